"""Session helpers: a UTC session, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """The session, with this package sent to its Python workers, once an application.

    Spark serves the archive from the driver, so workers need no installed copy
    and no common folder.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        name = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{os.path.basename(PACKAGE)}.zip")
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, files in os.walk(PACKAGE):
                for f in files:
                    if f.endswith(".py"):
                        path = os.path.join(folder, f)
                        out.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
        sc.addPyFile(name)
        _shipped.add(sc.applicationId)
    return spark


def build_session(app: str = "newsloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    Cluster deployments pass their own master and sizing through spark-submit;
    only semantics (time zone) and adaptive execution are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def use_utc(spark: SparkSession) -> SparkSession:
    """Day casts and timestamps are defined in UTC, and workers have this package, whatever the session came with."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ship(spark)


def shared_folder(spark: SparkSession) -> str | None:
    """The folder of ``spark.checkpoint.dir``; None only where everything runs in one local process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage and forget how it was computed.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A local
    session without it (tests on one machine) gets a scratch folder; a cluster
    without it is an error, as executors could not see such a folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark) or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)
