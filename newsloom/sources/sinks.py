"""Writers: idempotent reading lists and the metric exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import round_to


def persist_list(items: DataFrame, folder: str, regenerate: bool = False) -> DataFrame:
    """A13. Store user-day lists under ``folder``, one partition per ``list_date``.

    A user-day that is stored already stays as it is, unless ``regenerate``; then
    its items are replaced. Stored users of the same dates are carried over and
    only the touched date partitions are rewritten, after a checkpointed copy:
    the job never overwrites what it still reads. Running it twice changes
    nothing.
    """
    from newsloom.session import cut_lineage

    spark = items.sparkSession
    stored = read_lists(spark, folder, items)
    keys = ["user_id", "list_date"]
    items = cut_lineage(items)  # its dates and its rows are read apart
    dates = items.select("list_date").distinct()
    same_dates = stored.join(dates, "list_date", "left_semi")
    if regenerate:
        old = same_dates.join(items.select(*keys).distinct(), keys, "left_anti")
        new = items
    else:
        old = same_dates
        new = items.join(same_dates.select(*keys).distinct(), keys, "left_anti")
    merged = cut_lineage(old.unionByName(new))
    (
        merged.repartition("list_date", F.pmod(F.xxhash64("user_id"), F.lit(16)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("list_date")
        .parquet(folder)
    )
    return spark.read.schema(items.schema).parquet(folder)


def read_lists(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """Stored lists, or an empty table of the same shape before the first write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(folder)


def export_csv(df: DataFrame, folder: str) -> None:
    """A14. CSV with a header, numbers with three decimals, nulls blank; written by
    every task in parallel. Float noise is dropped first, so a sum just below a tie
    rounds as the tie does, whatever the order of its terms."""
    columns = [
        F.format_string("%.3f", round_to(F.col(c), 3)).alias(c) if t in ("double", "float") else F.col(c).cast("string").alias(c)
        for c, t in df.dtypes
    ]
    rows = df.select(*[F.when(F.col(c).isNotNull(), x).alias(c) for c, x in zip(df.columns, columns, strict=True)])
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").csv(folder)
