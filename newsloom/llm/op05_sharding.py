"""Sharding by sampled splitters, in DataFrame functions only; the law is ``bytes``.

The key of a record is (hash of its text, doc_id), so equal texts lie side by side and a group
of copies that is larger than a shard still splits. A sample that takes each key with a
probability in proportion to its size gives quantile boundaries; they cut the records into
``RANGES`` ranges of about equal bytes. Ranges that turn out overfull are subdivided by a hash
of the id. Bytes before each range, and running bytes in it, place every record exactly on the
line of all bytes; a shard is an equal stretch of that line. So shards differ by at most
one record's size from the mean, whatever the sample drew.

At most about ``8 * RANGES`` sampled keys reach the driver, and ``RANGES`` boundaries go out with
the plan; both are parameters, not functions of the data. Null texts have size 1 and the
checksum of no bytes. Repeated rows have one key and each gets its own slot; their order
among themselves is free. Rows with a null id come first among equal texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import stored

SHARDS = 16
RANGES = 512
OVERFULL = 2.0


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the text hash of every record."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"),
    )


def splitters(records: DataFrame, total: int, ranges: int) -> list[tuple[int, int]]:
    """Quantile boundaries of a size-weighted sample of keys; drawn by hash, so a lost task draws the same."""
    draw = F.pmod(F.xxhash64("doc_id", "h", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    sample = records.where(draw < F.col("size") * (8.0 * ranges / max(total, 1)))
    keys = sorted((r["h"], r["id"]) for r in sample.select("h", F.coalesce("doc_id", F.lit(-(2**63))).alias("id")).collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def with_range(records: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """The number of boundaries at or below each key, by binary search."""
    if not cuts:
        return records.withColumn("rng", F.lit(0))
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    heads, ids, last = F.lit([k[0] for k in cuts]), F.lit([k[1] for k in cuts]), len(cuts)

    def deeper(at, step):
        to = at + step
        inside = F.least(to, F.lit(last)) - 1
        head = F.get(heads, inside)
        below = (head < F.col("h")) | ((head == F.col("h")) & (F.get(ids, inside) <= F.coalesce("doc_id", F.lit(-(2**63)))))
        return F.when((to <= last) & below, to).otherwise(at)

    return records.withColumn("rng", F.aggregate(F.lit(steps), F.lit(0), deeper))


def shards(docs: DataFrame, n: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """Every record with its shard, and its slot in the shard."""
    records = stored(keyed(docs))
    whole = records.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    total, count = whole["bytes"] or 0, whole["rows"]
    ranged = with_range(records, splitters(records, total, ranges))

    # Subdivide ranges that hold too many records; a range that is one long text needs no more parts.
    load = ranged.groupBy("rng").agg(F.count(F.lit(1)).alias("rows"))
    full = stored(load.where(F.col("rows") > OVERFULL * count / ranges).select("rng", F.ceil(F.col("rows") * ranges / max(count, 1)).cast("int").alias("parts")))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts"))).cast("int")
    # At most RANGES rows: their size is bounded.
    placed = stored(ranged.join(F.broadcast(full), "rng", "left").withColumn("part", part).drop("parts"))

    line = Window.partitionBy("rng", "part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.withColumns({"bytes_in": F.sum("size").over(line), "rows_in": F.row_number().over(
        Window.partitionBy("rng", "part").orderBy("h", "doc_id"))})
    sums = placed.groupBy("rng", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("rng", "part").rowsBetween(Window.unboundedPreceding, -1)
    # At most about 2 * RANGES rows, whatever the input: one task, and a broadcast of bounded size.
    offsets = stored(sums.select("rng", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                                 F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before")))
    middle = F.col("bytes_before") + F.col("bytes_in") - F.col("size") / 2
    dealt = stored(
        inside.join(F.broadcast(offsets), ["rng", "part"])
        .select("doc_id", "size", "text_crc32", F.least(F.floor(middle * n / max(total, 1)), F.lit(n - 1)).cast("int").alias("shard"),
                (F.col("rows_before") + F.col("rows_in") - 1).alias("place"))
    )
    first = dealt.groupBy("shard").agg(F.min("place").alias("first"))
    return dealt.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
