"""Sharding by longest-processing-time scheduling: groups that stay together, largest first, each to the least-loaded shard.

Groups of one size are alike, so the heap runs over the exact histogram of group sizes and not over groups; it is the
only thing that reaches the driver. Different sizes add up to no more than the input, so there are at most
sqrt(2 * bytes) of them: under 250,000 at 30 GB and 15 million, if every size occurred, at 100 TB. Groups of one size
are numbered without gathering them in one task, and a group's number says which shard it goes to.
"""

from __future__ import annotations

from heapq import heapify, heapreplace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

def schedule(histogram: list[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int, int]]]:
    """(size, groups) -> for each size, (from, to, shard) over the numbers of its groups.

    Groups are placed one by one through a heap of (load, shard) while that can change the order of loads; once all
    shards' loads lie within one group's size, whole rounds over all shards follow, which leave them in that order.
    """
    heap = [(0, s) for s in range(shards)]
    out: dict[int, list[tuple[int, int, int]]] = {}
    for size, n in sorted(histogram, reverse=True):
        at, runs = 0, []
        while at < n:
            low = heap[0][0]
            if n - at >= shards and max(heap)[0] - low <= size:
                each = (n - at) // shards
                order = sorted(heap)
                for _, s in order:
                    runs.append((at, at + each, s))
                    at += each
                heap = [(load + each * size, s) for load, s in order]
                heapify(heap)
                continue
            load, s = heap[0]
            # As many as go here before another shard is less loaded.
            second = min(heap[1:3])[0] if len(heap) > 1 else float("inf")
            take = n - at if len(heap) == 1 else min(n - at, max(1, int((second - load) // size)))
            runs.append((at, at + take, s))
            at += take
            heapreplace(heap, (load + take * size, s))
        out[size] = runs
    return out


def numbered(df: DataFrame, by: list[str], chunk, order: list[str], out: str) -> DataFrame:
    """df with out: a gapless number from 0 within each key of `by`, worked out in chunks so that no task holds a whole key."""
    df = df.withColumn("_chunk", chunk)
    counts = df.groupBy(*by, "_chunk").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = df.withColumn("_row", F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy(*order)) - 1)
    return inside.join(before, [*by, "_chunk"]).withColumn(out, (F.col("_row") + F.col("_before")).cast("long")).drop("_row", "_before", "_chunk")


def shard_by_size(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, text) -> (doc_id, size, text_crc32, group, shard, slot), one row per input row.

    size is the text's UTF-8 bytes plus 1. Equal texts are one group and share a shard; null texts are one group, of
    size 1 each, and count as empty for the checksum. slot numbers a shard's rows from 0 without gaps. Rows may repeat and
    doc_id may be null or repeat. One text's copies cannot be split, so a text with more than a shard's share makes
    its shard the largest. Other columns are dropped. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("null")), 256).alias("group"))
    each = materialize(each, "sized")
    chunks = max(16, int(each.count() // 50_000) + 1)
    groups = each.groupBy("group").agg(F.sum("size").alias("bytes"))
    chunk = F.pmod(F.xxhash64("group"), F.lit(chunks))
    groups = materialize(numbered(groups, ["bytes"], chunk, ["group"], "rank"), "groups")
    histogram = [(r[0], r[1]) for r in groups.groupBy("bytes").agg(F.count("*")).collect()]  # bounded: see above
    plan = [(c, a, z, s) for c, runs in schedule(histogram, shards).items() for a, z, s in runs]
    planned = spark.createDataFrame(plan, "bytes long, lo long, hi long, shard int")
    # A size has few runs, so its groups are matched by size and the run that holds their number.
    of_group = groups.join(planned, "bytes").where("rank >= lo and rank < hi").select("group", "shard")
    placed = materialize(each.join(of_group, "group"), "placed")
    return numbered(placed, ["shard"], F.pmod(F.xxhash64("doc_id", "group"), F.lit(chunks)), ["doc_id", "group"], "slot")


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The law `bytes`: shards near equal in size; growing by a shard would move any row, so grown_shard is null."""
    return shard_by_size(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
