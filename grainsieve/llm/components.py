"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch

#: A key is hot if more than this share of all rows have it; so at most 1/HOT keys are.
HOT = 0.001


def join_sized(rows: DataFrame, sized: DataFrame, by: str, total: int) -> DataFrame:
    """rows joined with `sized`, which has one row for each key and with n how many of `total` rows, at most, have the key.

    The hot keys' rows are broadcast: as each has over HOT of the total, there are at most 1/HOT of them at any size of
    the input. So no task gets all rows of a hot key.
    """
    rest = [c for c in sized.columns if c != by]
    hot = F.col("n") > max(HOT * total, 50)
    marked = rows.join(F.broadcast(sized.where(hot).select(by, F.struct(*rest).alias("_hot"))), by, "left")
    cold = marked.where("_hot is null").drop("_hot").join(sized.where(~hot), by)
    return marked.where("_hot is not null").select(*rows.columns, *(F.col(f"_hot.{c}").alias(c) for c in rest)).union(cold.select(*rows.columns, *rest))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links between ids of any orderable type -> (id, component), the smallest id that each id reaches.

    Ids without a link do not appear. Null ends and loops are ignored; repeated links count once. Each round is
    written to the shared folder, in place of the one before. No round gathers a node's neighbours: a node's smallest
    neighbour is an aggregate, and hot nodes hand it on by a broadcast of bounded size. An empty table gives an empty one.
    """
    scratch = Scratch(edges.sparkSession)
    ends = edges.where("a is not null and b is not null and a <> b")
    now = scratch.write(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges0")
    before = None
    for k in range(1, most_rounds + 1):
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_sized(both.where("v > u"), least, "u", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large, f"large{k}")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_sized(large, least, "u", state[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = scratch.write(small, f"edges{k}")
        scratch.drop(f"edges{k - 1}", f"large{k}")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
