"""Hard negatives by a vector-approximation file: cells of every dimension, bounds of scores by table lookup, exact scores of what is left.

Each dimension's range is cut into cells of equal width, and a row is approximated by its cells, a byte each. For an
anchor a table holds the least product that each cell of each dimension can give; a row's table entries add up to a lower
bound of its score, and the upper bound lies above it by the same amount for all rows. Only rows whose bounds let them
enter an anchor's first positives, or the window of one of its positives, are scored exactly.

Anchors come in blocks of bounded bytes; each block is broadcast and meets all rows where they lie. A task passes on its
own first rows of every anchor and window, which is all that the whole's first rows can be among.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, ship
from .textcore import map_batches

#: Cells of a dimension; bytes of a block of anchors; components of the rows that a task looks at at a time.
CELLS, BLOCK_BYTES, PIECE = 256, 8 << 20, 1 << 20


def prepared(vectors: DataFrame, vector: str = "embedding", label: Column | str = "label", scale: int = 256) -> DataFrame:
    """(vec_id, label, v): rows that take part, with components floor(scale * x) as longs.

    Out are rows with a null vec_id, label or vector, and vectors with a null or non-finite component.
    """
    x = F.transform(vector, lambda c: c.cast("double"))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), x.alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return own.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(~odd).withColumn("v", F.transform("v", lambda c: F.floor(c * float(scale)).cast("long")))


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass
class Cells:
    """Cells of equal whole width for each dimension, from its least to its largest component."""

    low: np.ndarray
    width: np.ndarray
    exact: type  # what holds every score without rounding
    bound: type  # what holds every bound

    @classmethod
    def of(cls, low: np.ndarray, high: np.ndarray) -> Cells:
        most = max(int(np.abs(low).max(initial=0)), int(np.abs(high).max(initial=0)))
        if len(low) * most * most >= 1 << 62:
            raise ValueError(f"scores of {len(low)} components up to {most} do not fit a long; take a smaller scale")
        width = np.array([-((int(a) - int(z) - 1) // CELLS) for a, z in zip(low, high, strict=True)], np.int64)
        return cls(low, width, np.float64 if len(low) * most * most < 1 << 53 else np.int64, np.int32 if 4 * len(low) * (most + int(width.max(initial=0))) ** 2 < 1 << 31 else np.int64)

    def approximate(self, v: np.ndarray) -> np.ndarray:
        """The cells of rows, dimension by dimension."""
        return np.ascontiguousarray(((v - self.low) // self.width).astype(np.uint8).T)

    def table(self, a: np.ndarray) -> tuple[np.ndarray, int]:
        """For an anchor the least product of each cell of each dimension, and by how much a score can lie above the sum of these."""
        near = self.low[:, None] + self.width[:, None] * np.arange(CELLS)
        far = near + self.width[:, None] - 1
        return np.minimum(a[:, None] * near, a[:, None] * far).astype(self.bound), int((np.abs(a) * (self.width - 1)).sum())


def least_scores(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Lower bounds of the scores of rows, by adding up the table's entries for their cells."""
    out = np.zeros(cells.shape[1], table.dtype)
    for d, row in enumerate(cells):
        out += table[d].take(row)
    return out


def first(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first rows by score, larger first, then by id."""
    if len(score) > 4 * most:  # nothing below the most-th score can be among them
        keep = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
        return keep[np.lexsort((ids[keep], -score[keep]))[:most]]
    return np.lexsort((ids, -score))[:most]


def kth(x: np.ndarray, k: int):
    """The k-th largest value, or None where there are fewer."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else None


@dataclass
class Anchors:
    """A block of anchors; windows: for each the (place, low, high) of its positives, once these are known."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    windows: list[list[tuple[int, int, int]]] | None = None


def search(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, cells: Cells, anchors: Anchors, most: int) -> list[tuple[int, int, int, int]]:
    """(anchor, window, id, score) of these rows' first `most` for every anchor, or for every window of it.

    Without windows the rows of the anchor's own label are looked at (window 0), else those of other labels.
    """
    near = cells.approximate(v)
    exact_v = v.astype(cells.exact)
    out = []
    for a in range(len(anchors.ids)):
        if anchors.windows is None:
            at = np.flatnonzero((labels == anchors.labels[a]) & (ids != anchors.ids[a]))
            windows = [(0, None, None)]
        else:
            at = np.flatnonzero((labels != anchors.labels[a]) & (ids != anchors.ids[a]))
            windows = anchors.windows[a]
        if not len(at) or not windows:
            continue
        table, slack = cells.table(anchors.v[a])
        low = least_scores(table, near)[at]
        own = anchors.v[a].astype(cells.exact)
        for k, least, top in windows:
            if least is None:
                here, bar = at, kth(low, most)
                if bar is not None:
                    here = at[low + slack >= bar]
            else:
                may = (low + slack >= least) & (low <= top)  # the window may be entered
                sure = low[may & (low >= least) & (low + slack <= top)]
                bar = kth(sure, most)
                here = at[may if bar is None else may & (low + slack >= bar)]
            score = (exact_v[here] @ own).astype(np.int64)
            if least is not None:
                inside = (score >= least) & (score <= top)
                here, score = here[inside], score[inside]
            best = first(score, ids[here], most)
            out += zip([a] * len(best), [k] * len(best), ids[here][best].tolist(), score[best].tolist(), strict=True)
    return out


FOUND = [("anchor", "int"), ("window", "int"), ("vec_id", "long"), ("score", "long")]


def nearest(rows: DataFrame, cells: Cells, anchors: Anchors, most: int) -> DataFrame:
    """(anchor, window, vec_id, score, rank): the first `most` of all rows, from the first of each task."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((cells, anchors))  # BLOCK_BYTES of anchors
    dims = len(cells.low)

    def work(batches) -> Iterator[pa.RecordBatch]:
        c, block = shared.value
        best: list[np.ndarray] = []
        held: list[tuple[np.ndarray, ...]] = []

        def look() -> None:
            ids, labels, v = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            found = np.array(search(ids, labels, v, c, block, most), np.int64).reshape(-1, 4)
            both = np.concatenate([*best, found])
            both = both[np.lexsort((both[:, 2], -both[:, 3], both[:, 1], both[:, 0]))]
            new = np.ones(len(both), bool)
            new[1:] = (both[1:, :2] != both[:-1, :2]).any(1)
            start = np.maximum.accumulate(np.where(new, np.arange(len(both)), 0))
            best[:] = [both[np.arange(len(both)) - start < most]]

        for b in batches:
            if len(b):
                held.append((b["vec_id"].to_numpy(zero_copy_only=False), b["label"].to_numpy(zero_copy_only=False), matrix(b["v"], dims)))
                if sum(x[2].size for x in held) >= PIECE:
                    look()
        if held:
            look()
        for x in best:
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array(x[:, 1].astype(np.int32)), pa.array(x[:, 2]), pa.array(x[:, 3])], [n for n, _ in FOUND])

    found = map_batches(rows.select("vec_id", "label", "v"), work, FOUND)
    w = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """Hard negatives of prepared() rows: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: a condition on vec_id and label that says which rows are anchors. For each anchor its first `positives` rows of
    the same label by score, and for each of these the first `negatives` rows of other labels whose score is `least` to
    `most` hundredths of the positive's. Larger scores come first, ties by smaller vec_id.

    A row of the anchor's own vec_id is neither. Rows that repeat a vec_id are rows of their own; anchors that are equal in
    everything count once. The vectors have one length: the one that most rows have, the longer of equals; others take no
    part. An anchor without positives, and a positive without negatives, have no row. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    ship(spark)
    empty = spark.createDataFrame([], RESULT)
    scratch = Scratch(spark)
    rows = scratch.write(rows.select("vec_id", "label", "v"), "vectors")  # every block of anchors reads them twice
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if sizes is None or sizes.n == 0:
        return empty
    dims = sizes.n
    rows = rows.where(F.size("v") == dims)

    def edges(batches) -> Iterator[pa.RecordBatch]:
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if len(b):
                v = matrix(b["v"], dims)
                ends = [(np.minimum.reduce([v.min(0), *(x for x, _ in ends)]), np.maximum.reduce([v.max(0), *(x for _, x in ends)]))]
        for low, high in ends:
            yield pa.RecordBatch.from_arrays([pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([high.tolist()], pa.list_(pa.int64()))], ["low", "high"])

    each = map_batches(rows.select("v"), edges, [("low", "array<long>"), ("high", "array<long>")])
    ends = each.select(F.posexplode(F.arrays_zip("low", "high")).alias("d", "x")).groupBy("d").agg(F.min("x.low"), F.max("x.high")).orderBy("d").collect()
    cells = Cells.of(np.array([r[1] for r in ends], np.int64), np.array([r[2] for r in ends], np.int64))
    chosen = scratch.write(rows.where(anchor).select("vec_id", "label", "v").distinct(), "anchors")
    blocks = -(-chosen.count() * dims * 16 // BLOCK_BYTES)  # half full on average, as hashes deal them out
    block = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(max(blocks, 1)))
    if not blocks:
        return empty
    dealt = scratch.path("blocks")
    chosen.withColumn("block", block).repartition(min(blocks, 256), "block").write.partitionBy("block").parquet(dealt)
    out = scratch.path("hard_negatives")
    for k in range(blocks):
        mine_ = spark.read.schema("vec_id long, label long, v array<long>, block int").parquet(dealt).where(F.col("block") == k).orderBy("vec_id", "label").toPandas()
        if not len(mine_):
            continue
        anchors = Anchors(mine_["vec_id"].to_numpy(), mine_["label"].to_numpy(), np.stack(mine_["v"]))
        found = nearest(rows, cells, anchors, positives).select("anchor", "rank", "vec_id", "score").toPandas()  # a few for each anchor of the block
        anchors.windows = [[] for _ in anchors.ids]
        for a, place, score in zip(found["anchor"], found["rank"], found["score"], strict=True):
            s = int(score)
            anchors.windows[a].append((int(place), -(-least * s // 100), most * s // 100))
        told = spark.createDataFrame(found.assign(anchor_id=anchors.ids[found["anchor"]])[["anchor", "rank", "anchor_id", "vec_id", "score"]], "anchor int, window int, anchor_id long, positive_id long, positive_score long") if len(found) else None
        if told is None:
            continue
        near = nearest(rows, cells, anchors, negatives)
        made = near.join(F.broadcast(told), ["anchor", "window"])
        made.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{out}/block={k}")
    scratch.close("hard_negatives")
    return spark.read.schema(RESULT).parquet(f"{out}/block=*") if _exists(spark, out) else empty


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
