"""Token counts by an exact length histogram: documents by encoded length, and suffix sums over the lengths.

The histogram answers, for every context limit, how many documents are longer, the total with each document truncated
at the limit, and quantiles, without going back to the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .bpe import count

BAND = 256  # lengths in a band; sums run within bands, and a short table carries them from band to band


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(length, n_docs): how many whole texts have each encoded length. Null and empty texts have length 0. Rows may repeat."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    return count(texts, path=path).groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """(length, n_docs) -> for each occurring length, taken as a context limit:

    n_docs of just that length, docs_up_to, docs_longer, tokens_up_to (of documents no longer), tokens_longer,
    truncated_total (all documents cut at the limit), lost_tokens, quantile (share of documents no longer).
    Between two occurring limits all of these follow from the lower one: see at_limits(). An empty histogram gives an
    empty table.
    """
    h = materialize(histogram.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("band", F.floor(F.col("length") / BAND)), "histogram")
    bands = h.groupBy("band").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each 256 lengths that occur, whatever the number of documents.
    later = bands.select("band", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("ld"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("lt"))
    total = bands.agg(F.sum("bd").alias("all_docs"), F.sum("bt").alias("all_tokens"))
    inside = Window.partitionBy("band").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    sums = h.withColumns({"sd": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)), "st": F.coalesce(F.sum("tokens").over(inside), F.lit(0))})
    joined = sums.join(later, "band").crossJoin(F.broadcast(total))  # total is one row
    longer, tokens = F.col("sd") + F.col("ld"), F.col("st") + F.col("lt")
    cut = F.col("all_tokens") - tokens + F.col("length") * longer
    return joined.select("length", "n_docs", (F.col("all_docs") - longer).alias("docs_up_to"), longer.alias("docs_longer"), (F.col("all_tokens") - tokens).alias("tokens_up_to"), tokens.alias("tokens_longer"), cut.alias("truncated_total"), (F.col("all_tokens") - cut).alias("lost_tokens"), ((F.col("all_docs") - longer) / F.col("all_docs")).alias("quantile"))


def at_limits(table: DataFrame, wanted: list[int]) -> DataFrame:
    """(context_limit, docs_longer, truncated_total) for any limits, from limits(): one aggregate over the lengths that occur. An empty table gives zeros."""
    n, longer, cut = F.col("n_docs"), "docs_longer", "truncated_total"
    each = [F.struct(F.lit(int(w)).cast("long").alias("context_limit"), F.coalesce(F.sum(F.when(F.col("length") > w, n)), F.lit(0)).alias(longer), F.coalesce(F.sum(F.least("length", F.lit(int(w))) * n), F.lit(0)).alias(cut)) for w in wanted]
    return table.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def quantile(table: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents do not exceed."""
    return table.where(F.col("quantile") >= q).agg(F.min("length")).first()[0]
