"""Source divergence audit: how far each source's use of words is from the other sources of its language.

Terms are counted in Arrow batches, each task adding up what it has seen before anything is shuffled. A kept term is then
one row with a source-indexed array of its shares (the wide term vector); higher-order functions make its contributions
to all pairs of sources, and partial sums on the map side leave a row for each pair and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, ship
from .textcore import LOWER, column_bytes, map_batches, slices, words

# The shares' denominator, and how many documents a kept term is in.
SHARES, LEAST_DOCS = 1_000_000_000, 3
#: Rows of counts that a task holds before it passes them on, and bytes of text looked at at a time.
HELD, PIECE = 400_000, 1 << 22
#: Bytes of the sources' names up to which they are broadcast; beyond, terms meet them by salted keys.
BROADCAST, SALTS = 4 << 20, 64

IS_TERM = np.zeros(256, bool)
IS_TERM[np.r_[65:91, 97:123, 128:256]] = True

COUNTS = [("lang", "string"), ("source", "string"), ("term", "string"), ("n", "long"), ("docs", "long")]
_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def counted(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Table:
    """(lang, source, term, n, docs) of some rows: how often each term occurs, and in how many of them."""
    buf, off = column_bytes(text)
    buf = LOWER[buf]
    starts, ends, first = words(buf, off, IS_TERM)
    l, s = lang.dictionary_encode(), source.dictionary_encode()
    group = l.indices.to_numpy().astype(np.int64) * len(s.dictionary) + s.indices.to_numpy()
    length = ends - starts
    at = np.concatenate(([0], np.cumsum(length)))
    letters = buf[IS_TERM[buf]]  # the terms end to end: a term never crosses the end of a text
    terms = pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    k = max(len(terms.dictionary), 1)
    doc = np.repeat(np.arange(len(text)), np.diff(first))
    seen, n = np.unique(doc * k + terms.indices.to_numpy(), return_counts=True)
    key, back = np.unique(group[seen // k] * k + seen % k, return_inverse=True)
    g = key // k
    return pa.table([
        l.dictionary.take(pa.array(g // max(len(s.dictionary), 1))), s.dictionary.take(pa.array(g % max(len(s.dictionary), 1))), terms.dictionary.take(pa.array(key % k)).cast(pa.string()),
        pa.array(np.bincount(back, n, len(key)).astype(np.int64)), pa.array(np.bincount(back, minlength=len(key)).astype(np.int64)),
    ], schema=_SCHEMA)


def summed(parts: list[pa.Table]) -> pa.Table:
    """Counts of the same term and group added up."""
    t = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_SCHEMA.names)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): counts of whole texts, added up within each task; the same key may come from several tasks.

    Null texts, langs and sources are empty ones. Other columns are not looked at; rows may repeat and count each time.
    """
    ship(docs.sparkSession)
    own = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))

    def work(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = base = 0
        for b in batches:
            off = column_bytes(b["text"])[1]
            for i, j in slices(off, PIECE):
                held.append(counted(b["text"].slice(i, j - i), b["lang"].slice(i, j - i), b["source"].slice(i, j - i)))
                size += len(held[-1])
                if size > 2 * base + HELD:  # so that adding up costs as much as counting at most
                    held = [summed(held)]
                    size = base = len(held[0])
                    if size > HELD:
                        yield from held[0].to_batches(max_chunksize=20_000)
                        held, size, base = [], 0, 0
        if held:
            yield from summed(held).to_batches(max_chunksize=20_000)

    return map_batches(own, work, COUNTS)


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, found): terms in `least` documents of their language or more; found: array of struct(source, n), each source once."""
    one = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    both = one.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("found"))
    return both.where(F.col("docs") >= least).drop("docs")


def share(n: str, total: str) -> str:
    """SQL: 1 + floor(SHARES * (n + 1) / total), exact also where the product is beyond a long."""
    return f"1 + CASE WHEN {n} < 9000000000 THEN ({n} + 1) * {SHARES} div {total} ELSE CAST((CAST({n} AS DECIMAL(28,0)) + 1) * {SHARES} div {total} AS BIGINT) END"


def languages(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, n_terms, total, sources): every language, with the kept terms' number and occurrences, and its sources in order with theirs."""
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    n = kept.select("lang", F.explode("found").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    of = groups.join(n, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return of.join(terms, "lang", "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))


def settled(df: DataFrame, *columns) -> DataFrame:
    """A projection that later ones are not merged with: what lambdas use of it is worked out once a row, not once an element."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def wide(kept: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, term, counts, p, q): a term's count and share in each source of its language, by the sources' order, and its share in the language."""
    size = langs.agg(F.sum(F.aggregate("sources", F.length("lang") + 32, lambda a, s: a + F.length(s["source"]) * 4 + 24))).first()[0] or 0
    if size <= BROADCAST:
        both = kept.join(F.broadcast(langs), "lang")
    else:
        salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    keep = ("lang", "term", "sources", "n_terms", "total")
    of = settled(both, *keep, F.map_from_entries("found").alias("m"))
    of = settled(of, *keep, F.transform("sources", lambda s: F.coalesce(F.try_element_at("m", s["source"]), F.lit(0).cast("long"))).alias("counts"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
    return settled(of, "lang", "term", "counts", F.expr(f"zip_with(counts, sources, (n, s) -> {share('n', '(s.n + n_terms)')})").alias("p"), F.expr(share("n", "(total + n_terms)")).alias("q"))


def distance(p: str, q: str) -> str:
    return f"({p} - {q}) * ({p} - {q}) div {q}"


def pair_sums(terms: DataFrame) -> DataFrame:
    """(lang, i, j, value): the distance of source i from source j, summed over a language's kept terms."""
    rows = terms.select("lang", "p", F.posexplode("p").alias("i", "own"))
    each = rows.select("lang", "i", F.posexplode(F.expr(f"transform(p, x -> {distance('own', 'x')})")).alias("j", "f"))
    return each.where("i <> j").groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))


def top_terms(terms: DataFrame, most: int = 200) -> DataFrame:
    """(lang, i, item, value, rank): each source's terms above the language's share, the `most` furthest from it."""
    rows = terms.select("lang", F.col("term").alias("item"), "q", F.posexplode(F.arrays_zip("counts", "p")).alias("i", "x")).where("x.counts > 0 AND x.p > q")
    rows = rows.select("lang", "i", "item", F.expr(distance("x.p", "q")).alias("value"))
    w = Window.partitionBy("lang", "i").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def audit(docs: DataFrame, least: int = LEAST_DOCS, most: int = 200) -> DataFrame:
    """docs (text, lang, source) -> (lang, source, part, item, value, rank).

    Part `pair`: every other source of the language, by the summed distance of this source's shares from its. Part `term`:
    the source's terms above the language's share, the `most` first. Ranks go by value, larger first, then by the item's
    UTF-8 bytes. Null texts, langs and sources count as empty ones; a source without terms has the shares of zero counts;
    a language without kept terms has pairs of 0 and no terms; an empty table gives an empty one. Columns of other names
    are not looked at. A sum beyond a long is an error, not a wrong number.
    """
    scratch = Scratch(docs.sparkSession)
    kept = scratch.write(kept_terms(term_counts(docs), least), "kept_terms")
    langs = scratch.write(languages(docs, kept), "languages")
    terms = wide(kept, langs)
    names = langs.select("lang", F.posexplode("sources").alias("i", "s")).select("lang", "i", F.col("s.source").alias("source"))
    sums = scratch.write(pair_sums(terms), "pair_sums")
    tops = scratch.write(top_terms(terms, most), "top_terms")
    other = names.select("lang", F.col("i").alias("j"), F.col("source").alias("item"))
    pairs = names.join(other, "lang").where("i <> j").join(sums, ["lang", "i", "j"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    w = Window.partitionBy("lang", "i").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(w)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    out = pairs.unionByName(tops.join(names, ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
    scratch.drop("kept_terms")
    return out
