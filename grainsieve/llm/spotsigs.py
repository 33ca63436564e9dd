"""Document fingerprints by SpotSigs, in DataFrame functions only.

A spot is a run of common words (anchors) followed by content words; its signature is the last anchor of the run with
the chain of the next two content words, anchors between them passed over. A fingerprint is the set of a text's
signatures. Texts without a spot have one signature, of all their words or, failing words, of the text itself.

near_copies() finds all pairs of like fingerprints: they are partitioned by set length, only meet within a partition or
the next one, and pairs that lengths or positions rule out are not compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

# Common words of four languages.
ANCHORS = """
a an and are as at be by for from had has have he her his in is it its not of on or she that the their they this to was were which with you
al con de del el en es ha la las lo los no para por que se su un una y
au aux avec ce dans des du elle est et il je le les ne nous ou par pas pour qui sa se ses son sur une vous
als auch auf aus bei das dem den der des die ein eine er es für ich ihr im ist mit nach nicht oder sein sich sie so und von vor war wie wir zu zum zur
""".split()

PER_BUCKET = 400  # documents in a range of doc_id that is put in order at once
SEGMENTS, FEW = 128, 1024


def _is_anchor(word: Column) -> Column:
    return word.isin(sorted(set(ANCHORS)))


def with_signatures(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """df with a sorted array of signatures for each {column: text column}. Null and empty texts have none."""
    own = list(df.columns)
    words = {o: F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(t).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ") for o, t in texts.items()}
    df = df.select(*own, *(w.alias(f"_w_{o}") for o, w in words.items()))

    def content(o: str) -> Column:
        w = F.col(f"_w_{o}")
        return F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: ~_is_anchor(F.get(w, i)))

    df = df.select(*df.columns, *(content(o).alias(f"_c_{o}") for o in texts))

    def spots(o: str, t: str) -> Column:
        w, c = F.col(f"_w_{o}"), F.col(f"_c_{o}")

        def spot(r: Column) -> Column:
            at = F.get(c, r)
            return F.when((at > 0) & ((r == 0) | (F.get(c, r - 1) < at - 1)), F.hash(F.get(w, at - 1), F.get(w, at), F.get(w, F.get(c, r + 1))))

        found = F.when(F.size(c) > 1, F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 2, F.lit(0))), spot), lambda x: x.isNotNull())).otherwise(F.array().cast("array<int>"))
        return found

    df = df.select(*df.columns, *(spots(o, t).alias(f"_s_{o}") for o, t in texts.items()))

    def whole(o: str, t: str) -> Column:
        text = F.coalesce(F.col(t).cast("string"), F.lit(""))
        joined = F.array_join(F.col(f"_w_{o}"), " ")
        lone = F.when(joined != "", F.array(F.hash(joined))).when(text != "", F.array(F.hash(text))).otherwise(F.array().cast("array<int>"))
        return F.when(F.size(f"_s_{o}") > 0, F.sort_array(F.array_distinct(f"_s_{o}"))).otherwise(lone)

    return df.select(*own, *(whole(o, t).alias(o) for o, t in texts.items()))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets: 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise((both / (F.size(a) + F.size(b) - both)).cast("double"))


def as_text(signatures: Column) -> Column:
    """A fingerprint to keep: the set's size and its members in order."""
    return F.concat_ws(":", F.size(signatures).cast("string"), F.array_join(signatures.cast("array<string>"), ","))


def _place(doc_id: Column, tie: Column, bounds: list[int], inner: int, nulls: int) -> Column:
    """The range that a row of (doc_id, tie) falls into; ranges are numbered in the rows' order, null ids first.

    bounds cut the ids into segments of about as many rows each, and a segment is cut evenly into `inner` ranges, so
    neither ids far apart nor crowded ones make a large range. Rows of null doc_id are spread by their tie.
    """
    edges = [float(b) for b in bounds]
    at = doc_id.cast("double")
    segment = F.size(F.filter(F.array(*map(F.lit, edges)), lambda b: b <= at))
    low, high = (F.get(F.array(*map(F.lit, [edges[0], *edges] if k == 0 else [*edges, edges[-1]])), segment) for k in (0, 1))
    within = F.when(high > low, F.least(F.floor((at - low) / (high - low) * inner), F.lit(inner - 1))).otherwise(0)
    first = F.floor((tie.cast("double") / 2.0**64 + 0.5) * nulls)
    return F.when(doc_id.isNull(), F.greatest(F.least(first, F.lit(nulls - 1)), F.lit(0)) - nulls).otherwise(segment * inner + F.greatest(within, F.lit(0))).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with next_text, _bucket and _tie: the text of the next document by doc_id, after the last the first's.

    Ids are cut into ranges, and each range also gets the next range's first document, so no task holds more than
    a range. Rows of null doc_id come first; those and rows that share a doc_id are put in order by their texts' hash.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    shares = [k / SEGMENTS for k in range(SEGMENTS + 1)]
    n, nulls, bounds = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", shares, 10 * SEGMENTS)).first()
    bounds = sorted(set(bounds or [0]))
    docs = docs.withColumn("_bucket", _place(F.col("doc_id"), F.col("_tie"), bounds, n // (PER_BUCKET * SEGMENTS) + 1, nulls // PER_BUCKET + 1))
    # One row for each range that is not empty: the range before it, in a ring. Only every FEW-th range is put in order in one task.
    firsts = docs.groupBy("_bucket").agg(F.min(F.struct("doc_id", "_tie")).alias("_first")).withColumn("_few", F.floor(F.col("_bucket") / FEW))
    groups = firsts.groupBy("_few").agg(F.max("_bucket").alias("_top"))
    over = Window.orderBy("_few")
    before = groups.select("_few", F.lag("_top").over(over).alias("_prior"), F.max("_top").over(Window.orderBy(F.desc("_few")).rowsBetween(Window.unboundedPreceding, 0)).alias("_last"))
    firsts = firsts.withColumn("_near", F.lag("_bucket").over(Window.partitionBy("_few").orderBy("_bucket"))).join(before, "_few")
    firsts = materialize(firsts.select("_bucket", "_first", F.coalesce("_near", "_prior", "_last").alias("_before")), "firsts")
    guests = docs.join(firsts.select("_bucket", "_first", "_before"), "_bucket").where(F.struct("doc_id", "_tie") == F.col("_first")).select("doc_id", "text", "_tie", F.col("_before").alias("_bucket"), F.lit(1).alias("_guest"))
    rows = docs.select("doc_id", "text", "_tie", "_bucket", F.lit(0).alias("_guest")).union(guests)
    order = Window.partitionBy("_bucket").orderBy("_guest", F.asc_nulls_first("doc_id"), "_tie")
    return rows.withColumn("next_text", F.lead("text").over(order))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, fingerprint, and those of the edited text, with likenesses; one row per input row.

    The edited text has the last floor(n_chars / 2) characters replaced by the first as many of the next document.
    Null texts count as empty; two empty fingerprints are alike (1.0), an empty one and another are not (0.0). Equal
    texts have equal fingerprints. Other columns are dropped; rows may repeat; doc_ids may be any longs, however far
    apart. An empty table gives an empty one.
    """
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("doc_id", "_bucket", "_guest", "_tie", F.col("text"), n.cast("long").alias("n_chars"), edited.alias("_edited"))
    rows = with_signatures(rows, {"_own": "text", "_cut": "_edited"})
    rows = rows.select("doc_id", "_bucket", "_guest", "_tie", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "_own", "_cut", likeness(F.col("_own"), F.col("_cut")).alias("near_edited"))
    order = Window.partitionBy("_bucket").orderBy("_guest", F.asc_nulls_first("doc_id"), "_tie")
    rows = rows.withColumn("_next", F.lead("_own").over(order)).where("_guest = 0")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("_own")).alias("fingerprint"), as_text(F.col("_cut")).alias("edited_fingerprint"), "near_edited", likeness(F.col("_own"), F.col("_next")).alias("near_next"))


def _partition(n: Column, num: int, den: int, longest: int) -> Column:
    """The length partition of a set; a set's partners of at least num/den of its length are in its own or a neighbouring one."""
    lows = [1]
    while lows[-1] <= longest:
        lows.append(max(lows[-1] + 1, -(-lows[-1] * den // num)))
    return F.size(F.filter(F.array(*map(F.lit, lows)), lambda low: low <= n))


def near_copies(docs: DataFrame, threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """(doc_id, text) -> (a, b, likeness): all pairs of doc_ids a < b whose fingerprints' Jaccard similarity is at least num/den.

    Equal fingerprints are compared once. A set's first n - ceil(n * num / den) + 1 signatures, rarest first, must hold
    one of any partner's: only these are join keys, with the length partition. Pairs go before their sets are compared
    if their lengths, or the places of the signature that they meet at, leave too few in common. Empty fingerprints and
    rows of null doc_id are in no pair; rows that share a doc_id give the likest pair. Pairs grow with the square of a
    group of near copies, as they are what is asked for. An empty table gives an empty one.
    """
    num, den = threshold
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows = with_signatures(rows, {"sigs": "text"}).where(F.size("sigs") > 0).select("doc_id", "sigs", F.sha2(F.array_join(F.col("sigs").cast("array<string>"), ","), 256).alias("id"))
    rows = materialize(rows.distinct(), "fingerprints")
    sets = rows.groupBy("id").agg(F.first("sigs").alias("sigs"))
    each = sets.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("often"))
    ranked = each.join(often, "sig").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "sig"))).alias("s"))
    ranked = ranked.select("id", F.size("s").alias("n"), F.transform("s", lambda x: x["sig"]).alias("s"))
    longest = ranked.agg(F.max("n")).first()[0] or 1
    own = (F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1).cast("int")
    keys = ranked.select("id", "n", _partition(F.col("n"), num, den, longest).alias("part"), F.posexplode(F.slice("s", F.lit(1), own)).alias("at", "sig"))
    keys = materialize(keys, "prefixes")
    x = keys.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    y = keys.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"), "sig", "part")
    both = F.lit(num) * (F.col("nx") + F.col("ny"))  # num / (num + den) of it, at least, are in common
    left = F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay")) + F.least("ax", "ay")
    pairs = x.join(y, ["sig", "part"]).where("nx < ny or nx = ny and x < y").where((F.col("nx") * den >= F.col("ny") * num) & (left * (num + den) >= both))
    pairs = materialize(pairs.select("x", "y").distinct(), "pairs")
    like = pairs.join(sets.select(F.col("id").alias("x"), F.col("sigs").alias("sx")), "x").join(sets.select(F.col("id").alias("y"), F.col("sigs").alias("sy")), "y")
    common = F.size(F.array_intersect("sx", "sy"))
    like = like.where(common * den >= (F.size("sx") + F.size("sy") - common) * num).select("x", "y", likeness(F.col("sx"), F.col("sy")).alias("likeness"))
    like = like.union(sets.select(F.col("id").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("likeness")))
    found = like.join(rows.select(F.col("id").alias("x"), F.col("doc_id").alias("dx")), "x").join(rows.select(F.col("id").alias("y"), F.col("doc_id").alias("dy")), "y").where("dx <> dy")
    return found.groupBy(F.least("dx", "dy").alias("a"), F.greatest("dx", "dy").alias("b")).agg(F.max("likeness").alias("likeness"))
