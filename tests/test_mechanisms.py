"""Plans that stay small, terms as relations, states of streams, the data source of reports and the recogniser's table function."""

import random
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import udf

import __spark_entry__
from grainsieve import plain
from grainsieve.operators import lookups, recognition, terms
from grainsieve.sources import recognizer, reports
from grainsieve.sources.kb import knowledge_base
from grainsieve.streaming import jobs

KB = knowledge_base()
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [
    "full_report", "verdict_lattice", "baseline_verdict", "population_final", "constraint_status", "constraint_nutrition_max", "risk_weighted", "risk_factors", "verdicts_side_by_side", "crosscheck_gain", "batch_summary", "history_summary",
    "allergen_detect", "allergen_profile_filter", "avoid_words", "reject_gate", "confidence_min", "layout_to_report", "layout_regions", "clause_summaries", "box_shapes", "polygon_measures",
])
def test_plans_stay_small(spark, name):
    """No expression of the rule engine is written out more than once or so."""
    df = __spark_entry__.queries()[name](spark, SMALL)
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 210_000


@pytest.mark.parametrize("name", ["ctc_decode", "layout_regions", "layout_to_report", "boxes_in_reading_order", "parse_ingredients_leveled"])
def test_rows_are_dealt_out_before_the_work(spark, name):
    """A part file is one task's scan, however many rows it has: no fold over arrays runs in that task."""
    plan = __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution()
    assert plan.toRdd().getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "lambda" not in plan.executedPlan().toString().split("Exchange")[-1]


def test_portions_arrive_as_files_for_all_cores(spark):
    """A stream over one file verifies all of its labels in one task."""
    from grainsieve import queries, stream_queries

    seen = []

    class Ended:
        def awaitTermination(self):  # noqa: N802
            pass

    def start(arrived, out, checkpoint):
        seen.extend(arrived.sparkSession.read.schema(arrived.schema).parquet(folders[-1]).inputFiles())
        return Ended()

    folders, path = [], stream_queries.Scratch.path
    with pytest.MonkeyPatch.context() as m:
        m.setattr(stream_queries.Scratch, "path", lambda self, name: (p := path(self, name), folders.append(p) if name == "arriving" else None)[0])
        stream_queries.arriving(spark, queries.labels(spark, SMALL), 1, F.lit(0), start)
    assert len(seen) >= spark.sparkContext.defaultParallelism


def test_rows_of_one_row_group_are_dealt_out(spark):
    """A scan of as many tasks as there are cores has all rows in one of them, where the file is one row group."""
    from grainsieve import stream_queries

    class Taken(Exception):
        pass

    def arriving(spark, rows, *rest):
        raise Taken(rows.groupBy(F.spark_partition_id()).count().collect())

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.parquet(f"{SMALL}/part.parquet").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        with pytest.MonkeyPatch.context() as m, pytest.raises(Taken) as taken:
            m.setattr(stream_queries, "arriving", arriving)
            stream_queries.running_batch_summary(spark, SMALL)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found = [r["count"] for r in taken.value.args[0]]
    assert len(found) == spark.sparkContext.defaultParallelism and max(found) - min(found) <= 1


def test_ctc_scores_are_worked_out_once(spark):
    scores = F.array(*(F.array(F.lit(0.1), F.col("id") / F.lit(7919.0)) for _ in range(3)))
    df = spark.range(3).select(recognition.ctc_text(scores, F.array(F.lit(""), F.lit("a"))).alias("r"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("7919.0") == 3


def test_hits_are_put_together_once_a_claim(spark):
    """An array of all conditions' hits that stands within a lambda over a claim's hits is made again for each of them."""
    plan = __spark_entry__.queries()["verdict_lattice"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    hits = "array(CASE WHEN array_contains(_ids#"
    assert hits in plan and f"lambdafunction({hits}" not in plan


def test_parts_are_split_once(spark):
    for name in ("ingredients_by_terms", "allergens_by_terms"):
        plan = __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "part.parquet" not in plan and "regexp_extract_all" not in plan


# ---- terms


def test_terms_equal_the_plain_ones(spark):
    rng = random.Random(3)
    words = plain.vocabulary()
    asked = [None, "", "x", "食品添加剂", "复配", "优质", *words, *(rng.choice(("", *plain.NOISE)) + rng.choice(words) + rng.choice(("", "a", "某某某某某", "饮料")) for _ in range(150))]
    for w in [w for w in words if len(w) > 4][:40]:
        k = rng.randrange(len(w))
        asked += [w[:k] + "某" + w[k + 1 :], w[:k] + w[k + 1 :], w[::-1], w + "某", "某" + w[1:] + "某"]
    asked.append("".join(rng.choice("abc") for _ in range(3000)) + "白砂糖" + "".join(rng.choice("abc") for _ in range(3000)))  # across segments
    got = {r.term: r for r in terms.resolved(spark.createDataFrame([(t,) for t in asked] * 2, "term string").repartition(3), KB).collect()}
    assert set(got) == {t for t in asked if t}
    for t, r in got.items():
        n = plain.normalize(t)
        assert (r.standard, list(r.groups), r.is_additive, r.function, r.confidence) == (n["standard"], n["groups"], n["is_additive"], n["function"], n["confidence"]), t
    assert terms.resolved(spark.createDataFrame([], "term string"), KB).count() == 0


def test_no_similar_pair_is_lost_or_idle(spark):
    rng = random.Random(4)
    texts = list({"".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(2, 9))) for _ in range(120)})
    words = list({"".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(2, 9))) for _ in range(80)})
    a = spark.createDataFrame([(t, t) for t in texts], "key string, text string")
    b = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, ord int")
    got = {(r.text, r.word) for r in terms.similar_pairs(a, b, 0.7, 3).collect()}
    bound = lambda x, y: 2 * min(len(x), len(y)) / (len(x) + len(y)) >= 0.7 and abs(len(x) - len(y)) <= 3
    assert {(x, y) for x in texts for y in words if len(x) > 3 and bound(x, y) and SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.7} <= got
    assert all(bound(x, y) for x, y in got)


# ---- shapes


def test_hulls_of_few_and_odd_points(spark):
    p = lambda *xy: [{"x": None if x is None else float(x), "y": None if y is None else float(y)} for x, y in xy]
    rows = [(0, None), (1, p()), (2, p((1, 1))), (3, p((0, 0), (1, 1), (2, 2), (3, 3))), (4, p((0, 0), (4, 0), (4, 3), (0, 3), (2, 1), (4, 0), (None, 1))), (5, p((0, 0), (2, 0), (4, 0), (4, 2), (0, 2)))]
    h = recognition.convex_hull(F.col("p"))
    r = recognition.smallest_rectangle(F.col("h"))
    df = spark.createDataFrame(rows, "k int, p array<struct<x:double,y:double>>").withColumn("h", h)
    got = {x.k: x for x in df.select("k", "h", r.alias("r"), recognition.corners_in_order(r["points"]).alias("c")).collect()}
    assert [got[k].h for k in range(4)] == [None] * 4 and got[3].r is None
    assert [(q.x, q.y) for q in got[4].h] == [(0, 0), (4, 0), (4, 3), (0, 3)] and (got[4].r.area, got[4].r.width, got[4].r.height) == (12, 4, 3)
    assert [(q.x, q.y) for q in got[5].h] == [(0, 0), (4, 0), (4, 2), (0, 2)]
    assert [(q.x, q.y) for q in got[4].c] == [(0, 0), (4, 0), (4, 3), (0, 3)]


# ---- streams


def test_ring_and_latest_over_restarts(spark, tmp_path):
    """Null times, ties and repeated rows, in three portions with a restart between them: what comes out equals the batch operators."""
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice((None, *range(8))), rng.choice((None, *range(5)))) for _ in range(200)]
    schema = "u string, at long, n long"
    folder, kept, last, c = (str(tmp_path / x) for x in ("in", "ring", "latest", "check"))
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(2).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        jobs.keep(jobs.ring(stream, "u", "at", "n", 12), kept, c + "1").awaitTermination()
        jobs.keep(jobs.latest(stream.select("u", F.col("at").alias("request"), "n"), "u", "request"), last, c + "2").awaitTermination()
    found = [r for r in spark.read.parquet(kept).collect() if r.batch == 2]
    want = lookups.newest(spark.createDataFrame(rows, schema), "u", "at", "n", 12).collect()
    assert sorted((r.u, r.place, str(r.at), str(r.n)) for r in found) == sorted((r.u, r.place, str(r.at), str(r.n)) for r in want)
    out = sorted((r.u, r.batch, r.request) for r in spark.read.parquet(last).collect())
    assert all(a[2] < b[2] for a, b in zip(out, out[1:], strict=False) if a[0] == b[0]) and {r[0]: r[2] for r in out} == {u: 7 for u in "abc"}


def test_a_batch_that_runs_again_changes_no_summary(spark, tmp_path):
    schema = "label_id string, ok boolean, error string, confidence double, risk struct<level:string>, claim_verdicts array<struct<label:string>>"
    row = lambda k: (str(k), k % 4 > 0, None if k % 4 else "broken", 0.5 + k % 5 / 10, ("高" if k % 3 else "低",), [("不一致" if k % 2 else "一致",)])
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))

    def run():
        jobs.running_summary(spark.readStream.schema(schema).parquet(folder), out, checkpoint).awaitTermination()
        r = spark.read.parquet(f"{out}/total").orderBy(F.desc("batch")).first()
        return {x: r[x] for x in (*jobs._COUNTS, "inconsistent_pct")}

    for part in (range(10), range(10, 25)):
        spark.createDataFrame([row(k) for k in part], schema).write.mode("append").parquet(folder)
        got = run()
    whole = lookups.batch_summary(spark.createDataFrame([row(k) for k in range(25)], schema)).first().asDict()
    assert got == whole
    for name in ("1", ".1.crc"):
        Path(checkpoint, "commits", name).unlink(missing_ok=True)  # as if it had failed before its end
    assert run() == whole
    assert spark.read.parquet(f"{out}/failed").count() == 7


def test_a_summary_works_out_each_row_once(spark, tmp_path):
    """Totals and failed rows come from one pass, and what neither needs of a report is not worked out."""
    marks = tmp_path / "marks"

    @udf("string")
    def seen(text, mark):
        with marks.open("a") as f:
            f.write(mark)
        return text

    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "label_id string, ok boolean, error string, confidence double, level string, claim_verdicts array<struct<label:string>>"
    spark.createDataFrame([(str(k), k % 4 > 0, None if k % 4 else "broken", 0.5, "高", [("一致",)]) for k in range(20)], schema).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    reports = stream.withColumn("risk", F.struct(seen("level", F.lit("r")).alias("level"))).withColumn("population_results", seen("level", F.lit("p")))
    jobs.running_summary(reports, out, checkpoint).awaitTermination()
    total = spark.read.parquet(f"{out}/total").first()
    assert (total.total, total.ok, total.failed, total.high_risk, total.low_confidence) == (20, 15, 5, 15, 15)
    assert sorted(int(r.label_id) for r in spark.read.parquet(f"{out}/failed").collect()) == [0, 4, 8, 12, 16]
    assert marks.read_text() == "r" * 20
    assert not spark.sparkContext._jsc.getPersistentRDDs()


# ---- the data source of reports


def test_reports_appear_only_when_committed(spark, tmp_path):
    reports.register(spark)
    path = str(tmp_path / "r")
    rows = lambda a, z: spark.createDataFrame([(str(k), k / 100, k % 2 == 0, None if k % 5 == 0 else f'{{"k": "{k} ü"}}') for k in range(a, z)], reports.SCHEMA).repartition(3)
    back = lambda: sorted((r.label_id, r.confidence, r.rejected, r.report) for r in spark.read.format("label_reports").load(path).collect())
    assert back() == []
    rows(0, 40).write.format("label_reports").mode("append").save(path)
    first = back()
    assert first == sorted(map(tuple, rows(0, 40).collect()))

    @udf("string")
    def broken(x):
        if x == "55":
            raise ValueError("no")
        return x

    with pytest.raises(Exception, match="no"):
        rows(40, 60).withColumn("label_id", broken("label_id")).write.format("label_reports").mode("append").save(path)
    assert back() == first
    rows(40, 50).write.format("label_reports").mode("append").save(path)
    assert len(back()) == 50
    rows(0, 3).write.format("label_reports").mode("overwrite").save(path)
    assert len(back()) == 3


def test_a_stream_of_reports(spark, tmp_path):
    reports.register(spark)
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(2):
        spark.createDataFrame([(f"{k}-{i}", 0.5, False, "{}") for i in range(5)], reports.SCHEMA).write.mode("append").parquet(source)
        stream = spark.readStream.schema(reports.SCHEMA).parquet(source)
        stream.writeStream.format("label_reports").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.format("label_reports").load(path).count() == 10
    Path(checkpoint, "commits", "1").unlink()
    Path(checkpoint, "commits", ".1.crc").unlink(missing_ok=True)
    stream.writeStream.format("label_reports").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.format("label_reports").load(path).count() == 10


# ---- the recogniser's table function


def test_a_plug_in_is_loaded_once_and_again_after_a_failure(spark, tmp_path):
    loads = tmp_path / "loads"

    def load():
        with loads.open("a") as f:
            f.write("x")

    def detect(content):
        if content == b"bad":
            raise ValueError("bad image")
        return [{"text": content.decode(), "confidence": 0.5, "x_min": 0.0, "x_max": 1.0, "y_min": 0.0, "y_max": 1.0, "y_center": 0.5, "height": 1.0}]

    plug_in = recognizer.Recognizer("counting", detect, load)
    images = lambda bad: spark.createDataFrame([(f"{k}", b"bad" if k == bad else None if k == 3 else b"t%d" % k) for k in range(8)], "path string, content binary").coalesce(1)
    got = {r.image_id: r for r in recognizer.recognised(images(-1), plug_in).collect()}
    assert len(got) == 8 and got["4"].boxes[0].text == "t4" and got["3"].boxes is None and got["3"].error
    assert len(loads.read_text()) == 2  # at first, and after the null content
    got = {r.image_id: r for r in recognizer.recognised(images(7), plug_in).collect()}
    assert got["7"].error == "ValueError: bad image" and sum(r.boxes is not None for r in got.values()) == 6
    sources = recognizer.label_sources(spark.createDataFrame([("a", "配料：水".encode())], "path string, content binary"), KB, plug_in).first()
    assert sources.label_id == "a" and sources.ingredients_text == "水"
