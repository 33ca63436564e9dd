"""Recogniser output, the history store and streams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from grainsieve.operators import history, lookups, recognition
from grainsieve.sources import categories
from grainsieve.streaming import jobs


def test_charset_fits_the_classes():
    assert recognition.charset(["a", "b"], 3) == ["", "a", "b"] and recognition.charset(["a", "b"], 4) == ["", "a", "b", " "]
    with pytest.raises(ValueError, match="does not fit"):
        recognition.charset(["a"], 9)


def test_softmax_and_raw_scores(spark):
    rng = random.Random(1)
    steps = [[rng.uniform(-5, 5) for _ in range(4)] for _ in range(6)]
    df = spark.createDataFrame([(steps,)], "s array<array<double>>")
    got = df.select(F.transform("s", recognition.softmax).alias("p"), recognition.ctc_text(F.col("s"), F.array(*map(F.lit, ["", "a", "b", "c"])), raw_scores=True).alias("t")).first()
    for row, p in zip(steps, got.p, strict=True):
        total = sum(map(math.exp, row))
        assert p == pytest.approx([math.exp(x) / total for x in row])
    best = [max(range(4), key=r.__getitem__) for r in steps]
    shown = [k for k, b in enumerate(best) if b and (k == 0 or best[k - 1] != b)]
    assert got.t.text == "".join("-abc"[best[k]] for k in shown)
    assert got.t.confidence == pytest.approx(sum(got.p[k][best[k]] for k in shown) / len(shown) if shown else 0.0)


def test_reading_order_against_insertion(spark):
    rng = random.Random(2)
    for _ in range(5):
        boxes = [(float(rng.randint(0, 40)), float(rng.randint(0, 99)), k) for k in range(rng.randint(0, 12))]
        order = sorted(boxes, key=lambda b: (b[0], b[1]))
        for i in range(len(order) - 1):
            for j in range(i, -1, -1):
                if abs(order[j + 1][0] - order[j][0]) < 10 and order[j + 1][1] < order[j][1]:
                    order[j], order[j + 1] = order[j + 1], order[j]
                else:
                    break
        df = spark.createDataFrame([(boxes,)], "b array<struct<y:double,x:double,k:int>>")
        got = df.select(recognition.reading_order(F.col("b")).alias("b")).first().b
        assert [(b.y, b.x) for b in got] == [(y, x) for y, x, _ in order]


def test_no_line_left_is_a_problem(spark):
    rows = [(1, 0, "a", 0.9), (1, 1, "", 0.9), (1, 2, "b", 0.5), (2, 0, "c", 0.2), (2, 1, "d", 0.4)]
    got = {r.id: r for r in recognition.kept_lines(spark.createDataFrame(rows, "id int, place int, text string, confidence double"), "id").collect()}
    assert (got[1].full_text, got[1].confidence, got[1].problem) == ("a\nb", 0.7, None)
    assert got[2].n_kept == 0 and got[2].problem.endswith("d") and got[2].confidence is None


def test_category_documents(spark):
    texts = [None, "", "[]", '{"categories": {}}', '{"categories": {"Z": {}}}']
    got = [r.categories for r in categories.with_categories(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "t").orderBy("k").collect()]
    assert all(len(x) == 14 for x in got[:4]) and [(c.code, c.name, c.clause, c.note) for c in got[4]] == [("Z", "Z", "", "")]


def test_history_store(spark, tmp_path):
    for k in range(3):
        history.record(spark.createDataFrame([(u, 10 * k + i, i) for u in ("x", "y") for i in range(10)], "u string, at long, n long"), str(tmp_path / "h"))
    got = history.recent(spark, str(tmp_path / "h"), "u", "at", "n").collect()
    assert len(got) == 40 and {r.at for r in got} == set(range(10, 30)) and all(r.at == 30 - r.place for r in got)


def test_ring_on_a_stream_equals_batch(spark, tmp_path):
    """The bounded state gives what the window over all rows gives, and a progress listener that raises stops nothing."""
    rng = random.Random(3)
    rows = [(f"u{rng.randint(0, 3)}", rng.randint(0, 500), k) for k in range(150)]
    schema = "u string, at long, n long"
    for k in range(3):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []

    def tell(event, *_):
        seen.append(event)
        raise RuntimeError("ignored")

    listener = jobs.Progress(tell)
    spark.streams.addListener(listener)
    latest = {}

    def keep(batch, _):
        found = {}
        for r in batch.collect():
            found.setdefault(r.u, []).append((r.place, r["at"], r.n))
        latest.update(found)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.ring(stream, "u", "at", "n", 20).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(240) and jobs.stop(query)
    spark.streams.removeListener(listener)
    want = {}
    for r in lookups.newest(spark.createDataFrame(rows, schema), "u", "at", "n", 20).collect():
        want.setdefault(r.u, set()).add((r.place, r["at"], r.n))
    assert {u: set(x) for u, x in latest.items()} == want
    assert "started" in seen
