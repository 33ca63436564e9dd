"""Queries that run as streams over files that arrive in several portions, restarted from their checkpoints in between, with DuckDB SQL over the whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import _FOUND, _RISK, _VERDICT, LABELS, labels, query
from .runtime import Scratch, ship, spread, table
from .streaming import jobs


def arriving(spark: SparkSession, rows: DataFrame, portions: int, portion, start: Callable[[DataFrame, str, str], object]) -> str:
    """Rows written portion by portion into a folder; after each one a stream over it runs to its end and stops. The folder of what it has kept."""
    ship(spark)
    rows = spread(rows)  # files for all cores: a stream reads what was one file in one task
    scratch = Scratch(spark)
    folder, out, checkpoint = (scratch.path(x) for x in ("arriving", "kept", "checkpoint"))
    for k in range(portions):
        rows.where(portion == k).write.mode("append").parquet(folder)
        start(spark.readStream.schema(rows.schema).parquet(folder), out, checkpoint).awaitTermination()
    scratch.drop("arriving", "checkpoint")
    return out


@query("SELECT user_id, event_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC NULLS LAST, event_id DESC) AS place FROM (SELECT user_id, event_id, CASE WHEN event_id % 13 > 0 THEN ts END AS seen, unnest(range(CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END)) FROM events)) WHERE place <= 20")
def history_ring_stream(spark, sf_dir):
    """The history ring as a stream's state, out of order, with null times and repeated rows: each user's last emission is the whole's newest rows."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 13 > 0, F.col("ts")).alias("at"), F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 50 == 0, 2).otherwise(1))).alias("copy"))
    rows = e.select("user_id", "at", "event_id")
    out = arriving(spark, rows, 3, F.pmod(F.xxhash64("event_id"), F.lit(3)), lambda s, o, c: jobs.keep(jobs.ring(s, "user_id", "at", "event_id"), o, c))
    kept = spark.read.schema("user_id long, place int, event_id long, batch int").parquet(out)
    last = kept.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return kept.join(last, ["user_id", "batch"]).select("user_id", "event_id", "place")


@query("""WITH p AS (SELECT user_id, event_id, event_type, (event_id * 7 + user_id) % 3 AS portion FROM events), m AS (SELECT user_id, portion, max(event_id) AS event_id FROM p GROUP BY ALL),
r AS (SELECT *, max(event_id) OVER (PARTITION BY user_id ORDER BY portion ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)
SELECT user_id, event_id, event_type, portion::INT AS batch FROM r JOIN p USING (user_id, event_id, portion) WHERE before IS NULL OR event_id > before""")
def stale_results_dropped(spark, sf_dir):
    """Results that come when a newer request's are there already are dropped, across micro-batches and a restart."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    out = arriving(spark, rows, 3, (F.col("event_id") * 7 + F.col("user_id")) % 3, lambda s, o, c: jobs.keep(jobs.latest(s, "user_id", "event_id"), o, c))
    return spark.read.schema("user_id long, event_id long, event_type string, batch int").parquet(out)


@query(LABELS + _FOUND + _VERDICT + _RISK + """, f AS (SELECT label_id, substr(label_id, 2)::BIGINT % 11 = 0 AS failed FROM conf) SELECT count(*) AS total, count(*) FILTER (NOT failed) AS ok, count(*) FILTER (failed) AS failed, count(*) FILTER (NOT failed AND v.label = '不一致') AS inconsistent,
 count(*) FILTER (NOT failed AND s.level = '高') AS high_risk, count(*) FILTER (NOT failed AND c.confidence < 0.75) AS low_confidence, floor(count(*) FILTER (NOT failed AND v.label = '不一致') * 100 / count(*) FILTER (NOT failed) + 0.5)::BIGINT AS inconsistent_pct, count(*) FILTER (failed) AS n_errors
 FROM conf c JOIN f USING (label_id) LEFT JOIN verdict v USING (label_id) LEFT JOIN scored s USING (label_id)""")
def running_batch_summary(spark, sf_dir):
    """Labels arrive in portions and are verified as a stream; every eleventh fails. The last running summary is the whole's."""
    bad = F.substring("label_id", 2, 20).cast("long") % 11 == 0

    def start(arrived, out, checkpoint):
        r = jobs.verify_stream(arrived).withColumn("ok", ~bad).withColumn("error", F.when(bad, F.lit("unreadable")))
        return jobs.running_summary(r, out, checkpoint)

    out = arriving(spark, spread(labels(spark, sf_dir), even=True), 2, F.col("key") % 2, start)
    schema = ", ".join(f"{c} long" for c in (*jobs._COUNTS, "inconsistent_pct"))
    totals = spark.read.schema(f"{schema}, batch int").parquet(f"{out}/total")
    failed = spark.read.schema("label_id string, error string, batch int").parquet(f"{out}/failed").agg(F.count("error").alias("n_errors"))
    return totals.orderBy(F.desc("batch")).limit(1).drop("batch").crossJoin(failed)  # one row each
