"""Queries through the table function of recognisers and the data source of reports, with DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from .queries import _FOUND, _RISK, _VERDICT, LABELS, query, reports
from .runtime import Scratch, table
from .sources import recognizer
from .sources import reports as report_source


def _lines(content: bytes) -> list[dict]:
    """A recogniser of plain text: a box for each line that is not empty, below one another; it cannot read contents whose length seven divides."""
    if len(content) % 7 == 0:
        raise ValueError(f"{len(content)} bytes")
    boxes = [{"text": t, "confidence": 0.9, "x_min": 0.0, "x_max": float(len(t)), "y_min": 20.0 * k, "y_max": 20.0 * k + 16, "y_center": 20.0 * k + 8, "height": 16.0} for k, t in enumerate(content.decode().split("\n"))]
    return [b for b in boxes if b["text"]]


PLAIN_TEXT = recognizer.Recognizer("plain_text", _lines)


@query("""SELECT page_id::VARCHAR AS image_id, CASE WHEN strlen(html) % 7 = 0 THEN 'ValueError: ' || strlen(html) || ' bytes' END AS error, CASE WHEN strlen(html) % 7 > 0 THEN len(list_filter(string_split(html, chr(10)), lambda x: x <> '')) END::INT AS n_boxes,
 CASE WHEN strlen(html) % 7 > 0 THEN sha256(array_to_string(list_filter(string_split(html, chr(10)), lambda x: x <> ''), chr(10))) END AS text_sha256 FROM pages""")
def recognised_pages(spark, sf_dir):
    """Pages as images of text for a plug-in that fails for some: each row keeps its own boxes or error."""
    images = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    found = recognizer.recognised(images, PLAIN_TEXT)
    n = F.when(F.col("boxes").isNotNull(), F.size("boxes"))
    return found.select("image_id", "error", n.alias("n_boxes"), F.sha2(F.array_join(F.transform("boxes", lambda b: b["text"]), "\n"), 256).alias("text_sha256"))


@query(LABELS + _FOUND + _VERDICT + _RISK + " SELECT c.label_id, c.confidence, c.confidence < 0.6 AS rejected, s.level AS risk, v.label AS verdict FROM conf c LEFT JOIN scored s USING (label_id) LEFT JOIN verdict v USING (label_id)")
def reports_written_and_read(spark, sf_dir):
    """Whole reports through the data source in two jobs, and read back."""
    report_source.register(spark)
    scratch = Scratch(spark)
    path = scratch.path("label_reports")
    r = reports(spark, sf_dir)
    whole = r.select("label_id", "confidence", "rejected", F.to_json(F.struct("risk", "claim_verdicts", "baseline_verdicts", "population_results", "allergen_alerts", "meta", "reject_reason")).alias("report"))
    whole = scratch.write(whole, "whole")  # verified once, for both jobs
    for part in ("rejected", "NOT rejected"):
        whole.where(part).write.format("label_reports").mode("append").save(path)
    scratch.drop("whole")
    back = spark.read.format("label_reports").load(path)
    return back.select("label_id", "confidence", "rejected", F.get_json_object("report", "$.risk.level").alias("risk"), F.get_json_object("report", "$.claim_verdicts[0].label").alias("verdict"))
