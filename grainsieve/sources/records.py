"""Product records by bar code: a data source over any service that answers with JSON, and the table form of its answers."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.lookups import record_state

TIMEOUT_S = 20


class _Codes(InputPartition):
    def __init__(self, codes: list[str]):
        self.codes = codes


class ProductRecords(DataSource):
    """`spark.read.format("product_records").option("url", "https://host/{code}").option("codes", "1,2")`: one row for each code.

    status is null where the service could not be reached, so that no failure looks like an empty answer.
    """

    @classmethod
    def name(cls) -> str:
        return "product_records"

    def schema(self) -> str:
        return "code string, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.url, self.timeout = options["url"], float(options.get("timeout", TIMEOUT_S))
        self.codes = [c for c in options["codes"].split(",") if c]
        self.parts = int(options.get("partitions", "8"))

    def partitions(self) -> list[InputPartition]:
        return [_Codes(self.codes[k :: self.parts]) for k in range(min(self.parts, len(self.codes)))] or [_Codes([])]

    def read(self, partition: _Codes) -> Iterator[tuple]:
        for code in partition.codes:
            try:
                with urllib.request.urlopen(self.url.replace("{code}", code), timeout=self.timeout) as r:
                    body = r.read().decode("utf-8", "replace")
                    yield code, r.status, body if _has_product(body) else None
            except urllib.error.HTTPError as e:
                yield code, e.code, None
            except OSError:
                yield code, None, None


def _has_product(body: str) -> bool:
    try:
        return bool(json.loads(body).get("product"))
    except (ValueError, AttributeError):
        return False


def product_records(spark: SparkSession, url: str, codes: list[str], timeout: float = TIMEOUT_S) -> DataFrame:
    """(code, status, body, state) with the four outcomes of record_state()."""
    spark.dataSource.register(ProductRecords)
    rows = spark.read.format("product_records").option("url", url).option("codes", ",".join(codes)).option("timeout", str(timeout)).load()
    return rows.withColumn("state", record_state(rows["status"], rows["body"]))
