"""A batch data source over folders of fetched payload files, one entry row for each file."""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source string, kind string, url string, payload string, error string"


class PayloadSource(DataSource):
    """format("weft_payloads").option("path", folder): JSON files with source, kind, url and payload.

    The folder has to be one that every executor sees. A file that can't be read becomes a row with error, so that
    one source's failure stops no other.
    """

    @classmethod
    def name(cls) -> str:
        return "weft_payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(self.options["path"])


class PayloadReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name in sorted(os.listdir(self.path)) if name.endswith(".json")]

    def read(self, partition: InputPartition):
        try:
            with open(os.path.join(self.path, partition.value), encoding="utf-8") as f:
                row = json.load(f)
            yield (row.get("source"), row.get("kind"), row.get("url"), row.get("payload"), None)
        except (OSError, ValueError) as e:
            yield (partition.value, None, None, None, str(e))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PayloadSource)
