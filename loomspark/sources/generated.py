"""A Python data source of generated rows, readable in batch by `spark.read.format("generated")`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class GeneratedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.rows, self.parts = int(options.get("rows", 100)), int(options.get("parts", 4))

    def partitions(self) -> list[InputPartition]:
        step = -(-self.rows // self.parts)
        return [Range(k * step, min(self.rows, (k + 1) * step)) for k in range(self.parts)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for i in range(partition.low, partition.high):
            yield i, f"prompt {i}"


class GeneratedSource(DataSource):
    """Options: rows, parts."""

    @classmethod
    def name(cls) -> str:
        return "generated"

    def schema(self) -> str:
        return "id bigint, prompt string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return GeneratedReader(self.options)
