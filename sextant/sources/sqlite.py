"""SQLite files as a batch source: spark.read.format("sqlite").option("path", …).option("query", …)."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _held(self) -> tuple[list[str], list[set[type]]]:
        """Names of the columns, and the types of all values in each (a column of SQLite can hold several)."""
        db = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        try:
            cursor = db.execute(self.options["query"], json.loads(self.options.get("params", "[]")))
            names = [d[0] for d in cursor.description]
            held: list[set[type]] = [set() for _ in names]
            for row in cursor:
                for kinds, value in zip(held, row):
                    kinds.add(type(value))
            return names, held
        finally:
            db.close()

    def schema(self) -> StructType:
        """By all values: whole numbers, numbers, else text."""
        names, held = self._held()
        found = [kinds - {type(None)} for kinds in held]
        kinds = [LongType() if k == {int} else DoubleType() if k and k <= {int, float} else StringType() for k in found]
        return StructType([StructField(n, k) for n, k in zip(names, kinds)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.kinds = options, [{"long": int, "double": float}.get(f.dataType.typeName(), str) for f in schema.fields]

    def read(self, partition) -> Iterator[tuple]:
        db = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        try:
            for row in db.execute(self.options["query"], json.loads(self.options.get("params", "[]"))):
                yield tuple(None if v is None else k(v) for k, v in zip(self.kinds, row))
        finally:
            db.close()


def load_sql(spark: SparkSession, path: str, query: str, params: Sequence = ()) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("query", query).option("params", json.dumps(list(params))).load()
