"""Sorted layouts: what an index does for a lookup, done by file and row-group statistics.

A layout is a Parquet copy of some columns, range-partitioned and sorted by the
key, with the record numbers of the base table. Point and range predicates on a
leading key then read few row groups; `verify` compares it with its base.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from ..functions.collation import collated
from ..operators.expressions import Scope
from ..operators.filters import compile_filter
from ..operators.pipeline import RECORD
from ..plans.documents import COLLATIONS, check_filter
from .files import Files


class SortedLayout:
    """A layout in a folder: rows under `rows`, its keys in `layout.json`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, df: DataFrame, keys: dict[str, int], collation: str | None = None) -> None:
        """keys: field to 1 or -1, the order of the layout; collation orders text keys."""
        if RECORD not in df.columns or not keys or any(w not in (1, -1) for w in keys.values()) or (collation and collation not in COLLATIONS):
            raise StoreError("a layout needs record numbers and keys with directions")
        text = {f.name for f in df.schema if f.dataType.typeName() == "string"}
        order = []
        for k, way in keys.items():
            c = collated(F.col(f"`{k}`"), collation) if k in text else F.col(f"`{k}`")
            order.append(c.asc() if way == 1 else c.desc())
        rows = df.select(*keys, RECORD).repartitionByRange(*order, F.col(RECORD)).sortWithinPartitions(*order, RECORD)
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows")
        Files(self.spark).write(f"{self.folder}/layout.json", json.dumps({"keys": keys, "collation": collation, "rows": self.rows().count()}))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def lookup(self, filter: dict) -> DataFrame:
        """Keys and record numbers of the rows that match a filter over the keys."""
        rows = self.rows()
        return rows.where(compile_filter(Scope(rows.schema, hidden=frozenset({RECORD})), check_filter(filter), True))

    def fetch(self, base: DataFrame, filter: dict) -> DataFrame:
        """The base table's rows that a lookup names."""
        return base.join(self.lookup(filter).select(RECORD), RECORD, "left_semi")

    def verify(self, base: DataFrame) -> bool:
        """Whether the layout holds exactly the keys and record numbers of base."""
        rows = self.rows()
        own = base.select(*rows.columns)
        return own.exceptAll(rows).isEmpty() and rows.exceptAll(own).isEmpty()
