"""Catalogs: the tables of a folder by name, pinned for the length of a read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine, numbered
from ..errors import StoreError
from ..limits import DEFAULT, Limits
from . import dbf, xbf
from .files import Files

FORMATS = ("dbf", "xbf", "parquet")


class Catalog:
    """Direct children of a folder that are DBF, XBF or Parquet tables, or tables of a store; the name is the file's stem."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        dbf.register(spark)
        xbf.register(spark)
        self.files: dict[str, str] = {}
        listing = Files(spark)
        for n in listing.names(self.folder):
            stem, _, end = n.rpartition(".")
            if stem and end.lower() in FORMATS:
                self.files.setdefault(stem, n)
            elif listing.exists(f"{self.folder}/{n}/manifests"):
                self.files.setdefault(n, n)
        self._pinned: dict[tuple[str, int | None], DataFrame] = {}

    def table_names(self) -> list[str]:
        return sorted(self.files)

    def table(self, name: str, ordered: bool = True, at: int | None = None) -> DataFrame:
        """A table with _record_number and, where its format knows deletion, _deleted; at: a version of a store's table."""
        if name not in self.files:
            raise StoreError(f"no table {name}")
        key = (name, at)
        if key not in self._pinned:
            path = f"{self.folder}/{self.files[name]}"
            end = path.rpartition(".")[2].lower()
            if end in ("dbf", "xbf"):
                self._pinned[key] = self.spark.read.format(end).load(path)
            elif end == "parquet":
                self._pinned[key] = numbered(self.spark, path)
            else:
                from ..store import Store

                self._pinned[key] = Store(self.spark, path).read(at)
        return self._pinned[key]

    def schema_json(self, name: str) -> str:
        return self.table(name).schema.json()

    def register_views(self) -> None:
        """Temporary views of the active rows, for SQL."""
        for n in self.files:
            df = self.table(n)
            df = df.where(~df["_deleted"]) if "_deleted" in df.columns else df
            df.drop("_record_number", "_deleted").createOrReplaceTempView(n)

    def engine(self, at: int | None = None, limits: Limits = DEFAULT, seq: int | None = None) -> Engine:
        """An engine over the pinned tables; where stores are concerned at a version, or as of an entry of the catalog's log."""
        if seq is None:
            return Engine(self.spark, lambda name, ordered: self.table(name, ordered, at), limits)
        from ..transactions import CatalogLog

        then = CatalogLog(self.spark, self.folder).versions_at(seq)
        return Engine(self.spark, lambda name, ordered: self.table(name, ordered, then.get(name)), limits)

    def refresh(self) -> Catalog:
        """A catalog that sees what is there now."""
        return Catalog(self.spark, self.folder)
