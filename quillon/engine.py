"""The engine: request documents over DataFrames and catalogs."""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .errors import QueryError
from .functions.collation import collated
from .functions.order import Key, sort_key
from .limits import DEFAULT, Limits
from .operators import joins, paging
from .operators.expressions import Scope
from .operators.filters import compile_filter
from .operators.paging import Page
from .operators.pipeline import RECORD, Rows, needs_order, run
from .operators.projection import project
from .operators.values import STRING, resolve
from .plans.documents import QueryDocument, parse_join, parse_query
from .plans.stages import parse_pipeline

HIDDEN = {RECORD, "_deleted"}
FILE_STEP = 1 << 40  # record numbers of one file of a table of many


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with record numbers: places in files, files in order of name. They are computed only where a plan asks for them."""
    df = spark.read.parquet(path)
    files = sorted(df.inputFiles())
    row = F.col("_metadata.row_index") + 1
    if len(files) <= 1:
        return df.withColumn(RECORD, row)
    places = F.create_map(*(x for i, f in enumerate(files) for x in (F.lit(f), F.lit(i)))) if len(files) <= 1000 else None
    if places is not None:
        return df.withColumn(RECORD, places[F.input_file_name()] * F.lit(FILE_STEP) + row)
    listing = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "__file string, __place long")
    return df.withColumn("__file", F.input_file_name()).withColumn("__row", row).join(listing, "__file").withColumn(RECORD, F.col("__place") * FILE_STEP + F.col("__row")).drop("__file", "__row", "__place")


class Engine:
    """Runs documents. `tables` gives a frame for a name; frames with a column _record_number have a row order."""

    def __init__(self, spark: SparkSession, tables: Callable[[str, bool], DataFrame] | None = None, limits: Limits = DEFAULT):
        """tables(name, ordered): the frame of a table; with record numbers if `ordered`."""
        self.spark, self.limits = spark, limits
        self._tables = tables

    @classmethod
    def of_parquet(cls, spark: SparkSession, folder: str, limits: Limits = DEFAULT) -> Engine:
        """Tables are folder/name.parquet."""

        def tables(name: str, ordered: bool) -> DataFrame:
            path = f"{folder}/{name}.parquet"
            return numbered(spark, path) if ordered else spark.read.parquet(path)

        return cls(spark, tables, limits)

    def table(self, name: str | DataFrame, ordered: bool = False) -> DataFrame:
        if isinstance(name, DataFrame):
            df = name
        elif self._tables is None:
            raise QueryError(f"no table {name}")
        else:
            df = self._tables(name, ordered)
        return df.where(~F.col("_deleted")) if "_deleted" in df.columns else df

    # -- single-table requests ---------------------------------------------

    def find(self, table: str | DataFrame, document) -> DataFrame:
        """The result of a query document, as a plan. Pages have page()."""
        q = parse_query(document, self.limits)
        plan = parse_pipeline(q.aggregate) if q.aggregate is not None else None
        ordered = needs_order(plan) if plan else bool(q.sort or q.skip or q.limit is not None or q.page_size is not None)
        df = self.filtered(self.table(table, ordered), q)
        if q.page_size is not None:
            return project(self._page(df, q).frame, q.projection, HIDDEN)
        if plan:
            order = [Key(RECORD)] if RECORD in df.columns else []
            out = run(Rows(df, order), plan)
            return self.limits.check(out, "groups") if self.limits.groups is not None else out
        tie = [RECORD] if RECORD in df.columns else []
        if q.sort:
            keys = []
            for f, way in q.sort:
                v = resolve(df.schema, f)
                if v.present is False or v.type is None:
                    continue
                c = collated(sort_key(v), q.collation) if v.kind == STRING else sort_key(v)
                keys.append(c.asc() if way == 1 else c.desc())
            df = df.orderBy(*keys, *tie)
        elif (q.skip or q.limit is not None) and tie:
            df = df.orderBy(*tie)
        if q.skip:
            df = df.offset(q.skip)
        if q.limit is not None:
            df = df.limit(q.limit)
        return project(df, q.projection, HIDDEN)

    def filtered(self, df: DataFrame, q: QueryDocument) -> DataFrame:
        return df.where(compile_filter(Scope(df.schema, hidden=frozenset(HIDDEN)), q.filter, True)) if q.filter else df

    def page(self, table: str | DataFrame, document) -> Page:
        """One page with the cursor of the next."""
        q = parse_query(document, self.limits)
        if q.page_size is None:
            raise QueryError("page_size is needed")
        base = self.table(table, True)
        p = self._page(self.filtered(base, q), q)
        p.frame = project(p.frame, q.projection, HIDDEN)
        names = p.frame.columns
        p.records = [Row(**{n: r[n] for n in names}) for r in p.records] if not any("." in x for x in q.projection) else p.frame.collect()
        return p

    def _page(self, df: DataFrame, q: QueryDocument) -> Page:
        if RECORD not in df.columns:
            raise QueryError("paging needs record numbers")
        return paging.page(df, q, self.snapshot(df))

    @staticmethod
    def snapshot(df: DataFrame) -> str:
        """A tag of the files behind a frame; a cursor is good for one tag."""
        return hashlib.sha256("\n".join(sorted(df.inputFiles())).encode()).hexdigest()[:16]

    # -- joins --------------------------------------------------------------

    def join(self, document) -> DataFrame:
        return joins.execute(self.table, parse_join(document, self.limits), HIDDEN, self.limits)

    # -- explain and streams ------------------------------------------------

    def explain(self, table: str | DataFrame | None, document, mode: str = "formatted") -> dict:
        """The physical plan, and Catalyst's estimate of the result's size."""
        df = self.join(document) if table is None else self.find(table, document)
        plan = df._jdf.queryExecution()
        return {"plan": self.spark._jvm.PythonSQLUtils.explainString(plan, mode), "size_in_bytes": int(str(plan.optimizedPlan().stats().sizeInBytes())), "columns": df.columns}

    def stream(self, table: str | DataFrame | None, document) -> RowStream:
        """Rows one after the other, partition by partition; blocking controls are refused."""
        if table is None:
            return RowStream(self.join(document))
        q = parse_query(document, self.limits)
        if q.sort or q.aggregate is not None or q.page_size is not None:
            raise QueryError("a stream takes filter, projection, skip and limit alone")
        return RowStream(self.find(table, document))


class RowStream:
    """An iterator over a frame's rows that can be cancelled from another thread."""

    def __init__(self, df: DataFrame, prefetch: bool = True):
        self.df, self.prefetch, self.group = df, prefetch, f"stream-{uuid.uuid4().hex}"
        self._stop = threading.Event()

    def cancel(self) -> None:
        self._stop.set()
        self.df.sparkSession.sparkContext.cancelJobGroup(self.group)

    def __iter__(self) -> Iterator[Row]:
        self.df.sparkSession.sparkContext.setJobGroup(self.group, "row stream", interruptOnCancel=True)
        for row in self.df.toLocalIterator(prefetchPartitions=self.prefetch):
            if self._stop.is_set():
                return
            yield row

    def json(self) -> Iterator[str]:
        """Rows as JSON lines."""
        yield from (r[0] for r in RowStream(self.df.select(F.to_json(F.struct("*")).alias("v")), self.prefetch))
