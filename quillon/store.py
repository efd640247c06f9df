"""Versioned tables: immutable Parquet versions, numbered manifests as commit points, and a change log.

    folder/manifests/<n>.json     versions, newest last: transaction, folders, constraints, row count; the highest n counts
    folder/data/<txn>-<id>        one version's rows with _record_number and _deleted
    folder/pending/<txn>-<id>     its changes, until its manifest is there
    folder/changes/txn=<txn>      its changes: reset, record_number, before, after (JSON)

Reads are frames over one version, so they never see a later one. A commit
writes data and changes into folders of its own, and then creates the next
manifest, which fails if another writer was first: a losing commit changes
nothing. Changes are published after that; recover() does what a crash left.

Constraints are tested at commit. begin(immediate=True) tests those that aren't
deferred after each step too. Foreign keys are looked up among the tables beside
this one, or in the catalog transaction that the commit belongs to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constraints import Constraints, constraint_names, key_name, validate
from .errors import ConstraintError, StoreError
from .sources.files import Files

RECORD, DELETED = "_record_number", "_deleted"
MOST_STEPS = 1000


@dataclass(frozen=True)
class Version:
    txn: int
    data: str
    rows: int
    constraints: dict
    columns: str  # the schema as JSON
    changes: str = ""  # folder of its changes before they are published


@dataclass
class Prepared:
    """A commit whose data is written and that no manifest names yet."""

    store: Store
    number: int
    versions: list[Version]

    def manifest(self) -> str:
        return json.dumps({"versions": [v.__dict__ for v in self.versions]})

    def discard(self) -> None:
        for folder in (self.versions[-1].data, self.versions[-1].changes):
            self.store.files.delete(f"{self.store.folder}/{folder}")


class Store:
    """One versioned table in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)

    # -- versions -----------------------------------------------------------

    def manifest(self) -> list[Version]:
        return self._newest()[1]

    def _newest(self) -> tuple[int, list[Version]]:
        """Number and versions of the newest manifest."""
        names = [n for n in self.files.names(f"{self.folder}/manifests") if n.endswith(".json")]
        if not names:
            return 0, []
        return int(names[-1][:-5]), [Version(**v) for v in json.loads(self.files.read(f"{self.folder}/manifests/{names[-1]}"))["versions"]]

    def exists(self) -> bool:
        return bool(self._newest()[0])

    def latest(self) -> Version:
        versions = self.manifest()
        if not versions:
            raise StoreError(f"no table in {self.folder}")
        return versions[-1]

    def version(self, txn: int | None) -> Version:
        """The newest version that isn't newer than txn."""
        found = [v for v in self.manifest() if txn is None or v.txn <= txn]
        if not found:
            raise StoreError(f"no version at {txn}")
        return found[-1]

    def read(self, txn: int | None = None) -> DataFrame:
        v = self.version(txn)
        return self.spark.read.schema(T.StructType.fromJson(json.loads(v.columns))).parquet(f"{self.folder}/{v.data}")

    def constraints(self, txn: int | None = None) -> Constraints:
        return Constraints.from_json(self.version(txn).constraints)

    def create(self, df: DataFrame, constraints: Constraints = Constraints()) -> int:
        """The first version from a frame. Rows without numbers are numbered in the order of partitions."""
        if self.manifest():
            raise StoreError("the table exists")
        rows = df if RECORD in df.columns else numbered(df, 0)
        rows = rows if DELETED in rows.columns else rows.withColumn(DELETED, F.lit(False))
        return self._commit(rows, None, constraints, True, 0)

    def begin(self, txn: int | None = None, immediate: bool = False) -> Transaction:
        """immediate: test constraints that aren't deferred after each step, not at commit alone."""
        return Transaction(self, self.version(txn), immediate)

    def beside(self, name: str) -> DataFrame:
        """The newest rows of another table of the same folder."""
        other = Store(self.spark, f"{self.folder.rpartition('/')[0]}/{name}")
        if not other.exists():
            raise ConstraintError(f"a foreign key names a table that isn't there: {name}")
        return other.read()

    def _prepare(self, after: DataFrame, before: DataFrame | None, constraints: Constraints, reset: bool, base: int, tables=None, skip: frozenset = frozenset()) -> Prepared:
        """Write a version and its changes into new folders, and test it."""
        number, versions = self._newest()
        if (versions[-1].txn if versions else 0) != base:
            raise StoreError("the table was changed by another transaction")
        txn = base + 1
        unique = f"{txn:012d}-{uuid.uuid4().hex}"
        out = Prepared(self, number + 1, [*versions, Version(txn, f"data/{unique}", 0, constraints.to_json(), after.schema.json(), f"pending/{unique}")])
        path = f"{self.folder}/data/{unique}"
        try:
            after.write.parquet(path)
            written = self.spark.read.schema(after.schema).parquet(path)
            validate(written, constraints, tables or self.beside, skip)
            changes(before, written, reset).write.parquet(f"{self.folder}/pending/{unique}")
        except Exception:
            out.discard()
            raise
        out.versions[-1] = replace(out.versions[-1], rows=written.count())
        return out

    def _publish(self, prepared: Prepared, decided: bool = False) -> int:
        """Create the manifest: the commit point, unless a catalog's log has decided already. Then show the changes."""
        if not self.files.create(f"{self.folder}/manifests/{prepared.number:012d}.json", prepared.manifest()) and not decided:
            prepared.discard()
            raise StoreError("the table was changed by another transaction")
        self.recover()
        return prepared.versions[-1].txn

    def _commit(self, after: DataFrame, before: DataFrame | None, constraints: Constraints, reset: bool, base: int, tables=None, skip: frozenset = frozenset()) -> int:
        return self._publish(self._prepare(after, before, constraints, reset, base, tables, skip))

    def recover(self) -> None:
        """Publish the changes of committed versions that a crash left pending."""
        for v in self.manifest():
            if v.changes:
                self.files.move(f"{self.folder}/{v.changes}", f"{self.folder}/changes/txn={v.txn:012d}")

    def cleanup(self) -> list[str]:
        """Remove folders that no version names: what failed commits left. Only while nobody commits."""
        self.recover()
        named = {v.data for v in self.manifest()}
        loose = [f"data/{n}" for n in self.files.names(f"{self.folder}/data") if f"data/{n}" not in named]
        loose += [f"pending/{n}" for n in self.files.names(f"{self.folder}/pending")]
        for folder in loose:
            self.files.delete(f"{self.folder}/{folder}")
        return loose

    def _write_manifest(self, number: int, versions: list[Version]) -> None:
        if not self.files.create(f"{self.folder}/manifests/{number + 1:012d}.json", json.dumps({"versions": [v.__dict__ for v in versions]})):
            raise StoreError("the table was changed by another transaction")

    # -- history ------------------------------------------------------------

    def changes(self, after: int = 0, limit: int | None = None) -> DataFrame:
        """txn, reset, record_number, before, after of the transactions behind `after`; limit: transactions at most."""
        txns = [v.txn for v in self.manifest() if v.txn > after]
        txns = txns[:limit] if limit is not None else txns
        schema = "reset boolean, record_number long, before string, after string"
        out = [self.spark.read.schema(schema).parquet(f"{self.folder}/changes/txn={t:012d}").withColumn("txn", F.lit(t).cast("long")) for t in txns]
        empty = self.spark.createDataFrame([], schema + ", txn long")
        return reduce(lambda a, b: a.unionByName(b), out, empty)

    def row_versions(self, record: int) -> DataFrame:
        """txn and content of a row after each transaction that changed it."""
        return self.changes().where(F.col("record_number") == record).select("txn", "after").orderBy("txn")

    def row_at(self, record: int, txn: int) -> DataFrame:
        return self.read(txn).where(F.col(RECORD) == record)

    def gc(self, keep: int) -> list[int]:
        """Drop all but the newest versions' data; the change log stays. The dropped transactions."""
        number, versions = self._newest()
        drop = versions[:-keep] if keep > 0 else []
        if drop:
            self._write_manifest(number, versions[len(drop) :])
            for v in drop:
                self.files.delete(f"{self.folder}/{v.data}")
        return [v.txn for v in drop]

    def backup(self, folder: str, txn: int | None = None) -> None:
        """Copy one version, as a table of its own."""
        v = self.version(txn)
        Store(self.spark, folder).create(self.read(txn), Constraints.from_json(v.constraints))

    def restore(self, folder: str) -> int:
        """Commit another table's newest rows as the newest version here."""
        other = Store(self.spark, folder)
        return self._commit(other.read(), None, other.constraints(), True, self.latest().txn)

    def pack(self) -> int:
        """Drop deleted rows and number the rest anew."""
        before, v = self.read(), self.latest()
        kept = before.where(~F.col(DELETED))
        places = dense_numbers(kept.select(RECORD))
        rows = kept.join(places, RECORD).drop(RECORD).withColumnRenamed("__new", RECORD).select(*before.columns)
        return self._commit(rows, before, Constraints.from_json(v.constraints), True, v.txn)


def dense_numbers(keys: DataFrame, parts: int = 64) -> DataFrame:
    """_record_number and __new, 1 and up in its order, without a window over all rows."""
    from .functions.order import dense_rank

    ranked, _ = dense_rank(keys, RECORD, "__rank", parts)
    return ranked.select(RECORD, (F.col("__rank") + 1).cast("long").alias("__new"))


def numbered(df: DataFrame, base: int) -> DataFrame:
    """Rows with numbers from base + 1, in the order of partitions. The plan must be stable, as scans are."""
    with_place = df.withColumn("__place", F.monotonically_increasing_id())
    sizes = {r[0]: r[1] for r in with_place.groupBy(F.shiftright("__place", 33)).count().collect()}  # one row a partition
    before, total = [], base
    for p in sorted(sizes):
        before += [F.lit(p), F.lit(total)]
        total += sizes[p]
    start = F.create_map(*before)[F.shiftright("__place", 33)] if before else F.lit(base)
    return with_place.withColumn(RECORD, (start + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("__place")


def content(df: DataFrame) -> Column:
    return F.to_json(F.struct(*(F.col(f"`{n}`") for n in sorted(df.columns) if n != RECORD)), {"ignoreNullFields": "false"})


def changes(before: DataFrame | None, after: DataFrame, reset: bool) -> DataFrame:
    """reset, record_number, before, after: rows that differ; all rows of `after` where numbers were given anew."""
    new = after.select(F.col(RECORD).alias("record_number"), content(after).alias("after"))
    if before is None or reset:
        return new.select(F.lit(True).alias("reset"), "record_number", F.lit(None).cast("string").alias("before"), "after")
    old = before.select(F.col(RECORD).alias("record_number"), content(before).alias("before"))
    met = old.join(new, "record_number", "full").where(~F.col("before").eqNullSafe(F.col("after")))
    return met.select(F.lit(False).alias("reset"), "record_number", "before", "after")


class Transaction:
    """Steps over one version, as a plan; nothing is written before commit()."""

    def __init__(self, store: Store, base: Version, immediate: bool = False):
        self.store, self.base, self.immediate = store, base, immediate
        self.before = self.after = store.read(base.txn)
        self.rules = Constraints.from_json(base.constraints)
        self.count, self.steps = base.rows, 0
        self.deferred = set(self.rules.deferred) | {key_name(k) for k in self.rules.foreign_keys if k.deferred}
        self.tables = store.beside

    @property
    def fields(self) -> list[T.StructField]:
        return [f for f in self.before.schema if f.name not in (RECORD, DELETED)]

    def _step(self) -> None:
        self.steps += 1
        if self.steps > MOST_STEPS:
            raise StoreError(f"more than {MOST_STEPS} steps")

    def query(self, document) -> DataFrame:
        """A query document over the rows as they are in this transaction."""
        from .engine import Engine

        return Engine(self.store.spark).find(self.after, document)

    def _changed(self, after: DataFrame) -> None:
        """Take a step's result, unless it breaks a constraint that isn't deferred."""
        if self.immediate:
            validate(after, self.rules, self.tables, frozenset(self.deferred))
        self.after = after

    def set_deferred(self, *names: str, deferred: bool = True) -> None:
        """Defer constraints (by the names in errors) to the commit, or test them from now on; those that are broken by then raise."""
        if unknown := set(names) - constraint_names(self.rules):
            raise StoreError(f"unknown constraints: {sorted(unknown)}")
        if not deferred:
            validate(self.after, self.rules, self.tables, frozenset(constraint_names(self.rules) - set(names)))
        self.deferred = self.deferred | set(names) if deferred else self.deferred - set(names)

    def insert(self, rows: Iterable[dict] | DataFrame) -> None:
        """Rows from dicts, or a frame of any size; absent fields take their default or null."""
        self._step()
        names = {f.name: f for f in self.fields}
        if isinstance(rows, DataFrame):
            if unknown := set(rows.columns) - set(names):
                raise StoreError(f"unknown fields: {sorted(unknown)}")
            new = numbered(rows, self.count)
            self.count += rows.count()
        else:
            listed = []
            for r in rows:
                if unknown := set(r) - set(names):
                    raise StoreError(f"unknown fields: {sorted(unknown)}")
                self.count += 1
                listed.append({RECORD: self.count} | r)
            auto = self.rules.auto_increment
            if auto and any(r.get(auto) is None for r in listed):
                top = self.after.agg(F.max(auto)).first()[0] or 0
                for r in listed:
                    if r.get(auto) is None:
                        top += 1
                        r[auto] = top
            given = sorted({k for r in listed for k in r})
            schema = T.StructType([T.StructField(RECORD, T.LongType()) if k == RECORD else names[k] for k in given])
            schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
            new = self.store.spark.createDataFrame([tuple(r.get(k) for k in given) for r in listed], schema)
        for n, f in names.items():
            default = self.rules.defaults.get(n)
            if n not in new.columns:
                new = new.withColumn(n, F.lit(default).cast(f.dataType))
        new = new.withColumn(DELETED, F.lit(False)).select(*(F.col(f"`{c.name}`").cast(c.dataType).alias(c.name) for c in self.after.schema))
        self._changed(self.after.unionByName(new))

    def _row(self, record: int) -> Column:
        return F.col(RECORD) == record

    def _must_exist(self, record: int, deleted: bool = False) -> None:
        if self.after.where(self._row(record) & (F.col(DELETED) == deleted)).isEmpty():
            raise StoreError(f"no {'deleted ' if deleted else ''}record {record}")

    def replace(self, record: int, row: dict) -> None:
        """All fields anew; absent ones become null, an automatic number stays."""
        self._must_exist(record)
        full = {f.name: row.get(f.name) for f in self.fields if f.name != self.rules.auto_increment or f.name in row}
        if unknown := set(row) - {f.name for f in self.fields}:
            raise StoreError(f"unknown fields: {sorted(unknown)}")
        self._set(record, full)

    def patch(self, record: int, change: dict) -> None:
        """{field: value}, or the operators $set, $unset and $inc, each field once."""
        self._must_exist(record)
        operators = {k for k in change if k.startswith("$")}
        if operators and operators != set(change):
            raise StoreError("fields and operators can't be mixed")
        if not operators:
            return self._set(record, change)
        if unknown := operators - {"$set", "$unset", "$inc"}:
            raise StoreError(f"unknown operators: {sorted(unknown)}")
        unset = change.get("$unset", {})
        plain = dict(change.get("$set", {})) | {k: None for k in unset}
        more = change.get("$inc", {})
        touched = [*change.get("$set", {}), *unset, *more]
        if len(touched) != len(set(touched)):
            raise StoreError("a field may be changed once")
        if any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in more.values()):
            raise StoreError("$inc takes numbers")
        self._set(record, plain, more)

    def _set(self, record: int, values: dict, more: dict | None = None) -> None:
        self._step()
        types = {f.name: f.dataType for f in self.fields}
        if unknown := (set(values) | set(more or {})) - set(types):
            raise StoreError(f"unknown fields: {sorted(unknown)}")
        at = self._row(record)
        columns = {k: F.when(at, F.lit(v).cast(types[k])).otherwise(F.col(f"`{k}`")) for k, v in values.items()}
        columns |= {k: F.when(at, (F.col(f"`{k}`") + F.lit(v)).cast(types[k])).otherwise(F.col(f"`{k}`")) for k, v in (more or {}).items()}
        self._changed(self.after.withColumns(columns))

    def _document(self, record: int) -> dict:
        r = self.after.where(self._row(record) & ~F.col(DELETED)).drop(RECORD, DELETED).first()
        if r is None:
            raise StoreError(f"no record {record}")
        return r.asDict(True)

    def merge_patch(self, record: int, patch: dict) -> None:
        """JSON merge patch: null removes."""
        self.replace(record, merged(self._document(record), patch))

    def json_patch(self, record: int, operations: list[dict]) -> None:
        """JSON patch: add, remove, replace, move, copy and test."""
        self.replace(record, {k: v for k, v in patched(self._document(record), operations).items() if v is not None})

    def delete(self, record: int) -> None:
        self._must_exist(record)
        self._mark(record, True)

    def recall(self, record: int) -> None:
        self._must_exist(record, True)
        self._mark(record, False)

    def delete_where(self, filter: dict) -> None:
        """Mark all rows that match a filter, in one step."""
        from .operators.expressions import Scope
        from .operators.filters import compile_filter

        self._step()
        self._changed(self.after.withColumn(DELETED, F.col(DELETED) | compile_filter(Scope(self.after.schema), filter)))

    def _mark(self, record: int, deleted: bool) -> None:
        self._step()
        self._changed(self.after.withColumn(DELETED, F.when(self._row(record), F.lit(deleted)).otherwise(F.col(DELETED))))

    def merged(self, merge: bool) -> tuple[DataFrame, DataFrame, int]:
        """Before, after and base number of what is to be committed now."""
        latest = self.store.latest()
        if latest.txn == self.base.txn:
            return self.before, self.after, latest.txn
        if not merge:
            raise StoreError("the table was changed by another transaction")
        theirs = self.store.read(latest.txn)
        return theirs, row_merge(self.before, self.after, theirs), latest.txn

    def commit(self, tables=None, merge: bool = False) -> int:
        """Write a new version. merge: where others committed meanwhile, put both sets of row changes together if they touch different rows.

        Where tables beside this one refer to it, or the folder has a catalog log, the
        commit is one of a catalog transaction: actions of foreign keys change those tables too.
        """
        from .transactions import CatalogTransaction, belongs_to_catalog

        if tables is None and belongs_to_catalog(self.store):
            folder, _, name = self.store.folder.rpartition("/")
            whole = CatalogTransaction(self.store.spark, folder)
            whole.open[name] = self
            whole.commit(merge)
            return self.store.latest().txn
        before, after, base = self.merged(merge)
        return self.store._commit(after, before, self.rules, False, base, tables)

    def rollback(self) -> None:
        self.after = self.before


def row_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Three-way merge by record number; an error where both changed a row, or either changed the layout or inserted."""
    if ours.schema != theirs.schema or base.schema != ours.schema:
        raise StoreError("the layout was changed meanwhile")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(RECORD).alias(RECORD), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name))

    met = side(base, "b").join(side(ours, "o"), RECORD, "full").join(side(theirs, "t"), RECORD, "full")
    o, t = ~F.col("o").eqNullSafe(F.col("b")), ~F.col("t").eqNullSafe(F.col("b"))
    if not met.where((o & t & ~F.col("o").eqNullSafe(F.col("t"))) | (F.col("b").isNull() & (o | t))).isEmpty():
        raise StoreError("both transactions changed a row or inserted rows")
    return met.select(F.when(o, F.col("o")).otherwise(F.col("t")).alias("r")).select("r.*")


def merged(document: Any, patch: Any) -> Any:
    if not isinstance(patch, dict):
        return patch
    out = dict(document) if isinstance(document, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merged(out.get(k), v)
    return out


def patched(document: dict, operations: list[dict]) -> dict:
    import copy

    if len(operations) > 100:
        raise StoreError("more than 100 patch operations")
    document = copy.deepcopy(document)

    def parts(pointer: str) -> list[str]:
        if not pointer.startswith("/"):
            raise StoreError(f"not a pointer: {pointer}")
        return [p.replace("~1", "/").replace("~0", "~") for p in pointer[1:].split("/")]

    def parent(pointer: str):
        node, names = document, parts(pointer)
        for p in names[:-1]:
            try:
                node = node[int(p)] if isinstance(node, list) else node[p]
            except (KeyError, IndexError, ValueError, TypeError):
                raise StoreError(f"nothing at {pointer}") from None
        return node, names[-1]

    def get(pointer: str):
        node, last = parent(pointer)
        try:
            return node[int(last)] if isinstance(node, list) else node[last]
        except (KeyError, IndexError, ValueError, TypeError):
            raise StoreError(f"nothing at {pointer}") from None

    def add(pointer: str, value) -> None:
        node, last = parent(pointer)
        if isinstance(node, list):
            node.insert(len(node) if last == "-" else int(last), value)
        else:
            node[last] = value

    def remove(pointer: str):
        out = get(pointer)
        node, last = parent(pointer)
        del node[int(last) if isinstance(node, list) else last]
        return out

    for o in operations:
        op, path = o.get("op"), o.get("path", "")
        if op == "add":
            add(path, o["value"])
        elif op == "remove":
            remove(path)
        elif op == "replace":
            remove(path)
            add(path, o["value"])
        elif op == "move":
            add(path, remove(o["from"]))
        elif op == "copy":
            add(path, copy.deepcopy(get(o["from"])))
        elif op == "test":
            if get(path) != o["value"]:
                raise StoreError(f"the test of {path} failed")
        else:
            raise StoreError(f"unknown patch operation: {op}")
    return document
