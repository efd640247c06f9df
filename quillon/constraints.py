"""Constraints as queries: each gives the rows that break it, so that an empty result is a pass."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ConstraintError
from .operators.expressions import Scope
from .operators.filters import compile_filter
from .plans.documents import check_filter

ACTIONS = ("restrict", "no_action", "cascade", "set_null")


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    parent: tuple[str, ...]
    on_delete: str = "restrict"
    on_update: str = "restrict"
    deferred: bool = False


@dataclass(frozen=True)
class Constraints:
    not_null: tuple[str, ...] = ()
    primary: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: dict[str, dict] = field(default_factory=dict)
    defaults: dict = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()
    deferred: frozenset = frozenset()  # names of constraints that are tested at commit alone
    auto_increment: str | None = None

    @staticmethod
    def from_json(d: dict) -> Constraints:
        for f in d.get("checks", {}).values():
            check_filter(f)
        keys = tuple(ForeignKey(tuple(k["columns"]), k["table"], tuple(k["parent"]), k.get("on_delete", "restrict"), k.get("on_update", "restrict"), k.get("deferred", False)) for k in d.get("foreign_keys", []))
        for k in keys:
            if k.on_delete not in ACTIONS or k.on_update not in ACTIONS or len(k.columns) != len(k.parent):
                raise ConstraintError("a foreign key that isn't valid")
        return Constraints(tuple(d.get("not_null", ())), tuple(d.get("primary", ())), tuple(tuple(u) for u in d.get("unique", ())), d.get("checks", {}), d.get("defaults", {}), keys, frozenset(d.get("deferred", ())), d.get("auto_increment"))

    def to_json(self) -> dict:
        return {
            "not_null": list(self.not_null), "primary": list(self.primary), "unique": [list(u) for u in self.unique], "checks": self.checks, "defaults": self.defaults, "deferred": sorted(self.deferred), "auto_increment": self.auto_increment,
            "foreign_keys": [{"columns": list(k.columns), "table": k.table, "parent": list(k.parent), "on_delete": k.on_delete, "on_update": k.on_update, "deferred": k.deferred} for k in self.foreign_keys],
        }


def active(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_deleted")) if "_deleted" in df.columns else df


def null_rows(df: DataFrame, columns) -> DataFrame:
    return active(df).where(reduce(lambda a, b: a | b, (F.col(f"`{c}`").isNull() for c in columns)))


def repeated_keys(df: DataFrame, columns) -> DataFrame:
    """Keys without nulls that more than one row has."""
    whole = active(df).where(reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in columns)))
    return whole.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def failing_check(df: DataFrame, check: dict) -> DataFrame:
    return active(df).where(~compile_filter(Scope(df.schema), check))


def orphans(child: DataFrame, parent: DataFrame, columns, parents) -> DataFrame:
    """Rows whose key, without nulls, no parent row has."""
    keys = active(parent).select(*(F.col(f"`{p}`").alias(f"__p{i}") for i, p in enumerate(parents)))
    whole = active(child).where(reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in columns)))
    return whole.join(keys, reduce(lambda a, b: a & b, (whole[c] == keys[f"__p{i}"] for i, c in enumerate(columns))), "left_anti")


def key_name(k: ForeignKey) -> str:
    return f"foreign_key:{','.join(k.columns)}"


def constraint_names(c: Constraints) -> set[str]:
    """The names of a table's constraints, as errors give them."""
    out = {"not_null"} if c.not_null or c.primary else set()
    out |= {"primary"} if c.primary else set()
    return out | {f"unique:{','.join(u)}" for u in c.unique} | {f"check:{n}" for n in c.checks} | {key_name(k) for k in c.foreign_keys}


def validate(df: DataFrame, c: Constraints, tables=None, skip: frozenset = frozenset()) -> None:
    """Raise for the first constraint that df breaks. tables: parent frames by name. skip: names that are deferred now."""
    found: list[tuple[str, DataFrame]] = []
    if c.not_null or c.primary:
        found.append(("not_null", null_rows(df, (*c.not_null, *c.primary))))
    if c.primary:
        found.append(("primary", repeated_keys(df, c.primary)))
    found += [(f"unique:{','.join(u)}", repeated_keys(df, u)) for u in c.unique]
    found += [(f"check:{n}", failing_check(df, f)) for n, f in c.checks.items()]
    if tables is not None:
        found += [(key_name(k), orphans(df, tables(k.table), k.columns, k.parent)) for k in c.foreign_keys if key_name(k) not in skip]
    for name, rows in found:
        if name not in skip and not rows.isEmpty():
            raise ConstraintError(f"constraint {name} is broken")


def propagate(before: DataFrame, after: DataFrame, children: dict[str, tuple[DataFrame, ForeignKey]], record: str = "_record_number") -> dict[str, DataFrame]:
    """Child tables after a parent's rows were deleted or its keys changed, by each key's action."""
    out = {}
    for name, (child, key) in children.items():
        olds = active(before).select(record, *(F.col(f"`{p}`").alias(f"__o{i}") for i, p in enumerate(key.parent)))
        news = active(after).select(F.col(record).alias("__r"), *(F.col(f"`{p}`").alias(f"__n{i}") for i, p in enumerate(key.parent)))
        moved = olds.join(news, olds[record] == news["__r"], "left").withColumn("__gone", F.col("__r").isNull()).drop("__r", record)
        changed = reduce(lambda a, b: a | b, (~F.col(f"__o{i}").eqNullSafe(F.col(f"__n{i}")) for i in range(len(key.parent))))
        moved = moved.where(F.col("__gone") | changed)
        refers = reduce(lambda a, b: a & b, (child[c] == moved[f"__o{i}"] for i, c in enumerate(key.columns)))
        hit = child.join(moved, refers & ~child["_deleted"] if "_deleted" in child.columns else refers, "left")
        touched = F.col("__gone").isNotNull()
        for gone, action in ((True, key.on_delete), (False, key.on_update)):
            which = touched & (F.col("__gone") == gone)
            if action == "no_action":
                continue  # the key itself is tested once all actions are done
            if action == "restrict":
                if not hit.where(which).isEmpty():
                    raise ConstraintError(f"rows of {name} still refer to what was {'deleted' if gone else 'changed'}")
            elif action == "cascade" and gone:
                hit = hit.withColumn("_deleted", F.col("_deleted") | F.coalesce(which, F.lit(False)))
            else:
                for i, c in enumerate(key.columns):
                    new = F.lit(None) if action == "set_null" else F.col(f"__n{i}")
                    hit = hit.withColumn(c, F.when(F.coalesce(which, F.lit(False)), new).otherwise(F.col(f"`{c}`")))
        out[name] = hit.select(*child.columns)
    return out
