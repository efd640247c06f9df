"""Keyset pages: a cursor names the last row of a page by its sort keys and record number."""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.collation import collated
from ..functions.order import sort_key
from ..plans.documents import QueryDocument
from .pipeline import RECORD
from .values import STRING, resolve


@dataclass
class Page:
    records: list[Row]
    cursor: str | None
    frame: DataFrame  # the rows of the page, as a plan


def plain(x):
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x


def keys_of(df: DataFrame, q: QueryDocument) -> list[tuple[str, Column, bool]]:
    out = []
    for i, (f, way) in enumerate(q.sort):
        v = resolve(df.schema, f)
        if v.present is not False and v.type is not None:
            c = sort_key(v)
            out.append((f"__k{i}", collated(c, q.collation) if v.kind == STRING else c, way == 1))
    return out


def after(keys: list[tuple[str, Column, bool]], values: list, record: int, types: dict) -> Column:
    """Rows behind the cursor: lexicographic, nulls first when ascending and last when descending."""
    out, equal = F.lit(False), F.lit(True)
    for (name, _, up), x in zip(keys, values):
        c = F.col(name)
        if x is None:
            beyond = c.isNotNull() if up else F.lit(False)
            same = c.isNull()
        else:
            at = F.lit(x).cast(types[name])
            beyond = F.coalesce(c > at, F.lit(False)) if up else F.coalesce(c < at, F.lit(False)) | c.isNull()
            same = c.eqNullSafe(at)
        out, equal = out | (equal & beyond), equal & same
    return out | (equal & (F.col(RECORD) > record))


def page(df: DataFrame, q: QueryDocument, snapshot: str) -> Page:
    """One page of filtered rows with record numbers."""
    keys = keys_of(df, q)
    df = df.withColumns({n: c for n, c, _ in keys}) if keys else df
    types = {n: df.schema[n].dataType for n, _, _ in keys}
    shape = {"version": 2 if q.sort else 1, "snapshot": snapshot} | ({"sort": [[f, w] for f, w in q.sort], "collation": q.collation} if q.sort else {})
    if q.cursor is not None:
        try:
            c = json.loads(q.cursor)
            values, record = c.pop("keys", []), c.pop("record")
        except (ValueError, KeyError, AttributeError, TypeError):
            raise QueryError("not a cursor") from None
        if c != shape or len(values) != len(keys) or not isinstance(record, int):
            raise QueryError("the cursor belongs to another query or snapshot")
        df = df.where(after(keys, values, record, types))
    order = [F.col(n).asc() if up else F.col(n).desc() for n, _, up in keys]
    size = q.page_size if q.limit is None else min(q.page_size, q.limit)
    rows = df.orderBy(*order, RECORD).limit(size + 1)
    got = rows.collect()  # at most a page and one row
    more = len(got) > size and size > 0
    cursor = None
    if more:
        last = got[size - 1]
        cursor = json.dumps(shape | {"record": last[RECORD]} | ({"keys": [plain(last[n]) for n, _, _ in keys]} if keys else {}))
    names = {n for n, _, _ in keys}
    return Page(got[:size], cursor, df.orderBy(*order, RECORD).limit(size).drop(*names))
