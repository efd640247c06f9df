"""Inclusion and exclusion of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def tree_of(paths, names: list[str]) -> dict:
    """Paths as nested dicts; True marks an end. An exact name wins over a dotted path."""
    out: dict = {}
    for p in paths:
        if p in names:
            out[p] = True
            continue
        node, parts = out, p.split(".")
        for part in parts[:-1]:
            if node.get(part) is True:
                break
            node = node.setdefault(part, {})
        else:
            node[parts[-1]] = True
    return out


def only(c: Column, t: T.DataType, tree) -> Column | None:
    """The listed parts of a value; None if it has none of them."""
    if tree is True:
        return c
    if isinstance(t, T.StructType):
        parts = [(n, only(c[n], t[n].dataType, tree[n])) for n in t.names if n in tree]
        parts = [x.alias(n) for n, x in parts if x is not None]
        return F.when(c.isNotNull(), F.struct(*parts)) if parts else None
    if isinstance(t, T.MapType):
        return F.map_filter(c, lambda k, _: k.isin(list(tree)))
    if isinstance(t, T.ArrayType):
        if all(k.isdigit() for k in tree):
            places = {int(k): v for k, v in tree.items()}

            def at(e: Column, i: Column) -> Column:
                out = F.lit(None)
                for p, sub in places.items():
                    inner = only(e, t.elementType, sub)
                    out = F.when(i == p, inner).otherwise(out) if inner is not None else out
                return out

            return F.transform(F.slice(c, 1, max(places) + 1), at)
        if only(F.lit(None).cast(t.elementType), t.elementType, tree) is None:
            return None
        return F.transform(c, lambda e: only(e, t.elementType, tree))
    return None


def without(c: Column, t: T.DataType, tree) -> Column:
    """A value without the listed parts; an element of an array becomes null."""
    if isinstance(t, T.StructType):
        parts = [(without(c[n], t[n].dataType, tree[n]) if n in tree else c[n]).alias(n) for n in t.names if tree.get(n) is not True]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(t, T.MapType):
        return F.map_filter(c, lambda k, _: ~k.isin([k for k, v in tree.items() if v is True]))
    if isinstance(t, T.ArrayType):
        if all(k.isdigit() for k in tree):
            places = {int(k): v for k, v in tree.items()}

            def at(e: Column, i: Column) -> Column:
                out = e
                for p, sub in places.items():
                    out = F.when(i == p, F.lit(None) if sub is True else without(e, t.elementType, sub)).otherwise(out)
                return out

            return F.transform(c, at)
        return F.transform(c, lambda e: without(e, t.elementType, tree))
    return c


def project(df: DataFrame, projection: dict[str, int], hidden: set[str]) -> DataFrame:
    """df cut down to the projection; hidden columns always go."""
    names = [n for n in df.columns if n not in hidden]
    if not projection:
        return df.select(*(quoted(n) for n in names))
    tree = tree_of(projection, names)
    out = []
    for n in names:
        c, t = F.col(quoted(n)), df.schema[n].dataType
        if 1 in projection.values():
            if n in tree:
                part = only(c, t, tree[n])
                if part is not None:
                    out.append(part.alias(n))
        elif tree.get(n) is not True:
            out.append(without(c, t, tree[n]).alias(n) if n in tree else c)
    return df.select(*out)
