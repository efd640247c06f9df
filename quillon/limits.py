"""Optional bounds. The default has none; `STRICT` has those of small embedded engines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .errors import QueryError


@dataclass(frozen=True)
class Limits:
    request_bytes: int | None = 1 << 20
    groups: int | None = None
    join_rows: int | None = None
    join_stages: int | None = None
    page_size: int = 1000

    def check(self, df: DataFrame, what: str) -> DataFrame:
        """df, after counting that it has no more rows than the bound of that name (an action, only where a bound is set)."""
        most = getattr(self, what)
        if most is not None and df.limit(most + 1).count() > most:
            raise QueryError(f"more than {most} {what.replace('_', ' ')}")
        return df


DEFAULT = Limits()
STRICT = Limits(groups=10_000, join_rows=100_000, join_stages=8)
