"""Errors of the engine."""


class QueryError(ValueError):
    """A document that isn't valid, or data that it can't be applied to."""


class StoreError(RuntimeError):
    """A store, catalog or transaction that can't do what was asked."""


class ConstraintError(StoreError):
    """A table that breaks one of its constraints."""
