"""The register of queries: each is a function of the tables that its parameters name, beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from papyra.sources import tables as S

FOUND: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None):
    """Registers a function of the tables it names: its parameters are table names."""

    def add(f):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        FOUND[f.__name__] = (lambda spark, sf_dir: f(*[S.table(spark, sf_dir, n) for n in names]), sql)
        return f

    return add
