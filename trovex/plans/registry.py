"""One entry per query: a Spark callable and, where SQL can express it, its SQL."""

from __future__ import annotations

import re
from functools import wraps

from ..model import ship

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = wraps(f)(lambda spark, sf_dir: f(ship(spark), sf_dir))
        if sql:
            # lambdas are written with arrows, as in Spark; DuckDB has its own form
            ORACLE_SQL[f.__name__] = re.sub(r"\b(\w+) -> ", r"lambda \1: ", re.sub(r"\((\w+), (\w+)\) -> ", r"lambda \1, \2: ", sql))
        return f

    return add
