"""Vectorised Python functions that need no session to be defined."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(kind: str) -> Callable:
    """As pandas_udf, but made when it is called."""

    def of(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return of
