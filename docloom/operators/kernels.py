"""Plain Python functions over one value as Arrow UDFs (column functions)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from docloom.shipping import ship


def kernel(fn: Callable[..., Any], kind: T.DataType, arity: int = 1) -> Callable[..., Column]:
    """``fn`` of ``arity`` values as a function of columns; Arrow batches in and out, one call a row.

    The column is null where fn returns None. fn must not raise on any input.
    """
    arrow = to_arrow_type(kind)

    def convert(values: list[Any]) -> pa.Array:
        return pa.array(values, type=arrow)

    if arity == 1:

        def run(a: pa.Array) -> pa.Array:
            return convert([fn(x) for x in a.to_pylist()])
    elif arity == 2:

        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return convert([fn(*x) for x in zip(a.to_pylist(), b.to_pylist(), strict=True)])
    elif arity == 3:

        def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return convert([fn(*x) for x in zip(a.to_pylist(), b.to_pylist(), c.to_pylist(), strict=True)])
    else:
        raise ValueError("one to three columns")
    udf = arrow_udf(run, kind)

    def column(*columns: Column) -> Column:
        ship(SparkSession.active())
        return udf(*columns)

    column.udf = udf  # for registration in SQL
    return column
