"""Columns of callers next to columns of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shield(df: DataFrame, inputs: tuple[str, ...], outputs: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with its other columns out of the way, and the function that brings them back.

    ``inputs`` keep their names; every other column gets a name no operator uses, whatever
    it was called, and has its own again in the result. A column called like one of
    ``outputs`` (in any case) is replaced by the operator's.
    """
    if {c.lower() for c in inputs} & {c.lower() for c in outputs}:
        raise ValueError(f"{sorted(inputs)} cannot be read and {sorted(outputs)} be made under one name")
    taken = {c.lower() for c in outputs}
    names, gone, back = [], [], []
    for i, column in enumerate(df.columns):
        if column in inputs and column not in names:
            names.append(column)
            back.append((column, column))
        elif column.lower() in taken:
            names.append(f"_replaced{i}")
            gone.append(f"_replaced{i}")
        else:
            names.append(f"_kept{i}")
            back.append((f"_kept{i}", column))
    inner = df.toDF(*names).drop(*gone)

    def restore(out: DataFrame) -> DataFrame:
        here = set(out.columns)
        return out.select(*[F.col(n).alias(c) for n, c in back if n in here], *[c for c in outputs if c in here])

    return inner, restore
