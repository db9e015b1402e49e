"""Column statistics: counts, least and greatest value, lengths in bytes, distinct values. One row a column."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade import types
from colonnade.functions import values

FIELDS = "column string, row_count bigint, null_count bigint, min_value string, max_value string, min_length bigint, max_length bigint, total_length bigint, unique_count bigint"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def _aggregates(c: Column, kind: str, exact: bool) -> list[Column]:
    """Of one column: rows, nulls, least, greatest, three lengths, distinct values."""
    lengths = [how(F.octet_length(c)).cast("bigint") if kind == "string" else F.lit(None).cast("bigint") for how in (F.min, F.max, F.sum)]
    return [F.count("*"), F.count_if(c.isNull()), F.min(c), F.max(c), *lengths, F.count_distinct(c) if exact else F.approx_count_distinct(c)]


def column_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """Statistics of every column of a type that tables have. exact: distinct values are counted exactly, by an aggregation of each column
    alone, which reads only that column and sends each task's different values once; else by sketches in one pass over
    all columns. Lengths are NULL but for strings, values are text."""
    kinds = [(f.name, types.of_spark(f.dataType, f.name).name) for f in df.schema]
    cells = lambda name, kind, got: [F.lit(name), got[0], got[1], values.to_text(got[2], kind), values.to_text(got[3], kind), *got[4:]]
    if exact:
        each = []
        for name, kind in kinds:
            made = df.agg(*(a.alias(f"a{k}") for k, a in enumerate(_aggregates(F.col(f"`{name}`"), kind, True))))
            each.append(made.select(*(c.alias(n) for c, n in zip(cells(name, kind, [F.col(f"a{k}") for k in range(8)]), NAMES, strict=True))))
        return reduce(DataFrame.unionAll, each)
    made = df.agg(*(a.alias(f"a{i}_{k}") for i, (name, kind) in enumerate(kinds) for k, a in enumerate(_aggregates(F.col(f"`{name}`"), kind, False))))
    rows = [F.struct(*(c.alias(n) for c, n in zip(cells(name, kind, [F.col(f"a{i}_{k}") for k in range(8)]), NAMES, strict=True))) for i, (name, kind) in enumerate(kinds)]
    return made.select(F.inline(F.array(*rows)))


@dataclass(frozen=True)
class TypedStatistics:
    """Statistics of one column with its least and greatest value as values of its type."""

    name: str
    type: types.ColumnType
    row_count: int
    null_count: int
    min_value: Any
    max_value: Any

    @classmethod
    def of(cls, df: DataFrame, name: str) -> TypedStatistics:
        kind, c = types.of_spark(df.schema[name].dataType, name), F.col(f"`{name}`")
        return cls(name, kind, *df.agg(F.count("*"), F.count_if(c.isNull()), F.min(c), F.max(c)).first())

    def may_hold(self, op: str, value: Any) -> bool:
        """Whether some row's value may compare so with value: what lets a reader skip rows."""
        if self.min_value is None or value is None:
            return False
        low, high = self.min_value, self.max_value
        return {"eq": low <= value <= high, "ne": low != value or high != value, "lt": low < value, "le": low <= value, "gt": high > value, "ge": high >= value}[op]
