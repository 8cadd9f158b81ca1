"""Rows carried as one struct, so that no column of the input is meant by a name that an operator uses inside."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def name_of(column: str) -> str:
    """A column's name in quotes."""
    return "`" + column.replace("`", "``") + "`"


def whole(df: DataFrame, **more: Column) -> DataFrame:
    """``row``: all columns of a table in one struct; more: further columns, made of the table's."""
    return df.select(F.struct(*[F.col(name_of(c)) for c in df.columns]).alias("row"), *[c.alias(name) for name, c in more.items()])


def fields_of(df: DataFrame, without: Iterable[str] = ()) -> list[Column]:
    """The table's columns out of ``row``, in order, but for some."""
    left = set(without)
    return [F.col(f"row.{name_of(c)}").alias(c) for c in df.columns if c not in left]
