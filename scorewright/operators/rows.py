"""Filters, column choice and automatic roles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.config import LABEL, TEST, Roles
from .predicates import compile_predicate


def exclude(df: DataFrame, predicate: Column | str | None = None, *, python: str | None = None, names: Mapping[str, object] | None = None) -> DataFrame:
    """Rows for which the predicate isn't true; unknown keeps the row.

    ``predicate`` is a Column or SQL text, ``python`` a Python text over ``inds``
    (see predicates); a row that either names is left out.
    """
    if isinstance(predicate, str):
        predicate = F.expr(predicate) if predicate.strip() else None
    if predicate is not None:
        df = df.where(~F.coalesce(predicate.cast("boolean"), F.lit(False)))
    return df.where(~compile_predicate(df, python, names)) if python and python.strip() else df


def work_file(df: DataFrame) -> DataFrame:
    """Model and validation rows; all rows of a table without partition labels."""
    return df.where(~(F.coalesce(F.col(LABEL), F.lit(0)) == TEST)) if LABEL in df.columns else df


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in each of the columns."""
    return df.na.drop(subset=list(dict.fromkeys(columns)))


def prefixed(df: DataFrame, prefix: str, keep_list: tuple[str, ...] = ()) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c not in keep_list]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))]


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct values without nulls.

    One row per (column, value) is counted, so the distinct values of all
    columns spread over the tasks together instead of expanding every row once
    per column in one wide aggregate.
    """
    if not columns:
        return {}
    long = unpivoted(df, columns).where("value is not null").groupBy("variable", "value").agg(F.lit(1).alias("one"))
    found = {r.variable: r.n for r in long.groupBy("variable").agg(F.count("*").alias("n")).collect()}
    return {c: found.get(c, 0) for c in columns}


def unpivoted(df: DataFrame, columns: list[str], *keep: str, kind: str = "string") -> DataFrame:
    """One row per row and column: the kept columns, variable, value."""
    items = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns])
    return df.select(*keep, F.explode(items).alias("_item")).select(*keep, "_item.variable", "_item.value")


def auto_roles(df: DataFrame, dep_var: str, id_col: str | None = None, **roles) -> Roles:
    """Numbers with two distinct values are binary, other numbers continuous, text nominal, nothing ordinal."""
    skip = {dep_var, id_col, LABEL, roles.get("weight"), *roles.get("keep_list", ())}
    numbers = [c for c in numeric_columns(df) if c not in skip]
    counts = distinct_counts(df, numbers)
    return Roles(id=id_col, dep_var=dep_var, bin_vars=tuple(c for c in numbers if counts[c] == 2), cont_vars=tuple(c for c in numbers if counts[c] != 2), nom_vars=tuple(c for c in text_columns(df) if c not in skip), **roles)
