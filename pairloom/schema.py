"""Required columns and parsers that fail on what they don't know."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def lenient_boolean(c: Column) -> Column:
    """True for true, 1 and yes in any case; false for all else."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def three_state_boolean(c: Column) -> Column:
    """True, false or null (empty text, none, nan); an error for other text."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False).when(t.isNull() | t.isin("", "nan", "none"), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), t)).cast("boolean"))


def strict_boolean(c: Column) -> Column:
    """True or false; an error for all else, null too."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t == "true", True).when(t == "false", False).otherwise(F.raise_error(F.concat(F.lit("not true or false: "), F.coalesce(t, F.lit("null")))).cast("boolean"))


def unique(df: DataFrame, keys: list[str]) -> Column:
    """For an aggregate over df: whether no two rows share the keys."""
    return F.count("*") == F.count_distinct(*keys)


def normalized_name(c: Column) -> Column:
    """Lower case without anything but letters, digits and underscores."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", "")
