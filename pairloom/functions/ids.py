"""Identifiers from content: sixteen hex digits of SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha16(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts]), 256), 1, 16)


def short_decimal(c: Column) -> Column:
    """Six decimals without trailing zeros and dot."""
    return F.regexp_replace(F.format_string("%.6f", c.cast("double")), r"\.?0+$", "")


def structure_id(kind: Column, chrom: Column, start: Column, end: Column, center: Column) -> Column:
    """TYPE_ and a hash of type, place and center."""
    t = F.upper(F.trim(kind))
    return F.concat(t, F.lit("_"), sha16(t, F.trim(chrom), start.cast("string"), end.cast("string"), short_decimal(center)))


def window_id(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("WIN_"), sha16(F.trim(chrom), start.cast("string"), end.cast("string")))


def scale_window_id(scale: Column, chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("WIN_"), scale, F.lit("_"), sha16(scale, F.trim(chrom), start.cast("string"), end.cast("string")))


def region_id(chrom: Column, start: Column, end: Column, peak: Column) -> Column:
    """A region of the final proposals: a hash of its place and of the window it is named by."""
    return F.concat(F.lit("FREG_"), sha16(chrom, start.cast("string"), end.cast("string"), peak))


#: What regions of one scale, of several scales and of the equalized detector are called; the rest is their peak window's.
REGIONS = {"single": "REG_", "multiscale": "MSREG_", "equalized": "EQREG_"}


def peak_region_id(detector: str, peak_window_id: Column) -> Column:
    return F.concat(F.lit(REGIONS[detector]), F.regexp_replace(peak_window_id, "^WIN_", ""))


def tie_key(seed: int, name: Column) -> Column:
    """An order that does not depend on the order of rows."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), name), 256)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_")


def dominant_branch(density: Column, shape: Column, strong: float = 1.3010299956639813) -> Column:
    """mixed if both tail scores reach -log10(0.05), else the larger one's name."""
    return F.when((density >= strong) & (shape >= strong), "mixed").when(density >= shape, "density").otherwise("shape")
