"""Columns that keep SQL NULL, NaN and infinity apart, and chromosome names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b as double; NULL where b is 0 or either is NULL (ANSI division would raise)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def safe_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over rows that have both; NULL where one side does not vary (the built-in would raise)."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = (F.when(both, col(c).cast("double")) for c in (a, b))
    return safe_div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def is_finite(c: Column | str) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def safe_log2(c: Column | str) -> Column:
    """log2, NULL for anything that is not a positive finite number."""
    c = col(c).cast("double")
    return F.when(is_finite(c) & (c > 0), F.log2(c))


def finite_or(c: Column | str, default: float) -> Column:
    return F.when(is_finite(c), col(c)).otherwise(F.lit(default))


def chrom_key(name: Column | str, numeric_sex: bool = True) -> Column:
    """Chromosome name to key: ``chr`` prefix off in any case, x/y raised; X, Y as 23, 24 in the numeric layer."""
    bare = F.upper(F.regexp_replace(col(name), "(?i)^chr", ""))
    return F.when(bare == "X", "23").when(bare == "Y", "24").otherwise(bare) if numeric_sex else bare


def chrom_label(key: Column | str) -> Column:
    """Inverse of the numeric keys: 23 and 24 become X and Y."""
    k = col(key).cast("string")
    return F.when(k == "23", "X").when(k == "24", "Y").otherwise(k)


def mad(values: Column | str, center: Column | str, scale: float = 1.4826) -> Column:
    """Aggregate: scaled median of absolute deviations from a centre that is already known per row."""
    return F.median(F.abs(col(values) - col(center))) * scale
