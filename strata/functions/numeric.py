"""Column expressions for numbers (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A plain decimal or scientific number, as a pandas-style numeric parse accepts
# it.  Spark's own cast also takes suffixes such as '1d' or '1f', which a
# numeric coercion must reject.
NUMERIC_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|infinity|nan)$"

OUTPUT_DIGITS = 6


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def qcol(name: str) -> Column:
    """Column by a name that may contain dots or spaces."""
    return F.col(f"`{name}`")


def nan_to_null(c: str | Column) -> Column:
    """One missing marker: NaN becomes NULL for floating columns."""
    c = col_of(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def as_double(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Feature value as DOUBLE with NaN mapped to NULL.

    Text is coerced: cells that are not plain numbers become NULL.
    Booleans become 0/1.
    """
    c = col_of(c)
    if isinstance(dtype, T.StringType):
        t = F.lower(F.trim(c))
        return F.when(t.rlike(NUMERIC_TEXT), nan_to_null(t.try_cast("double")))
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    return nan_to_null(c.cast("double"))


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num/den as double; ``default`` when the denominator is zero."""
    r = F.try_divide(num.cast("double"), den.cast("double"))
    return r if default is None else F.coalesce(r, F.lit(float(default)))


def r6(c: str | Column) -> Column:
    """Output rounding shared with the SQL oracle."""
    return F.round(col_of(c).cast("double"), OUTPUT_DIGITS)


def unit_draw(*parts: str | Column) -> Column:
    """Deterministic uniform [0, 1) draw from md5 of the colon-joined parts.

    The same expression in DuckDB:
    ('0x' || substr(md5(...), 1, 8))::BIGINT / 4294967296e0
    """
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
