"""Numeric Column expressions: digit normalisation, safe casts, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: decimal digit blocks mapped to ASCII 0-9 ------------------------
# Python's int()/float() read any Unicode decimal digit; Spark's casts read ASCII only.
# Blocks: full-width, Arabic-Indic, extended Arabic-Indic, Devanagari, Bengali.
DIGIT_BLOCKS = (
    "０１２３４５６７８９"
    "٠١٢٣٤٥٦٧٨٩"
    "۰۱۲۳۴۵۶۷۸۹"
    "०१२३४५६७८९"
    "০১২৩৪৫৬৭৮৯"
)
ASCII_DIGITS = "0123456789" * 5
# Text accepted as a number by pandas.to_numeric (decimal, exponent, inf, nan).
NUMERIC_TEXT = r"(?i)^\s*[-+]?((\d+\.?\d*|\.\d+)(e[-+]?\d+)?|inf|infinity|nan)\s*$"
# Text accepted by Python int(): optional sign, digits with single underscores.
INT_TEXT = r"(?U)^\s*[-+]?\d+(_\d+)*\s*$"
# ----------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_digits(text) -> Column:
    return F.translate(_col(text), DIGIT_BLOCKS, ASCII_DIGITS)


def int_token(token) -> Column:
    """Python ``int(token)`` semantics: NULL where int() would raise."""
    t = _col(token)
    clean = F.regexp_replace(F.regexp_replace(ascii_digits(t), "(?U)^\\s+|\\s+$", ""), "_", "")
    return F.when(t.rlike(INT_TEXT), clean.try_cast("bigint"))


def coerce_numeric(value) -> Column:
    """``pd.to_numeric(errors='coerce')``; failures and NaN become NULL."""
    c = _col(value)
    txt = c.cast("string")
    parsed = F.when(txt.rlike(NUMERIC_TEXT), F.trim(txt).try_cast("double"))
    return F.nanvl(parsed, F.lit(None).cast("double"))


def rint_round(x, digits: int = 2) -> Column:
    """Round half-to-even at ``digits`` decimals by scale-rint-unscale (pandas/numpy rule)."""
    scale = float(10 ** digits)
    return F.rint(_col(x) * F.lit(scale)) / F.lit(scale)


def python_round(x, digits: int = 2) -> Column:
    """Python's ``round(x, digits)``: half to even on the *exact* binary value of x.

    ``rint(x * 10^d) / 10^d`` differs only when the product lands exactly on a half
    (2.675 * 100 == 267.5 in doubles although 2.675 is stored as 2.67499999...).  There
    the exact error of the product, recovered with Dekker's split (plain double
    arithmetic, exact in IEEE), says on which side the true value lies."""
    v = _col(x).cast("double")
    scale = float(10 ** digits)
    p = v * F.lit(scale)
    k = F.floor(p).cast("double")
    c = v * F.lit(134217729.0)          # 2^27 + 1: splits v into two 26-bit halves
    hi = c - (c - v)
    lo = v - hi
    err = (hi * F.lit(scale) - p) + lo * F.lit(scale)   # v * scale - p, exactly
    tie = (p - k) == F.lit(0.5)
    r = (F.when(tie & (err < 0), k).when(tie & (err > 0), k + F.lit(1.0)).otherwise(F.rint(p)))
    return r / F.lit(scale)


def mean_of_two(a, b, digits: int = 2) -> Column:
    """Mean of two ratings rounded like pandas ``.round(2)``."""
    return rint_round((_col(a) + _col(b)) / F.lit(2.0), digits)


def abs_diff(a, b) -> Column:
    """P22."""
    return F.abs(_col(a) - _col(b))


def answer_text(x, digits: int = 2) -> Column:
    """``str(round(x, 2))`` -- rounded value rendered as text ('5.0', '5.1'),
    with Python's rounding (``python_round``).

    Spark writes doubles of 1e7 and above in exponent form ('1.2E7') where Python
    writes all digits; that range is formatted with the decimals and one trailing zero
    dropped, which is Python's shortest form for a value with at most two decimals."""
    r = python_round(x, digits)
    long_form = F.regexp_replace(F.format_string(f"%.{digits}f", r), "(\\.\\d*?)0$", "$1")
    wide = (F.abs(r) >= F.lit(1e7)) & (F.abs(r) < F.lit(1e16))
    return F.when(wide, long_form).otherwise(r.cast("string"))
