"""Text and number rules of a dynamically typed log reader, as native column expressions.

Blank, unparsable and absent cells mean different things to the metrics, so none of these turns one into another.
"""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space at the ends of a cell.
SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: What counts as a number, with the bases by their prefixes.
NUMBER = r"[+-]?(Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"
PREFIXED = {16: "0[xX][0-9a-fA-F]+", 8: "0[oO][0-7]+", 2: "0[bB][01]+"}


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def lower(c: Column) -> Column:
    return F.lower(trim(F.coalesce(c, F.lit(""))))


def upper(c: Column) -> Column:
    return F.upper(trim(F.coalesce(c, F.lit(""))))


def strip_edge_quotes(c: Column) -> Column:
    """Without one quote at either end."""
    return F.regexp_replace(c, '^"|"$', "")


def filled(c: Column) -> Column:
    """Whether a cell is there and not blank."""
    return F.coalesce(F.length(trim(c)) > 0, F.lit(False))


def number(c: Column) -> Column:
    """A cell as a double: decimal, exponent, Infinity, 0x, 0o or 0b; blank is 0, other text NaN, null NaN."""
    return trimmed_number(trim(c))


def trimmed_number(t: Column) -> Column:
    """number() of a cell that is trimmed already. Nearly all cells are told by one pattern and one cast; t stands here several times, so let
    it be a column or a cheap expression."""
    digits = F.substring(t, 3, 1 << 30)
    other = F.lit(None).cast("string")
    for base, pattern in PREFIXED.items():
        other = F.when(t.rlike(f"^{pattern}$"), F.conv(digits, base, 10)).otherwise(other)
    other = F.when(t.rlike("^0[xXoObB]"), F.coalesce(other.try_cast("double"), F.lit(float("nan")))).otherwise(float("nan"))
    return F.when(t.rlike(f"^({NUMBER})?$"), F.coalesce(t.try_cast("double"), F.lit(0.0))).otherwise(other)


def read_number(value: Any) -> float:
    """A value of a request by the same rules: a list of one counts as what it holds, an empty one as blank; what is no number is NaN."""
    if isinstance(value, list | tuple):
        return 0.0 if not value else read_number(value[0]) if len(value) == 1 else math.nan
    if isinstance(value, bool | int | float):
        return float(value)
    if value is None:
        return 0.0
    if not isinstance(value, str):
        return math.nan
    t = value.strip(SPACES)
    for base, pattern in PREFIXED.items():
        if re.fullmatch(pattern, t):
            return float(int(t[2:], base))
    return (float(t) if t else 0.0) if re.fullmatch(f"({NUMBER})?", t, re.ASCII) else math.nan


def number_text(c: Column) -> Column:
    """A double as text: no trailing .0, plain digits from 1e-6 up to 1e21."""
    size = F.abs(c)
    whole = F.when((c == F.floor(c)) & (size < 1e15), c.cast("long").cast("string"))
    plain = F.regexp_replace(F.regexp_replace(c.cast("string").try_cast("decimal(38,17)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(F.isnan(c), "NaN").when(size == float("inf"), c.cast("string")).otherwise(F.coalesce(whole, F.when((size >= 1e-6) & (size < 1e20), plain), c.cast("string")))


def finite(c: Column) -> Column:
    """Whether a double is there and neither NaN (which is above all numbers) nor infinite."""
    return F.coalesce(F.abs(c) < float("inf"), F.lit(False))


def no_nan(c: Column) -> Column:
    """Null for NaN. Unlike a condition with isnan this names the column once, so a filter on it stays small wherever it is pushed."""
    return F.nanvl(c, F.lit(None).cast("double"))
