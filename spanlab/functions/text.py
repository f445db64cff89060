"""Scalar column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's ``str.strip()`` removes: C0 separators, NEL and every
# Unicode separator.  Written as one explicit class so Java and RE2 agree.
NON_BLANK = r"[^\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"


def is_blank(text: Column) -> Column:
    """True for null text and text made only of whitespace (``strip()`` empty)."""
    return text.isNull() | ~text.rlike(NON_BLANK)


def strip(text: Column) -> Column:
    """Python ``text.strip()``: white space of ``NON_BLANK``'s complement off both ends."""
    ws = NON_BLANK.replace("[^", "[")
    return F.regexp_replace(text, rf"^{ws}+|{ws}+$", "")


def round6(x: Column) -> Column:
    """Round to 6 decimals with plain IEEE operations (identical in every engine)."""
    return F.floor(x * 1000000.0 + 0.5) / 1000000.0


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 when the denominator is 0 (zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def half_even_div(num: Column, den: Column) -> Column:
    """Integer ``round_half_even(num / den)`` computed exactly in integers."""
    q = F.floor(num / den).cast("bigint")
    r = num - q * den
    up = (2 * r > den) | ((2 * r == den) & (q % 2 == 1))
    return q + F.when(up, 1).otherwise(0)


def mean_1dp(total: Column, count: Column) -> Column:
    """Mean rounded half-even to one decimal (exact rational rounding)."""
    return half_even_div(total * 10, count) / 10.0


def percent_0dp(num: Column, den: Column) -> Column:
    """``'%.0f%%' % (num / den * 100)`` with half-even rounding, as text."""
    return F.concat(half_even_div(num * 100, den).cast("string"), F.lit("%"))


def surface_shape(text: Column) -> Column:
    """Shape of a surface form: digits -> 9, upper -> A, lower -> a."""
    s = F.regexp_replace(text, r"[0-9]", "9")
    s = F.regexp_replace(s, r"\p{Lu}", "A")
    return F.regexp_replace(s, r"\p{Ll}", "a")


def hash_bucket(*parts: Column, buckets: int = 100) -> Column:
    """``md5(p1,p2,..)`` -> first 4 hex digits as an int, modulo ``buckets``."""
    key = F.concat_ws(",", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int") % buckets


# A quoted string without escapes, the text between strings, or a stray quote.
_LITERAL_PART = r"""'[^']*+'|"[^"]*+"|[^'"]++|['"]"""


def normalise_literal(text: Column) -> Column:
    r"""Python-literal list text -> JSON that ``from_json`` reads.

    ``None``/``True``/``False`` become ``null``/``true``/``false`` outside quoted
    strings only.  Escaped backslashes and quotes become ``\uNNNN``, so that every quote
    left opens or closes a string, and ``\xNN`` becomes ``\u00NN``; other escapes are
    JSON's own.  Single-quoted strings stay: Spark's JSON reader accepts them.
    """
    out = F.replace(text, F.lit("\\\\"), F.lit("\\u005c"))
    for quote, code in (("'", "0027"), ('"', "0022")):
        out = F.replace(out, F.lit("\\" + quote), F.lit("\\u" + code))
    out = F.regexp_replace(out, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")

    def values(part: Column) -> Column:
        for py, js in (("None", "null"), ("True", "true"), ("False", "false")):
            part = F.regexp_replace(part, rf"\b{py}\b", js)
        return part

    parts = F.regexp_extract_all(out, F.lit(_LITERAL_PART), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^['\"]"), p).otherwise(values(p))), "")
