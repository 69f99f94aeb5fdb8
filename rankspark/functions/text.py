"""Text expressions built from Spark functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character that counts as white space (Unicode included).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
_WS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE_SPACE) + "]"


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip_right(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE_SPACE))


def present(c: Column) -> Column:
    """Stripped text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def clean(c: Column) -> Column:
    """Stripped text, or an empty string for null."""
    return F.coalesce(strip(c), F.lit(""))


def nonempty_items(items: Column) -> Column:
    """Strip every item of a string array and drop null and blank ones; order and repeats stay."""
    return F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))


def join_nonempty(items: Column, sep: str = ", ") -> Column:
    return F.array_join(nonempty_items(items), sep)


def whole_word_pattern(words: tuple[str, ...]) -> str:
    """One pattern for all words, so that a task compiles it once."""
    return r"(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in words) + r")(?![a-z0-9])"


def has_whole_word(text_lower: Column, term_lower: Column) -> Column:
    """Does the term stand in the text between characters other than a-z and 0-9?

    The cheap containment test runs first; a pattern is compiled only for terms that occur at all.
    """
    term = F.regexp_replace(term_lower, r"(\p{Punct})", r"\\$1")
    pattern = F.concat(F.lit("(?<![a-z0-9])"), term, F.lit("(?![a-z0-9])"))
    return (term_lower != "") & F.contains(text_lower, term_lower) & F.rlike(text_lower, pattern)


def digit_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\p{Nd}+"), F.lit(0))


def tidy(c: Column) -> Column:
    """Repair spacing and commas where a part of a sentence was left out."""
    c = F.regexp_replace(c, f"{_WS}+", " ")
    c = F.regexp_replace(c, r" +([,;.)])", "$1")
    c = F.regexp_replace(c, r"\( +", "(")
    c = F.regexp_replace(c, r"(?:, *)+([;.)])", "$1")
    return strip(c)


def fixed_decimals(c: Column, digits: int = 6) -> Column:
    """``%.<digits>f`` of a double, rounded on its exact binary value, halves to even.

    ``format_string`` rounds the shortest decimal text of a number, which may lie on the other side of a
    half. Here the fraction is split into two halves of 26 bits (Veltkamp), whose products with the power
    of ten are exact, so that the comparison with one half is too. Exact below 2**63 and
    for up to 7 digits; larger numbers are formatted by Spark.
    """
    if not 0 <= digits <= 7:
        raise ValueError(f"0 to 7 digits, got {digits}")
    scale = float(10**digits)
    x = F.abs(c.cast("double"))
    whole = F.floor(x)
    part = x - whole.cast("double")
    wide = part * F.lit(134217729.0)
    high = wide - (wide - part)
    a, b = high * F.lit(scale), (part - high) * F.lit(scale)
    below = F.floor(a)
    over = a - below.cast("double") - F.lit(0.5)
    up = (over > -b) | ((over == -b) & (below % 2 == 1))
    if digits == 0:  # the half belongs to the whole number itself
        up = (part > 0.5) | ((part == 0.5) & (whole % 2 == 1))
        below = F.lit(0).cast("bigint")
    n = below + F.when(up, F.lit(1)).otherwise(F.lit(0))
    carried = whole + F.when(n >= int(scale), F.lit(1)).otherwise(F.lit(0)) if digits else whole + n
    shown = carried.cast("string")
    if digits:
        shown = F.concat(shown, F.lit("."), F.lpad((n % int(scale)).cast("string"), digits, "0"))
    sign = F.when(F.startswith(c.cast("double").cast("string"), F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    finite = F.when(x < float(2**63), shown).otherwise(F.format_string(f"%.{digits}f", x))
    known = F.when(F.isnan(x), F.lit("nan")).when(x == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, finite))
    return F.when(c.isNotNull(), known)
