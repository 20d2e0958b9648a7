"""Cleaning and comparison forms of text, as column expressions.

White space is Unicode-aware, ``(?U)``: a no-break space counts as white space.
Null stays null unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing value, and the two value maps.
NULL_TOKENS = ["nan", "none", "", "<na>"]
TRANSMISSION = {"a": "automatic", "m": "manual"}
FUEL = {"gasoline": "gas"}


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _collapsed(c: Column) -> Column:
    return F.nullif(strip(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def clean_text(c: Column) -> Column:
    """Lower case, only a-z, digits and single blanks; a spelling of nothing or an empty result is null."""
    low = strip(F.lower(c.cast("string")))
    kept = F.when(~low.isin(NULL_TOKENS), F.regexp_replace(low, r"(?U)[^a-z0-9\s]", ""))
    return _collapsed(kept)


def clean_description(c: Column) -> Column:
    """As ``clean_text``, but links go first and other characters become blanks."""
    low = F.lower(c.cast("string"))
    kept = F.when(~low.isin(NULL_TOKENS), F.regexp_replace(F.regexp_replace(low, r"(?U)http\S+|www\S+", ""), r"(?U)[^a-z0-9\s]", " "))
    return _collapsed(kept)


def to_number(c: Column) -> Column:
    """A double, or null for anything that isn't a number (the JVM alone would read ``4d`` as 4)."""
    x = c.try_cast("double")
    suffixed = c.cast("string").rlike(r"(?i)\d[df]\s*$")
    return F.when(~F.isnan(x) & ~suffixed, x)


def mapped(c: Column, values: Mapping[str, str]) -> Column:
    """Whole values replaced, after lower-casing; others unchanged."""
    out = F.lower(c)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), out), out)


def compare_form(c: Column) -> Column:
    """Lower case, stripped; empty for null."""
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))


def year_form(c: Column) -> Column:
    """The integer part of a number as text; other text as it is; empty for null or blank."""
    whole = to_number(c.cast("string")).try_cast("bigint").cast("string")
    return F.coalesce(whole, strip(c.cast("string")), F.lit(""))


def prefix3(c: Column) -> Column:
    return F.substring(c, 1, 3)


def matcher_form(c: Column) -> Column:
    """Empty for null; a whole number without its fraction; else stripped."""
    x = to_number(c.cast("string"))
    text = strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(text)


def null_if_token(c: Column, tokens: list[str]) -> Column:
    """Null where the stripped, lower-case value is one of ``tokens``."""
    return F.when(~F.lower(strip(c)).isin(tokens), c)
