"""Vehicle identification numbers as column expressions (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the check digit: letters, their numbers, and the weight of each position.
LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
NUMBERS = "12345678123457923456789"
WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
#: Sequences that only placeholders contain (fixed values).
PLACEHOLDERS = ["12345678", "ABCDEFGH"]


def normalized(vin: Column) -> Column:
    """Upper case, without anything but letters and digits."""
    return F.regexp_replace(F.upper(vin), "[^A-Z0-9]", "")


def is_legal(vin: Column) -> Column:
    """17 characters of the VIN alphabet (no I, O or Q)."""
    return vin.rlike("^[A-HJ-NPR-Z0-9]{17}$")


def is_placeholder(vin: Column) -> Column:
    """One character repeated, or a run of the alphabet or of the digits."""
    repeated = (F.length(vin) == 17) & (F.repeat(F.substring(vin, 1, 1), F.lit(17)) == vin)
    return repeated | F.greatest(*[vin.contains(p) for p in PLACEHOLDERS])


def check_digit_ok(vin: Column) -> Column:
    """Whether position 9 is the weighted sum of the others modulo 11; false for illegal numbers and null."""
    digits = F.translate(vin, LETTERS, NUMBERS)
    total = sum((F.substring(digits, i + 1, 1).try_cast("int") * w for i, w in enumerate(WEIGHTS) if w), F.lit(0)) % 11
    expected = F.when(total == 10, F.lit("X")).otherwise(total.cast("string"))
    return F.coalesce(is_legal(vin) & (F.substring(vin, 9, 1) == expected), F.lit(False))


def usable(vin: Column) -> Column:
    """The normalised number if it is legal, no placeholder and has a right check digit, else null."""
    v = normalized(vin)
    return F.when(check_digit_ok(v) & ~is_placeholder(v), v)
