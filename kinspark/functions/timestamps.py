"""Problem 6: mixed timestamp formats and zones to one instant, JVM-side.

All formats are one regular expression with named groups. It runs once per value:
``regexp_replace`` with the groups as replacement yields every component in fixed
positions, ``split`` reads them. Calendar ranges are then checked and the instant is put
together by integer day arithmetic; only local times need the zone rules, which are the
JVM's own (``to_utc_timestamp``).

Results for the edge cases: null, blank, vague or impossible values give null; so does a
local time inside a spring gap; a local time that occurs twice is its first occurrence; a
value without zone and without a known local zone gives null; fractions are cut off.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names and North American zone abbreviations with their hours from UTC.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ABBREVIATIONS = {
    "z": 0.0, "ut": 0.0, "utc": 0.0, "gmt": 0.0, "nst": -3.5, "ndt": -2.5, "ast": -4.0, "adt": -3.0, "est": -5.0, "edt": -4.0,
    "cst": -6.0, "cdt": -5.0, "mst": -7.0, "mdt": -6.0, "pst": -8.0, "pdt": -7.0, "akst": -9.0, "akdt": -8.0, "hst": -10.0, "hdt": -9.0,
}

_MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_DAY = "mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:rs(?:day)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
_DATES = [
    r"(?<y1>\d{4})(?<p1>[-/.])(?<m1>\d{1,2})\k<p1>(?<d1>\d{1,2})",
    r"(?<m2>\d{1,2})/(?<d2>\d{1,2})/(?<y2>\d{4}|\d{2})",
    r"(?<d3>\d{1,2})\.(?<m3>\d{1,2})\.(?<y3>\d{4}|\d{2})",
    rf"(?:(?:{_DAY})\.?,?\s+)?(?<d4>\d{{1,2}})[\s-]+(?<n4>{_MONTH})\.?,?[\s-]+(?<y4>\d{{4}}|\d{{2}})",
    rf"(?:(?:{_DAY})\.?,?\s+)?(?<n5>{_MONTH})\.?\s+(?<d5>\d{{1,2}}),?\s+(?<y5>\d{{4}})",
]
_ZONE = r"(?:z|[a-z]{2,4}|[+-]\d{2}(?::?\d{2})?|[a-z]+(?:/[a-z_+-]+){1,2})"
PATTERN = (
    r"(?is)^\s*(?:(?<e>\d{9,14})"
    rf"|(?<y6>\d{{4}})(?<m6>\d{{2}})(?<d6>\d{{2}})t(?<h6>\d{{2}})(?<i6>\d{{2}})(?<s6>\d{{2}})?(?:[.,]\d+)?\s*(?<z6>{_ZONE})?"
    rf"|(?:{'|'.join(_DATES)})"
    r"(?:(?:t|,?\s+)(?<h>\d{1,2}):(?<i>\d{2})(?::(?<s>\d{2})(?:[.,]\d{1,9})?)?(?:\s*(?<a>[ap])\.?m\.?(?![a-z]))?)?"
    rf"\s*(?<z>{_ZONE})?)\s*$"
)
#: One position per component; at most one of the groups in a position takes part in a match.
_PARTS = ["${e}", "${y1}${y2}${y3}${y4}${y5}${y6}", "${m1}${m2}${m3}${m6}", "${n4}${n5}", "${d1}${d2}${d3}${d4}${d5}${d6}", "${h}${h6}", "${i}${i6}", "${s}${s6}", "${a}", "${z}${z6}"]
REPLACEMENT = "\u0001" + "\u0001".join(_PARTS)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, integers only (years from 0 on)."""
    early = F.when(m <= 2, 1).otherwise(0)
    yy = y - early
    mp = m + F.when(m > 2, -3).otherwise(9)
    whole = lambda a, b: (a - a % b) / F.lit(b)  # noqa: E731  exact: a multiple of b, far below 2**53
    days = yy * 365 + whole(yy, 4) - whole(yy, 100) + whole(yy, 400) + whole(mp * 153 + 2, 5)
    return days.cast("bigint") + d - 1 - 719468


def _days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def with_utc_second(df: DataFrame, value: str, local_zone: str | None, out: str = "utc_second") -> DataFrame:
    """``df`` with ``out``: the second since 1970-01-01 UTC that the text in ``value`` denotes, or null.

    ``local_zone`` is the column with the zone of values that have none themselves; an
    unknown zone name counts as null. With ``local_zone=None`` such values are read as UTC.
    The steps are projections of their own, so that each component is computed once.
    """
    known = sorted(zoneinfo.available_timezones())
    keep = [F.col(f"`{c}`") for c in df.columns if c != out]
    given = F.col(f"`{value}`")
    # Runs of blanks in long values become one blank, so that the pattern never tries their divisions; no length is refused.
    given = F.when(F.length(given) <= 80, given).otherwise(F.regexp_replace(given, r"\s+", " "))
    raw = F.split(F.regexp_replace(given, F.lit(PATTERN), F.lit(REPLACEMENT)), "\u0001")
    zone_in = F.lit("UTC") if local_zone is None else F.col(f"`{local_zone}`")
    df = df.select(*keep, raw.alias("_p"), zone_in.alias("_lz"))
    text = lambda k: F.get("_p", F.lit(k + 1))
    num = lambda k: text(k).try_cast("bigint")  # noqa: E731  empty and missing give null
    name = F.substring(F.lower(text(3)), 1, 3)
    month = F.coalesce(num(2), F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), name), F.lit(0)))
    df = df.select(
        *keep, "_lz", num(0).alias("_e"), F.length(text(0)).alias("_digits"), F.when(F.length(text(1)) == 2, num(1) + 2000).otherwise(num(1)).alias("_y"),
        month.alias("_m"), num(4).alias("_d"), num(5).alias("_h"), num(6).alias("_i"), F.coalesce(num(7), F.lit(0)).alias("_s"), F.lower(text(8)).alias("_a"), text(9).alias("_zt"), F.lower(text(9)).alias("_z"),
    )
    c = F.col
    hour = F.when(c("_a") == "", c("_h")).when(c("_h").between(1, 12), c("_h") % 12 + F.when(c("_a") == "p", 12).otherwise(0))
    clock = F.when(c("_h").isNull(), 0).when(hour.between(0, 23) & c("_i").between(0, 59) & c("_s").between(0, 59), hour * 3600 + c("_i") * 60 + c("_s"))
    valid = c("_y").between(1, 9999) & c("_m").between(1, 12) & (c("_d") >= 1) & (c("_d") <= _days_in_month(c("_y"), c("_m")))
    digits = F.regexp_replace("_z", "[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    signed = F.when((hours <= 15) & (minutes <= 59), F.when(c("_z").startswith("-"), -1).otherwise(1) * (hours * 3600 + minutes * 60))
    table = F.create_map(*[F.lit(x) for a, h in ABBREVIATIONS.items() for x in (a, int(h * 3600))])
    offset = F.when(c("_z").rlike("^[+-]"), signed).when(~c("_z").contains("/"), F.try_element_at(table, c("_z")))
    where = F.when(c("_z") == "", c("_lz")).when(c("_z").contains("/"), c("_zt"))
    df = df.select(*keep, "_e", "_digits", F.when(valid, days_from_civil(c("_y"), c("_m"), c("_d")) * 86400 + clock).alias("_local"), offset.alias("_off"), F.when(where.isin(known), where).alias("_where"))
    at = F.timestamp_seconds("_local")
    df = df.select(*keep, "_e", "_digits", "_local", "_off", "_where", F.when(c("_where").isNotNull(), F.to_utc_timestamp(at, c("_where"))).alias("_utc"))
    by_zone = F.when(F.from_utc_timestamp("_utc", c("_where")) == at, F.unix_seconds("_utc"))
    epoch = F.when(c("_digits") >= 12, ((c("_e") - c("_e") % 1000) / F.lit(1000)).cast("bigint")).otherwise(c("_e"))
    return df.select(*keep, F.coalesce(epoch, c("_local") - c("_off"), by_zone).cast("bigint").alias(out))


def listing_instants(listings: DataFrame, zones: DataFrame, carry: list[str]) -> DataFrame:
    """Problem 6 over listings: ``carry`` columns and ``utc_second`` of each listing's date.

    ``zones`` (location, zone_name) is a fixed list of places; a place listed twice takes
    the smallest zone name. The join is left to the planner, which broadcasts by size.
    """
    z = zones.where(F.col("location").isNotNull()).groupBy("location").agg(F.min("zone_name").alias("_zone"))
    return with_utc_second(listings.join(z, "location", "left"), "pubblication_date", "_zone").select(*carry, "utc_second")
