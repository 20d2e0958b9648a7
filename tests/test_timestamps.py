import datetime as dt
import zoneinfo

import pytest

from kinspark.functions.timestamps import listing_instants, with_utc_second


def _second(y, m, d, h=0, i=0, s=0, zone="UTC"):
    return int(dt.datetime(y, m, d, h, i, s, tzinfo=zoneinfo.ZoneInfo(zone)).timestamp())


NY = "America/New_York"
CASES = [
    ("2020-04-02T17:54:30-0600", NY, _second(2020, 4, 2, 23, 54, 30)),
    ("2020-04-27T22:46:07.581899+00:00", NY, _second(2020, 4, 27, 22, 46, 7)),
    ("2020-03-31T16:50:38Z", None, _second(2020, 3, 31, 16, 50, 38)),
    (" 2020-05-02T19:43 ", NY, _second(2020, 5, 2, 19, 43, zone=NY)),
    ("2020-04-06 09:16:49", NY, _second(2020, 4, 6, 9, 16, 49, NY)),
    ("2020-04-09 15:55:45 UTC", NY, _second(2020, 4, 9, 15, 55, 45)),
    ("2020-04-09 09:31:39 America/Chicago", NY, _second(2020, 4, 9, 9, 31, 39, "America/Chicago")),
    ("2020-04-10", NY, _second(2020, 4, 10, zone=NY)),
    ("2020/04/20", NY, _second(2020, 4, 20, zone=NY)),
    ("04/26/2020 12:07 PM", NY, _second(2020, 4, 26, 12, 7, zone=NY)),
    ("04/26/2020 12:07 AM", NY, _second(2020, 4, 26, 0, 7, zone=NY)),
    ("04/08/2020 10:58:57 PM MST", NY, _second(2020, 4, 9, 5, 58, 57)),
    ("4/24/20 07:15", NY, _second(2020, 4, 24, 7, 15, zone=NY)),
    ("02.04.2020 10:19", NY, _second(2020, 4, 2, 10, 19, zone=NY)),
    ("Sat, 04 Apr 2020 00:41:39 -0700", None, _second(2020, 4, 4, 7, 41, 39)),
    ("21 Apr 2020 16:49 EDT", None, _second(2020, 4, 21, 20, 49)),
    ("20200503T202902Z", None, _second(2020, 5, 3, 20, 29, 2)),
    ("November 1, 2020 07:53:52 PM", NY, _second(2020, 11, 1, 19, 53, 52, NY)),
    ("1587051701", None, 1587051701),
    ("1588059290198", None, 1588059290),
    ("2020-11-01 01:30:00", NY, _second(2020, 11, 1, 5, 30)),  # twice: the first
    ("2020-11-01 01:30:00 EST", NY, _second(2020, 11, 1, 6, 30)),  # an abbreviation tells
    ("2020-03-08 02:30:00", NY, None),  # inside the gap
    ("2020-02-29", NY, _second(2020, 2, 29, zone=NY)),
    ("2021-02-29", NY, None),
    ("13/01/2020", NY, None),
    ("04/26/2020 13:07 PM", NY, None),
    ("2020-04-10 24:00:00", NY, None),
    ("2020-04-10", None, None),
    ("2020-04-10 10:00 XYZ", NY, None),
    ("2020-04-10 10:00:00 Mars/Base", NY, None),
    ("2020-04-10", "Mars/Base", None),
    *[(v, NY, None) for v in ("", "yesterday", "week 14", "13:45", "31/02", "n/a", "--", "3 days ago", "x" * 5000, None)],
]


@pytest.fixture(scope="module")
def instants(spark):
    df = spark.createDataFrame([(i, v, z) for i, (v, z, _) in enumerate(CASES)], "i int, v string, z string")
    return {r["i"]: r["utc_second"] for r in with_utc_second(df, "v", "z").collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[repr(c[0])[:40] for c in CASES])
def test_value(instants, i):
    assert instants[i] == CASES[i][2]


def test_without_zone_column_values_are_utc(spark):
    df = spark.createDataFrame([("2020-04-10",)], "v string")
    assert with_utc_second(df, "v", None).first()["utc_second"] == _second(2020, 4, 10)


def test_listings_keep_rows_and_survive_clashing_names(spark, rows):
    listings = spark.createDataFrame([("a", "x", "2020-04-10", 7), ("b", None, "2020-04-10", 8), ("c", "nowhere", "2020-04-10Z", 9)], "rec_id string, location string, pubblication_date string, utc_second int")
    zones = spark.createDataFrame([("x", NY), ("x", "UTC"), (None, NY)], "location string, zone_name string")
    assert rows(listing_instants(listings, zones, ["rec_id"])) == [("a", _second(2020, 4, 10, zone=NY)), ("b", None), ("c", _second(2020, 4, 10))]
    assert listing_instants(listings.limit(0), zones, ["rec_id"]).count() == 0
    assert rows(listing_instants(listings, zones.limit(0), ["rec_id"]))[0] == ("a", None)
