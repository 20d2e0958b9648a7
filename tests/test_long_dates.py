"""Readable dates stay readable however many blanks stand around or in them."""

from kinspark.functions.timestamps import with_utc_second


def test_dates_padded_past_80_characters(spark):
    gap = " " * 5000
    values = ["2024-05-06 07:08:09", gap + "2024-05-06 07:08:09" + gap, "2024-05-06" + "\t " * 60 + "07:08:09", "2024-05-06 07:08:09" + gap + "UTC", "x" * 5000, gap + "2024-05-06 07:08:09 x" + gap, None, gap]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.utc_second for r in with_utc_second(df, "v", None).collect()}
    assert got == {i: 1714979289 if i < 4 else None for i in range(8)}
