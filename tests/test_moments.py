"""Problem 2."""

import pytest

from engramma.operators.moments import normalise_moments

CASES = [
    ("2022/05/11 (Mon) 01:44", "Europe/Berlin", "2022-05-10T23:44:00Z"),
    ("2023-10-29T02:30", "Europe/Berlin", "2023-10-29T00:30:00Z"),  # occurs twice: the earlier instant
    ("2024-03-31T02:30", "Europe/Berlin", "2024-03-31T01:30:00Z"),  # skipped: not yet changed
    ("2:34 am on 30 March, 2025", "Europe/Berlin", "2025-03-30T01:34:00Z"),
    ("2021-12-27T06:49:32-08:00[America/Los_Angeles]", None, "2021-12-27T14:49:32Z"),
    ("2023-10-01 23:50 America/Chicago", "UTC", "2023-10-02T04:50:00Z"),
    ("2022-06-06 01:13 CET", "America/New_York", "2022-06-06T00:13:00Z"),
    ("1672551598", "Asia/Tokyo", "2023-01-01T05:39:58Z"),
    ("1682366543378", None, "2023-04-24T20:02:23Z"),
    ("08/06/2023 (Thu) 00:08", None, "2023-06-08T00:08:00Z"),
    ("08/06/2023 (Sun) 00:08", None, "2023-08-06T00:08:00Z"),
    ("05/21/2022 10:56 AM", None, "2022-05-21T10:56:00Z"),
    ("28/06/2022 01:03", None, "2022-06-28T01:03:00Z"),
    ("20220730T130007.437Z", None, "2022-07-30T13:00:07Z"),
    ("Thu, 12 Jan 2023 16:42:53 +0545", None, "2023-01-12T10:57:53Z"),
    ("Sunday, 20 November 2022 at 3.45pm", None, "2022-11-20T15:45:00Z"),
    ("20 Jul 2023, 15h34", None, "2023-07-20T15:34:00Z"),
    ("26.3.2023, 03:35 Uhr", None, "2023-03-26T03:35:00Z"),
    ("2023年6月20日 21:42", None, "2023-06-20T21:42:00Z"),
    ("12:03 pm on 12 December, 2023 (UTC+12:45)", None, "2023-12-11T23:18:00Z"),
    ("December 17th, 2022", "Asia/Tokyo", "2022-12-17"),
    ("Nov. 2022", None, "2022-11"),
    ("2022/06", None, "2022-06"),
    ("2022", None, "2022"),
    ("02.11.2022", None, "2022-11-02"),
]
NONE = ["", "  ", None, "TBD", "last spring", "week 83", "2023-02-30", "46.05.2024", "25:61 on 3 May, 2023", "2024-13-23T10:00", "D4:12", "2023-05-12 37:10", "13:05 pm on 3 May, 2023", "08/06/2023 00:08", "x" * 200_000]


def values(spark, rows):
    return spark.createDataFrame([("f", str(i), "", f"s{i}", v, "clash") for i, (v, *_) in enumerate(rows)], "field string, rec_id string, item_key string, source_id string, value string, home_tz string")


def test_cases(spark):
    zones = spark.createDataFrame([(f"s{i}", tz) for i, (_, tz, _) in enumerate(CASES)], "source_id string, home_tz string")
    got = {r["rec_id"]: r["norm_value"] for r in normalise_moments(values(spark, CASES).drop("home_tz"), zones).collect()}
    assert {v: got.get(str(i)) for i, (v, *_) in enumerate(CASES)} == {v: want for v, _, want in CASES}


def test_no_cases(spark):
    assert normalise_moments(values(spark, [(v,) for v in NONE])).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata"])
def test_the_session_zone_does_not_matter(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = normalise_moments(values(spark, [("2023-01-01 12:00 JST",), ("1672551598",)])).collect()
        assert {r["norm_value"] for r in rows} == {"2023-01-01T03:00:00Z", "2023-01-01T05:39:58Z"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_repeats_and_empty(spark):
    v = values(spark, [("2022",)])
    assert normalise_moments(v.unionByName(v)).count() == 1
    assert normalise_moments(v.limit(0)).count() == 0
