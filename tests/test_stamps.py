from datetime import UTC, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from granary.functions.timestamps import read_stamp
from granary.operators.stamps import found_moments
from tests.conftest import rows


def ms(*parts, zone=UTC, micro=0):
    return (datetime(*parts, micro, tzinfo=zone) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)


NEW_YORK, BERLIN = ZoneInfo("America/New_York"), ZoneInfo("Europe/Berlin")
CASES = [
    ("2015-01-15T14:23:10.456789Z", "UTC", "DMY", ms(2015, 1, 15, 14, 23, 10, micro=456789)),
    (" 2010-06-15 03:10:00  ", "America/New_York", "MDY", ms(2010, 6, 15, 3, 10, 0, zone=NEW_YORK)),
    ("9/6/2016 4:13:00 PM", "America/New_York", "MDY", ms(2016, 9, 6, 16, 13, 0, zone=NEW_YORK)),
    ("9/6/2016 16:13", "Europe/Berlin", "DMY", ms(2016, 6, 9, 16, 13, 0, zone=BERLIN)),
    ("01-Nov-2012 04:03:48 CEST", "UTC", "DMY", ms(2012, 11, 1, 2, 3, 48)),
    ("Wed, 07 May 2008 09:39:05 +0900", "UTC", "DMY", ms(2008, 5, 7, 0, 39, 5)),
    ("Sun, 7 November 2010, 19:42", "UTC", "MDY", ms(2010, 11, 7, 19, 42, 0)),
    ("Oct 27, 2013 12:05 AM", "UTC", "MDY", ms(2013, 10, 27, 0, 5, 0)),
    ("20170412T002502Z", "UTC", "DMY", ms(2017, 4, 12, 0, 25, 2)),
    ("2011-11-06T01:00:05+00:00[UTC]", "UTC", "DMY", ms(2011, 11, 6, 1, 0, 5)),
    ("20230422", "Europe/Berlin", "DMY", ms(2023, 4, 22, 0, 0, 0, zone=BERLIN)),
    ("1541549142", "UTC", "DMY", 1541549142000),
    # occurs twice: the first, in summer time
    ("2013-11-03 01:30:00", "America/New_York", "MDY", ms(2013, 11, 3, 1, 30, 0, zone=timezone(timedelta(hours=-4)))),
    # skipped: read with the offset before the jump
    ("2013-03-10 02:30:00", "America/New_York", "MDY", ms(2013, 3, 10, 2, 30, 0, zone=timezone(timedelta(hours=-5)))),
    ("31.11.2015", "UTC", "DMY", None),
    ("2013-02-30", "UTC", "DMY", None),
    ("2013-02-03 25:00:00", "UTC", "DMY", None),
    ("13/13/2013", "UTC", "DMY", None),
    ("13:00 PM", "UTC", "DMY", None),
    ("2/3/2013 13:00 PM", "UTC", "DMY", None),
    ("13/2/2013", "UTC", None, ms(2013, 2, 13, 0, 0, 0)),
    ("3/2/2013", "UTC", None, None),
    ("2013-01-01 00:00:00 XYZ", "UTC", "DMY", None),
    ("yesterday", "UTC", "DMY", None),
    ("", "UTC", "DMY", None),
    (None, "UTC", "DMY", None),
]


def test_cascade(spark):
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(CASES)], "k int, stamp string, zone string, o string")
    got = {r["k"]: r["ms"] for r in df.select("k", read_stamp(F.col("stamp"), F.col("zone"), F.col("o")).alias("ms")).collect()}
    assert [(c[0], got[k]) for k, c in enumerate(CASES)] == [(c[0], c[3]) for c in CASES]


def test_session_zone_plays_no_part(spark):
    df = spark.createDataFrame([("2013-11-03 01:30:00",)], "stamp string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert df.select(read_stamp(F.col("stamp"), F.lit("UTC"), F.lit("DMY"))).first()[0] == ms(2013, 11, 3, 1, 30, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_found(spark):
    schema = "id string, source string, date_published string, date_modified string, ts_millis long, field string"
    data = [
        ("a", " S.Example ", "3/2/2013", None, 1566569201220, "x"),
        ("a", " S.Example ", "3/2/2013", None, 1566569201220, "x"),
        ("b", None, "2013-01-01 00:00:00", "unknown", -1, None),
        ("", None, "2013-01-01", None, 0, None),
        (None, None, "2013-01-01", None, None, None),
        ("c", "nobody", "1960-01-01", "2031-01-01", 1263028260462158, None),
    ]
    registry = spark.createDataFrame([("s.example", 1, "Europe/Berlin", "DMY"), (None, 2, "UTC", "MDY")], "source string, trust int, time_zone string, date_order string")
    df = spark.createDataFrame(data, schema)
    assert rows(found_moments(df, registry)) == [
        ("a", "date_published", ms(2013, 2, 3, 0, 0, 0, zone=BERLIN)), ("a", "ts_millis", 1566569201220),
        ("b", "date_published", ms(2013, 1, 1, 0, 0, 0)), ("c", "ts_millis", 1263028260462),
    ]
    assert found_moments(df.limit(0), registry.limit(0)).count() == 0
