from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from tidemill.operators import timestamps as T

UTC = timezone.utc
COLLECTED = datetime(2025, 6, 1, 12, 0, tzinfo=UTC)


def us(d: datetime) -> int:
    return (d - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def one(value, zone=None, minutes=480, collected=COLLECTED, yearless=False):
    c = T.NAT if collected is None else us(collected)
    got = T.convert([value], [zone], [minutes], np.array([c], np.int64), np.array([yearless]))[0]
    return None if got == T.NAT else datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=int(got))


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("2025-05-31T20:10:13Z", datetime(2025, 5, 31, 20, 10, 13, tzinfo=UTC)),
        ("2025-05-31T20:10:13.123456789Z", datetime(2025, 5, 31, 20, 10, 13, 123456, tzinfo=UTC)),
        ("2025-05-31T20:10:13,5Z", datetime(2025, 5, 31, 20, 10, 13, 500000, tzinfo=UTC)),
        ("20250504T082303Z", datetime(2025, 5, 4, 8, 23, 3, tzinfo=UTC)),
        ("2025年5月14日 23:48", datetime(2025, 5, 14, 15, 48, tzinfo=UTC)),
        ("２０２５-０６-０２ ０９：２２", datetime(2025, 6, 2, 1, 22, tzinfo=UTC)),
        ("25/06/02 04:14", datetime(2025, 6, 1, 20, 14, tzinfo=UTC)),
        ("2025年5月25日 下午3:42", datetime(2025, 5, 25, 7, 42, tzinfo=UTC)),
        ("2025年5月25日 上午12:42", datetime(2025, 5, 24, 16, 42, tzinfo=UTC)),
        ("发布于 2025-05-31 02:30", datetime(2025, 5, 30, 18, 30, tzinfo=UTC)),
        ("Thu, 05 Jun 2025 21:23:42 +1000", datetime(2025, 6, 5, 11, 23, 42, tzinfo=UTC)),
        ("Apr 16, 2025, 4:59 PM UTC", datetime(2025, 4, 16, 16, 59, tzinfo=UTC)),
        ("2025-05-11T12:18:38[Asia/Tokyo]", datetime(2025, 5, 11, 3, 18, 38, tzinfo=UTC)),
        ("2025-05-19 09:10:03 PST", datetime(2025, 5, 19, 17, 10, 3, tzinfo=UTC)),
        ("1747298874", datetime(2025, 5, 15, 8, 47, 54, tzinfo=UTC)),
        ("1740545948222", datetime(2025, 2, 26, 4, 59, 8, 222000, tzinfo=UTC)),
        ("27分钟前", COLLECTED - timedelta(minutes=27)),
        ("昨天 10:15", datetime(2025, 5, 31, 2, 15, tzinfo=UTC)),
        ("2025/6/1", datetime(2025, 5, 31, 16, 0, tzinfo=UTC)),
    ],
)
def test_forms(value, expected):
    assert one(value) == expected


@pytest.mark.parametrize("value", [None, "", " ", "N/A", "null", "-", "未知", "2025-02-30 10:00:00", "2024-13-05 08:00", "0000-00-00 00:00:00", "1970-01-01 00:00:00", "03-13 09:09", "8-27", "x" * 5000])
def test_no_instant(value):
    assert one(value) is None


def test_yearless_only_where_allowed():
    assert one("03-13 09:09", yearless=True) == datetime(2025, 3, 13, 1, 9, tzinfo=UTC)
    assert one("12-31 09:09", yearless=True) == datetime(2024, 12, 31, 1, 9, tzinfo=UTC)
    assert one("06-03 19:59", yearless=True) == datetime(2025, 6, 3, 11, 59, tzinfo=UTC)
    assert one("06-03 20:01", yearless=True) == datetime(2024, 6, 3, 12, 1, tzinfo=UTC)
    assert one("06-03", yearless=True) is None
    assert one("06-03 10:00", yearless=True, collected=None) is None


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Australia/Sydney", "Asia/Kolkata", "Asia/Shanghai"])
def test_zone_tables_agree_with_the_database(zone):
    z = ZoneInfo(zone)
    for day in range(0, 366, 3):
        for hour in (0, 1, 2, 3, 12):
            wall = datetime(2025, 1, 1) + timedelta(days=day, hours=hour, minutes=30)
            assert one(wall.strftime("%Y-%m-%d %H:%M"), zone=zone) == wall.replace(tzinfo=z, fold=0).astimezone(UTC)


def test_repeated_and_missing_wall_times():
    assert one("2025-11-02 01:30", zone="America/New_York") == datetime(2025, 11, 2, 5, 30, tzinfo=UTC)  # the earlier one
    assert one("2025-03-09 02:30", zone="America/New_York") == datetime(2025, 3, 9, 7, 30, tzinfo=UTC)  # moved forward


def test_operator_on_odd_tables(spark):
    schema = "seq long, source string, publishedAt string, collectedAt string, sourceMetadata map<string,string>, utc_us string, v string"
    rows = [(1, "wechat", "2025-01-01 08:00", "2025-06-01T00:00:00Z", {"clockZone": None}, "x", "y"), (1, "wechat", "2025-01-01 08:00", None, None, None, None),
            (2, None, "2025-01-01 08:00", "bad", {}, None, None), (None, None, None, None, None, None, None)]
    got = T.document_instants(spark.createDataFrame(rows, schema)).collect()
    midnight = us(datetime(2025, 1, 1, tzinfo=UTC))
    assert sorted((r.seq, r.utc_us) for r in got) == [(1, midnight), (1, midnight), (2, midnight + 8 * 3600 * 10**6)]
    assert T.document_instants(spark.createDataFrame([], schema)).count() == 0
