import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from claimloom.operators.timestamps import _intervals_of, document_instants, parse_timestamps, resolve_local

UTC = dt.timezone.utc


def us(*parts, zone="UTC", micro=0):
    t = dt.datetime(*parts, tzinfo=ZoneInfo(zone))
    return int(t.timestamp()) * 1_000_000 + micro


CASES = [  # text, uploader, expected microseconds or None
    ("2023-01-02T03:04:05Z", "b", us(2023, 1, 2, 3, 4, 5)),
    ("2023-01-02t03:04:05.123456789z", "b", us(2023, 1, 2, 3, 4, 5, micro=123456)),
    ("  2023-01-02 03:04:05,5\n", "b", us(2023, 1, 2, 3, 4, 5, zone="Europe/Berlin", micro=500000)),
    ("2023-01-02", "b", us(2023, 1, 2, zone="Europe/Berlin")),
    ("2023/01/02 03:04:05", "n", us(2023, 1, 2, 3, 4, 5, zone="America/New_York")),
    ("2023-01-02T03:04+0545", "b", us(2023, 1, 2, 3, 4) - 345 * 60_000_000),
    ("2023-01-02T03:04-07", "b", us(2023, 1, 2, 3, 4) + 420 * 60_000_000),
    ("2023-01-02 03:04:05 PDT", "b", us(2023, 1, 2, 3, 4, 5) + 420 * 60_000_000),
    ("2023-12-02 03:04:05 CEST", "b", us(2023, 12, 2, 3, 4, 5) - 120 * 60_000_000),
    ("2023-01-02T03:04:05[Asia/Kolkata]", "b", us(2023, 1, 2, 3, 4, 5, zone="Asia/Kolkata")),
    ("2023-01-02 03:04:05 Australia/Sydney", None, us(2023, 1, 2, 3, 4, 5, zone="Australia/Sydney")),
    ("2019-07-12 06:52:17 America/Los_Angeles", None, us(2019, 7, 12, 6, 52, 17, zone="America/Los_Angeles")),
    ("July 16, 2021 1:13 p.m. America/New_York", "b", us(2021, 7, 16, 13, 13, zone="America/New_York")),
    ("July 16, 2021 1:13 AM (America/Los_Angeles)", "b", us(2021, 7, 16, 1, 13, zone="America/Los_Angeles")),
    ("July 16, 2021 12:13 AM (UTC)", "b", us(2021, 7, 16, 0, 13)),
    ("July 16, 2021 12:13 PM", "b", us(2021, 7, 16, 12, 13, zone="Europe/Berlin")),
    ("Mon, 23 May 2022 19:17:46 +1000", "b", us(2022, 5, 23, 9, 17, 46)),
    ("Thu, 26 Oct 2023 15:11:25 GMT", None, us(2023, 10, 26, 15, 11, 25)),
    ("22 Jun 2019 20:55 +02:00", "b", us(2019, 6, 22, 18, 55)),
    ("04-Feb-2021 22:56:38", "b", us(2021, 2, 4, 22, 56, 38, zone="Europe/Berlin")),
    ("28 May 2022", "n", us(2022, 5, 28, zone="America/New_York")),
    ("5/6/2022 10:00", "b", us(2022, 6, 5, 10, zone="Europe/Berlin")),
    ("5/6/2022 10:00", "n", us(2022, 5, 6, 10, zone="America/New_York")),
    ("13.5.2022 10:00 +00:00", "n", None),
    ("13.5.2022 10:00 +00:00", "nobody", us(2022, 5, 13, 10)),
    ("5.6.2022 10:00 +00:00", "nobody", None),
    ("1700000000", "b", 1700000000 * 1_000_000),
    ("1700000000.25", "b", 1700000000 * 1_000_000 + 250_000),
    ("1700000000123", "b", 1700000000123 * 1_000),
    ("1700000000123456", "b", 1700000000123456),
    ("1700000000123456789", "b", 1700000000123456),
    ("20230102", "b", us(2023, 1, 2, zone="Europe/Berlin")),
    ("20230102030405", "b", us(2023, 1, 2, 3, 4, 5, zone="Europe/Berlin")),
    ("20230102T030405Z", "b", us(2023, 1, 2, 3, 4, 5)),
    ("20230102T030405+0530", "b", us(2023, 1, 2, 3, 4, 5) - 330 * 60_000_000),
    ("2023-03-26 02:30:00", "b", None),  # skipped
    ("2023-10-29 02:30:00", "b", None),  # shown twice
    ("2023-10-29 02:30:00 +01:00", "b", us(2023, 10, 29, 1, 30)),
    ("2023-10-29 03:00:00", "b", us(2023, 10, 29, 2, 0)),
    ("2023-03-26 01:59:59", "b", us(2023, 3, 26, 0, 59, 59)),
    ("2023-03-26 03:00:00", "b", us(2023, 3, 26, 1, 0)),
    ("2023-01-02 03:04:05", None, None),
    ("2023-01-02 03:04:05", "nobody", None),
    ("2023-01-02 03:04:05 Foo/Bar", "b", None),
    *[(t, "b", None) for t in ("", " ", "2021", "2022-07", "12:45", "n/a", "TBD", "-", "null", "spring 2020", "2022-13-05", "2021-02-30T10:00:00Z", "2024-05-17T25:10:00Z", "0000-00-00 00:00:00", "2023-06-31 08:15", "x" * 100_000, "9" * 5000)],
    ("2024-02-29", "b", us(2024, 2, 29, zone="Europe/Berlin")),
    ("2023-02-29", "b", None),
    ("1900-02-29T00:00:00Z", "b", None),
    ("1969-07-20T20:17:40Z", "b", us(1969, 7, 20, 20, 17, 40)),
    ("2023-01-02T03:04:60Z", "b", None),
]


@pytest.fixture(scope="module")
def uploaders(spark):
    return spark.createDataFrame([("b", "Europe/Berlin", "DMY"), ("n", "America/New_York", "MDY"), (None, "UTC", "DMY")], "uploader string, zone_id string, date_order string")


def test_spellings(spark, uploaders):
    rows = [(f"d{i:03}", t, u, "extra") for i, (t, u, _) in enumerate(CASES)] + [("dnull", None, "b", ""), (None, "2023-01-02", "b", "")]
    docs = spark.createDataFrame(rows, "doc_id string, upload_date string, uploader string, zone_name string")
    docs = docs.unionByName(docs)  # delivered twice
    got = [tuple(r) for r in document_instants(docs, uploaders).collect()]
    assert len(got) == len(set(got))
    got = dict(got)
    want = {f"d{i:03}": w for i, (_, _, w) in enumerate(CASES) if w is not None}
    assert {k: (CASES[int(k[1:])], got.get(k)) for k in set(want) | set(got) if got.get(k) != want.get(k)} == {}


def test_every_hour_of_a_year_of_changes(spark):
    """Brute force: a local reading has as many instants as there are offsets that lead back to it."""
    zones = ("Europe/Berlin", "Australia/Lord_Howe", "America/Sao_Paulo", "Asia/Kathmandu")
    start = dt.datetime(2018, 1, 1)
    rows, want = [], {}
    for z in zones:
        tz = ZoneInfo(z)
        for i in range(0, 365 * 24 * 2, 7):
            local = start + dt.timedelta(minutes=30 * i + 15)
            found = set()
            for fold in (0, 1):
                t = local.replace(tzinfo=tz, fold=fold).astimezone(UTC)
                if t.astimezone(tz).replace(tzinfo=None) == local:
                    found.add(t)
            key = int(local.replace(tzinfo=UTC).timestamp()) * 1_000_000
            rows.append((z, key))
            want[z, key] = (len(found), int(found.pop().timestamp()) * 1_000_000 if len(found) == 1 else None)
    got = resolve_local(spark.createDataFrame(rows, "zone_name string, local_us long")).collect()
    assert {(r["zone_name"], r["local_us"]): (r["matches"], r["resolved_us"]) for r in got} == want


def readings(tz, local):
    """Instants of a local reading: those of the offsets in force within two days that lead back to it."""
    near = local.replace(tzinfo=UTC)
    offsets = {(near + dt.timedelta(hours=h)).astimezone(tz).utcoffset() for h in range(-48, 49)}
    return {t for o in offsets if (t := near - o).astimezone(tz).replace(tzinfo=None) == local}


def test_changes_that_are_soon_undone(spark):
    """Every zone, every pair of changes less than 8 days apart: readings before, between, after and at both changes."""
    from zoneinfo import available_timezones

    rows, want = [], {}
    for z in sorted(available_timezones()):
        spans = _intervals_of(z)
        tz = ZoneInfo(z)
        for (_, b, _), (_, c, _) in zip(spans, spans[1:], strict=False):
            if c - b >= 8 * 86_400:
                continue
            for t in (b - 90_000, b - 1800, b + 1800, (b + c) // 2, c - 1800, c + 1800, c + 90_000):
                local = dt.datetime.fromtimestamp(t, tz).replace(tzinfo=None)
                for moved in (0, 1800, -1800, 3600, -3600):
                    x = (local + dt.timedelta(seconds=moved)).replace(microsecond=0, fold=0)
                    found = readings(tz, x)
                    key = int(x.replace(tzinfo=UTC).timestamp()) * 1_000_000
                    rows.append((z, key))
                    want[z, key] = (len(found), int(found.pop().timestamp()) * 1_000_000 if len(found) == 1 else None)
    assert {"America/Recife", "America/Noronha", "Asia/Gaza", "Asia/Hebron", "Africa/Freetown"} <= {z for z, _ in rows}
    got = resolve_local(spark.createDataFrame(list(set(rows)), "zone_name string, local_us long")).collect()
    assert {(r["zone_name"], r["local_us"]): (r["matches"], r["resolved_us"]) for r in got} == want


def test_offsets_of_every_zone_hour_by_hour():
    """The intervals against zoneinfo, at every hour of years in which some zone has changes that are soon undone."""
    for z, years in {"America/Recife": (2000,), "America/Boa_Vista": (2000,), "Asia/Gaza": (2040, 2054, 2072, 2090), "Africa/Freetown": (1939,), "Europe/Berlin": (2023, 2149), "Africa/Casablanca": (2030,), "UTC": (2020,)}.items():
        tz, spans = ZoneInfo(z), _intervals_of(z)
        for year in years:
            t, at = int(dt.datetime(year, 1, 1, tzinfo=UTC).timestamp()), 0
            for s in range(t, t + 366 * 86_400, 3600):
                while spans[at][1] <= s:
                    at += 1
                assert dt.datetime.fromtimestamp(s, tz).utcoffset().total_seconds() == spans[at][2], (z, s)


def test_empty_tables_and_clashing_columns(spark, uploaders):
    none = spark.createDataFrame([], "doc_id string, upload_date string, uploader string")
    assert document_instants(none, uploaders).collect() == []
    assert document_instants(spark.createDataFrame([("d", "2023-01-02", "b")], none.schema), uploaders.where("false")).collect() == []
    clash = spark.createDataFrame([("2023-01-02T00:00:00Z", 5, "z", 1)], "s string, instant_us int, zone_name string, y int")
    row = parse_timestamps(clash, "s").collect()[0]
    assert row["instant_us"] == us(2023, 1, 2) and row["y"] == 1 and row["zone_name"] is None
