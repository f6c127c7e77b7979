"""Timestamps of mixed spelling, precision and zone, brought to one UTC instant.

Parsing is one regular expression per family of spellings, evaluated once per value in the JVM. Values
with their own offset are resolved by arithmetic. Local times are resolved by an as-of join to the
zone's offset intervals, exploded to one row per zone and year: no interval holds a local time that the
clock skips, two hold one that it shows twice, and one interval gives the offset.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Minutes east of UTC that zone abbreviations usually mean.
ABBREVIATION_MINUTES = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "NPT": 345, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "HST": -600, "AKST": -540,
    "AKDT": -480, "PST": -480, "PDT": -420, "MST": -420, "MDT": -360, "CST": -360, "CDT": -300, "EST": -300,
    "EDT": -240, "AST": -240, "ADT": -180,
}
# English month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

FIRST_YEAR, LAST_YEAR = 1850, 2150

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\b\.?)?"
_ZONE = r"([+-]\d{2}(?::?\d{2})?|[A-Za-z][A-Za-z0-9_+-]*(?:/[A-Za-z0-9_+-]+)*)"
_TAIL = rf"(?:\s*{_ZONE})?(?:\s*[\[(]\s*{_ZONE}\s*[\])])?"
_DAYNAME = r"(?:(?:[Mm]on|[Tt]ue|[Ww]ed|[Tt]hu|[Ff]ri|[Ss]at|[Ss]un)[a-z]*\.?,?\s+)?"
#: (spelling, order of the first three groups); the groups after them are hour, minute, second, fraction, a/p, zone, bracketed zone.
_FAMILIES = (
    (rf"(?s)^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:(?:[Tt]\s*|,?\s+){_TIME}{_TAIL})?$", "ymd"),
    (r"(?s)^(\d{4})(\d{2})(\d{2})(?:[Tt]?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?(N)?" + _TAIL + ")?$", "ymd"),
    (rf"(?s)^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(?:(?:[Tt]\s*|,?\s+){_TIME}{_TAIL})?$", "local"),
    (rf"(?s)^{_DAYNAME}(\d{{1,2}})(?:st|nd|rd|th)?[-\s]\s*([A-Za-z]{{3,9}})\.?,?[-\s]\s*(\d{{4}})(?:,?\s+{_TIME}{_TAIL})?$", "dny"),
    (rf"(?s)^{_DAYNAME}([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}{_TAIL})?$", "ndy"),
)
_SEP = "\u0001"


def _month_of(name: Column) -> Column:
    """Number of a month name or its first three (or, for September, four) letters."""
    low = F.lower(name)
    out = F.lit(None).cast("int")
    for i, full in enumerate(MONTHS, 1):
        short = [full, full[:3]] + (["sept"] if full == "september" else [])
        out = F.when(low.isin(*short), F.lit(i)).otherwise(out)
    return out


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, null if there is no such date."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= length)
    # years counted from March, so that the leap day is the last of its year
    shifted = F.when(m <= 2, y - 1).otherwise(y)
    moved = F.when(m <= 2, m + 9).otherwise(m - 3)
    fl = lambda a, b: F.floor(a / F.lit(b)).cast("long")
    day_of_year = fl(moved * 153 + 2, 5) + d - 1
    total = shifted * 365 + fl(shifted, 4) - fl(shifted, 100) + fl(shifted, 400) + day_of_year - 719468
    return F.when(ok, total.cast("long"))


def parse_timestamps(df: DataFrame, text: str, date_order: str | None = None) -> DataFrame:
    """Adds ``local_us``, ``offset_min``, ``zone_name`` and ``instant_us`` to each row.

    - ``instant_us``: set for counts since 1970 and for values with an offset or a known abbreviation.
    - ``local_us`` with ``zone_name`` not null: the clock reading in the zone that the text names.
    - ``local_us`` with ``zone_name`` and ``instant_us`` null: a reading without zone.
    - all null: no time (null, blank, no day, impossible date or hour, or other text).

    ``date_order`` names a column with DMY or MDY for all-digit dates that do not begin with the year; where
    it is null or absent, such a date is read only if both orders agree or just one is possible.
    Columns of these names that ``df`` already has are replaced; internal names begin with ``_ts_``.
    """
    s = F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", "")
    out = df.withColumn("_ts_s", s)
    fields = F.lit(None).cast("array<string>")
    for pattern, kind in reversed(_FAMILIES):
        canon = kind + "".join(f"{_SEP}${i}" for i in range(1, 11))
        fields = F.when(F.col("_ts_s").rlike(pattern), F.split(F.regexp_replace(F.col("_ts_s"), pattern, canon), _SEP)).otherwise(fields)
    digits = F.col("_ts_s").rlike(r"^\d+$")
    out = out.withColumn("_ts_f", F.when(digits & ~F.length("_ts_s").isin(8, 12, 14), None).otherwise(fields))
    g = lambda i: F.get(F.col("_ts_f"), F.lit(i))
    n = lambda c: c.try_cast("long")
    c = lambda name: F.col(f"_ts_{name}")
    # staged, so that each step is computed once and not inlined into all that use it
    out = out.select(
        "*",
        g(0).alias("_ts_kind"),
        F.when(g(0) == "ymd", n(g(1))).otherwise(n(g(3))).alias("_ts_y"),
        F.when(g(0) == "ymd", n(g(2))).when(g(0) == "dny", _month_of(g(2)).cast("long")).when(g(0) == "ndy", _month_of(g(1)).cast("long")).otherwise(n(g(1))).alias("_ts_a"),
        F.when(g(0) == "ymd", n(g(3))).when(g(0) == "dny", n(g(1))).otherwise(n(g(2))).alias("_ts_b"),
        (g(4) != "").alias("_ts_timed"),
        n(g(4)).alias("_ts_h"),
        n(g(5)).alias("_ts_mi"),
        F.coalesce(n(g(6)), F.lit(0)).alias("_ts_sec"),
        F.when(g(7) == "", 0).otherwise(n(F.rpad(F.substring(g(7), 1, 6), 6, "0"))).alias("_ts_frac"),
        F.lower(g(8)).alias("_ts_half"),
        # an offset or name right after the time comes before one in brackets
        F.when(g(9) != "", g(9)).when(g(10) != "", g(10)).alias("_ts_zone"),
    ).drop("_ts_f")
    # _ts_a, _ts_b: month and day, but for all-digit dates that end with the year the first and second number
    order = F.upper(F.col(date_order)) if date_order else F.lit(None).cast("string")
    out = out.select(
        "*",
        _days(c("y"), c("a"), c("b")).alias("_ts_md"),
        F.when(c("kind") == "local", _days(c("y"), c("b"), c("a"))).alias("_ts_dm"),
        order.alias("_ts_order"),
        F.when(c("half").isin("a", "p"), F.when((c("h") >= 1) & (c("h") <= 12), c("h") % 12 + F.when(c("half") == "p", 12).otherwise(0)))
        .otherwise(F.when(c("h") <= 23, c("h")))
        .alias("_ts_hour"),
        c("zone").rlike(r"^[+-]").alias("_ts_signed"),
        n(F.regexp_extract(c("zone"), r"^[+-](\d{2})", 1)).alias("_ts_oh"),
        F.coalesce(n(F.regexp_extract(c("zone"), r"^[+-]\d{2}:?(\d{2})$", 1)), F.lit(0)).alias("_ts_om"),
        F.when(digits, n(c("s"))).alias("_ts_count"),
        F.length("_ts_s").alias("_ts_size"),
        F.regexp_extract("_ts_s", r"^(\d{10})\.\d+$", 1).alias("_ts_whole"),
        F.regexp_extract("_ts_s", r"^\d{10}\.(\d+)$", 1).alias("_ts_part"),
    )
    either = F.when(c("dm").isNull(), c("md")).when(c("md").isNull() | (c("dm") == c("md")), c("dm"))
    days = F.when(c("kind") != "local", c("md")).when(c("order") == "DMY", c("dm")).when(c("order") == "MDY", c("md")).otherwise(either)
    abbreviation = F.create_map(*[F.lit(x) for kv in ABBREVIATION_MINUTES.items() for x in kv])
    minutes = F.when((c("oh") <= 18) & (c("om") <= 59), (c("oh") * 60 + c("om")) * F.when(c("zone").startswith("-"), -1).otherwise(1))
    out = out.select(
        "*",
        days.alias("_ts_days"),
        F.when(c("timed"), F.when((c("mi") <= 59) & (c("sec") <= 59), (c("hour") * 3600 + c("mi") * 60 + c("sec")) * 1_000_000 + c("frac"))).otherwise(F.lit(0)).alias("_ts_clock"),
        F.when(c("signed"), minutes).otherwise(F.try_element_at(abbreviation, F.upper(c("zone"))).cast("long")).alias("_ts_off"),
    )
    out = out.select(
        "*",
        (c("days") * 86_400_000_000 + c("clock")).alias("_ts_local"),
        F.coalesce(c("signed") & c("off").isNull(), F.lit(False)).alias("_ts_bad"),
        # counts since 1970, by their number of digits; a fraction may follow seconds
        F.when(c("whole") != "", n(c("whole")) * 1_000_000 + n(F.rpad(F.substring(c("part"), 1, 6), 6, "0")))
        .when(c("size") == 10, c("count") * 1_000_000)
        .when(c("size") == 13, c("count") * 1_000)
        .when(c("size") == 16, c("count"))
        .when(c("size") == 19, F.expr("_ts_count div 1000"))
        .alias("_ts_counted"),
    )
    # a generator of one row: predicates on the result are not copied into the parser's expressions
    parsed = F.struct(
        F.coalesce(c("counted"), c("local") - c("off") * 60_000_000).alias("instant_us"),
        F.when(~c("bad"), c("local")).alias("local_us"),
        c("off").alias("offset_min"),
        F.when(c("off").isNull() & ~c("bad"), c("zone")).alias("zone_name"),
    )
    return out.select(*[x for x in df.columns if x not in ("instant_us", "local_us", "offset_min", "zone_name")], F.inline(F.array(parsed)))


def _zone_file(name: str) -> bytes:
    """The compiled rules of a zone, from where ``zoneinfo`` takes them: the system's folders, else the tzdata package."""
    import zoneinfo
    from importlib import resources
    from pathlib import Path

    for folder in zoneinfo.TZPATH:
        path = Path(folder, *name.split("/"))
        if path.is_file():
            return path.read_bytes()
    *package, last = name.split("/")
    return resources.files(".".join(["tzdata.zoneinfo", *package])).joinpath(last).read_bytes()


def _listed_changes(data: bytes) -> tuple[list[int], bool]:
    """(seconds of the changes that the file lists, whether a yearly rule goes on after them)."""
    head = 44
    counts = lambda at: struct.unpack(">6l", data[at + 20 : at + head])

    def body(c: tuple[int, ...], width: int) -> int:
        utc, std, leaps, times, types, chars = c
        return times * (width + 1) + types * 6 + chars + leaps * (width + 4) + std + utc

    if data[4:5] < b"2":
        return list(struct.unpack(f">{counts(0)[3]}l", data[head : head + 4 * counts(0)[3]])), False
    second = head + body(counts(0), 4)
    c = counts(second)
    times = struct.unpack(f">{c[3]}q", data[second + head : second + head + 8 * c[3]])
    return list(times), b"," in data[second + head + body(c, 8) :]


def _intervals_of(name: str) -> list[tuple[int, int, int]]:
    """(first second, end second, offset) in UTC of a zone; the first begins and the last ends beyond any date.

    The changes are those that the zone's file lists, one by one, so none is too short to be seen. What a yearly rule
    adds after them, until LAST_YEAR, is searched by days: such a rule changes the clock twice a year.
    """
    from zoneinfo import ZoneInfo

    zone = ZoneInfo(name)
    offset = lambda t: int(dt.datetime.fromtimestamp(t, zone).utcoffset().total_seconds())
    at = lambda year: int(dt.datetime(year, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    far, day = 400_000_000_000, 86_400
    listed, goes_on = _listed_changes(_zone_file(name))
    changes = sorted({t for t in listed if at(2) < t < at(9998)})
    t = max([at(1970), *changes])
    now = offset(t)
    while goes_on and t < at(LAST_YEAR):
        after = offset(t + day)
        if after != now:
            low, high = t, t + day
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == now else (low, middle)
            changes.append(high)
        now, t = after, t + day
    begin, now, out = -far, offset(changes[0] - 1 if changes else 0), []
    for t in changes:
        if (after := offset(t)) != now:
            out.append((begin, t, now))
            begin, now = t, after
    return [*out, (begin, far, now)]


def _explode_zones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from zoneinfo import available_timezones

    known = available_timezones()
    jan = [int(dt.datetime(y, 1, 1, tzinfo=dt.timezone.utc).timestamp()) for y in range(FIRST_YEAR, LAST_YEAR + 2)]
    for batch in batches:
        rows = []
        for name in batch["zone_name"]:
            if name not in known:
                continue
            spans = _intervals_of(name)
            at = 0
            for i, year in enumerate(range(FIRST_YEAR, LAST_YEAR + 1)):
                low = -(10**15) if i == 0 else jan[i] - 86_400 * 2
                high = 10**15 if year == LAST_YEAR else jan[i + 1] + 86_400 * 2
                while spans[at][1] <= low:
                    at += 1
                k, here = at, []
                while k < len(spans) and spans[k][0] < high:
                    b, e, o = spans[k]
                    here.append({"begin_us": (b + o) * 1_000_000, "end_us": (e + o) * 1_000_000, "offset_s": o})
                    k += 1
                rows.append((name, year, here))
        yield pd.DataFrame(rows, columns=["zone_name", "zone_year", "spans"])


def zone_intervals(zones: DataFrame) -> DataFrame:
    """Offset intervals in local time of each zone in column ``zone_name``, one row per zone and year.

    Unknown names give no row, so the result is bounded by the number of IANA zones (about 600) times the
    years from FIRST_YEAR to LAST_YEAR; earlier and later times use the first and last year's row.
    """
    schema = "zone_name string, zone_year int, spans array<struct<begin_us: bigint, end_us: bigint, offset_s: int>>"
    return zones.select("zone_name").where("zone_name is not null").distinct().mapInPandas(_explode_zones, schema)


def resolve_local(df: DataFrame, local_us: str = "local_us", zone_name: str = "zone_name") -> DataFrame:
    """As-of join of local times to the zone intervals; adds ``resolved_us`` and ``matches``.

    ``matches`` is the number of intervals that hold the reading: 0 for one the clock skips or an unknown
    zone, 1 for a plain one, 2 for one shown twice. ``resolved_us`` is set only for 1. The interval table is
    broadcast: it has at most 600 zones times 301 years of a few intervals each, whatever the input.
    """
    days = F.floor(F.col(local_us) / F.lit(86_400_000_000)).cast("int")
    year = F.greatest(F.lit(FIRST_YEAR), F.least(F.lit(LAST_YEAR), F.year(F.date_from_unix_date(days))))
    keyed = df.withColumn("_zone_year", F.when(F.col(local_us).isNotNull(), year)).withColumn("_zone", F.col(zone_name))
    table = zone_intervals(df.select(F.col(zone_name).alias("zone_name"))).select(
        F.col("zone_name").alias("_zone"), F.col("zone_year").alias("_zone_year"), F.col("spans").alias("_spans")
    )
    joined = keyed.join(F.broadcast(table), ["_zone", "_zone_year"], "left")
    hit = F.filter("_spans", lambda x: (x["begin_us"] <= F.col(local_us)) & (F.col(local_us) < x["end_us"]))
    joined = joined.withColumn("_hit", hit).withColumn("matches", F.coalesce(F.when(F.col("_hit").isNotNull(), F.size("_hit")), F.lit(0)))
    one = F.when(F.col("matches") == 1, F.col(local_us) - F.get("_hit", F.lit(0))["offset_s"].cast("long") * 1_000_000)
    return joined.withColumn("resolved_us", one).drop("_zone", "_zone_year", "_spans", "_hit")


def document_instants(documents: DataFrame, uploaders: DataFrame) -> DataFrame:
    """One row per document whose ``upload_date`` denotes exactly one instant: (doc_id, upload_us).

    A zone or offset in the text decides; without one, the zone of the uploader's row. Repeated deliveries
    come out once. The uploaders side is joined by key without a hint, so Spark broadcasts it only while
    its own size check allows. Null uploaders and uploaders without a row leave local times unresolved.
    """
    people = uploaders.groupBy("uploader").agg(F.max("zone_id").alias("home_zone"), F.max("date_order").alias("date_order"))
    rows = documents.where("doc_id is not null and upload_date is not null").select("doc_id", "upload_date", "uploader").dropDuplicates()
    rows = rows.join(people, "uploader", "left")
    rows = parse_timestamps(rows, "upload_date", "date_order")
    rows = rows.where("instant_us is not null or local_us is not null")
    rows = rows.withColumn("zone_name", F.coalesce("zone_name", "home_zone"))
    rows = resolve_local(rows.select("doc_id", "instant_us", "local_us", F.when(F.col("instant_us").isNull(), F.col("zone_name")).alias("zone_name")))
    out = rows.select("doc_id", F.coalesce("instant_us", "resolved_us").alias("upload_us"))
    return out.where("upload_us is not null").dropDuplicates()
