"""Mixed timestamp spellings brought to one UTC instant.

A value is first rewritten, by the one pattern it matches, to fixed fields; fields
with an offset give the instant directly. Fields without one are joined, as of
their local time, to the intervals in which the zone keeps one offset: two
intervals hold a wall-clock time that occurs twice, none holds one that the clock
change skips.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import reduce
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names as the sources write them.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "januar": 1, "februar": 2, "märz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
    "января": 1, "февраля": 2, "марта": 3, "апреля": 4, "мая": 5, "июня": 6,
    "июля": 7, "августа": 8, "сентября": 9, "октября": 10, "ноября": 11, "декабря": 12,
    "січня": 1, "лютого": 2, "березня": 3, "квітня": 4, "травня": 5, "червня": 6,
    "липня": 7, "серпня": 8, "вересня": 9, "жовтня": 10, "листопада": 11, "грудня": 12,
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "janeiro": 1, "fevereiro": 2, "março": 3, "maio": 5, "junho": 6, "julho": 7, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12,
}

# Zone abbreviations, in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "JST": 540,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?:UTC(?=[+-]))?(Z|[A-Z]{2,5}|[+-]\d{2}(?::?\d{2})?)?"

#: Pattern, and the order in which its groups give year|month|day|hour|minute|second|fraction|half of day|offset.
SPELLINGS = [
    (rf"^(\d{{4}})[-/](\d{{2}})[-/](\d{{2}})[T ]{_CLOCK} ?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_CLOCK} ?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?{_ZONE}$", "$1|$2|$3|$4|$5|$6|||$7"),
    (rf"^(?:\p{{L}}{{2,4}}, )?(\d{{1,2}})(?:\.|º|er)? (?:de )?(\p{{L}}+)\.? (?:de )?(\d{{4}})(?: [гр]\.)?,? {_CLOCK} ?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^(\p{{L}}+)\.? (\d{{1,2}}), (\d{{4}}),? {_CLOCK}[ \x{{202F}}]?([AP]M)$", "$3|$1|$2|$4|$5|$6|$7|$8|"),
]

MICROS = 1_000_000
#: Local years for which offsets are listed. No zone changed before the first; long before the last each follows its standing rule, so a year has the offsets of a listed one with the same calendar.
FIRST_YEAR, LAST_YEAR = 1800, 2139


def _transitions(zone: ZoneInfo) -> list[tuple[int, int]]:
    """(UTC second, offset in seconds) at the start and at each change between the two years."""

    def offset(second: int) -> int:
        return int((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())

    day = 86_400
    start = int((datetime(FIRST_YEAR, 1, 1) - datetime(1970, 1, 1)).total_seconds()) - 2 * day
    end = int((datetime(LAST_YEAR + 1, 1, 1) - datetime(1970, 1, 1)).total_seconds()) + 2 * day
    found, before = [(start, offset(start))], offset(start)
    for at in range(start + 5 * day, end + 5 * day, 5 * day):
        now = offset(at)
        if now != before:
            lo = at - 5 * day
            lo += bisect.bisect_left(range(5 * day), True, key=lambda s: offset(lo + s) != before)
            found.append((lo, now))
            before = now
    return found


def _intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name in batch["zone"]:
            try:
                changes = _transitions(ZoneInfo(name))
            except (KeyError, ValueError, OSError):  # no such zone
                continue
            ends = [at for at, _ in changes[1:]] + [(datetime(LAST_YEAR + 1, 1, 1) - datetime(1970, 1, 1)).total_seconds() + 86_400]
            for (at, off), end in zip(changes, ends):
                lo, hi = at + off, int(end) + off
                first = (datetime(1970, 1, 1) + timedelta(seconds=lo)).year
                last = (datetime(1970, 1, 1) + timedelta(seconds=hi - 1)).year
                rows += [(name, year, lo * MICROS, hi * MICROS, off * MICROS) for year in range(max(first, FIRST_YEAR), min(last, LAST_YEAR) + 1)]
        yield pd.DataFrame(rows, columns=["zone", "year", "lo", "hi", "off"])


def zone_intervals(zones: DataFrame) -> DataFrame:
    """For each name in the column ``zone`` and each local year, the array of its constant-offset intervals in local micros.

    Names that are no IANA zone give no row. The result has at most 340 rows a zone,
    and there are about 600 zones: it stays under 20 MB whatever the data.
    """
    rows = zones.where(F.col("zone").isNotNull()).select("zone").distinct().mapInPandas(_intervals, "zone string, year int, lo bigint, hi bigint, off bigint")
    return rows.groupBy("zone", "year").agg(F.collect_list(F.struct("lo", "hi", "off")).alias("spans"))


def _listed_year(year: Column) -> tuple[Column, Column]:
    """(year of the list that has the same calendar and rules, days from its first day to that of ``year``)."""
    first = lambda y: F.make_date(y, F.lit(1), F.lit(1))
    # Of leap and common years there are seven kinds each, by the weekday that they begin with.
    like = {f"{datetime(y, 1, 1).isoweekday()} {(datetime(y + 1, 1, 1) - datetime(y, 1, 1)).days}": y for y in range(LAST_YEAR - 28, LAST_YEAR)}
    kind = F.concat_ws(" ", F.weekday(first(year)) + 1, F.datediff(first(year + 1), first(year)))
    same = F.when(year > LAST_YEAR, _lookup(like, kind)).when(year < FIRST_YEAR, FIRST_YEAR).otherwise(year)
    return same, F.datediff(first(year), first(same))


def _lookup(values: dict[str, int], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def parse_fields(value: Column) -> Column:
    """``year|month|day|hour|minute|second|fraction|half|offset`` of a trimmed value, or null when no spelling fits."""
    return reduce(lambda rest, spelling: F.when(value.rlike(spelling[0]), F.regexp_replace(value, *spelling)).otherwise(rest), reversed(SPELLINGS), F.lit(None).cast("string"))


def normalise_instants(df: DataFrame, value: str, zones: DataFrame, zone: str, out: str = "utc_ms", finding: str | None = None) -> DataFrame:
    """Add ``out``, the epoch milliseconds (rounded down) that ``value`` denotes, or null.

    With ``finding`` also a column of that name: ``instant``, ``ambiguous`` (a wall-clock
    time that occurs twice; the first is meant), ``nonexistent`` (one that is skipped),
    ``no_zone`` or ``unreadable``.

    ``df`` must have the string columns ``value`` and ``zone`` (the IANA zone of
    values that name none; null: such values denote no instant). ``zones`` has the
    zone names in its column ``zone``. All columns and rows of ``df`` are kept.

    Null, blank, unknown words, impossible dates and wall-clock times that a clock
    change skips give null; one that occurs twice means the first; missing seconds
    are 0. Ten, 13 or 16 digits are epoch seconds, milli- or microseconds.
    """
    text = F.trim(F.regexp_replace(F.col(value), r"[\s\x{A0}]+", " "))
    named = ["__text", "__f", "__local", "__off", "__year", "__zone", "__listed", "__then"]
    df = df.withColumn("__text", text).withColumn("__f", F.split(parse_fields(F.col("__text")), r"\|"))

    def part(i: int) -> Column:
        return F.col("__f")[i]

    def number(i: int) -> Column:
        return part(i).try_cast("int")

    month = F.coalesce(number(1), _lookup(MONTHS, F.lower(part(1))))
    date = F.concat_ws("-", part(0), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0")).try_cast("date")
    half = part(7)
    hour = F.when(half == "", number(3)).when(number(3).between(1, 12), number(3) % 12 + F.when(half == "PM", 12).otherwise(0))
    second = F.when(part(5) == "", 0).otherwise(number(5))
    micros = F.rpad(F.substring(part(6), 1, 6), 6, "0").cast("bigint")
    fine = hour.between(0, 23) & number(4).between(0, 59) & second.between(0, 59) & month.isNotNull()
    local = F.when(fine, (F.unix_date(date).cast("bigint") * 86_400 + hour * 3600 + number(4) * 60 + second) * MICROS + micros)
    given = part(8)
    digits = F.regexp_replace(given, ":", "")
    minutes = F.substring(digits, 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 4, 2).try_cast("int"), F.lit(0))
    shift = F.when(given.rlike(r"^[+-]\d"), F.when(given.startswith("-"), -minutes).otherwise(minutes)).otherwise(_lookup(ABBREVIATIONS, given))
    df = df.withColumn("__local", local).withColumn("__off", F.when(given != "", shift.cast("bigint") * 60 * MICROS)).withColumn("__year", F.when((given == "") & F.col("__local").isNotNull(), number(0))).withColumn("__zone", F.col(zone))
    listed, days = _listed_year(F.col("__year"))
    df = df.withColumn("__listed", listed).withColumn("__then", F.col("__local") - days.cast("bigint") * 86_400 * MICROS)

    spans = F.broadcast(zone_intervals(zones).select(F.col("zone").alias("__z"), F.col("year").alias("__y"), F.col("spans").alias("__spans")))
    df = df.join(spans, (F.col("__zone") == F.col("__z")) & (F.col("__listed") == F.col("__y")), "left")
    held = F.filter(F.col("__spans"), lambda s: (s["lo"] <= F.col("__then")) & (F.col("__then") < s["hi"]))
    # Of two intervals, the one with the larger offset gives the earlier instant.
    by_zone = F.col("__local") - F.array_max(F.transform(held, lambda s: s["off"]))
    length = F.length("__text")
    epoch = F.when(F.col("__text").rlike(r"^\d+$"), F.when(length == 10, F.col("__text").try_cast("bigint") * MICROS).when(length == 13, F.col("__text").try_cast("bigint") * 1000).when(length == 16, F.col("__text").try_cast("bigint")))
    instant = F.coalesce(epoch, F.col("__local") - F.col("__off"), F.when(F.col("__year").isNotNull(), by_zone))
    df = df.withColumn(out, F.floor(instant / F.lit(1000)).cast("bigint"))
    if finding:
        found = F.size(held)
        kind = F.when(F.col("__year").isNotNull() & (found > 1), "ambiguous").when(F.col(out).isNotNull(), "instant").when(F.col("__year").isNull(), "unreadable")
        df = df.withColumn(finding, kind.when(F.col("__spans").isNull(), "no_zone").otherwise("nonexistent"))
    return df.drop(*named, "__z", "__y", "__spans")


def dirty_instants(posts: DataFrame, links: DataFrame, channels: DataFrame) -> DataFrame:
    """``(src, src_id, utc_ms)`` of each post date and link observation that denotes an instant but is not in canonical form.

    Exact duplicate rows give one result row. Rows whose channel is unknown have no
    zone. Empty tables give an empty result.
    """
    values, zones = _dirty_values(posts, links, channels)
    done = normalise_instants(values, "value", zones, "zone")
    return done.where(F.col("utc_ms").isNotNull()).select("src", "src_id", "utc_ms").distinct()


def _dirty_values(posts: DataFrame, links: DataFrame, channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values not in canonical form with the zone of their channel, all zones)."""
    values = posts.select(F.lit("post").alias("src"), F.col("row_id").alias("src_id"), "channel", F.col("date").alias("value")).unionByName(
        links.select(F.lit("link").alias("src"), F.col("link_id").alias("src_id"), "channel", F.col("preview.observed_at").alias("value"))
    )
    values = values.where(F.col("value").isNotNull() & ~F.col("value").rlike(CANONICAL))
    zones = channels.where(F.col("channel").isNotNull()).groupBy("channel").agg(F.max("time_zone").alias("zone"))
    return values.join(zones, "channel", "left"), channels.select(F.col("time_zone").alias("zone"))


def findings(posts: DataFrame, links: DataFrame, channels: DataFrame) -> DataFrame:
    """``(src, finding, values)``: how many distinct rows' values are plain instants, ambiguous, nonexistent, without zone or unreadable."""
    values, zones = _dirty_values(posts, links, channels)
    done = normalise_instants(values, "value", zones, "zone", finding="finding").select("src", "src_id", "finding").distinct()
    return done.groupBy("src", "finding").agg(F.count(F.lit(1)).alias("values"))


def instants_by_month(posts: DataFrame, links: DataFrame, channels: DataFrame) -> DataFrame:
    """``(src, month, values)``: how many non-canonical values denote an instant in each UTC month."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("utc_ms") / 86_400_000).cast("int"))
    month = F.date_format(day, "yyyy-MM")
    return dirty_instants(posts, links, channels).groupBy("src", month.alias("month")).agg(F.count(F.lit(1)).alias("values"))
