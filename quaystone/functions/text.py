"""Words, folding and the small projections over posts, as native expressions."""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.operators.deliveries import fold_channel as fold_channel

#: Latin letters whose decomposition starts with a plain letter, and that letter: the fold of the word index. Cyrillic letters stay.
_FOLDED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.normalize("NFD", chr(c))[0].isascii()}
FOLD_FROM, FOLD_TO = "".join(_FOLDED), "".join(_FOLDED.values())
TOKEN_GAP = r"[^\p{L}\p{N}\p{Co}]+"
SNIPPET = 140


def fold_yo(text: Column) -> Column:
    """The letter yo as ye, in the index and in queries."""
    return F.translate(text, "ёЁ", "еЕ")


#: What stands between two words of a line.
BETWEEN = "  "


def word_line(text: Column) -> Column:
    """The words of a text in one string, two spaces between them: runs of letters, digits and private-use characters, in lower case, Latin accents dropped.

    No array is made, so everything stays in generated code; see ``count_in_line``.
    """
    low = F.lower(text)
    low = F.when(low.rlike(r"[\x{300}-\x{36F}]"), F.regexp_replace(low, r"[\x{300}-\x{36F}]", "")).otherwise(low)
    low = F.when(low.rlike(r"[\x{C0}-\x{24F}\x{1E00}-\x{1EFF}]"), F.translate(low, FOLD_FROM, FOLD_TO)).otherwise(low)
    return F.trim(F.regexp_replace(low, TOKEN_GAP, BETWEEN))


def words(text: Column) -> Column:
    """Array of the words of a text; null gives null, no words an empty array."""
    return line_words(word_line(text))


def line_words(line: Column) -> Column:
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, BETWEEN))


def line_length(line: Column) -> Column:
    """Number of words of a line."""
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(BETWEEN), F.lit(" "))) + 1)


def count_in_line(line: Column, phrase: list[str]) -> Column:
    """How often the words of ``phrase`` stand in a line one after another; overlapping places count."""
    padded, wanted = F.concat(F.lit(" "), line, F.lit(" ")), f" {BETWEEN.join(phrase)} "
    if len(phrase) == 1:
        return ((F.length(padded) - F.length(F.replace(padded, F.lit(wanted), F.lit("")))) / len(wanted)).cast("int")
    return F.when(F.contains(padded, F.lit(wanted)), F.regexp_count(padded, F.lit(f"(?={re.escape(wanted)})"))).otherwise(0)


def words_of(text: str) -> list[str]:
    """``words`` of one text, on the driver."""
    bare = re.sub("[̀-ͯ]", "", text).lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return ["".join(run) for run in _runs(bare)]


def _runs(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for c in text:
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            out[-1].append(c)
        elif out[-1]:
            out.append([])
    return [run for run in out if run]


def permalink(channel: Column, message_id: Column) -> Column:
    """The public address of a post."""
    return F.concat(F.lit("https://t.me/"), channel, F.lit("/"), message_id.cast("string"))


def snippet(text: Column, question: Column | None = None) -> Column:
    """One line of at most SNIPPET code points, with an ellipsis if cut; a poll's question if there is no text."""
    body = text if question is None else F.when(F.coalesce(text, F.lit("")) == "", question).otherwise(text)
    line = F.trim(F.translate(F.coalesce(body, F.lit("")), "\n", " "))
    return F.when(F.length(line) > SNIPPET, F.concat(F.substring(line, 1, SNIPPET), F.lit("…"))).otherwise(line)


def iso_instant(at: Column) -> Column:
    """ISO 8601 in UTC with milliseconds; the session's zone must be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def abbreviated_views(text: Column) -> Column:
    """``struct<value,is_approximate>`` of a counter such as 987, 1.4K or 1.67M; null if it is none."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([KM]?)\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([KM]?)\s*$", 2)
    scale = F.when(unit == "K", 1000).when(unit == "M", 1_000_000).otherwise(1)
    value = (number.try_cast("decimal(20,6)") * scale).cast("bigint")
    return F.when(number != "", F.struct(value.alias("value"), (unit != "").alias("is_approximate")))


def total_reactions(reactions: Column) -> Column:
    """Sum of the counts of an array of reactions, paid ones included; 0 for none."""
    return F.aggregate(F.coalesce(reactions, F.array()), F.lit(0).cast("bigint"), lambda a, r: a + F.coalesce(r["count"], F.lit(0)))


def chat_id(raw_channel_id: Column) -> Column:
    """The client library's chat id of a channel: arithmetic only."""
    return F.lit(-(10**12)).cast("bigint") - raw_channel_id


def is_username(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9_]+$"), F.lit(False))


_REFERENCE = re.compile(r"^(?:https?://)?(?:t\.me/)?@?([A-Za-z0-9_]+)/([0-9]+)$")


def parse_reference(text: str) -> tuple[str, int] | None:
    """(channel, id) of a post written as @name/7, name/7 or its address; None if it is none."""
    m = _REFERENCE.match(text.strip())
    return (m[1].lower(), int(m[2])) if m and int(m[2]) > 0 else None


def parse_bound(text: str) -> tuple[datetime, bool]:
    """(instant, is a whole day) of a date filter: ISO 8601 with zone, with or without fraction, or a UTC day."""
    try:
        if len(text) == 10:
            return datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=timezone.utc), True
        at = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"not a date: {text!r}") from None
    if at.tzinfo is None:
        raise ValueError(f"date without a zone: {text!r}")
    return at.astimezone(timezone.utc), False


def day_after(day: datetime) -> datetime:
    return day + timedelta(days=1)


def similar_text(a: str, b: str, least: float = 0.9) -> bool:
    """Whether two renderings are one text: equal words, or a common subsequence of at least ``least`` of the longer one."""
    x, y = re.findall(r"[^\W_]+", a.lower()), re.findall(r"[^\W_]+", b.lower())
    if x == y:
        return True
    longest = max(len(x), len(y))
    if min(len(x), len(y)) < least * longest:
        return False
    row = [0] * (len(y) + 1)
    for w in x:
        diagonal = 0
        for j, v in enumerate(y, 1):
            diagonal, row[j] = row[j], diagonal + 1 if w == v else max(row[j], row[j - 1])
    return row[-1] >= least * longest


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar_text(x or "", y or "") for x, y in zip(a, b)], dtype=bool)


def similar_texts(a: Column, b: Column) -> Column:
    """``similar_text`` of two columns; null counts as empty."""
    return _similar(a, b)
