"""Queries, filters and ranked search over a table that has no index.

A searchable table has ``channel, message_id, date, kind, content`` (see
``searchable``). Ranks are BM25 with the statistics of the whole table, taken
before any filter; lower is better, and ties are broken by channel and id. A query
here reads the whole table; ``operators.index`` gives the same from files.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quaystone.functions.stems import stem, stem_line
from quaystone.functions.text import count_in_line, fold_yo, line_length, word_line, words_of
from quaystone.session import cut_lineage

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MAX_LIMIT = 100_000
KEY = ["channel", "message_id"]
# Pairs of quotation marks that make a phrase.
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}


@dataclass(frozen=True)
class Query:
    """``phrases`` are ordered words, ``tokens`` loose ones, ``pieces`` the literal parts in typed order."""

    phrases: list[list[str]] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)

    @property
    def literal(self) -> str:
        return " ".join(self.pieces).lower()


def parse_query(text: str) -> Query:
    """Quoted parts become phrases, the rest loose words; an unclosed quote opens nothing, an empty pair is ignored."""
    text = text.translate(str.maketrans("ёЁ", "еЕ"))
    phrases, tokens, pieces, loose, i = [], [], [], "", 0

    def flush() -> None:
        nonlocal loose
        tokens.extend(words_of(loose))
        pieces.extend(loose.split())
        loose = ""

    while i < len(text):
        close = text.find(QUOTES[text[i]], i + 1) if text[i] in QUOTES else -1
        if close < 0:
            loose += " " if text[i] in QUOTES else text[i]
            i += 1
            continue
        flush()
        inside = text[i + 1 : close].strip()
        found = words_of(inside)
        if found:
            phrases.append(found) if len(found) > 1 else tokens.extend(found)
            pieces.append(inside)
        i = close + 1
    flush()
    return Query(phrases, tokens, pieces)


def refuse_operators(text: str) -> None:
    """Bare upper-case AND, OR, NOT outside quotes are an error at the tool surface: they would silently be words."""
    bare = text
    for opened, closed in QUOTES.items():
        bare = re.sub(f"{re.escape(opened)}[^{re.escape(closed)}]*{re.escape(closed)}", " ", bare)
    found = [w for w in re.split(r"[\W_]+", bare) if w in ("AND", "OR", "NOT")]
    if found:
        raise ValueError(f"{found[0]} is not an operator here; all words must match, and quotes make an ordered phrase")


def searchable(posts: DataFrame, previews: DataFrame | None = None) -> DataFrame:
    """Posts with ``content``: text, tags, poll, author and link previews, a line each.

    ``posts`` has channel, message_id, date, kind, text, hashtags, poll, author_name;
    ``previews`` channel, message_id, title, description, any number a post. Nulls
    add nothing; a post with nothing to search has empty content.
    """
    if previews is None:
        return _searchable(posts)
    lines = previews.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.concat_ws("\n", "title", "description"))).alias("__previews"))
    return _searchable(posts.join(lines, KEY, "left"), F.col("__previews"))


def searchable_whole(posts: DataFrame) -> DataFrame:
    """``searchable`` of posts with their ``links`` and the previews of these in them: nothing is joined."""
    return _searchable(posts, F.array_sort(F.array_distinct(F.transform("links", lambda x: F.concat_ws("\n", x["preview"]["title"], x["preview"]["description"])))))


def _searchable(posts: DataFrame, previews: Column | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    tags = F.transform(F.coalesce("hashtags", none), lambda t: F.concat(F.lit("#"), t))
    parts = [F.array("text"), tags, F.array("poll.question"), F.coalesce("poll.options", none), F.array("author_name")]
    if previews is not None:
        parts.append(F.coalesce(previews, none))
    return posts.select(*KEY, "date", "kind", F.array_join(F.flatten(F.array(*parts)), "\n").alias("content"))


@dataclass(frozen=True)
class SearchFilter:
    """All that is given must hold; ``until`` is inclusive, ``before`` exclusive. The channel may have leading @ and any case."""

    channel: str | None = None
    kind: str | None = None
    since: object | None = None
    until: object | None = None
    before: object | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        tests = []
        if self.channel is not None:
            tests.append(F.col("channel") == self.channel.lstrip("@").lower())
        if self.kind is not None:
            tests.append(F.col("kind") == self.kind)
        if self.since is not None:
            tests.append(F.col("date") >= F.lit(self.since))
        if self.until is not None:
            tests.append(F.col("date") <= F.lit(self.until))
        if self.before is not None:
            tests.append(F.col("date") < F.lit(self.before))
        return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def indexed(table: DataFrame, with_stems: bool = True) -> DataFrame:
    """``table`` with folded content, the line of its words, the line of their stems (the second field, or empty) and the length of both."""
    df = table.withColumn("folded", fold_yo(F.coalesce("content", F.lit(""))))
    df = df.withColumn("words", word_line(F.col("folded")))
    df = df.withColumn("stems", stem_line(F.col("words")) if with_stems else F.lit(""))
    return df.withColumn("length", line_length(F.col("words")) + line_length(F.col("stems")))


def _terms(query: Query, with_stems: bool) -> list[list[tuple[str, list[str]]]]:
    """For each required term, the (field, phrase) pairs of which one must stand in the document."""
    wanted = [[t] for t in query.tokens] + query.phrases
    return [[("words", p), *([("stems", [stem(w) for w in p])] if with_stems else [])] for p in wanted]


def _ranked(df: DataFrame, counts: list[Column], length: str, hit: Column) -> DataFrame:
    """Hits of ``df`` with their BM25 rank. One pass takes the statistics of the whole table and keeps the hits."""
    df = df.select(*KEY, "date", "kind", F.col(length).alias("dl"), *[c.alias(f"f{i}") for i, c in enumerate(counts)])
    seen = Observation()
    n_of = [F.sum(F.when(F.col(f"f{i}") > 0, 1).otherwise(0)).alias(f"n{i}") for i in range(len(counts))]
    found = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("dl").alias("all"), *n_of).where(hit))
    stats = seen.get
    n, mean = stats.get("n") or 0, (stats.get("all") or 0) / max(stats.get("n") or 0, 1) or 1.0
    rank = F.lit(0.0)
    for i in range(len(counts)):
        n_i = stats.get(f"n{i}") or 0
        idf = max(math.log((n - n_i + 0.5) / (n_i + 0.5)), LEAST_IDF)
        f = F.col(f"f{i}")
        rank = rank - F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.lit(float(mean))))
    return found.select(*KEY, "date", "kind", rank.alias("rank"))


def word_hits(index: DataFrame, query: Query, with_stems: bool = True) -> DataFrame:
    """``(channel, message_id, date, kind, rank)`` of documents with every word and phrase, in the text or in its stems."""
    terms = _terms(query, with_stems)
    if not terms:
        return _none(index)
    counts = [count_in_line(F.col(where), phrase) for term in terms for where, phrase in term]
    hit, i = F.lit(True), 0
    for term in terms:
        hit = hit & reduce(lambda a, b: a | b, [F.col(f"f{i + k}") > 0 for k in range(len(term))])
        i += len(term)
    return _ranked(index, counts, "length", hit)


def substring_hits(index: DataFrame, query: Query) -> DataFrame:
    """The same for documents that hold the typed text literally, case and yo aside; fewer than three characters find nothing."""
    literal = query.literal
    if len(literal) < 3:
        return _none(index)
    low = F.lower("folded")
    count = F.when(F.contains(low, F.lit(literal)), F.regexp_count(low, F.lit(f"(?={re.escape(literal)})"))).otherwise(0)
    return _ranked(index.withColumn("trigrams", F.greatest(F.length(low) - 2, F.lit(0))), [count], "trigrams", F.col("f0") > 0)


def _none(index: DataFrame) -> DataFrame:
    return index.select(*KEY, "date", "kind", F.lit(0.0).alias("rank")).where(F.lit(False))


def hits(index: DataFrame, text: str, mode: str = "both", where: SearchFilter = SearchFilter(), with_stems: bool = True) -> DataFrame:
    """``(channel, message_id, date, kind, tier, rank)``: word hits (tier 0), then what only the substring search finds (tier 1)."""
    if mode not in ("words", "substring", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    query = parse_query(text)
    found = []
    if mode != "substring":
        found.append(where.apply(word_hits(index, query, with_stems)).withColumn("tier", F.lit(0)))
    if mode != "words":
        part = where.apply(substring_hits(index, query))
        if found:
            part = part.join(found[0].select(*KEY), KEY, "left_anti")
        found.append(part.withColumn("tier", F.lit(1 if mode == "both" else 0)))
    return reduce(DataFrame.unionByName, found).select(*KEY, "date", "kind", "tier", "rank")


def ranked_page(found: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """Rows of ``hits`` in their one order; a negative limit gives nothing, none gives all."""
    ordered = found.orderBy("tier", F.round("rank", 12), *KEY)
    rest = ordered.offset(offset) if offset else ordered
    return rest if limit is None else rest.limit(min(max(limit, 0), MAX_LIMIT))


def match_count(index: DataFrame, text: str, mode: str = "both", where: SearchFilter = SearchFilter(), with_stems: bool = True) -> DataFrame:
    """``(total)``: number of hits."""
    return hits(index, text, mode, where, with_stems).agg(F.count(F.lit(1)).alias("total"))


def stale_rows(index: DataFrame, posts: DataFrame) -> DataFrame:
    """Index rows whose post is gone."""
    return index.join(posts.select(*KEY), KEY, "left_anti")
