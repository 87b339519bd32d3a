"""The search index in files: texts, postings with positions, the vocabulary and the sums that BM25 needs.

``write_index`` tokenises and stems every document once. Afterwards a word query reads
the postings of its words only (files are sorted by word, so the words reach the scan as
pushed filters), phrases are positions that follow one another, and a substring is looked
for among the words of the vocabulary first, so that a rare one reads a few texts.

An index may have several segments, one for each batch of added documents: all its tables
are simply read together. Replaced documents need a new index.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quaystone.functions.predicates import has_key, is_in
from quaystone.functions.stems import stem
from quaystone.functions.text import BETWEEN, fold_yo, line_length, word_line, words_of
from quaystone.operators.search import B, K1, KEY, LEAST_IDF, Query, SearchFilter, parse_query
from quaystone.session import at_once, cut_lineage

PARTS = ("texts", "postings", "vocabulary", "sums")
#: Fields of a posting: the words as written, and their stems.
SURFACE, STEM = 0, 1
#: Postings that a task hands on at once.
EMITTED = 100_000
#: Bytes of lines whose postings a task sorts at once.
SORTED = 8 << 20
#: A substring whose words are at most so many, in at most so many documents, is looked up by document; any other reads all texts. Both give the same.
LOOKED_UP_WORDS, LOOKED_UP_DOCS = 200, 1000


@dataclass(frozen=True)
class SearchIndex:
    """``texts``: channel, message_id, date, kind, low, dl, grams; ``postings``: word, field, channel, message_id, date, kind, dl, f, places;
    ``vocabulary``: word, field, documents, occurrences; ``sums``: documents, words, grams."""

    texts: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    sums: DataFrame

    def totals(self) -> tuple[int, float, float]:
        """(documents, mean length in words of both fields, mean number of trigrams)."""
        row = self.sums.agg(F.sum("documents"), F.sum("words"), F.sum("grams")).first()
        n = row[0] or 0
        return n, (row[1] or 0) / max(n, 1) or 1.0, (row[2] or 0) / max(n, 1) or 1.0


def index_texts(table: DataFrame, with_stems: bool = True) -> DataFrame:
    """The ``texts`` of a searchable table, with the line of its words. A null content counts as empty."""
    folded = fold_yo(F.coalesce("content", F.lit("")))
    df = table.select(*KEY, "date", "kind", folded.alias("__folded"))
    df = df.select(*KEY, "date", "kind", F.lower("__folded").alias("low"), word_line(F.col("__folded")).alias("line"))
    return df.select(*KEY, "date", "kind", "low", "line", (line_length(F.col("line")) * (2 if with_stems else 1)).alias("dl"), F.greatest(F.length("low") - 2, F.lit(0)).alias("grams"))


def _placed(lines: pa.Array, with_stems: bool) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, field, start, places) of all words of some lines, by word, field and row; ``start`` has one more and says where each one's places begin, which rise."""
    held = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(lines), 0), False).to_numpy(zero_copy_only=False))
    lists = pc.split_pattern(lines.take(pa.array(held)), BETWEEN)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
    rows = np.repeat(np.arange(len(held)), np.diff(ends, prepend=0))
    places = np.arange(len(rows)) - np.concatenate([[0], ends[:-1]])[rows] if len(held) else rows
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    spelt = [words, *([[stem(w) for w in words]] if with_stems else [])]
    names = sorted({w for field in spelt for w in field})
    rank = {w: i for i, w in enumerate(names)}
    key = np.concatenate([(np.array([rank[w] for w in field], np.int64)[codes] * 2 + n) * max(len(held), 1) + rows for n, field in enumerate(spelt)])
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.diff(key, prepend=-1))
    named, row = np.divmod(key[start], max(len(held), 1))
    return held[row], pa.array(names, pa.string()).take(pa.array(named >> 1)), named & 1, np.append(start, len(key)), np.tile(places, len(spelt))[order]


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces whose lines have at most ``most`` bytes, or in one row more."""
    waiting, held = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("line")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            end = int(np.searchsorted(sizes, before + most - held, "right"))
            end = at + 1 if end == at and not waiting else end
            if end > at:
                waiting.append(batch.slice(at, end - at))
                held += int(sizes[end - 1]) - before
                at = end
            if at < batch.num_rows:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, held = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _poster(kept: list[str], schema: pa.Schema, with_stems: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, SORTED):
            rows, words, fields, start, places = _placed(batch.column("line"), with_stems)
            for at in range(0, len(rows), EMITTED):
                end = min(at + EMITTED, len(rows))
                taken = batch.select(kept).take(pa.array(rows[at:end]))
                lists = pa.ListArray.from_arrays(pa.array(start[at : end + 1] - start[at], pa.int32()), pa.array(places[start[at] : start[end]], pa.int32()))
                own = [words.slice(at, end - at), pa.array(fields[at:end], pa.int8()), *taken.columns, pa.array(np.diff(start[at : end + 1]), pa.int32()), lists]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(own, schema)], schema=schema)

    return run


def index_postings(texts: DataFrame, with_stems: bool = True) -> DataFrame:
    """One row for each word of each document and field, with the word's places; nothing is shuffled. They come in runs sorted by word, field and row."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [*KEY, "date", "kind", "dl"]
    rows = texts.select(*kept, "line")
    out = T.StructType([T.StructField("word", T.StringType()), T.StructField("field", T.ByteType()), *[T.StructField(n, rows.schema[n].dataType) for n in kept], T.StructField("f", T.IntegerType()), T.StructField("places", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_poster(kept, to_arrow_schema(out), with_stems), out)


def write_index(table: DataFrame, at: Callable[[str], str], with_stems: bool = True) -> SearchIndex:
    """Write the index of a searchable table (channel, message_id, date, kind, content); ``at`` gives the folder of each of PARTS.

    ``table`` is unique in channel and message_id. Documents without words have a row in
    texts and count in the sums. Postings are ranged by word and document, so a word that
    a third of all documents have is split over as many files as its size asks for.
    An empty table gives an index in which nothing is found.
    """
    write_parts(table, at, with_stems)
    return read_index(table.sparkSession, lambda part: [at(part)])


def write_parts(table: DataFrame, at: Callable[[str], str], with_stems: bool = True, small: bool = False, ranged: bool = True) -> None:
    """What ``write_index`` writes; a ``small`` table, of a few pages, is not ranged but goes into one sorted file a part.

    Not ``ranged``, as a batch of an archive is written, each task sorts what it has: no posting is
    shuffled or written twice, and a word is found in a few pages of every file.
    """
    spark, by_word = table.sparkSession, ["word", "field", *KEY]
    total = lambda lines: lines.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("dl").cast("bigint")).alias("words"), F.sum(F.col("grams").cast("bigint")).alias("grams"))
    count = lambda rows: rows.groupBy("word", "field").agg(F.count(F.lit(1)).alias("documents"), F.sum("f").alias("occurrences"))
    if small:
        lines = index_texts(table.coalesce(1), with_stems)
        rows = cut_lineage(index_postings(lines, with_stems)).coalesce(1)
        parts = {"postings": rows.sortWithinPartitions(*by_word), "texts": lines.drop("line").sortWithinPartitions(*KEY), "vocabulary": count(rows).sortWithinPartitions("word", "field"), "sums": total(lines)}
        at_once([lambda part=part, df=df: df.write.mode("overwrite").parquet(at(part)) for part, df in parts.items()])
        return
    if not ranged:
        index_texts(table, with_stems).drop("line").sortWithinPartitions(*KEY).write.mode("overwrite").parquet(at("texts"))
        texts = spark.read.parquet(at("texts"))
        # The words of a text are those of its lower case.
        index_postings(texts.withColumn("line", word_line(F.col("low"))), with_stems).write.mode("overwrite").parquet(at("postings"))
        count(spark.read.parquet(at("postings"))).sortWithinPartitions("word", "field").write.mode("overwrite").parquet(at("vocabulary"))
        total(texts).write.mode("overwrite").parquet(at("sums"))
        return
    draft = f"{at('postings')}-draft"
    index_texts(table, with_stems).write.mode("overwrite").parquet(f"{at('texts')}-draft")
    lines = spark.read.parquet(f"{at('texts')}-draft")
    index_postings(lines, with_stems).write.mode("overwrite").parquet(draft)
    rows = spark.read.parquet(draft)
    rows.repartitionByRange(*by_word).sortWithinPartitions(*by_word).write.mode("overwrite").parquet(at("postings"))
    # Texts are sorted by document, so that a few of them are a few row groups.
    lines.drop("line").repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.mode("overwrite").parquet(at("texts"))
    count(rows).repartitionByRange("word", "field").sortWithinPartitions("word", "field").write.mode("overwrite").parquet(at("vocabulary"))
    total(lines).write.mode("overwrite").parquet(at("sums"))
    for path in (draft, f"{at('texts')}-draft"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_index(spark: SparkSession, at: Callable[[str], list[str]]) -> SearchIndex:
    """The index whose segments lie in the folders that ``at`` gives for each of PARTS."""
    return SearchIndex(*[spark.read.parquet(*at(part)) for part in PARTS])


def required_terms(query: Query, with_stems: bool = True) -> list[list[tuple[int, list[str]]]]:
    """For each required word or phrase, the (field, words) of which one must stand in the document."""
    wanted = [[t] for t in query.tokens] + query.phrases
    return [[(SURFACE, p), *([(STEM, [stem(w) for w in p])] if with_stems else [])] for p in wanted]


def _rank(counts: list[str], seen: list[int], n: int, length: str, mean: float) -> Column:
    rank = F.lit(0.0)
    for name, n_i in zip(counts, seen):
        idf = max(math.log((n - n_i + 0.5) / (n_i + 0.5)), LEAST_IDF)
        f = F.col(name)
        rank = rank - F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col(length) / F.lit(float(mean))))
    return rank


def _back(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by) if by else places


def _none(index: SearchIndex) -> DataFrame:
    return index.texts.select(*KEY, "date", "kind", F.lit(0.0).alias("rank")).where(F.lit(False))


def word_hits(index: SearchIndex, query: Query, where: SearchFilter = SearchFilter(), with_stems: bool = True) -> DataFrame:
    """``(channel, message_id, date, kind, rank)`` of documents that have every word and phrase, as written or by stem.

    Only postings of the query's words are read. Of loose words the vocabulary knows in how
    many documents each is, so the filter goes to the scan; phrases are counted before it.
    """
    terms = required_terms(query, with_stems)
    if not terms:
        return _none(index)
    singles = list(dict.fromkeys((field, w) for term in terms for field, p in term for w in p))
    words = sorted({w for _, w in singles})
    n, mean, _ = index.totals()
    has_phrase = any(len(p) > 1 for term in terms for _, p in term)
    rows = index.postings.where(is_in(F.col("word"), words))
    if not with_stems:
        rows = rows.where(F.col("field") == SURFACE)
    if not has_phrase:
        rows = where.apply(rows)
    name = {single: f"w{i}" for i, single in enumerate(singles)}
    this = lambda field, word: (F.col("word") == word) & (F.col("field") == field)
    by_doc = rows.groupBy(*KEY, "date", "kind", "dl").agg(
        *[F.max(F.when(this(*s), F.col("f"))).alias(name[s]) for s in singles],
        *[F.max(F.when(this(*s), F.col("places"))).alias(f"p_{name[s]}") for s in singles if has_phrase and any(len(p) > 1 and s[0] == field and s[1] in p for term in terms for field, p in term)],
    )
    counts, hit = [], F.lit(True)
    for t, term in enumerate(terms):
        either = F.lit(False)
        for k, (field, p) in enumerate(term):
            column = f"f{t}_{k}"
            if len(p) == 1:
                f = F.col(name[field, p[0]])
            else:
                # Places of the first word that all others follow at their distance.
                starts = [_back(F.col(f"p_{name[field, w]}"), i) for i, w in enumerate(p)]
                f = F.size(reduce(F.array_intersect, starts))
            by_doc = by_doc.withColumn(column, F.greatest(F.coalesce(f, F.lit(0)), F.lit(0)))
            counts.append((column, (field, p)))
            either = either | (F.col(column) > 0)
        hit = hit & either
    by_doc = by_doc.select(*KEY, "date", "kind", "dl", *[c for c, _ in counts])
    known = {(r["field"], r["word"]): r["n"] for r in index.vocabulary.where(is_in(F.col("word"), words)).groupBy("field", "word").agg(F.sum("documents").alias("n")).collect()}
    if has_phrase:
        seen = Observation()
        by_doc = cut_lineage(by_doc.observe(seen, *[F.count_if(F.col(c) > 0).alias(c) for c, _ in counts]).where(hit))
        found = seen.get
        ranked = where.apply(by_doc)
        n_of = [(found.get(c) or 0) if len(p) > 1 else known.get((field, p[0]), 0) for c, (field, p) in counts]
    else:
        ranked = by_doc.where(hit)
        n_of = [known.get((field, p[0]), 0) for _, (field, p) in counts]
    return ranked.select(*KEY, "date", "kind", _rank([c for c, _ in counts], n_of, n, "dl", mean).alias("rank"))


def _lookup(index: SearchIndex, literal: str) -> DataFrame | None:
    """The texts of documents that may hold ``literal``; None if these are so many that all texts are read.

    Each run of letters and digits of the literal lies within one word of the document: the
    first at the end of a word, the last at its start, those between are whole words.
    """
    runs = words_of(literal)
    if not runs:
        return None
    surface = index.vocabulary.where(F.col("field") == SURFACE)
    inner = runs[1:-1]
    if inner:
        words = surface.where(F.col("word") == max(inner, key=len))
    elif len(runs) == 2:
        words = surface.where(F.endswith("word", F.lit(runs[0])) if len(runs[0]) >= len(runs[1]) else F.startswith("word", F.lit(runs[1])))
    else:
        words = surface.where(F.contains("word", F.lit(runs[0])))
    listed = words.groupBy("word").agg(F.sum("documents").alias("n")).limit(LOOKED_UP_WORDS + 1).collect()
    if len(listed) > LOOKED_UP_WORDS or sum(r["n"] for r in listed) > LOOKED_UP_DOCS:
        return None
    if not listed:
        return index.texts.where(F.lit(False))
    keys = index.postings.where(is_in(F.col("word"), sorted(r["word"] for r in listed)) & (F.col("field") == SURFACE)).select(*KEY).distinct().collect()  # at most LOOKED_UP_DOCS
    return index.texts.where(has_key([tuple(k) for k in keys]))


def substring_hits(index: SearchIndex, query: Query, where: SearchFilter = SearchFilter()) -> DataFrame:
    """The same for documents that hold the typed text literally, case and yo aside; fewer than three characters find nothing."""
    literal = query.literal
    if len(literal) < 3:
        return _none(index)
    n, _, mean = index.totals()
    texts = _lookup(index, literal)
    texts = index.texts if texts is None else texts
    held = texts.where(F.contains("low", F.lit(literal))).select(*KEY, "date", "kind", "grams", F.regexp_count("low", F.lit(f"(?={re.escape(literal)})")).alias("f"))
    seen = Observation()
    held = cut_lineage(held.observe(seen, F.count(F.lit(1)).alias("n")))
    return where.apply(held).select(*KEY, "date", "kind", _rank(["f"], [seen.get.get("n") or 0], n, "grams", mean).alias("rank"))


def hits(index: SearchIndex, text: str, mode: str = "both", where: SearchFilter = SearchFilter(), with_stems: bool = True) -> DataFrame:
    """``(channel, message_id, date, kind, tier, rank)``: word hits (tier 0), then what only the substring search finds (tier 1)."""
    query = parse_query(text)
    if mode == "words":
        return _tier(word_hits(index, query, where, with_stems), 0)
    if mode == "substring":
        return _tier(substring_hits(index, query, where), 0)
    if mode != "both":
        raise ValueError(f"unknown mode {mode!r}")
    words = word_hits(index, query, where, with_stems)
    return _tier(words, 0).unionByName(_tier(substring_hits(index, query, where).join(words.select(*KEY), KEY, "left_anti"), 1))


def _tier(found: DataFrame, tier: int) -> DataFrame:
    return found.select(*KEY, "date", "kind", F.lit(tier).alias("tier"), "rank")


def ordered(found: DataFrame, end: int | None = None) -> DataFrame:
    """Hits in their one order, and no more than ``end`` of them."""
    rows = found.orderBy("tier", F.round("rank", 12), *KEY)
    return rows if end is None else rows.limit(end)


def page_of(index: SearchIndex, text: str, mode: str, where: SearchFilter, offset: int, limit: int, with_stems: bool = True) -> tuple[DataFrame, int]:
    """(rows of a page, total). No more than ``offset + limit`` hits of either kind are ever sorted; substring hits fill a page only where word hits do not."""
    query, end = parse_query(text), offset + limit
    if mode != "both":
        found = cut_lineage(hits(index, text, mode, where, with_stems))
        return ordered(found, end).offset(offset), found.count()
    words = cut_lineage(_tier(word_hits(index, query, where, with_stems), 0))
    tail = cut_lineage(_tier(substring_hits(index, query, where).join(words.select(*KEY), KEY, "left_anti"), 1))
    n = words.count()
    best = ordered(words, end) if n >= end else words.unionByName(ordered(tail, end - n))
    return ordered(best, end).offset(offset), n + tail.count()


def numbered(found: DataFrame) -> tuple[DataFrame, int]:
    """(all hits with their ``place`` in the one order, from 0; total): whoever wants many pages sorts once, and each is a run of places."""
    rows = cut_lineage(ordered(cut_lineage(found)))
    # The sorted partitions are kept, so a row's place is its place within its own behind the rows of those before.
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    counts = dict(rows.groupBy(F.shiftright("__at", 33)).count().collect())  # one row a partition
    before = [0]
    for i in range(max(counts, default=0)):
        before.append(before[-1] + counts.get(i, 0))
    place = F.element_at(F.lit(before), F.shiftright("__at", 33).cast("int") + 1) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("place", place.cast("bigint")).drop("__at"), sum(counts.values())


def document_frequencies(index: SearchIndex, field: int = SURFACE) -> DataFrame:
    """``(word, documents, occurrences)`` of one field of the whole index."""
    return index.vocabulary.where(F.col("field") == field).groupBy("word").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences"))


def stale_documents(index: SearchIndex, posts: DataFrame) -> DataFrame:
    """``(channel, message_id)`` that the index still has though ``posts`` does not."""
    return index.texts.select(*KEY).join(posts.select(*KEY), KEY, "left_anti")

