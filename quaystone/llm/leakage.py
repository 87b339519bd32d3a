"""Evaluation passages inside training documents, found by Wu-Manber search over words.

The patterns are all runs of ``words`` consecutive words of the test items. A table
of two-word blocks tells how far the window may move on; only where the block ends
some pattern does the hash of its last words select the patterns that are compared
word by word. Most windows move by ten words or so without any comparison.
"""

import pickle
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.session import shared_folder

#: Items of one table (some 10 MB for every thousand): a task holds one table at a time.
BLOCK = 5000
#: Characters of documents that a task searches with one table after another.
HELD = 16 << 20

_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, accents composed, in lower case."""
    return _WORDS.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())


class WordSearch:
    """Wu-Manber tables for patterns of ``length`` words, each with the ids it stands for."""

    BLOCK = 2
    SUFFIX = 5

    def __init__(self, items: list[tuple[int, str]], length: int):
        if length < self.SUFFIX:
            raise ValueError(f"patterns need at least {self.SUFFIX} words")
        self.length = length
        patterns: dict[tuple[str, ...], list[int]] = {}
        for item, text in items:
            found = words_of(text)
            for i in range(len(found) - length + 1):
                ids = patterns.setdefault(tuple(found[i : i + length]), [])
                if item not in ids:
                    ids.append(item)
        #: How far the window may move for a block; a block in no pattern lets it pass the block.
        self.far = length - self.BLOCK + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.buckets: dict[tuple[str, ...], list[tuple[list[str], list[int]]]] = {}
        for pattern, ids in patterns.items():
            for end in range(self.BLOCK, length + 1):
                block = pattern[end - self.BLOCK : end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.buckets.setdefault(pattern[-self.SUFFIX :], []).append((list(pattern), ids))

    def find(self, text: str) -> list[int]:
        """Ids of the items of which ``text`` holds a pattern, in order."""
        return sorted(self.find_words(words_of(text)))

    def find_words(self, words: list[str]) -> set[int]:
        length, far = self.length, self.far
        shift, buckets, suffix = self.shift.get, self.buckets.get, self.SUFFIX
        found: set[int] = set()
        end, n = length - 1, len(words)
        while end < n:
            step = shift((words[end - 1], words[end]), far)
            if step:
                end += step
                continue
            for pattern, ids in buckets(tuple(words[end - suffix + 1 : end + 1]), ()):
                if words[end - length + 1 : end + 1] == pattern:
                    found.update(ids)
            end += 1
        return found


def _builder(folder: str, words: int) -> Callable:
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        table = WordSearch(list(zip(rows["item"].tolist(), rows["text"])), words)
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        # Each attempt of a task has a file of its own; the one that counts is named in the result.
        name = f"table-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{base}/{name}") as out:
            out.write(pickle.dumps(table, protocol=pickle.HIGHEST_PROTOCOL))
        return pd.DataFrame({"name": [name]})

    return build


def build_tables(items: DataFrame, item_id: str, item_text: str, words: int, block: int) -> tuple[str, list[str]]:
    """(folder, names) of search tables of about ``block`` items each, built by tasks into the shared folder.

    Only the names come to the driver. pyarrow must be able to open the folder (a shared
    mount, HDFS, S3 or GCS).
    """
    spark = items.sparkSession
    folder = shared_folder(spark, f"leakage-{uuid.uuid4().hex}")
    folder = folder if "://" in folder else folder.replace("file:", "file://", 1)
    rows = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).alias("text"))
    blocks = -(-rows.count() // block)
    if not blocks:
        return folder, []
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    built = rows.withColumn("block", part).groupBy("block").applyInPandas(_builder(folder, words), "name string")
    return folder, sorted(r["name"] for r in built.collect())


_loaded: tuple[str, WordSearch] | None = None


def _table(folder: str, name: str) -> WordSearch:
    """A table from the shared folder; a worker keeps the last one."""
    global _loaded
    if _loaded is None or _loaded[0] != f"{folder}/{name}":
        _loaded = None  # the old one goes before the next comes
        system, base = fs.FileSystem.from_uri(folder)
        with system.open_input_stream(f"{base}/{name}") as data:
            _loaded = (f"{folder}/{name}", pickle.loads(data.read()))
    return _loaded[1]


def _searcher(folder: str, names: list[str], schema: pa.Schema) -> Callable:
    def rows(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], schema[0].type), pa.array([p[1] for p in pairs], schema[1].type)], schema=schema)

    def search_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _table(folder, names[0]).find
        for batch in batches:
            yield rows([(doc, item) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for item in find(text)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list = []
        split: list[list[str]] = []
        held = 0

        def found() -> pa.RecordBatch:
            hits: list[set[int]] = [set() for _ in docs]
            for name in names:
                table = _table(folder, name)
                for hit, words in zip(hits, split):
                    hit |= table.find_words(words)
            return rows([(doc, item) for doc, hit in zip(docs, hits) for item in sorted(hit)])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc)
                split.append(words_of(text))
                held += len(text)
                if held >= HELD:
                    yield found()
                    docs, split, held = [], [], 0
        if docs:
            yield found()

    return search_one if len(names) == 1 else search


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 12, block: int = BLOCK) -> DataFrame:
    """``(doc_id, item_id)``: documents that hold ``words`` consecutive words of an item as consecutive words, once each.

    The items are the stated query set: tasks build tables of ``block`` items each into
    the shared folder. Documents are read once; a task takes some 16 MB of them at a time
    through all tables, one after another. Documents are read whole, nothing is shuffled
    but repeated result rows. Null and empty texts, and items of fewer words, match nothing.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    folder, names = build_tables(items, item_id, item_text, words, block)
    kept = documents.where(F.col(text).isNotNull()).select(F.col(doc_id), F.col(text))
    out = T.StructType([T.StructField(doc_id, kept.schema[0].dataType), T.StructField(item_id, items.schema[item_id].dataType)])
    return kept.mapInArrow(_searcher(folder, names, to_arrow_schema(out)), out).distinct()


def leaks_by_item(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, suite, lang, documents)``: each item that leaked and the number of documents that hold it."""
    found = leaks(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.select("item_id", "suite", "lang").join(found, "item_id")
