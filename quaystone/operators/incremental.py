"""Processing only records that are new or changed since the last successful run.

``IncrementalRun`` follows a monotonic commit sequence: the upper limit is fixed
before anything is read, the output goes to a folder of its own, and one manifest
file, created exclusively, makes output and watermark valid together. A run that
fails before leaves a folder that no manifest names, so the next run takes up the
same records, once.

``SyncRun`` does the same for the channels of an archive: each channel has a watermark,
which starts as the last successful walk of the crawl log (lowest and highest message
id, backfill complete or not) and grows with every committed run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.operators.deliveries import order_key


def sync_marks(walks: DataFrame) -> DataFrame:
    """The mark of each channel: its succeeded walk with bounds and the largest finished_at (of equals, the largest walk_id).

    Columns channel, mark_at, low, high, complete. Channels without such a walk have
    no row; duplicate rows change nothing; a null is_backfill_complete counts as false.
    """
    usable = walks.where((F.col("outcome") == "succeeded") & F.col("lowest_message_id").isNotNull() & F.col("highest_message_id").isNotNull() & F.col("finished_at").isNotNull())
    mark = F.struct(
        F.col("finished_at").alias("mark_at"),
        F.col("lowest_message_id").alias("low"),
        F.col("highest_message_id").alias("high"),
        F.coalesce("is_backfill_complete", F.lit(False)).alias("complete"),
    )
    return usable.groupBy("channel").agg(F.max_by(mark, F.struct("finished_at", "walk_id")).alias("m")).select("channel", "m.*")


def content_signature(seed: int) -> Column:
    """64 bits of text, is_edited and deleted_at exactly as stored; two of them with different seeds stand for the content in shuffles."""
    return F.xxhash64(F.lit(seed), F.col("text").isNull(), "text", F.col("is_edited").isNull(), "is_edited", F.col("deleted_at").isNull(), "deleted_at")


def handled_by_log() -> Column:
    """Whether a row joined to the mark of its channel was taken up by that walk: fetched by its end, with an id within its bounds."""
    within = (F.col("message_id") <= F.col("high")) & (F.col("complete") | (F.col("message_id") >= F.col("low")))
    return F.coalesce((F.col("fetched_at") <= F.col("mark_at")) & within, F.lit(False))


def changed_posts(rows: DataFrame, handled: Column) -> DataFrame:
    """``(channel, message_id)`` of posts without a handled row, or whose newest row differs from their newest handled one, once each."""
    rows = rows.select("channel", "message_id", content_signature(1).alias("s1"), content_signature(2).alias("s2"), order_key().alias("__order"), handled.alias("__handled"))
    rows = rows.withColumn("__handled", F.when(F.col("__handled"), F.col("__order")))
    both = rows.groupBy("channel", "message_id").agg(
        F.max_by("s1", "__order").alias("a1"), F.max_by("s2", "__order").alias("a2"), F.max_by("s1", "__handled").alias("b1"), F.max_by("s2", "__handled").alias("b2")
    )
    return both.where(F.col("b1").isNull() | (F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))).select("channel", "message_id")


_POST = ["channel", "message_id", "row_id", "fetched_at", "text", "is_edited", "deleted_at"]


def _rows_of_posts(posts: DataFrame) -> DataFrame:
    return posts.select(*_POST).where(F.col("channel").isNotNull() & F.col("message_id").isNotNull())


def pending_posts(posts: DataFrame, walks: DataFrame) -> DataFrame:
    """``(channel, message_id)`` of each post that the next sync must take up, once each; nothing is committed (see ``SyncRun``).

    A row is handled if it was fetched by the mark's time and its id lies within the
    mark's bounds (all ids up to the highest, once the backfill is complete). A post
    is pending if it has no handled row, or if its newest row differs from its newest
    handled row. All posts of a channel without a mark are pending. Rows without
    channel or message_id are no post. An empty ``walks`` makes every post pending.
    """
    return changed_posts(_rows_of_posts(posts).join(sync_marks(walks), "channel", "left"), handled_by_log())


def pending_counts(pending: DataFrame) -> DataFrame:
    """``(channel, pending, lowest, highest)``: how much a sync of each channel takes up."""
    return pending.groupBy("channel").agg(F.count(F.lit(1)).alias("pending"), F.min("message_id").alias("lowest"), F.max("message_id").alias("highest"))


@dataclass(frozen=True)
class Manifest:
    """A committed state. ``mark`` is the largest sequence value handled, as JSON of its parts; ``outputs`` are valid folders; ``epochs`` are the leases under which it was written, by channel."""

    version: int = 0
    mark: str | None = None
    outputs: list[str] = field(default_factory=list)
    epochs: dict[str, int] = field(default_factory=dict)


def create_once(spark: SparkSession, path: str, text: str) -> None:
    """A new file that appears whole, or FileExistsError: of several writers one succeeds.

    By a rename that never overwrites (atomic on HDFS; object stores without such a rename
    need a file system layer that offers it).
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    draft = hadoop.Path(target.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    never_overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        context.rename(draft, target, never_overwrite)
    except Exception as error:
        fs.delete(draft, False)
        if fs.exists(target):
            raise FileExistsError(f"{path} is there already") from error
        raise


class ManifestLog:
    """Numbered manifest files in a folder of any Hadoop file system; a number is taken once."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self._folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self._folder))

    def versions(self) -> list[int]:
        """All committed versions there still are, in order."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self._folder))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> Manifest:
        numbers = self.versions()
        return self.read(numbers[-1]) if numbers else Manifest()

    def drop(self, version: int) -> None:
        self._fs.delete(self._path(f"{self._folder}/{version:020d}.json"), False)

    def read(self, version: int) -> Manifest:
        stream = self._fs.open(self._path(f"{self._folder}/{version:020d}.json"))
        try:
            text = self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def commit(self, manifest: Manifest) -> None:
        """Make ``manifest`` the latest; FileExistsError if another run took its number."""
        create_once(self._spark, f"{self._folder}/{manifest.version:020d}.json", json.dumps(manifest.__dict__))


class IncrementalRun:
    """Runs ``transform`` over the rows of a source beyond the last committed sequence value.

    ``sequence`` names columns that only grow from commit to commit, most significant
    first; rows where one is null are never due. Results are read with ``output``.
    """

    def __init__(self, spark: SparkSession, folder: str, sequence: list[str]):
        self._spark, self._folder, self._sequence = spark, folder.rstrip("/"), sequence
        self.log = ManifestLog(spark, f"{self._folder}/manifests")

    def _due(self, source: DataFrame, after: str | None, upto: str) -> DataFrame:
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*self._sequence).schema)
        options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
        value = lambda text: F.from_json(F.lit(text), types, options)
        here = F.struct(*self._sequence)
        complete = F.lit(True)
        for name in self._sequence:
            complete = complete & F.col(name).isNotNull()
        due = source.where(complete & (here <= value(upto)))
        if after is not None:
            first = self._sequence[0]
            # The first bound alone reaches the scan as a pushed filter.
            due = due.where((F.col(first) >= value(after)[first]) & (here > value(after)))
        return due

    def run(self, source: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> Manifest:
        """One run; returns the committed manifest, or the present one if nothing is due."""
        state = self.log.latest()
        options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
        rows = source.dropna(subset=self._sequence)
        upto = rows.agg(F.to_json(F.max(F.struct(*self._sequence)), options).alias("upto")).first()["upto"]
        if upto is None or upto == state.mark:
            return state
        out = f"{self._folder}/data/{state.version + 1:020d}-{uuid.uuid4().hex}"
        transform(self._due(source, state.mark, upto)).write.parquet(out)
        done = Manifest(state.version + 1, upto, [*state.outputs, out])
        self.log.commit(done)
        return done

    def output(self) -> DataFrame | None:
        """All committed results; None before the first run."""
        outputs = self.log.latest().outputs
        return self._spark.read.parquet(*outputs) if outputs else None


class SyncRun:
    """Runs that take up the posts of all channels that are new or changed since each channel's watermark.

    A run first writes the upper limit of each channel, the newest (fetched_at, row_id)
    there is now; rows that come later belong to the next run. Then it writes the posts
    that are due, and last one manifest makes both valid together. A run that fails
    before that leaves folders that no manifest names: the next one takes up the same
    posts, once. A row without fetched_at has no place in the sequence: only a channel's
    first run takes it up.
    """

    def __init__(self, spark: SparkSession, folder: str, walks: DataFrame):
        self._spark, self._folder, self._walks = spark, folder.rstrip("/"), walks
        self.log = ManifestLog(spark, f"{self._folder}/manifests")

    def _of(self, state: Manifest, kind: str) -> list[str]:
        return [path for name, _, path in (entry.partition("=") for entry in state.outputs) if name == kind]

    def watermarks(self) -> DataFrame:
        """``(channel, lowest_message_id, highest_message_id, is_backfill_complete, done)`` after the last committed run; ``done`` orders the rows that were handled."""
        return self._marks(self.log.latest()).select("channel", "lowest_message_id", "highest_message_id", "is_backfill_complete", "done")

    def _marks(self, state: Manifest) -> DataFrame:
        stored = self._of(state, "marks")
        if stored:
            return self._spark.read.parquet(stored[-1])
        marks = sync_marks(self._walks)
        return marks.select("*", F.col("low").alias("lowest_message_id"), F.col("high").alias("highest_message_id"), F.col("complete").alias("is_backfill_complete"), F.lit(None).cast("decimal(38,0)").alias("done"))

    def run(self, posts: DataFrame, before_commit: Callable[[], None] | None = None) -> Manifest:
        """One run; returns the committed manifest, or the present one if there is no row beyond it. ``before_commit`` may raise to give the run up."""
        state = self.log.latest()
        rows = _rows_of_posts(posts)
        name = f"{state.version + 1:012d}-{uuid.uuid4().hex}"
        marks, out = f"{self._folder}/marks/{name}", f"{self._folder}/posts/{name}"
        limits = rows.groupBy("channel").agg(F.max(order_key()).cast("decimal(38,0)").alias("upto"), F.min("message_id").alias("first"), F.max("message_id").alias("last"))
        known = self._marks(state).drop("before").withColumnRenamed("done", "before")
        merged = known.join(limits, "channel", "full_outer")
        merged.select(
            "channel", "mark_at", "low", "high", "complete", "before",
            F.greatest("before", "upto").alias("done"),
            F.least("lowest_message_id", "first").alias("lowest_message_id"),
            F.greatest("highest_message_id", "last").alias("highest_message_id"),
            F.coalesce("is_backfill_complete", F.lit(False)).alias("is_backfill_complete"),
        ).write.parquet(marks)
        fixed = self._spark.read.parquet(marks)
        upto = str(fixed.agg(F.max("done")).first()[0])
        if upto in ("None", state.mark):
            return state
        key = order_key()
        due = rows.join(fixed.select("channel", "mark_at", "low", "high", "complete", "before", "done"), "channel").where(key <= F.col("done"))
        changed_posts(due, handled_by_log() | F.coalesce(key <= F.col("before"), F.lit(False))).write.parquet(out)
        if before_commit:
            before_commit()
        done = Manifest(state.version + 1, upto, [*[e for e in state.outputs if not e.startswith("marks=")], f"posts={out}", f"marks={marks}"])
        self.log.commit(done)
        return done

    def output(self, version: int | None = None) -> DataFrame:
        """``(channel, message_id)`` put out by one committed run, by default the last; nothing before the first."""
        paths = self._of(self.log.latest(), "posts")
        if not paths:
            return self._spark.createDataFrame([], "channel string, message_id bigint")
        return self._spark.read.parquet(paths[(version or len(paths)) - 1])
