"""The archive as immutable snapshots under a manifest.

Every write makes a new generation: its tables are written first, then one manifest
file is created exclusively and makes them valid together. Readers hold on to the
generation they opened and see nothing half written.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quaystone.functions.text import similar_text, similar_texts
from quaystone.operators.incremental import Manifest, ManifestLog
from quaystone.operators.index import PARTS, SearchIndex, read_index, write_parts
from quaystone.session import at_once

#: Writes rows to the folder it is given.
Writer = Callable[[str], None]

SCHEMA_VERSION = 1
KEY = ["channel", "message_id"]
# Kinds of posts, sources of formatting, and how a channel can be reached.
KINDS = frozenset("text photo album video videoNote audio voice document poll sticker location giveaway unknown".split())
FORMAT_SOURCES = frozenset("tdlib web absent export".split())
REACHABILITY = frozenset("webPreview previewDisabled group unresolvable".split())


def known_reachability(column: str = "reachability"):
    """The stored value, or null if it is none we know."""
    return F.when(F.col(column).isin(*sorted(REACHABILITY)), F.col(column))


def keep_existing(stored: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """``stored`` and those rows of ``new`` whose key it lacks; of repeated new keys one row stays."""
    return stored.unionByName(new.dropDuplicates(key).join(stored.select(*key), key, "left_anti").select(*stored.columns))


def replace_existing(stored: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """All of ``new``, and those rows of ``stored`` whose key it lacks."""
    return stored.join(new.select(*key), key, "left_anti").select(*stored.columns).unionByName(new.dropDuplicates(key).select(*stored.columns))


def written_and_kept(stored: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """``(written, kept)`` of an import that keeps existing posts."""
    there = stored.select(*key).distinct().withColumn("there", F.lit(1))
    rows = new.select(*key).distinct().join(there, key, "left")
    return rows.agg(F.count_if(F.col("there").isNull()).alias("written"), F.count_if(F.col("there").isNotNull()).alias("kept"))


class IdentityConflict(ValueError):
    """A name and a chat that cannot belong together."""


CHANNEL = "channel string, raw_channel_id bigint, title string, subscriber_count bigint, reachability string, lowest_message_id bigint, highest_message_id bigint, is_backfill_complete boolean, last_synced_at timestamp"
#: A channel's number that no source has told yet; it matches any.
UNKNOWN_ID = 0


def upsert_channels(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored channels with number, title, subscribers and reachability of ``new`` written over; marks of a crawl stay. Unknown channels are added."""
    told = ["raw_channel_id", "title", "subscriber_count", "reachability"]
    rest = [c for c in stored.columns if c not in ("channel", *told)]
    rows = stored.withColumn("__old", F.lit(True)).join(new.select("channel", *[F.col(c).alias(f"__{c}") for c in told], F.lit(True).alias("__new")).dropDuplicates(["channel"]), "channel", "full_outer")
    kept = [F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in told]
    return rows.select("channel", *kept, *rest).select(*stored.columns)


def ensured_channels(stored: DataFrame, names: DataFrame, reachability: str) -> DataFrame:
    """``stored`` and a row for each of ``names`` (a column channel) it lacks, with no number yet; a channel that is there stays as it is."""
    new = names.select("channel").where(F.col("channel").isNotNull()).distinct().join(stored.select("channel"), "channel", "left_anti")
    new = new.withColumn("raw_channel_id", F.lit(UNKNOWN_ID).cast("bigint")).withColumn("reachability", F.lit(reachability))
    return stored.unionByName(new, allowMissingColumns=True)


def identified(stored: DataFrame, learned: DataFrame) -> DataFrame:
    """``stored`` with number and reachability of ``learned`` (channel, raw_channel_id, reachability) and nothing else changed; unknown channels are not added."""
    new = learned.select("channel", F.col("raw_channel_id").alias("__id"), F.col("reachability").alias("__reach"), F.lit(True).alias("__new")).dropDuplicates(["channel"])
    rows = stored.join(new, "channel", "left")
    put = {"raw_channel_id": "__id", "reachability": "__reach"}
    return rows.select(*[F.when(F.col("__new"), F.col(put[c])).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in stored.columns])


def refuse_group(channels: DataFrame, username: str) -> None:
    """Raise if a crawl would write to a channel that was imported as a group: a group never becomes a channel."""
    if channels.where((F.col("channel") == username) & (F.col("reachability") == "group")).limit(1).count():
        raise IdentityConflict(f"{username} is a group and cannot be crawled")


def refuse_other_chat(channels: DataFrame, username: str, raw_id: int | None) -> None:
    """Raise if ``username`` is stored as another chat than ``raw_id``, or that chat under another name."""
    if raw_id is None:
        return
    rows = channels.where((F.col("channel") == username) | (F.col("raw_channel_id") == raw_id)).select("channel", "raw_channel_id").limit(3).collect()
    for row in rows:
        if row["channel"] == username and row["raw_channel_id"] not in (None, UNKNOWN_ID, raw_id):
            raise IdentityConflict(f"{username} is stored as chat {row['raw_channel_id']}, not {raw_id}")
        if row["channel"] != username and row["raw_channel_id"] == raw_id:
            raise IdentityConflict(f"chat {raw_id} is stored under {row['channel']}")


def claim_identity(channels: DataFrame, posts: DataFrame, username: str, raw_id: int | None, new: DataFrame, replace: bool = False) -> DataFrame:
    """``channels`` after an import of ``new`` posts has claimed ``username`` as a group, or IdentityConflict.

    Refused are a crawled channel, another number for the name, and a number stored under
    another name. A history without a number that the claim would give one must be the
    history of ``new``: no shared message may disagree, and one must agree unless ``replace``.
    Without ``raw_id`` the stored number stays.
    """
    known = channels.where(F.col("channel") == username).select("raw_channel_id", "reachability").first()
    if known and known["reachability"] == "webPreview":
        raise IdentityConflict(f"{username} is crawled and takes no import")
    refuse_other_chat(channels, username, raw_id)
    mine = posts.where(F.col("channel") == username)
    if known and raw_id is not None and known["raw_channel_id"] in (None, UNKNOWN_ID) and mine.limit(1).count():
        seen = confirm_history(mine, new.where(F.col("channel") == username)).first()
        if seen["disagree"]:
            raise IdentityConflict(f"{seen['disagree']} stored messages of {username} are not those of the import")
        if not seen["agree"] and not replace:
            raise IdentityConflict(f"no stored message of {username} confirms that the import is the same chat")
    row = channels.sparkSession.createDataFrame([(username,)], "channel string")
    ensured = ensured_channels(channels, row, "group")
    is_it = F.col("channel") == username
    number = F.col("raw_channel_id") if raw_id is None else F.when(is_it, F.lit(raw_id).cast("bigint")).otherwise(F.col("raw_channel_id"))
    return ensured.withColumn("reachability", F.when(is_it, "group").otherwise(F.col("reachability"))).withColumn("raw_channel_id", number)


def compared_posts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``(channel, message_id, near, neutral, same)`` of ids that both have: dates within a second; an edited or a wordless pair, whose words prove nothing; equal words."""
    pairs = stored.select(*KEY, F.col("date").alias("d1"), F.col("text").alias("t1"), F.col("is_edited").alias("e1")).join(new.select(*KEY, F.col("date").alias("d2"), F.col("text").alias("t2"), F.col("is_edited").alias("e2")), KEY)
    near = F.abs(F.unix_millis("d1") - F.unix_millis("d2")) < 1000
    wordless = ~F.coalesce(F.col("t1"), F.lit("")).rlike(r"[\p{L}\p{N}]") & ~F.coalesce(F.col("t2"), F.lit("")).rlike(r"[\p{L}\p{N}]")
    neutral = F.coalesce(F.col("e1"), F.lit(False)) | F.coalesce(F.col("e2"), F.lit(False)) | wordless
    return pairs.select(*KEY, F.coalesce(near, F.lit(False)).alias("near"), neutral.alias("neutral"), similar_texts(F.col("t1"), F.col("t2")).alias("same"))


def confirm_history(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``(agree, disagree)`` of ``compared_posts``."""
    agree = F.col("near") & ~F.col("neutral") & F.col("same")
    return compared_posts(stored, new).agg(F.count_if(agree).alias("agree"), F.count_if(~F.col("near") | (~F.col("neutral") & ~F.col("same"))).alias("disagree"))


def verification_candidates(posts: DataFrame, zone: str, newest: int = 3) -> DataFrame:
    """``(why, message_id)``: posts to look up on the live source before an import: the newest with text and without, the first of each UTC offset that the zone had, the oldest and the middle one."""
    latest = lambda part, why: part.orderBy(F.desc("date"), F.desc("message_id")).limit(newest).select(F.lit(why).alias("why"), "message_id")
    worded = F.coalesce(F.col("text"), F.lit("")) != ""
    recent = latest(posts.where(worded), "text").unionByName(latest(posts.where(~worded), "media"))
    offset = (F.unix_seconds(F.from_utc_timestamp("date", zone)) - F.unix_seconds("date")).alias("offset")
    first = posts.select(offset, F.struct("date", "message_id").alias("at")).groupBy("offset").agg(F.min("at").alias("at"))
    probes = first.select(F.lit("offset").alias("why"), F.col("at.message_id").alias("message_id"))
    oldest = posts.agg(F.min_by("message_id", F.struct("date", "message_id")).alias("message_id")).where(F.col("message_id").isNotNull()).select(F.lit("oldest").alias("why"), "message_id")
    # Half of the posts are older than the middle one (found by a sketch, exact up to some thousand posts).
    n = posts.count()
    at = posts.agg(F.percentile_approx(F.unix_micros("date"), (n // 2 + 0.5) / n if n else 0.5, 10_000)).first()[0]
    later = posts.where(F.unix_micros("date") >= F.lit(at)) if at is not None else posts.where(F.lit(False))
    middle = later.agg(F.min_by("message_id", F.struct("date", "message_id")).alias("message_id")).where(F.col("message_id").isNotNull()).select(F.lit("middle").alias("why"), "message_id")
    return reduce(DataFrame.unionByName, [recent, probes, oldest, middle])


class NotVerified(ValueError):
    """An export that the live source does not bear out."""


def verify_export(posts: DataFrame, channel: str, zone: str, look_up: Callable[[int], dict | None]) -> int:
    """The chat's number, after the live source has borne out some posts of an export.

    ``look_up(message_id)`` gives text, date and raw_channel_id of the live message, None
    for one that is gone, and raises if it got no answer. One of the newest posts must be
    there; it and every probe that is there must have the same words (if it has any), the
    same second and a number. A date that is off means that the zone is wrong.
    """
    order = {"text": 0, "media": 1, "offset": 2, "oldest": 3, "middle": 4}
    rows = sorted(verification_candidates(posts, zone).collect(), key=lambda r: (order[r["why"]], -r["message_id"]))  # a handful
    ids = list(dict.fromkeys(r["message_id"] for r in rows))
    stored = {r["message_id"]: r for r in posts.where(F.col("message_id").isin(ids)).select("message_id", "text", F.unix_seconds("date").alias("second")).collect()}

    def probe(id_: int) -> int | None:
        live = look_up(id_)
        if live is None:
            return None
        if live["text"] and not similar_text(live["text"], stored[id_]["text"] or ""):
            raise NotVerified(f"{channel}/{id_} says something else on the live source")
        off = stored[id_]["second"] - int(live["date"].timestamp())
        if off:
            raise NotVerified(f"{channel}/{id_} is off by {off} seconds: {zone} is not the zone of the export")
        if live["raw_channel_id"] is None:
            raise NotVerified(f"{channel}/{id_} names no chat")
        return live["raw_channel_id"]

    found, number = None, None
    for row in rows:
        if row["why"] in ("text", "media") and number is None:
            number = probe(row["message_id"])
            found = row["message_id"]
    if number is None:
        raise NotVerified(f"none of the newest posts of {channel} is on the live source")
    for id_ in dict.fromkeys(r["message_id"] for r in rows if r["why"] not in ("text", "media") and r["message_id"] != found):
        probe(id_)
    return number


class Outdated(RuntimeError):
    """Another writer has committed since this archive was opened: read again and repeat."""


class Archive:
    """A folder of generations. ``open`` pins the latest; ``commit`` adds one."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")
        self._log = ManifestLog(spark, f"{self._folder}/manifests")
        # Schemas of the folders written here, which need not be asked of their files again.
        self._schemas: dict[str, StructType] = {}
        self._pinned = self._log.latest()
        self._check()

    def _check(self) -> None:
        if self._pinned.mark not in (None, str(SCHEMA_VERSION)):
            raise ValueError(f"archive has schema {self._pinned.mark}, this reads {SCHEMA_VERSION}")

    @property
    def session(self) -> SparkSession:
        return self._spark

    @property
    def folder(self) -> str:
        return self._folder

    @property
    def generation(self) -> int:
        return self._pinned.version

    def refresh(self) -> int:
        self._pinned = self._log.latest()
        self._check()
        return self._pinned.version

    def tables(self) -> dict[str, list[str]]:
        return _tables(self._pinned)

    def read(self, name: str) -> DataFrame:
        if name not in self.tables():
            raise LookupError(f"archive has no table {name!r}")
        paths = self.tables()[name]
        known = self._schemas.get(paths[0])
        return (self._spark.read.schema(known) if known else self._spark.read).parquet(*paths)

    def commit(self, tables: dict[str, DataFrame | Writer] | None = None, before: Callable[[], None] | None = None, append: dict[str, DataFrame | Writer] | None = None, lease=None) -> int:
        """The next generation after the one opened: ``tables`` are replaced, rows of ``append`` added as further files, all else carries over.

        Instead of rows a function may be given that writes them to a folder. ``before``
        runs right before the manifest. If any other commit came since this archive was
        opened, or the ``lease`` is not the latest, it raises and leaves nothing valid:
        what was computed from an older generation never overwrites a newer one.
        """
        state = self._pinned
        entries = [e for e in state.outputs if e.partition("=")[0] not in (tables or {})]
        writes: list[Callable[[], None]] = []
        for name, rows in [*(tables or {}).items(), *(append or {}).items()]:
            path = f"{self._folder}/data/{name}-{state.version + 1:012d}-{uuid.uuid4().hex[:8]}"
            entries.append(f"{name}={path}")
            if isinstance(rows, DataFrame):
                self._schemas[path] = rows.schema
                writes.append(lambda rows=rows, path=path: rows.write.parquet(path))
            else:
                writes.append(lambda rows=rows, path=path: rows(path))
        at_once(writes)
        epochs = dict(state.epochs)
        if lease is not None:
            lease.check()
            if lease.epoch < epochs.get(lease.channel, 0):
                raise Outdated(f"{lease.channel} was written under a later lease")
            epochs[lease.channel] = lease.epoch
        if before:
            before()
        try:
            self._log.commit(Manifest(state.version + 1, str(SCHEMA_VERSION), entries, epochs))
        except FileExistsError as error:
            raise Outdated(f"generation {state.version + 1} was committed by another writer") from error
        return self.refresh()

    def transact(self, change: Callable[[Archive], int], attempts: int = 5) -> int:
        """Run ``change``, which reads and commits, again on the newest generation whenever another writer was faster."""
        for left in range(attempts - 1, -1, -1):
            try:
                return change(self)
            except Outdated:
                if not left:
                    raise
                self.refresh()
        raise AssertionError

    def vacuum(self, keep: int = 2, older_than: float = 86_400.0, clock: Callable[[], float] = time.time) -> list[str]:
        """Delete the manifests of all but the last ``keep`` generations, and the folders that no manifest left names.

        That removes replaced tables and what failed commits have left. Folders touched in
        the last ``older_than`` seconds stay, as a commit may be writing them. Returns what was deleted.
        """
        versions = self._log.versions()
        for version in versions[: -keep or None]:
            self._log.drop(version)
        named = {path.partition("=")[2].rpartition("/")[2] for version in versions[-keep:] for path in self._log.read(version).outputs}
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/data")
        fs = path.getFileSystem(self._spark._jsc.hadoopConfiguration())
        gone = []
        for status in fs.listStatus(path) if fs.exists(path) else ():
            name = status.getPath().getName()
            if name not in named and clock() - status.getModificationTime() / 1000 > older_than:
                fs.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)

    def index(self) -> SearchIndex | None:
        """The search index of the pinned generation; None if it has none."""
        if any(f"index_{part}" not in self.tables() for part in PARTS):
            return None
        return read_index(self._spark, lambda part: self.tables()[f"index_{part}"])

    @contextmanager
    def draft(self, rows: DataFrame) -> Iterator[DataFrame]:
        """``rows`` in files, to be read several times; the files go with the block, or with ``vacuum`` after a crash."""
        path = f"{self._folder}/data/draft-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        try:
            yield self._spark.read.schema(rows.schema).parquet(path)
        finally:
            folder = self._spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(folder, True)

    def index_writers(self, searchable: DataFrame, small: bool = False, ranged: bool = True) -> dict[str, Writer]:
        """What a commit takes to write the index of ``searchable`` with the rows it belongs to: as ``tables`` a whole index, as ``append`` one more segment; for ``small`` and ``ranged`` see ``write_parts``."""
        base = f"{self._folder}/data/draft-{uuid.uuid4().hex}"
        written: list[bool] = []
        one = threading.Lock()

        def write(part: str, path: str) -> None:
            with one:
                if not written:
                    write_parts(searchable, lambda p: f"{base}/{p}", small=small, ranged=ranged)
                    written.append(True)
            source = self._spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{part}")
            source.getFileSystem(self._spark._jsc.hadoopConfiguration()).rename(source, self._spark._jvm.org.apache.hadoop.fs.Path(path))

        return {f"index_{part}": (lambda path, part=part: write(part, path)) for part in PARTS}

    def compact(self, name: str) -> int:
        """One folder for a table that many appends have made of small ones."""
        return self.commit({name: self.read(name)})

    def health(self) -> dict[str, bool]:
        """Whether the folder takes writes, and whether each table of the pinned generation answers."""
        out = {"writable": self._writable()}
        for name in self.tables():
            try:
                self.read(name).limit(1).count()
                out[name] = True
            except Exception:  # noqa: BLE001 - the answer is the health
                out[name] = False
        return out

    def _writable(self) -> bool:
        try:
            path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/.probe-{uuid.uuid4().hex}")
            fs = path.getFileSystem(self._spark._jsc.hadoopConfiguration())
            fs.create(path, False).close()
            return bool(fs.delete(path, False))
        except Exception:  # noqa: BLE001 - the answer is the health
            return False


def _tables(manifest: Manifest) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for entry in manifest.outputs:
        name, _, path = entry.partition("=")
        out.setdefault(name, []).append(path)
    return out
