"""The three read operations, over one generation of an archive."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quaystone.functions.predicates import has_key
from quaystone.functions.text import day_after, parse_bound, parse_reference
from quaystone.functions.urls import canonical_url
from quaystone.operators import links as link_ops
from quaystone.operators import search as search_ops
from quaystone.operators.index import SearchIndex, page_of, write_index
from quaystone.operators.integrity import post_counts
from quaystone.operators.records import hydrated, summaries
from quaystone.paging import BadCursor, Cursor, fingerprint, next_cursor
from quaystone.session import cut_lineage, shared_folder
from quaystone.sources.archive import Archive

MAX_PAGE, DEFAULT_PAGE = 100, 20
KEY = ["channel", "message_id"]


class ToolError(ValueError):
    """Arguments that a caller can put right."""


@dataclass
class Page:
    hits: list[Row]
    total: int
    next_cursor: str | None
    index_moved: bool = False


@dataclass
class ArchiveReader:
    """Reads of posts (newest rows), links, reactions and resolutions; all operations of one reader see the same generation.

    Tables are those of the archive with ``date`` as a timestamp. ``stored`` is the index
    of that generation; without one it is written to the shared folder, once a reader.
    """

    posts: DataFrame
    links: DataFrame
    reactions: DataFrame
    resolutions: DataFrame
    generation: int = 0
    stored: SearchIndex | None = field(default=None, repr=False)

    @property
    def index(self) -> SearchIndex:
        if self.stored is None:
            previews = self.links.select(*KEY, "preview.title", "preview.description")
            folder = shared_folder(self.posts.sparkSession, f"reader-{uuid.uuid4().hex}")
            self.stored = write_index(search_ops.searchable(self.posts, previews), lambda part: f"{folder}/{part}")
        return self.stored

    def search_posts(self, query: str, channel: str | None = None, kind: str | None = None, since: str | None = None, until: str | None = None, mode: str = "both", limit: int = DEFAULT_PAGE, cursor: str | None = None) -> Page:
        """A page of post summaries, words first, with the total and the cursor of the next page."""
        try:
            search_ops.refuse_operators(query)
            where = filter_of(channel, kind, since, until)
            if mode not in ("words", "substring", "both"):
                raise ValueError(f"mode is words, substring or both, not {mode!r}")
        except ValueError as error:
            raise ToolError(str(error)) from None
        print_ = query_fingerprint(query, mode, where)
        limit, at = self._place(limit, cursor, print_)
        rows, total = page_of(self.index, query, mode, where, at.offset, limit)
        return self._answer(self._summaries(rows.select(*KEY)) if limit else [], total, at, print_)

    def _place(self, limit: int, cursor: str | None, print_: str) -> tuple[int, Cursor]:
        return min(max(limit, 0), MAX_PAGE), Cursor.decode(cursor, print_) if cursor else Cursor(0, print_, self.generation)

    def _answer(self, shown: list[Row], total: int, at: Cursor, print_: str) -> Page:
        return Page(shown, total, next_cursor(at.offset, len(shown), total, print_, self.generation), at.generation != self.generation)

    def _summaries(self, rows: DataFrame) -> list[Row]:
        keys = [tuple(r) for r in rows.collect()]  # at most MAX_PAGE
        found = {(r["channel"], r["message_id"]): r for r in summaries(self._records(keys)).collect()}
        return [found[k] for k in keys if k in found]

    def _records(self, keys: list[tuple[str, int]]) -> DataFrame:
        """Whole records of the posts of one page; the keys are literals, so they reach the scans."""
        return hydrated(self.posts.where(has_key(keys)), self.links.where(has_key(keys)), self.reactions.where(has_key(keys)))

    def find_links(self, url: str, limit: int = DEFAULT_PAGE, cursor: str | None = None) -> Page:
        """A page of links to the same resource as ``url``, with their posts; a cursor survives a new resolution and says that the index moved."""
        if not url.strip():
            raise ToolError("url is empty")
        print_ = fingerprint("links", canonical_url(url) or url)
        limit, at = self._place(limit, cursor, print_)
        found = cut_lineage(link_ops.links_to(self.links, self.resolutions, url).dropDuplicates(["link_id"]))
        rows = found.orderBy(*KEY, "ord", "link_id").limit(at.offset + limit).offset(at.offset)
        keys = [tuple(r) for r in rows.select(*KEY).collect()]  # at most MAX_PAGE
        shown = link_ops.link_hits(rows, self.posts.where(has_key(keys))).orderBy(*KEY, "ord").collect() if keys else []
        return self._answer(shown, found.count(), at, print_)

    def get_post(self, post: str) -> Row | None:
        """One whole record by ``name/7``, ``@name/7`` or address; None if there is none."""
        key = parse_reference(post)
        if key is None:
            raise ToolError(f"not a post: {post!r}")
        return self._records([key]).first()


def filter_of(channel: str | None, kind: str | None, since: str | None, until: str | None) -> search_ops.SearchFilter:
    """The filter of a request; a whole day as ``until`` ends before the next one begins."""
    start = parse_bound(since)[0] if since else None
    end, whole = parse_bound(until) if until else (None, False)
    name = channel.lstrip("@").lower() if channel else None
    return search_ops.SearchFilter(name, kind, start, None if whole else end, day_after(end) if whole and end else None)


def query_fingerprint(query: str, mode: str, where: search_ops.SearchFilter) -> str:
    """What a cursor of this search carries; equivalent spellings of a query share it."""
    parsed = search_ops.parse_query(query)
    return fingerprint("search", repr((parsed.phrases, sorted(parsed.tokens), parsed.literal)), mode, *[None if x is None else str(x) for x in (where.channel, where.kind, where.since, where.until, where.before)])


def open_reader(archive: Archive) -> ArchiveReader:
    """A reader of the archive's opened generation with its index; an archive without resolutions has resolved none."""
    spark = archive.session
    known = archive.tables()
    resolutions = archive.read("url_resolution") if "url_resolution" in known else spark.createDataFrame([], "url_canonical string, resolved_canonical string, http_status string, hops int, resolved_at timestamp")
    return ArchiveReader(archive.read("post"), archive.read("link"), archive.read("reaction"), resolutions, archive.generation, archive.index())


#: The tools by name: what each does, its arguments with their types, and those that must be given.
TOOLS = {
    "search_posts": ("Ranked search of the archive.", {"query": str, "channel": str, "kind": str, "since": str, "until": str, "mode": str, "limit": int, "cursor": str}, ("query",)),
    "find_links": ("Posts that link to a resource, whatever address they give it.", {"url": str, "limit": int, "cursor": str}, ("url",)),
    "get_post": ("One post with everything that belongs to it.", {"post": str}, ("post",)),
}


def tool_schemas() -> list[dict]:
    """The tools as JSON schemas; arguments beyond these are not allowed."""
    kinds = {str: "string", int: "integer"}
    return [{"name": name, "description": what, "inputSchema": {"type": "object", "properties": {a: {"type": kinds[t]} for a, t in args.items()}, "required": list(must), "additionalProperties": False}} for name, (what, args, must) in TOOLS.items()]


def call_tool(reader: ArchiveReader, name: str, arguments: dict) -> Page | Row | None:
    """One call by name. An unknown tool is a LookupError of the caller's program; bad arguments are a ToolError that says which."""
    if name not in TOOLS:
        raise LookupError(f"no tool {name!r}")
    _, args, must = TOOLS[name]
    unknown = sorted(set(arguments) - set(args))
    if unknown:
        raise ToolError(f"unknown argument {unknown[0]!r}; {name} takes {', '.join(args)}")
    for a, value in arguments.items():
        if type(value) is not args[a]:
            raise ToolError(f"{a} must be {'a whole number' if args[a] is int else 'text'}, not {value!r}")
    for a in must:
        if a not in arguments:
            raise ToolError(f"{name} needs {a!r}")
    try:
        return getattr(reader, name)(**arguments)
    except BadCursor as error:
        raise ToolError(str(error)) from None


def instructions(reader: ArchiveReader) -> str:
    """What a caller should know at the start: the channels and how many posts each has."""
    counts = post_counts(reader.posts).orderBy(F.desc("posts"), "channel").collect()  # one row a channel
    return "Channels: " + ", ".join(f"{r['channel']} ({r['posts']})" for r in counts) + "." if counts else "The archive is empty."
