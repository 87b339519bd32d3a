"""``python -m quaystone search|links|show|doctor|sync|import|compact|vacuum ARCHIVE ...``: thin wrappers over the API."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from quaystone.api import ArchiveReader, open_reader
from quaystone.operators.integrity import coverage
from quaystone.session import local_session
from quaystone.sources.archive import Archive
from quaystone.streaming.lease import LeaseLost
from quaystone.streaming.sync import import_export, sync_channel


def _named(function: str):
    """A function given as module:name."""
    module, _, name = function.partition(":")
    return getattr(importlib.import_module(module), name)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quaystone")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, what in (("search", "query"), ("links", "url"), ("show", "post"), ("doctor", None), ("compact", "table"), ("vacuum", None)):
        one = sub.add_parser(name)
        one.add_argument("archive")
        if what:
            one.add_argument(what)
        if name in ("search", "links"):
            one.add_argument("--limit", type=int, default=20)
            one.add_argument("--cursor")
        if name == "search":
            for option in ("channel", "kind", "since", "until"):
                one.add_argument(f"--{option}")
            one.add_argument("--mode", default="both")
    sync = sub.add_parser("sync")
    sync.add_argument("archive")
    sync.add_argument("channels", nargs="+")
    sync.add_argument("--fetcher", required=True, help="module:function of an address that gives status, final address and text")
    sync.add_argument("--full", action="store_true")
    sync.add_argument("--max-pages", type=int, default=500)
    taken = sub.add_parser("import")
    taken.add_argument("archive")
    taken.add_argument("folder")
    taken.add_argument("channel")
    taken.add_argument("--zone", required=True)
    taken.add_argument("--look-up", help="module:function of a message id, to verify the export")
    taken.add_argument("--replace", action="store_true")
    return parser


def _answer(args: argparse.Namespace, archive: Archive) -> tuple[object, int]:
    """(what is printed, exit code)."""
    if args.command == "doctor":
        health = archive.health()
        rows = [r.asDict() for r in coverage(archive.read("post")).collect()] if health.get("post") else []
        return {"health": health, "coverage": rows}, 0 if len(health) > 1 and all(health.values()) else 1
    if args.command == "sync":
        return [sync_channel(archive, c, _named(args.fetcher), args.full, args.max_pages).__dict__ for c in args.channels], 0
    if args.command == "import":
        return import_export(archive, args.folder, args.channel, args.zone, _named(args.look_up) if args.look_up else None, args.replace).__dict__, 0
    if args.command == "compact":
        return {"generation": archive.compact(args.table)}, 0
    if args.command == "vacuum":
        return {"deleted": archive.vacuum()}, 0
    reader: ArchiveReader = open_reader(archive)
    if args.command == "show":
        post = reader.get_post(args.post)
        return None if post is None else post.asDict(True), 0
    page = reader.find_links(args.url, args.limit, args.cursor) if args.command == "links" else reader.search_posts(args.query, args.channel, args.kind, args.since, args.until, args.mode, args.limit, args.cursor)
    return {**page.__dict__, "hits": [h.asDict(True) for h in page.hits]}, 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        shown, code = _answer(args, Archive(local_session(), args.archive))
    except (ValueError, ConnectionError, LookupError, LeaseLost) as error:
        print(error, file=sys.stderr)
        return 2
    print(json.dumps(shown, default=str, ensure_ascii=False))
    return code


if __name__ == "__main__":
    sys.exit(main())
