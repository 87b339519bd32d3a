"""Search against brute force: matches, ranks, paging, filters, cursors, and the API."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quaystone import paging, render
from quaystone.api import ArchiveReader, ToolError, call_tool, instructions, tool_schemas
from quaystone.functions.stems import stem
from quaystone.functions.text import parse_bound, parse_reference, words, words_of
from quaystone.operators import index as files
from quaystone.operators import search
from quaystone.operators.search import SearchFilter, parse_query
from tests.conftest import at, post_rows, rows_of

VOCABULARY = "swift concurrency навигация навигации кэш сборки ещё build cache Café layout engine the a".split()


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(7)
    rows = [(f"c{i % 3}", i, at(i % 9, i % 24), ("text", "photo")[i % 2], " ".join(draw.choices(VOCABULARY, k=draw.randint(0, 12)))) for i in range(120)]
    rows += [("c0", 500, None, None, None), ("c0", 501, at(1), "text", ""), ("c1", 502, at(2), "text", "swift " * 5_000), ("c1", 503, at(2), "text", "imation animation")]
    return spark.createDataFrame(rows, "channel string, message_id bigint, date timestamp, kind string, content string").withColumn("hit", F.lit(1)).withColumn("dl", F.lit(1))


@pytest.fixture(scope="module")
def index(table):
    return search.indexed(table).persist()


def test_words_agree(spark):
    texts = ["Café ÉCOLE naïve", "ё й ї", "a_b c-d 4.5 x²", "", "日本語 テスト", "कोड जनक"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(words(F.col("t"))).collect()] == [words_of(t) for t in texts]
    assert spark.createDataFrame([(None,)], "t string").select(words(F.col("t"))).first()[0] is None


def test_query_grammar():
    assert parse_query('a "b c" d') == search.Query([["b", "c"]], ["a", "d"], ["a", "b c", "d"])
    assert parse_query("«чистая архитектура» ещё").phrases == [["чистая", "архитектура"]] and parse_query("ещё").tokens == ["еще"]
    assert parse_query('unclosed "b c').tokens == ["unclosed", "b", "c"] and parse_query('"" x').tokens == ["x"]
    assert parse_query("SE-0413").literal == "se-0413" and parse_query("OR * NOT").tokens == ["or", "not"]
    search.refuse_operators('android "a OR b" org')
    for bad in ("a OR b", "NOT(b", "a,AND"):
        with pytest.raises(ValueError):
            search.refuse_operators(bad)


def brute_rank(docs, fields):
    """BM25 with the formula written out; ``fields``: (name, phrase) pairs."""
    lengths = [len(d["words"]) + len(d["stems"]) for d in docs]
    mean = sum(lengths) / len(docs)
    count = lambda ws, p: sum(ws[i : i + len(p)] == p for i in range(len(ws) - len(p) + 1))
    ranks = [0.0] * len(docs)
    for name, phrase in fields:
        f = [count(d[name], phrase) for d in docs]
        n = sum(x > 0 for x in f)
        idf = max(math.log((len(docs) - n + 0.5) / (n + 0.5)), 1e-6)
        for i, x in enumerate(f):
            ranks[i] -= idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * lengths[i] / mean))
    return ranks


@pytest.mark.parametrize("text", ["swift", "навигация", "build cache", '"build cache"', '"layout engine" the', "cafe", "еще", "a a", "nothinghere", "", '"the the"'])
def test_word_hits_against_brute_force(table, index, text):
    docs = []
    for r in table.collect():
        ws = words_of((r["content"] or "").replace("ё", "е"))
        docs.append({"key": (r["channel"], r["message_id"]), "words": ws, "stems": [stem(w) for w in ws]})
    query = parse_query(text)
    wanted = [[t] for t in query.tokens] + query.phrases
    fields = [x for p in wanted for x in (("words", p), ("stems", [stem(w) for w in p]))]
    ranks = brute_rank(docs, fields)
    has = lambda ws, p: any(ws[i : i + len(p)] == p for i in range(len(ws) - len(p) + 1))
    want = {d["key"]: r for d, r in zip(docs, ranks) if wanted and all(has(d["words"], p) or has(d["stems"], [stem(w) for w in p]) for p in wanted)}
    got = {(r["channel"], r["message_id"]): r["rank"] for r in search.hits(index, text, "words").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_inflections_meet_by_stems(index):
    a, b = (set(r["message_id"] for r in search.hits(index, t, "words").collect()) for t in ("навигация", "навигации"))
    assert a == b and a


def test_substring(index, table):
    assert [r["message_id"] for r in search.hits(index, "nimat", "substring").collect()] == [503]
    assert search.hits(index, "ni", "substring").count() == 0
    want = {r["message_id"] for r in table.collect() if "ut eng" in (r["content"] or "").lower()}
    assert {r["message_id"] for r in search.hits(index, "ut  eng", "substring").collect()} == want


@pytest.mark.parametrize("mode", ["words", "substring", "both"])
def test_pages_make_the_whole(index, mode):
    found = search.hits(index, "build", mode).persist()
    whole = [(r["channel"], r["message_id"]) for r in search.ranked_page(found, None).collect()]
    assert len(whole) == len(set(whole)) == search.match_count(index, "build", mode).first()["total"]
    for size in (1, 7, 50):
        paged = []
        for offset in range(0, len(whole) + size, size) if size > 1 else (0, 3):
            page = [(r["channel"], r["message_id"]) for r in search.ranked_page(found, size, offset).collect()]
            assert page == whole[offset : offset + size]
            paged += page
    assert search.ranked_page(found, -5).count() == 0 and search.ranked_page(found, 10**9).count() == len(whole)


def test_words_come_first_and_filters_keep_ranks(index):
    both = search.ranked_page(search.hits(index, "imation", "both"), None).collect()
    assert [r["tier"] for r in both] == sorted(r["tier"] for r in both)
    ranks = {(r["channel"], r["message_id"]): r["rank"] for r in search.hits(index, "swift", "words").collect()}
    for where in (SearchFilter(channel="@@C1"), SearchFilter(kind="text"), SearchFilter(since=at(2), until=at(5)), SearchFilter(before=at(3))):
        part = search.hits(index, "swift", "words", where).collect()
        assert part and len(part) < len(ranks) and all(ranks[r["channel"], r["message_id"]] == r["rank"] for r in part)


@pytest.fixture(scope="module")
def stored(table, tmp_path_factory):
    folder = tmp_path_factory.mktemp("index")
    return files.write_index(table, lambda part: f"{folder}/{part}")


def found_by(df) -> dict:
    return {(r["channel"], r["message_id"], r["tier"]): round(r["rank"], 9) for r in df.collect()}


CASES = [(t, "both") for t in ("swift", "навигация the", "nothinghere", '"layout engine"', "ut eng", "imation")] + [(t, "words") for t in ("build cache", '"the the" swift', "cafe", "")] + [(t, "substring") for t in ("ut eng", "e", "!!!")]


@pytest.mark.parametrize("text, mode", CASES)
def test_files_give_what_the_scan_gives(index, stored, text, mode):
    assert found_by(files.hits(stored, text, mode)) == found_by(search.hits(index, text, mode))


def test_filters_and_stems_in_files(index, stored):
    for where in (SearchFilter(channel="@@C1"), SearchFilter(kind="text", since=at(2), until=at(5)), SearchFilter(before=at(3))):
        for text in ("swift", '"build cache"', "ache"):
            assert found_by(files.hits(stored, text, "both", where)) == found_by(search.hits(index, text, "both", where))
    assert found_by(files.hits(stored, "навигация", "words", with_stems=False)).keys() < found_by(files.hits(stored, "навигация", "words")).keys()


@pytest.mark.parametrize("text, mode", [("build", "both"), ('"build cache"', "words"), ("animation", "substring")])
def test_bounded_pages_make_the_whole(stored, text, mode):
    found = files.hits(stored, text, mode)
    whole = [(r["channel"], r["message_id"]) for r in files.ordered(found).collect()]
    for size in (1, 7, 500):
        for offset in (0, 3 * size):
            page, total = files.page_of(stored, text, mode, SearchFilter(), offset, size)
            assert [(r["channel"], r["message_id"]) for r in page.collect()] == whole[offset : offset + size] and total == len(whole)


def test_segments_count_as_one_index(spark, table, stored, tmp_path):
    halves = [table.where(F.coalesce(F.col("message_id"), F.lit(0)) % 2 == i) for i in (0, 1)]
    for i, half in enumerate(halves):
        files.write_index(half, lambda part: f"{tmp_path}/{i}/{part}")  # noqa: B023
    both = files.read_index(spark, lambda part: [f"{tmp_path}/0/{part}", f"{tmp_path}/1/{part}"])
    for text in ("swift", '"build cache" the', "ache"):
        assert found_by(files.hits(both, text, "both")) == found_by(files.hits(stored, text, "both"))
    assert files.stale_documents(both, halves[0]).count() == halves[1].count()


def test_pages_of_one_sort(spark, tmp_path, monkeypatch):
    from quaystone.plans import ingest

    rows = [(f"c{i % 3}", i, at(i % 9), "text", "retry " * (i % 4) + "retrying x" * (i % 2) + "no") for i in range(120)]
    table = spark.createDataFrame(rows, "channel string, message_id bigint, date timestamp, kind string, content string")
    stored = files.write_index(table, lambda part: f"{tmp_path}/{part}")
    keys = lambda df: [(r["channel"], r["message_id"]) for r in df.collect()]
    for text, mode in (("retry", "both"), ("retry", "words"), ("nothing of it", "both")):
        alone, total = files.page_of(stored, text, mode, SearchFilter(), 0, 1000)
        found, n = files.numbered(files.hits(stored, text, mode))
        found = found.orderBy("place")
        assert keys(found) == keys(alone) and [r["place"] for r in found.collect()] == list(range(total)) and n == total
    # However many pages there are, their hits are found once.
    monkeypatch.setattr(ingest, "searchable_documents", lambda s, d: table)
    found, cut, cuts = keys(files.page_of(stored, "retry", "both", SearchFilter(), 0, 1000)[0]), files.cut_lineage, []
    monkeypatch.setattr(files, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    pages = {(r["channel"], r["message_id"]): r["page"] for r in ingest.paged_search(spark, "").collect()}
    assert pages == {k: i // 25 + 1 for i, k in enumerate(found)} and max(pages.values()) > 3 and len(cuts) < 4


def test_index_of_nothing(table, tmp_path):
    empty = files.write_index(table.limit(0), lambda part: f"{tmp_path}/{part}")
    assert files.hits(empty, "swift", "both").count() == 0 and files.page_of(empty, "swift", "both", SearchFilter(), 0, 5)[1] == 0


def test_searchable_widens_content(spark):
    posts = post_rows(spark, [{"channel": "a", "message_id": 1, "text": "t", "hashtags": ["x", "x"], "poll": ("why", ["yes", "no"], 1), "author_name": "Ann"}, {"channel": "a", "message_id": 2}]).withColumn("date", F.col("fetched_at"))
    previews = spark.createDataFrame([("a", 1, "title", None), ("a", 1, "title", None)], "channel string, message_id bigint, title string, description string")
    assert rows_of(search.searchable(posts, previews).select("message_id", "content")) == [(1, "t\n#x\n#x\nwhy\nyes\nno\nAnn\ntitle"), (2, "")]
    empty = search.indexed(search.searchable(posts.limit(0)))
    assert search.hits(empty, "t", "both").count() == 0


def test_cursors():
    print_ = paging.fingerprint("search", "ab", "c")
    assert print_ != paging.fingerprint("search", "a", "bc") and paging.fingerprint(None) != paging.fingerprint("")
    text = paging.Cursor(40, print_, 3).encode()
    assert paging.Cursor.decode(text, print_) == paging.Cursor(40, print_, 3)
    for bad in ("", "!!", text[:-4], paging.Cursor(10**9, print_, 3).encode()):
        with pytest.raises(paging.BadCursor):
            paging.Cursor.decode(bad, print_)
    with pytest.raises(paging.BadCursor):
        paging.Cursor.decode(text, "other")
    assert paging.next_cursor(0, 0, 5, print_, 1) is None and paging.next_cursor(3, 2, 5, print_, 1) is None and paging.next_cursor(0, 2, 5, print_, 1)


def test_arguments():
    assert parse_reference("@Name/7") == parse_reference("https://t.me/name/7") == parse_reference("t.me/name/7") == ("name", 7)
    assert parse_reference("name/0") is None and parse_reference("name") is None and parse_reference("a b/7") is None
    assert parse_bound("2024-05-06")[1] and parse_bound("2024-05-06T07:08:09.5+02:00")[0].hour == 5
    for bad in ("2024-5-6", "x", "2024-05-06T07:08:09"):
        with pytest.raises(ValueError):
            parse_bound(bad)


def test_api(spark):
    posts = post_rows(spark, [{"channel": "a", "message_id": i, "text": f"swift news {i}", "kind": "text", "date": None} for i in range(1, 8)]).withColumn("date", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("message_id")))
    link = "link_id bigint, channel string, message_id bigint, ord int, url_raw string, url_canonical string, spec_version int, preview struct<site_name: string, title: string, description: string, resolved_url: string, observed_at: string>"
    links = spark.createDataFrame([(1, "a", 1, 0, "http://sho.example/x", "https://sho.example/x", 3, None), (2, "a", 2, 0, "https://www.long.example/y/", "https://long.example/y", 3, None), (2, "a", 2, 0, "https://www.long.example/y/", "https://long.example/y", 3, None), (3, "a", 3, 0, "tg:raw", None, 3, None)], link)
    reactions = spark.createDataFrame([(1, "a", 1, "x", 3, False), (1, "a", 1, "x", 3, False), (2, "a", 1, None, 2, True)], "reaction_id bigint, channel string, message_id bigint, emoji string, count bigint, is_paid boolean")
    resolutions = spark.createDataFrame([("https://sho.example/x", "https://long.example/y", "200", 1, at(1)), ("https://fail.example", None, "404", 0, at(1))], "url_canonical string, resolved_canonical string, http_status string, hops int, resolved_at timestamp")
    reader = ArchiveReader(posts, links, reactions, resolutions, generation=4)
    first = reader.search_posts("swift", limit=3)
    second = reader.search_posts("swift", limit=3, cursor=first.next_cursor)
    third = reader.search_posts("SWIFT", limit=3, cursor=second.next_cursor)
    assert [h["message_id"] for p in (first, second, third) for h in p.hits] == list(range(1, 8)) and third.next_cursor is None and first.total == 7
    assert first.hits[0]["reactions"] == 5 and first.hits[0]["link"] == "https://t.me/a/1"
    assert reader.search_posts("swift", limit=0).total == 7 and not reader.search_posts("swift", until="2023-11-13").hits
    with pytest.raises(ToolError):
        reader.search_posts("a OR b")
    with pytest.raises(paging.BadCursor):
        reader.search_posts("other", cursor=first.next_cursor)
    for url in ("https://sho.example/x", "http://www.long.example/y?utm_source=z"):
        page = reader.find_links(url)
        assert [h["message_id"] for h in page.hits] == [1, 2] and page.total == 2
    assert [h["message_id"] for h in reader.find_links("tg:raw").hits] == [3]
    moved = ArchiveReader(posts, links, reactions, resolutions, generation=5)
    assert moved.find_links("https://sho.example/x", limit=1, cursor=reader.find_links("https://sho.example/x", limit=1).next_cursor).index_moved
    assert render.page_text(first, "swift").splitlines()[0] == "https://t.me/a/1 [text] (5 reactions): swift news 1" and "3 of 7; next page" in render.page_text(first, "swift")
    assert "Nothing matches" in render.page_text(reader.search_posts("nothinghere"), "nothinghere") and "last page" in render.page_text(third, "swift")
    assert "Reactions: x 3, paid 2" in render.record_text(reader.get_post("a/1"))
    assert call_tool(reader, "find_links", {"url": "https://sho.example/x"}).hits[0]["snippet"] == "swift news 1" and instructions(reader) == "Channels: a (7)."
    assert [t["name"] for t in tool_schemas()] == ["search_posts", "find_links", "get_post"]
    for bad in ({"url": "x", "color": "red"}, {}, {"url": 5}, {"url": "x", "limit": "3"}, {"url": "x", "cursor": "zzz"}):
        with pytest.raises(ToolError):
            call_tool(reader, "find_links", bad)
    with pytest.raises(LookupError):
        call_tool(reader, "delete_post", {})
    post = reader.get_post("@A/1")
    assert post["message_id"] == 1 and [r["count"] for r in post["reactions"]] == [3, 2] and reader.get_post("a/99") is None
    with pytest.raises(ToolError):
        reader.get_post("nonsense")


def test_no_limit_gives_every_hit(spark):
    n = search.MAX_LIMIT + 5
    found = spark.range(n).select(F.lit("a").alias("channel"), F.col("id").alias("message_id"), F.lit(0).alias("tier"), F.lit(-1.0).alias("rank"))
    assert search.ranked_page(found, None).count() == n and search.ranked_page(found, None, 3).count() == n - 3
