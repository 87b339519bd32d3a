"""Markup, resolver logs, snapshots, crawls, leases and the stream, without a network."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quaystone.functions.text import abbreviated_views, similar_text, snippet
from quaystone.functions.urls import canonical_url, decode_entities
from quaystone.operators.carry import carry_forward
from quaystone.operators.integrity import coverage
from quaystone.operators.links import links_to, resolved_links
from quaystone.sources import archive as store
from quaystone.sources import crawl, markup, resolutions
from quaystone.streaming.crawlstate import CrawlState, Page, walk
from quaystone.streaming.ingest import apply_batch, ingest_stream, page_counts
from quaystone.streaming.lease import Lease, LeaseLost
from tests.conftest import at, rows_of

URLS = [
    ("http://Example.ORG/A/", "https://example.org/A"), ("https://www.example.org:443", "https://example.org"), ("https://example.org:8080/x", "https://example.org:8080/x"), ("https://example.org/?utm_x=1&b=2&a=1&A=0#f", "https://example.org?A=0&a=1&b=2"),
    ("https://example.org/p?v=1&si=2&s=3&fbclid=4", "https://example.org/p?v=1"), ("https://example.org/a%2Fb%2Dc", "https://example.org/a%2Fb-c"), ("https://example.org/?a=1&amp;amp;b=2", "https://example.org?a=1&b=2"), ("https://example.org/x&#33;y", "https://example.org/x!y"),
    ("https://example.org/статья", "https://example.org/%D1%81%D1%82%D0%B0%D1%82%D1%8C%D1%8F"), ("https://[::1]/x", "https://[::1]/x"), ("  https://example.org//a//b  ", "https://example.org//a//b"), ("https://example.org/?flag", "https://example.org?flag"),
    ("mailto:a@b.example", None), ("/x", None), ("", None), ("https://", None), ("https://exa mple.org", None), (None, None), ("http://a:99999999/", None), ("x" * 50_000, None),
]


def test_canonical_urls():
    for raw, want in URLS:
        assert canonical_url(raw) == want, raw
        assert want is None or canonical_url(want) == want
    assert decode_entities("&sect=1 &lt;&#x41;&nope;") == "&sect=1 <A&nope;"


LISTING = """<div class="tgme_widget_message_wrap"><div class="tgme_widget_message" data-post="Chan/10" data-view="{view}">
<div class="tgme_widget_message_author"><span class="tgme_widget_message_from_author">Ann</span></div>
<a class="tgme_widget_message_reply" href="https://t.me/chan/7?x=1"><div class="tgme_widget_message_text js-message_text">quoted</div></a>
<div class="tgme_widget_message_forwarded_from"><a class="tgme_widget_message_forwarded_from_name" href="https://t.me/Other/55">Other</a></div>
<div class="tgme_widget_message_text js-message_text">See <a href="https://x.example/a?utm_source=1">https://x.example/a?utm_source=1</a> by <a href="https://t.me/ann">@Ann</a><br/><a href="?q=%23tag">#tag</a> <a href="?q=%23tag">#tag</a> &amp; <a href="https://x.example/b">this</a></div>
<a class="tgme_widget_message_link_preview" href="https://x.example/b"><div class="link_preview_site_name">Site</div><div class="link_preview_title">Title</div></a>
<div class="tgme_widget_message_reactions"><span class="tgme_reaction"><i class="emoji"><b>🎈</b></i>71</span><span class="tgme_reaction tgme_reaction_paid"><i></i>3</span></div>
<span class="tgme_widget_message_views">1.4K</span><span class="tgme_widget_message_meta">edited <a class="tgme_widget_message_date"><time datetime="2022-11-08T05:10:40+00:00">x</time></a></span></div></div>
<div class="tgme_widget_message" data-post="chan/11"><div class="tgme_widget_message_poll"><div class="tgme_widget_message_poll_question">Why?</div><div class="tgme_widget_message_poll_option_text">yes</div><div class="tgme_widget_message_poll_option_text">no</div></div><span class="tgme_widget_message_voters">650 votes</span><time datetime="2022-11-08T05:11:40+00:00"></time></div>
<div class="tgme_widget_message" data-post="chan/12"><div class="tgme_widget_message_grouped"><a class="tgme_widget_message_photo_wrap"></a><a class="tgme_widget_message_photo_wrap"></a></div><time datetime="2022-11-08T05:12:40+00:00"></time></div>
<div class="tgme_widget_message" data-post="chan/x"><time datetime="2022-11-08T05:12:40+00:00"></time></div>
<div class="tgme_widget_message" data-post="chan/13"><time datetime="never"></time></div>
<div class="tgme_widget_message" data-post="foreign/5"><time datetime="2022-11-08T05:12:40+00:00"></time></div>"""

EXPORT = """<div class="message service" id="message1"><div class="body details">x</div></div>
<div class="message default" id="message10"><div class="body"><div class="pull_right date details" title="8 November 2022, 08:10:40">08:10</div><div class="from_name">Ann</div>
<div class="text">Hi <a href="" onclick="return ShowHashtag(&quot;tag&quot;)">#tag</a> <a onclick="return ShowHashtag('$TKN')" href="#">$TKN</a> <a href="mailto:a@b.example">a@b.example</a></div></div></div>
<div class="message default joined" id="message11"><div class="body"><div class="pull_right date details" title="8 November 2022, 08:20:00">edited 08:20</div><div class="reply_to details">In reply to <a href="#go_to_message10" onclick="return GoToMessage(10)">this</a></div><div class="text">two</div></div></div>
<div class="message default" id="message12"><div class="body"><div class="pull_right date details" title="garbage">x</div><div class="from_name">Bob</div></div></div>"""
EXPORT2 = '<div class="message default joined" id="message13"><div class="body"><div class="pull_right date details" title="8 November 2022, 09:00:00">09:00</div><div class="text">three</div></div></div>'


def test_listing(spark):
    pages = spark.createDataFrame([("chan", LISTING.replace("{view}", markup.view_data_of(1234))), ("chan", ""), ("chan", None)], "crawled string, html string")
    posts = markup.listing_posts(pages)
    got = {r["message_id"]: r for r in posts.where("readable").collect()}
    p = got[10]
    assert (p["channel"], p["text"], p["author_name"], p["reply_to"], p["is_edited"], p["kind"]) == ("chan", "See https://x.example/a?utm_source=1 by @Ann\n#tag #tag & this", "Ann", 7, True, "text")
    assert p["hashtags"] == ["tag", "tag"] and [(x["url_raw"], x["preview"] and x["preview"]["title"]) for x in p["links"]] == [("https://x.example/a?utm_source=1", None), ("https://x.example/b", "Title")]
    assert (p["forward"]["channel"], p["forward"]["message_id"], p["views"]["value"], p["views"]["is_approximate"], p["raw_channel_id"]) == ("other", 55, 1400, True, 1234)
    assert [(r["emoji"], r["count"], r["is_paid"]) for r in p["reactions"]] == [("🎈", 71, False), (None, 3, True)]
    assert got[11]["kind"] == "poll" and got[11]["poll"]["options"] == ["yes", "no"] and got[11]["poll"]["total_votes"] == 650
    assert got[12]["kind"] == "album" and got[12]["media_count"] == 2
    assert rows_of(page_counts(posts)) == [("chan", 3, 2, 1, 10, 12)]
    by_pattern = {r["message_id"]: r for r in markup.listing_posts_by_pattern(pages).collect()}
    assert (by_pattern[10]["channel"], by_pattern[10]["text"], by_pattern[10]["reply_to"], by_pattern[10]["hashtags"]) == ("chan", p["text"], 7, ["tag", "tag"]) and by_pattern[10]["date"] == p["date"]
    assert {r["url_canonical"] for r in markup.with_canonical_links(posts).collect()} == {"https://x.example/a", "https://x.example/b"}
    assert markup.listing_posts(pages.limit(0)).count() == 0


def test_export(spark):
    pages = spark.createDataFrame([("e", 1, EXPORT), ("e", 2, EXPORT2)], "source string, page int, html string")
    rows = {r["message_id"]: r for r in markup.export_posts(pages, "Europe/Moscow").where("readable").collect()}
    assert sorted(rows) == [10, 11, 13] and str(rows[10]["date"]) == "2022-11-08 05:10:40"
    assert (rows[10]["hashtags"], rows[11]["reply_to"], rows[11]["author_name"], rows[11]["is_edited"]) == (["tag"], 10, "Ann", True)
    assert rows[13]["author_name"] == "Bob"  # carried over the page and the unreadable block
    names = spark.createDataFrame([("d/messages.html",), ("d/messages2.html",), ("d/style.css",)], "name string")
    assert rows_of(markup.page_numbers(names).select("page")) == [(1,), (2,)]
    with pytest.raises(ValueError):
        markup.page_numbers(names.unionByName(spark.createDataFrame([("d/messages4.html",)], "name string")))


def test_page_kind(spark):
    page = lambda text: f'<div class="tgme_page_extra">{text}</div>'
    df = spark.createDataFrame([(page("8 315 subscribers"), 200), (page("77 members, 5 online"), 200), ("<p>contact</p>", 200)], "html string, status int")
    assert [r[0] for r in df.select(markup.page_kind(F.col("html"), F.col("status"))).collect()] == ["previewDisabled", "group", "unresolvable"]
    with pytest.raises(Exception, match="answered 404"):
        spark.createDataFrame([("", 404)], "html string, status int").select(markup.page_kind(F.col("html"), F.col("status"))).collect()


def test_resolver_log(spark, tmp_path):
    good = {"url_canonical": "https://s.example/1", "final_url": "http://www.long.example/x/", "http_status": 200, "hops": 2, "resolved_at": "2024-01-01T00:00:00.123+00:00"}
    lines = [json.dumps(good), json.dumps(good | {"url_canonical": "https://s.example/2", "http_status": "URLError"}), json.dumps(good | {"url_canonical": "https://s.example/3", "http_status": 404, "resolved_at": "2024-01-01T00:00:00+00:00"}), "", json.dumps(good | {"http_status": True}), json.dumps(good | {"resolved_at": "soon"}), json.dumps(good | {"url_canonical": None}), '{"url_canonical": "x', "[1]"]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    rows, skipped = resolutions.read_log(spark, str(tmp_path / "log.jsonl"))
    assert rows_of(rows.select("url_canonical", "resolved_canonical", "http_status")) == [("https://s.example/1", "https://long.example/x", "200"), ("https://s.example/2", None, "URLError"), ("https://s.example/3", None, "404")]
    assert sorted(r["reason"] for r in skipped.collect())[:3] == ["bad status", "bad time", "no address"] and skipped.count() == 5
    newer = rows.withColumn("resolved_at", F.expr("resolved_at + interval 1 day")).withColumn("hops", F.lit(9)).limit(1)
    assert {r["hops"] for r in resolutions.upsert(rows, newer).where("url_canonical = 'https://s.example/1'").collect()} == {9}
    asked = resolutions.resolve(rows.select("url_canonical"), lambda method, url: (200, None) if url.endswith("1") else 1 / 0)
    assert {r["http_status"] for r in asked.collect()} == {"200", "ZeroDivisionError"}
    assert resolutions.resolve(rows.select("url_canonical"), lambda *_: (200, None), done=rows.where("hops = 2")).count() == 0


def test_redirects():
    answers = {("HEAD", "https://a.example/1"): (301, "/2"), ("HEAD", "https://a.example/2"): (405, None), ("GET", "https://a.example/2"): (302, "https://b.example/x"), ("HEAD", "https://b.example/x"): (404, None), ("HEAD", "https://a.example/loop"): (307, "/loop"), ("HEAD", "https://a.example/odd"): (301, None)}
    ask = lambda method, url: answers[method, url]
    assert resolutions.follow_redirects("https://a.example/1", ask) == ("https://b.example/x", "404", 2)
    assert resolutions.follow_redirects("https://a.example/loop", ask) == ("https://a.example/loop", "TooManyRedirects", resolutions.MAX_HOPS)
    assert resolutions.follow_redirects("https://a.example/odd", ask)[1:] == ("301", 0) and resolutions.follow_redirects("https://gone.example", ask)[1] == "KeyError"


def test_links(spark):
    links = spark.createDataFrame([("a", 1, 0, "u1", "c1"), ("a", 2, 0, "u2", "c2"), ("a", 3, 0, "u3", None)], "channel string, message_id bigint, ord int, url_raw string, url_canonical string")
    none = spark.createDataFrame([], "url_canonical string, resolved_canonical string, resolved_at timestamp")
    assert rows_of(resolved_links(links, none).select("effective")) == [("c1",), ("c2",), (None,)]
    assert links_to(links, none, "u3").count() == 1 and links_to(links.limit(0), none, "https://x.example").count() == 0


def test_coverage(spark, monkeypatch):
    monkeypatch.setattr("quaystone.operators.integrity.BLOCK_IDS", 4)
    rows = [("a", 1, 1), ("a", 2, 3), ("a", 4, 1), ("a", 10, 2), ("a", 20, 4), ("a", 20, 4), ("b", 5, None), ("c", 1, 1), ("c", 4, 1), ("c", 7, 1), (None, 1, 1), ("a", None, 1)]
    got = {r["channel"]: r for r in coverage(spark.createDataFrame(rows, "channel string, message_id bigint, media_count int")).collect()}
    a = got["a"]
    assert (a["lowest"], a["highest"], a["posts"], a["covered"], a["unexplained"], a["longest_gap"], a["longest_gap_start"]) == (1, 23, 5, 10, 13, 8, 12)
    assert got["b"]["longest_gap_start"] is None and got["c"]["longest_gap_start"] == 2 and got["c"]["coverage"] == pytest.approx(42.9)


def test_carry_forward(spark, monkeypatch):
    monkeypatch.setattr("quaystone.operators.carry.BLOCK_IDS", 4)
    rows = [("a", i, x) for i, x in enumerate([None, "p", None, None, None, None, None, None, None, "q", None])]
    got = carry_forward(spark.createDataFrame(rows, "g string, i bigint, v string"), "g", "i", "v", "out").orderBy("i").collect()
    assert [r["out"] for r in got] == [None] + ["p"] * 8 + ["q"] * 2


def test_projections(spark):
    df = spark.createDataFrame([("1.4K", "a\nb", None), ("987", "", "why?"), ("x", None, None), (None, "z" * 200, None)], "v string, t string, q string")
    rows = df.select(abbreviated_views(F.col("v")).alias("v"), snippet(F.col("t"), F.col("q")).alias("s")).collect()
    assert [r["v"] and tuple(r["v"]) for r in rows] == [(1400, True), (987, False), None, None]
    assert [r["s"] for r in rows] == ["a b", "why?", "", "z" * 140 + "…"]
    assert similar_text("A b, c!", "a B c") and not similar_text("a b c d", "d c b a") and similar_text("", "")


def test_archive(spark, tmp_path):
    df = lambda *ids: spark.createDataFrame([("a", i, f"t{i}") for i in ids], "channel string, message_id bigint, text string")
    one = store.Archive(spark, str(tmp_path))
    assert one.generation == 0 and one.health() == {"writable": True}
    assert one.commit({"post": df(1, 2)}) == 1
    reader = store.Archive(spark, str(tmp_path))
    one.commit({"post": store.keep_existing(one.read("post"), df(2, 3).withColumn("text", F.lit("new")))})
    assert rows_of(one.read("post")) == [("a", 1, "t1"), ("a", 2, "t2"), ("a", 3, "new")]
    assert reader.read("post").count() == 2 and reader.refresh() == 2
    other = store.Archive(spark, str(tmp_path) + "-2")
    other.commit({"post": df(1)})
    other.commit(append={"post": df(2)})
    assert other.read("post").count() == 2 and len(other.tables()["post"]) == 2 and other.compact("post") == 3 and len(other.tables()["post"]) == 1
    assert rows_of(store.replace_existing(one.read("post"), df(1).withColumn("text", F.lit("r"))))[0] == ("a", 1, "r")
    assert tuple(store.written_and_kept(one.read("post"), df(3, 4, 4)).first()) == (1, 1)

    def lost():
        raise LeaseLost("gone")

    with pytest.raises(LeaseLost):
        one.commit({"post": df(9)}, before=lost)
    assert store.Archive(spark, str(tmp_path)).generation == 2 and one.health() == {"writable": True, "post": True}
    with pytest.raises(LookupError):
        one.read("nothing")


POSTS = "channel string, message_id bigint, date timestamp, text string, is_edited boolean"


def test_identity(spark):
    channels = spark.createDataFrame([("c", 1, "webPreview"), ("g", 2, "group"), ("z", 0, "group"), ("old", 0, "previewDisabled")], "channel string, raw_channel_id bigint, reachability string")
    posts = spark.createDataFrame([("z", 1, at(1), "one two", False)], POSTS)
    same, other, none = spark.createDataFrame([("z", 1, at(1), "One, two", False)], POSTS), spark.createDataFrame([("z", 1, at(2), "one two", False)], POSTS), spark.createDataFrame([("z", 9, at(1), "x", False)], POSTS)
    claim = lambda name, id_, new=same, replace=False: {r["channel"]: (r["raw_channel_id"], r["reachability"]) for r in store.claim_identity(channels, posts, name, id_, new, replace).collect()}
    assert claim("new", 9)["new"] == (9, "group") and claim("g", 2)["g"] == (2, "group") and claim("g", None)["g"] == (2, "group") and claim("old", 5)["old"] == (5, "group") and claim("old", None)["old"] == (0, "group")
    assert claim("z", 7)["z"] == (7, "group") and claim("z", 7, none, True)["z"] == (7, "group") and claim("z", None, other)["z"] == (0, "group")
    for bad in (("c", 1), ("g", 7), ("new", 1), ("z", 7, other), ("z", 7, none), ("z", 7, other, True)):
        with pytest.raises(store.IdentityConflict):
            claim(*bad)
    with pytest.raises(store.IdentityConflict):
        store.refuse_group(channels, "g")
    store.refuse_group(channels, "c")
    for bad in (("c", 3), ("x", 2)):
        with pytest.raises(store.IdentityConflict):
            store.refuse_other_chat(channels, *bad)


def test_channels(spark):
    schema = "channel string, raw_channel_id bigint, title string, subscriber_count bigint, reachability string, lowest_message_id bigint"
    stored = spark.createDataFrame([("a", 1, "A", 10, "webPreview", 5), ("b", 0, None, None, "group", None)], schema)
    new = spark.createDataFrame([("a", 1, None, 11, "webPreview"), ("c", 3, "C", 1, "webPreview")], "channel string, raw_channel_id bigint, title string, subscriber_count bigint, reachability string")
    assert rows_of(store.upsert_channels(stored, new)) == [("a", 1, None, 11, "webPreview", 5), ("b", 0, None, None, "group", None), ("c", 3, "C", 1, "webPreview", None)]
    assert rows_of(store.ensured_channels(stored, new, "webPreview")) == [("a", 1, "A", 10, "webPreview", 5), ("b", 0, None, None, "group", None), ("c", 0, None, None, "webPreview", None)]
    assert rows_of(store.identified(stored, new)) == [("a", 1, "A", 10, "webPreview", 5), ("b", 0, None, None, "group", None)]


def test_two_writers_lose_nothing(spark, tmp_path):
    df = lambda *ids: spark.createDataFrame([("a", i) for i in ids], "channel string, message_id bigint")
    store.Archive(spark, str(tmp_path)).commit({"post": df(1)})
    one, two = store.Archive(spark, str(tmp_path)), store.Archive(spark, str(tmp_path))
    one.commit({"post": one.read("post").unionByName(df(2))})
    with pytest.raises(store.Outdated):
        two.commit({"post": two.read("post").unionByName(df(3))})
    assert two.transact(lambda a: a.commit({"post": a.read("post").unionByName(df(3))})) == 3
    assert rows_of(two.read("post").select("message_id")) == [(1,), (2,), (3,)]
    late = store.Archive(spark, str(tmp_path))
    two.commit(append={"post": df(7)})
    add = lambda a: a.commit(append={"post": df(7).join(a.read("post"), ["channel", "message_id"], "left_anti")})
    late.transact(add)
    assert rows_of(late.read("post").select("message_id")) == [(1,), (2,), (3,), (7,)]
    with pytest.raises(store.Outdated):
        late.transact(lambda a: store.Archive(spark, str(tmp_path)).commit(append={"post": df()}) and a.commit(append={"post": df()}), attempts=2)


def test_a_lost_lease_cannot_write(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "channel string, message_id bigint")
    now = [0.0]
    one, two = (Lease(spark, str(tmp_path / "l"), "a", 120, lambda: now[0]) for _ in range(2))
    archive = store.Archive(spark, str(tmp_path / "s"))
    one.acquire()
    archive.commit({"post": df}, lease=one)
    now[0] = 500
    two.acquire()
    with pytest.raises(LeaseLost):
        archive.commit({"post": df}, lease=one)
    archive.commit({"post": df}, lease=two)
    one.check = lambda: None  # as if it had looked before two took over
    with pytest.raises(store.Outdated):
        archive.commit({"post": df}, lease=one)


def test_every_crash_leaves_a_whole_generation(spark, tmp_path):
    df = lambda *ids: spark.createDataFrame([("a", i) for i in ids], "channel string, message_id bigint")
    archive = store.Archive(spark, str(tmp_path))
    archive.commit({"post": df(1), "link": df(1)})

    def crash(*_):
        raise RuntimeError("gone")

    for step in ({"append": {"post": df(2), "link": crash}}, {"append": {"post": df(2)}, "before": crash}, {"tables": {"post": crash}}):
        with pytest.raises(RuntimeError):
            archive.commit(**step)
        fresh = store.Archive(spark, str(tmp_path))
        assert fresh.generation == 1 and rows_of(fresh.read("post").select("message_id")) == rows_of(fresh.read("link").select("message_id")) == [(1,)]
    assert archive.vacuum(older_than=10**6) == [] and len(archive.vacuum(older_than=-1)) == 2
    archive.commit(append={"post": df(2)})
    archive.commit({"post": df(5)})
    archive.commit({"post": df(6)})
    assert len(archive.vacuum(keep=1, older_than=-1)) == 3 and rows_of(store.Archive(spark, str(tmp_path)).read("post").select("message_id")) == [(6,)]


def test_history_and_candidates(spark):
    rows = lambda *r: spark.createDataFrame([("a", i, d, t, e, k) for i, d, t, e, k in r], "channel string, message_id bigint, date timestamp, text string, is_edited boolean, kind string")
    old = rows((1, at(1), "one two three", False, "text"), (2, at(2), "x", True, "text"), (3, at(3), None, False, "photo"), (4, at(4), "same", False, "text"), (5, at(100), "p", False, "photo"))
    new = rows((1, at(1), "One, two three!", False, "text"), (2, at(2), "other", False, "text"), (3, at(3, 1), None, False, "photo"), (4, at(4), "different words here", False, "text"), (9, at(9), "n", False, "text"))
    assert tuple(store.confirm_history(old, new).first()) == (1, 2)
    found = rows_of(store.verification_candidates(old, "Europe/Berlin", newest=1))
    assert found == [("media", 3), ("middle", 3), ("offset", 1), ("offset", 5), ("oldest", 1), ("text", 5)]
    live = lambda posts, **more: lambda i: next(({"text": r["text"], "date": r["date"].replace(tzinfo=dt.timezone.utc), "raw_channel_id": 7} | more for r in posts.collect() if r["message_id"] == i), None)
    assert store.verify_export(old, "a", "Europe/Berlin", live(old)) == 7
    assert store.verify_export(old, "a", "Europe/Berlin", live(old.where("message_id <> 5"))) == 7  # one that is gone says nothing
    for bad in (live(old.limit(0)), live(old, text="something else altogether"), live(old, date=at(1)), live(old, raw_channel_id=None)):
        with pytest.raises(store.NotVerified):
            store.verify_export(old, "a", "Europe/Berlin", bad)
    assert store.verification_candidates(old.limit(0), "UTC").count() == 0


def test_lease(spark, tmp_path):
    now = [0.0]
    one, two = (Lease(spark, str(tmp_path), "a", 120, lambda: now[0]) for _ in range(2))
    with one:
        with pytest.raises(LeaseLost):
            two.acquire()
        now[0] = 100
        one.renew()
        now[0] = 230
        two.acquire()
        with pytest.raises(LeaseLost):
            one.check()
    two.check()
    two.release()
    one.acquire().release()


def test_two_takers_of_a_dead_lease(spark, tmp_path):
    now = [0.0]
    make = lambda: Lease(spark, str(tmp_path), "a", 120, lambda: now[0])
    make().acquire()
    now[0] = 500
    one, two = make(), make()
    seen = one._latest()
    two._latest = lambda: seen  # both have looked before either took it
    one.acquire()
    with pytest.raises(LeaseLost):
        two.acquire()
    one.check()


def test_crawl_state():
    new = CrawlState()
    assert new.plan() == (None, None)
    page = new.step("page", 80, 100)
    assert page == CrawlState(80, 100) and page.plan() == (None, 80) and page.step("page", 50, 60) == CrawlState(50, 100)
    done = page.step("end", 1, 79)
    assert done == CrawlState(1, 100, True) and done.plan() == (100, None) and done.step("page", 101, 120) == done
    assert done.step("reached", 101, 120) == CrawlState(1, 120, True)
    assert done.step("cap", 110, 120) == CrawlState(110, 120, False) and done.step("foreign", None, None) == done
    assert done.step("failed", None, None) == done and page.step("cap", 60, 79) == CrawlState(60, 100)
    # A full walk starts anew, replaces the bounds it has seen and never takes completion back.
    assert done.plan(full=True) == (None, None) and page.plan(full=True) == (None, None)
    assert done.step("page", 90, 130, full=True) == CrawlState(90, 130, True) and done.step("cap", 90, 130, full=True) == CrawlState(90, 130, True)
    assert done.step("end", None, None, full=True) == done and page.step("end", 3, 130, full=True) == CrawlState(3, 130, True)


def test_walk():
    pages = {None: Page((9, 10)), 9: Page((5, 6)), 5: Page((1, 2))}
    assert walk(pages.__getitem__)[1] == "end" and len(walk(pages.__getitem__)[0]) == 3
    assert walk(pages.__getitem__, since=6)[1] == "reached" and walk(pages.__getitem__, max_pages=1)[1] == "cap" and len(walk(pages.__getitem__, resume_from=5)[0]) == 1
    for last, why in ((Page(), "end"), (Page(unreadable=1), "unreadable"), (Page(foreign=2), "foreign"), (Page((9, 11)), "repeated")):
        assert walk({None: Page((9, 10)), 9: last}.__getitem__)[1] == why
    for bad in (Page(status=500), Page(moved=True)):
        with pytest.raises(ConnectionError):
            walk(lambda _, bad=bad: bad)
    seen = []
    assert walk(pages.__getitem__, on_page=seen.append) == ([], "end") and len(seen) == 3


def fake_fetch(url):
    """Pages of posts 25 down to 1, ten at a time; injected by name into the data source."""
    before = int(url.partition("before=")[2] or 26)
    return 200, "".join(f'<div class="tgme_widget_message" data-post="chan/{i}"></div>' for i in range(max(1, before - 10), before))


def test_crawl_source(spark):
    crawl.register(spark)
    read = lambda **more: spark.read.format("channel_pages").options(channel="@Chan", fetcher="tests.test_sources:fake_fetch", pause="0", **more).load()
    assert [(r["before"], r["stop"]) for r in read().collect()] == [(None, None), (16, None), (6, "end")]
    assert [r["stop"] for r in read(since="20").collect()] == [None, "reached"] and read(maxpages="2").collect()[-1]["stop"] == "cap" and read(maxpages="2").count() == 2 and read(resumefrom="6").count() == 1


def test_crawl_stream(spark, tmp_path):
    crawl.register(spark)
    pages = spark.readStream.format("channel_pages").options(channel="chan", fetcher="tests.test_sources:fake_fetch", pause="0").load()
    query = pages.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
    for _ in range(200):
        query.processAllAvailable()
        if spark.read.schema(pages.schema).parquet(str(tmp_path / "out")).where("stop is not null").count():
            break
    query.stop()
    assert sorted((r["before"] or 99, r["stop"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(6, "end"), (16, None), (99, None)]


def test_stream_takes_each_file_once(spark, tmp_path):
    for d in ("in", "archive", "check"):
        (tmp_path / d).mkdir()
    drop = lambda name, *ids: (tmp_path / "in" / name).write_text(json.dumps({"channel": "chan", "html": "".join(f'<div class="tgme_widget_message" data-post="chan/{i}"><div class="js-message_text">{name}</div><time datetime="2024-01-01T00:00:00+00:00"></time></div>' for i in ids)}))
    lease = Lease(spark, str(tmp_path / "archive"), "chan").acquire()
    for name, ids in (("1", (1, 2)), ("2", (2, 3))):
        drop(name, *ids)
        ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "archive"), str(tmp_path / "check"), lease=lease).awaitTermination()
    archive = store.Archive(spark, str(tmp_path / "archive"))
    assert rows_of(archive.read("post").select("message_id", "text")) == [(1, "1"), (2, "1"), (3, "2")] and archive.generation == 2
    ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "archive"), str(tmp_path / "check")).awaitTermination()
    assert archive.refresh() == 2
    apply_batch(archive, spark.read.schema("channel string, html string").json(str(tmp_path / "in" / "2")), replace=True)
    assert rows_of(archive.read("post").select("message_id", "text")) == [(1, "1"), (2, "2"), (3, "2")]


LISTED = '<div class="tgme_widget_message" data-post="chan/{0}"><a class="tgme_widget_message_reply" href="https://t.me/chan/3?single"><div class="js-message_text">said</div></a><div class="js-message_text">a &lt; b<br/><a href="https://x.example/?a=1&amp;b=2">there</a></div><span class="tgme_reaction"><b>x</b>{0}</span><time datetime="2024-01-01T00:00:00Z"></time></div>'


def test_pages_are_read_without_a_tree(monkeypatch):
    usual, odd = LISTED.format(7), LISTED.format(7).replace("<b>x</b>", "<B>x</b ><!-- 1 --><script>2 < 3</script>")
    want = markup.listing_blocks(odd)
    assert want[0]["reactions"] == [{"emoji": "x", "count": 7, "is_paid": False}] and want[0]["text"] == "a < b\nthere" and want[0]["reply"] == "3"
    assert want[0]["entities"] == [{"type": "textURL", "text": "there", "arg": "https://x.example/?a=1&b=2"}]
    # Markup as it usually is needs no parser of any markup, and closing what was never opened closes nothing.
    monkeypatch.setattr(markup.HTMLParser, "feed", lambda *_: pytest.fail("parsed whole"))
    assert markup.listing_blocks(usual) == markup.listing_blocks(usual.replace("<b>", "</p></root></br><b>")) == want


def test_a_batch_with_nothing_new_writes_nothing(spark, tmp_path):
    from quaystone.sources.archive import Archive

    archive = Archive(spark, str(tmp_path))
    pages = spark.createDataFrame([("chan", LISTED.format(7) + LISTED.format(8)), ("chan", LISTED.format(8) + LISTED.format(9))], "channel string, html string")
    apply_batch(archive, pages)
    files = sorted(p.name for p in (tmp_path / "data").iterdir())
    assert apply_batch(archive, pages) == 2 and sorted(p.name for p in (tmp_path / "data").iterdir()) == files
    assert rows_of(archive.read("post").select("message_id", "text")) == [(i, "a < b\nthere") for i in (7, 8, 9)] and archive.read("link").count() == archive.index().texts.count() == 3


def test_postings_of_pieces(spark, monkeypatch):
    import pyarrow as pa

    from quaystone.functions.stems import stem
    from quaystone.operators import index

    lines = ["running  run  running", "", None, "crashes", "run  run"]
    want = sorted((w, field, i, [k for k, x in enumerate(words) if x == w]) for i, line in enumerate(lines) for field, words in enumerate(((line or "").split(), [stem(x) for x in (line or "").split()])) for w in set(words))
    schema = pa.schema([("word", pa.string()), ("field", pa.int8()), ("message_id", pa.int64()), ("f", pa.int32()), ("places", pa.list_(pa.int32()))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(lines)], ["message_id", "line"])
    for most, runs in ((8 << 20, 1), (22, 2), (1, 3)):
        monkeypatch.setattr(index, "SORTED", most)
        out = list(index._poster(["message_id"], schema, True)(iter([batch.slice(0, 2), batch.slice(2)])))
        rows = [(r["word"], r["field"], r["message_id"], r["places"]) for b in out for r in b.to_pylist()]
        assert sorted(rows) == want and len(out) == runs and all(r["f"] == len(r["places"]) for b in out for r in b.to_pylist())
        assert runs > 1 or rows == want
