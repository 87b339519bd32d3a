"""Queries of the archive's own operators over the test tables, and what DuckDB must give for them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions.stems import CYRILLIC_ENDINGS, LATIN_ENDINGS
from quaystone.functions.text import FOLD_FROM, FOLD_TO, chat_id, day_after, fold_channel, iso_instant, parse_bound, permalink, similar_texts, snippet
from quaystone.functions.urls import SPEC_VERSION, canonical_url_of
from quaystone.operators import index, integrity, links, records, search
from quaystone.operators.carry import carry_forward
from quaystone.operators.deliveries import newest_rows
from quaystone.session import shared_folder, state_of, table
from quaystone.sources import archive as store
from quaystone.sources.markup import listing_posts

POST_COLUMNS = ["date", "kind", "media_count", "text", "author_name", "is_edited", "reply_to", "views_value", "views_is_approximate", "hashtags", "poll", "deleted_at", "fetched_at", "row_id"]


#: Folders of the indexes that this process has written, by application, tables' state and name.
_WRITTEN: dict[str, str] = {}


def _stored_index(spark: SparkSession, base: str, tables: list[str], name: str, searchable) -> index.SearchIndex:
    """The index of a table in the shared folder, written by the first query that needs it and again once the table's files change."""
    key = "-".join([spark.sparkContext.applicationId, name, *[state_of(spark, base, t) for t in tables]])
    if key not in _WRITTEN:
        folder = shared_folder(spark, f"index-{name}-{uuid.uuid4().hex}")
        index.write_index(searchable(), lambda part: f"{folder}/{part}")
        _WRITTEN[key] = folder
    return index.read_index(spark, lambda part: [f"{_WRITTEN[key]}/{part}"])


def searchable_documents(spark: SparkSession, base: str) -> DataFrame:
    """Documents as a searchable table: source as channel, doc_id as id, language as kind."""
    return table(spark, base, "documents").select(F.col("source").alias("channel"), F.col("doc_id").alias("message_id"), F.col("collected_at").alias("date"), F.col("lang").alias("kind"), F.col("text").alias("content"))


def document_index(spark: SparkSession, base: str) -> index.SearchIndex:
    return _stored_index(spark, base, ["documents"], "documents", lambda: searchable_documents(spark, base))


def current_posts(spark: SparkSession, base: str) -> DataFrame:
    """The newest row of each post."""
    return newest_rows(table(spark, base, "post").select("channel", "message_id", *POST_COLUMNS), POST_COLUMNS)


def searchable_posts(spark: SparkSession, base: str) -> DataFrame:
    previews = table(spark, base, "link").select("channel", "message_id", "preview.title", "preview.description")
    return search.searchable(current_posts(spark, base).withColumn("date", F.col("fetched_at")), previews)


def post_index(spark: SparkSession, base: str) -> index.SearchIndex:
    return _stored_index(spark, base, ["post", "link"], "posts", lambda: searchable_posts(spark, base))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("channel", "message_id", "tier", F.round("rank", 9).alias("rank"))


def _search(text: str, mode: str, where: search.SearchFilter = search.SearchFilter(), with_stems: bool = True):
    return lambda s, d: _shown(index.hits(document_index(s, d), text, mode, where, with_stems))


def _page(text: str, mode: str, offset: int, limit: int):
    return lambda s, d: _shown(index.page_of(document_index(s, d), text, mode, search.SearchFilter(), offset, limit)[0])


IN_2024 = {"since": "2024-01-01T00:00:00Z", "until": "2024-06-30T00:00:00Z"}


def rendered_pages(spark: SparkSession, base: str) -> DataFrame:
    """Each post's newest row as a listing page in markup, for reading it back."""
    quote = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), "\n", "<br/>")
    p = current_posts(spark, base)
    tags = F.array_join(F.transform(F.coalesce("hashtags", F.array().cast("array<string>")), lambda t: F.concat(F.lit('<a href="?q=%23'), t, F.lit('">#'), t, F.lit("</a>"))), " ")
    html = F.concat(
        F.lit('<div class="tgme_widget_message_wrap"><div class="tgme_widget_message" data-post="'), F.col("channel"), F.lit("/"), F.col("message_id").cast("string"),
        F.lit('"><div class="tgme_widget_message_text js-message_text">'), quote(F.coalesce("text", F.lit(""))), F.lit("</div>"),
        F.lit('<div class="js-tags">'), tags, F.lit('</div><span class="tgme_widget_message_views">'), F.coalesce(F.col("views_value").cast("string"), F.lit("")),
        F.lit('</span><time datetime="'), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit('">x</time></div></div>'),
    )
    return p.select(html.alias("html"))


def _coverage(s, d):
    return integrity.coverage(table(s, d, "post"))


def _halves(s, d) -> tuple[DataFrame, DataFrame]:
    """Stored and new posts: deliveries with even and odd row ids, newest of each."""
    rows = table(s, d, "post").select("channel", "message_id", "row_id", "fetched_at", "text", "views_value")
    pick = lambda part: newest_rows(rows.where(F.col("row_id") % 2 == part), ["row_id", "text", "views_value", "fetched_at"]).drop("fetched_at")
    return pick(0), pick(1)


def _same_text(s, d):
    """Edited deliveries whose text is the same but for a few words, by the longest common subsequence."""
    rows = table(s, d, "post").where(F.col("text").isNotNull()).select("channel", "message_id", "row_id", "fetched_at", "text")
    both = rows.groupBy("channel", "message_id").agg(F.min_by("text", F.struct("fetched_at", "row_id")).alias("first"), F.max_by("text", F.struct("fetched_at", "row_id")).alias("last"))
    return both.where(F.col("first") != F.col("last")).select("channel", "message_id", similar_texts(F.col("first"), F.col("last")).alias("same"))


QUERIES = {
    "word_search_single": _search("crashes", "words"),
    "word_search_and": _search("layout engine crashes", "words"),
    "word_search_surface": _search("layout engine crashes", "words", with_stems=False),
    "word_search_diacritics": _search("Generateur déjà", "words"),
    "word_search_cyrillic_yo": _search("ещё работает", "words"),
    "word_search_stems": _search("уведомления сервисы", "words"),
    "phrase_search": _search('"code generator"', "words"),
    "phrase_surface": _search('"code generator"', "words", with_stems=False),
    "phrase_with_loose_word": _search('«build cache» slow', "words"),
    "phrase_vs_and": lambda s, d: index.hits(document_index(s, d), '"layout engine"', "words").agg(F.count(F.lit(1)).alias("phrase")).select("phrase", F.lit(index.hits(document_index(s, d), "layout engine", "words").count()).cast("bigint").alias("loose")),
    "substring_search": _search("yout engi", "substring"),
    "substring_rare": _search("üllenfe", "substring"),
    "substring_with_marks": _search("fig. 3", "substring"),
    "search_both_merged": _search("push token", "both"),
    "search_both_total": lambda s, d: s.range(1).select(F.lit(index.page_of(document_index(s, d), "retry", "both", search.SearchFilter(), 0, 0)[1]).cast("bigint").alias("total")),
    "search_filtered_channel": _search("release", "words", search.SearchFilter(channel="@Export/Loomlab")),
    "search_filtered_kind": _search("release", "both", search.SearchFilter(kind="en")),
    "search_filtered_phrase": _search('"code generator"', "both", search.SearchFilter(kind="en")),
    "search_date_from_to": _search("release", "words", search.SearchFilter(since=parse_bound(IN_2024["since"])[0], until=parse_bound(IN_2024["until"])[0])),
    "search_day_exclusive": _search("release", "words", search.SearchFilter(before=day_after(parse_bound("2024-06-30")[0]))),
    "search_top_20": _page("search index", "both", 0, 20),
    "search_page_2": _page("search index", "both", 20, 20),
    "search_page_of_7": _page("search index", "words", 14, 7),
    "search_page_past_words": _page("yout engine", "both", 0, 500),
    "bm25_rank_ties": lambda s, d: index.hits(document_index(s, d), "the", "words").groupBy(F.round("rank", 9).alias("rank")).agg(F.count(F.lit(1)).alias("documents")),
    "post_search_widened": lambda s, d: _shown(index.hits(post_index(s, d), "crash reporter", "words")),
    "post_search_both": lambda s, d: _shown(index.hits(post_index(s, d), "reporter", "both")),
    "search_without_index": lambda s, d: _shown(search.hits(search.indexed(searchable_documents(s, d)), "push token", "both")),
    "token_document_frequency": lambda s, d: index.document_frequencies(document_index(s, d)),
    "stem_document_frequency": lambda s, d: index.document_frequencies(document_index(s, d), index.STEM),
    "doc_length_stats": lambda s, d: document_index(s, d).texts.agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("dl"), 6).alias("average"), F.max("dl").cast("bigint").alias("longest")),
    "stale_index_rows": lambda s, d: index.stale_documents(document_index(s, d), searchable_documents(s, d).where(F.col("kind") != "en")),
    "url_canonical": lambda s, d: table(s, d, "link").select("link_id", canonical_url_of(F.col("url_raw")).alias("url_canonical"), F.lit(SPEC_VERSION).alias("spec_version")).distinct(),
    "effective_url": lambda s, d: links.resolved_links(table(s, d, "link"), table(s, d, "url_resolution")).select("link_id", "url_canonical", "resolved_canonical", "effective").distinct(),
    "links_to_url": lambda s, d: links.links_to(table(s, d, "link"), table(s, d, "url_resolution"), "http://www.sho.example/1017/?utm_source=feed").select("link_id", "channel", "message_id", "ord", "effective"),
    "link_sharings_by_canonical": lambda s, d: links.shared_resources(table(s, d, "link"), table(s, d, "url_resolution")),
    "channel_integrity": _coverage,
    "channel_longest_gap": lambda s, d: integrity.coverage(table(s, d, "post")).select("channel", "longest_gap", "longest_gap_start", "alarm"),
    "channel_post_counts": lambda s, d: integrity.post_counts(table(s, d, "post")),
    "upsert_keep_existing": lambda s, d: store.keep_existing(*_halves(s, d)),
    "upsert_replace": lambda s, d: store.replace_existing(*_halves(s, d)),
    "import_written_and_kept": lambda s, d: store.written_and_kept(*_halves(s, d)),
    "sender_carry_over": lambda s, d: carry_forward(current_posts(s, d).select("channel", "message_id", F.nullif(F.trim("author_name"), F.lit("")).alias("author")), "channel", "message_id", "author", "sender").select("channel", "message_id", "sender"),
    "post_detail_nested": lambda s, d: records.hydrated(current_posts(s, d).select("channel", "message_id", "text", "hashtags"), table(s, d, "link"), table(s, d, "reaction")).select(
        "channel", "message_id", "text", "hashtags", F.transform("links", lambda x: F.struct(x["ord"].alias("ord"), x["link_id"].alias("link_id"), x["url_canonical"].alias("url_canonical"))).alias("links"), F.transform("reactions", lambda x: F.struct(x["reaction_id"].alias("reaction_id"), x["emoji"].alias("emoji"), x["count"].alias("count"))).alias("reactions")
    ),
    "snippet_projection": lambda s, d: current_posts(s, d).select("channel", "message_id", snippet(F.col("text"), F.col("poll.question")).alias("snippet")),
    "permalink_projection": lambda s, d: current_posts(s, d).select(permalink(F.col("channel"), F.col("message_id")).alias("link"), iso_instant(F.col("fetched_at")).alias("fetched")),
    "reaction_totals": lambda s, d: records.reaction_totals(current_posts(s, d), table(s, d, "reaction")),
    "most_reacted_posts": lambda s, d: records.single_reactions(table(s, d, "reaction")).groupBy("channel", "message_id").agg(F.sum("count").alias("total")).orderBy(F.desc("total"), "channel", "message_id").limit(50),
    "poll_options_explode": lambda s, d: current_posts(s, d).where(F.col("poll").isNotNull()).select("channel", "message_id", "poll.question", F.posexplode("poll.options").alias("ord", "option"), "poll.total_votes"),
    "hashtag_counts": lambda s, d: current_posts(s, d).select(F.explode("hashtags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("uses")),
    "event_props_json": lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")),
    "channel_fold": lambda s, d: table(s, d, "post").where(F.col("forward_channel").isNotNull()).groupBy(fold_channel(F.col("forward_channel")).alias("channel")).agg(F.count(F.lit(1)).alias("forwards")),
    "channel_chat_ids": lambda s, d: table(s, d, "channel").select("channel", chat_id(F.col("raw_channel_id")).alias("chat_id"), store.known_reachability().alias("reachability")),
    "page_posts_extracted": lambda s, d: listing_posts(rendered_pages(s, d)).select("channel", "message_id", "date", "text", "kind", "hashtags", F.col("views.value").alias("views")),
    "same_text_ratio": _same_text,
}

# ---- the same in DuckDB -------------------------------------------------------------------


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(lower(regexp_replace(translate(coalesce({text}, ''), 'ёЁ', 'еЕ'), '[\x{{300}}-\x{{36F}}]', '', 'g')), '{FOLD_FROM}', '{FOLD_TO}'), '[\p{{L}}\p{{N}}\p{{Co}}]+')"


_ENDINGS = "|".join(sorted({*CYRILLIC_ENDINGS, *LATIN_ENDINGS}, key=lambda e: (-len(e), e)))
_STEMS = rf"list_transform(w, lambda x: regexp_replace(x, '^(.{{3,}}?)(?:{_ENDINGS})$', '\1'))"
_DOCS = f"words_of AS (SELECT source AS channel, doc_id AS message_id, collected_at AS date, lang AS kind, translate(coalesce(text, ''), 'ёЁ', 'еЕ') AS folded, {_words('text')} AS w FROM documents), docs AS (SELECT *, {_STEMS} AS st FROM words_of)"


def _stem_sql(word: str) -> str:
    return f"regexp_replace('{word}', '^(.{{3,}}?)(?:{_ENDINGS})$', '\\1')"


def _bm25(counts: list[str], length: str, hit: str, name: str, where: str = "true") -> str:
    """CTEs that rank the hits of ``docs``; ``counts`` are SQL expressions over its words, stems and folded text."""
    cols = ", ".join(f"{c} AS f{i}" for i, c in enumerate(counts))
    seen = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(counts)))
    rank = " ".join(f"- greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(counts)))
    return f"""{name}_f AS (SELECT channel, message_id, date, kind, {length} AS dl, {cols} FROM docs),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS mean, {seen} FROM {name}_f),
{name} AS (SELECT channel, message_id, date, kind, 0.0 {rank} AS rank FROM {name}_f, {name}_s WHERE {hit} AND {where})"""


def _count_sql(words: list[str], line: str) -> str:
    """How often ``words`` (SQL expressions) stand one after another in a list."""
    if len(words) == 1:
        return f"len(list_filter({line}, lambda x: x = {words[0]}))"
    return f"len(list_filter(range(1, greatest(len({line}) - {len(words)} + 2, 2)), lambda i: {line}[i : i + {len(words) - 1}] = [{', '.join(words)}]))"


def _word_sql(tokens: list[str], phrases: list[list[str]] = (), where: str = "true", docs: str = _DOCS, stems: bool = True) -> str:
    counts, hit = [], []
    for p in [[t] for t in tokens] + list(phrases):
        mine = [_count_sql([f"'{w}'" for w in p], "w")] + ([_count_sql([_stem_sql(w) for w in p], "st")] if stems else [])
        hit.append("(" + " OR ".join(f"f{len(counts) + k} > 0" for k in range(len(mine))) + ")")
        counts += mine
    return f"WITH {docs}, {_bm25(counts, 'len(w) + len(st)' if stems else 'len(w)', ' AND '.join(hit), 'words', where)}"


def _substring_parts(literal: str, where: str = "true") -> str:
    count = f"CASE WHEN contains(lower(folded), '{literal}') THEN len(list_filter(range(1, length(folded) + 1), lambda i: substr(lower(folded), i, {len(literal)}) = '{literal}')) ELSE 0 END"
    return _bm25([count], "greatest(length(lower(folded)) - 2, 0)", "f0 > 0", "subs", where)


_SHOWN = "SELECT channel, message_id, 0 AS tier, round(rank, 9) AS rank FROM words"


def _both(tokens: list[str], literal: str, where: str = "true", phrases: list[list[str]] = (), docs: str = _DOCS) -> str:
    return _word_sql(tokens, phrases, where, docs) + f", {_substring_parts(literal, where)}, merged AS (SELECT *, 0 AS tier FROM words UNION ALL SELECT *, 1 AS tier FROM subs s WHERE NOT EXISTS (SELECT 1 FROM words x WHERE x.channel = s.channel AND x.message_id = s.message_id))"


_MERGED = " SELECT channel, message_id, tier, round(rank, 9) AS rank FROM merged"
_ORDER = " ORDER BY tier, round(rank, 12), channel, message_id"
_PAGE = _both(["search", "index"], "search index") + _MERGED + _ORDER
_BM25_PAGE = lambda text: _both(text.split(), text)
_NEWEST = "newest AS (SELECT DISTINCT ON (channel, message_id) * FROM post WHERE channel IS NOT NULL AND message_id IS NOT NULL ORDER BY channel, message_id, fetched_at DESC, row_id DESC)"
_POST_DOCS = (
    f"{_NEWEST}, previews AS (SELECT channel, message_id, array_to_string(list_sort(list(DISTINCT concat_ws(chr(10), preview.title, preview.description))), chr(10)) AS lines FROM link GROUP BY ALL), "
    "contents AS (SELECT channel, message_id, fetched_at, kind, concat_ws(chr(10), text, array_to_string(list_transform(hashtags, lambda t: '#' || t), chr(10)), poll.question, array_to_string(poll.options, chr(10)), author_name, lines) AS content FROM newest LEFT JOIN previews USING (channel, message_id)), "
    f"words_of AS (SELECT channel, message_id, fetched_at AS date, kind, translate(content, 'ёЁ', 'еЕ') AS folded, {_words('content')} AS w FROM contents), docs AS (SELECT *, {_STEMS} AS st FROM words_of)"
)
_LINKS = "resolved AS (SELECT l.*, r.resolved_canonical, coalesce(r.resolved_canonical, l.url_canonical) AS effective FROM link l LEFT JOIN url_resolution r USING (url_canonical))"
_GAPS = """WITH spans AS (SELECT channel, message_id AS lo, message_id + greatest(max(coalesce(media_count, 1)), 1) - 1 AS hi FROM post GROUP BY channel, message_id),
seen AS (SELECT *, max(hi) OVER (PARTITION BY channel ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM spans),
gaps AS (SELECT *, coalesce(greatest(lo - last - 1, 0), 0) AS gap, last + 1 AS gap_start, greatest(hi - greatest(lo - 1, coalesce(last, lo - 1)), 0) AS fresh FROM seen),
found AS (SELECT channel, min(lo) AS lowest, max(hi) AS highest, count(*) AS posts, CAST(sum(fresh) AS BIGINT) AS covered, CAST(sum(gap) AS BIGINT) AS unexplained, max(gap) AS longest_gap,
  CASE WHEN max(gap) > 0 THEN arg_min(gap_start, (-gap, gap_start)) END AS longest_gap_start, max(gap) >= 25 AS alarm, round(100.0 * CAST(sum(fresh) AS BIGINT) / (max(hi) - min(lo) + 1), 1) AS coverage FROM gaps GROUP BY channel)"""
_HALVES = """WITH stored AS (SELECT DISTINCT ON (channel, message_id) channel, message_id, row_id, text, views_value FROM post WHERE row_id % 2 = 0 ORDER BY channel, message_id, fetched_at DESC, row_id DESC),
new AS (SELECT DISTINCT ON (channel, message_id) channel, message_id, row_id, text, views_value FROM post WHERE row_id % 2 = 1 ORDER BY channel, message_id, fetched_at DESC, row_id DESC)"""
_SNIPPET = "trim(replace(coalesce(CASE WHEN coalesce(text, '') = '' THEN poll.question ELSE text END, ''), chr(10), ' '), ' ')"

SQL = {
    "word_search_single": _word_sql(["crashes"]) + _SHOWN,
    "word_search_and": _word_sql(["layout", "engine", "crashes"]) + _SHOWN,
    "word_search_surface": _word_sql(["layout", "engine", "crashes"], stems=False).replace("len(w) AS dl", "2 * len(w) AS dl") + _SHOWN,
    "word_search_diacritics": _word_sql(["generateur", "deja"]) + _SHOWN,
    "word_search_cyrillic_yo": _word_sql(["еще", "работает"]) + _SHOWN,
    "word_search_stems": _word_sql(["уведомления", "сервисы"]) + _SHOWN,
    "phrase_search": _word_sql([], [["code", "generator"]]) + _SHOWN,
    "phrase_surface": _word_sql([], [["code", "generator"]], stems=False).replace("len(w) AS dl", "2 * len(w) AS dl") + _SHOWN,
    "phrase_with_loose_word": _word_sql(["slow"], [["build", "cache"]]) + _SHOWN,
    "phrase_vs_and": _word_sql([], [["layout", "engine"]]) + f", {_word_sql(['layout', 'engine']).partition('st FROM words_of), ')[2].replace('words', 'loose')} SELECT (SELECT count(*) FROM words) AS phrase, (SELECT count(*) FROM loose) AS loose",
    "substring_search": f"WITH {_DOCS}, {_substring_parts('yout engi')} SELECT channel, message_id, 0 AS tier, round(rank, 9) AS rank FROM subs",
    "substring_rare": f"WITH {_DOCS}, {_substring_parts('üllenfe')} SELECT channel, message_id, 0 AS tier, round(rank, 9) AS rank FROM subs",
    "substring_with_marks": f"WITH {_DOCS}, {_substring_parts('fig. 3')} SELECT channel, message_id, 0 AS tier, round(rank, 9) AS rank FROM subs",
    "search_both_merged": _both(["push", "token"], "push token") + _MERGED,
    "search_both_total": _both(["retry"], "retry") + " SELECT count(*) AS total FROM merged",
    "search_filtered_channel": _word_sql(["release"], where="channel = 'export/loomlab'") + _SHOWN,
    "search_filtered_kind": _both(["release"], "release", "kind = 'en'") + _MERGED,
    "search_filtered_phrase": _both([], "code generator", "kind = 'en'", [["code", "generator"]]) + _MERGED,
    "search_date_from_to": _word_sql(["release"], where=f"date >= TIMESTAMPTZ '{IN_2024['since']}' AND date <= TIMESTAMPTZ '{IN_2024['until']}'") + _SHOWN,
    "search_day_exclusive": _word_sql(["release"], where="date < TIMESTAMPTZ '2024-07-01T00:00:00Z'") + _SHOWN,
    "search_top_20": _PAGE + " LIMIT 20",
    "search_page_2": _PAGE + " LIMIT 20 OFFSET 20",
    "search_page_of_7": _word_sql(["search", "index"]) + " SELECT channel, message_id, 0 AS tier, round(rank, 9) AS rank FROM words" + _ORDER.replace("tier, ", "") + " LIMIT 7 OFFSET 14",
    "search_page_past_words": _both(["yout", "engine"], "yout engine") + _MERGED + _ORDER + " LIMIT 500",
    "bm25_rank_ties": _word_sql(["the"]) + " SELECT round(rank, 9) AS rank, count(*) AS documents FROM words GROUP BY 1",
    "post_search_widened": _word_sql(["crash", "reporter"], docs=_POST_DOCS) + _SHOWN,
    "post_search_both": _both(["reporter"], "reporter", docs=_POST_DOCS) + _MERGED,
    "search_without_index": _both(["push", "token"], "push token") + _MERGED,
    "token_document_frequency": f"WITH {_DOCS} SELECT word, count(*) AS documents, CAST(sum(n) AS BIGINT) AS occurrences FROM (SELECT channel, message_id, word, count(*) AS n FROM (SELECT channel, message_id, unnest(w) AS word FROM docs) GROUP BY ALL) GROUP BY word",
    "stem_document_frequency": f"WITH {_DOCS} SELECT word, count(*) AS documents, CAST(sum(n) AS BIGINT) AS occurrences FROM (SELECT channel, message_id, word, count(*) AS n FROM (SELECT channel, message_id, unnest(st) AS word FROM docs) GROUP BY ALL) GROUP BY word",
    "doc_length_stats": f"WITH {_DOCS} SELECT count(*) AS documents, round(avg(len(w) + len(st)), 6) AS average, CAST(max(len(w) + len(st)) AS BIGINT) AS longest FROM docs",
    "stale_index_rows": "SELECT source AS channel, doc_id AS message_id FROM documents WHERE lang = 'en' OR lang IS NULL",
    "url_canonical": "SELECT DISTINCT link_id, url_canonical, 3 AS spec_version FROM link",
    "effective_url": f"WITH {_LINKS} SELECT DISTINCT link_id, url_canonical, resolved_canonical, effective FROM resolved",
    "links_to_url": f"WITH {_LINKS} SELECT link_id, channel, message_id, ord, effective FROM resolved WHERE effective = coalesce((SELECT resolved_canonical FROM url_resolution WHERE url_canonical = 'https://sho.example/1017'), 'https://sho.example/1017')",
    "link_sharings_by_canonical": f"WITH {_LINKS} SELECT effective, count(DISTINCT (channel, message_id)) AS posts, count(DISTINCT channel) AS channels FROM resolved WHERE effective IS NOT NULL GROUP BY effective HAVING count(DISTINCT (channel, message_id)) >= 2",
    "channel_integrity": _GAPS + " SELECT * FROM found",
    "channel_longest_gap": _GAPS + " SELECT channel, longest_gap, longest_gap_start, alarm FROM found",
    "channel_post_counts": "SELECT channel, count(DISTINCT message_id) AS posts FROM post GROUP BY channel",
    "upsert_keep_existing": _HALVES + " SELECT * FROM stored UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.channel = n.channel AND s.message_id = n.message_id)",
    "upsert_replace": _HALVES + " SELECT * FROM new UNION ALL SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM new n WHERE s.channel = n.channel AND s.message_id = n.message_id)",
    "import_written_and_kept": _HALVES + " SELECT count(*) FILTER (s.row_id IS NULL) AS written, count(*) FILTER (s.row_id IS NOT NULL) AS kept FROM new n LEFT JOIN stored s USING (channel, message_id)",
    "sender_carry_over": f"WITH {_NEWEST} SELECT channel, message_id, last_value(nullif(trim(author_name, ' '), '') IGNORE NULLS) OVER (PARTITION BY channel ORDER BY message_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sender FROM newest",
    "post_detail_nested": f"""WITH {_NEWEST},
l AS (SELECT channel, message_id, list({{'ord': ord, 'link_id': link_id, 'url_canonical': url_canonical}} ORDER BY ord, link_id) AS links FROM (SELECT DISTINCT ON (link_id) * FROM link) GROUP BY ALL),
r AS (SELECT channel, message_id, list({{'reaction_id': reaction_id, 'emoji': emoji, 'count': count}} ORDER BY reaction_id) AS reactions FROM (SELECT DISTINCT ON (reaction_id) * FROM reaction ORDER BY reaction_id, count DESC) GROUP BY ALL)
SELECT channel, message_id, text, hashtags, coalesce(links, []) AS links, coalesce(reactions, []) AS reactions FROM newest LEFT JOIN l USING (channel, message_id) LEFT JOIN r USING (channel, message_id)""",
    "snippet_projection": f"WITH {_NEWEST} SELECT channel, message_id, CASE WHEN length({_SNIPPET}) > 140 THEN substr({_SNIPPET}, 1, 140) || '…' ELSE {_SNIPPET} END AS snippet FROM newest",
    "permalink_projection": f"WITH {_NEWEST} SELECT 'https://t.me/' || channel || '/' || message_id AS link, strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(fetched_at) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS fetched FROM newest",
    "reaction_totals": f"WITH {_NEWEST} SELECT channel, message_id, CAST(coalesce(sum(count), 0) AS BIGINT) AS total FROM newest LEFT JOIN (SELECT DISTINCT ON (reaction_id) * FROM reaction ORDER BY reaction_id, count DESC) USING (channel, message_id) GROUP BY channel, message_id",
    "most_reacted_posts": "SELECT channel, message_id, CAST(sum(count) AS BIGINT) AS total FROM (SELECT DISTINCT ON (reaction_id) * FROM reaction ORDER BY reaction_id, count DESC) GROUP BY channel, message_id ORDER BY total DESC, channel, message_id LIMIT 50",
    "poll_options_explode": f"WITH {_NEWEST} SELECT channel, message_id, poll.question AS question, CAST(i - 1 AS INTEGER) AS ord, poll.options[i] AS option, poll.total_votes AS total_votes FROM newest, unnest(range(1, len(poll.options) + 1)) AS t(i) WHERE poll IS NOT NULL",
    "hashtag_counts": f"WITH {_NEWEST} SELECT tag, count(*) AS uses FROM (SELECT unnest(hashtags) AS tag FROM newest) GROUP BY tag",
    "event_props_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "channel_fold": "SELECT lower(regexp_replace(forward_channel, '^@+', '')) AS channel, count(*) AS forwards FROM post WHERE forward_channel IS NOT NULL GROUP BY 1",
    "channel_chat_ids": "SELECT channel, -1000000000000 - raw_channel_id AS chat_id, CASE WHEN reachability IN ('webPreview', 'previewDisabled', 'group', 'unresolvable') THEN reachability END AS reachability FROM channel",
    # The longest common subsequence by rows: each place of a row is the largest of what the places before it offer.
    "same_text_ratio": r"""WITH RECURSIVE pair AS (SELECT channel, message_id, arg_min(text, (fetched_at, row_id)) AS t1, arg_max(text, (fetched_at, row_id)) AS t2 FROM post WHERE text IS NOT NULL GROUP BY channel, message_id),
w AS (SELECT channel, message_id, regexp_extract_all(lower(t1), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(t2), '[\p{L}\p{N}]+') AS b FROM pair WHERE t1 <> t2),
dp AS (SELECT channel, message_id, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0) AS r FROM w
  UNION ALL SELECT channel, message_id, a, b, i + 1, list_transform(range(0, len(b) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k: CASE WHEN k = 0 THEN 0 ELSE greatest(r[k + 1], r[k] + CASE WHEN a[i + 1] = b[k] THEN 1 ELSE 0 END) END))) FROM dp WHERE i < len(a))
SELECT channel, message_id, a = b OR r[len(b) + 1] >= 0.9 * greatest(len(a), len(b)) AS same FROM dp WHERE i = len(a)""",
    "page_posts_extracted": rf"WITH {_NEWEST} SELECT channel, message_id, date_trunc('second', fetched_at) AS date, body AS text, CASE WHEN body <> '' THEN 'text' ELSE 'unknown' END AS kind, [] AS hashtags, views_value AS views FROM (SELECT *, nfc_normalize(regexp_replace(coalesce(text, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS body FROM newest)",
}
