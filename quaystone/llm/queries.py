"""Queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from quaystone.llm import conversations, languages, leakage, lookalikes, mixing, personal, sentences, sessions
from quaystone.session import table

QUERIES = {
    "p2_found": lambda s, d: lookalikes.look_alike_pairs(table(s, d, "post"), "row_id", "text"),
    "p2_classes": lambda s, d: lookalikes.look_alike_classes(table(s, d, "post"), "row_id", "text"),
    "p2_consistent": lambda s, d: lookalikes.with_form(table(s, d, "post").select("row_id", "text"), "text", "form"),
    "p5_found": lambda s, d: personal.details(table(s, d, "post"), secret="example"),
    "p5_redacted": lambda s, d: personal.redacted(table(s, d, "post").select("row_id", "text", "author_name"), secret="example"),
    "p5_by_type": lambda s, d: personal.details_by_type(table(s, d, "post")),
    "p6_found": lambda s, d: conversations.conversations(table(s, d, "post")),
    "p6_sessions": lambda s, d: sessions.sessions(table(s, d, "post"), table(s, d, "channel")),
    "p6_sessions_compared": lambda s, d: sessions.compared(table(s, d, "post"), table(s, d, "channel")),
    "p6_sizes": lambda s, d: conversations.conversation_sizes(table(s, d, "post")),
    "p7_found": lambda s, d: languages.mislabelled(table(s, d, "post")),
    "p7_segments": lambda s, d: languages.segment_languages(table(s, d, "post")),
    "p8_found": lambda s, d: leakage.leaks(table(s, d, "documents"), table(s, d, "eval_item")),
    "p8_by_item": lambda s, d: leakage.leaks_by_item(table(s, d, "documents"), table(s, d, "eval_item")),
    "p9_copies": lambda s, d: mixing.copies_drawn(table(s, d, "documents"), table(s, d, "mix_target")),
    "p9_shares": lambda s, d: mixing.shares_reached(table(s, d, "documents"), table(s, d, "mix_target")),
    "p9_faithful_shares": lambda s, d: mixing.shares_reached(table(s, d, "documents"), table(s, d, "mix_target"), faithful=True),
    "p10_found": lambda s, d: sentences.sentences(table(s, d, "documents")).drop("ordinal"),
    "p10_texts": lambda s, d: sentences.sentence_texts(table(s, d, "documents")),
}

_CONVERSATIONS = r"""
WITH RECURSIVE newest AS (
  SELECT DISTINCT ON (channel, message_id) channel, message_id, media_count, reply_to, deleted_at, text,
         nullif(lower(regexp_replace(author_name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '') AS author
  FROM post WHERE message_id IS NOT NULL AND channel IS NOT NULL
  ORDER BY channel, message_id, fetched_at DESC NULLS LAST, row_id DESC),
ids AS (
  SELECT channel, id, max(message_id) AS parent
  FROM (SELECT channel, message_id, unnest(range(message_id, message_id + greatest(coalesce(media_count, 1), 1))) AS id FROM newest) GROUP BY channel, id),
edge AS (
  SELECT n.channel, n.message_id, i.parent FROM newest n JOIN ids i ON i.channel = n.channel AND i.id = n.reply_to),
member AS (
  SELECT channel, message_id AS root, message_id FROM newest WHERE reply_to IS NULL
  UNION ALL
  SELECT e.channel, m.root, e.message_id FROM edge e JOIN member m ON m.channel = e.channel AND m.message_id = e.parent),
full_member AS (
  SELECT m.*, n.author,
         n.author IS NULL OR n.deleted_at IS NOT NULL OR n.text IS NULL OR NOT regexp_matches(n.text, '[^\s\p{Z}\p{Cc}\p{Cf}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}\x{34F}\x{FE00}-\x{FE0F}]') AS bad
  FROM member m JOIN newest n USING (channel, message_id)),
whole AS (
  SELECT channel, root, max(author) FILTER (message_id = root) AS opener
  FROM full_member GROUP BY channel, root HAVING count(*) >= 2 AND NOT bool_or(bad) AND min(author) <> max(author)),
found AS (
  SELECT f.channel, f.root AS root_message_id, f.message_id,
         CAST(row_number() OVER (PARTITION BY f.channel, f.root ORDER BY f.message_id <> f.root, f.message_id) AS INTEGER) AS turn,
         CASE WHEN f.author = w.opener THEN 'opener' ELSE 'replier' END AS speaker_role
  FROM full_member f JOIN whole w USING (channel, root))
"""

_LEAKS = r"""
WITH doc AS (SELECT doc_id AS id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
item AS (SELECT item_id AS id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM eval_item WHERE text IS NOT NULL),
doc_run AS (SELECT DISTINCT id, array_to_string(w[i : i + 11], ' ') AS run FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM doc)),
item_run AS (SELECT DISTINCT id, array_to_string(w[i : i + 11], ' ') AS run FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM item)),
found AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM doc_run d JOIN item_run i USING (run))
"""

SQL = {
    "p6_found": _CONVERSATIONS + "SELECT * FROM found",
    "p6_sizes": _CONVERSATIONS
    + "SELECT channel, count(*) AS conversations, CAST(sum(n) AS BIGINT) AS messages, max(n) AS longest FROM (SELECT channel, root_message_id, count(*) AS n FROM found GROUP BY ALL) GROUP BY channel",
    "p8_found": _LEAKS + "SELECT * FROM found",
    "p8_by_item": _LEAKS + "SELECT item_id, suite, lang, n AS documents FROM eval_item JOIN (SELECT item_id, count(*) AS n FROM found GROUP BY item_id) USING (item_id)",
}
