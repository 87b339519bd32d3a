"""Pages and records as plain text."""

from __future__ import annotations

from pyspark.sql import Row

from quaystone.api import Page


def hit_line(hit: Row) -> str:
    """One line: address, author and kind, reactions, snippet."""
    who = f" {hit['author']}" if hit["author"] else ""
    reactions = f" ({hit['reactions']} reactions)" if hit["reactions"] else ""
    return f"{hit['link']}{who} [{hit['kind']}]{reactions}: {hit['snippet']}"


def page_text(page: Page, query: str) -> str:
    """All hits of a page with a footer that says how many there are and how to go on."""
    if not page.total:
        return f"Nothing matches {query!r}. All words must match; quotes make an ordered phrase."
    lines = [hit_line(h) for h in page.hits]
    lines.append(f"{len(page.hits)} of {page.total}" + (f"; next page: {page.next_cursor}" if page.next_cursor else "; last page"))
    if page.index_moved:
        lines.append("The archive has changed since the first page; hits may repeat or be missing.")
    return "\n".join(lines)


def record_text(post: Row) -> str:
    """A whole record: heading, text, poll, links and reactions."""
    lines = [f"{post['channel']}/{post['message_id']} {post['date']} [{post['kind']}]" + (f" by {post['author_name']}" if post["author_name"] else ""), post["text"] or ""]
    if post["poll"]:
        lines += [f"Poll: {post['poll']['question']}", *(f"- {o}" for o in post["poll"]["options"])]
    lines += [f"Link: {x['url_raw']}" for x in post["links"]]
    if post["reactions"]:
        lines.append("Reactions: " + ", ".join(f"{r['emoji'] or 'paid'} {r['count']}" for r in post["reactions"]))
    return "\n".join(lines)
