"""Canonical form of web addresses, version 3 of the contract.

Equal resources get equal addresses without asking the network: scheme and host are
unified, tracking parameters and fragments dropped, parameters sorted, escapes of
unreserved characters undone. What is no absolute http(s) address has no form.
"""

from __future__ import annotations

import re
from urllib.parse import quote, unquote, urlsplit

import idna
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPEC_VERSION = 3

# Query parameters that track and do not identify.
TRACKING_PREFIXES = ("utm_",)
TRACKING = frozenset("ssource share startapp ref referrer referer fbclid gclid yclid dclid msclkid twclid igshid _openstat mc_cid mc_eid spm at_medium at_campaign si s".split())
# Named entities that are decoded.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}

_ENTITY = re.compile(r"&(#[xX][0-9A-Fa-f]{1,9}|#[0-9]{1,10}|[A-Za-z]{1,11});")
_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})")
_UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_PATH, _QUERY = "/%:@!$&'()*+,;=-._~", "/?%:@!$&'()*+,;=-._~"


def _entity(match: re.Match) -> str:
    name = match[1]
    if name[0] != "#":
        return ENTITIES.get(name.lower(), match[0])
    code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else match[0]


def decode_entities(text: str) -> str:
    """Entities that end in a semicolon decoded, in at most three passes."""
    for _ in range(3):
        decoded = _ENTITY.sub(_entity, text)
        if decoded == text:
            break
        text = decoded
    return text


def _unreserved(text: str) -> str:
    return _ESCAPE.sub(lambda m: c if (c := chr(int(m[1], 16))) in _UNRESERVED else m[0], text)


def _host(host: str) -> str | None:
    host = unquote(host).lower()
    if not host or re.search(r"[\s/?#@<>\"]", host):
        return None
    if not host.isascii():
        try:
            host = idna.encode(host, uts46=True).decode()
        except idna.IDNAError:
            return None
    return host.removeprefix("www.") or None


def canonical_url(raw: str | None) -> str | None:
    """The canonical form of ``raw``; None if it is no absolute http(s) address with a host."""
    if raw is None:
        return None
    text = decode_entities(raw).strip()
    scheme = re.match(r"(?i)(https?)://", text)
    if not scheme or re.search(r"\s", text):
        return None
    try:
        parts = urlsplit(text)
        port = parts.port
    except ValueError:
        return None
    netloc = parts.netloc.rpartition("@")
    inside = netloc[2]
    if inside.startswith("["):
        host = inside[: inside.find("]") + 1].lower()
    else:
        host = _host(inside.rpartition(":")[0] if re.search(r":\d*$", inside) else inside)
    if not host:
        return None
    user = f"{netloc[0]}@" if netloc[1] else ""
    path = _unreserved(quote(parts.path, safe=_PATH))
    path = path[:-1] if path.endswith("/") else path
    kept = []
    for item in parts.query.split("&") if parts.query else ():
        name, equals, value = item.partition("=")
        plain = unquote(name).lower()
        if item and plain not in TRACKING and not plain.startswith(TRACKING_PREFIXES):
            kept.append((unquote(name), unquote(value), _unreserved(quote(name, safe=_QUERY)) + equals + _unreserved(quote(value, safe=_QUERY))))
    query = "&".join(x[2] for x in sorted(kept, key=lambda x: x[:2]))
    return f"https://{user}{host}{'' if port in (None, 80, 443) else f':{port}'}{path}{'?' if query else ''}{query}"


@F.pandas_udf(T.StringType())
def _canonical(urls: pd.Series) -> pd.Series:
    return urls.map(canonical_url, na_action="ignore")


def canonical_url_of(url: Column) -> Column:
    """``canonical_url`` of a column; null for null and for what is no web address."""
    return _canonical(url)


def is_web_url(url: Column) -> Column:
    """Whether the text starts as an http or https address."""
    return url.startswith("http://") | url.startswith("https://")


def effective_url(resolved: Column, canonical: Column) -> Column:
    """What links are joined on: where a redirect was seen to lead, else the canonical form."""
    return F.coalesce(resolved, canonical)
