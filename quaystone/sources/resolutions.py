"""Redirects as recorded by a resolver: import of its log, and the interface to run one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions.urls import canonical_url_of

SCHEMA = "url_canonical string, final_url string, http_status string, hops int, resolved_at string, _corrupt string"


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(resolutions, skipped) of a JSON-lines log.

    A line that is no JSON object, names no address, has a boolean status or a time that
    cannot be read is skipped, with its reason. A status other than 2xx, also a word, is
    a recorded failure: resolved_canonical is null.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    raw = lines.select("value", F.from_json("value", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    status = F.get_json_object("value", "$.http_status")
    # Of a boolean, from_json makes the words true and false; strings are told apart by their quotes.
    boolean = F.col("value").rlike(r'"http_status"\s*:\s*(?:true|false)\b')
    at = F.try_to_timestamp(F.col("r.resolved_at"))
    reason = (
        F.when(F.col("r._corrupt").isNotNull() | F.col("r").isNull(), "not a record")
        .when(F.coalesce(F.col("r.url_canonical"), F.lit("")) == "", "no address")
        .when(boolean, "bad status")
        .when(at.isNull(), "bad time")
    )
    rows = raw.withColumn("reason", reason)
    ok = status.try_cast("int").between(200, 299)
    good = rows.where(F.col("reason").isNull()).select(
        F.col("r.url_canonical").alias("url_canonical"),
        F.when(ok, canonical_url_of(F.col("r.final_url"))).alias("resolved_canonical"),
        status.alias("http_status"),
        F.coalesce("r.hops", F.lit(0)).alias("hops"),
        at.alias("resolved_at"),
    )
    return good, rows.where(F.col("reason").isNotNull()).select("value", "reason")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The newest record of each address; of equal times the new one."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    kept = F.struct(*[c for c in stored.columns if c != "url_canonical"])
    return both.groupBy("url_canonical").agg(F.max_by(kept, F.struct("resolved_at", "__new")).alias("r")).select("url_canonical", "r.*").select(*stored.columns)


#: Redirects that are followed before an address is given up.
MAX_HOPS = 10
# Answers that send a request elsewhere.
REDIRECTS = frozenset((301, 302, 303, 307, 308))


def follow_redirects(url: str, ask: Callable[[str, str], tuple[int, str | None]]) -> tuple[str, str | None, int]:
    """(last address, status, hops) from ``ask(method, url)``, which gives status and location.

    HEAD is asked first and GET only where HEAD is refused (405). A redirect without a
    location ends the way; more than MAX_HOPS give the status TooManyRedirects; an error
    becomes the status by its name.
    """
    at, hops = url, 0
    while hops < MAX_HOPS:
        try:
            status, location = ask("HEAD", at)
            if status == 405:
                status, location = ask("GET", at)
        except Exception as error:  # noqa: BLE001 - any failure is a recorded one
            return at, type(error).__name__, hops
        if status not in REDIRECTS or not location:
            return at, str(status), hops
        at, hops = urljoin(at, location), hops + 1
    return at, "TooManyRedirects", hops


def resolve(urls: DataFrame, ask: Callable[[str, str], tuple[int, str | None]], hosts_at_once: int = 8, done: DataFrame | None = None) -> DataFrame:
    """``(url_canonical, final_url, http_status, hops)``: each address once, one request at a time a host, ``hosts_at_once`` tasks.

    ``ask`` does the network part on the executors. Addresses that ``done`` (an earlier
    log's resolutions) has are left out, so a run that was broken off goes on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(url, *follow_redirects(url, ask)) for url in batch["url_canonical"]], columns=["url_canonical", "final_url", "http_status", "hops"])

    host = F.regexp_extract("url_canonical", "^https?://([^/?#]+)", 1)
    todo = urls.select("url_canonical").where(F.col("url_canonical").isNotNull()).distinct()
    if done is not None:
        todo = todo.join(done.select("url_canonical"), "url_canonical", "left_anti")
    each = todo.withColumn("host", host).repartition(hosts_at_once, "host").select("url_canonical")
    return each.mapInPandas(run, "url_canonical string, final_url string, http_status string, hops int")
