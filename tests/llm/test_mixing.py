"""Drawing to target shares: constraints kept, caps kept, shares reached, on skewed sources."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaystone.llm import mixing

DOC = "doc_id bigint, source string, text string, tokens string, p string"
TARGET = "source string, target_share double, max_copies int"


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 400), st.floats(0.01, 0.99), st.integers(0, 10**6))
def test_flight_keeps_both_totals(n, share, seed):
    tokens = np.random.default_rng(seed).integers(1, 3000, n)
    out = mixing.flight(np.full(n, share), tokens, seed)
    assert out.sum() == pytest.approx(share * n, abs=1e-6 * (n + 1))
    assert (out * tokens).sum() == pytest.approx(share * tokens.sum(), rel=1e-6, abs=1e-3)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    whole = mixing.land(out, tokens)
    assert set(np.unique(whole)) <= {0.0, 1.0}


def test_flight_is_fair():
    tokens = np.arange(1, 21) * 10
    mean = np.mean([mixing.land(mixing.flight(np.full(20, 0.3), tokens, s), tokens) for s in range(800)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.08


def test_goals():
    assert mixing._goals({"a": (0.5, 100), "b": (0.5, 1000)}, None) == {"a": 100.0, "b": 100.0}
    assert mixing._goals({"a": (0.5, 100), "b": (0.5, 1000)}, 600) == {"a": 100.0, "b": 500.0}
    assert mixing._goals({}, None) == {}


@pytest.fixture(scope="module")
def tables(spark):
    def rows(source, n, start, words):
        return [(start + i, source, "word " * (words + i % 7), "x", "y") for i in range(n)]

    docs = rows("big", 1500, 0, 20) + rows("small", 30, 5000, 15) + rows("unwanted", 20, 6000, 5) + [(7000, None, "x", "", ""), (None, "big", "x", "", ""), (7001, "big", None, "", ""), (7002, "big", "", "", "")]
    docs += docs[:3]
    return spark.createDataFrame(docs, DOC), spark.createDataFrame([("big", 0.6, 2), ("small", 0.3, 4), ("absent", 0.1, 3), ("never", 0.0, 3)], TARGET)


def test_mix(tables):
    copies, shares = mixing.mix(*tables, faithful=True, group=200)
    got = {r["source"]: r for r in shares.collect()}
    assert set(got) == {"big", "small", "absent", "never"} and got["absent"]["tokens"] == 0
    assert got["big"]["reached_share"] == pytest.approx(2 / 3, abs=0.01) and got["small"]["reached_share"] == pytest.approx(1 / 3, abs=0.01)
    assert got["small"]["most_copies"] == 4 and got["big"]["most_copies"] <= 2
    assert copies.count() == copies.select("doc_id").distinct().count() and copies.where(F.col("source") == "unwanted").count() == 0
    again, _ = mixing.mix(tables[0].repartition(7), tables[1], faithful=True, group=200)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, copies.collect()))


def test_scarce_sources_fall_short_and_the_others_fill(tables):
    docs, targets = tables
    copies, shares = mixing.mix(docs, targets, group=200)
    got = {r["source"]: r for r in shares.collect()}
    sizes = {r["source"]: r["t"] for r in mixing.with_tokens(docs.where("source is not null and doc_id is not null").dropDuplicates(["doc_id"]), "text", "n").groupBy("source").agg(F.sum("n").alias("t")).collect()}
    # The mix is as large as the sources wanted; the small one gives its four copies of everything, which is less than its share.
    assert got["small"]["tokens"] == 4 * sizes["small"] and got["small"]["limited"] and got["small"]["reached_share"] < 0.3
    assert sum(r["tokens"] for r in got.values()) == pytest.approx(sizes["small"] + sizes["big"], rel=0.002) and not got["big"]["limited"]
    assert sum(r["reached_share"] for r in got.values()) == pytest.approx(1)
    by_source = {r["source"]: r for r in copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("copies").alias("m"), F.sum("copies").alias("u")).collect()}
    for name, row in by_source.items():
        assert (got[name]["tokens"], got[name]["most_copies"], got[name]["uses"]) == (row["t"], row["m"], row["u"]) and row["m"] <= got[name]["max_copies"]


def test_a_mix_of_too_many_sources_is_refused(tables, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    with pytest.raises(ValueError):
        mixing.mix(*tables)


def test_mix_with_total_and_empty_tables(tables):
    docs, targets = tables
    _, shares = mixing.mix(docs, targets, total=20_000)
    got = {r["source"]: r for r in shares.collect()}
    assert got["small"]["most_copies"] == 4 and sum(r["tokens"] for r in got.values()) == pytest.approx(20_000, rel=0.02)
    assert {r["tokens"] for r in mixing.mix(docs.limit(0), targets)[1].collect()} == {0}
    assert mixing.mix(docs, targets.limit(0))[0].count() == 0
