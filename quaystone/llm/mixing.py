"""Drawing documents so that each source has its target share of all tokens.

Every document of a source gets the same expected number of copies; its whole part
is given, its fraction is drawn by the cube method. Probabilities are moved along
the null space of two constraints (number of documents, number of tokens) until all
but two in a group are 0 or 1. Groups are bounded: what is left of each goes to
groups of the next round, and only a handful of documents a source is landed.
"""

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.session import cut_lineage

#: Where the public tokenizers' files are, and the one that is counted with.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Documents in one group of the drawing.
GROUP = 4000
#: Sources that a mix may have: what is sent to the driver and to all tasks is one row for each.
MAX_SOURCES = 100_000


@lru_cache(maxsize=2)
def _encoder(folder: str, vocabulary: str):
    import importlib.util
    import sys

    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers", f"{folder}/__init__.py")
    module = sys.modules.get("public_tokenizers") or importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(f"{folder}/{vocabulary}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, out: str = "tokens", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``out``, the number of tokens of ``text`` (null: 0). Texts are counted whole."""

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(folder, vocabulary).encode_ordinary
        for batch in texts:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int64")

    # Said to be nondeterministic, it is evaluated once a row and not again by a filter on its result.
    counter = F.pandas_udf(count, T.LongType(), F.PandasUDFType.SCALAR_ITER).asNondeterministic()
    return df.withColumn(out, counter(F.col(text)))


def flight(share: np.ndarray, tokens: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities moved until at most two are fractions; their sum and the sum of share x tokens stay."""
    draw = np.random.default_rng(seed)
    out = share.astype(float).tolist()
    size = tokens.astype(float).tolist()
    open_units: list[int] = []
    for k in draw.permutation(len(out)).tolist():
        if not 1e-9 < out[k] < 1 - 1e-9:
            continue
        open_units.append(k)
        if len(open_units) < 3:
            continue
        a, b, c = open_units
        # The null space of ((1, 1, 1), (token counts)).
        move = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if move == (0, 0, 0):
            move = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for unit, m in zip(open_units, move):
            if m > 0:
                up, down = min(up, (1 - out[unit]) / m), min(down, out[unit] / m)
            elif m < 0:
                up, down = min(up, out[unit] / -m), min(down, (1 - out[unit]) / -m)
        step = up if draw.random() * (up + down) < down else -down
        for unit, m in zip(open_units, move):
            out[unit] += step * m
        open_units = [u for u in open_units if 1e-9 < out[u] < 1 - 1e-9]
    return np.clip(np.array(out), 0, 1)


def land(share: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The 0-1 choice of the last few documents nearest to the tokens they still stand for."""
    left = [i for i, p in enumerate(share) if 1e-9 < p < 1 - 1e-9]
    goal = float(sum(share[i] * tokens[i] for i in left))
    best = min(product((0, 1), repeat=len(left)), key=lambda pick: abs(sum(x * tokens[i] for x, i in zip(pick, left)) - goal))
    out = np.round(share)
    out[left] = best
    return out


_STATE = T.StructType([T.StructField("doc", T.LongType()), T.StructField("src", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("h", T.LongType())])


def _fly(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["h", "doc"], kind="stable")
    group["p"] = flight(group["p"].to_numpy(), group["tokens"].to_numpy(), int(group["h"].iloc[0]) & 0x7FFFFFFF)
    return group[["doc", "src", "tokens", "p", "h"]]


def _fly_and_land(group: pd.DataFrame) -> pd.DataFrame:
    group = _fly(group)
    group["p"] = land(group["p"].to_numpy(), group["tokens"].to_numpy())
    return group


def _draw(rows: DataFrame, per_source: int, group: int) -> DataFrame:
    """0-1 picks for rows (doc, src, tokens, p, h): flight in bounded groups, the rest in fewer groups, and so on."""
    rest, done = rows, None
    while True:
        groups = -(-per_source // group)
        last = groups <= 1
        moved = rest.withColumn("g", F.lit(0) if last else F.pmod(F.xxhash64("h", F.lit(per_source)), F.lit(groups)).cast("int"))
        moved = cut_lineage(moved.groupBy("src", "g").applyInPandas(_fly_and_land if last else _fly, _STATE))
        whole = (F.col("p") < 1e-9) | (F.col("p") > 1 - 1e-9)
        decided = moved.where(whole)
        done = decided if done is None else done.unionByName(decided)
        if last:
            return done
        rest, per_source = moved.where(~whole), 2 * groups


def _few(df: DataFrame) -> list:
    rows = df.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"a mix has at most {MAX_SOURCES} sources")
    return rows


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, faithful: bool = False, seed: int = 17, group: int = GROUP, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(copies, shares): ``(doc_id, source, tokens, copies)`` of each document used, and the shares reached.

    ``targets`` has source, target_share, max_copies. ``total`` is the size of the mix in
    tokens, by default that of all documents of the sources wanted. Sources that cannot
    fill their part give all they may, ``limited`` says which, and the others fill the
    rest in proportion. With ``faithful`` the mix is instead the largest in which every
    source that has tokens reaches its share among those; the scarcest source then sets
    its size. Sources without target are not used; rows with null doc_id or
    source and documents without tokens neither; repeated rows of a document are drawn
    as one. ``shares`` has a row for each target, also if the source has no documents.
    """
    wanted = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_copies") > 0)).groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_copies").alias("cap"))
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & F.col("text").isNotNull()).select("doc_id", "source", "text")
    counted = with_tokens(rows.join(wanted.select("source"), "source", "left_semi"), "text", folder=folder, vocabulary=vocabulary)
    sizes = cut_lineage(counted.where(F.col("tokens") > 0).groupBy(F.col("doc_id").alias("doc"), F.col("source").alias("src")).agg(F.max("tokens").alias("tokens")))
    # One row a source: bounded by the number of targets, and small by their nature.
    have = {r["src"]: (r["tokens"], r["docs"]) for r in _few(sizes.groupBy("src").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))}
    plan = {r["source"]: (r["share"], r["cap"]) for r in _few(wanted)}
    size = None if faithful else sum(tokens for tokens, _ in have.values()) if total is None else total
    goal = _goals({s: (share, cap * have[s][0]) for s, (share, cap) in plan.items() if s in have}, size)
    full = [s for s in goal if goal[s] >= plan[s][1] * have[s][0] * (1 - 1e-12)]
    spark = documents.sparkSession
    ratio = spark.createDataFrame([(s, goal[s] / have[s][0], plan[s][1]) for s in goal], "src string, ratio double, cap bigint")
    given = sizes.join(F.broadcast(ratio), "src").withColumn("base", F.least(F.floor(F.col("ratio") + 1e-9), F.col("cap")))
    given = given.withColumn("p", F.when(F.col("base") >= F.col("cap"), 0.0).otherwise(F.greatest(F.col("ratio") - F.col("base"), F.lit(0.0)))).withColumn("h", F.xxhash64("doc", F.lit(seed)))
    most = max((n for _, n in have.values()), default=0)
    picked = _draw(given.select("doc", "src", "tokens", "p", "h"), most, group)
    copies = picked.join(F.broadcast(ratio), "src").select(
        F.col("doc").alias("doc_id"), F.col("src").alias("source"), "tokens", (F.least(F.floor(F.col("ratio") + 1e-9), F.col("cap")) + F.round("p")).cast("bigint").alias("copies")
    )
    copies = copies.where(F.col("copies") > 0)
    used = cut_lineage(copies).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("uses"), F.max("copies").alias("most_copies"))
    shares = targets.select("source", "target_share", "max_copies").join(used, "source", "left").na.fill(0, ["tokens", "uses", "most_copies"])
    whole = used.agg(F.sum("tokens").alias("whole")).first()["whole"] or 0
    reached = F.col("tokens") / F.lit(float(whole)) if whole else F.lit(0.0)
    shares = shares.select("source", "target_share", "max_copies", "tokens", "uses", "most_copies", reached.alias("reached_share"), F.col("source").isin(full).alias("limited"))
    return copies, shares


def _goals(sources: dict[str, tuple[float, int]], total: int | None) -> dict[str, float]:
    """Tokens each source gives; ``sources``: share wanted, and tokens it may give at most."""
    whole = sum(share for share, _ in sources.values())
    if not whole:
        return {}
    if total is None:
        total = min(most / (share / whole) for share, most in sources.values())
        return {s: total * share / whole for s, (share, _) in sources.items()}
    goal: dict[str, float] = {}
    left, rest = float(total), dict(sources)
    while rest:
        whole = sum(share for share, _ in rest.values())
        full = {s: most for s, (share, most) in rest.items() if most <= left * share / whole}
        if not full:
            return goal | {s: left * share / whole for s, (share, _) in rest.items()}
        goal |= {s: float(most) for s, most in full.items()}
        left -= sum(full.values())
        rest = {s: x for s, x in rest.items() if s not in full}
    return goal


def shares_reached(documents: DataFrame, targets: DataFrame, faithful: bool = False) -> DataFrame:
    """Shares that a mix as large as the documents of the sources wanted reaches, by source."""
    return mix(documents, targets, faithful=faithful)[1]


def copies_drawn(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents of that mix with their numbers of copies."""
    return mix(documents, targets)[0]
