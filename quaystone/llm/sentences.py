"""Sentences of texts in any script.

Candidates are runs of sentence-final punctuation outside brackets and quotations.
Each is judged by a maximum-entropy model over its neighbours: what stands before
(length, case, digits, inner stops, how often this word ends a block), what comes
after, and the script. How often words end blocks is counted over all documents. The
weights are fitted on boundaries that leave no doubt, found in a bounded sample of the
documents: stops at the end of a block are boundaries, stops before a small letter, a
comma or a digit of the same number are none. The fit starts from and is held to prior
weights, so that little data do no harm.
"""

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm.sampling import hashed_sample

# Words with a stop that introduce a name or number, whatever follows.
INTRODUCING = frozenset(
    "mr mrs ms dr dra prof profa rev inkl exkl zzgl abzgl evtl ggf gen sen rep st hon capt lt col sgt fr no nos fig figs p pp vol ch sec art eq ref vs cf approx ca hr hrn frau nr abb s bd kap vgl bzw bspw z.b d.h u.a mme mlle m mgr me pr tél sr sra srta dña d núm pág págs cap г-н г-жа гр им ул просп пер пл д кв стр рис табл см ср гл п пп т тт ст тов проф акад доц др напр etc ص د م أ डॉ श्री प्रो".split()
)
# Months that follow a day written with a stop (German, Danish, Norwegian, Czech, Finnish).
MONTHS = frozenset(
    """januar februar märz april mai juni juli august september oktober november dezember jänner marts maj december mars desember
    ledna února března dubna května června července srpna září října listopadu prosince
    tammikuuta helmikuuta maaliskuuta huhtikuuta toukokuuta kesäkuuta heinäkuuta elokuuta syyskuuta lokakuuta marraskuuta joulukuuta""".split()
)
#: Characters of a word: of a longer run without spaces, the last so many are the word before a stop.
WORD = 256
FINAL = ".!?…。！？｡．।॥؟۔"
HARD = frozenset("。！？｡।॥؟۔")
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "‹": "›", '"': '"'}
_ENDINGS = ".!?…"
#: Marks that close what a sentence stands in; those that also open are left to the pairing.
CLOSERS = "')]”’」』）】》›»"

_BLOCK = re.compile(r"\n[^\S\n]*\n\s*|\n(?=[^\S\n]*[•*\-·‣◦▪●][^\S\n])")
_PAIRED = re.compile("[" + re.escape("".join(PAIRS) + "".join(PAIRS.values())) + "]")
_CANDIDATE = re.compile(rf"[{FINAL}](?:(?<!\d\.)|(?!\d))[{FINAL}]*")
_AFTER = re.compile(rf"[{re.escape(CLOSERS)}]*(?:[ \u00a0\u202f]»)?")
#: All up to the start of the last word.
_UP_TO_WORD = re.compile(r".*[\s“„«「『(（\[\"'¿¡—]", re.DOTALL)
_NEXT = re.compile(r"(\s*)([“„«「『(（\[\"'¿¡—–\s-]*)(\S?)([^\W_]*)")
#: What a block may start with, up to the stop of its numbering.
_NUMBERING = re.compile(r"\s*(?:[•*\-·‣◦▪●]\s+)?(?:\d+(?:\.\d+)*|[A-Za-zА-Яа-я])")


#: Where a sentence ends inside a word because no space follows it.
_JOINED = re.compile(r".*(?:[^\W\d_]{3,}|[\d%)»”])[.!?]+(?=[A-ZÀ-ÖØ-ÞА-ЯЁЄІЇ])")


def _last_word(text: str, at: int, stop: int) -> str:
    """The word that stands before ``stop`` in a block that starts at ``at``."""
    near = max(at, stop - 24)
    word = text[near:stop].removesuffix("\n")
    m = _UP_TO_WORD.match(word)
    if m is None and near > at:  # it is longer than usual
        word = text[max(at, stop - WORD) : stop].removesuffix("\n")
        m = _UP_TO_WORD.match(word)
    if m:
        word = word[m.end() :]
    m = _JOINED.match(word) if "." in word or "!" in word or "?" in word else None
    return word[m.end() :] if m else word


@lru_cache(maxsize=1 << 14)
def _kind(c: str) -> str:
    if not c:
        return "none"
    if c.islower():
        return "lower"
    if c.isupper() or c.istitle():
        return "upper"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "caseless"
    category = unicodedata.category(c)
    return "picture" if category in ("So", "Sk") or ord(c) > 0x1F000 else "mark"


@lru_cache(maxsize=1 << 16)
def _shape(word: str) -> tuple[str, ...]:
    """Features of the word before the stop."""
    bare = word.lower().strip(".")
    letters = [c for c in word if c.isalpha()]
    out = []
    if bare in INTRODUCING:
        out.append("introducing")
    if not letters:
        out.append("number" if bare.isdigit() else "version" if any(c.isdigit() for c in bare) else "bare")
    elif len(bare) == 1:
        out.append("initial" if word[-1:].isupper() else "letter")
    elif "." in bare:
        out.append("inner_stop" if all(len(x) <= 4 for x in bare.split(".")) else "long")
    elif letters[-1].lower() == letters[-1].upper():
        out.append("short_caseless" if len(bare) <= 2 else "long_caseless")
    elif len(bare) <= 3:
        out.append("short")
    else:
        out.append("long")
    return tuple(out)


#: Prior weights: what holds before any document is seen.
PRIOR = {
    "stop": 0.5, "bang": 2.5, "dots": 0.5, "hard": 8.0,
    "next=upper": 2.0, "next=lower": -6.0, "next=digit": 0.0, "next=caseless": 1.5, "next=mark": -5.0, "next=picture": 1.0,
    "stop&introducing&next=upper": -6.0, "stop&introducing": -3.0, "stop&initial": -7.0, "stop&letter": -1.0, "stop&short_caseless": -5.0, "stop&inner_stop&next=digit": -6.0, "stop&short&next=digit": -4.0, "stop&letter&next=digit": -5.0,
    "stop&number&month": -8.0, "stop&pair": -7.0, "stop&numbering": -9.0, "direct": -1.0, "stop&direct&initial": -4.0, "stop&direct&next=digit": -6.0, "stop&direct&next=caseless": 0.5, "direct&next=lower": -4.0,
    "quoted": -0.5, "quoted&before=caseless": -12.0, "hard&next=lower": 0.0, "hard&next=mark": -1.0, "dots&before=caseless": 4.0,
    "rate=never": -4.0, "rate=seldom": -2.0, "rate=usual": 0.5,
}


def _term(run: str) -> str:
    """What a run of punctuation counts as: its full stop, its mark of another script, its ! or ?, else dots."""
    return "." if run == "." else next((c for c in run if c in HARD), None) or next((c for c in run if c in "!?"), None) or "…"


class Boundaries:
    """A fitted model: weights, and how words with a stop stand at the end of blocks."""

    def __init__(self, weights: dict[str, float] | None = None, rates: dict[str, str] | None = None):
        self.weights, self.rates = dict(PRIOR if weights is None else weights), dict(rates or {})
        self._decide = lru_cache(maxsize=1 << 17)(self._score)

    def __getstate__(self) -> tuple:
        return self.weights, self.rates

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def features(self, term: str, word: str, numbering: bool, quoted: bool, before: str, direct: bool, after: str, next_word: str) -> list[str]:
        kind = "hard" if term in HARD else "dots" if term == "…" else "stop" if term == "." else "bang"
        own = [*_shape(word)] if kind in ("stop", "dots") else []
        flags = [f"next={after}", *own]
        if direct:
            flags.append("direct")
        if quoted:
            flags.append("quoted")
        if before == "caseless":
            flags.append("before=caseless")
        if kind == "stop":
            if numbering:
                flags.append("numbering")
            if next_word == ".":  # one of several letters with stops, as in z. B.
                flags.append("pair")
            elif next_word.lower() in MONTHS:
                flags.append("month")
            flags.append(f"rate={self.rates.get(word.lower(), 'new')}")
        out = [kind, *flags]
        out += [f"{kind}&{x}" for x in flags]
        out += [f"{kind}&{x}&{y}" for x in own for y in flags if x != y]
        out += [f"{x}&{y}" for x in ("quoted", "direct") if x in flags for y in flags if y.startswith(("before", "next"))]
        if direct and kind == "stop":
            out += [f"stop&direct&{y}" for y in flags]
        return out

    def _score(self, *context) -> bool:
        weights = self.weights
        return sum(weights.get(f, 0.0) for f in self.features(*context)) > 0

    def candidates(self, text: str) -> Iterator[tuple[int, int, int, tuple | None]]:
        """(block start, block end, candidate's end, context) in order; context is None at the end of a block."""
        for at, stop in self._blocks(text):
            yield from self._in_block(text, at, stop)
            yield at, stop, stop, None

    @staticmethod
    def _blocks(text: str) -> Iterator[tuple[int, int]]:
        at = 0
        for gap in _BLOCK.finditer(text):
            yield at, gap.start()
            at = gap.end()
        yield at, len(text)

    @staticmethod
    def _spans(text: str, at: int, stop: int) -> list[tuple[int, int]]:
        """Outermost bracketed or quoted parts of a block; an opening mark without a closing one opens nothing."""
        stack: list[tuple[str, int]] = []
        found: list[tuple[int, int]] = []
        for m in _PAIRED.finditer(text, at, stop):
            c = m[0]
            for depth in range(len(stack) - 1, -1, -1):
                if c in PAIRS[stack[depth][0]]:
                    found.append((stack[depth][1], m.start()))
                    del stack[depth:]
                    break
            else:
                if c in PAIRS:
                    stack.append((c, m.start()))
        found.sort()
        outer: list[tuple[int, int]] = []
        for lo, hi in found:
            if not outer or lo > outer[-1][1]:
                outer.append((lo, hi))
        return outer

    def _stops(self, text: str, at: int, stop: int) -> Iterator[tuple[int, int, str, bool]]:
        """(start, end with closing marks, punctuation, at the end of a quoted part) of the candidates inside a block."""
        solid = at + len(text[at:stop].rstrip())
        spans = self._spans(text, at, stop)
        k, last = 0, -1
        for m in _CANDIDATE.finditer(text, at, stop):
            i, end = m.start(), m.end()
            if i < last:
                continue
            while k < len(spans) and spans[k][1] < i:
                k += 1
            quoted = False
            if k < len(spans) and spans[k][0] < i:
                close = spans[k][1]
                if text[end:close].strip():
                    continue
                end, quoted = close + 1, True
            if not quoted and end < stop and (not text[end].isspace() or text[end + 1 : end + 2] == "»"):
                end = _AFTER.match(text, end, stop).end()
            last = end
            if end < solid:  # else it is the end of the block
                yield i, end, m[0], quoted

    def _in_block(self, text: str, at: int, stop: int) -> Iterator[tuple[int, int, int, tuple]]:
        numbered = _NUMBERING.match(text, at, stop)
        for i, end, run, quoted in self._stops(text, at, stop):
            term = _term(run)
            word = _last_word(text, at, i) if term in ".…" else ""
            n = _NEXT.match(text, end, stop)
            before = next((c for c in text[max(at, i - 2) : i][::-1] if c.isalnum()), "")
            numbering = term == "." and numbered is not None and numbered.end() == i
            yield at, stop, end, (term, word, numbering, quoted, _kind(before), not n[1], _kind(n[3]), n[3] + n[4] if word.isdigit() else "." if len(word) == 1 and word.isascii() and not n[4] and text[n.end() : n.end() + 1] == "." else "")

    def split(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each sentence, in code points, without outer white space."""
        units, start, begun = [], 0, -1
        for at, _, end, context in self.candidates(text):
            if at != begun:
                start = begun = at
            if context is not None and not self._decide(*context):
                continue
            piece = text[start:end]
            bare = piece.strip()
            if bare:
                lead = len(piece) - len(piece.lstrip())
                units.append((start + lead, start + lead + len(bare)))
            start = end
        return units

    def tally(self, text: str, seen: Counter, ends: Counter) -> None:
        """Add how often each word of ``text`` stands before a stop, and how often before one that ends a block."""
        for at, stop in self._blocks(text):
            for i, _, run, _ in self._stops(text, at, stop):
                if run == ".":
                    seen[_last_word(text, at, i).lower()] += 1
            end = at + len(text[at:stop].rstrip())
            if end > at and text[end - 1] in _ENDINGS:
                while end > at and text[end - 1] in _ENDINGS:
                    end -= 1
                last = _last_word(text, at, end).lower()
                seen[last] += 1
                ends[last] += 1

    @classmethod
    def fit(cls, texts: list[str], strength: float = 0.5, rounds: int = 300, rates: dict[str, str] | None = None) -> "Boundaries":
        """Weights for the reliable boundaries of ``texts``, held to the prior by ``strength``.

        ``rates``: how words end blocks; without them they are counted in ``texts``.
        """
        model = cls(rates=rates)
        ends, seen, examples = Counter(), Counter(), []
        for text in texts:
            if rates is None:
                model.tally(text, seen, ends)
            examples += [(context, None) for _, _, _, context in model.candidates(text) if context is not None]
            # A block's last stop with the first word of the next block is a boundary between two sentences.
            blocks = [b.strip() for b in _BLOCK.split(text)]
            for a, b in zip(blocks, blocks[1:]):
                first = re.match(r"[“„«「『(（\[\"'¿¡]*(\S)", b)
                if a[-1:] and a[-1:] in FINAL and first and first[1] not in "•*-":
                    bare = a.rstrip(FINAL)
                    run = a[len(bare) :]
                    term, word = _term(run), _last_word(bare, 0, len(bare))
                    last = _kind(next((c for c in reversed(word) if c.isalnum()), ""))
                    # Where words are not spaced, sentences are not either.
                    for direct in (False, True) if last == "caseless" and _kind(first[1]) == "caseless" else (False,):
                        examples.append(((term, word if term in ".…" else "", False, False, last, direct, _kind(first[1]), ""), True))
        if rates is None:
            model.rates = judged(((word, n, ends[word]) for word, n in seen.items()), sum(seen.values()), sum(ends.values()))
        grouped: Counter = Counter()
        for context, label in examples:
            if label is None:
                term, word, numbering, quoted, before, direct, after, _ = context
                inside = quoted and before == "caseless"  # a quotation with which the sentence goes on
                if after == "lower" or (after == "mark" and term not in HARD) or (direct and after == "digit" and term == ".") or inside or numbering or (term == "." and model.rates.get(word.lower()) == "never"):
                    label = False
                elif not quoted and ((term in "!?" and after in ("upper", "caseless")) or (term in HARD and after != "mark")):
                    label = True
                else:
                    continue
            grouped[context, label] += 1
        if not grouped:
            return model
        names: dict[str, int] = {}
        rows = [[names.setdefault(f, len(names)) for f in model.features(*context)] for context, _ in grouped]
        x = np.zeros((len(rows), len(names)), dtype=np.float32)
        for i, row in enumerate(rows):
            x[i, row] = 1
        y = np.array([label for _, label in grouped], dtype=np.float32)
        n = np.log1p(np.array(list(grouped.values()), dtype=np.float32))
        prior = np.array([PRIOR.get(f, 0.0) for f in names], dtype=np.float32)
        w, total = prior.copy(), n.sum()
        for step in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (n * (p - y)) / total + strength * (w - prior) / total
            w -= (2.0 / (1 + step / 20)) * grad
        model.weights = PRIOR | dict(zip(names, w.tolist()))
        model._decide.cache_clear()
        return model


#: Sightings below which nothing is said of a word.
LEAST_SEEN = 60
#: Words that a task counts before it hands its counts on.
HELD = 200_000


def judged(counts: Iterable[tuple[str, int, int]], seen: int, ends: int) -> dict[str, str]:
    """How words end blocks, from ``(word, sightings, ends)`` and the sums of both over all words.

    A word never or seldom ends one if the upper 95 % bound (Wilson) of its share lies
    below 5 % and below 0.3 of the share of all words. A few ends among very many sightings
    (texts cut off, slips) leave a word at never. Words without an end whose bound is
    higher are not judged.
    """
    bar = min(0.05, 0.3 * ends / max(seen, 1))
    zz = 1.645**2
    rates = {}
    for word, n, k in counts:
        if n < LEAST_SEEN:
            continue
        share = k / n
        upper = (share + zz / (2 * n) + (zz * (share * (1 - share) / n + zz / (4 * n * n))) ** 0.5) / (1 + zz / n)
        if share >= 0.01:
            rates[word] = "usual"
        elif upper < bar:
            rates[word] = "never" if share < 0.002 else "seldom"
    return rates


def _tally_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model, seen, ends = Boundaries(), Counter(), Counter()

    def counted() -> pa.RecordBatch:
        words = [None, *seen]  # the row without a word has the sums
        all_seen, all_ends = [sum(seen.values()), *seen.values()], [sum(ends.values()), *(ends[w] for w in seen)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(all_seen, pa.int64()), pa.array(all_ends, pa.int64())], ["word", "seen", "ends"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            model.tally(text, seen, ends)
            if len(seen) > HELD:
                yield counted()
                seen.clear()
                ends.clear()
    yield counted()


def block_ends(documents: DataFrame, text: str) -> dict[str, str]:
    """How words end blocks, counted over all documents; tasks hand on one row a word, the driver gets the words seen often."""
    rows = documents.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(text).cast("string"))
    words = rows.mapInArrow(_tally_batches, "word string, seen bigint, ends bigint").groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))
    counts = words.where(F.col("word").isNull() | (F.col("seen") >= LEAST_SEEN)).toArrow().to_pydict()
    found = dict(zip(counts["word"], zip(counts["seen"], counts["ends"])))
    seen, ends = found.pop(None, (0, 0))
    return judged(((word, *n) for word, n in found.items()), seen, ends)


def fit_boundaries(documents: DataFrame, key: str, text: str, sample: int = 1500) -> Boundaries:
    """A model with the block ends of all documents and weights fitted on about ``sample`` of them, chosen by their hashed keys."""
    rows = hashed_sample(documents, key, [F.col(text).alias("t")], sample, F.col(text).isNotNull() & (F.length(text) > 0))
    return Boundaries.fit([r["t"] for r in rows], rates=block_ends(documents, text))


def _split_batches(model: Boundaries, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, starts, ends, order = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                units = model.split(text)
                where += [i] * len(units)
                starts += [u[0] for u in units]
                ends += [u[1] for u in units]
                order += range(1, len(units) + 1)
            keys = batch.column(0).take(pa.array(where, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(order, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], schema=schema)

    return run


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", model: Boundaries | None = None, sample: int = 1500) -> DataFrame:
    """``(key, ordinal, start_char, end_char)``: every sentence of every document, in code points.

    Documents are read whole and never shuffled. Null, empty and blank texts have no
    sentences; repeated rows give repeated sentences.
    """
    model = model or fit_boundaries(documents, key, text, sample)
    rows = documents.where(F.col(text).isNotNull()).select(key, text)
    kind = rows.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("ordinal", T.IntegerType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    return rows.mapInArrow(_split_batches(model, to_arrow_schema(out)), out)


def sentence_texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, sentences)``: the sentences of each document as an array of texts; documents without any have no row."""
    model = fit_boundaries(documents, key, text)
    split = F.pandas_udf(lambda s: s.map(lambda t: [t[a:b] for a, b in model.split(t)]), T.ArrayType(T.StringType()), F.PandasUDFType.SCALAR)
    split = split.asNondeterministic()  # else the filter below splits every text a second time
    rows = documents.where(F.col(text).isNotNull()).select(key, split(F.col(text)).alias("sentences"))
    return rows.where(F.size("sentences") > 0)
