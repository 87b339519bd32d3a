"""Languages of texts and of their segments, whatever their labels say.

A text is a mixture: each sentence comes from one of the text's languages. Sentences
are scored by character n-gram models; expectation-maximisation estimates how much
of the text each language has, and the set of languages is grown as long as the
likelihood gains more than a penalty for one more language. A ninth model, of which
nothing is known but the number of its letters, takes what is in none of the eight. The
models are counted on a bounded sample of labelled texts whose wrong labels are sorted
out in rounds.
"""

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm.lookalikes import placed, plain_with_places
from quaystone.llm.sampling import hashed_sample

LANGUAGES = ("en", "ru", "de", "fr", "es", "uk", "pt", "ja")
#: The language of segments in none of these.
UNKNOWN = "und"
# What labels name, by code and by name (in English and in the language itself).
NAMED = {
    "en": "en eng english", "ru": "ru rus russian русский", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castellano",
    "uk": "uk ukr ukrainian українська", "pt": "pt por portuguese português portugues", "ja": "ja jpn jp japanese 日本語",
    "it": "it ita italian italiano", "zh": "zh zho chi chinese 中文", "hi": "hi hin hindi हिन्दी", "ar": "ar ara arabic العربية", "pl": "pl pol polish polski", "nl": "nl nld dut dutch nederlands", "tr": "tr tur turkish türkçe", "ko": "ko kor korean 한국어",
}
LABELS = {name: code for code, names in NAMED.items() for name in names.split()}

#: What makes no language: handles, tags and words with digits; links and mailboxes; version marks in brackets.
_CODES = re.compile(r"[#@][^\s#@]+|(?<![A-Za-z])[A-Za-z]*\d[A-Za-z\d]*(?:[./\-][A-Za-z\d]+)*")
_LINKS = re.compile(r"https?://\S+|(?<![\w.-])[\w.-]+\.\w+/\S*|(?<![\w.+-])[\w.+-]+(?: ?@ ?|\s?[\[(]at[\])]\s?)[\w-]+(?:(?:\.| dot |\s?[\[(]dot[\])]\s?)[\w-]+)+")
_MARKS = re.compile(r"[(\[][^()\[\]\s]{0,14}[ -]?[^()\[\]\s]{0,6}\d[^()\[\]\s]{0,8}[)\]]")
_SEGMENT = re.compile(r"(?:[^.!?。！？\n]|[.!?](?=[^\s.!?]))+[.!?。！？]*")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_KANA = re.compile("[\u3040-\u30ff]")
#: Japanese is written without spaces: four characters make a word here.
_CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff]{1,4}")
_HAS_CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff]")


def label_language(label: Column) -> Column:
    """The language code that a label names, however spelt (code, region form or name); null if it names none."""
    base = F.lower(F.regexp_extract(F.trim(label), r"^([^\s_\-]+)", 1))
    return F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[base]


def words_in(segment: str) -> list[str]:
    """Lower-case words of a segment; Japanese script is cut from Latin names inside it and into pieces."""
    if _HAS_CJK.search(segment):
        runs = _CJK.findall(segment)
        return runs + _WORD.findall(_CJK.sub(" ", segment).lower())
    return _WORD.findall(segment.lower())


class LanguageModel:
    """Character n-gram models: log-likelihood of a word under each language, and under none, against the best one, smoothed over shorter contexts."""

    ORDER = 4
    #: Of an unknown language: each of its letters is as likely as any other.
    LETTERS = 36
    #: The most, in nats, by which one word can speak against a language: a name decides nothing.
    VOTE = 8.0

    def __init__(self, counts: dict[str, Counter]):
        """``counts``: for each language, its words with their frequencies."""
        self.languages = tuple(counts)
        grams: dict[str, dict[str, float]] = {}
        totals: dict[str, dict[str, float]] = {}
        for lang, words in counts.items():
            g: dict[str, float] = defaultdict(float)
            t: dict[str, float] = defaultdict(float)
            for word, n in words.items():
                weight = float(n)
                s = f"\x02{word}\x03"
                for i in range(1, len(s)):
                    for k in range(self.ORDER):
                        if i - k < 0:
                            break
                        g[s[i - k : i + 1]] += weight
                        t[s[i - k : i]] += weight
            grams[lang], totals[lang] = dict(g), dict(t)
        self._grams, self._totals = grams, totals
        self._cache: dict[str, np.ndarray] = {}

    def __getstate__(self) -> tuple:
        return self.languages, self._grams, self._totals

    def __setstate__(self, state: tuple) -> None:
        self.languages, self._grams, self._totals = state
        self._cache = {}

    def word(self, word: str) -> np.ndarray:
        found = self._cache.get(word)
        if found is None:
            known = np.array([self._score(word, lang) for lang in self.languages], dtype=np.float32)
            unknown = -math.log(self.LETTERS) * (len(word) + 1) - known.max()
            found = np.clip(np.append(known - known.max(), np.float32(unknown)), -self.VOTE, self.VOTE)
            if len(self._cache) > 200_000:
                self._cache.clear()
            if len(word) <= 64:  # what is longer hardly comes again
                self._cache[word] = found
        return found

    def _score(self, word: str, lang: str) -> float:
        grams, totals, s, out = self._grams[lang], self._totals[lang], f"\x02{word}\x03", 0.0
        for i in range(1, len(s)):
            p = 1e-5
            for k in range(min(self.ORDER, i + 1)):
                seen = totals.get(s[i - k : i])
                if not seen:
                    break
                p = (grams.get(s[i - k : i + 1], 0.0) + 4.0 * p) / (seen + 4.0)
            out += math.log(p)
        return out


def _bare(text: str, blank: str | Callable = " ") -> str:
    """The text without what makes no language."""
    if "@" in text or "/" in text or "at)" in text or "at]" in text:
        text = _LINKS.sub(blank, text)
    if "(" in text or "[" in text:
        text = _MARKS.sub(blank, text)
    return _CODES.sub(blank, text)


def segments_of(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences of a text that hold words; what makes no language is blanked out first."""
    bare = _bare(text, lambda m: " " * len(m[0]))
    out = []
    for m in _SEGMENT.finditer(bare):
        words = words_in(m[0])
        if words:
            out.append((m.start(), m.end(), words))
    return out


def mixture(scores: np.ndarray, weights: np.ndarray, penalty: float, rounds: int = 12) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(languages, their proportions, responsibility of each for each segment) by EM and a penalised choice of the set.

    ``scores``: log-likelihood of each segment under each language; ``weights``: what
    each segment counts for; the last column is the unknown language. Starts from the best
    single known language and adds the one that gains most, while that is more than ``penalty``.
    """

    def fit(chosen: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        part = scores[:, chosen]
        share = np.full(len(chosen), 1 / len(chosen))
        for _ in range(rounds):
            joint = part + np.log(np.maximum(share, 1e-12))
            top = joint.max(axis=1, keepdims=True)
            resp = np.exp(joint - top)
            resp /= resp.sum(axis=1, keepdims=True)
            share = (resp * weights[:, None]).sum(axis=0) / weights.sum()
        joint = part + np.log(np.maximum(share, 1e-12))
        top = joint.max(axis=1, keepdims=True)
        return float((top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))).sum()), share, resp

    chosen = [int(scores[:, :-1].sum(axis=0).argmax())]
    if np.maximum(scores - scores[:, chosen], 0).sum(axis=0).max() <= penalty:
        return chosen, np.ones(1), np.ones((len(scores), 1))
    value, share, resp = fit(chosen)
    while len(chosen) < scores.shape[1]:
        rest = [k for k in range(scores.shape[1]) if k not in chosen]
        gain = [np.maximum(scores[:, k] - scores[:, chosen].max(axis=1), 0).sum() for k in rest]
        best = rest[int(np.argmax(gain))]
        if max(gain) <= penalty:
            break
        more = fit([*chosen, best])
        if more[0] - value <= penalty:
            break
        chosen, (value, share, resp) = [*chosen, best], more
    return chosen, share, resp


class Detector:
    """Finds the languages of whole texts and of their segments."""

    def __init__(self, model: LanguageModel, penalty: float = 12.0):
        self.model, self.penalty = model, penalty

    def detect(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, language, confidence) of each segment with words, in order, in code points of ``text``."""
        return self.detect_all([text])[0]

    def detect_all(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """The same for many texts at once: all words are looked up and summed together."""
        flat, lengths, places, per_text = [], [], [], []
        word = self.model.word
        for text in texts:
            plain, where = plain_with_places(text) if text else ("", None)
            found = segments_of(plain)
            per_text.append(len(found))
            for lo, hi, words in found:
                places.append(placed(lo, hi, text, where))
                lengths.append(len(words))
                flat += words
        if not flat:
            return [[] for _ in texts]
        ids: dict[str, int] = {}
        index = np.fromiter((ids.setdefault(w, len(ids)) for w in flat), dtype=np.int64, count=len(flat))
        table = np.stack([word(w) for w in ids])
        scores = np.add.reduceat(table[index], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0)
        best = scores.argmax(axis=1)
        top = scores[np.arange(len(best)), best]
        sure = 1 / np.exp(np.clip(scores - top[:, None], -60, 0)).sum(axis=1)
        languages, out, at = (*self.model.languages, UNKNOWN), [], 0
        for n in per_text:
            if not n:
                out.append([])
            elif best[at] < len(languages) - 1 and (best[at : at + n] == best[at]).all():  # no other could gain anything
                out.append([(*places[i], languages[best[i]], float(sure[i])) for i in range(at, at + n)])
            else:
                chosen, _, resp = mixture(scores[at : at + n].astype(np.float64), np.asarray(lengths[at : at + n], dtype=np.float64), self.penalty)
                pick = resp.argmax(axis=1)
                out.append([(*places[at + i], languages[chosen[pick[i]]], float(resp[i, pick[i]])) for i in range(n)])
            at += n
        return out


    def sets(self, texts: list[str | None]) -> list[list[str]]:
        """The sorted known languages of each text, as ``detect_all`` finds them.

        No segment can gain more for a further language than its words do one by one,
        so texts whose words together gain no more than the penalty are in one
        language and need no segments.
        """
        flat, lengths, which = [], [], []
        for i, text in enumerate(texts):
            words = words_in(_bare(plain_with_places(text)[0])) if text else ()
            if words:
                flat += words
                lengths.append(len(words))
                which.append(i)
        out: list[list[str]] = [[] for _ in texts]
        if not flat:
            return out
        ids: dict[str, int] = {}
        known = ids.get
        for w in flat:
            if w not in ids:
                ids[w] = len(ids)
        index = np.array([known(w) for w in flat])
        scores = np.stack([self.model.word(w) for w in ids])[index]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        best = np.add.reduceat(scores[:, :-1], starts, axis=0).argmax(axis=1)
        own = scores[np.arange(len(index)), np.repeat(best, lengths)]
        gain = np.add.reduceat(np.maximum(scores - own[:, None], 0), starts, axis=0).max(axis=1)
        rest = []
        for i, b, g in zip(which, best.tolist(), gain.tolist()):
            if g <= self.penalty:
                out[i] = [self.model.languages[b]]
            else:
                rest.append(i)
        for i, found in zip(rest, self.detect_all([texts[i] for i in rest])):
            out[i] = sorted({lang for _, _, lang, _ in found} - {UNKNOWN})
        return out


def train(rows: list[tuple[str, str | None]], languages: tuple[str, ...] = LANGUAGES, rounds: int = 3) -> LanguageModel:
    """A model from (text, label) rows; after each round, segments go to the language they fit best, so wrong labels and mixed texts lose their weight."""
    split: list[tuple[list[list[str]], str | None]] = [([w for _, _, w in segments_of(plain_with_places(text)[0])], label) for text, label in rows if text]
    counts = {lang: Counter() for lang in languages}
    for segments, label in split:
        if label in counts:
            for words in segments:
                # Kana is written in Japanese only, and Japanese hardly ever without; Cyrillic in two of the languages.
                if _script_fits(words, label):
                    counts[label].update(words)
    model = LanguageModel({lang: _own_words(counts, lang) for lang in languages})
    for _ in range(rounds):
        counts = {lang: Counter() for lang in languages}
        memo: dict[tuple, int] = {}
        for segments, label in split:
            for words in segments:
                key = tuple(words)
                if key not in memo:
                    memo[key] = int(np.sum([model.word(w) for w in words], axis=0)[:-1].argmax())
                lang = languages[memo[key]]
                if len(words) >= 4 or lang == label:
                    counts[lang].update(words)
        model = LanguageModel(counts)
    return model


_SCRIPT = {"ja": _KANA, "ru": re.compile("[\u0400-\u04ff]"), "uk": re.compile("[\u0400-\u04ff]")}
_LATIN = re.compile("[A-Za-z]")


def _script_fits(words: list[str], lang: str) -> bool:
    text = " ".join(words)
    if lang in _SCRIPT:
        return bool(_SCRIPT[lang].search(text))
    return bool(_LATIN.search(text)) and not any(s.search(text) for s in _SCRIPT.values())


def _own_words(counts: dict[str, Counter], lang: str) -> Counter:
    """Words of a language without those that are far more frequent, for its size, in another."""
    size = {k: max(1, c.total()) for k, c in counts.items()}
    own = Counter()
    for word, n in counts[lang].items():
        share = n / size[lang]
        if all(share * 6 >= c.get(word, 0) / size[k] for k, c in counts.items()):
            own[word] = n
    return own


def fit_detector(posts: DataFrame, key: str = "row_id", text: str = "text", label: str = "lang", sample: int = 12_000) -> Detector:
    """A detector trained on about ``sample`` labelled rows, chosen by their hashed keys."""
    named = label_language(F.col(label))
    rows = hashed_sample(posts, key, [F.col(text).alias("t"), named.alias("l")], sample, F.col(text).isNotNull() & named.isin(*LANGUAGES))
    return Detector(train([(r["t"], r["l"]) for r in rows]))


_SEGMENTS = T.ArrayType(
    T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())])
)


def _segmenter(detector: Detector) -> Callable:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"start_char": a, "end_char": b, "lang": l, "confidence": c} for a, b, l, c in found] for found in detector.detect_all(texts.tolist())], dtype=object)

    return run


def _setter(detector: Detector) -> Callable:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(detector.sets(texts.tolist()), dtype=object)

    return run


def with_languages(posts: DataFrame, detector: Detector, text: str = "text", out: str = "languages") -> DataFrame:
    """Add ``out``, the sorted languages of ``text``; an empty array for texts without words of a language."""
    # Said to be nondeterministic, it is evaluated once a row and not again for each later use of its result.
    find = F.pandas_udf(_setter(detector), T.ArrayType(T.StringType()), F.PandasUDFType.SCALAR_ITER).asNondeterministic()
    return posts.withColumn(out, find(F.col(text)))


def mislabelled(posts: DataFrame, key: str = "row_id", text: str = "text", label: str = "lang", detector: Detector | None = None) -> DataFrame:
    """``(key, lang)``: rows whose label names no language or one that the text is not in, or whose text is in several; one row for each language of the text.

    Null, empty and wordless texts are no cases. Nothing is shuffled; repeated rows
    come out repeatedly.
    """
    detector = detector or fit_detector(posts, key, text, label)
    rows = posts.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("__text"), label_language(F.col(label)).alias("__label"))
    rows = with_languages(rows, detector, "__text", "__langs").where(F.size("__langs") > 0)
    case = F.col("__label").isNull() | ~F.array_contains("__langs", F.col("__label")) | (F.size("__langs") > 1)
    return rows.where(case).select(key, F.explode("__langs").alias("lang"))


def segment_languages(posts: DataFrame, key: str = "row_id", text: str = "text", label: str = "lang", detector: Detector | None = None) -> DataFrame:
    """``(key, start_char, end_char, lang, confidence)`` of each segment with words, in code points of the stored text; ``und`` is a language that is none of ours."""
    detector = detector or fit_detector(posts, key, text, label)
    find = F.pandas_udf(_segmenter(detector), _SEGMENTS, F.PandasUDFType.SCALAR_ITER)
    return posts.where(F.col(text).isNotNull()).select(F.col(key), F.explode(find(F.col(text))).alias("__s")).select(key, "__s.*")
