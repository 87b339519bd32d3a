"""Text that looks the same in different characters, brought to one spelling.

Each base letter has a set of scripts in which something looks like it. The sets
are intersected over a token: one script left means the token can only be meant
in that script (a mixed spelling is put right), several mean that the whole token
could be either (it follows the letters of the text that leave no choice), none
means that the token joins scripts and is cut where the intersection runs empty.
Full-width forms, combining accents, invisible characters and special spaces are
normalised besides. As every step depends only on what a character looks like, two
texts get the same form exactly if they look the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm.conversations import has_visible
from quaystone.session import cut_lineage

# Letters that look alike, as Latin, Cyrillic, Greek ("-": none).
ALIKE = """
A А Α
B В Β
C С Ϲ
E Е Ε
H Н Η
I І Ι
J Ј Ϳ
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
S Ѕ -
T Т Τ
X Х Χ
Y У Υ
Z - Ζ
a а α
c с ϲ
e е -
i і ι
j ј ϳ
o о ο
p р ρ
s ѕ -
u - υ
v ѵ ν
x х χ
y у γ
h һ -
d ԁ -
q ԛ -
w ԝ -
"""
#: Of these, letters that hardly any language uses.
RARE = set("ѕЅһԁԛԝѵјЈϲϹϳͿ")
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")

#: Look-alike letter to its spellings by script. ``public_classes`` adds the other scripts.
CLASSES: dict[str, dict[str, str]] = {}
for _line in ALIKE.split("\n"):
    _spelled = {s: c for s, c in zip(SCRIPTS, _line.split()) if c != "-"}
    for _letter in _spelled.values():
        CLASSES[_letter] = _spelled

#: Spaces that look like the plain one, and characters that are not seen at all.
SPACES = {c: " " for c in map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))}
UNSEEN = {chr(c): None for c in (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x200B, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0)}
HYPHENS = {"\u2010": "-", "\u2011": "-"}
#: Joiners shape the letters of some scripts and join pictures; elsewhere they are not seen.
_JOINING = "\u0600-\u06ff\u0900-\u0dff\u2600-\u27bf\U0001f000-\U0001faff"
_JOINERS = re.compile(f"(?<![{_JOINING}])[\u200c\u200d]|[\u200c\u200d](?![{_JOINING}])")
#: Full-width and half-width forms.
WIDTHS = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFFEF) if unicodedata.decomposition(chr(c)).startswith(("<wide>", "<narrow>"))}
_FIRST = str.maketrans(SPACES | UNSEEN | HYPHENS | WIDTHS)

_SPECIAL = re.compile("[" + "".join(map(re.escape, SPACES | UNSEEN | HYPHENS | WIDTHS)) + "\u200c\u200d]")
_TOKENS = re.compile(r"([^\W\d_]+)")
_MARKED = re.compile("((?:[^\\W\\d_][\u0300-\u036f]*)+)")
#: Latin, Cyrillic and Greek letters; tokens without any of these are left alone.
_CASED = re.compile("[A-Za-z\u00c0-\u052f\u1f00-\u1fff]")
_MARKS = re.compile("[\u0300-\u036f]")


class Spelling:
    """The consistent spelling under one table of look-alike letters."""

    def __init__(self, classes: dict[str, dict[str, str]] | None = None):
        self.classes = CLASSES if classes is None else classes
        self.scripts = (*SCRIPTS, *sorted({s for spelled in self.classes.values() for s in spelled} - set(SCRIPTS)))
        further = "".join(sorted(c for c in self.classes if not _CASED.match(c)))
        self._cased = re.compile(f"{_CASED.pattern[:-1]}{re.escape(further)}]") if further else _CASED
        self._letter = lru_cache(maxsize=1 << 14)(self._letter_of)
        self._resolve = lru_cache(maxsize=1 << 16)(self._resolve_token)

    def __getstate__(self) -> dict:
        return {"classes": self.classes}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["classes"])

    def _letter_of(self, base: str) -> frozenset[str]:
        if base in self.classes:
            return frozenset(self.classes[base])
        if not base.isalpha():  # a superscript goes with any script
            return frozenset((*self.scripts, "OTHER"))
        name = unicodedata.name(base, "").split(" ")[0]
        return frozenset((name if name in self.scripts else "OTHER",))

    def runs(self, token: str) -> list[tuple[str, frozenset[str]]]:
        """The decomposed token as runs whose letters share a script, each with its resolved set."""
        runs: list[tuple[str, frozenset[str]]] = []
        text, scripts = "", frozenset()
        for c in unicodedata.normalize("NFD", token):
            if unicodedata.combining(c):
                text += c
                continue
            own = self._letter(c)
            both = scripts & own if text else own
            if text and not both:
                runs.append((text, scripts))
                text, both = "", own
            text, scripts = text + c, both
        return [*runs, (text, scripts)]

    def _spelled(self, run: str, script: str) -> str:
        return "".join(self.classes[c].get(script, c) if c in self.classes else c for c in run)

    def _resolved(self, token: str) -> tuple[str | None, str | None, tuple]:
        """``_resolve_token``, kept for tokens of a usual length."""
        return self._resolve(token) if len(token) <= 64 else self._resolve_token(token)

    def _resolve_token(self, token: str) -> tuple[str | None, str | None, tuple]:
        """(spelling or None where the context decides, script of its last letters, runs)."""
        runs = self.runs(token)
        if all(len(scripts) == 1 for _, scripts in runs):
            spelled = unicodedata.normalize("NFC", "".join(self._spelled(run, min(scripts)) for run, scripts in runs))
            return spelled, min(runs[-1][1]), ()
        return None, None, tuple(runs)

    def _rank(self, script: str) -> int:
        return self.scripts.index(script) if script in self.scripts else len(self.scripts)

    def _in_context(self, runs: tuple, script: str | None, by_digits: bool) -> str:
        """Spelling of a token that could be of several scripts: the one with the fewest letters that hardly any language uses, then Latin beside digits (codes, hex), else the script of the last word that leaves no choice."""
        want = "LATIN" if by_digits or script is None or any(c.isnumeric() for run, _ in runs for c in run) else script
        best = [min(scripts, key=lambda s: (sum(_is_rare(c) for c in self._spelled(run, s)), s != want, self._rank(s))) for run, scripts in runs]
        return unicodedata.normalize("NFC", "".join(self._spelled(run, s) for (run, _), s in zip(runs, best)))

    def form(self, text: str) -> str:
        """The one spelling of ``text``: what looks the same comes out the same. Line breaks, case, accents and punctuation stay."""
        if text.isascii():
            return text
        if _SPECIAL.search(text):
            text = text.translate(_FIRST)
            if "\u200c" in text or "\u200d" in text:
                text = _JOINERS.sub("", text)
        text = unicodedata.normalize("NFC", text)
        if text.isascii() or not self._cased.search(text):
            return text
        # Accents that do not compose with a look-alike belong to its token.
        parts = (_MARKED if _MARKS.search(text) else _TOKENS).split(text)
        resolve, script, changed, open_at = self._resolve, None, False, []
        for i in range(1, len(parts), 2):
            token = parts[i]
            spelled, now, _ = resolve(token) if len(token) <= 64 else self._resolve_token(token)
            if spelled is None:
                if script is None:
                    open_at.append(i)
                    continue
                spelled = self._beside(parts, i, script)
            elif now != "OTHER":
                script = now
                if open_at:  # words before the first that leaves no choice
                    for j in open_at:
                        first = self._beside(parts, j, script)
                        if first != parts[j]:
                            parts[j], changed = first, True
                    open_at = []
            if spelled != token:
                parts[i], changed = spelled, True
        for j in open_at:
            first = self._in_context(self._resolved(parts[j])[2], None, False)
            if first != parts[j]:
                parts[j], changed = first, True
        return "".join(parts) if changed else text

    def _beside(self, parts: list[str], i: int, script: str) -> str:
        """A token that could be of several scripts, with the digits that may stand beside it."""
        return self._in_context(self._resolved(parts[i])[2], script, parts[i - 1][-1:].isdigit() or parts[i + 1][:1].isdigit())


def _is_rare(letter: str) -> bool:
    """Letters that hardly any language of today uses: the listed ones, and Cyrillic beyond the letters of living alphabets."""
    return letter in RARE or "\u0460" <= letter <= "\u0489" or "\u04c0" == letter or "\u04cf" == letter or "\u0500" <= letter <= "\u052f" or "\ua640" <= letter <= "\ua69f"


_BASE = Spelling()


def consistent_form(text: str) -> str:
    """``Spelling.form`` under the table of this module, which knows three scripts."""
    return _BASE.form(text)


def public_classes(spark: SparkSession) -> tuple[dict[str, dict[str, str]], str]:
    """(CLASSES and the look-alikes of all other scripts with two cases, the data's version), from the public confusables data that the session's ICU library carries.

    Added are letters that ICU holds for one ASCII letter of the same case. Letters of the
    Russian and Greek alphabets keep their classes from above: that a Russian letter
    resembles a small Latin one in some typeface makes no text ambiguous. Without the
    library CLASSES stay as they are, and the version is empty.
    """
    classes = {c: dict(spelled) for c, spelled in CLASSES.items()}
    letters = [c for c in map(chr, range(0x370, 0x1F000)) if unicodedata.category(c) in ("Lu", "Ll") and unicodedata.decomposition(c) == "" and c not in CLASSES and not _ALPHABETS.match(c)]
    try:
        icu = spark._jvm.com.ibm.icu
        skeletons = icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
        version = icu.lang.UCharacter.getUnicodeVersion().toString()
    except (TypeError, AttributeError):
        return classes, ""
    for letter, skeleton in zip(letters, skeletons):
        if skeleton == "l" and letter.isupper():  # one skeleton stands for both
            skeleton = "I"
        script = unicodedata.name(letter).split(" ")[0]
        if len(skeleton) != 1 or not skeleton.isascii() or not skeleton.isalpha() or skeleton.isupper() != letter.isupper() or script in ("LATIN", "MATHEMATICAL"):
            continue
        latin = classes.setdefault(skeleton, {"LATIN": skeleton})
        classes[letter] = latin | {script: letter}
        latin.setdefault(script, letter)
    return classes, version


#: The letters of the Russian and Greek alphabets.
_ALPHABETS = re.compile("[\u0391-\u03a9\u03b1-\u03c9\u0410-\u044f\u0401\u0451]")

_ODD = re.compile("[" + "".join(map(re.escape, SPACES | UNSEEN | HYPHENS | WIDTHS)) + "\u200c\u200d\u0300-\u036f]")
_LOOKS_MIXED = re.compile("[A-Za-z][\u0300-\u036f]*[\u0370-\u052f]|[\u0370-\u052f][\u0300-\u036f]*[A-Za-z]")


def plain_with_places(text: str) -> tuple[str, list[int] | None]:
    """The text as it looks, and for each of its characters (and its end) the place in ``text``; None: the same places."""
    if text.isascii():
        return text, None
    places = None
    if _ODD.search(text):
        out: list[str] = []
        places = []
        for i, c in enumerate(text):
            if c in UNSEEN or c in "\u200c\u200d":
                continue
            if unicodedata.combining(c) and out:
                joined = unicodedata.normalize("NFC", out[-1] + c)
                if len(joined) == 1:
                    out[-1] = joined
                    continue
            for x in WIDTHS.get(c) or SPACES.get(c) or HYPHENS.get(c) or c:
                out.append(x)
                places.append(i)
        places.append(len(text))
        text = "".join(out)
    if not _LOOKS_MIXED.search(text):
        return text, places
    same = consistent_form(text)
    return (same if len(same) == len(text) else text), places


def placed(lo: int, hi: int, text: str, places: list[int] | None) -> tuple[int, int]:
    """A part of the plain text as a part of ``text``: with the marks and unseen characters inside it and the marks on its last letter, not with what follows."""
    if places is None:
        return lo, hi
    end = places[hi - 1] + 1
    while end < len(text) and unicodedata.combining(text[end]):
        end += 1
    return places[lo], end


def token_finding(token: str, spelling: Spelling = _BASE) -> str:
    """``mixed`` (letters of several scripts), ``whole`` (all of it could be another script) or ``single``."""
    runs = spelling.runs(token)
    own = {unicodedata.name(c, "").split(" ")[0] for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c)} & set(spelling.scripts)
    if len(own) > 1:
        return "mixed"
    return "whole" if len(runs) == 1 and len(runs[0][1]) > 1 else "single"


def _former(spelling: Spelling) -> Callable:
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(spelling.form, na_action="ignore")

    return run


def with_form(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """Add ``out``, the consistent form of ``text`` under ``public_classes``; null stays null."""
    form = F.pandas_udf(_former(Spelling(public_classes(df.sparkSession)[0])), T.StringType(), F.PandasUDFType.SCALAR_ITER)
    # Said to be nondeterministic, it is evaluated once a row and not again by a filter on its result.
    return df.withColumn(out, form.asNondeterministic()(F.col(text)))


def _hashes(value: Column, one: str, two: str) -> list[Column]:
    """128 bits of a text in two columns: such keys are hashed, never sorted."""
    return [F.xxhash64(value).alias(one), F.xxhash64(F.lit(7), value).alias(two)]


def _linked(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(__k, f1, f2, t1, t2, links)``: rows that look like a row with another text, with the hashes of their form and text."""
    rows = with_form(df.select(F.col(key).alias("__k"), F.col(text).alias("__t")).where(F.col("__t").isNotNull()), "__t", "__f")
    rows = rows.where(has_visible(F.col("__f")))
    rows = cut_lineage(rows.select("__k", *_hashes(F.col("__f"), "f1", "f2"), *_hashes(F.col("__t"), "t1", "t2")))
    # Most forms have one text: they are left behind before anything is counted.
    several = rows.groupBy("f1", "f2").agg(F.min("t1").alias("a"), F.max("t1").alias("b"), F.min("t2").alias("c"), F.max("t2").alias("d"))
    several = several.where((F.col("a") != F.col("b")) | (F.col("c") != F.col("d"))).select("f1", "f2")
    rows = cut_lineage(rows.join(several, ["f1", "f2"], "left_semi"))
    by_text = rows.groupBy("f1", "f2", "t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    by_form = by_text.groupBy("f1", "f2").agg(F.sum("n").alias("all"))
    links = by_text.join(by_form, ["f1", "f2"]).select("f1", "f2", "t1", "t2", (F.col("all") - F.col("n")).alias("links"))
    return rows.join(links, ["f1", "f2", "t1", "t2"])


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(<key>, class_id, text_id, links)``: one row for each row that looks like a row with another text.

    Rows of one class look the same; those of one text_id are the same; ``links`` counts
    the rows of the class with another text. Texts that are null or without a visible
    character are in no class; an empty table gives none. Only hashes are shuffled, and a
    text that a third of all rows share is one group of a partial aggregate.
    """
    name = lambda one, two: F.lower(F.concat(F.lpad(F.hex(one), 16, "0"), F.lpad(F.hex(two), 16, "0")))
    return _linked(df, key, text).select(F.col("__k").alias(key), name("f1", "f2").alias("class_id"), name("t1", "t2").alias("text_id"), "links")


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(<key>_a, <key>_b)``, a < b: the links of ``look_alike_classes`` written out, rows whose texts differ as stored but look the same.

    All pairs of unequal texts come out, none of equal ones: as many as there are links,
    which grows with the square of a class. Different texts are paired first, one row
    each, and rows are joined to the pairs of their text.
    """
    rows = cut_lineage(_linked(df, key, text).drop("links"))
    spellings = rows.select("f1", "f2", "t1", "t2").distinct()
    other = spellings.select("f1", "f2", F.col("t1").alias("u1"), F.col("t2").alias("u2"))
    before = (F.col("t1") < F.col("u1")) | ((F.col("t1") == F.col("u1")) & (F.col("t2") < F.col("u2")))
    pairs = spellings.join(other, ["f1", "f2"]).where(before).drop("f1", "f2")
    left = rows.select("t1", "t2", F.col("__k").alias("__a")).join(pairs, ["t1", "t2"]).drop("t1", "t2")
    right = rows.select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("__k").alias("__b"))
    both = left.join(right, ["u1", "u2"])
    return both.select(F.least("__a", "__b").alias(f"{key}_a"), F.greatest("__a", "__b").alias(f"{key}_b")).where(F.col(f"{key}_a") < F.col(f"{key}_b"))
