"""Sentence units: the rules one by one, and what holds for any text."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaystone.llm.sentences import Boundaries, block_ends, fit_boundaries, judged, sentence_texts, sentences

CASES = [
    ["One stop.", "Two stops!", "Is it three?"],
    ["Dr. Hargemont measured 34.6 ms on build 4.2, i.e. 32 % less than before.", "Fine."],
    ["J. K. Peñarrosa wrote it in approx. two weeks.", "See fig. 3, p. 787, for the numbers (the old ones were wrong. Sorry!), then run it again."],
    ["“It works. I checked it twice.” was the only answer.", "“Did you try?” asked Ann."],
    ["We stop at 6 p.m.", "See the list."],
    ["Архив занимает 333 тыс. строк и т. д. по списку.", "Это было в 2023 г.", "Новый выпуск вышел."],
    ["По словам г-на Полуветров, сборка 5.4 быстрее на 18.6 %, т. е. почти вдвое.", "Что?!", "«Всё работает. Я проверил.» — так и написали."],
    ["Laut Dr. Hargemont nur 26.5 Sek., d. h. fast die Hälfte.", "Am 3. Oktober erschien es, z. B. für ältere Geräte.", "Das kostet ca. 1.234,50 Euro inkl. Versand."],
    ["Voir fig. 3, p. 337, tout y est.", "Comment ?!", "« Ça marche. J'ai vérifié. » fut la seule réponse.", "Bon... la liste a fini par passer."],
    ["“能用。我试过两次。”这是唯一的回复。", "什么？！", "崩溃减少了16.8%（旧数据有误。抱歉！），请再看一遍。", "我们在找人……", "结果发现了。"],
    ["Osterwick说：“再编译一次！”然后就下线了。", "版本14.5.2需要内存！"],
    ["「動いた。でも遅い。」と返事が来ました。", "え？！", "計測では25.7秒でした。"],
    ["इस सप्ताह हम लिखेंगे॥", "डॉ. Brestovel के अनुसार 23.4 प्रतिशत।", "“क्या आपने फिर से बनाया?” Hargemont ने पूछा।", "यह काम करता है!"],
    ["الأرقام في ص. 813 من الدليل.", "قال د. Velkarin إن سجل الأخطاء يعمل الآن!", "هل قاس أحد؟"],
    ["Docs live at docs.velum.example/v471.html and nowhere else.", "Roll it back to 16.7.6.", "Next."],
]
JOINED = {"Archive is full.Next one is here.": 2, "It works!Dr. Velkarin measured it.": 2, "месяц.И. О. Снегоряев написал.": 2, "Node 3.5 is out": 1, "1.2. Results": 1, "* one\n* two\n\nThree. Four": 4, "wrapped\nline. Next": 2, "…": 1, "a.b.c.d": 1}


@pytest.fixture(scope="module")
def model():
    return Boundaries.fit([" ".join(case) + "\n\nNext block." for case in CASES for _ in range(3)])


@pytest.mark.parametrize("fitted", [False, True])
def test_rules(model, fitted):
    split = (model if fitted else Boundaries()).split
    for case in CASES:
        gap = "" if "。" in "".join(case) else " "
        text = gap.join(case)
        assert [text[a:b] for a, b in split(text)] == case
    for text, n in JOINED.items():
        assert len(split(text)) == n, text


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aB. !?\n。“”(«»)…•-1Дж", max_size=60))
def test_units_cover_the_text_in_order(text):
    units, at = Boundaries().split(text), 0
    for a, b in units:
        assert at <= a < b and not text[at:a].strip() and text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()


def test_table(spark):
    rows = [(1, "One. Two.", "x"), (2, "", "x"), (3, None, "x"), (4, " \n\n ", "x"), (5, "a" * 200_000 + ". B", "x"), (1, "One. Two.", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start_char string")
    got = sorted(tuple(r) for r in sentences(df).collect())
    assert got == [(1, 1, 0, 4), (1, 1, 0, 4), (1, 2, 5, 9), (1, 2, 5, 9), (5, 1, 0, 200_001), (5, 2, 200_002, 200_003)]
    assert sentences(df.limit(0)).count() == 0
    assert {r["doc_id"]: r["sentences"] for r in sentence_texts(df).where("doc_id = 1").collect()} == {1: ["One.", "Two."]}


def test_block_ends_are_counted_over_all_documents(spark):
    rare = [(i, f"Yesterday Qvbr. Alden came to town {i % 7} and left.") for i in range(150)]
    parts = ["The list is long.", "Nobody read it before.", "It stays here.", "The end of it is near."]
    rest = [(i, " ".join(parts[i % 4 :] + parts[: i % 4])) for i in range(1000, 5000)]
    df = spark.createDataFrame(rare + rest, "doc_id bigint, text string").repartition(7)
    assert block_ends(df, "text") == {"qvbr": "never", "left": "usual", "long": "usual", "before": "usual", "here": "usual", "near": "usual"}
    model = fit_boundaries(df, "doc_id", "text", sample=100)
    text = "Yesterday Qvbr. Alden came to town 3 and left. He slept."
    assert [text[a:b] for a, b in model.split(text)] == ["Yesterday Qvbr. Alden came to town 3 and left.", "He slept."]
    # The sample may be any part of the table; the counts are those of all of it.
    texts = [t for _, t in rare + rest]
    assert block_ends(df, "text") == Boundaries.fit(texts, rounds=0).rates == block_ends(df.repartition(2), "text")
    assert block_ends(df.limit(0), "text") == {}


def test_words_are_judged_by_bounds():
    assert judged([("a", 59, 0), ("b", 60, 0), ("c", 60, 6), ("d", 9000, 3), ("e", 9000, 80), ("f", 9000, 400)], 100_000, 20_000) == {"b": "never", "c": "usual", "d": "never", "e": "seldom", "f": "usual"}
    # Where few stops end a block, few sightings say nothing.
    assert judged([("b", 60, 0), ("g", 2000, 0)], 100_000, 1_000) == {"g": "never"}
    assert judged([("b", 6000, 0)], 6000, 0) == {}
