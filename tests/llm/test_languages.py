"""Languages of texts and segments: held-out sentences, mixtures, wrong labels."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quaystone.llm.languages import LANGUAGES, UNKNOWN, Detector, fit_detector, mislabelled, mixture, segment_languages, segments_of, train
from tests.conftest import post_rows

PARTS = {
    "en": ("the old {} has many replies|we finally removed the {} from the app|nobody remembers who wrote the {}|is it normal that the {} takes so long", "cache reader layer screen index"),
    "ru": ("никто не помнит, кто написал {}|мы наконец выкинули {} из приложения|это нормально, что {} открывается долго|в старой ветке про {} много ответов", "кэш слой экран индекс модуль"),
    "uk": ("ніхто не пам'ятає, хто написав {}|ми нарешті викинули {} із застосунку|це нормально, що {} відкривається довго|у старій гілці про {} багато відповідей", "кеш шар екран індекс модуль"),
    "de": ("niemand weiß noch, wer {} geschrieben hat|ist es normal, dass {} so lange braucht|wir haben {} endlich entfernt|im alten Faden über {} stehen viele Antworten", "den Speicher|die Anzeige|den Leser|die Schicht"),
    "fr": ("personne ne sait qui a écrit {}|est-il normal que {} prenne autant de temps|nous avons enfin retiré {} du projet|la vieille discussion sur {} a beaucoup de réponses", "le cache|la couche|le lecteur|la barre"),
    "es": ("nadie recuerda quién escribió {}|es normal que {} tarde tanto|por fin hemos quitado {} de la aplicación|el hilo antiguo sobre {} tiene muchas respuestas", "la caché|la capa|el lector|la barra"),
    "pt": ("ninguém lembra quem escreveu {}|é normal que {} demore tanto|finalmente tiramos {} do aplicativo|a conversa antiga sobre {} tem muitas respostas", "o cache|a camada|o leitor|a barra"),
    "ja": ("{}がやっと直りました|{}を誰が書いたか覚えていません|{}を測った人はいますか|{}について返事がたくさんあります", "画面 検索 同期 通知"),
}


def sentence(lang: str, draw: random.Random) -> str:
    shapes, things = PARTS[lang]
    thing = draw.choice(things.split("|") if "|" in things else things.split(" "))
    text = draw.choice(shapes.split("|")).format(thing)
    return text[0].upper() + text[1:] + ("。" if lang == "ja" else draw.choice(".!"))


@pytest.fixture(scope="module")
def detector():
    draw = random.Random(1)
    rows = []
    for _ in range(1600):
        lang = draw.choice(LANGUAGES)
        label = lang if draw.random() > 0.1 else draw.choice(LANGUAGES)  # one label in ten is any
        rows.append((" ".join(sentence(lang, draw) for _ in range(draw.randint(1, 3))), label))
    return Detector(train(rows))


def test_held_out_accuracy(detector):
    draw = random.Random(2)
    right = 0
    for _ in range(400):
        langs = sorted(draw.sample(LANGUAGES, draw.choice((1, 1, 2))))
        text = " ".join(sentence(lang, draw) for lang in langs for _ in range(2)) + draw.choice(("", " #tag @someone_dev", " (KX-131412)", " https://x.example/a/b", " 16.7.6"))
        right += detector.sets([text])[0] == langs
    assert right >= 392


def test_sets_agree_with_segments(detector):
    draw = random.Random(3)
    texts = [" ".join(sentence(draw.choice(LANGUAGES), draw) for _ in range(draw.randint(0, 4))) for _ in range(200)] + ["", None, "123 !", "#tag @a_b", "x" * 40_000]
    assert detector.sets(texts) == [sorted({s[2] for s in found} - {UNKNOWN}) for found in detector.detect_all(texts)]
    assert detector.sets(["", None, "2:0", "#tag @a_b 5.2"]) == [[], [], [], []]
    for a, b, _, sure in detector.detect("Nobody remembers who wrote the cache. Никто не помнит, кто написал кэш!"):
        assert 0 <= a < b and 0.9 < sure <= 1


def test_mixture_chooses_by_penalty():
    scores = np.array([[0.0, -30.0, -40.0, -50.0], [-30.0, 0.0, -40.0, -50.0], [0.0, -3.0, -40.0, -50.0]])
    assert mixture(scores, np.ones(3), 10.0)[0] == [0, 1] and mixture(scores, np.ones(3), 100.0)[0] == [0]


def test_other_languages_are_not_forced_into_ours(detector):
    foreign = ["这是一个测试文章我们今天讨论新的编译器和缓存问题。", "هذا نص تجريبي باللغة العربية عن التخزين المؤقت.", "यह एक परीक्षण पाठ है जो हिंदी में लिखा गया है।", "이것은 컴파일러 캐시에 관한 테스트 문장입니다.", "Bu bir deneme metnidir ve derleyici önbelleği hakkındadır."]
    for text in foreign:
        assert detector.sets([text]) == [[]] and {s[2] for s in detector.detect(text)} == {UNKNOWN}
    both = "Nobody remembers who wrote the cache. " + foreign[1]
    assert [s[2] for s in detector.detect(both)] == ["en", UNKNOWN] and detector.sets([both]) == [["en"]]


def test_segments_are_parts_of_the_stored_text(detector):
    text = "No\u200bbody remembers who wrote the ca\u200bche. Никто не помнит, кто написал кэш! Niemand weiß noch, wer die Anzeige geschrieben hat."
    assert [(text[a:b].strip(), lang) for a, b, lang, _ in detector.detect(text)] == [("No\u200bbody remembers who wrote the ca\u200bche.", "en"), ("Никто не помнит, кто написал кэш!", "ru"), ("Niemand weiß noch, wer die Anzeige geschrieben hat.", "de")]


def test_segments_keep_places():
    text = "Build 16.7.6 is out. Mehr dazu\nКэш a@b.example!"
    assert [text[a:b].strip() for a, b, _ in segments_of(text)] == ["Build 16.7.6 is out.", "Mehr dazu", "Кэш a@b.example!"]


def test_mislabelled(spark, detector):
    draw = random.Random(4)
    labels = ["en", "English", "en-US", "EN", "", None, "und", "n/a", "de", "Русский", "xx"]
    rows = [{"row_id": i, "text": sentence("en", draw), "lang": label} for i, label in enumerate(labels)]
    rows += [{"row_id": 50, "text": sentence("en", draw) + " " + sentence("ru", draw), "lang": "en"}, {"row_id": 51, "text": None, "lang": None}, {"row_id": 52, "text": "12:0", "lang": None}, {"row_id": 53, "text": sentence("ja", draw), "lang": "日本語"}]
    df = post_rows(spark, rows, clash=True)
    want = [(i, "en") for i in range(4, 11)] + [(50, "en"), (50, "ru")]
    assert sorted(tuple(r) for r in mislabelled(df, detector=detector).collect()) == want
    assert mislabelled(df.limit(0), detector=detector).count() == 0
    assert {r["lang"] for r in segment_languages(df, detector=detector).where("row_id = 50").collect()} == {"en", "ru"}
    assert fit_detector(df).model.languages == LANGUAGES  # fits on whatever there is
    assert mislabelled(df.limit(0)).count() == 0
