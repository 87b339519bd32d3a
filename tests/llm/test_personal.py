"""Personal details: forms that must be found, look-alikes that must not, and placeholders."""

from __future__ import annotations

import datetime as dt
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quaystone.llm.personal import details, details_by_type, find_in_author, find_in_text, redact, redacted
from quaystone.llm.pseudonyms import CHECKED, Pseudonyms, is_card, is_iban, scheme_of, telephone
from tests.conftest import post_rows, rows_of

FOUND = [
    ("Write to a.b+x@mail.example.org if", "email", "a.b+x@mail.example.org"), ("an irina.z @ post.example, danke", "email", "irina.z @ post.example"),
    ("o-k[at]team.tide.example now", "email", "o-k[at]team.tide.example"), ("c_l (at) box-mail dot test.", "email", "c_l (at) box-mail dot test"),
    ("Звоните: +7 000 555‑48‑32.", "phone", "+7 000 555‑48‑32"), ("телефон 8(000)555-71-50.", "phone", "8(000)555-71-50"), ("Call (202) 555-0155 now", "phone", "(202) 555-0155"),
    ("an: 0049 30 23125122.", "phone", "0049 30 23125122"), ("ou 01.99.00.31.14.", "phone", "01.99.00.31.14"), ("al (+34) 600000175.", "phone", "(+34) 600000175"), ("oder 030/23125107.", "phone", "030/23125107"),
    ("мой паспорт 00 13 370130.", "id_number", "00 13 370130"), ("серия 0053 № 341341.", "id_number", "0053 № 341341"), ("NI number QQ 00 86 00 Z. Next", "id_number", "QQ 00 86 00 Z"),
    ("SSN 000-54-3985.", "id_number", "000-54-3985"), ("meine ist Ausweis L0X87T2367.", "id_number", "L0X87T2367"), ("DNI 00.388.388-Ñ.", "id_number", "00.388.388-Ñ"), ("NIR 0 21 13 99 634 634 21.", "id_number", "0 21 13 99 634 634 21"),
    ("по адресу Еловск, ул. Янтарная Малая 29, вход", "address", "Еловск, ул. Янтарная Малая 29"), ("здесь: г. Еловск, проспект Сверчков, дом 8; тел", "address", "г. Еловск, проспект Сверчков, дом 8"),
    ("at Flat 32, 71 Quarrel Street, Brackenmouth, second", "address", "Flat 32, 71 Quarrel Street, Brackenmouth"), ("in der Rabenstr. 48 b, zweiter", "address", "Rabenstr. 48 b"),
    ("au 75 bis, impasse du Grillon Muet, deuxième", "address", "75 bis, impasse du Grillon Muet"), ("en calle del Grillo Azul, 94, 3.º B, segunda", "address", "calle del Grillo Azul, 94, 3.º B"),
    ("у Нины Снегоряевой.", "name", "Нины Снегоряевой"), ("Thanks to Sofia Ash-Ney for", "name", "Sofia Ash-Ney"), ("Die Leitung hat Jonas A. Ilvenson, fragt", "name", "Jonas A. Ilvenson"), ("— М. Тормазова, спросите", "name", "М. Тормазова"),
]
CLEAN = [
    "Ping @marlstone_dev in the comments.", "Заказ 9200-5625-15 ушёл", "Checksum 9288 1604 5077 matches", "Score 324 to 9041468087", "The ISBN, 978-0-10000-499-0, has a typo", "Release 1.4.1 (2024-03-11) hashes to 3002 6030 5008.",
    "Order 4763/9225/66 shipped", "Roll Fernwire back to 16.7.6. Next one", "Olga wrote this", "see S. 636, dort", "", "\n", "x" * 50_000, "Plan 3.º B. Una nota", "(KX-131412) №133477 [rev 21e2ac]",
]


def test_forms():
    for text, kind, value in FOUND:
        assert [(k, text[a:b]) for a, b, k in find_in_text(text)] == [(kind, value)], text
    for text in CLEAN:
        assert find_in_text(text) == [], text


def test_disguised_details_are_taken_as_they_stand():
    text = "Write to оscar@mail​.example о​к, call +７ 000 555-48-32!"
    assert [(k, text[a:b]) for a, b, k in find_in_text(text)] == [("email", "оscar@mail​.example"), ("phone", "+７ 000 555-48-32")]


def test_announced_numbers_end_before_words():
    for text, value in {"ИНН 000011981198 UPD: x": "000011981198", "passport ZZ 0005492 NEXT": "ZZ 0005492", "RVNR 00 970190 Z 859.": "00 970190 Z 859", "ID " + "A" * 50_000 + "a": None, "SSN 000-54-3985 I": "000-54-3985 I"}.items():
        assert [text[a:b] for a, b, k in find_in_text(text)] == ([value] if value else []), text[:60]


def test_authors():
    for author, name in {
        "Dr. Rafael Zorvane": "Rafael Zorvane", "WINTERSOL Rafael": "WINTERSOL Rafael", "marta drovantes (moderator)": "marta drovantes", "Müllenfeld, Daniel 🚀": "Müllenfeld, Daniel", "Н. Орешкевина | KiteUI": "Н. Орешкевина", " Вера Ильмерина ": "Вера Ильмерина",
        "Anna Schmidt <a.b@mail.example>": "Anna Schmidt", "Team | Anna Schmidt": "Anna Schmidt",
        "Editorial Desk": None, "marlstone_73": None, "swiftyard_bot": None, "Die Redaktion": None, "L'équipe": None, "Oscar": None, "deleted account": None, "🤖 linter": None, "": None,
    }.items():
        assert [author[a:b] for a, b, k in find_in_author(author) if k == "name"] == ([name] if name else []), author


def test_details_table(spark):
    rows = [{"row_id": i, "text": t, "author_name": "E. Castrevo" if i % 2 else None} for i, (t, _, _) in enumerate(FOUND)] + [{"row_id": 900, "text": None, "author_name": None}, {"row_id": 901, "text": "SSN 000-54-3985 and SSN 000-54-3985"}]
    df = post_rows(spark, rows, clash=True)
    want = {(i, "text", k, v) for i, (_, k, v) in enumerate(FOUND)} | {(i, "author_name", "name", "E. Castrevo") for i in range(len(FOUND)) if i % 2} | {(901, "text", "id_number", "000-54-3985")}
    assert {tuple(r) for r in details(df).collect()} == want and details(df).count() == len(want)
    assert details(df.limit(0)).count() == 0
    assert sum(r["details"] for r in details_by_type(df).collect()) == len(want)
    safe = {r["row_id"]: r for r in redacted(df, "secret").collect()}
    assert safe[901]["text"].count("[ID_NUMBER:") == 2 and len(set(re.findall(r"\[ID_NUMBER:([^\]]+)\]", safe[901]["text"]))) == 1
    assert safe[900]["text"] is None and all(v not in safe[i]["text"] for i, (_, _, v) in enumerate(FOUND))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0123456789-ABZ ()+", min_size=1, max_size=18), st.binary(min_size=1, max_size=8))
def test_numbers_keep_their_format(value, key):
    out = Pseudonyms(key).number(value, "phone")
    if sum(c.isdigit() or c.isupper() for c in value) >= 2:
        shape = lambda v: re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", v))
        assert shape(out) == shape(value)
    assert out == Pseudonyms(key).number(value, "phone")


def test_numbers_are_permuted_one_to_one():
    names = Pseudonyms(b"k")
    assert len({names.number(f"{i:03d}-A", "id_number") for i in range(1000)}) == 1000


def test_rest_of_the_text_is_untouched():
    text = "Спасибо, доклад был у Нины Снегоряевой.\nSSN 000-54-3985!"
    out = redact(text, find_in_text(text), Pseudonyms(b"k"))
    assert re.fullmatch(r"Спасибо, доклад был у \[NAME:\w+\]\.\nSSN \[ID_NUMBER:\d{3}-\d{2}-\d{4}\]!", out)


def test_tags_are_too_long_to_meet():
    names = Pseudonyms(b"example")
    assert len(names.tag("Anna Schmidt")) == 32 and names.tag("Anna  Schmidt") == names.tag("anna schmidt") != names.tag("Anna Schmitt")


def test_check_digits_survive():
    names = Pseudonyms(b"k")
    made = 0
    for form, check in CHECKED:
        for seed in range(60):
            payload = names._symbols("X1234567" if form[0] == "A" else "1" * len(form), b"%d" % seed)
            payload = "XYZ"[seed % 3] + payload[1:] if form[0] == "A" else payload
            value = payload + check(payload)
            out = names.number(value, "id_number")
            assert scheme_of(value) is not None and scheme_of(out) == scheme_of(value)
            made += out != value
    assert made > 0.9 * 60 * len(CHECKED)
    for wrong in ("529982247262", "000-54-3985", "QQ 00 86 00 Z"):
        symbols = re.sub("[^0-9A-Z]", "", names.number(wrong, "id_number"))
        assert scheme_of(symbols) == scheme_of(re.sub("[^0-9A-Z]", "", wrong))
    small = {names.checked(f"{i:04d}", "id_number") for i in range(10_000)}
    assert len(small) == 10_000


def test_accounts_and_birth_dates():
    text = "Card 4539 1488 0343 6467 or DE89 3704 0044 0532 0130 00; born 1985-03-12, дата рождения: 05.11.1990. Card 4539 1488 0343 6468."
    found = [(k, text[a:b]) for a, b, k in find_in_text(text)]
    assert [f for f in found if f[0] in ("account", "birth_date")] == [("account", "4539 1488 0343 6467"), ("account", "DE89 3704 0044 0532 0130 00"), ("birth_date", "1985-03-12"), ("birth_date", "05.11.1990")]
    names = Pseudonyms(b"k")
    card, iban = names.number("4539 1488 0343 6467", "account"), names.number("DE89 3704 0044 0532 0130 00", "account")
    assert is_card(card.replace(" ", "")) and is_iban(iban.replace(" ", "")) and iban.startswith("DE") and card != "4539 1488 0343 6467"
    same = {names.birth_date(v) for v in ("1985-03-12", "12.03.1985")}
    assert len({dt.date.fromisoformat(v) if v[4] == "-" else dt.datetime.strptime(v, "%d.%m.%Y").date() for v in same}) == 1
    days = [dt.date(1900, 1, 1) + dt.timedelta(days=i) for i in range(0, 73049, 7)]
    assert len({names.day(d) for d in days}) == len(days) and names.day(dt.date(1800, 1, 1)) == dt.date(1800, 1, 1)


def test_ways_to_write_a_number_get_one_placeholder():
    names = Pseudonyms(b"k")
    for ways in (
        ("+7 999 123-45-67", "8 (999) 123-45-67", "0079991234567"),
        ("+49 30 23125122", "030/23125122", "0049 30 23125122", "+49 (0)30 23125122"),
        ("+33 1 99 00 31 14", "01.99.00.31.14"),
        ("(202) 555-0155", "+1 202 555 0155", "1-202-555-0155"),
        ("+34 600000175", "600 000 175"),
        ("+44 1632 960 123", "01632 960123"),
    ):
        assert len({names.placeholder(w, "phone") for w in ways}) == 1, ways
        code, national = telephone(ways[0])
        assert re.fullmatch(rf"\[PHONE:\+{code}{national[0]}\d{{{len(national) - 1}}}\]", names.placeholder(ways[0], "phone"))
    assert names.placeholder("+7 999 123-45-67", "phone") != names.placeholder("+7 999 123-45-68", "phone")


def test_redaction_comes_from_the_replacements(spark):
    texts = ["Thanks to Sofia Ash-Ney for +7 000 555‑48‑32!", "𝒳 😀 SSN 000-54-3985 а̀ конец", "", None, "nothing"]
    df = post_rows(spark, [{"row_id": i, "text": t, "author_name": t} for i, t in enumerate(texts)], clash=True)
    names = Pseudonyms(__import__("hashlib").sha256(b"s").digest())
    got = {r["row_id"]: (r["text"], r["author_name"]) for r in redacted(df, "s").collect()}
    for i, t in enumerate(texts):
        want = None if t is None else redact(t, find_in_text(t), names)
        assert got[i][0] == want and (got[i][1] is None) == (t is None)


def test_names_that_no_list_has():
    for text, name in {
        "Ask Dr. Priya Sharma about it": "Priya Sharma", "Thanks to Prof. Dr. Zbigniew Kowalski.": "Zbigniew Kowalski", "My name is Chen Wei, hello": "Chen Wei", "Меня зовут Гульнара Ахметова": "Гульнара Ахметова",
        "Спасибо, Рустам Тимурович Ахметов ответил": "Рустам Тимурович Ахметов", "von Frau Ayşe Yılmaz": "Ayşe Yılmaz", "Herr Doktor Müller sagt": None, "au 12 Rue de la Paix, 75002 Paris": None, "Visual Studio is out": None,
    }.items():
        assert [text[a:b] for a, b, k in find_in_text(text) if k == "name"] == ([name] if name else []), text
    assert [(k, "12 Rue de la Paix, 75002 Paris") for _, _, k in find_in_text("au 12 Rue de la Paix, 75002 Paris")] == [("address", "12 Rue de la Paix, 75002 Paris")]
