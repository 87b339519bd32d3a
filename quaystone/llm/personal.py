"""Personal details in free text: found, and replaced by typed placeholders.

Details are found by the formats of numbers and addresses, by the words that
announce identity numbers and birth dates, by check digits, and by given names in all
their endings. ``replacements`` is the operator: each detail with its place and its
placeholder from ``pseudonyms``. What was found and the redacted text come from it.
"""

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm.lookalikes import placed, plain_with_places
from quaystone.llm.pseudonyms import Pseudonyms, is_card, is_iban

# Given names, Latin script.
GIVEN_LATIN = frozenset(
    """adam adrian agnes alan albert alejandro alessandro alex alexander alexandra alfred alice alicia amelie amy ana andrea andreas andrew angela anita anja anna anne anton antonia
    antonio arthur astrid barbara beatrice benjamin bernard birgit bruno camille carla carlos carmen caroline catherine cecilia charles charlotte chloe christian christina christine
    clara claudia claire daniel david diana diego dieter dominic dorothea edgar eduardo edward elena elias elisabeth elizabeth ella emil emilia emily emma eric erik ernst esther eva
    felix fernando florian francesca francis frank frederic fritz gabriel george gerald greta hanna hannah hans heinrich helen helena henri henrik henry hugo ida ines ingrid irene irina
    isabel isabella ivan jack jacob james jan jana jane javier jean jens joan joao johan johanna john jonas jorge jose joseph juan judith julia julian julie karin karl katharina
    kevin klara klaus laura lea lena leo leon linda lisa louis louise lucas lucia lucy luis lukas magdalena manuel marc marco marcus maria marie marina mario mark marta martin mary
    mateo matthias max maximilian maya michael miguel mia nadine natalia nicolas nina nora olga oliver oscar otto pablo patricia paul paula pedro peter philipp philip pierre rachel
    rafael ralf raul rebecca richard robert rosa rose ruth samuel sandra sara sarah sebastian silvia simon sofia sophia sophie stefan stephen susan susanne theo thomas tim tobias tom
    ulrich ursula valentina vera veronica victor victoria vincent walter werner william yvonne""".split()
)
# Given names, Cyrillic script, in the nominative.
GIVEN_CYRILLIC = """александр александра алексей алёна алина алиса алла анастасия анатолий андрей анна антон арина артём богдан борис вадим валентина валерий варвара василий вера виктор виктория виталий
    владимир владислав вячеслав галина геннадий георгий глеб григорий даниил дарья денис дмитрий евгений евгения екатерина елена елизавета жанна зинаида зоя иван игорь илья инна ирина
    карина кирилл константин кристина ксения лариса лев леонид лидия любовь людмила максим маргарита марина мария марк матвей михаил надежда наталья никита николай нина оксана олег ольга
    павел пётр полина раиса роман руслан светлана семён сергей станислав степан тамара татьяна тимофей ульяна фёдор юлия юрий яков ярослав тарас оксана остап богдана""".split()  # fmt: skip


def _endings(name: str) -> set[str]:
    """A Russian given name in all its cases."""
    if name == "павел":
        return {name, *("павл" + e for e in ("а", "у", "ом", "е"))}
    if name == "лев":
        return {name, *("льв" + e for e in ("а", "у", "ом", "е"))}
    if name == "пётр":
        return {name, *("петр" + e for e in ("а", "у", "ом", "е", "")), "пётр"}
    if name.endswith("ий"):
        return {name, *(name[:-1] + e for e in ("я", "ю", "ем", "и"))}
    if name.endswith("й"):
        return {name, *(name[:-1] + e for e in ("я", "ю", "ем", "е"))}
    if name.endswith("ь"):
        return {name, *(name[:-1] + e for e in ("я", "ю", "ем", "ём", "е", "и", "ью"))}
    if name.endswith("ия"):
        return {name, *(name[:-1] + e for e in ("и", "ю", "ей"))}
    if name.endswith("я"):
        return {name, *(name[:-1] + e for e in ("и", "е", "ю", "ей", "ёй"))}
    if name.endswith("а"):
        return {name, *(name[:-1] + e for e in ("ы", "и", "е", "у", "ой", "ою", "ей"))}
    return {name, *(name + e for e in ("а", "у", "ом", "е"))}


GIVEN = GIVEN_LATIN | {form for name in GIVEN_CYRILLIC for form in _endings(name)}
GIVEN = GIVEN | {name.replace("ё", "е") for name in GIVEN}

_UP, _ANY = "A-ZÀ-ÖØ-ÞА-ЯЁЄІЇ", "A-Za-zÀ-ÖØ-öø-ÿĀ-žА-яЁёЄєІіЇї"
_CAP = rf"[{_UP}][{_ANY}'’]*[{_ANY}](?:-[{_UP}][{_ANY}]+)*"

_EMAIL = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*(?: ?@ ?|\s?\[at\]\s?|\s?\(at\)\s?)[A-Za-z0-9-]+(?:(?:\.| dot |\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z0-9-]+)*(?:\.| dot |\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z]{2,}(?![\w@])"
)

# How telephone numbers are written, by country.
_PHONE_FORMS = [
    r"(?:\(\+\d{1,3}\)|\+\d{1,3}|00[1-9]\d)(?:[ .\-/]?\(?\d{1,5}\)?){2,6}",  # with the country
    r"8[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{2}[ -]?\d{2}",  # Russia
    r"(?:1[-. ])?(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}",  # North America
    r"0\d{4} \d{3} ?\d{3}|0\d{3} \d{3} \d{4}|0\d{2} \d{4} \d{4}",  # Britain
    r"\(0\d{2,4}\) ?\d{3,8}(?:-\d{1,4})?|0\d{2,4}[/-]\d{5,8}|0\d{2,4} \d{5,8}",  # Germany
    r"0[1-9](?:[ .]\d{2}){4}",  # France
    r"[679]\d{2}(?:[ -]\d{3}){2}|[679]\d{2}(?:[ -]\d{2}){3}",  # Spain
]
_PHONE = re.compile(rf"(?<![\w+(])(?<!\d[ \-./])(?:{'|'.join(_PHONE_FORMS)})(?!\w)(?![ \-./]\d)")
_DIGIT = re.compile(r"\d")
_SUM = re.compile(r"\d{4} \d{4} \d{4}$")
_MANY_DIGITS = re.compile(r"\d(?:[ ().\-/]{0,3}\d){6}")

# Words that announce an identity number.
_ID_WORDS = r"""паспорт\w{0,2}|серия|полис\w{0,2} ОМС|ОМС|ИНН|СНИЛС|ІПН|SSN|[Ss]ocial [Ss]ecurity(?: number)?|NI number|National Insurance(?: number)?|[Pp]assport|[Dd]river[’']?s licen[cs]e|ID no\.?|ID number|ID card|ID
|RVNR|Rentenversicherungsnummer|Sozialversicherungsnummer|Personalausweis(?:nummer|nr\.?)?|Ausweis(?:nummer|nr\.?)?|Reisepass(?:nummer)?|Führerschein(?:nummer)?|Steuer-ID|Steuernummer
|[Cc]arte d[’']identité|CNI|NIR|[Ss]écurité sociale|[Pp]asseport|[Pp]ermis de conduire|[Pp]asaporte|NIE|DNI|NIF|NUSS|[Pp]assaporte|CPF|RG|[Cc]artão de cidadão""".replace("\n", "")
_ID = re.compile(rf"(?<!\w)(?:{_ID_WORDS})(?:[ :#]|№|n\.º|nº|no\.|number|Nr\.|is|ist|est|es)*[ :]([A-ZÑ0-9]+(?:(?:[ .\-/]| № )[A-ZÑ0-9]+)*)(?!\w)")
_ID_TOKEN = re.compile(r"[A-ZÑ0-9]+")
_ID_BARE = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")

_TOWN = rf"{_CAP}(?: {_CAP}){{0,2}}"
_RU_KIND = r"(?:ул\.|улица|просп\.|проспект|пр-т|пр\.|наб\.|набережная|пер\.|переулок|ш\.|шоссе|бул\.|бульвар|пл\.|площадь|проезд|вул\.|вулиця)"
_RU_STREET = rf"(?:{_RU_KIND} {_CAP}(?: {_CAP})?|{_CAP}(?: {_CAP})? (?:переулок|улица|проспект|бульвар|шоссе|набережная|площадь|проезд|тупик|провулок))"
_FR_KIND = r"(?:rue|av\.|avenue|impasse|boulevard|bd|place|chemin|allée|quai|cours|route|square)"
_OF = r"(?:(?:de la|de los|de las|des|del|du|de|d['’]|de l['’]) ?)?"
# How addresses are written, by country.
_ADDRESS_FORMS = [
    rf"(?:\d{{6}}, )?(?:(?:г\. |м\. )?{_TOWN}, )?{_RU_STREET},? (?:д\. ?|дом |буд\. ?)?\d+(?:/\d+|[а-еА-Е](?!\w))?(?:, (?:корп\.|корпус|стр\.|кв\.|квартира|оф\.) ?\d+)*(?:, \d{{6}})?(?:, г\. {_TOWN})?",
    rf"(?:(?:Flat|Apt\.?|Unit|Suite) \d+[A-Za-z]?, )?\d+[A-Za-z]? (?:{_CAP} ){{1,3}}(?:Street|St\.?|Avenue|Ave\.?|Lane|Ln\.?|Court|Ct\.?|Way|Drive|Dr\.?|Row|Road|Rd\.?|Blvd\.?|Boulevard|Place|Square|Close|Terrace|Gardens|Crescent)(?!\w)(?:, (?:Apt\.?|Flat|Unit|Suite) \d+[A-Za-z]?)?(?:, {_TOWN})?(?:,? [A-Z]{{2}} \d{{5}}|,? [A-Z]{{1,2}}\d{{1,2}} \d[A-Z]{{2}})?",
    rf"(?:{_CAP} (?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ring)|{_CAP}(?<=straße|trasse)|{_CAP}(?<=gasse)|{_CAP}(?<=weg)|{_CAP}(?<=platz)|{_CAP}(?<=allee)|{_CAP}(?<=ufer)|{_CAP}(?<=damm)|{_CAP}(?<=str)\.|(?:Am|An der|Im|Auf dem|Zum|Zur) {_CAP}) \d+(?: ?[a-h](?!\w))?(?:, (?:\d{{5}} )?{_TOWN})?",
    rf"(?:\d+(?: bis| ter)?,? (?:{_FR_KIND}|Rue|Avenue|Boulevard|Impasse|Chemin|Allée|Quai) {_OF}{_CAP}(?: {_CAP})*|{_FR_KIND} {_OF}{_CAP}(?: {_CAP})*,? \d+(?: bis| ter)?(?!\w))(?:, (?:\d{{5}} )?{_TOWN})?",
    rf"(?:[Cc]alle|C/|[Aa]venida|[Aa]v\.|[Pp]laza|[Pp]aseo|[Cc]amino|[Rr]onda|[Tt]ravesía|[Rr]ua|[Pp]raça) ?{_OF}{_CAP}(?: {_CAP})*,? (?:n\.º |nº |núm\. )?\d+(?:, \d+\.?º(?: [A-Z](?!\w))?)?(?:, (?:\d{{4,5}}(?:-\d{{3}})? )?{_TOWN})?",
]
#: A cheap look before each pattern: every address of a form has one of these in it.
_ADDRESS_HINTS = [
    "ул. |улица |просп|пр-т |наб. |набережная|пер. |переулок|ш. |шоссе|бул. |бульвар|пл. |площадь|проезд |тупик|вул. |вулиця |провулок|пр. ",
    " Street| St.| St,| St | Avenue| Ave| Lane| Ln| Court| Ct| Way| Drive| Dr.,| Row| Road| Rd| Blvd| Boulevard| Place| Square| Close| Terrace| Gardens| Crescent",
    "traße |trasse |tr. |asse |eg |latz |llee |fer |amm | Ring |Am |An der |Im |Auf dem |Zum |Zur ",
    "ue |Boulevard |Impasse |Chemin |Allée |Quai |rue |av. |avenue |impasse |boulevard |bd |place |chemin |allée |quai |cours |route |square ",
    "alle |C/|venida |Av. |av. |laza |aseo |amino |onda |ravesía |rua |Rua |raça ",
]
_ADDRESSES = [(hints.split("|"), re.compile(rf"(?<!\w)(?:{form})")) for hints, form in zip(_ADDRESS_HINTS, _ADDRESS_FORMS)]
#: Every announced number has one of these before it.
_ANNOUNCED = "паспорт серия ОМС ИНН СНИЛС ІПН SSN ecurity NI\u0020 National assport icen ID RVNR ummer weis Reisepass schein Steuer identité CNI NIR sociale asseport ermis asaporte NIE DNI NIF NUSS assaporte CPF RG artão".split(" ")
_WORDS = re.compile(r"[^\W\d_]+")
_INITIAL = re.compile(rf"(?<!\w)[{_UP}]\. ?[{_UP}]")

# Titles and words of introduction before a full name, whatever given name it has.
_TITLED = re.compile(rf"(?<!\w)(?:(?:Dr|Dra|Prof|Mr|Mrs|Ms|Mme|Sr|Sra|Herr|Frau|г-н|г-жа|пан|пані)\.? )+({_CAP} {_CAP})")
_INTRODUCED = re.compile(rf"(?:[Mm]y name is|[Mm]ein Name ist|[Ii]ch heiße|[Jj]e m['’]appelle|[Mm]e llamo|[Mm]i nombre es|[Mm]eu nome é|[Мм]еня зовут|[Мм]ене звати) ({_CAP} {_CAP})")
#: A Russian or Ukrainian full name shows by its father's name.
_FATHERED = re.compile(rf"(?<!\w)({_CAP} [{_UP}][а-яёіїє]+(?:ович|евич|йович|ьич|овна|евна|ична|івна|ївна)(?:а|у|ем|ом|е|ы|и|ой|ою)? {_CAP})(?!\w)")
_NAMED = [(("r. ", "rof", "Mrs ", "Mr ", "Ms ", "Mme ", "Sr", "ra. ", "Herr ", "Frau ", "г-н", "г-ж", "пан"), _TITLED), (("name is ", "Name ist ", "ch heiße ", "appelle ", "llamo ", "nombre es ", "nome é ", "зовут ", "звати "), _INTRODUCED), (("ич", "вн", "чн"), _FATHERED)]
#: Capitalised words behind a title that are a title too.
_HIGHER = frozenset("doktor doctor professor direktor minister präsident president kollege kollegin docteur доктор профессор".split())

_CAPITAL = re.compile(rf"(?<![\w@])(?:[{_UP}]\.(?: ?[{_UP}]\.)?|{_CAP})")
_FAMILY = re.compile(rf" (?:[{_UP}]\. ?){{0,2}}({_CAP})")
_FAMILY_AFTER_INITIAL = re.compile(rf" ?({_CAP})")
_BEFORE = re.compile(rf"({_CAP}),? $")
_ANY_NAME = re.compile(rf"[{_ANY}'’]+(?:-[{_ANY}]+)*\.?")
_TITLES = frozenset("dr prof mr mrs ms herr frau mme sr sra don doña г-н г-жа др".split())
#: Accounts: bank account numbers with a country, and payment cards. Both must be valid.
_ACCOUNT = re.compile(r"(?<![\w-])(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7})(?![\w-])")
# Words that announce a date of birth.
_BORN = re.compile(
    r"(?:[Dd]ate of birth|[Bb]orn(?: on)?|DOB|[Bb]irthday|[Gg]eboren(?: am)?|[Gg]eb\.|[Nn]ée?(?: le)?|[Dd]ate de naissance|[Nn]acid[oa](?: el)?|[Ff]echa de nacimiento|[Dd]ata de nascimento|[Дд]ата рождения|[Рр]одил(?:ся|ась)|[Дд]ата народження|生年月日)[ :：]{1,2}"
    r"(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}([./-])\d{1,2}\2\d{4})(?!\w)"
)
#: Types that have a name of their own besides those of the reported details.
REPORTED = ("email", "phone", "id_number", "address", "name")

Found = tuple[int, int, str]


def _names(text: str, taken: list[Found]) -> Iterator[Found]:
    free = 0
    for m in _CAPITAL.finditer(text):
        if m.start() < free:
            continue
        word = m[0]
        if word.endswith("."):
            # Initials: no name if a number stands before or the family name is one that only begins a sentence.
            ahead = text[max(0, m.start() - 2) : m.start()]
            if ahead[-2:-1].isdigit() or ahead[-2:-1] in "º№" and ahead:
                continue
            f = _FAMILY_AFTER_INITIAL.match(text, m.end())
            if not f or len(f[1]) < 4:
                continue
            span = (m.start(), f.end())
        elif word.lower() in GIVEN:
            f = _FAMILY.match(text, m.end())
            if f:
                span = (m.start(), f.end())
            else:
                b = _BEFORE.search(text, max(free, m.start() - 40), m.start())
                if not b or b[1].lower().strip(".") in _TITLES or b.start() == 0 or text[b.start() - 2 : b.start()].strip()[-1:] in ".!?:\n":
                    continue
                span = (b.start(), m.end())
        else:
            continue
        if any(lo < span[1] and span[0] < hi for lo, hi, _ in taken):
            continue
        free = span[1]
        yield (*span, "name")


def _id_end(value: str) -> int:
    """Where an identity number ends: before a word in capitals, which has no digit and is no single letter behind a number or a short mark before it."""
    end, digits = 0, 0
    tokens = list(_ID_TOKEN.finditer(value))
    for i, m in enumerate(tokens):
        here = sum(c.isdigit() for c in m[0])
        ahead = any(c.isdigit() for t in tokens[i + 1 : i + 2] for c in t[0])
        if not here and (len(m[0]) > 3 or (digits and len(m[0]) > 1 and not ahead)):
            break
        digits += here
        end = m.end()
    return end


def _add(found: list[Found], lo: int, hi: int, kind: str) -> None:
    if all(hi <= a or b <= lo for a, b, _ in found):
        found.append((lo, hi, kind))


def find_in_text(text: str) -> list[Found]:
    """(start, end, type) of the personal details of a free text, in order, without overlap, in code points of ``text``."""
    plain, places = plain_with_places(text)
    found: list[Found] = []
    if "@" in plain or "at]" in plain or "at)" in plain:
        for m in _EMAIL.finditer(plain):
            _add(found, m.start(), m.end(), "email")
    for m in _ID.finditer(plain) if any(x in plain for x in _ANNOUNCED) else ():
        end = _id_end(m[1])
        if sum(c.isdigit() for c in m[1][:end]) >= 5:
            _add(found, m.start(1), m.start(1) + end, "id_number")
    if _MANY_DIGITS.search(plain):
        for m in _ID_BARE.finditer(plain):
            _add(found, m.start(), m.end(), "id_number")
        for m in _PHONE.finditer(plain):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15 and not _SUM.match(m[0]):
                _add(found, m.start(), m.end(), "phone")
        for m in _ACCOUNT.finditer(plain):
            symbols = re.sub("[ -]", "", m[0])
            if is_iban(symbols) or is_card(symbols):
                _add(found, m.start(), m.end(), "account")
        for m in _BORN.finditer(plain):
            _add(found, m.start(1), m.end(1), "birth_date")
    for hints, form in _ADDRESSES if _DIGIT.search(plain) else ():
        for m in form.finditer(plain) if any(x in plain for x in hints) else ():
            hi = m.end() - (m[0].endswith(".") and not m[0].endswith(("St.", "Rd.", "Ave.", "Dr.")))
            _add(found, m.start(), hi, "address")
    for hints, form in _NAMED:
        for m in form.finditer(plain) if any(x in plain for x in hints) else ():
            if m[1].partition(" ")[0].lower() not in _HIGHER:
                _add(found, m.start(1), m.end(1), "name")
    if not GIVEN.isdisjoint(_WORDS.findall(plain.lower())) or _INITIAL.search(plain):
        found += list(_names(plain, found))
    found.sort()
    return _placed(found, text, places)


def find_in_author(text: str) -> list[Found]:
    """The same for an author field: mailboxes and numbers, and a name in any order and case, without titles and decoration."""
    plain, places = plain_with_places(text)
    found: list[Found] = [(m.start(), m.end(), "email") for m in _EMAIL.finditer(plain)] if "@" in plain else []
    if _MANY_DIGITS.search(plain):
        for m in _PHONE.finditer(plain):
            _add(found, m.start(), m.end(), "phone")
    # What was found parts the field as a bar does.
    bare = plain
    for lo, hi, _ in found:
        bare = bare[:lo] + "|" * (hi - lo) + bare[hi:]
    at = 0
    for part in _DECORATION.split(bare):
        name = _name_in_part(part)
        if name:
            _add(found, at + name[0], at + name[1], "name")
            break
        at += len(part) + 1
    found.sort()
    return _placed(found, text, places)


_DECORATION = re.compile(r"[|(\[{/•·<>]")


def _name_in_part(part: str) -> tuple[int, int] | None:
    words = [(m.start(), m.end(), m[0]) for m in _ANY_NAME.finditer(part)]
    words = [w for w in words if w[2].lower().strip(".") not in _TITLES]
    if not 2 <= len(words) <= 4:
        return None
    single = [len(w[2].strip(".")) == 1 for w in words]
    known = [w[2].lower() in GIVEN for w in words]
    full = [not s and len(w[2]) > 2 and not w[2].endswith(".") for s, w in zip(single, words)]
    if sum(full) == 2 - (not any(known)) and (any(known) or any(single)) and all(s or f for s, f in zip(single, full)):
        between = [part[a[1] : b[0]] for a, b in zip(words, words[1:])]
        if all(x.strip() in ("", ",") for x in between):
            return words[0][0], words[-1][1]
    return None


def _placed(found: list[Found], text: str, places: list[int] | None) -> list[Found]:
    return found if places is None else [(*placed(lo, hi, text, places), kind) for lo, hi, kind in found]


def placeholder(value: str, kind: str, names: Pseudonyms) -> str:
    return names.placeholder(plain_with_places(value)[0], kind)


def redact(text: str, found: list[Found], names: Pseudonyms) -> str:
    """``text`` with each detail replaced by its placeholder and every other character untouched."""
    out, at = [], 0
    for lo, hi, kind in found:
        out += [text[at:lo], placeholder(text[lo:hi], kind, names)]
        at = hi
    return "".join([*out, text[at:]])


_REPLACEMENTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("field", T.StringType()),
            T.StructField("start_char", T.IntegerType()),
            T.StructField("end_char", T.IntegerType()),
            T.StructField("pii_type", T.StringType()),
            T.StructField("pii_value", T.StringType()),
            T.StructField("placeholder", T.StringType()),
        ]
    )
)


def _replacer(key: bytes) -> Callable:
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = Pseudonyms(key)
        for texts, authors in batches:
            out = []
            for text, author in zip(texts, authors):
                rows = []
                for field, value, find in (("text", text, find_in_text), ("author_name", author, find_in_author)):
                    rows += [{"field": field, "start_char": a, "end_char": b, "pii_type": k, "pii_value": value[a:b], "placeholder": placeholder(value[a:b], k, names)} for a, b, k in find(value)] if value else []
                out.append(rows or None)
            yield pd.Series(out, dtype=object)

    return run


def _key(secret: str) -> bytes:
    return hashlib.sha256(secret.encode()).digest()


def with_replacements(posts: DataFrame, secret: str, text: str = "text", author: str = "author_name", out: str = "replacements") -> DataFrame:
    """Add ``out``: each personal detail of the two fields in order, with its place, type, value and keyed placeholder; null for none.

    Nothing is shuffled and ``secret`` is not stored. Null and empty fields hold nothing.
    """
    # Said to be nondeterministic, it is evaluated once a row and not again for each use of its result.
    find = F.pandas_udf(_replacer(_key(secret)), _REPLACEMENTS, F.PandasUDFType.SCALAR_ITER).asNondeterministic()
    return posts.withColumn(out, find(F.col(text), F.col(author)))


def details(posts: DataFrame, secret: str = "example", key: str = "row_id", text: str = "text", author: str = "author_name", types: tuple[str, ...] = REPORTED) -> DataFrame:
    """``(key, field, pii_type, pii_value)`` of ``with_replacements``: each detail as it stands, once for each row, field, type and value.

    A value that stands twice in a field comes out once; repeated rows come out repeatedly.
    """
    rows = posts.where(F.col(text).isNotNull() | F.col(author).isNotNull()).select(F.col(key), F.col(text).alias("__text"), F.col(author).alias("__author"))
    rows = with_replacements(rows, secret, "__text", "__author", "__r").select(key, "__r")
    wanted = F.filter(F.transform("__r", lambda r: F.struct(r["field"].alias("field"), r["pii_type"].alias("pii_type"), r["pii_value"].alias("pii_value"))), lambda r: r["pii_type"].isin(*types))
    return rows.select(key, F.explode(F.array_distinct(wanted)).alias("__d")).select(key, "__d.*")


def _spliced(text: Column, field: str, replacements: Column) -> Column:
    """The text with the replacements of one field put in, in place."""
    mine = F.filter(replacements, lambda r: r["field"] == field)
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda a, r: F.struct(F.concat(a["done"], F.substring(text, a["at"] + 1, r["start_char"] - a["at"]), r["placeholder"]).alias("done"), r["end_char"].alias("at"))
    whole = F.aggregate(mine, start, step, lambda a: F.concat(a["done"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(mine) > 0, whole).otherwise(text)


def redacted(posts: DataFrame, secret: str, text: str = "text", author: str = "author_name") -> DataFrame:
    """``posts`` with typed placeholders for all details in the two fields; ``secret`` keys the pseudonyms and is not stored."""
    rows = with_replacements(posts, secret, text, author, "__r").withColumn("__r", F.coalesce("__r", F.array().cast(_REPLACEMENTS)))
    return rows.withColumn(text, _spliced(F.col(text), "text", F.col("__r"))).withColumn(author, _spliced(F.col(author), "author_name", F.col("__r"))).drop("__r")


def details_by_type(posts: DataFrame, secret: str = "example") -> DataFrame:
    """``(field, pii_type, details, rows)``: how many details and rows with any, by field and type."""
    by_row = details(posts, secret, types=(*REPORTED, "account", "birth_date")).groupBy("field", "pii_type", "row_id").agg(F.count(F.lit(1)).alias("n"))
    return by_row.groupBy("field", "pii_type").agg(F.sum("n").alias("details"), F.count(F.lit(1)).alias("rows"))
