"""Keyed placeholders that keep equal values linked.

Numbers and dates are permuted within their format by a keyed Feistel network. A number
is validated first: what carries check digits gets new ones, so a valid number stays
valid and an invalid one invalid; a telephone number is brought to country and national
number, so that all ways to write it get one placeholder. Names, addresses and mailboxes,
which have no such format, get a keyed tag of 128 bits. Without the key nothing leads back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from datetime import date, timedelta

ROUNDS = 8
#: Values whose placeholders a worker keeps.
KEPT = 1 << 16


def _weighted(digits: str, weights: list[int]) -> int:
    return sum(int(d) * w for d, w in zip(digits, weights))


def _luhn(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _inn12(payload: str) -> str:
    one = str(_weighted(payload, [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]) % 11 % 10)
    return one + str(_weighted(payload + one, [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]) % 11 % 10)


def _cpf(payload: str) -> str:
    one = str(_weighted(payload, list(range(10, 1, -1))) * 10 % 11 % 10)
    return one + str(_weighted(payload + one, list(range(11, 1, -1))) * 10 % 11 % 10)


def _iso_11_10(payload: str) -> str:
    product = 10
    for c in payload:
        total = (int(c) + product) % 10 or 10
        product = total * 2 % 11
    return str((11 - product) % 10)


_SPANISH = "TRWAGMYFPDXBNJZSQVHLCKE"

#: Numbers with check characters: form of the payload, and what must follow it. Of those with one form the first that holds counts.
CHECKED: list[tuple[str, Callable[[str], str]]] = [
    ("9" * 9, lambda p: str(_weighted(p, [2, 4, 10, 3, 5, 9, 4, 6, 8]) % 11 % 10)),  # tax number, Russia, organisations
    ("9" * 10, _inn12),  # the same, persons
    ("9" * 9, lambda p: f"{_weighted(p, list(range(9, 0, -1))) % 101 % 100:02d}"),  # insurance number, Russia
    ("9" * 9, _cpf),  # tax number, Brazil
    ("9" * 10, _iso_11_10),  # tax number, Germany
    ("9" * 8, lambda p: str((-_weighted(p, list(range(9, 1, -1))) % 11) % 10)),  # tax number, Portugal
    ("9" * 13, lambda p: f"{97 - int(p) % 97:02d}"),  # social security, France
    ("9" * 8, lambda p: _SPANISH[int(p) % 23]),  # identity number, Spain
    ("A" + "9" * 7, lambda p: _SPANISH[int(str("XYZ".find(p[0])) + p[1:]) % 23] if p[0] in "XYZ" else ""),  # the same, foreigners
    *[("9" * n, _luhn) for n in range(12, 19)],  # payment cards
]


def _form(symbols: str) -> str:
    return "".join("9" if c.isdigit() else "A" for c in symbols)


def scheme_of(symbols: str) -> int | None:
    """Which of CHECKED a number of digits and capitals is valid by, if any."""
    for i, (form, check) in enumerate(CHECKED):
        n = len(form)
        if n < len(symbols) <= n + 2 and _form(symbols[:n]) == form and check(symbols[:n]) == symbols[n:]:
            return i
    return None


def iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def is_iban(symbols: str) -> bool:
    return bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", symbols)) and iban_check(symbols[:2], symbols[4:]) == symbols[2:4]


def is_card(symbols: str) -> bool:
    return symbols.isdigit() and 13 <= len(symbols) <= 19 and _luhn(symbols[:-1]) == symbols[-1]


# Country codes of one and two digits in the international numbering plan; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Digits of national numbers, by country code; elsewhere 5 to 12.
_NATIONAL = {"1": (10, 10), "7": (10, 10), "33": (9, 9), "34": (9, 9), "44": (9, 10), "49": (6, 11), "351": (9, 9), "380": (9, 9), "81": (9, 10), "55": (10, 11)}


def _country(digits: str) -> str:
    return digits[:1] if digits[:1] in _CODES else digits[:2] if digits[:2] in _CODES else digits[:3]


def telephone(value: str) -> tuple[str, str] | None:
    """(country code, national number) of a telephone number however written; None if it is none that fits a country."""
    digits = re.sub(r"\D", "", value)
    if "+" in value or digits.startswith("00"):
        digits = digits.removeprefix("00")
        code = _country(digits)
        national = digits[len(code) :]
        if re.search(r"\(0\)", value):
            national = national.removeprefix("0")
    elif len(digits) == 11 and digits[0] == "8":
        code, national = "7", digits[1:]
    elif len(digits) in (10, 11) and re.fullmatch(r"(?:1[-. ])?(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}", value):
        code, national = "1", digits[-10:]
    elif re.fullmatch(r"0[1-9](?:[ .]\d{2}){4}", value):
        code, national = "33", digits[1:]
    elif re.fullmatch(r"0\d{4} \d{3} ?\d{3}|0\d{3} \d{3} \d{4}|0\d{2} \d{4} \d{4}", value):
        code, national = "44", digits[1:]
    elif digits.startswith("0"):
        code, national = "49", digits[1:]
    elif len(digits) == 9 and digits[0] in "679":
        code, national = "34", digits
    else:
        return None
    least, most = _NATIONAL.get(code, (5, 12))
    return (code, national) if least <= len(national) <= most else None


_EPOCH, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


class Pseudonyms:
    """Placeholders under one key; equal values of a type get equal ones."""

    def __init__(self, key: bytes):
        self._key = key[:64]
        self._kept: dict[tuple[str, str], str] = {}

    def permute(self, value: int, size: int, tweak: bytes) -> int:
        """A keyed bijection of 0 .. size - 1: a Feistel network over two halves of nearly equal size, walked until the result is in range."""
        if size < 2:
            return value
        a = max(2, int(size**0.5))
        while a * a < size:
            a += 1
        b = -(-size // a)
        while True:
            left, right = value % a, value // a
            for i in range(ROUNDS):
                if i % 2:
                    right = (right + self._word(tweak, i, left)) % b
                else:
                    left = (left + self._word(tweak, i, right)) % a
            value = right * a + left
            if value < size:
                return value

    def _word(self, tweak: bytes, i: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%b:%d:%d" % (tweak, i, half), key=self._key, digest_size=16).digest(), "big")

    def _symbols(self, symbols: str, tweak: bytes) -> str:
        """Digits for digits and capitals for capitals."""
        value, size = 0, 1
        for c in symbols:
            base = 10 if c.isdigit() else 26
            value = value * base + (int(c) if base == 10 else ord(c) - 65)
            size *= base
        value = self.permute(value, size, tweak)
        out = []
        for c in reversed(symbols):
            value, s = divmod(value, 10 if c.isdigit() else 26)
            out.append(str(s) if c.isdigit() else chr(65 + s))
        return "".join(reversed(out))

    def checked(self, symbols: str, kind: str) -> str:
        """A number of digits and capitals in its own form, valid by the same check if it was valid and by none if not."""
        if is_iban(symbols):
            account = self._symbols(symbols[4:], f"{kind}:iban:{symbols[:2]}:{_form(symbols)}".encode())
            return symbols[:2] + iban_check(symbols[:2], account) + account
        mine = scheme_of(symbols)
        tweak = f"{kind}:{mine}:{_form(symbols)}".encode()
        while True:
            if mine is None:
                symbols = self._symbols(symbols, tweak)
            else:
                form, check = CHECKED[mine]
                payload = symbols[: len(form)]
                if payload[0] in "XYZ":  # the letter takes part in the check and is one of three
                    payload = payload[0] + self._symbols(payload[1:], tweak + payload[:1].encode())
                else:
                    payload = self._symbols(payload, tweak)
                symbols = payload + check(payload)
            if scheme_of(symbols) == mine and not is_iban(symbols):
                return symbols

    def number(self, value: str, kind: str) -> str:
        """``value`` with its digits and capital letters permuted; everything else, and so the format, stays."""
        at = [i for i, c in enumerate(value) if c.isascii() and (c.isdigit() or c.isupper())]
        if len(at) < 2:
            return self.tag(value)
        out = list(value)
        for i, s in zip(at, self.checked("".join(value[i] for i in at), kind)):
            out[i] = s
        return "".join(out)

    def phone(self, value: str) -> str:
        """One international form for all ways to write a number; country and first digit stay, so the form fits the country."""
        found = telephone(value)
        if found is None:
            return self.number(value, "phone")
        code, national = found
        return f"+{code}{national[0]}{self._symbols(national[1:], f'phone:{code}:{len(national)}'.encode())}"

    def day(self, value: date) -> date:
        """Another day of 1900 to 2099; other days stay."""
        n = (value - _EPOCH).days
        return _EPOCH + timedelta(days=self.permute(n, _DAYS, b"day")) if 0 <= n < _DAYS else value

    def birth_date(self, value: str) -> str:
        """A date in figures, as another date written alike."""
        m = re.fullmatch(r"(\d{1,4})([./-])(\d{1,2})\2(\d{1,4})", value)
        if not m:
            return self.tag(value)
        parts = [m[1], m[3], m[4]]
        order = (0, 1, 2) if len(m[1]) == 4 else (2, 1, 0) if m[2] != "/" or int(m[1]) > 12 else (2, 0, 1)
        try:
            then = self.day(date(*[int(parts[i]) for i in order]))
        except ValueError:
            return self.number(value, "birth_date")
        written = {order[0]: f"{then.year:04d}", order[1]: f"{then.month:02d}", order[2]: f"{then.day:02d}"}
        return m[2].join(written[i] for i in range(3))

    def tag(self, value: str) -> str:
        bare = " ".join(value.split()).casefold()
        return hashlib.blake2b(bare.encode(), key=self._key, digest_size=16).hexdigest()

    def placeholder(self, plain: str, kind: str) -> str:
        """``[TYPE:pseudonym]`` of a detail in its plain spelling."""
        found = self._kept.get((plain, kind))
        if found is None:
            if kind == "phone":
                inside = self.phone(plain)
            elif kind in ("id_number", "account"):
                inside = self.number(plain, kind)
            elif kind == "birth_date":
                inside = self.birth_date(plain)
            else:
                inside = self.tag(plain)
            found = f"[{kind.upper()}:{inside}]"
            if len(self._kept) >= KEPT:
                self._kept.clear()
            self._kept[plain, kind] = found
        return found
