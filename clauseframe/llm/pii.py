"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass validation (card and bank numbers, telephone numbers, addresses of machines, social
security numbers, calendar dates) are replaced by others of the same format through a keyed Feistel network over the
values that the format allows. The mapping is a permutation fixed by the key, so equal values get equal pseudonyms in
all documents and different values different ones, and no table of values is kept. Check digits are worked out anew,
so pseudonyms pass the same validation. The names of mail addresses and long hexadecimal tokens are treated the same
way, each as a whole among those of its shape; the domain of an address stays in clear. A day is one value in whatever
order and with or without zeros it is written; where both readings are days, 3/4/2024 is read day first.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from clauseframe.llm.common import columns, map_texts

ROUNDS = 8
#: Years between which a date counts as one, and in which its pseudonym lies.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


class Feistel:
    """Keyed permutations of 0 .. n - 1, one for each format."""

    def __init__(self, key: bytes):
        self.key = key
        self._cached = lru_cache(maxsize=100_000)(self._permute)

    def _round(self, tweak: bytes, r: int, x: int, most: int) -> int:
        size = (most.bit_length() + 7) // 8 + 8
        return int.from_bytes(hashlib.shake_256(hmac.digest(self.key, tweak + bytes([r]) + x.to_bytes((x.bit_length() + 7) // 8 or 1, "big"), "sha256")).digest(size), "big") % most

    def _permute(self, tweak: bytes, n: int, x: int) -> int:
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        while True:  # left has a values and right a, so the domain is little larger than n; walk until inside
            left, right = divmod(x, a)
            for r in range(ROUNDS):
                left, right = right, (left + self._round(tweak, r, right, a)) % a
            x = left * a + right
            if x < n:
                return x

    def permute(self, tweak: str, n: int, x: int) -> int:
        return self._cached(tweak.encode(), n, x)


def luhn_digit(digits: str) -> str:
    """The check digit that belongs behind some digits."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def luhn(digits: str) -> bool:
    return digits[-1:] == luhn_digit(digits[:-1])


def iban_ok(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _refill(shape: str, chars: str, wanted: Callable[[str], bool]) -> str:
    """``shape`` with its wanted characters replaced by ``chars`` in order."""
    it = iter(chars)
    return "".join(next(it) if wanted(c) else c for c in shape)


def _number(f: Feistel, tweak: str, digits: str) -> str:
    return str(f.permute(f"{tweak}{len(digits)}", 10 ** len(digits), int(digits))).zfill(len(digits)) if digits else ""


_SHAPE = str.maketrans(dict.fromkeys(DIGITS, "0") | dict.fromkeys(LOWER, "a") | dict.fromkeys(UPPER, "A"))
_CLASSES = dict.fromkeys(DIGITS, DIGITS) | dict.fromkeys(LOWER, LOWER) | dict.fromkeys(UPPER, UPPER)


def _letters(f: Feistel, tweak: str, text: str) -> str:
    """The text as a whole is permuted among those of its shape: the same classes of characters at the same places."""
    places = [(c, letters) for c in text if (letters := _CLASSES.get(c))]
    n, total = 0, 1
    for c, letters in places:
        n, total = n * len(letters) + letters.index(c), total * len(letters)
    n = f.permute(f"{tweak}|{text.translate(_SHAPE)}", total, n)
    made = []
    for _, letters in reversed(places):
        n, d = divmod(n, len(letters))
        made.append(letters[d])
    return _refill(text, "".join(reversed(made)), _CLASSES.__contains__)


#: First digits and lengths of card numbers.
CARDS = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|35\d{14}|6(?:011|4[4-9]\d|5\d\d)\d{12}")


def _card(f: Feistel, m: re.Match) -> str | None:
    """Only numbers of a known issuer with a right check digit; the issuer's four digits stay."""
    digits = re.sub(r"\D", "", m[0])
    if not (CARDS.fullmatch(digits) and luhn(digits)):
        return None
    body = digits[:4] + _number(f, f"card{digits[:4]}", digits[4:-1])
    return _refill(m[0], body + luhn_digit(body), str.isdigit)


def _iban(f: Feistel, m: re.Match) -> str | None:
    plain = m[0].replace(" ", "")
    if not 15 <= len(plain) <= 34 or not iban_ok(plain):
        return None
    body = plain[:2] + "00" + _letters(f, "iban" + plain[:2], plain[4:])
    check = str(98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97).zfill(2)
    return _refill(m[0], body[:2] + check + body[4:], lambda c: c != " ")


#: How card numbers are usually written in groups.
LAYOUTS = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), (4, 4, 4, 1)}
_ANY = re.compile(r".+", re.DOTALL)
#: Lengths of bank numbers by country.
IBANS = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FO,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,TL "
    "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC"
).split()) for c in cs.split(",")}


def _card_parts(m: re.Match) -> Iterator[re.Match]:
    """What in a run of digits may be a card, as other numbers may stand beside it: from each group of digits to the
    end of each group that leaves 13 to 19 digits. Unbroken groups come first, then customary ones, then the longest part.
    """
    groups = list(re.finditer(r"\d+", m[0]))
    last = len(groups) - bool(re.compile(r"\w|\.\d", re.ASCII).match(m.string, m.end()))
    found = []
    for i in range(last):
        lengths: list[int] = []
        for j in range(i, last):
            lengths.append(len(groups[j][0]))
            if sum(lengths) > 19:
                break
            if sum(lengths) >= 13:
                found.append((0 if i == j else 1 if tuple(lengths) in LAYOUTS else 2, i, -j))
    for _, i, j in sorted(found):
        yield _ANY.fullmatch(m.string, m.start() + groups[i].start(), m.start() + groups[-j].end())


def _iban_parts(m: re.Match) -> Iterator[re.Match]:
    """What of a bank number and the words behind it may be the number: first by the country's length, then the longest."""
    ends = [i for i, c in enumerate(m[1]) if c == " "] + [len(m[1])]
    for end in sorted(ends, key=lambda i: (i - m[1].count(" ", 0, i) != IBANS.get(m[1][:2]), -i)):
        yield _ANY.fullmatch(m.string, m.start(), m.start() + end)


def _phone(f: Feistel, m: re.Match) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 8 <= len(digits) <= 15:
        return None
    keep = len(digits) - 7  # country and area stay, as they fix how the rest is written
    if keep >= 4:  # the area is personal too, and its first digit may not be 0 or 1
        head, area, rest = digits[: keep - 3], digits[keep - 3 : keep], digits[keep:]
        if "2" <= area[0]:
            n = f.permute(f"phone{head}", 800 * 10**7, (int(area) - 200) * 10**7 + int(rest))
            return _refill(m[0], head + str(n // 10**7 + 200) + str(n % 10**7).zfill(7), str.isdigit)
    return _refill(m[0], digits[:keep] + _number(f, "phone" + digits[:keep], digits[keep:]), str.isdigit)


def _ssn(f: Feistel, m: re.Match) -> str | None:
    area, group, serial = int(m[1]), int(m[2]), int(m[3])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    n = f.permute("ssn", 898 * 99 * 9999, ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1)
    n, serial = divmod(n, 9999)
    area, group = divmod(n, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


#: First number and how many there are, of octets with so many digits.
_OCTETS = {1: (0, 10), 2: (10, 90), 3: (100, 156)}


def _ip(f: Feistel, m: re.Match) -> str | None:
    """Among addresses whose parts have as many digits."""
    parts = m[0].split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n, total = 0, 1
    for p in parts:
        first, count = _OCTETS[len(p)]
        n, total = n * count + int(p) - first, total * count
    n = f.permute("ip" + "".join(str(len(p)) for p in parts), total, n)
    out = []
    for p in reversed(parts):
        first, count = _OCTETS[len(p)]
        n, d = divmod(n, count)
        out.append(str(first + d))
    return ".".join(reversed(out))


def _date(order: str) -> Callable[[Feistel, re.Match], str | None]:
    def work(f: Feistel, m: re.Match) -> str | None:
        got = dict(zip(order, (m[1], m[3], m[4]), strict=True))
        try:
            day = datetime.date(int(got["y"]), int(got["m"]), int(got["d"]))
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        # Among days whose month and day have as many digits, so that a day gets the same one however it is written.
        digits = len(str(day.month)), len(str(day.day))
        days, at = _days(*digits)
        new = days[f.permute(f"date{digits[0]}{digits[1]}", len(days), at[day])]
        made = {"y": str(new.year), "m": str(new.month).zfill(len(got["m"])), "d": str(new.day).zfill(len(got["d"]))}
        return m[2].join(made[x] for x in order)

    return work


@lru_cache(maxsize=8)
def _days(month_digits: int, day_digits: int) -> tuple[list[datetime.date], dict[datetime.date, int]]:
    out = []
    day = FIRST_DAY
    while day <= LAST_DAY:
        if len(str(day.month)) == month_digits and len(str(day.day)) == day_digits:
            out.append(day)
        day += datetime.timedelta(1)
    return out, {d: i for i, d in enumerate(out)}


def _mail(f: Feistel, m: re.Match) -> str:
    """The name as a whole, among the names of its shape at that domain; the domain stays."""
    return _letters(f, f"mail{m[2].lower()}", m[1]) + "@" + m[2]


#: Hexadecimal digits that are permuted at once; what follows depends on what came before.
TOKEN_PART = 128


def _token(f: Feistel, m: re.Match) -> str | None:
    if not re.search(r"\d", m[0]) or not re.search("[a-f]", m[0]):
        return None
    out = []
    before = ""
    for i in range(0, len(m[0]), TOKEN_PART):
        part = m[0][i : i + TOKEN_PART]
        n = f.permute(f"hex{len(m[0])}{before}", 16 ** len(part), int(part, 16))
        out.append(f"{n:0{len(part)}x}")
        before = hashlib.sha256(f"{before}{part}".encode()).hexdigest()
    return "".join(out)


#: Kinds, tried in this order at each place of a text.
KINDS: list[tuple[str, str, Callable[[Feistel, re.Match], str | None]]] = [
    ("email", r"(?<![\w.+-])([A-Za-z0-9._%+-]{1,64})@([A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})(?![\w@])", _mail),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _ip),
    ("date", r"(?<![\d./-])(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?![\d]|[-/.]\d)", _date("ymd")),
    ("date", r"(?<![\d./-])(\d{1,2})([./-])(\d{1,2})\2(\d{4})(?![\d]|[-/.]\d)", _date("dmy")),
    ("date", r"(?<![\d./-])(\d{1,2})([./-])(\d{1,2})\2(\d{4})(?![\d]|[-/.]\d)", _date("mdy")),
    ("ssn", r"(?<![\w-])(\d{3})-(\d{2})-(\d{4})(?![\w]|-\d)", _ssn),
    ("iban", r"(?<!\w)(?=([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)))", _iban),
    ("card", r"(?<![\w.+-])\d(?:[ -]?\d){12,}", _card),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(?\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\w]|[.-]\d)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w]|[.-]\d)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w]|[.-]\d)", _phone),
    ("token", r"(?<![\w])[0-9a-f]{32,}+(?![\w])", _token),
]
NAMES = list(dict.fromkeys(k for k, _, _ in KINDS))
_PATTERNS = [(k, re.compile(p, re.ASCII), f) for k, p, f in KINDS]
#: Kinds whose pattern finds where to look; which part is the value, validation tells.
_PARTS = {"iban": _iban_parts, "card": _card_parts}
#: A text without such a place has nothing to replace; it is far cheaper to look for.
_HINT = re.compile(r"@|\d[\d().\-/ ]{5}|[0-9a-f]{32}", re.ASCII)

SCHEMA = columns(text="string", **{f"n_{k}": "long" for k in NAMES})


def _free(spans: list[tuple[int, int, str]], m: re.Match) -> bool:
    """Whether a match lies over none of some spans, which are in order."""
    i = bisect.bisect_left(spans, (m.start(),))
    return (i == 0 or spans[i - 1][1] <= m.start()) and (i == len(spans) or m.end() <= spans[i][0])


def pseudonymize(text: str, f: Feistel) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind."""
    counts = dict.fromkeys(NAMES, 0)
    if not _HINT.search(text):
        return text, counts
    spans: list[tuple[int, int, str]] = []  # in order, none over another
    for kind, pattern, work in _PATTERNS:
        parts = _PARTS.get(kind, lambda m: (m,))
        new: list[tuple[int, int, str]] = []
        for m in (part for found in pattern.finditer(text) for part in parts(found)):
            if _free(spans, m) and _free(new, m) and (made := work(f, m)) is not None:
                bisect.insort(new, (m.start(), m.end(), made))
        counts[kind] += len(new)
        spans = sorted(spans + new) if new else spans
    out, at = [], 0
    for a, b, made in spans:
        out += [text[at:a], made]
        at = b
    return "".join([*out, text[at:]]), counts


def pseudonyms(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its identifier, the text with pseudonyms, and ``n_<kind>`` replaced.

    Defined cases: a null text gives an empty one; texts are read whole; values that fail validation stay as they are;
    a card or bank number is found beside other numbers and words too; repeated rows and null identifiers are rows of
    their own; an empty table gives an empty result; other columns are not read. ``key`` is a secret of at least 16 characters; the same key gives the same pseudonyms.
    """
    if len(key) < 16:
        raise ValueError("the key needs 16 characters")
    state: list[Feistel] = []

    def work(texts: list[str]) -> pd.DataFrame:
        if not state:
            state.append(Feistel(key.encode()))
        rows = [(t, *(c[k] for k in NAMES)) for t, c in (pseudonymize(x, state[0]) for x in texts)]
        return pd.DataFrame(rows, columns=["text", *(f"n_{k}" for k in NAMES)])

    return map_texts(df, id_col, text_col, work, SCHEMA)
