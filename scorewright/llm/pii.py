"""Pseudonyms for personal data by format-preserving Feistel permutation.

Values are found by pattern and validated (check digits, calendars, ranges).  A
valid value is numbered within all values of its format, the number is permuted
under a secret key, and the result is written back in the value's own shape: same
length, separators and letter case, check digits right.  The permutation is one
to one and depends on key and format alone, so equal values stay equal, and
different ones different, across all documents and runs.
"""

from __future__ import annotations

import bisect
import contextlib
import datetime
import functools
import hashlib
import re
import string
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .common import only, only_cache, read, spread

#: For this repository's query alone; whoever calls the operator passes a secret key.
DEMO_KEY = b"demonstration key, not secret"
ROUNDS = 8


def _round(key: bytes, kind: str, size: int, i: int, half: int, width: int) -> int:
    """A number of at least ``width`` + 128 bits, so that no part of a half that wide is left as it was."""
    out, block = b"", 0
    while len(out) * 8 < width + 128:
        out += hashlib.blake2b(f"{kind}|{size}|{i}|{block}|{half:x}".encode(), key=key[:64], digest_size=64).digest()
        block += 1
    return int.from_bytes(out, "big")


def permute(x: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """Keyed permutation of 0..size-1: a Feistel network over two near-equal halves, walked until inside."""
    if not 0 <= x < size:
        raise ValueError("outside the format")
    if size == 1:
        return x
    a = 1
    while a * a < size:
        a *= 2
    if a > 2 and (a // 2) * a >= size:
        b, a = a // 2, a
    else:
        b = a
    width = a.bit_length()
    while True:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2:
                f = _round(key, kind, size, i, left, width) % b
                right = (right - f) % b if back else (right + f) % b
            else:
                f = _round(key, kind, size, i, right, width) % a
                left = (left - f) % a if back else (left + f) % a
        x = left * b + right
        if x < size:
            return x


def _fill(shape: str, digits: str) -> str:
    """``digits`` in place of the digits of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c in string.digits else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c in string.digits)


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` plus it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 == 0 else d
    return str(-total % 10)


def _numbered(kind: str, least: int, most: int):
    def make(raw: str, go) -> str | None:
        d = _digits(raw)
        if not least <= len(d) <= most or len(set(d)) == 1:
            return None
        return _fill(raw, str(go(int(d), 10 ** len(d), f"{kind}{len(d)}")).zfill(len(d)))

    return make


def _card(raw: str, go) -> str | None:
    d = _digits(raw)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = str(go(int(d[:-1]), 10 ** (len(d) - 1), f"card{len(d)}")).zfill(len(d) - 1)
    return _fill(raw, body + luhn_digit(body))


_PLAN = re.compile(r"[2-9]\d\d [2-9]\d\d \d{4}")


def _phone(raw: str, go) -> str | None:
    """National digits are permuted; a country code after + stays."""
    if _PLAN.fullmatch(raw):
        # Area and exchange begin with 2 to 9, so that the pseudonym is such a number again.
        d = [int(c) for c in _digits(raw)]
        sizes = [8 if i in (0, 3) else 10 for i in range(10)]
        n = 0
        for i, (x, size) in enumerate(zip(d, sizes)):
            n = n * size + x - (2 if size == 8 else 0)
        n, out = go(n, 64 * 10**8, "phone plan"), []
        for size in reversed(sizes):
            n, x = divmod(n, size)
            out.append(str(x + (2 if size == 8 else 0)))
        return _fill(raw, "".join(reversed(out)))
    code = re.match(r"\+\d{1,3}(?=[ .(-])", raw)
    head = code[0] if code else ""
    made = _numbered("phone", 6, 14)(raw[len(head) :], go)
    return None if made is None or not 7 <= len(_digits(raw)) <= 15 else head + made


def _ssn(raw: str, go) -> str | None:
    area, group, serial = (int(x) for x in raw.split("-"))
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return None
    n = go(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    area, group, serial = n // (99 * 9999), n // 9999 % 99 + 1, n % 9999 + 1
    return f"{area + 1 + (area + 1 >= 666):03d}-{group:02d}-{serial:04d}"


def _iban_mod(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(raw: str, go) -> str | None:
    """Letters of either case; check digits are made anew, the country stays."""
    s = raw.replace(" ", "").upper()
    if _iban_mod(s) != 1:
        return None
    body, sizes = s[4:], []
    n = 0
    for c in body:
        base = 10 if c in string.digits else 26
        n = n * base + (int(c) if base == 10 else ord(c) - 65)
        sizes.append(base)
    size = 1
    for base in sizes:
        size *= base
    n = go(n, size, "iban" + s[:2] + "".join("d" if b == 10 else "a" for b in sizes))
    out = []
    for base in reversed(sizes):
        n, x = divmod(n, base)
        out.append(str(x) if base == 10 else chr(65 + x))
    body = "".join(reversed(out))
    s = s[:2] + f"{98 - _iban_mod(s[:2] + '00' + body):02d}" + body
    it = iter(s)
    return "".join(c if c == " " else next(it).lower() if c.islower() else next(it) for c in raw)


def _ipv4(raw: str, go) -> str | None:
    parts = [int(x) for x in raw.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in raw.split(".")):
        return None
    # Each part keeps its number of digits.
    lows, sizes = [(0, 10, 100)[len(str(x)) - 1] for x in parts], [(10, 90, 156)[len(str(x)) - 1] for x in parts]
    n, size = 0, 1
    for x, low, base in zip(parts, lows, sizes):
        n, size = n * base + x - low, size * base
    n, out = go(n, size, "ipv4" + "".join(str(len(str(x))) for x in parts)), []
    for low, base in zip(reversed(lows), reversed(sizes)):
        n, x = divmod(n, base)
        out.append(str(x + low))
    return ".".join(reversed(out))


_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal() - datetime.date(1900, 1, 1).toordinal() + 1
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _moved(y: int, m: int, d: int, go, fits: Callable[[datetime.date], bool] | None = None, kind: str = "date") -> datetime.date | None:
    """The date permuted within 1900-2099, or within those dates that fit the value's own form."""
    try:
        n = datetime.date(y, m, d).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= n < _DAYS:
        return None
    while True:
        n = go(n, _DAYS, kind)
        moved = datetime.date.fromordinal(_FIRST + n)
        if fits is None or fits(moved):
            return moved


def _ymd(raw: str, go) -> str | None:
    y, m, d = (int(x) for x in re.split(r"[-/.]", raw))
    moved = _moved(y, m, d, go)
    return moved and f"{moved.year:04d}{raw[4]}{moved.month:02d}{raw[4]}{moved.day:02d}"


def _dmy(raw: str, go) -> str | None:
    """Day first; month first only where the other reading is no date, and then the result is such a one too.

    One digit stays one digit, two stay two.
    """
    a, b, _ = re.split(r"[-/.]", raw)
    x, y, year = (int(v) for v in re.split(r"[-/.]", raw))
    mark = re.search(r"[-/.]", raw)[0]
    short = lambda text, v: len(text) == 2 or v < 10
    if y <= 12:
        moved = _moved(year, y, x, go, lambda t: short(a, t.day) and short(b, t.month))
        return moved and f"{moved.day:0{len(a)}d}{mark}{moved.month:0{len(b)}d}{mark}{moved.year:04d}"
    moved = _moved(year, x, y, go, lambda t: t.day > 12 and short(a, t.month), "late date")
    return moved and f"{moved.month:0{len(a)}d}{mark}{moved.day:02d}{mark}{moved.year:04d}"


def _suffix(day: int) -> str:
    return "th" if 11 <= day <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


def _named(raw: str, go) -> str | None:
    """1 March 1984, March 1st, 1984 and the like: the month's name keeps its length and case, the day its digits."""
    word = re.search(_MONTH, raw)[0]
    day, year = re.findall(r"\d+", raw)
    ordinal = re.search(rf"{day}(st|nd|rd|th)", raw, re.IGNORECASE)
    name = lambda m: _MONTHS[m - 1][:3] if len(word) == 3 else _MONTHS[m - 1]
    month = [m[:3] for m in _MONTHS].index(word[:3].capitalize()) + 1
    if ordinal and ordinal[1].lower() != _suffix(int(day)):
        return None
    moved = _moved(int(year), month, int(day), go, lambda t: len(name(t.month)) == len(word) and (len(day) == 2 or t.day < 10))
    if not moved:
        return None
    as_word = lambda x: "".join(c.upper() if w.isupper() else c.lower() for c, w in zip(x, word))
    said = {word: as_word(name(moved.month)), day: f"{moved.day:0{len(day)}d}", year: f"{moved.year:04d}"}
    if ordinal:
        suffix = _suffix(moved.day)
        said = {ordinal[0]: said[day] + (suffix.upper() if ordinal[1].isupper() else suffix)} | {k: v for k, v in said.items() if k != day}
    return re.sub("|".join(map(re.escape, sorted(said, key=len, reverse=True))), lambda m: said[m[0]], raw)


@functools.lru_cache(4096)
def _alphabet(c: str) -> str:
    """The characters that ``c`` may become: same sort, same neighbourhood of 64 code points; a mark only itself."""
    if c in string.digits:
        return string.digits
    if c in string.ascii_lowercase or c in string.ascii_uppercase:
        return string.ascii_lowercase if c.islower() else string.ascii_uppercase
    kind, low = unicodedata.category(c), ord(c) & ~63
    return "".join(chr(i) for i in range(low, low + 64) if unicodedata.category(chr(i)) == kind) if kind[0] in "LN" else c


def _email(raw: str, go) -> str | None:
    """Letters and digits, of any script, are permuted in place; only the last label of the domain stays as it is.

    ASCII letters count alike in both cases and keep their case.
    """
    own, dot, last = raw.rpartition(".")
    alphabets = [_alphabet(c.lower() if c in string.ascii_letters else c) for c in own]
    n, size = 0, 1
    for c, letters in zip(own, alphabets):
        n = n * len(letters) + letters.index(c.lower() if c in string.ascii_letters else c)
        size *= len(letters)
    n = go(n, size, "email" + "".join(a[0] if len(a) > 1 else "." for a in alphabets))
    out = []
    for c, letters in zip(reversed(own), reversed(alphabets)):
        n, x = divmod(n, len(letters))
        out.append(letters[x].upper() if c in string.ascii_uppercase else letters[x])
    return "".join(reversed(out)) + dot + last


#: Lengths of IBANs: fixed values of the public registry.
IBAN_LENGTHS = {k[:2]: int(k[2:]) for k in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 "
    "JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
_MONTH = r"(?i:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_DAY = r"\d{1,2}(?i:st|nd|rd|th)?"
#: In this order; what one kind has taken the later ones leave alone. No pattern asks for more at its edges than that no
#: digit goes on: any letter, mark or sign may stand beside a value.
KINDS: tuple[tuple[str, re.Pattern, Callable], ...] = (
    ("email", re.compile(r"@(?:[^\W_][\w-]*\.)+(?:xn--[A-Za-z0-9-]{2,59}|[^\W\d_]{2,63})"), _email),
    ("iban", re.compile(r"[A-Za-z]{2}\d{2}(?= ?[A-Za-z0-9])"), _iban),
    ("date", re.compile(r"(?<!\d)(?:19|20)\d\d([-/.])\d{2}\1\d{2}(?!\d)"), _ymd),
    ("date", re.compile(r"(?<!\d)\d{1,2}([-/.])\d{1,2}\1(?:19|20)\d\d(?!\d)"), _dmy),
    ("date", re.compile(rf"(?<!\d){_DAY}(?i: of)? {_MONTH},? (?:19|20)\d\d(?!\d)|{_MONTH} {_DAY},? (?:19|20)\d\d(?!\d)"), _named),
    ("ipv4", re.compile(r"(?<!\d)(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"), _ipv4),
    ("ssn", re.compile(r"(?<!\d)(?<!\d-)\d{3}-\d{2}-\d{4}(?!-?\d)"), _ssn),
    ("card", re.compile(r"(?<!\d)(?:(?<!\+)|(?=(?:\d[ -]?){16}))\d(?:[ -]?\d){12,18}(?!\d)"), _card),
    ("phone", re.compile(r"\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d){5,13}(?!\d)|\(\d{2,4}\)[ .-]?\d{2,4}[ .-]\d{2,5}(?!\d)|(?<!\d)\d{3}([.-])\d{3}\1\d{4}(?!\d)|(?<!\d)[2-9]\d\d [2-9]\d\d \d{4}(?!\d)"), _phone),
)
_ANY = re.compile(r"\d|@")
#: Kinds whose patterns may take in text beside a value, beyond one of these marks.
_GREEDY, _MARK = ("card", "phone"), re.compile("[ .-]")
#: What the part of an address before the @ may hold besides letters and digits; it begins with one of those.
_LOCAL_MARKS = frozenset("._%+'-")


def _address(text: str, at: int, low: int) -> int:
    """Where the part before the @ at ``at`` begins, not before ``low``; ``at`` if there is none."""
    i = at
    while i > low and (text[i - 1].isalnum() or text[i - 1] in _LOCAL_MARKS):
        i -= 1
    while i < at and not text[i].isalnum():
        i += 1
    return i


def _account(text: str, start: int) -> int:
    """Where the IBAN that begins at ``start`` ends by its country's length, groups of four apart by a space or not; 0 if it doesn't."""
    left, i, n = IBAN_LENGTHS.get(text[start : start + 2].upper(), 0), start, 0
    while left and i < len(text):
        c = text[i]
        if c == " " and n and n % 4 == 0 and text[i - 1] != " ":
            i += 1
        elif c.isascii() and c.isalnum():
            i, n, left = i + 1, n + 1, left - 1
        else:
            return 0
    return i if n and not left else 0


def _candidates(text: str, kind: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans to be tried in turn, the longest first at each place; the receiver sends whether it took the last one."""
    at, low = 0, 0
    while m := pattern.search(text, at):
        start, end = m.span()
        if kind == "email":
            first, at = _address(text, start, low), start + 1
            if first < start and (yield first, end):
                at = low = end
            continue
        if kind == "iban":
            at, stop = start + 1, _account(text, start)
            if stop and (yield start, stop):
                at = stop
            continue
        cuts = [c.start() for c in _MARK.finditer(text, start, end)] if kind in _GREEDY else []
        at = next((c + 1 for c in cuts if c > start), end)  # what follows, if nothing is valid here
        for stop in [end, *reversed(cuts)]:
            if (stop == end or pattern.fullmatch(text, start, stop)) and (yield start, stop):
                at = stop
                break


def find(text: str, key: bytes, back: bool = False) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of every valid value, in no set order; ``back`` gives the originals of pseudonyms."""
    if not _ANY.search(text):
        return
    taken: list[tuple[int, int]] = []  # sorted, without overlaps
    go = lambda n, size, kind: permute(n, size, key, kind, back)
    for kind, pattern, make in KINDS:
        if kind == "email" and "@" not in text:
            continue
        tried, took = _candidates(text, kind, pattern), None
        with contextlib.suppress(StopIteration):
            while True:
                start, end = tried.send(took)
                took = False
                k = bisect.bisect_left(taken, (start, end))
                if k < len(taken) and taken[k][0] < end or k and taken[k - 1][1] > start:
                    continue
                made = make(text[start:end], go)
                if made is not None:
                    took = True
                    taken.insert(k, (start, end))
                    yield start, end, kind, made


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with pseudonyms, and what was replaced: (start, end, kind, pseudonym) by place in the original."""
    found = sorted(find(text, key, back))
    parts, at = [], 0
    for start, end, _, made in found:
        parts += [text[at:start], made]
        at = end
    return "".join([*parts, text[at:]]), found


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("pseudonym", pa.string())])
_OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_values", pa.int64()), ("spans", pa.list_(_SPAN))])


def _map(key: bytes):
    def run(batches):
        only_cache()
        held, size = [], 0
        for doc_id, text in tokens.rows(batches, "doc_id", "text"):
            made, found = pseudonymise(text, key) if text else (text, [])
            held.append({"doc_id": doc_id, "text": made, "n_values": len(found), "spans": [dict(zip(("start", "end", "kind", "pseudonym"), f)) for f in found]})
            size += len(text or "") + 64
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=_OUT)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=_OUT)

    return run


def pseudonymise_documents(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text with pseudonyms, n_values, spans (of the original text).

    ``key`` is the secret; the same key gives the same pseudonyms in every run.
    Recognised: e-mail addresses (all but the top-level domain changes), IBAN (mod 97), dates 1900 to 2099, IPv4
    addresses, US social security numbers, card numbers (Luhn) and phone numbers.
    Anything that fails its validation is left as it is, as are texts without
    such values.  Any character may stand beside a value but a digit.  On purpose
    letters, digits and ``.%+'-_`` before an address, after a letter or digit,
    are part of it, as are letters after it; up to 15 digits after a ``+`` are a
    phone number, not a card; groups of digits joined by ``.`` or ``-`` to what
    reads as an IPv4 address or social security number make it none.  Lengths
    stay: one-digit days and months stay one digit, names of months keep theirs.
    Other columns, clashing names too, stay behind; texts of any length are
    taken whole.  A null text stays null, an empty one empty; ids may be null or
    repeat; an empty table gives an empty result.  No row meets another.
    """
    return spread(only(docs, doc_id=id_col, text=text_col)).mapInArrow(_map(key), "doc_id long, text string, n_values long, spans array<struct<start: long, end: long, kind: string, pseudonym: string>>")


def op1_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymise_documents(read(spark, sf_dir, "documents"), DEMO_KEY).select("doc_id", "text", "n_values", "spans")
