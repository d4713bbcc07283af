import datetime
import ipaddress
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorewright.llm import pii

KEY = b"k1"
TEXT = (
    "Mail Ann.Lee7@mail3.example.com or +1 (017) 555-7713, card 4263429643439180 / 4263-4296-4343-9180, "
    "IP 97.51.17.173, born 1984-03-12, 31.12.1999, 12/25/2001, 5 May 1990, March 1, 1984, ssn 123-45-6789, IBAN DE89 3704 0044 0532 0130 00."
)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation(size):
    got = [pii.permute(x, size, KEY, "t") for x in range(size)]
    assert sorted(got) == list(range(size))
    assert [pii.permute(y, size, KEY, "t", back=True) for y in got] == list(range(size))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 10**30).flatmap(lambda n: st.tuples(st.just(n), st.integers(0, n - 1))))
def test_large_permutation_inverts(case):
    size, x = case
    y = pii.permute(x, size, KEY, "t")
    assert 0 <= y < size and pii.permute(y, size, KEY, "t", back=True) == x


def test_every_kind_is_replaced_in_its_format():
    made, found = pii.pseudonymise(TEXT, KEY)
    assert [k for _, _, k, _ in found] == ["email", "phone", "card", "card", "ipv4", "date", "date", "date", "date", "date", "ssn", "iban"]
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s)))
    for start, end, kind, new in found:
        old = TEXT[start:end]
        assert new != old and new in made and old not in made
        if kind in ("email", "phone", "card", "ssn", "iban") or re.fullmatch(r"[\d./-]+", old) and kind == "date":
            assert shape(new) == shape(old)
        if kind == "card":
            d = re.sub(r"\D", "", new)
            assert pii.luhn_digit(d[:-1]) == d[-1]
        if kind == "iban":
            assert pii._iban_mod(new.replace(" ", "")) == 1
    again = pii.pseudonymise(made, KEY)[1]
    assert [k for _, _, k, _ in again] == [k for _, _, k, _ in found]  # still valid values
    assert pii.pseudonymise(made, KEY, back=True)[0] == TEXT
    assert pii.pseudonymise(TEXT, b"k2")[0] != made
    cards = [re.sub(r"\D", "", n) for _, _, k, n in found if k == "card"]
    assert cards[0] == cards[1]  # the same number, however written


def test_invalid_values_and_plain_text_stay():
    for text in ("version 2.0, 4.0.", "4263429643439181", "300.1.1.1", "1.2.3.4.5", "2023-02-30", "000-12-3456", "DE89 3704 0044 0532 0130 02", "a@b", "1111111111111111", "page 12 of 34", "", "x" * 100000, "1 2 3 4 5 6 7 8 9"):
        assert pii.pseudonymise(text, KEY) == (text, []), text


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("0123456789 -.@abé+()/:MayDE\n"), max_size=80))
def test_any_text_is_restored(text):
    made, found = pii.pseudonymise(text, KEY)
    assert len(made) - len(text) == sum(len(n) - (e - s) for s, e, _, n in found)


def test_table(spark):
    docs = [(1, TEXT), (1, TEXT), (2, None), (3, ""), (None, "no data"), (4, ("é " * 50000) + "97.51.17.173")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("n_values", F.lit(0))
    rows = pii.pseudonymise_documents(df, key=KEY).collect()
    assert sorted(((r.doc_id, r.text, r.n_values) for r in rows), key=repr) == sorted(((d, pii.pseudonymise(t, KEY)[0] if t else t, len(pii.pseudonymise(t or "", KEY)[1])) for d, t in docs), key=repr)
    assert pii.pseudonymise_documents(df.limit(0), KEY).count() == 0


LETTERS = "firstname.lastname.of.the.family.with.a.long.name.and.more.of.it.x1"


@pytest.mark.parametrize("raw", [
    LETTERS[:64] + "@" + ".".join(["departmentofaveryverylongname"] * 2) + ".subsubdomain.example.com",
    LETTERS[:64] + "@" + ".".join(["a" * 63] * 7) + ".com",
    "jane.doe@janedoe.net",
    "\u0438\u0432\u0430\u043d.\u043f\u0435\u0442\u0440\u043e\u0432@example.org",
    "J\u00fcrgen.M\u00fcller\u0661\u0662@example.org",
])
def test_no_part_of_an_address_stays(raw):
    made, found = pii.pseudonymise(f"to {raw} now", KEY)
    assert [(s, e, k) for s, e, k, _ in found] == [(3, 3 + len(raw), "email")]
    new = found[0][3]
    assert len(new) == len(raw) and new.rpartition(".")[2] == raw.rpartition(".")[2]
    at = len(raw) - len(raw.rpartition(".")[2])
    for a, b in zip(raw[:at], new[:at]):
        assert (a.isalpha(), a.isdigit(), a.isupper()) == (b.isalpha(), b.isdigit(), b.isupper()) and (a.isalnum() or a == b)
    same = "".join("x" if a == b and a.isalnum() else " " for a, b in zip(raw[:at], new[:at]))
    assert max(map(len, same.split()), default=0) <= 4  # chance agreement only
    assert pii.pseudonymise(made, KEY, back=True)[0] == f"to {raw} now"


def test_both_halves_of_wide_numbers_change():
    size = 26**400
    for x in (0, 1, 5, size // 3, size - 1):
        y = pii.permute(x, size, KEY, "t")
        assert abs(y - x) > size >> 40 and pii.permute(y, size, KEY, "t", back=True) == x
        near = pii.permute((x + 1) % size, size, KEY, "t")
        assert abs(near - y) > size >> 40


def plain_luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def plain_iban(s):
    n = 0
    for c in s[4:] + s[:4]:
        n = (n * 10 + int(c)) % 97 if c.isdigit() else (n * 100 + ord(c) - 55) % 97
    return n == 1


#: Values with the check that an independent reader makes of them.
PLANTED = [
    ("email", "ann.lee@mail.example.com", lambda v: re.fullmatch(r"[a-z.]+@[a-z.]+\.com", v)), ("email", "Bob_2@x-y.org", lambda v: re.fullmatch(r"[A-Z][a-z]{2}_\d@[a-z]-[a-z]\.org", v)),
    ("iban", "DE89370400440532013000", plain_iban), ("iban", "GB82WEST12345698765432", plain_iban),
    ("date", "2020-02-29", lambda v: datetime.date.fromisoformat(v)), ("date", "07.11.1963", lambda v: datetime.datetime.strptime(v, "%d.%m.%Y")),
    ("ipv4", "10.0.0.254", lambda v: ipaddress.IPv4Address(v)), ("ssn", "078-05-1120", lambda v: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", v)),
    ("card", "4111111111111111", plain_luhn), ("card", "378282246310005", plain_luhn), ("phone", "+49 30 1234567", lambda v: v[:4] == "+49 "), ("phone", "555-123-4567", lambda v: re.fullmatch(r"\d{3}-\d{3}-\d{4}", v)),
]


def test_planted_values_are_found_and_nothing_else(spark):
    r = random.Random(11)
    words = "the cat sat on a mat in room with 12 chairs and 3 tables at 50 % of 1,200 units v2.1 x".split()
    docs, want = [], {}
    for i in range(150):
        text, spans = "", []
        for _ in range(r.randrange(6)):
            text += " ".join(r.choice(words) for _ in range(r.randrange(1, 9))) + r.choice([": ", " (", "\n", " - see "])
            kind, value, _ = PLANTED[r.randrange(len(PLANTED))]
            spans.append((len(text), len(text) + len(value), kind, value))
            text += value + r.choice([", ", ") ", "\n", "; "])
        docs.append((i, text + "end"))
        want[i] = spans
    checks, made_of = {v: f for _, v, f in PLANTED}, {}
    for row in pii.pseudonymise_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), KEY).collect():
        spans = want[row.doc_id]
        assert [(s.start, s.end, s.kind) for s in row.spans] == [x[:3] for x in spans] and row.n_values == len(spans)
        rebuilt, at, old = "", 0, docs[row.doc_id][1]
        for s, (_, _, _, value) in zip(row.spans, spans):
            rebuilt += old[at : s.start] + s.pseudonym
            at = s.end
            assert s.pseudonym != value and checks[value](s.pseudonym)
            assert made_of.setdefault(value, s.pseudonym) == s.pseudonym  # linked across documents
        assert row.text == rebuilt + old[at:]
    assert len(set(made_of.values())) == len(made_of) == len(PLANTED)


def test_query_leaves_no_value(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op1_feistel_pseudonyms(spark, sf).collect():
        for s in r.spans:
            assert docs[r.doc_id][s.start : s.end] not in r.text
        if not r.n_values:
            assert r.text == docs[r.doc_id]
            assert not re.search(r"\S@\S|\d{13}|\d+\.\d+\.\d+\.\d+|555-\d{4}", r.text)


@pytest.mark.parametrize(("kind", "value"), [("card", "4111 1111 1111 1111"), ("card", "4111-1111-1111-1111"), ("iban", "BE68 5390 0754 7034"), ("iban", "AT61 1904 3002 3457 3201")])
def test_value_beside_other_text(kind, value):
    for before, after in (("", " 12/27"), ("", " 123"), ("", " EUR"), ("", " BIC"), ("", " BANK CODE"), ("no. 12 ", ""), ("", " 12 and more")):
        made, found = pii.pseudonymise(f"x {before}{value}{after}", KEY)
        assert [(s, e, k) for s, e, k, _ in found] == [(2 + len(before), 2 + len(before) + len(value), kind)], (before, after)
        assert value not in made and made == f"x {before}{found[0][3]}{after}"


def test_values_in_a_row():
    row = "BE68 5390 0754 7034 AT61 1904 3002 3457 3201 4111 1111 1111 1111 4263 4296 4343 9180"
    assert [row[s:e] for s, e, _, _ in pii.pseudonymise(row, KEY)[1]] == ["BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "4111 1111 1111 1111", "4263 4296 4343 9180"]


@pytest.mark.parametrize(("text", "value"), [
    ("2024-01-15T10:00:00Z", "2024-01-15"), ("1999-02-01_", "1999-02-01"), ("-john.smith@example.com", "john.smith@example.com"), ("+john@example.com", "john@example.com"), ("john@example.com_", "john@example.com"),
    ("john.smith@example.com2", "john.smith@example.com"), ("john@\u043f\u0440\u0438\u043c\u0435\u0440.\u0440\u0444", None), ("o'brien@example.com", None), ("212 555 0199", None), ("1 march 1984", None), ("March 1st, 1984", None),
    ("the 22ND OF AUGUST 1999.", "22ND OF AUGUST 1999"), ("de89370400440532013000", None), ("DE89 3704 0044 0532 0130 00", None), ("1/2/1999", None), ("12/31/1999", None), ("3-11-2005", None), ("7.4.2031.", "7.4.2031"), ("8.8.4.4", None), ("may 5, 2001", None),
])
def test_edges_and_widths(text, value):
    value = value or text
    made, found = pii.pseudonymise(text, KEY)
    at = text.index(value)
    assert [(s, e) for s, e, _, _ in found] == [(at, at + len(value))]
    new = found[0][3]
    assert len(new) == len(value) and [c.isdigit() for c in new] == [c.isdigit() for c in value] and [c.isupper() for c in new] == [c.isupper() for c in value]
    assert pii.pseudonymise(made, KEY, back=True)[0] == text


@pytest.mark.parametrize("sign", [*"-+_'T:/.,;#*|~=\"x", "\u0436", "\u6f22", "\u00e9"])
def test_any_neighbour(sign):
    for kind, value, _ in [*PLANTED, ("date", "1/2/1999", None), ("date", "3 May 2001", None), ("date", "12/31/1999", None), ("phone", "212 555 0199", None), ("phone", "(212) 555-0199", None), ("iban", "BE68 5390 0754 7034", None)]:
        for before, after in ((sign, ""), ("", sign), (sign, sign)):
            if kind == "email" and (before.isalpha() or after.isalpha()):
                continue  # letters beside an address are part of it
            if before == "+" and kind in ("card", "phone"):
                continue  # up to 15 digits after a plus are a phone number
            text = f"see {before}{value}{after} there"
            made, found = pii.pseudonymise(text, KEY)
            assert [(s, e, k) for s, e, k, _ in found] == [(4 + len(before), 4 + len(before) + len(value), kind)], text
            assert found[0][3] != value and pii.pseudonymise(made, KEY, back=True)[0] == text


def test_dates_of_one_width_are_permuted():
    """All dates that a form can write go to different dates of that form."""
    for make, texts in ((pii._dmy, [f"{d}/{m}/{y}" for y in range(1990, 1993) for m in range(1, 10) for d in range(1, 10)]), (pii._named, [f"{d} June {y}" for y in range(1950, 1960) for d in range(1, 10)])):
        made = [make(t, lambda n, size, kind: pii.permute(n, size, KEY, kind)) for t in texts]
        assert len(set(made)) == len(texts) and {len(x) for x in made} == {len(texts[0])}
