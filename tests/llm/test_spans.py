import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeworks.llm import pii, regex_trigrams, secrets
from tapeworks.llm.common import stored

PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(text):
    total = 0
    for i, c in enumerate(reversed(text)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)).encode()).hexdigest()


def pii_spans(text):
    return [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(PII) for m in re.finditer(p, text or "") if ok(m.group())]


def secret_spans(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


CASES = [
    "a@b.co_x@c.de", "..@a.b", "x@y", "é@a.bc mail ü.ö@x.y-z.w 😀 a@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "999999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "+1 (555) 010-9999 ) +44", "+1+1+12345678901", "1" * 3000 + "@", "a" * 3000 + "@b.c",
    "a@b.c " * 700, "1.2.3.4 " * 600, "x" * 20000 + "a@b.c",
    'password = "hunter22"', "PassWord:abc", "api_key=12345", "APIKEY='123456'", "token" + " " * 500 + ": abcdef", "secret=secret=abcdef", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "akia" + "A" * 20,
    "f" * 24, "F" * 24, "0123456789abcdef" * 3 + "g" + "a" * 23, "ſecret=abcdefg", "toKen=abcdefg",
]


@pytest.fixture(scope="module")
def texts(spark, awkward):
    cases = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(CASES)], "doc_id long, text string")
    return awkward.select("doc_id", "text").unionByName(cases)


def test_pii_base_spans(texts, documents):
    for docs in (texts, documents.select("doc_id", "text")):
        rows = stored(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("n")), "rows")
        got = pii.report(rows.drop("doc_id"), "n").collect()
        want = {r["n"]: r["text"] for r in rows.collect()}
        assert len(got) == len(want)
        for r in got:
            spans = pii_spans(want[r["doc_id"]])
            assert r["base_sha256"] == digest(spans), want[r["doc_id"]]
            assert [r[f"n_{k}"] for k, _, _ in PII] == [sum(s[2] == k for s in spans) for k, _, _ in PII]
            assert {f"{k}:{a}:{b}" for a, _, k, b in spans} <= set(r["spans"].split(","))


def test_pii_checks_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "DE88 3704 0044 0532 0130 00", "ssn 078-05-1120", "078-05-1120"]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[s["kind"] for s in r["found"] if s["kind"] in ("iban", "ssn")] for r in rows] == [["iban"], [], ["ssn"], []]


def test_secret_base_spans(texts, documents):
    for docs in (texts, documents.select("doc_id", "text")):
        rows = stored(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("n")), "rows")
        want = {r["n"]: r["text"] for r in rows.collect()}
        got = secrets.report(rows.drop("doc_id"), "n").collect()
        assert len(got) == len(want)
        for r in got:
            spans = secret_spans(want[r["doc_id"]])
            assert r["base_sha256"] == digest(spans), want[r["doc_id"]]
            assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]


def test_trigram_queries():
    assert regex_trigrams.query("[0-9a-f]{24,}") == regex_trigrams.EVERY
    assert regex_trigrams.query("(ab|cd)?x*") == regex_trigrams.EVERY
    assert regex_trigrams.query("abcd[0-9]+") == frozenset([frozenset([frozenset(["abc", "bcd"])])])
    assert regex_trigrams.query("(?:abc|xyz)[0-9]+") == frozenset([frozenset([frozenset(["abc"]), frozenset(["xyz"])])])


def test_candidates_lose_no_match():
    import pyarrow as pa

    scanner = secrets.Scanner()
    texts = CASES + ["ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "pass", "word", ""]
    postings = scanner.postings(pa.array(texts))
    for expression, query in zip(scanner.expressions, scanner.queries, strict=True):
        if query:
            rows = set(scanner.candidates(query, postings, len(texts)).tolist())
            assert {i for i, t in enumerate(texts) if expression.search(t)} <= rows < set(range(len(texts)))


@pytest.mark.parametrize(("pattern", "flags", "text"), [("contraseña=[a-z]+", 0, "x contraseña=abc"), ("пароль=[a-z]+", 0, "пароль=abc"), ("secret=[a-z]+", re.IGNORECASE, "ſecret=abc"), ("(?i:token)=[a-z]+", 0, "to\u212aen=abc"), ("(?i)key[:=]x", 0, "\u212aEY:X"), ("h[i-k]t[0-9]", re.IGNORECASE, "h\u0130t1")])
def test_rules_outside_ascii_lose_no_match(pattern, flags, text):
    import pyarrow as pa

    assert re.search(pattern, text, flags)
    assert secrets.Scanner((secrets.Rule("own", pattern, flags),)).scan(pa.array(["", text, "z"]))[1]


LETTERS = st.sampled_from("abksiABKſñ\u212a-")
PATTERNS = st.recursive(
    st.one_of(st.text(LETTERS, min_size=1, max_size=4).map(re.escape), st.sampled_from(["[a-c]", "[^a]", "[sk]", ".", r"\w", "ñ?"])),
    lambda inner: st.one_of(st.tuples(inner, inner).map("".join), st.tuples(inner, inner).map("(?:{0[0]}|{0[1]})".format), inner.map("(?:{})?".format), inner.map("(?:{}){{1,2}}".format), inner.map("(?i:{})".format), inner.map("(?:{})*".format)),
    max_leaves=8,
)


@settings(max_examples=400, deadline=None)
@given(PATTERNS, st.sampled_from([0, re.IGNORECASE, re.IGNORECASE | re.ASCII]), st.lists(st.text(LETTERS, max_size=12), min_size=1, max_size=20))
def test_candidates_of_any_rule_lose_no_match(pattern, flags, texts):
    import pyarrow as pa

    scanner = secrets.Scanner((secrets.Rule("own", pattern, flags),))
    rows = scanner.candidates(scanner.queries[0], scanner.postings(pa.array(texts)), len(texts)).tolist() if scanner.queries[0] else range(len(texts))
    assert {i for i, t in enumerate(texts) if re.search(pattern, t, flags)} <= set(rows)


def test_redaction_keeps_rows_and_columns(spark, awkward):
    out = secrets.redact(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    case = spark.createDataFrame([(1, "a token=abcdefgh b", 3, "x"), (2, None, None, None)], "doc_id long, text string, n_chars long, found string")
    assert [tuple(r) for r in secrets.redact(case).orderBy("doc_id").collect()] == [(1, "a [SECRET] b", 12, "x"), (2, None, None, None)]


def test_empty_tables(nothing):
    assert pii.report(nothing).collect() == [] and secrets.report(nothing).collect() == [] and secrets.redact(nothing).collect() == []
