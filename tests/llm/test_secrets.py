"""Secret scans against Python's re."""

import hashlib
import re

from pyspark.sql import functions as F

from rolegrain.llm import secrets

PY = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
LEAST = {"assign": 12, "access": 18, "hex": 16}


def base(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PY.items()) for m in p.finditer(text or "") if len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]]
    return found, ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


OPAQUE = "Zq9xW2mN7bV4cK1pL8tR5y"
TEXTS = [
    "", None, 'x PASSWORD: "abcdefghijkl" tail', "password=token:abcdefghijklmnop", "token=secret=abcdefghijklmnop rest", "😀😀 api_key = AKIAABCDEFGHIJKLMN é 0123456789abcdef",
    "\x01 token='0123456789abcdef0123' \x01\x02 deadbeef deadbeefdeadbeef", "apikey=short then apikey=longenough123", f"own {OPAQUE} here", "AKIAAKIAAKIA" * 3, "no secret here " * 20_000 + "passwd=aaaabbbbcccc",
    "secret = " + "0123456789abcdef" * 5000, "token: 0123456789abcdef " * 300,
]


def test_base_spans_match_re(spark):
    rows = [(i, t, f"s{i}", "en", 1) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "s2", "en", 1), (None, "passwd=aaaabbbbcccc", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, hash int")
    got = secrets.secret_spans(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text, *_ in rows:
        found, line = base(text)
        r = by_id[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[2] == k for f in found) for k in PY), i
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), i
        assert [x for x in r.spans.split(",") if not x.startswith("live:") and x] == [x for x in line.split(",") if x]
    at = TEXTS[8].index(OPAQUE)
    assert by_id[8].spans == f"live:{at}:{at + len(OPAQUE)}"


def test_widely_copied_values_are_not_added(spark):
    rows = [(i, f"copy {OPAQUE} of {i}", f"s{i}", "en") for i in range(5)] + [(9, "mine Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8 only", "s9", "en")]
    got = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert all(got[i].spans == "" and got[i].n_widely_copied == 1 for i in range(5))
    assert got[9].spans == "live:5:29" and got[9].n_owner_specific == 1


def test_redact(spark):
    rows = [(1, "a password=abcdefghijkl z", "s", "en"), (2, "clean text", "s", "en"), (3, None, "s", "en"), (4, "é token = 0123456789abcdef0 end", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert got == {1: "a [secret] z", 2: "clean text", 3: None, 4: "é [secret] end"}
    assert secrets.secret_spans(docs.limit(0)).count() == 0


def test_redact_with_clashing_names_and_odd_rows(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    rows = [(1, f"use {key} now {key}", "a", "en", "x"), (2, None, None, None, None), (3, "", "b", "en", "y"), (1, f"use {key} now {key}", "a", "en", "x"), (None, key, "c", "de", "z"), (4, "plain " * 5000, "a", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, spans string").withColumns({"row": F.lit(7), "done": F.lit(8), "text_hash": F.lit(9)})
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r["spans"] or "", r["row"]) for r in got.collect()) == sorted((i or 0, (t or "").replace(key, "[secret]"), s or "", 7) for i, t, _, _, s in rows)
    assert secrets.redact(docs.limit(0)).count() == 0


def test_a_hundred_thousand_spans_in_a_text(spark):
    """Hex and opaque stretches in turn: twice the text may take about twice the time, and none is lost."""
    one = [f"{hashlib.md5(str(i).encode()).hexdigest()} {OPAQUE}{i:06d}" for i in range(50_000)]
    text = "\n".join(one)
    docs = spark.createDataFrame([(1, text, "a", "en"), (2, "plain", "b", "en")], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in secrets.secret_spans(docs).collect()}
    assert got[1].n_hex == 50_000 and got[1].base_sha256 == hashlib.sha256(base(text)[1].encode()).hexdigest()
    assert got[1].spans.count("live:") == 50_000 and got[2].spans == ""
    lines = {r.doc_id: r.text for r in secrets.redact(docs).collect()}[1].split("\n")
    assert lines == ["[secret] [secret]"] * 50_000


def test_spans_over_blocks(spark):
    text = "é" * 4090 + " token=" + "Ab1-" * 3000 + " 😀 passwd=aaaabbbbcccc" + " x" * 5000
    docs = spark.createDataFrame([(1, text, "a", "en")], "doc_id long, text string, source string, lang string")
    assert secrets.redact(docs).first().text == "é" * 4090 + " [secret] 😀 [secret]" + " x" * 5000
