"""Language ID: held-out accuracy, each kind of evidence, odd rows."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rolegrain.llm import langid

LETTERS = {"de": ["sch", "ein", "ung", "und", "der"], "en": ["the", "ing", "and", "tion", "er"], "es": ["ción", "que", "los", "ado", "mente"], "fr": ["eau", "oux", "les", "ère", "ment"]}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_accuracy_and_wrong_declarations(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        true = rng.choice(list(LETTERS))
        declared = true if i % 4 else rng.choice(["de", "en", None, "xx"])
        rows.append((i, text(rng, true), declared, f"src{i % 3}", true))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, host string")
    got = {r.doc_id: r for r in langid.judged(langid.document_rows(docs), ["doc_id", "page_id"]).collect()}
    assert len(got) == 400 and sum(got[r[0]].language == r[4] for r in rows) >= 392
    assert sum(got[i].accepted for i in got) >= 396


def test_other_evidence_decides_without_text(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, "fr"), "fr", "www.a.test", "test") for i in range(60)] + [(60 + i, text(rng, "en"), "en", "b.test", "test") for i in range(60)]
    rows += [(120 + i, text(rng, "de"), "de", "c.test", "test") for i in range(50)] + [(170 + i, text(rng, "es"), "es", "d.test", "test") for i in range(25)] + [(200, None, None, "www.a.test", "test"), (201, "", None, "new.a.test", "test"), (202, "", None, "x.y.de", "de"), (203, "", "es", None, None), (204, "", None, None, "mx"), (205, "\x00\x01 7 7", None, "", ""), (206, "zqx jvk qqz xkw vjq wzx kqj zzv " * 40, None, "", ""), (200, None, None, "www.a.test", "test")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string")
    got = langid.judged(frame, ["doc_id"]).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].language for i in (200, 201, 202, 203, 204)] == ["fr", "fr", "de", "es", "es"]
    assert not any(by_id[i].accepted for i in range(200, 207)) and by_id[206].language == "und", by_id[206]


def test_pages_and_stage(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = langid.judged(langid.page_rows(pages), ["doc_id", "page_id"]).collect()
    assert len(got) == pages.count() and sum(r.language == r.declared for r in got) >= 0.9 * len(got)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.union(spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", None, None, None), (None, "of the and to in was with that this", "en", "src1", 3)], docs.schema))
    kept = langid.accepted_documents(rows)
    assert kept.columns == docs.columns and 10**6 not in (ids := [r.doc_id for r in kept.collect()]) and None in ids and len(ids) >= 0.99 * docs.count()
    assert langid.judged(langid.document_rows(docs.limit(0)), ["doc_id"]).count() == 0


def brute_posteriors(rows, languages=("de", "en", "es", "fr"), trust=0.9, suffix_trust=0.7, smoothing=20.0):
    """Posteriors by plain loops: rows of (text, declared, host, suffix)."""
    names = [*languages, "und"]

    def grams(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return langid.trigrams(data, np.array([0, len(data)]))[0].tolist()

    def softmax(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    each = [grams(r[0]) for r in rows]
    evidence, shares = [], []
    for i, (_, declared, _, _) in enumerate(rows):
        n, logs = len(each[i]), []
        for x in languages:
            others = Counter(g for j, r in enumerate(rows) if j != i and r[1] == x for g in each[j])
            whole = sum(others.values()) + langid.BUCKETS
            logs.append(sum(math.log((others[g] + 1) / whole) for g in each[i]))
        logs.append(-n * math.log(langid.BUCKETS))
        logs = [x * langid.DEPTH / (n + langid.DEPTH) for x in logs]
        if declared in languages:
            logs = [v + math.log(trust if x == declared else (1 - trust) / len(languages)) for v, x in zip(logs, names, strict=True)]
        evidence.append(logs)
        shares.append(softmax(logs))
    domain = lambda host: ".".join((host or "").lower().split(".")[-2:])
    out = []
    for i, (_, _, host, suffix) in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i]
        rest = lambda keep: [sum(shares[j][k] for j in others if keep(j)) for k in range(len(names))]  # noqa: B023, E731
        prior = [(x + 1) / (len(others) + len(names)) for x in rest(lambda j: True)]
        for level in (domain, lambda h: (h or "").lower()):
            sums = rest(lambda j: level(rows[j][2]) == level(host))  # noqa: B023
            prior = [(a + smoothing * b) / (sum(sums) + smoothing) for a, b in zip(sums, prior, strict=True)]
        spoken = langid.SUFFIXES.get((suffix or "").lower())
        said = [0.0] * len(names) if spoken not in languages else [math.log(suffix_trust if x == spoken else (1 - suffix_trust) / len(languages)) for x in names]
        out.append(softmax([e + math.log(p) + s for e, p, s in zip(evidence[i], prior, said, strict=True)]))
    return names, out


def test_posteriors_by_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        true = rng.choice(list(LETTERS))
        rows.append((text(rng, true, rng.randrange(0, 12)), rng.choice([true, true, "de", None, "xx"]), rng.choice(["a.x.test", "b.x.test", "y.test", "", None, "C.x.Test"]), rng.choice(["de", "test", None, "mx", "UK"])))
    rows += [(None, None, None, None), ("", "fr", "y.test", "fr"), ("ab", "en", "y.test", ""), (rows[0][0], *rows[0][1:]), ("\x00 1 2", None, "a.x.test", None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, declared string, host string, suffix string")
    got = {r.doc_id: r for r in langid.judged(frame, ["doc_id"]).collect()}
    names, want = brute_posteriors(rows)
    for i, chances in enumerate(want):
        best = max(range(len(names)), key=chances.__getitem__)
        assert got[i].language == names[best] and abs(got[i].posterior - chances[best]) < 1e-6, i
        assert got[i].accepted == (names[best] != "und" and chances[best] >= 0.6 and len(langid.trigrams(np.frombuffer((rows[i][0] or "").encode(), np.uint8), np.array([0, len((rows[i][0] or "").encode())]))[0]) > 0)


def test_domains_and_clashing_names(spark):
    rows = [(i, "the and ing tion er " * 5, "en", h) for i, h in enumerate(["a.b.co.uk", "b.co.uk", "x.y.com", "y.com", "", "co.uk"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string").withColumn("suffix", F.lit(""))
    assert langid.judged(frame, ["doc_id"]).count() == len(rows)
    docs = spark.createDataFrame([(None, None, "en", "s", 1), (None, "the and ing tion er " * 5, "en", "s", 2), (3, "", "en", "s", 3), (3, "the and ing tion er " * 5, "en", "s", 4)], "doc_id long, text string, lang string, source string, row_hash long")
    assert sorted(r.row_hash for r in langid.accepted_documents(docs).collect()) == [2, 4]
