"""Personal data: base spans against Python's re, the graph against a plain version in whole numbers."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rolegrain.llm import personal, queries

SF = "/root/testdata/sf0.001"
KINDS = ("email", "ip", "card", "phone")
PY = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PY[kind], text or "") if passes(kind, m[0])]


def line(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def value(found):
    dotted = found.count(".") >= 3 and re.fullmatch(r"[0-9.]+", found)
    return found.lower() if "@" in found or dotted else re.sub("[^0-9]", "", found)


def brute(texts, support=3, prior=1, promoted=500_000, rounds=5):
    """Spans of each text, from mentions, patterns and scores held in dictionaries."""
    mentions, places = [], Counter()
    for i, text in enumerate(texts):
        text = text or ""
        words = [(m.start(), re.sub("[A-Z]", lambda c: c[0].lower(), m[0])) for m in re.finditer(r"""[^ \t\n\v\f\r:=("'<>\[\]{},;|]+""", text)]
        for j in range(len(words)):
            for g in (1, 2, 3):
                if g <= j:
                    places[tuple(w for _, w in words[j - g : j])] += 1
        spans = base(text)
        others = [({0}, m.start(), m.start() + len(m[0].rstrip(".!?)"))) for m in re.finditer(r"""[^ \t\n\v\f\r:=("'<>\[\]{},;|]*@[^ \t\n\v\f\r:=("'<>\[\]{},;|]*""", text) if re.fullmatch("[^@]+@[^@]+", m[0].rstrip(".!?)"))]
        for m in re.finditer(r"[0-9](?:[ ()./-]{0,2}[0-9])*", text):
            digits, glue = re.sub("[^0-9]", "", m[0]), r"[A-Za-z0-9_@%&#$]|[^\x00-\x7f]"
            if len(digits) >= 6 and not re.fullmatch(glue, text[m.start() - 1 : m.start()]) and not re.fullmatch(glue, text[m.end() : m.end() + 1]):
                dotted = m[0].count(".") >= 3 and re.fullmatch("[0-9.]+", m[0])
                others.append(({1} if dotted else {3} | ({2} if len(digits) >= 12 else set()), m.start() - (text[m.start() - 1 : m.start()] == "+"), m.end()))
        others = [x for x in others if not any(a < x[2] and x[1] < b for _, a, b in spans)]
        for seed, may, a, b in [(k, {k}, a, b) for k, a, b in spans] + [(None, *x) for x in others]:
            at = next((j for j, (start, _) in enumerate(words) if start == a), None)
            contexts = [tuple(w for _, w in words[at - g : at]) for g in (1, 2, 3) if g <= at] if at is not None else []
            mentions.append((i, seed, may, a, b, value(text[a:b]), contexts))
    seeds, may, count, pairs = defaultdict(set), defaultdict(set), Counter(), Counter()
    for _, seed, m, _, _, v, contexts in mentions:
        seeds[v] |= {seed} - {None}
        may[v] |= m
        count[v] += 1
        pairs.update((p, v) for p in contexts)
    after = defaultdict(list)
    for (p, v), n in pairs.items():
        after[p].append((v, n))
    after = {p: x for p, x in after.items() if len(x) >= support}
    score = {v: [1_000_000 * (k in seeds[v]) for k in range(4)] for v in count}
    for _ in range(rounds):
        best = {v: [0] * 4 for v in count}
        for p, x in after.items():
            weight = max(places[p], sum(n for _, n in x)) + prior
            for k in range(4):
                if sum(score[v][k] >= promoted for v, _ in x) >= support:
                    confidence = sum(n * score[v][k] for v, n in x) // weight
                    for v, n in x:
                        best[v][k] = max(best[v][k], confidence * min(2 * n, count[v]) // count[v])
        score = {v: [1_000_000 if k in seeds[v] else best[v][k] if k in may[v] else 0 for k in range(4)] for v in count}
    out = [base(t) for t in texts]
    for i, seed, _, a, b, v, _ in mentions:
        if seed is None and max(score[v]) >= promoted:
            out[i].append((score[v].index(max(score[v])), a, b))
    return [sorted(x) for x in out]


def held(rows, texts, spans):
    assert len(rows) == len(texts)
    for r, text, wanted in zip(rows, texts, spans):
        own = base(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in own) for k in range(4)], text
        assert r.base_sha256 == hashlib.sha256(line(own).encode()).hexdigest(), text
        assert r.spans == line(wanted), text


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = queries.op12_personal_data(spark, SF).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs] and sum(r.n_card + r.n_email for r in rows) > 0
    held(rows, [d.text for d in docs], brute([d.text for d in docs]))


def test_contexts_find_other_forms_in_rounds(spark):
    calls = [f"please call me on +1 (555) 010-{i:04d} today" for i in range(6)]
    texts = [*calls, "Please call me on 555 019 8877 or later", "my desk line is 555-019-8877, ok", "my desk line is 555-123-4567, ok", "my desk line is 555-765-4321", "my desk line is 555-111-2222", "order 20240131 of lot 555123 and 777888", "we call me on nothing", "write: joe@localhost"]
    texts += [*[f"write: joe{i}@mail.example.com" for i in range(4)], "the number 123456789 is not private", "the rest of 987654321 neither"]
    spans = brute(texts)
    rows = personal.private_spans(table(spark, texts)).orderBy("doc_id").collect()
    held(rows, texts, spans)
    assert rows[6].spans == "phone:18:30" and rows[6].n_added == 1 and rows[13].spans == "email:7:20"
    assert all(rows[i].n_added == 0 for i in (11, 12, 18, 19))


def test_what_is_found_makes_other_contexts_known(spark):
    texts = [f"please call me on +1 (555) 010-{i:04d} today" for i in range(30)]
    texts += [f"Please call me on 555 019 88{i:02d} or later" for i in range(10)] + [f"my desk line is 555-019-88{i:02d}, ok" for i in range(10)] + ["my desk line is 555 777 1234"]
    docs = table(spark, texts)
    for rounds, found in ((1, []), (3, [(3, 16, 28)])):
        rows = personal.identified(docs, rounds=rounds).orderBy("doc_id").collect()
        assert [[tuple(s) for s in r.spans] for r in rows] == brute(texts, rounds=rounds)
        assert [tuple(s) for s in rows[-1].spans] == found


def test_random_texts(spark):
    rnd = random.Random(4)
    bits = ["a@b.co", "@", "_x@y.zz", ".", "1.2.3.4", "256.1.1.1", "+49 30 1234567", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "call", "me", " ", " ", ":", "12", "3456789", "(", ")", "+", "-", "😀", "\n", "x@y", "00000000001.2.3.4", "mail"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(400)] + ["call me " + rnd.choice(bits) for _ in range(200)]
    held(personal.private_spans(table(spark, texts)).orderBy("doc_id").collect(), texts, brute(texts))


def test_odd_rows(spark):
    texts = [None, "", "1" * 500_000, "a" * 500_000 + "@", "@" * 300_000, "+1" + "(" * 300_000, "1.1" * 100_000, "joe@x.org " * 20_000, "1 " * 200_000, "..@" * 100_000 + "a.b"]
    rows = personal.private_spans(table(spark, texts)).orderBy("doc_id").collect()
    for r, text in zip(rows, texts):
        if text is None or len(text) < 10 or "joe" in text or text.startswith("1 "):
            assert r.base_sha256 == hashlib.sha256(line(base(text)).encode()).hexdigest()
    assert rows[7].n_email == 20_000 and rows[3].n_email == 0
    odd = spark.createDataFrame([(None, "joe@x.org", 1), (5, "joe@x.org", 2), (5, "joe@x.org", 2)], "doc_id long, text string, row int").withColumns({"found": F.lit(1), "base": F.lit("b"), "value": F.lit(0)})
    assert sorted((r.doc_id or 0, r.spans) for r in personal.private_spans(odd).collect()) == [(0, "email:0:9"), (5, "email:0:9"), (5, "email:0:9")]
    assert personal.private_spans(odd.limit(0)).count() == 0
