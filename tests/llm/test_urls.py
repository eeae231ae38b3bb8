"""The URL filter: rules against Python, the models against held-out URLs."""

import math
import random
import re
import zlib
from collections import Counter

from rolegrain.llm import urls


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        after = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", after)[0]
        path = re.match(r"[^?#]*", after[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text)) if fits else None


def test_rules(spark):
    texts = ["http://a.EXAMPLE.com/en/7x?q#f", "https://example.com/en/", "x://com/en/", "http://notcom/en/", "http://b.example.net/de/81", "http://net/de/", "http://org/es/#/", "http://é.org?/es/", None, "", "no scheme/en/", "a://b://c/d", "http://", "http://com/EN/", "HTTP://X.ORG/es/\nq", "http://net/de/8"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[1], None)]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            host, path, rule = brute(texts[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule.text if rule else None), texts[r.page_id]
            assert r.verdict == (rule.verdict if rule else r.verdict) and r.verdict in ("allow", "block")


def test_models_part_held_out_urls(spark):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    good = [f"http://{word('abcdefg')}.net/de/{word('abcdefg')}" for _ in range(300)]
    bad = [f"http://{word('qrstuvw')}.com/en/{word('qrstuvw')}" for _ in range(300)]
    new = [(1, f"http://{word('abcdefg')}.info/{word('abcdefg')}") for _ in range(60)] + [(0, f"http://{word('qrstuvw')}.info/{word('qrstuvw')}") for _ in range(60)]
    rows = [(None, u) for u in good + bad] + [(i, u) for i, (_, u) in enumerate(new)]
    got = [r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect() if r.page_id is not None]
    assert sum((r.verdict == "allow") == bool(new[r.page_id][0]) for r in got) >= 0.95 * len(new)


def brute_scores(texts, labels):
    """The score of each text from dictionaries of counts, and the calibrated threshold."""
    order, marked = urls.ORDER, lambda t: urls.START + (t or "").encode() + urls.END
    grams = [[Counter() for _ in range(order + 1)] for _ in range(2)]
    for t, label in zip(texts, labels, strict=True):
        if label is not None and zlib.crc32((t or "").encode()) % 5:
            b = marked(t)
            for i in range(order, len(b)):
                for k in range(order + 1):
                    grams[label][k][b[i - k : i + 1]] += 1
    total, kinds = [[Counter() for _ in range(order + 1)] for _ in range(2)], [[Counter() for _ in range(order + 1)] for _ in range(2)]
    for label in range(2):
        for k in range(order + 1):
            for g, n in grams[label][k].items():
                total[label][k][g[:-1]] += n
                kinds[label][k][g[:-1]] += 1

    def log_p(label, g):
        p = 1 / 257
        for k in range(order + 1):
            own, c = g[order - k :], g[order - k : -1]
            if total[label][k][c]:
                p = (grams[label][k][own] + kinds[label][k][c] * p) / (total[label][k][c] + kinds[label][k][c])
        return math.log(p)

    scores = []
    for t in texts:
        b = marked(t)
        each = [log_p(1, b[i - order : i + 1]) - log_p(0, b[i - order : i + 1]) for i in range(order, len(b))]
        scores.append(sum(each) / len(each))
    held = [(min(2000, max(0, math.floor(s * 200 + 1000))), label) for s, t, label in zip(scores, texts, labels, strict=True) if label is not None and zlib.crc32((t or "").encode()) % 5 == 0]
    n = Counter(label for _, label in held)
    if not n[0] or not n[1]:
        return scores, 0.0
    lost = [sum(x < cut for x, label in held if label) / n[1] + sum(x >= cut for x, label in held if not label) / n[0] for cut in range(2002)]
    best = [cut for cut, x in enumerate(lost) if x <= min(lost) + 1e-9]
    return scores, (best[len(best) // 2] - 1000) / 200


def test_scores_and_verdicts_by_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").limit(150)
    rows = [(r.page_id, r.url) for r in pages.collect()]
    rows += [(9001, None), (9002, ""), (9003, "é" * 40), (9004, rows[0][1]), (9005, "http://b.info/" + "x" * 5000)]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    ruled = [brute(u)[2] for _, u in rows]
    scores, threshold = brute_scores([u for _, u in rows], [None if r is None else int(r.verdict == "allow") for r in ruled])
    assert len(got) == len(rows) and any(r is None for r in ruled)
    for (i, u), rule, score in zip(rows, ruled, scores, strict=True):
        assert abs(got[i].score - score) < 1e-6, u
        assert got[i].verdict == (rule.verdict if rule else "allow" if score >= threshold else "block"), u


def test_empty_and_one_label(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    got = urls.judge_urls(spark.createDataFrame([(1, "http://x.org/es/a"), (2, "http://other.info/")], "page_id long, url string")).collect()
    assert {(r.page_id, r.verdict, r.score) for r in got} == {(1, "block", 0.0), (2, "allow", 0.0)}
