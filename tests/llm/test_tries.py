"""Prefix tries against a plain trie of whole turns."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from rolegrain.llm import oracles, queries, tries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c in own:
        own[c] = [(r, t) for *_, r, t in sorted(own[c], key=lambda x: (x[0], x[1], hashlib.sha256(f"{len(x[2])}:{x[2]}{len(x[3])}:{x[3]}".encode()).digest()[:16]))]
    nodes = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append((c, len(turns) == d))
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        saved[path] = sum(saved[x] for x in children[path]) + (len(nodes[path]) - 1) * (len(path[-1][1]) if path else 0)
    sha = lambda path: hashlib.sha256(",".join(str(c) for c, end in sorted(nodes[path]) if end).encode()).hexdigest()
    least = {path: min(nodes[path])[0] for path in nodes}
    return sorted((least[p], len(p), least[p[:-1]] if p else None, len(nodes[p]), len(children[p]), leaves[p], saved[p], sha(p)) for p in nodes)


def result(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


def made(n, seed):
    """Conversations that share turns, end within others, repeat whole, and a few long ones."""
    rnd, rows = random.Random(seed), []
    for c in range(n):
        length = rnd.choice([1, 2, 3, 5, 8, 30 if c % 20 == 0 else 4])
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}.{rnd.choice('aaab')}" if t < 20 else "deep") for t in range(length)]
    return rows


def test_query_matches_brute_force_and_sql(spark):
    got = result(queries.op13_prefix_trie(spark, SF))
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    assert got == brute([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert got == sorted(con.execute(oracles.PREFIX_TRIE).fetchall())


@pytest.mark.parametrize("most", [100_000, 60, 1])
def test_large_subtries_are_split(spark, most):
    rows = made(150, 3)
    assert result(tries.prefix_trie(spark.createDataFrame(rows, SCHEMA), most)) == brute(rows)


def test_one_long_conversation_and_its_copies(spark):
    long = [(c, t, "user", f"turn {t}") for c in (100, 101, 300) for t in range(400)]
    rows = long + [(c, t, "user", f"turn {t}") for c in (205, 206, 207) for t in range(c - 200)] + [(300, 400, "user", "more")]
    assert result(tries.prefix_trie(spark.createDataFrame(rows, SCHEMA), 50)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "", ""), (1, 0, "user", "é😀" * 3), (1, 0, "user", "é😀" * 3), (None, 0, "user", "lost"), (2, 3, "user", "long " * 200_000), (-7, 1, "a", "b"), (-7, 0, "a", None), (9_223_372_036_854_775_800, 5, "user", "x")]
    rows += [(c, 0, "user", "only") for c in range(400, 430)] + [(c, 0, "ab", "c") for c in (431, 433)] + [(c, 0, "a", "bc") for c in (432, 434)]
    table = spark.createDataFrame(rows, SCHEMA)
    extra = table.withColumns({"gid": F.lit("g"), "depth": F.lit(1), "part": F.lit(2), "h": F.lit(3)})
    assert result(tries.prefix_trie(extra)) == brute(rows)
    assert result(tries.prefix_trie(table, 1)) == brute(rows)
    assert result(tries.prefix_trie(table.limit(0))) == []
    assert result(tries.prefix_trie(table.filter("conv_id IS NULL"))) == []
