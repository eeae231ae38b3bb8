"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrain.llm.bits import bitmap
from rolegrain.llm.components import components
from rolegrain.llm.shared import materialize, stretches, text_batches
from rolegrain.llm.textvec import COMBINE, LOWER, gram_hashes, mix, text_chunks, whole_hash, word_hashes, words_of

#: Buckets of the shingle counts that order prefixes; sent to every task, so fixed.
COUNT_BUCKETS = 1 << 16
MOST_MATCHES = 5
FLUSH_ENTRIES = 400_000
ENTRY = np.dtype([("token", "<u8"), ("node", "<u8"), ("size", "<u4"), ("place", "<u4"), ("matches", "<u4")])
INT = {"a": pa.int64(), "b": pa.int64(), "node": pa.int64()}


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    for lo, hi, data, offsets in text_chunks(column):
        words = words_of(LOWER[data], offsets)
        hashes = word_hashes(words)
        grams = gram_hashes(hashes, k)
        for i in range(hi - lo):
            a, b = int(words.bounds[i]), int(words.bounds[i + 1])
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield np.array([whole_hash(hashes[a:b])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def node_of(shingles: np.ndarray) -> np.uint64:
    """Texts with one set of shingles are one node."""
    return mix(mix(shingles + COMBINE[10]).sum(keepdims=True) + COMBINE[11:12] * np.array([len(shingles)], np.uint64))[0]


def least_overlap(size: np.ndarray | int, other: np.ndarray | int, percent: int):
    """The smallest intersection with which two sets of these sizes link."""
    return -(-percent * (size + other) // (100 + percent))


def surveyed(docs: DataFrame, k: int) -> DataFrame:
    """A row (doc_id, n_shingles, node) per document, and rows (bucket, places) of shingle counts."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("bucket", pa.int32()), ("places", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNT_BUCKETS, np.int64)
        for batch in batches:
            sizes, nodes = [], []
            for s in shingle_sets(batch.column("text"), k):
                sizes.append(len(s))
                nodes.append(int(node_of(s).astype(np.int64)) if len(s) else None)
                counts += np.bincount((s & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64), minlength=COUNT_BUCKETS) if len(s) > 4096 else 0
                if len(s) <= 4096:
                    np.add.at(counts, (s & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64), 1)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], schema=fields)
        at = np.flatnonzero(counts)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(at.astype(np.int32)), pa.array(counts[at])], schema=fields)

    return docs.mapInArrow(rows, "doc_id long, n_shingles long, node long, bucket int, places long")


def matches_wanted(expected: np.ndarray, size: int, base: int, most: int) -> int:
    """How many prefix tokens a partner must share: the number with the least estimated cost. expected[i] is
    the estimated list length of the i-th token. Reading lists costs their length; a list entry is a candidate
    that shares the number with odds of one in that number, and costs a check in proportion to size."""
    scan = np.cumsum(expected)[base - 1 : base - 1 + most]
    cost = scan * (1 + size / 64 / np.arange(1, len(scan) + 1))
    return 1 + int(np.argmin(cost))


def prefix_entries(docs: DataFrame, k: int, percent: int, n_parts: int, counts) -> DataFrame:
    """Packed prefix entries by ranges of tokens (part, entries), and a bitmap of each node (node, size, bits)."""
    fields = pa.schema([("part", pa.int32()), ("entries", pa.binary()), ("node", pa.int64()), ("size", pa.int32()), ("bits", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_by, usual = counts.value
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if held:
                e = np.concatenate(held)
                held.clear()
                size = 0
                part = ((e["token"] >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
                order = np.argsort(part, kind="stable")
                part, e = part[order], e[order]
                cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                to = np.r_[cut[1:], len(part)]
                # field after field, so that alike bytes stand together for the shuffle's compression
                packed = [b"".join(np.ascontiguousarray(e[name][a:b]).tobytes() for name in ENTRY.names) for a, b in zip(cut, to, strict=True)]
                n = len(cut)
                yield pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array(packed, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=fields)

        for batch in batches:
            nodes, sizes, bits = [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n = len(s)
                if not n or (node := int(node_of(s))) in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(node)
                c = order_by[(s & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64)]
                least = -(-percent * n // 100)
                base, most = n - least + 1, min(MOST_MATCHES, least)
                reach = min(n, base - 1 + most)
                if reach < n // 2:
                    near = np.argpartition(c, reach)
                    edge = c[near[:reach]].max()
                    pick = np.flatnonzero(c <= edge)
                else:
                    pick = np.arange(n)
                pick = pick[np.lexsort((s[pick], c[pick]))][:reach]
                wanted = matches_wanted(np.maximum(c[pick] - usual, 0), n, base, most)
                length = base - 1 + wanted
                e = np.empty(length, ENTRY)
                e["token"], e["node"], e["size"], e["place"], e["matches"] = s[pick[:length]], node, n, np.arange(length), wanted
                held.append(e)
                size += length
                slots = 64
                while slots < 4 * n:
                    slots *= 2
                field = np.zeros(slots, bool)
                field[(s >> np.uint64(16)).astype(np.int64) & (slots - 1)] = True
                nodes.append(np.uint64(node).astype(np.int64))
                sizes.append(n)
                bits.append(np.packbits(field, bitorder="little").tobytes())
                if size >= FLUSH_ENTRIES:
                    yield from flush()
            n = len(nodes)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())], schema=fields)
        yield from flush()

    return docs.mapInArrow(rows, "part int, entries binary, node long, size int, bits binary")


def shared_lists(entries: DataFrame) -> DataFrame:
    """The entries of tokens that two nodes or more have in their prefixes, each with its list's pivot: the node
    with the fewest rarer tokens, as the original of a group of edited copies has."""
    fields = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("matches", pa.int32()), ("pivot", pa.int64()), ("pivot_size", pa.int32()), ("pivot_place", pa.int32())])

    def lists(table: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[] for _ in ENTRY.names]
        for packed in table.column("entries").to_pylist():
            n, at = len(packed) // ENTRY.itemsize, 0
            for to, name in zip(columns, ENTRY.names, strict=True):
                to.append(np.frombuffer(packed, ENTRY[name], n, at))
                at += n * ENTRY[name].itemsize
        token, node, size, place, matches = (np.concatenate(c) for c in columns)
        order = np.argsort(token, kind="stable")
        sorted_token = token[order]
        many = np.r_[sorted_token[1:] == sorted_token[:-1], False]
        order = order[many | np.r_[False, many[:-1]]]
        order = order[np.lexsort((node[order], token[order]))]
        twice = np.r_[False, (token[order[1:]] == token[order[:-1]]) & (node[order[1:]] == node[order[:-1]])] if len(order) else np.zeros(0, bool)
        order = order[~twice]
        order = order[np.lexsort((node[order], place[order], token[order]))]
        t = token[order]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(t)])
        pivot = order[np.repeat(first, n)] if len(t) else order
        keep = np.repeat(n > 1, n) if len(t) else np.zeros(0, bool)
        order, pivot = order[keep], pivot[keep]
        out = (token[order].view(np.int64), node[order].view(np.int64), size[order].astype(np.int32), place[order].astype(np.int32), matches[order].astype(np.int32), node[pivot].view(np.int64), size[pivot].astype(np.int32), place[pivot].astype(np.int32))
        return pa.Table.from_arrays([pa.array(x) for x in out], schema=fields)

    return entries.groupBy("part").applyInArrow(lists, "token long, node long, size int, place int, matches int, pivot long, pivot_size int, pivot_place int")


def reach(size: Column, place: Column, other: Column, matches: Column, percent: int) -> Column:
    """Whether the token at place lies in the prefix that a set of this size needs for partners of the other
    size, if so many shared tokens are asked for."""
    least = F.ceil((F.lit(percent) * (size + other)) / F.lit(100 + percent))
    return place <= size - least + matches - 1


def sizes_fit(size: Column, other: Column, percent: int) -> Column:
    return 100 * F.least(size, other) >= percent * F.greatest(size, other)


def enough_shared(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share as many tokens as the less demanding of the two asks for, within the prefixes that
    are as long as this number needs. Tokens in one prefix only are in no list and in none of prefixes."""
    side = lambda x: prefixes.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("size", "matches", "prefix")])
    wanted = F.least("a_matches", "b_matches")
    within = lambda x, y: F.filter(f"{x}_prefix", lambda e: reach(F.col(f"{x}_size"), e["place"], F.col(f"{y}_size"), wanted, percent))["token"]
    shared = F.size(F.array_intersect(within("a", "b"), within("b", "a")))
    return pairs.join(side("b"), "b").join(side("a"), "a").filter(shared >= wanted).select("a", "b")


def size_class(size: Column, percent: int) -> Column:
    """Sets that may link are of one class or of neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / float(np.log(100 / percent) + 1e-9)).cast("int") if percent < 100 else size


def may_link(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) that their nodes' bitmaps don't rule out, with the bound that they give on the overlap:
    what falls on a bit that the other set lacks is not shared."""
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bound", pa.float64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_size, b_size = batch.column("a_size").to_pylist(), batch.column("b_size").to_pylist()
            keep, bounds = [], []
            for i, (n, m, x, y) in enumerate(zip(a_size, b_size, batch.column("a_bits"), batch.column("b_bits"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) != len(y):
                    small = min(len(x), len(y))
                    x, y = (np.bitwise_or.reduce(z.reshape(-1, small), axis=0) for z in (x, y))
                most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
                if 100 * most >= percent * (n + m - most):
                    keep.append(i)
                    bounds.append(most / (n + m - most))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(bounds, pa.float64())], schema=fields)

    side = lambda x: bitmaps.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("bits").alias(f"{x}_bits"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_size", "b_size", "a_bits", "b_bits").mapInArrow(judge, "a long, b long, bound double")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets. A bitmap of the pairs' nodes, 16 MB at most, keeps the
    other documents' sets out of the shuffle."""
    spark = docs.sparkSession
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    wanted = spark.sparkContext.broadcast(bitmap(nodes, "node", nodes.count()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found, out = [], []
            for s in shingle_sets(batch.column("text"), k):
                if len(s):
                    node = node_of(s)
                    if wanted.value.may_have(np.array([node]))[0] and int(node) not in seen:
                        if len(seen) >= 200_000:
                            seen.clear()
                        seen.add(int(node))
                        found.append(node.astype(np.int64))
                        out.append(s.view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *out])))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), lists], ["node", "shingles"])

    found = docs.mapInArrow(sets, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))
    side = lambda x: found.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}_set"))
    shared, sizes = F.size(F.array_intersect("a_set", "b_set")), F.size("a_set") + F.size("b_set")
    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").filter(100 * shared >= percent * (sizes - shared)).select("a", "b")


def linked_groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of distinct word shingles
    (A-Z lower-cased; a shorter text is one shingle, an empty one has none and links with nothing);
    component_id is the smallest doc_id that links reach. Every link between different sets is found or
    lies within one component already.

    Documents with one set are one node. Tokens are ordered by estimated frequency; a node's prefix is as
    long as its wanted number of shared tokens (1 to 5, by estimated candidate cost) needs, and a pair is a
    candidate when it shares the smaller number of its two nodes within the prefixes for it; only then it is
    checked. First each node meets the pivots of its lists, which joins most of a group at once; then all candidates
    from different components are checked. Equal members of a list are therefore never paired with each other.

    Null text is empty. Null doc_ids count only in a component without others, whose id is null. Repeated
    rows share their component. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    survey = materialize(surveyed(rows, shingle), "survey")
    members = survey.filter("bucket is null").select("doc_id", "n_shingles", "node")
    counts = np.zeros(COUNT_BUCKETS, np.int64)
    for r in survey.filter("bucket is not null").groupBy("bucket").agg(F.sum("places").alias("places")).collect():
        counts[r.bucket] = r.places
    usual = float(np.median(counts))
    usual += 4 * usual**0.5
    texts = rows.select("text")
    first_pass = materialize(prefix_entries(texts, shingle, percent, stretches(texts), spark.sparkContext.broadcast((counts, usual))), "prefixes")
    lists = materialize(shared_lists(first_pass.filter("part is not null").select("part", "entries")), "lists")
    in_lists = lists.select("node").distinct()
    bitmaps = materialize(first_pass.filter("node is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("bits").alias("bits")).join(in_lists, "node", "left_semi"), "bitmaps")

    prefixes = materialize(lists.groupBy("node").agg(F.first("size").alias("size"), F.first("matches").alias("matches"), F.collect_list(F.struct("token", "place")).alias("prefix")), "node_prefixes")
    star = lists.filter((F.col("node") != F.col("pivot")) & sizes_fit(F.col("size"), F.col("pivot_size"), percent)).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    best = may_link(enough_shared(star, prefixes, percent), bitmaps, percent).groupBy("b").agg(F.max_by("a", F.struct("bound", "a")).alias("a"))
    links = materialize(verified(materialize(best, "star"), texts, shingle, percent), "star_links")
    labels = components(links)

    known = lists.select("token", "node", "size", "place", "matches").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = materialize(known, "labelled")
    by_label = known.groupBy("token", "label").agg(F.count("*").alias("n"))
    mixed = by_label.groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.count("*").alias("labels")).filter("labels > 1").select("token", "major")
    open_lists = known.join(mixed, "token")
    open_lists = materialize(open_lists, "open_lists")
    few = open_lists.filter("label <> major").select("token", *[F.col(c).alias(f"few_{c}") for c in ("node", "label", "size", "place", "matches")])
    f, o = (lambda c: F.col(f"few_{c}")), (lambda c: F.col(c))
    # a pair that links shares a token in the prefixes for one, whatever number it has to share in longer ones
    meet = (
        (f("label") != o("label")) & ((o("label") == o("major")) | (f("node") < o("node"))) & sizes_fit(f("size"), o("size"), percent)
        & reach(f("size"), f("place"), o("size"), F.lit(1), percent) & reach(o("size"), o("place"), f("size"), F.lit(1), percent)
    )
    # a token's list is joined by classes of sizes, not as a whole
    classes = F.explode(F.array(*[size_class(F.col("few_size"), percent) + i for i in (-1, 0, 1)]))
    few, open_lists = few.withColumn("few_class", classes), open_lists.withColumn("class", size_class(F.col("size"), percent))
    met = few.join(open_lists, (few["token"] == open_lists["token"]) & (F.col("few_class") == F.col("class")) & meet).select(F.least("few_node", "node").alias("a"), F.greatest("few_node", "node").alias("b")).distinct()
    candidates = enough_shared(met, prefixes, percent)
    rest = materialize(may_link(candidates, bitmaps, percent).select("a", "b"), "candidates")
    all_links = links.union(verified(rest, texts, shingle, percent))
    labels = components(all_links)
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "label", "left").select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that links connect to a document with a smaller doc_id. Documents without shingles
    or doc_id stay; rows that repeat a doc_id go or stay together. Null texts are empty and stay. An empty table stays
    empty; columns keep their names, whatever they are."""
    gone = linked_groups(docs, shingle, percent).filter("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    return docs.alias("docs").join(materialize(gone, "gone").alias("gone"), F.col("docs.doc_id").cast("long") == F.col("gone.doc_id"), "left_anti")
