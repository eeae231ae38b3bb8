"""Substring dedup: suffix automata of reference shards, matching statistics, removal of repeated spans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrain.llm.anchors import anchor_hashes, cells_of
from rolegrain.llm.bits import Bits, bitmap
from rolegrain.llm.shared import blocks, materialize, stretches, text_batches
from rolegrain.llm.textvec import COMBINE, gram_hashes, mix, text_chunks, word_hashes, words_of

GRAM = 8
SHARD_WORDS = 40_000
FLUSH_WORDS = 2_000_000
#: An anchor in more places than this gets a reference group per window instead of one for all its windows.
HOT_PLACES = 20_000
PACKED = pa.schema([("part", pa.int32()), ("block", pa.string()), ("groups", pa.binary()), ("contents", pa.binary()), ("places", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary())])


class SuffixAutomaton:
    """A generalised suffix automaton of word sequences, each with the number of places that it stands for."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def add(self, words: list[int], places: int) -> None:
        nexts, link, length, count = self.next, self.link, self.length, self.places
        last = 0
        for w in words:
            q = nexts[last].get(w)
            if q is not None:
                if length[q] != length[last] + 1:
                    q = self._split(last, w, q)
                last = q
            else:
                cur = len(nexts)
                nexts.append({})
                link.append(0)
                length.append(length[last] + 1)
                count.append(0)
                p = last
                while p >= 0:
                    ahead = nexts[p]
                    q = ahead.get(w)
                    if q is not None:
                        link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
                        break
                    ahead[w] = cur
                    p = link[p]
                last = cur
            count[last] += places

    def _split(self, p: int, w: int, q: int) -> int:
        nexts, link = self.next, self.link
        clone = len(nexts)
        nexts.append(nexts[q].copy())
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.places.append(0)
        link[q] = clone
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = clone
            p = link[p]
        return clone

    def count_places(self) -> None:
        """Each state's number of places, from those of the states that end in it."""
        places, link = self.places, self.link
        for s in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():
            places[link[s]] += places[s]

    def matched(self, words: list[int], least_places: int = 2) -> list[int]:
        """Matching statistics: for each word, the length of the longest run that ends there and occurs in
        least_places places of the reference or more."""
        nexts, link, length, places = self.next, self.link, self.length, self.places
        s = n = 0
        out = []
        for w in words:
            q = nexts[s].get(w)
            while s and (q is None or places[q] < least_places):
                s = link[s]
                n = length[s]
                q = nexts[s].get(w)
            if q is not None and places[q] >= least_places:
                s, n = q, n + 1
            out.append(n)
        return out


def repeated_anchors(texts: DataFrame, width: int) -> DataFrame:
    """(anchor, places) of each anchor at two places or more, counted over all documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text")):
                words = words_of(data, offsets)
                found, n = np.unique(anchor_hashes(word_hashes(words), words.bounds, width, GRAM), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["anchor", "places"])

    return texts.mapInArrow(rows, "anchor long, places long").groupBy("anchor").agg(F.sum("places").alias("places")).filter("places > 1")


def candidate_cells(hashes: np.ndarray, bounds: np.ndarray, width: int, repeated: Bits, hot: Bits) -> tuple[np.ndarray, ...]:
    """(group, content, first, count) of the runs of windows whose anchor may be repeated. The windows of a
    group share an anchor; those of a hot anchor are each in a group of their own content."""
    cells = cells_of(hashes, bounds, width, GRAM)
    keep = repeated.may_have(cells.anchor)
    group, first, count = (x[keep] for x in cells)
    many = hot.may_have(group)
    if many.any():
        n = np.where(many, count, 1)
        row = np.repeat(np.arange(len(group)), n)
        first = first[row] + np.where(many[row], np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), 0)
        group, count = group[row], np.where(many[row], 1, count[row])
        many = many[row]
    windows = gram_hashes(hashes, width)
    content = mix(windows[first] * COMBINE[6] + windows[first + count - 1] * COMBINE[7] + group + count.astype(np.uint64) * COMBINE[8]) if len(first) else group
    if many.any():
        group = np.where(many, content, group)
    return group, content, first, count


def packed_cells(rows_of: DataFrame, width: int, n_parts: int, repeated, hot) -> DataFrame:
    """Rows of PACKED: the different candidate cells of a stretch of a block, by the part of their group, with
    their number of places and their words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        block, size = None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if held:
                group, content, count, lengths, words = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                size = 0
                content, at, places = np.unique(content, return_index=True, return_counts=True)
                part = ((group[at] >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
                order = np.argsort(part, kind="stable")
                part, content, places, at = part[order], content[order], places[order], at[order]
                starts = np.cumsum(lengths) - lengths
                cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                out: list[list] = [[], [], [], [], [], [], []]
                for a, b in zip(cut, np.r_[cut[1:], len(part)], strict=True):
                    own = at[a:b]
                    n = lengths[own]
                    index = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    for to, x in zip(out, (int(part[a]), block, group[own].tobytes(), content[a:b].tobytes(), places[a:b].astype(np.int64).tobytes(), count[own].astype(np.uint8).tobytes(), words[index].tobytes()), strict=True):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, PACKED.types, strict=True)], schema=PACKED)

        for batch in batches:
            names = batch.column("block").to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if names[a] != block:
                    yield from flush()
                    block = names[a]
                for _, _, data, offsets in text_chunks(batch.column("text").slice(a, b - a)):
                    words = words_of(data, offsets)
                    hashes = word_hashes(words)
                    if size + len(hashes) > FLUSH_WORDS:
                        yield from flush()
                    group, content, first, count = candidate_cells(hashes, words.bounds, width, repeated.value, hot.value)
                    if len(group):
                        n = count + (width - 1)
                        index = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        held.append((group, content, count, n, hashes[index]))
                        size += len(index)
        yield from flush()

    return rows_of.mapInArrow(rows, "part int, block string, groups binary, contents binary, places binary, sizes binary, words binary")


def judged_cells(packed: DataFrame, width: int) -> DataFrame:
    """(block, contents, masks): bit k of a cell's mask says that its window k is in two places or more.

    A part of the groups is cut into reference shards of about SHARD_WORDS; each shard becomes a suffix
    automaton and its passages are streamed through it. Equal windows share a group, so a shard sees all
    places of its windows."""

    def judge(table: pa.Table) -> pa.Table:
        read = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
        each = read("contents", np.uint64)
        group, content, places, count = np.concatenate(read("groups", np.uint64)), np.concatenate(each), np.concatenate(read("places", np.int64)), np.concatenate(read("sizes", np.uint8)).astype(np.int64)
        words = np.concatenate(read("words", np.uint64))
        starts = np.cumsum(count + (width - 1)) - (count + (width - 1))
        content, at, back = np.unique(content, return_index=True, return_inverse=True)
        total = np.bincount(back, places, len(content)).astype(np.int64)
        masks = np.zeros(len(content), np.uint64)
        order = np.argsort(group[at], kind="stable")
        groups = group[at][order]
        n_words = count[at][order] + width - 1
        last = np.flatnonzero(np.r_[groups[1:] != groups[:-1], True])
        shard_of = np.repeat(np.cumsum(n_words)[last] // SHARD_WORDS, np.diff(np.r_[-1, last]))
        edges = np.flatnonzero(np.r_[True, shard_of[1:] != shard_of[:-1]])
        for a, b in zip(edges, np.r_[edges[1:], len(order)], strict=True):
            own = order[a:b].tolist()
            passages = [words[starts[at[i]] : starts[at[i]] + count[at[i]] + width - 1].tolist() for i in own]
            automaton = SuffixAutomaton()
            for i, passage in zip(own, passages, strict=True):
                automaton.add(passage, int(total[i]))
            automaton.count_places()
            for i, passage in zip(own, passages, strict=True):
                masks[i] = sum(1 << k for k, n in enumerate(automaton.matched(passage)[width - 1 :]) if n >= width)
        found = masks[back]
        ends = np.cumsum([len(x) for x in each])
        return pa.Table.from_arrays([table.column("block"), table.column("contents"), pa.array([found[e - len(x) : e].tobytes() for x, e in zip(each, ends, strict=True)], pa.binary())], ["block", "contents", "masks"])

    return packed.groupBy("part").applyInArrow(judge, "block string, contents binary, masks binary")


def removed_words(n_words: int, first: np.ndarray, masks: np.ndarray, width: int) -> np.ndarray:
    """Which words a repeated window covers."""
    edge = np.zeros(n_words + 1, np.int64)
    for k in range(32):
        at = first[(masks >> np.uint64(k)) & np.uint64(1) == 1] + k
        np.add.at(edge, at, 1)
        np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, min_words: int = 35, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    A window is min_words consecutive words of one text. Each word goes that a window covers whose words
    also begin anywhere else, in the same text or another; all places go, the first too.

    Documents stay in blocks (stretches of input files). Only windows whose anchor (their smallest 8-word
    hash) is in two places are candidates; a bitmap of those anchors, 16 MB at most, is broadcast. Candidate
    passages are cut at their anchors and dealt by them to reference shards, equal ones of a block once;
    each shard's suffix automaton lives in the task that streams the shard's passages, as the reference,
    which grows with the corpus, has no bound for a broadcast. What matching finds goes back to the blocks.
    An anchor in very many places is dealt by window, so no shard gathers its contexts.

    Null text is empty: no words. Repeated rows are places of each other. An empty table gives no rows.
    Columns other than doc_id and text are ignored. Min_words is 16 or more.
    """
    if min_words < 2 * GRAM:
        raise ValueError(f"min_words must be {2 * GRAM} or more")
    spark = docs.sparkSession
    text_batches(spark)
    docs, block = blocks(docs.select("doc_id", "text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), block.alias("block"))
    anchors = materialize(repeated_anchors(rows.select("text"), min_words), "anchors")
    repeated = spark.sparkContext.broadcast(bitmap(anchors, "anchor", anchors.count()))
    many = anchors.filter(F.col("places") > HOT_PLACES)
    hot = spark.sparkContext.broadcast(bitmap(many, "anchor", many.count()))
    judged = judged_cells(packed_cells(rows.select("text", "block"), min_words, stretches(rows), repeated, hot), min_words)
    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text)

    def keep(texts: pa.Table, masks: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return fields.empty_table()
        known = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in masks.column("contents").to_pylist())])
        found = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in masks.column("masks").to_pylist())])
        known, at = np.unique(known, return_index=True)
        found = found[at]
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for _, _, data, offsets in text_chunks(texts.column("text")):
            words = words_of(data, offsets)
            hashes = word_hashes(words)
            _, content, first, _ = candidate_cells(hashes, words.bounds, min_words, repeated.value, hot.value)
            gone = removed_words(len(hashes), first, found[np.searchsorted(known, content)] if len(content) else content, min_words)
            stay = np.flatnonzero(~gone)
            kept_bounds = np.searchsorted(stay, words.bounds)
            size = words.ends[stay] - words.starts[stay] + 1
            ends = np.cumsum(size)
            source = np.repeat(words.starts[stay] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
            out = np.append(data, np.uint8(32))[source]
            out[ends - 1] = 32
            byte_bounds = np.r_[0, ends][kept_bounds]
            for a, b in zip(byte_bounds[:-1].tolist(), byte_bounds[1:].tolist(), strict=True):
                text = out[a : max(a, b - 1)].tobytes()
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept_texts.append(text.decode())
            n = np.diff(words.bounds)
            n_words.append(n)
            n_removed.append(n - np.diff(kept_bounds))
        return pa.Table.from_arrays([texts.column("doc_id"), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_removed)), pa.array(digests)] + [pa.array(kept_texts, pa.string())] * with_text, schema=fields)

    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(keep, out)
