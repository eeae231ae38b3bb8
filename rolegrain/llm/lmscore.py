"""Language-model scoring from a log-frequency Bloom filter of quantised bigram counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrain.llm.packed import added_up, pack_counts, pack_keys, part_of, unpack_counts, unpack_keys
from rolegrain.llm.shared import blocks, broadcast_bytes, materialize, stretches, text_batches
from rolegrain.llm.textvec import COMBINE, LOWER, mix, text_chunks, word_hashes, words_of

END = np.uint64(0x5E4D0FE4D5E4D0FE)
KEY_BITS = np.uint64((1 << 48) - 1)
FLUSH_ENTRIES = 1_500_000
PACKED = "part int, block string, keys binary, counts binary"
PACKED_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.string()), ("keys", pa.binary()), ("counts", pa.binary())])


class Filter(NamedTuple):
    """The Bloom filters of all parts, end to end: part r has sizes[r] bits from byte starts[r] on."""

    bits: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    levels: int
    hashes: int
    base: float


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with one END a row, the token before each, first token of each row and their number)."""
    words = words_of(LOWER[data], offsets)
    tokens = np.insert(word_hashes(words), words.bounds[1:], END)
    bounds = words.bounds + np.arange(len(words.bounds))
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = END
    return tokens, before, bounds


def bigram_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * COMBINE[2] + tokens * COMBINE[3]) & KEY_BITS


def counted(docs: DataFrame, n_parts: int, order: int) -> DataFrame:
    """Rows of PACKED: what a stretch of a block of documents has of each part's tokens (order 1, with
    count 0 for those of held-out documents alone), training bigrams (order 2) or all bigrams (order 3)."""
    bits = 64 if order == 1 else 48

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held, block = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not keys:
                return
            k, c = added_up(np.concatenate(keys), np.concatenate(counts))
            keys.clear()
            counts.clear()
            held = 0
            if not len(k):
                return
            part = part_of(k, n_parts, bits)
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            to = np.r_[at[1:], len(k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[at].astype(np.int32)), pa.array([block] * len(at), pa.string()), pa.array([pack_keys(k[a:b]) for a, b in zip(at, to, strict=True)], pa.binary()), pa.array([pack_counts(c[a:b]) for a, b in zip(at, to, strict=True)], pa.binary())],
                schema=PACKED_SCHEMA,
            )

        for batch in batches:
            names, train = batch.column("block"), ~batch.column("held_out").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                here = [names[lo].as_py()]
                cuts = [lo, hi]
                if order != 2 and names[hi - 1].as_py() != here[0] or block not in (None, here[0]):
                    labels = np.array(names.slice(lo, hi - lo).to_pylist())
                    cuts = [lo, *(lo + 1 + np.flatnonzero(labels[1:] != labels[:-1])), hi]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if block is not None and names[int(a)].as_py() != block and order != 2:
                        yield from flush()
                    block = names[int(a)].as_py()
                    part_offsets = offsets[a - lo : b - lo + 1]
                    tokens, before, bounds = tokens_of(data[part_offsets[0] : part_offsets[-1]], part_offsets - part_offsets[0])
                    learn = np.repeat(train[a:b], np.diff(bounds))
                    if order != 2:
                        k, c = added_up(tokens if order == 1 else bigram_keys(before, tokens), learn.astype(np.int64))
                    else:
                        k, c = added_up(bigram_keys(before, tokens)[learn], np.ones(int(learn.sum()), np.int64))
                    keys.append(k)
                    counts.append(c)
                    held += len(k)
                    if held >= FLUSH_ENTRIES:
                        yield from flush()
        yield from flush()

    return docs.mapInArrow(rows, PACKED)


def corpus_counts(packed: DataFrame) -> DataFrame:
    """For each row of counted(order=1), its tokens' counts in all training documents; with block null, a
    part's number of training tokens and of different ones, in counts."""

    def total(table: pa.Table) -> pa.Table:
        each = [unpack_keys(x) for x in table.column("keys").to_pylist()]
        keys, counts = added_up(np.concatenate(each), np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()]))
        part = table.column("part").combine_chunks()
        found = [pack_counts(counts[np.searchsorted(keys, k)]) for k in each]
        own = np.array([counts.sum(), (counts > 0).sum()], np.int64)
        return pa.Table.from_arrays(
            [pa.concat_arrays([part, part[:1]]), pa.array([*table.column("block").to_pylist(), None], pa.string()), pa.array([*table.column("keys").to_pylist(), b""], pa.binary()), pa.array([*found, own.tobytes()], pa.binary())],
            schema=PACKED_SCHEMA,
        )

    return packed.groupBy("part").applyInArrow(total, PACKED)


def level_of(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)


def level_counts(levels: int, base: float) -> np.ndarray:
    """The count that a level stands for: the mean of the integers that it covers, or its lower end."""
    out = np.zeros(levels + 1)
    for j in range(1, levels + 1):
        lo, hi = np.ceil(base ** (j - 1) - 1e-9), np.ceil(base**j - 1e-9) - 1
        out[j] = (lo + hi) / 2 if hi >= lo else base ** (j - 1)
    return out


def slots(keys: np.ndarray, level: np.ndarray | int, size: np.ndarray | int, hashes: int) -> Iterator[np.ndarray]:
    """The bits of (key, level) in its part's filter, one hash function after another."""
    x = mix(keys * COMBINE[4] + np.asarray(level, np.uint64) * COMBINE[5])
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    for i in range(hashes):
        yield (a + np.uint64(i) * b) % np.asarray(size, np.uint64)


def filter_parts(packed: DataFrame, bits_per_entry: int, hashes: int, base: float) -> DataFrame:
    """(part, bits, levels): each part of the bigrams becomes a Bloom filter in its own task, of bits_per_entry for
    each (bigram, level) counted in it."""

    def one(table: pa.Table) -> pa.Table:
        keys, counts = added_up(np.concatenate([unpack_keys(x) for x in table.column("keys").to_pylist()]), np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()]))
        levels = level_of(counts, base)
        size = max(64, bits_per_entry * int(levels.sum()))
        size -= size % 8
        field = np.zeros(size, bool)
        for level in range(1, int(levels.max()) + 1):
            for at in slots(keys[levels >= level], level, size, hashes):
                field[at] = True
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary()), "levels": pa.array([int(levels.max())], pa.int32())})

    return packed.groupBy("part").applyInArrow(one, "part int, bits binary, levels int")


def gathered(filters: DataFrame, n_parts: int, hashes: int, base: float) -> Filter:
    """All parts of the filter on the driver."""
    found = {r.part: r for r in filters.collect()}
    each = [np.frombuffer(found[r].bits, np.uint8) if r in found else np.zeros(8, np.uint8) for r in range(n_parts)]
    sizes = np.array([len(x) for x in each], np.int64)
    return Filter(np.concatenate(each), np.cumsum(sizes) - sizes, 8 * sizes, max([0, *(r.levels for r in found.values())]), hashes, base)


def answered(packed: DataFrame, filters: DataFrame, levels: int, hashes: int, base: float) -> DataFrame:
    """The rows of counted(order=3) with the quantised counts of their bigrams, probed where their part's filter is."""

    def one(probes: pa.Table, part: pa.Table) -> pa.Table:
        if not probes.num_rows:
            return PACKED_SCHEMA.empty_table()
        bits = np.frombuffer(part.column("bits")[0].as_py(), np.uint8) if part.num_rows else np.zeros(8, np.uint8)
        lm = Filter(bits, np.zeros(1, np.int64), np.array([8 * len(bits)]), levels, hashes, base)
        found = [pack_counts(probed_levels(lm, unpack_keys(x))) for x in probes.column("keys").to_pylist()]
        return pa.Table.from_arrays([*[probes.column(c) for c in ("part", "block", "keys")], pa.array(found, pa.binary())], schema=PACKED_SCHEMA)

    return packed.groupBy("part").cogroup(filters.groupBy("part")).applyInArrow(one, PACKED)


def probed_levels(model: Filter, keys: np.ndarray) -> np.ndarray:
    """The quantised count of each key: levels are probed from 1 on until one is absent."""
    part = part_of(keys, len(model.sizes), 48).astype(np.int64)
    sizes, starts = model.sizes[part], model.starts[part]
    out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for level in range(1, model.levels + 1):
        for i in range(model.hashes):
            x = mix(keys[left] * COMBINE[4] + np.array([level], np.uint64) * COMBINE[5])
            at = (((x & np.uint64(0xFFFFFFFF)) + np.uint64(i) * ((x >> np.uint64(32)) | np.uint64(1))) % sizes[left].astype(np.uint64)).astype(np.int64)
            left = left[(model.bits[starts[left] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1]
        if not len(left):
            break
        out[left] = level
    return out


def score(docs: DataFrame, weight: float = 0.4, base: float = 1.5, bits_per_entry: int = 8, hashes: int = 3, max_filter_bytes: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose crc32(doc_id as text) mod 7 is not 2. Bigram counts are summed over the
    cluster by ranges of their hashes, quantised as 1 + floor(log_base(count)) and put into a log-frequency
    Bloom filter of bits_per_entry for each level. That filter is broadcast if it has max_filter_bytes at most (where
    None is given, what the session lets a broadcast have); a larger one stays in parts, and the bigrams of each block of documents go to their part by a shuffle. Each
    block (a stretch of an input file) gets the exact counts of the tokens that occur in it by
    a shuffle, as the whole vocabulary has no bound. A token's probability after h is
    (1 - weight) * (c + 1) / (N + V + 1) + weight * q / c(h), where q is the count that probing gives, c(h)
    at most, and a document begins after an end token; after an unseen h it is the first part alone, whole.

    Null text is empty: its only token is the end. A null doc_id counts as empty text in the crc32. Repeated
    rows are learned from and scored as often as they come. Without training tokens c, N and V are 0. An
    empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs, block = blocks(docs.select("doc_id", "text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (crc % 7 == 2).alias("held_out"), block.alias("block"))
    n_parts = stretches(rows)
    known = materialize(corpus_counts(counted(rows, n_parts, 1)), "token_counts")
    totals = [np.frombuffer(r.counts, np.int64) for r in known.filter("block is null").select("counts").toLocalIterator()]
    n_train, n_words = (int(sum(t[i] for t in totals)) for i in (0, 1))
    filters = materialize(filter_parts(counted(rows, n_parts, 2), bits_per_entry, hashes, base), "filter_parts")
    n_bytes, levels = filters.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0)), F.coalesce(F.max("levels"), F.lit(0))).first()
    most = broadcast_bytes(spark) if max_filter_bytes is None else max_filter_bytes
    model = spark.sparkContext.broadcast(gathered(filters, n_parts, hashes, base)) if n_bytes <= most else None
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    fields = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def judge(texts: pa.Table, counts: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return fields.empty_table()
        stands_for = level_counts(levels, base)
        if model is None:
            of_pairs = pc.equal(counts.column("order"), 3)
            pairs = counts.filter(of_pairs)
            counts = counts.filter(pc.invert(of_pairs))
            pair_keys = np.concatenate([unpack_keys(x) for x in pairs.column("keys").to_pylist()])
            pair_levels = np.concatenate([unpack_counts(x) for x in pairs.column("counts").to_pylist()])
            pair_keys, at = np.unique(pair_keys, return_index=True)
            pair_levels = pair_levels[at]
        keys = np.concatenate([unpack_keys(x) for x in counts.column("keys").to_pylist()])
        found = np.concatenate([unpack_counts(x) for x in counts.column("counts").to_pylist()])
        keys, at = np.unique(keys, return_index=True)
        found = found[at]
        sums: list[tuple] = []
        for _, _, data, offsets in text_chunks(texts.column("text")):
            tokens, before, bounds = tokens_of(data, offsets)
            c = found[np.searchsorted(keys, tokens)]
            at_end = found[np.searchsorted(keys, END)]
            c_before = np.r_[at_end, c[:-1]]
            c_before[bounds[:-1]] = at_end
            alone = (c + 1) / (n_train + n_words + 1)
            pair = bigram_keys(before, tokens)
            level = pair_levels[np.searchsorted(pair_keys, pair)] if model is None else probed_levels(model.value, pair)
            q = np.minimum(stands_for[level], np.minimum(c, c_before))
            p = np.where(c_before > 0, (1 - weight) * alone + weight * q / np.maximum(c_before, 1), alone)
            first = bounds[:-1]
            sums.append((np.diff(bounds), np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(np.log10(alone), first), np.add.reduceat(np.log10(p), first)))
        n, n_known, base_score, full = (np.concatenate(x) for x in zip(*sums, strict=True))
        return pa.Table.from_arrays([texts.column("doc_id"), texts.column("held_out"), pa.array(n), pa.array(n_known), pa.array(np.full(len(n), n_train)), pa.array(base_score), pa.array(full)], schema=fields)

    tokens = known.filter("block is not null").select("block", "keys", "counts", F.lit(1).alias("order"))
    if model is None:
        tokens = tokens.union(answered(counted(rows, n_parts, 3), filters, levels, hashes, base).select("block", "keys", "counts", F.lit(3)))
    return rows.groupBy("block").cogroup(tokens.groupBy("block")).applyInArrow(judge, out)
