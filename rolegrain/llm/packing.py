"""Best-fit packing of tokenized documents into fixed-length sequences (best-two-fit)."""

from __future__ import annotations

import json
import math
import os
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrain.llm.shared import materialize, text_batches

GROUP_PIECES = 32_768
CACHE_WORDS = 400_000
#: Characters of a stretch whose ids are kept at most, characters of texts that are encoded at once, and a mark that the
#: tokenizer has one id for.
LONGEST, TEXT_CHARS, BETWEEN = 64, 1 << 22, "|"
_encoders: dict[str, "Encoder"] = {}
# The normaliser and pre-tokenizer of a file whose texts may be taken stretch by stretch.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


class Encoder(dict):
    """Token ids of one space-separated stretch of text, as little-endian bytes. A tokenizer with the normaliser and
    the pre-tokenizer above drops white space before it merges, so a text's ids are those of its stretches, joined;
    any other gets whole texts. Bounded: when full, it keeps its entries for one more turn, and those that are
    asked for again."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the work to tasks of one thread
        from tokenizers import Tokenizer

        super().__init__()
        self.before: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(Path(path).read_text())
        split = rules.get("pre_tokenizer") or {}
        self.marks = {m: self.whole(m) for m in ",."}
        self.between = int(np.frombuffer(self.whole(BETWEEN), "<u4")[0])
        special = [t["content"] for t in rules.get("added_tokens", []) if t["content"]]
        self.by_stretch = rules.get("normalizer") == NORMALIZER and split.get("type") == "Sequence" and split["pretokenizers"][0] == SPLIT and len(self.whole(BETWEEN)) == 4 and all(t.startswith("<|") and not set(t) & set(" \n") for t in special)

    def __missing__(self, stretch: str) -> bytes:
        if (known := self.before.pop(stretch, None)) is None:
            return self.whole(stretch)
        self[stretch] = known
        return known

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def learn(self, stretches: set[str]) -> None:
        """Take in the ids of stretches that aren't there yet. Those that differ in case or by a mark at the end share
        their letters' ids; letters are encoded many at once, with a mark between them that none of them has."""
        if len(self) >= CACHE_WORDS:
            self.before = dict(self)
            self.clear()
        new = [s for s in stretches if s not in self and s not in self.before and len(s) <= LONGEST]
        letters = {}
        for s in new:
            word = s.lower() if s.isascii() and "<|" not in s else s  # the tokenizer lower-cases
            if word[-1:] in (",", ".") and word[-2:-1].isascii() and word[-2:-1].isalpha():  # it parts letters from what follows them
                word = word[:-1]
            letters[s] = word
        wanted = [w for w in set(letters.values()) if w not in self and w not in self.before]
        together = [w for w in wanted if w and BETWEEN not in w and "<|" not in w]
        for lo in range(0, len(together), 1000):
            own = together[lo : lo + 1000]
            ids = np.frombuffer(self.whole(f" {BETWEEN} ".join(own)), "<u4")
            cuts = np.flatnonzero(ids == self.between)
            if len(cuts) != len(own) - 1:
                continue
            for w, x, y in zip(own, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                self[w] = ids[x:y].tobytes()
        for w in wanted:
            if w not in self:
                self[w] = self.whole(w)
        for s, w in letters.items():
            if s not in self:
                self[s] = self[w] + (self.marks[s[-1]] if len(w) < len(s) and s[-1:] in self.marks else b"")

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_stretch:
            return [self.whole(t) for t in texts]
        each = [t.replace("\n", " ").split(" ") for t in texts]
        self.learn(set().union(*each))
        return [b"".join(map(self.__getitem__, x)) for x in each]

    def ids(self, text: str | None) -> bytes:
        return self.texts([text or ""])[0]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def piece_frame(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row of docs. A document is its ids,
    then end_id; only one longer than capacity is cut."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity
    fields = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            texts, held, size = [x.as_py() or "" for x in batch.column(1)], 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= TEXT_CHARS or i + 1 == len(texts):
                    for doc_id, ids in zip(batch.column(0).slice(held, i + 1 - held).to_pylist(), encode.texts(texts[held : i + 1]), strict=True):
                        ids += end
                        rows += [(doc_id, k, at // 4, len(part := ids[at : at + step]) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), step))]
                    held, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.types, strict=True)] if rows else [pa.array([], t) for t in fields.types], schema=fields)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. A bin takes the longest piece left, then the longest that fits, again
    and again. Then its smallest piece gives way to the two unpacked pieces that fit the widened gap most
    tightly, if they leave less of it empty. Which lengths are left is kept as the bits of one integer."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    left: dict[int, list[int]] = {}
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        left.setdefault(n, []).append(i)
    here = mirrored = 0
    for n in left:
        here |= 1 << n
        mirrored |= 1 << (capacity - n)

    def take(n: int) -> int:
        nonlocal here, mirrored
        i = left[n].pop()
        if not left[n]:
            here ^= 1 << n
            mirrored ^= 1 << (capacity - n)
        return i

    def put(n: int, i: int) -> None:
        nonlocal here, mirrored
        left[n].append(i)
        here |= 1 << n
        mirrored |= 1 << (capacity - n)

    number = 0
    while here:
        held, gap = [], capacity
        while fits := here & ((1 << (gap + 1)) - 1):
            n = fits.bit_length() - 1
            held.append((n, take(n)))
            gap -= n
        if gap and len(held) > 1:
            small, i = held[-1]
            for total in range(gap + small, small, -1):
                pairs = here & (mirrored >> (capacity - total)) & ((1 << total) - 1)
                if pairs and not total % 2 and len(left.get(total // 2, ())) == 1:
                    pairs &= ~(1 << (total // 2))
                if pairs:
                    a = pairs.bit_length() - 1
                    held[-1:] = [(a, take(a)), (total - a, take(total - a))]
                    put(small, i)
                    break
        at = 0
        for n, i in held:
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces (not their ids) are dealt in turn to groups of about group_pieces, whatever their keys, and
    each group is packed by itself, so at any input size a task holds that many short rows, and the
    waste over one global packing is a bin or two a group.

    Null text is empty: one piece with end_id alone. Null doc_id is kept. Repeated rows are packed as often
    as they come. Ties among equal lengths go by place in the group. An empty table gives no rows. Columns
    other than doc_id and text are ignored.
    """
    text_batches(docs.sparkSession)
    pieces = materialize(piece_frame(docs, tokenizer, capacity, end_id), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(batches)
        if not kept:
            return
        table = pa.Table.from_batches(kept)
        if not table.num_rows:
            return
        bins, offsets = best_two_fit(table.column("length").to_numpy(), capacity)
        bins += TaskContext.get().partitionId() << 32
        yield from table.append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offsets)).to_batches()

    return pieces.repartition(groups).mapInArrow(deal, schema)
