"""Packing against the whole-text tokenizer, and best_two_fit against its own rules."""

import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rolegrain.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_bins(lengths, bins, offsets, capacity):
    for b in set(bins.tolist()):
        at = sorted((o, n) for o, n in zip(offsets[bins == b].tolist(), lengths[bins == b].tolist(), strict=True))
        end = 0
        for o, n in at:
            assert o == end
            end += n
        assert end <= capacity


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_bins_are_gapless_and_hold_every_piece(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets = packing.best_two_fit(lengths, 64)
    check_bins(lengths, bins, offsets, 64)
    assert len(set(bins.tolist())) <= 2 * max(1, -(-int(lengths.sum()) // 64))


def test_two_pieces_replace_the_smallest():
    lengths = np.array([50, 40, 36, 34, 30, 10])  # greedy alone: 50+40+10 | 36+34+30
    bins, _ = packing.best_two_fit(lengths, 100)
    assert len(set(bins.tolist())) == 2
    lengths = np.array([60, 30, 21, 19, 9])
    bins, _ = packing.best_two_fit(lengths, 100)  # greedy: 60+30+9 leaves 1; 21+19 for 30 leaves 0 of 40
    assert sorted(lengths[bins == bins[0]].tolist()) == [9, 30, 60] or sorted(lengths[bins == bins[0]].tolist()) == [19, 21, 60]


def test_query_against_whole_text_encoding(spark):
    texts = ["", None, "one", "don't  STOP\tme\x0bnow \x1c x y <|endoftext|>z", "é́ ÅNGSTRÖM 12ab!!", "word " * 5000, "x" * 300_000, "dup", "dup"]
    rows = [(i if i != 8 else 7, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(docs, PATH, 64).collect()
    whole = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text, _ in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    seq = np.array([r.sequence_id for r in got])
    check_bins(np.array([r.length for r in got]), seq, np.array([r.offset for r in got]), 64)
    assert len(set(seq.tolist())) <= -(-sum(r.length for r in got) // 64) + 2


def test_corpus_texts_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole, got = Tokenizer.from_file(PATH), {(r.doc_id, r.piece): r for r in packing.pack(docs, PATH).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            assert got.pop((doc_id, k)).ids_crc32 == zlib.crc32(ids[at : at + 2048].tobytes())
    assert not got
    assert packing.pack(docs.limit(0), PATH).count() == 0
    with pytest.raises(Exception, match="text"):
        packing.pack(docs.drop("text"), PATH)


def test_stretches_against_whole_texts_of_odd_letters():
    """Every cased letter, combining marks and white space of Unicode beside what the encoder parts by itself."""
    whole, encode = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    assert encode.by_stretch
    odd = [c for c in map(chr, range(0x3000)) if c.lower() != c or c.upper() != c or unicodedata.combining(c) or c.isspace()]
    rng = np.random.default_rng(0)
    near = [*"aZk9.,'s \n", "<|", "|>", "\u0130", "\u03a3", "\u212a"]
    for c in odd:
        texts = [f"{c}.", f"a{c},", f"{c}a. b{c}", "".join([c, *rng.choice(near, 6)]), "".join([*rng.choice(near, 4), c, *rng.choice(near, 2)]), "".join(rng.choice(odd, 5)) + "."]
        for text in texts:
            assert np.frombuffer(encode.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, ascii(text)


def test_other_tokenizers_take_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encode = Tokenizer.from_file(path), packing.Encoder(path)
    for text in ("One  two.\nThree, FOUR", "", " x"):
        assert np.frombuffer(encode.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
