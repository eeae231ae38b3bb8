"""Copies among images: planted crops, edits and turns are found, other images are left alone."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from rolegrain.llm import media


def texture(seed, side=128):
    rng = np.random.default_rng(seed)
    return np.clip(128 + 200 * media.box(rng.normal(0, 1, (side, side)).astype(np.float32), 1), 0, 255).astype(np.uint8)


def pgm(image):
    return b"P5\n# made\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image).tobytes()


def png(image, kind):
    lines = b""
    above = np.zeros(image.shape[1], int)
    for row in image.astype(int):
        left = np.r_[0, row[:-1]]
        corner = np.r_[0, above[:-1]]
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * row, left, above, (left + above) // 2, paeth][kind]
        lines += bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, d: len(d).to_bytes(4) + k + d + zlib.crc32(k + d).to_bytes(4)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", image.shape[1].to_bytes(4) + image.shape[0].to_bytes(4) + bytes([8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def all_pairs(rows, met):
    """The linked pairs among images, of all pairs of corners for which met says so."""
    out, each = set(), []
    for i, data in rows:
        x, y, angle, scale, bits = media.described(media.decode(data))
        each.append((i, bits, {"x": x, "y": y, "angle": angle, "scale": scale, "bits": bits.copy().view(np.uint64), "place": np.arange(len(x))}))
    for n, (i, one, a) in enumerate(each):
        for j, other, b in each[:n]:
            p, q = np.nonzero(met(other, one))
            if len(p) and media.most_votes(np.zeros(len(p), int), {c: v[p] for c, v in b.items()}, {c: v[q] for c, v in a.items()}, 1)[0] >= media.VOTES:
                out.add((min(i, j), max(i, j)))
    return out


def test_decode():
    image = texture(1)
    for data in (pgm(image), *(png(image, k) for k in range(5))):
        assert (media.decode(data) == image).all()
    assert media.decode(b"P6 1 1 255\n\x03\x06\x09").tolist() == [[6.0]]
    for data in (None, b"", b"P5", b"GIF89a", pgm(image)[:-1], png(image, 0)[:60], b"P5 0 0 255\n"):
        assert media.decode(data) is None


def test_planted_copies(spark):
    rows, groups = [], {}
    for s in range(12):
        image = texture(s)
        edits = [image, image[20:110, 15:120], np.clip(image.astype(int) + 25, 0, 255).astype(np.uint8), np.clip(128 + (image.astype(int) - 128) * 0.8, 0, 255).astype(np.uint8), np.rot90(image), image.copy()]
        edits[5][40:60, 40:60] = 255
        for k, e in enumerate(edits):
            rows.append((100 * s + k, pgm(e)))
            groups[100 * s + k] = 100 * s
        rows.append((100 * s + 50, pgm(image)))
        groups[100 * s + 50] = 100 * s
    rows += [(5000, None), (5001, b"junk"), (5002, b"junk"), (5003, pgm(np.full((64, 64), 9, np.uint8))), (5004, pgm(np.zeros((2, 2), np.uint8))), (3, rows[3][1]), (None, b"own")]
    got = media.copy_groups(spark.createDataFrame([(*r, "x") for r in rows], "media_id long, image binary, digest string")).collect()
    assert len(got) == len(rows)
    by_id = {r.media_id: r for r in got}
    assert sum(by_id[i].copy_group == g for i, g in groups.items()) >= 0.95 * len(groups)
    assert all(by_id[i].copy_group // 100 * 100 == g for i, g in groups.items())
    assert [(by_id[i].n_corners, by_id[i].copy_group) for i in (5000, 5001, 5002, 5003, 5004, None)] == [(None, 5000), (None, 5001), (None, 5001), (0, 5003), (0, 5004), (None, None)]


def test_corners_follow_area_and_spread():
    strong = texture(1, 256).astype(np.float32)
    weak = 128 + (strong - 128) * 0.15
    weak[:96, :96] = strong[:96, :96]
    x, y, *_, bits = media.described(weak)
    assert len(bits) >= 48 * 256 * 256 // 96**2 and len(media.described(strong[:96, :96])[0]) >= 48
    cells = set(zip(x.astype(int) // 64, y.astype(int) // 64, strict=True))
    assert len(cells) == 16


def test_crop_outside_the_strongest_patch(spark):
    rows = []
    for s in range(6):
        image = 128 + (texture(s, 256).astype(float) - 128) * 0.25
        image[:110, :110] = texture(s + 50, 110)
        rows += [(10 * s, pgm(image.astype(np.uint8))), (10 * s + 1, pgm(image[130:240, 125:235].astype(np.uint8)))]
    got = {r.media_id: r.copy_group for r in media.copy_groups(spark.createDataFrame(rows, "media_id long, image binary")).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


def test_noisy_and_blurred_copies_match_all_pairs(spark):
    """The links among plants against those of every pair of corners with few different bits."""
    rng = np.random.default_rng(3)
    rows = []
    for s in range(8):
        image = texture(200 + s, 96).astype(np.float32)
        edits = [image, image + rng.normal(0, 14, image.shape), media.box(image, 1), media.resized(image, 1.5), image[8:90, 4:88]]
        rows += [(10 * s + k, pgm(np.clip(e, 0, 255).astype(np.uint8))) for k, e in enumerate(edits)]
    frame = spark.createDataFrame(rows, "media_id long, image binary")
    every = all_pairs(rows, lambda one, other: np.ones((len(one), len(other)), bool))
    got = {r.media_id: r.copy_group for r in media.copy_groups(frame).collect()}
    assert len(every) > 40 and sum(got[i] == got[j] for i, j in every) >= 0.95 * len(every)
    assert all(g // 10 == i // 10 for i, g in got.items())


def test_drawn_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(60)
    extra = vectors.limit(1).withColumn("vec_id", vectors.vec_id + 1000)
    got = {r.media_id: r.copy_group for r in media.copy_groups(media.drawn(vectors.union(extra))).collect()}
    first = vectors.first().vec_id
    assert got[first + 1000] == got[first]
    assert media.copy_groups(media.drawn(vectors.limit(0))).count() == 0


@pytest.mark.parametrize("noise, few", [(14, True), (32, False)])
def test_groups_are_those_of_all_pairs(spark, noise, few):
    """Noisy copies, with much noise linked in part only: pivots and what follows lose no link that all pairs of corners
    of one key have."""
    rng = np.random.default_rng(5)
    rows = []
    for s in range(2):
        image = texture(s, 96).astype(int)
        rows += [(1000 * s + k, pgm(np.clip(image + rng.normal(0, noise, image.shape), 0, 255).astype(np.uint8))) for k in range(70)]
    frame = spark.createDataFrame(rows, "media_id long, image binary")
    got = {r.media_id: r.copy_group for r in media.copy_groups(frame).collect()}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def one_key(one, other):
        return np.logical_or.reduce([x[:, None] == y[None] for x, y in zip(media.table_keys(one), media.table_keys(other), strict=True)])

    for a, b in all_pairs(rows, one_key):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {i: root(i) for i in parent}
    sizes = Counter(got.values())
    assert (len(sizes) == 2) if few else (len(sizes) > 2 and max(sizes.values()) > 1)


def test_keys_agree_where_the_table_s_bits_do():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 256, (400, 16), np.uint8)
    bits = np.unpackbits(one, axis=1, bitorder="little")
    other = bits.copy()
    for row in other:
        row[rng.integers(0, 128, 3)] ^= 1
    keys = zip(media.TABLES, media.table_keys(one), media.table_keys(np.packbits(other, axis=1, bitorder="little")), strict=True)
    met = np.zeros(400, bool)
    for (lo, hi), x, y in keys:
        own = np.array([(hi << 64 | lo) >> b & 1 for b in range(128)], bool)
        assert 50 <= own.sum() <= 52 and ((x == y) == (bits[:, own] == other[:, own]).all(axis=1)).all()
        met |= x == y
    assert met.all()


def made_apart(spark, corners, labels, monkeypatch):
    """What met_apart gives, and the rows of the table in which images met groups."""
    made, write = {}, media.materialize
    with monkeypatch.context() as patch:
        patch.setattr(media, "materialize", lambda df, name: made.setdefault(name, write(df, name)))
        met = media.met_apart(spark.createDataFrame(corners, "key long, node long, place int"), spark.createDataFrame(labels, "node long, label long"))
        return sorted(tuple(r) for r in met.collect()), made["beside"].count()


def test_a_common_key_makes_no_pairs(spark, monkeypatch):
    """400 images with one corner of one key each, in groups of their own, and two with four corners in common."""
    corners = [(7, n, 0) for n in range(400)] + [(100 + k, n, 1 + k) for k in range(3) for n in (11, 300)]
    met, rows = made_apart(spark, corners, [(n, n) for n in range(400)], monkeypatch)
    assert met == [(11, p, 300, p) for p in range(4)]
    assert rows <= 40


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_sketches_lose_no_company(spark, monkeypatch, buckets):
    """Few buckets, so that groups share them with each other and with the image itself, against all pairs."""
    monkeypatch.setattr(media, "SKETCH", buckets)
    rng = np.random.default_rng(4)
    corners = sorted({(int(rng.integers(0, 60)), n, p) for n in range(60) for p in range(8)})
    label = {n: n - n % 3 if n < 30 else n for n in range(60)}
    size = Counter(label.values())
    own = {n: (size[x], x) for n, x in label.items()}
    met, _ = made_apart(spark, corners, list(label.items()), monkeypatch)
    every = [(n, p, m, q) for k, n, p in corners for j, m, q in corners if k == j and own[n] < own[m]]
    places = {}
    for n, p, m, _ in every:
        places.setdefault((n, label[m]), set()).add(p)
    want = sorted(x for x in every if len(places[x[0], label[x[2]]]) >= media.VOTES)
    assert want and met == want


def test_keys_shared_by_chance_meet_no_pivots(spark, monkeypatch):
    """3000 keys that two of 300 images share, and five pairs with four corners in common: only these meet pivots."""
    rng = np.random.default_rng(6)
    pairs = [rng.choice(300, 2, replace=False) for _ in range(3000)]
    corners = [(k, int(n), int(rng.integers(0, 48))) for k, pair in enumerate(pairs) for n in pair]
    corners += [(5000 + 4 * n + p, n + m, p) for n in range(5) for p in range(4) for m in (0, 100)]
    rows = []

    def four_in_common(met, images):
        rows.append(met.count())
        return met.groupBy("a", "b").agg(F.count_distinct("a_place").alias("n")).filter(F.col("n") >= media.VOTES).select("a", "b")

    monkeypatch.setattr(media, "shared_corners", lambda images: spark.createDataFrame(corners, "key long, node long, place int"))
    monkeypatch.setattr(media, "linked_pairs", four_in_common)
    assert sorted(tuple(r) for r in media.linked(None).collect()) == sorted((n + m, n) for n in range(5) for m in (0, 100))
    assert sum(rows) <= 40


@pytest.mark.parametrize("spread, few", [(1, 1), (3, 2), (65_536, 1), (65_536, 3), (65_536, 64)])
def test_corners_of_pairs_that_can_link_stay(spark, monkeypatch, spread, few):
    """Images that share buckets, keys with more images than a sketch holds, and images with many such keys."""
    monkeypatch.setattr(media, "SPREAD", spread)
    monkeypatch.setattr(media, "FEW", few)
    rng = np.random.default_rng(8)
    corners = {(int(rng.integers(0, 400)), n, p) for n in range(80) for p in range(8)}
    corners |= {(1000 + int(rng.integers(0, 3)), n, 8 + p) for n in range(40, 60) for p in range(3)}
    corners |= {(2000 + 8 * n + p, n + m, p) for n in range(0, 80, 8) for p in range(2 + n % 5) for m in (0, 3)}
    by_key, met = {}, {}
    for k, n, p in corners:
        by_key.setdefault(k, []).append((k, n, p))
    for own in by_key.values():
        for a in own:
            for b in own:
                if a[1] != b[1]:
                    met.setdefault((a[1], b[1]), set()).add(a)
    places = {pair: len({p for _, _, p in own}) for pair, own in met.items()}
    want = {c for (n, m), own in met.items() if min(places[n, m], places[m, n]) >= media.VOTES for c in own}
    got = [tuple(r) for r in media.with_company(spark.createDataFrame(sorted(corners), "key long, node long, place int")).collect()]
    assert want and len(got) == len(set(got)) and want <= set(got) <= corners
    assert few < 64 or len(got) < len(corners) / 2
