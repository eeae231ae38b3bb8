"""Copies among images by local descriptors: corners, binary tests, Hamming tables, geometric consensus."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrain.llm.anchors import sliding
from rolegrain.llm.bits import bitmap
from rolegrain.llm.components import components
from rolegrain.llm.packed import added_up, pack_keys, part_of, unpack_keys
from rolegrain.llm.shared import materialize, parts
from rolegrain.llm.textvec import COMBINE, mix

#: Corners of each scale in an image of AREA pixels or less. Larger images have as many for each AREA pixels.
CORNERS = (24, 16, 8)
SCALES = (1.0, 1.5, 2.25)
AREA, CELL = 96 * 96, 32
#: Corners that Python takes in at once.
TAKEN = 98_304
RADIUS, BITS = 8, 128
#: Two descriptors meet in a Hamming table if two of the five parts of one of two splits of their bits agree, as those
#: with at most three different bits always do and those with more often do. They match if at most NEAR bits differ.
SPLITS, PARTS = 2, 5
NEAR = 24
VOTES, PLACE = 4, 6.0
#: Rounds in which the images of a key meet one of them, before all that is still apart meets. The first takes one of
#: SHARE keys.
STARS, SHARE = 4, 4
#: Buckets of groups in the sketch of a key: what a corner carries of its company, at most.
SKETCH = 4096
#: The same of single images, before there are groups: more buckets, but a key with images in more than FEW of them has
#: company everywhere, so that a corner carries FEW entries at most.
SPREAD, FEW = 65_536, 64
#: Keys that a task holds before it packs them.
FLUSH_KEYS = 1_000_000
_rng = np.random.default_rng(20)
TESTS = np.clip(_rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS + 1, RADIUS - 1)
_parts = [[sum(1 << int(b) for b in part) for part in np.array_split(np.random.default_rng(s).permutation(BITS), PARTS)] for s in range(SPLITS)]
#: The bits of each Hamming table, 64 of them in each of two numbers.
TABLES = [((i | j) & (1 << 64) - 1, (i | j) >> 64) for split in _parts for i, j in itertools.combinations(split, 2)]
DESCRIPTION = "media_id long, digest string, readable boolean, x array<float>, y array<float>, angle array<float>, scale array<float>, bits binary"


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM, or of an 8-bit PNG without interlacing; None for anything else."""
    try:
        if data is None:
            return None
        if data[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                if data[at : at + 1] == b"#":
                    at = data.index(b"\n", at)
                    continue
                end = at
                while data[end : end + 1].isdigit():
                    end += 1
                fields.append(int(data[at:end]))
                at = end
            width, height, most = fields
            depth = 3 if data[1:2] == b"6" else 1
            if most > 255:
                return None
            values = np.frombuffer(data, np.uint8, width * height * depth, at + 1).reshape(height, width, depth)
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            at, packed = 8, b""
            while at < len(data):
                size, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
                if kind == b"IHDR":
                    width, height = int.from_bytes(data[at + 8 : at + 12]), int.from_bytes(data[at + 12 : at + 16])
                    depth = {0: 1, 2: 3, 4: 2, 6: 4}[data[at + 17]]
                    if data[at + 16] != 8 or data[at + 20]:
                        return None
                elif kind == b"IDAT":
                    packed += data[at + 8 : at + 8 + size]
                at += size + 12
            lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * depth)
            values = unfiltered(lines, depth).reshape(height, width, depth)
            values = values[:, :, : 3 if depth > 2 else 1]
        else:
            return None
        return values.astype(np.float32).mean(axis=2) if values.size else None
    except (ValueError, KeyError, IndexError, zlib.error, UnboundLocalError):
        return None


def unfiltered(lines: np.ndarray, depth: int) -> np.ndarray:
    """PNG scan lines without their filters."""
    out = np.zeros((len(lines) + 1, lines.shape[1] - 1), np.uint8)
    for i, line in enumerate(lines):
        kind, raw, above = line[0], line[1:].astype(int), out[i].astype(int)
        if kind == 0:
            out[i + 1] = raw
        elif kind == 1:
            for c in range(depth):
                out[i + 1, c::depth] = np.cumsum(raw[c::depth]) & 255
        elif kind == 2:
            out[i + 1] = (raw + above) & 255
        else:
            now = [0] * (len(raw) + depth)
            old = [0] * depth + above.tolist()
            for j, r in enumerate(raw.tolist()):
                a, b, c = now[j], old[j + depth], old[j]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[j + depth] = (r + guess) & 255
            out[i + 1] = now[depth:]
    return out[1:]


def box(image: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2 * r + 1, edges repeated."""
    padded = np.pad(image, ((r + 1, r), (r + 1, r)), mode="edge")
    total = padded.cumsum(0, dtype=np.float64).cumsum(1)
    k = 2 * r + 1
    return ((total[k:, k:] - total[:-k, k:] - total[k:, :-k] + total[:-k, :-k]) / (k * k)).astype(np.float32)


def resized(image: np.ndarray, factor: float) -> np.ndarray:
    """Smaller by the factor, by bilinear reading of the smoothed image."""
    if factor == 1:
        return image
    h, w = int(image.shape[0] / factor), int(image.shape[1] / factor)
    soft = box(image, 1)
    y, x = (np.arange(h) + 0.5) * factor - 0.5, (np.arange(w) + 0.5) * factor - 0.5
    y0, x0 = np.clip(y.astype(int), 0, image.shape[0] - 2), np.clip(x.astype(int), 0, image.shape[1] - 2)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    a, b = soft[y0][:, x0], soft[y0][:, x0 + 1]
    c, d = soft[y0 + 1][:, x0], soft[y0 + 1][:, x0 + 1]
    return ((a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy).astype(np.float32)


def chosen(strength: np.ndarray, y: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """The places of the `most` strongest corners, and in each cell of the image of those that are among its
    strongest, most over the number of cells: a part of the image keeps corners however strong the rest is."""
    order = np.lexsort((x, y, -strength))
    cell = (y[order] // CELL) * (int(x.max()) // CELL + 1) + x[order] // CELL
    by_cell = np.argsort(cell, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(cell[by_cell]) != 0])
    within = np.empty(len(order), int)
    within[by_cell] = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    each = -(-most // ((int(y.max()) // CELL + 1) * (int(x.max()) // CELL + 1)))
    return order[(np.arange(len(order)) < most) | (within < each)]


def described(image: np.ndarray) -> tuple[np.ndarray, ...]:
    """(x, y, angle, scale, bits) of the corners of an image. Corners are local maxima of the smaller
    eigenvalue's bound (Harris); the angle is that of the patch's brightness centroid, and the tests compare
    smoothed values at places turned by it."""
    out = []
    disc = np.array([(dx, dy) for dy in range(-RADIUS, RADIUS + 1) for dx in range(-RADIUS, RADIUS + 1) if dx * dx + dy * dy <= RADIUS * RADIUS])
    for factor, most in zip(SCALES, CORNERS, strict=True):
        if min(image.shape) / factor < 4 * RADIUS:
            break
        small = resized(image, factor)
        gx, gy = np.zeros_like(small), np.zeros_like(small)
        gx[:, 1:-1], gy[1:-1] = small[:, 2:] - small[:, :-2], small[2:] - small[:-2]
        xx, yy, xy = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        edge = 2 * RADIUS - 2
        inner = strength[edge:-edge, edge:-edge]
        if inner.size == 0:
            continue
        around = strength[edge - 2 : strength.shape[0] - edge + 2, edge - 2 : strength.shape[1] - edge + 2]
        most_near = sliding(sliding(around, 5, np.maximum).T, 5, np.maximum).T
        y, x = np.nonzero((inner >= most_near) & (inner > 1e-3))
        peak = np.ones(len(y), bool)
        for dy, dx in itertools.product((-2, -1, 0, 1, 2), repeat=2):  # of equal ones side by side, the first
            if (dy, dx) < (0, 0):
                peak &= inner[y, x] > strength[y + edge + dy, x + edge + dx]
        y, x = y[peak], x[peak]
        if not len(y):
            continue
        order = chosen(inner[y, x], y, x, -(-most * max(image.size, AREA) // AREA))
        y, x = y[order] + edge, x[order] + edge
        soft = box(small, 2)
        patch = small[y[:, None] + disc[:, 1], x[:, None] + disc[:, 0]]
        patch = patch - patch.mean(axis=1, keepdims=True)
        angle = np.arctan2((patch * disc[:, 1]).sum(1), (patch * disc[:, 0]).sum(1))
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px = np.rint(x[:, None, None] + cos * TESTS[..., 0] - sin * TESTS[..., 1]).astype(int)
        py = np.rint(y[:, None, None] + sin * TESTS[..., 0] + cos * TESTS[..., 1]).astype(int)
        seen = soft[np.clip(py, 0, soft.shape[0] - 1), np.clip(px, 0, soft.shape[1] - 1)]
        out.append((x * factor, y * factor, angle, np.full(len(x), factor), np.packbits(seen[..., 0] < seen[..., 1], axis=1)))
    if not out:
        return (*(np.zeros(0) for _ in range(4)), np.zeros((0, BITS // 8), np.uint8))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def stretches(corners: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of rows with TAKEN corners at most, or of one row."""
    lo = held = 0
    for hi, n in enumerate(corners):
        if held and held + n > TAKEN:
            yield lo, hi
            lo, held = hi, 0
        held += n
    if lo < len(corners):
        yield lo, len(corners)


def descriptions(media: DataFrame) -> DataFrame:
    """A row of DESCRIPTION for each image."""
    floats = pa.list_(pa.float32())
    fields = pa.schema([("media_id", pa.int64()), ("digest", pa.string()), ("readable", pa.bool_()), ("x", floats), ("y", floats), ("angle", floats), ("scale", floats), ("bits", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            lo = held = 0
            for hi in range(1, batch.num_rows + 1):
                image = decode(batch.column("image")[hi - 1].as_py())
                found = described(image) if image is not None else described(np.zeros((1, 1), np.float32))
                for to, x in zip(columns, (image is not None, *(v.astype(np.float32) for v in found[:4]), found[4].tobytes()), strict=True):
                    to.append(x)
                held += len(found[0])
                if hi == batch.num_rows or hi - lo == 256 or held >= TAKEN:
                    part = batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([part.column("media_id"), part.column("digest"), *[pa.array(c, t) for c, t in zip(columns, fields.types[2:], strict=True)]], schema=fields)
                    columns, lo, held = [[] for _ in range(6)], hi, 0

    return media.mapInArrow(rows, DESCRIPTION)


def table_keys(bits: np.ndarray) -> list[np.ndarray]:
    """The keys of descriptors in each Hamming table: 48 bits of a hash of the table's number and its bits."""
    words = bits.copy().view("<u8").T
    out = []
    for t, masks in enumerate(TABLES):
        lo, hi = (w & np.uint64(m) for w, m in zip(words, masks, strict=True))
        out.append(mix(mix(lo * COMBINE[50] + COMBINE[60 + t]) + hi * COMBINE[51]) >> np.uint64(16))
    return out


def shared_keys(images: DataFrame) -> DataFrame:
    """(key): the keys that two images or more have, mixed to 64 bits. Tasks count keys by image, pack them by ranges,
    and a group gets the packed keys of its range."""
    n_parts = 2 * parts(images.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            part = part_of(found, n_parts, 48)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            to = np.r_[cut[1:], len(part)]
            packed = [[pack_keys(found[a:b]) for a, b in zip(cut, to, strict=True)], [np.packbits(n[a:b] > 1).tobytes() for a, b in zip(cut, to, strict=True)]]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), *[pa.array(x, pa.binary()) for x in packed]], ["part", "keys", "twice"])

        for batch in batches:
            for raw in batch.column("bits").to_pylist():
                own = np.unique(np.concatenate(table_keys(np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8))))
                held.append(own)
                size += len(own)
                if size >= FLUSH_KEYS:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    def twice(table: pa.Table) -> pa.Table:
        each = [unpack_keys(x) for x in table.column("keys").to_pylist()]
        more = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for k, x in zip(each, table.column("twice").to_pylist(), strict=True)]
        found, n = added_up(np.concatenate(each), 1 + np.concatenate(more).astype(np.int64))
        return pa.table({"key": pa.array(mix(found[n > 1]).view(np.int64))})

    return images.select("bits").mapInArrow(keys, "part int, keys binary, twice binary").groupBy("part").applyInArrow(twice, "key long")


def shared_corners(images: DataFrame) -> DataFrame:
    """(key, node, place) of the corners of images by those keys of their Hamming tables that two images have. A bitmap
    of the shared keys, 16 MB at most, keeps most others out; a key that it lets through by mistake meets nothing."""
    shared = materialize(shared_keys(images), "shared_keys")
    wanted = images.sparkSession.sparkContext.broadcast(bitmap(shared, "key", shared.count()))

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x.as_buffer()) * 8 // BITS for x in batch.column("bits")]
            for lo, hi in stretches(sizes):
                part = batch.slice(lo, hi - lo)
                n = np.array(sizes[lo:hi], np.int64)
                node = np.repeat(part.column("node").to_numpy(), n)
                place = (np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                for key in table_keys(np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint8).reshape(-1, BITS // 8)):
                    at = np.flatnonzero(wanted.value.may_have(mix(key.copy())))
                    yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (key.view(np.int64), node, place)], ["key", "node", "place"])

    return materialize(images.select("node", "bits").mapInArrow(corners, "key long, node long, place int"), "shared_corners")


def most_votes(pair: np.ndarray, a: dict[str, np.ndarray], b: dict[str, np.ndarray], n_pairs: int) -> np.ndarray:
    """For each pair of images, the votes of its pairs of corners a and b: how many corners of each image agree on one
    transform, that is on zoom and, in one of eight shifted grids, on the turn and on where the origin goes. Pairs of
    corners with more than NEAR different bits have no vote."""
    near = np.flatnonzero(np.bitwise_count(a["bits"] ^ b["bits"]).sum(axis=1) <= NEAR)
    pair, a, b = pair[near], {c: v[near] for c, v in a.items()}, {c: v[near] for c, v in b.items()}
    ratio, turn = b["scale"] / a["scale"], b["angle"] - a["angle"]
    dx = b["x"] - ratio * (np.cos(turn) * a["x"] - np.sin(turn) * a["y"])
    dy = b["y"] - ratio * (np.sin(turn) * a["x"] + np.cos(turn) * a["y"])
    zoom, most = np.rint(np.log(ratio) / np.log(1.5)), np.zeros(n_pairs, np.int64)
    for grid in range(8):
        shifted = lambda v, size, bit: np.floor(v / size + (grid & (1 << bit)) / (2.0 * (1 << bit)))  # noqa: B023, E731
        wound = np.mod(shifted(np.mod(turn, 2 * np.pi), np.pi / 8, 2), 16)
        cells, of = np.unique(np.stack([pair, zoom, wound, shifted(dx, PLACE * 2, 0), shifted(dy, PLACE * 2, 1)], axis=1).astype(np.int64), axis=0, return_inverse=True)
        n = [np.bincount(np.unique(np.stack([of.ravel(), x["place"]], axis=1), axis=0)[:, 0], minlength=len(cells)) for x in (a, b)]
        np.maximum.at(most, cells[:, 0], np.minimum(*n))
    return most


def linked_pairs(met: DataFrame, images: DataFrame) -> DataFrame:
    """The pairs (a, b) of images of which VOTES corners of each or more agree on one transform, of the pairs of corners
    met (a, a_place, b, b_place), a row for each table in which they meet. Pairs of images are counted before their
    descriptions are brought in: each needs VOTES corners that meet."""
    spark = images.sparkSession
    ahead = F.col("a") < F.col("b")
    one = lambda x, y: [F.when(ahead, F.col(f"{x}{c}")).otherwise(F.col(f"{y}{c}")) for c in ("", "_place")]
    (low, low_place), (high, high_place) = one("a", "b"), one("b", "a")
    ordered = met.select(low.alias("a"), high.alias("b"), low_place.alias("a_place"), high_place.alias("b_place"))
    pairs = ordered.groupBy("a", "b").agg(F.collect_set(F.struct("a_place", "b_place")).alias("met")).filter(F.size("met") >= VOTES)
    different = lambda c: F.size(F.array_distinct(F.col("met")[c]))
    pairs = materialize(pairs.filter((different("a_place") >= VOTES) & (different("b_place") >= VOTES)), "pairs")
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair_nodes")
    wanted = spark.sparkContext.broadcast(bitmap(nodes, "node", nodes.count()))
    columns = ("x", "y", "angle", "scale", "bits")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value.may_have(batch.column("node").to_numpy().view(np.uint64))))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                places = part.column("met").flatten()
                pair = np.repeat(np.arange(part.num_rows), np.diff(part.column("met").offsets.to_numpy()))
                sides = []
                for s, place in zip("ab", places.flatten(), strict=True):
                    bits = part.column(f"{s}_bits").to_pylist()
                    first = np.cumsum([0, *(len(x) * 8 // BITS for x in bits)])[:-1]
                    at = first[pair] + place.to_numpy()
                    own = {c: part.column(f"{s}_{c}").flatten().to_numpy(zero_copy_only=False)[at].astype(np.float64) for c in columns[:-1]}
                    sides.append(own | {"place": place.to_numpy(), "bits": np.frombuffer(b"".join(bits), np.uint64).reshape(-1, BITS // 64)[at]})
                linked = pa.array(most_votes(pair, *sides, part.num_rows) >= VOTES)
                yield pa.RecordBatch.from_arrays([part.column(c).filter(linked) for c in "ab"], ["a", "b"])

    found = images.select("node", *columns).mapInArrow(keep, "node long, " + ", ".join(f"{c} {'binary' if c == 'bits' else 'array<float>'}" for c in columns))
    side = lambda s: found.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(judge, "a long, b long")


def linked(images: DataFrame) -> DataFrame:
    """(node, label) of the images' groups. In a few rounds the images of a key meet one of them, its pivot, if they
    are not in one group with it yet: at first the image with most shared corners, then one drawn anew each round. That
    joins a group of copies without pairing it out. Copies share so many keys, up to 20 for each corner, that a share of
    them joins most in the first round; what that leaves apart meets by all keys in the others. Whatever then still lies
    apart and is near enough meets whole."""
    corners = with_company(shared_corners(images))
    shares = materialize(corners.groupBy("node").agg(F.count("*").alias("shares")), "shares")
    labels, links = shares.withColumn("label", F.col("node")), None
    for stars in range(STARS):
        keys = corners if stars else corners.filter(F.pmod(F.xxhash64("key"), F.lit(SHARE)) == 0)
        found = materialize(linked_pairs(met_pivots(keys.join(labels, "node"), stars), images), "star_links")
        if found.isEmpty():
            if stars:
                break
            continue
        links = found if links is None else links.union(found)
        labels = materialize(shares.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node")), "node_labels")
    between = materialize(linked_pairs(met_apart(corners, labels), images), "group_links")
    return components(between if links is None else links.union(between))


def met_pivots(labelled: DataFrame, stars: int) -> DataFrame:
    """The corners (b, b_place) of images that meet those of their keys' pivots (a, a_place) under another label."""
    by = F.struct("shares", "node") if not stars else F.struct(F.xxhash64("node", F.lit(stars)), "node")
    best = labelled.groupBy("key").agg(F.max_by(F.struct("node", "place", "label"), by).alias("p"), F.min("label").alias("low"), F.max("label").alias("high"))
    pivots = best.filter("low < high").select("key", F.col("p.node").alias("a"), F.col("p.place").alias("a_place"), F.col("p.label").alias("of"))
    return labelled.join(pivots, "key").filter("label <> of").select("a", "a_place", F.col("node").alias("b"), F.col("place").alias("b_place"))


def bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("label"), F.lit(n)).cast("int")


def likely(labelled: DataFrame, few: int | None = None) -> DataFrame:
    """(key, node, place, buckets): the corners (key, node, place, label, bucket) of which the company can matter, and the
    buckets it is in. A key's sketch is the set of its groups' buckets, each with whether more than one of its groups is
    there. An image can link with a group only if VOTES different places have a key with another group in that bucket. No
    pair of an image and a group is made for that: a corner carries one sketch. One of more than few entries is left
    empty and stands for every bucket; such a corner's own buckets are empty too."""
    held = labelled.groupBy("key", "bucket").agg((F.min("label") < F.max("label")).cast("int").alias("more"))
    sketches = held.groupBy("key").agg(F.collect_list(F.col("bucket") * 2 + F.col("more")).alias("sketch"))
    if few is not None:
        sketches = sketches.withColumn("sketch", F.when(F.size("sketch") <= few, F.col("sketch")).otherwise(F.array().cast("array<int>")))
    company = F.when((F.size("sketch") != 1) | (F.get("sketch", F.lit(0)) % 2 == 1), F.struct("key", "place", "sketch"))
    images = labelled.join(sketches, "key").groupBy("node", F.col("bucket").alias("own")).agg(F.collect_list(company).alias("corners"))

    def judged(node: np.ndarray, own: np.ndarray, corners: pa.ListArray) -> pa.RecordBatch:
        key, place, sketch = corners.flatten().flatten()
        image, place = np.repeat(np.arange(len(node)), np.diff(corners.offsets.to_numpy())), place.to_numpy()
        entries = np.diff(sketch.offsets.to_numpy())
        corner, everywhere = np.repeat(np.arange(len(key)), entries), np.flatnonzero(entries == 0)
        at, more = np.divmod(sketch.flatten().to_numpy(), 2)
        other = np.flatnonzero((at != own[image[corner]]) | (more == 1))
        corner, at = corner[other], at[other]
        met, beside = np.unique(image[corner] << 32 | at, return_inverse=True)
        places = np.bincount(np.unique(beside << 32 | place[corner]) >> 32, minlength=len(met))
        wide = np.bincount(np.unique(image[everywhere] << 32 | place[everywhere]) >> 32, minlength=len(node))
        near = np.flatnonzero(places[beside] + wide[image[corner]] >= VOTES)
        n = np.bincount(corner[near], minlength=len(key))
        linking = wide >= VOTES
        linking[image[corner[near]]] = True
        keep = np.flatnonzero((n > 0) | (entries == 0) & linking[image])
        buckets = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[keep])].astype(np.int32)), pa.array(at[near].astype(np.int32)))
        return pa.RecordBatch.from_arrays([*[pa.array(x) for x in (key.to_numpy()[keep], node[image[keep]], place[keep])], buckets], ["key", "node", "place", "buckets"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            corners = batch.column("corners")
            entries = np.diff(corners.flatten().field("sketch").offsets.to_numpy())
            of = np.repeat(np.arange(batch.num_rows), np.diff(corners.offsets.to_numpy()))
            for lo, hi in stretches(np.bincount(of, entries + 1, batch.num_rows).tolist()):
                yield judged(*[batch.column(c)[lo:hi].to_numpy() for c in ("node", "own")], corners[lo:hi])

    return images.mapInArrow(rows, "key long, node long, place int, buckets array<int>")


def with_company(corners: DataFrame) -> DataFrame:
    """The corners (key, node, place) that a link between two images can need. Most keys that two images share by chance
    are the only ones of the two, and the number of such pairs grows with the square of the images; what is left grows
    with the copies. Both images of a pair that meets at VOTES places of each or more keep all corners in which they meet."""
    return materialize(likely(corners.withColumn("label", F.col("node")).withColumn("bucket", bucket(SPREAD)), FEW).select("key", "node", "place"), "company")


def met_apart(corners: DataFrame, labels: DataFrame) -> DataFrame:
    """The corners of images that meet under different labels, of those of which VOTES different ones have company in
    the other, larger group, as they must if the image links with any there. What sketches leave of an image meets each
    group of a key once before that count is known, however many images of the group have the key."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("images"))
    named = labels.select("node", "label").join(sizes, "label").select("node", "label", F.struct("images", "label").alias("own"))
    labelled = corners.join(named, "node").withColumn("bucket", bucket(SKETCH))
    ahead = materialize(likely(labelled).select("key", "node", "place", F.explode("buckets").alias("bucket")), "likely")
    groups = labelled.select("key", "bucket", F.col("own").alias("other")).distinct()
    beside = materialize(ahead.join(groups, ["key", "bucket"]).join(named, "node").filter("own < other").select("key", "node", "place", F.col("other.label").alias("other")), "beside")
    near = beside.groupBy("node", "other").agg(F.count_distinct("place").alias("places")).filter(F.col("places") >= VOTES).select("node", "other")
    ones = beside.join(near, ["node", "other"]).select("key", F.col("other").alias("label"), F.col("node").alias("a"), F.col("place").alias("a_place"))
    return ones.join(labelled.select("key", "label", F.col("node").alias("b"), F.col("place").alias("b_place")), ["key", "label"]).select("a", "a_place", "b", "b_place")


def copy_groups(media: DataFrame) -> DataFrame:
    """One row per row of media (media_id, image): media_id, n_corners, copy_group.

    copy_group is the smallest media_id that links reach. Two images link when they are the same bytes, or
    when VOTES corners or more agree on one turn, zoom and shift, as those of a cropped, brightened, overlaid
    or turned copy do. Images of the same bytes are one node, so groups of exact copies give no pairs.

    An image that is null or can't be read has no corners (n_corners null) and links with nothing but, if not
    null, its exact copies; an empty or plain image has none either (0). Null media_ids count only in a group
    without others. Repeated rows share their group. An empty table gives no rows. Other columns are ignored.
    """
    rows = media.select(F.col("media_id").cast("long").alias("media_id"), F.col("image").cast("binary").alias("image")).withColumn("digest", F.sha2("image", 256))
    members = materialize(descriptions(rows), "descriptions")
    node = F.xxhash64("digest")
    images = materialize(members.filter("readable and digest is not null").dropDuplicates(["digest"]).withColumn("node", node), "images")
    labels = linked(images)
    named = members.withColumn("node", F.when(F.col("digest").isNotNull(), node)).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.filter("label is not null").groupBy("label").agg(F.min("media_id").alias("copy_group"))
    return named.join(lowest, "label", "left").select("media_id", F.when(F.col("readable"), F.size("x")).alias("n_corners"), F.when(F.col("label").isNull(), F.col("media_id")).otherwise(F.col("copy_group")).alias("copy_group"))


def drawn(vectors: DataFrame, side: int = 96) -> DataFrame:
    """A media table from vectors, as the tables hold no images: each vector is drawn as a PGM of side * side,
    the sum of fixed noise textures in the proportions of its components. Equal vectors give equal images; a
    null vector gives a null image."""
    texture = np.random.default_rng(7)
    noise = [np.zeros((0, side * side), np.float32)]

    def patterns(n: int) -> np.ndarray:
        if len(noise[0]) < n:
            more = [box(texture.normal(0, 1, (side, side)).astype(np.float32), 1).ravel() for _ in range(n - len(noise[0]))]
            noise[0] = np.vstack([noise[0], *more])
        return noise[0][:n]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = []
            for vector in batch.column("embedding").to_pylist():
                if vector is None:
                    images.append(None)
                    continue
                v = np.nan_to_num(np.array([x or 0.0 for x in vector], np.float32), posinf=0, neginf=0)
                v /= max(float(np.linalg.norm(v)), 1e-9)
                total = v @ patterns(len(v)) if len(v) else np.zeros(side * side, np.float32)
                images.append(b"P5 %d %d 255\n" % (side, side) + np.clip(128 + 150 * total, 0, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("media_id"), pa.array(images, pa.binary())], ["media_id", "image"])

    return vectors.select(F.col("vec_id").cast("long").alias("media_id"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(rows, "media_id long, image binary")
