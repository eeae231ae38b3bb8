"""Personal data: base patterns as seeds, and identifiers of other forms found by the contexts that seeds induce."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrain.llm.bits import Bits, bitmap
from rolegrain.llm.shared import materialize, text_batches
from rolegrain.llm.textvec import LOWER, gram_hashes, text_chunks, word_hashes, words_of

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The base patterns. They are ASCII, so they match bytes of UTF-8 as they match characters. An e-mail is
# looked for from its @, and an address from the first digit of a run, as each start within a long run would be tried else.
LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(rb"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
DIGITS = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
CALL = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")

#: Numbers of other forms: digits with two signs between them at most, of SHORTEST digits or more.
NUMBER = re.compile(rb"[0-9](?:[\x20()./-]{0,2}[0-9])*")
SHORTEST = 6
GLUE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_@%&#$") | frozenset(range(128, 256))
#: Words of contexts end at white space and at these signs, and are lower-cased from A to Z.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d:=(\"'<>[]{},;|"
PLAIN = LOWER.copy()
PLAIN[list(SEPARATORS)] = 0x20
SPACED = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))

#: A pattern is the one, two or three words before a mention.
ORDERS = (1, 2, 3)
MILLION = 1_000_000
MENTION = pa.struct([("seed", pa.int32()), ("may", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64()), ("contexts", pa.list_(pa.int64()))])
MENTION_SQL = "array<struct<seed:int,may:int,start:bigint,end:bigint,value:bigint,contexts:array<bigint>>>"


def luhn(digits: bytes) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(odd) - 48 * len(odd) + sum(sum(divmod(2 * (d - 48), 10)) for d in even)) % 10 == 0


def only_digits(found: bytes) -> bytes:
    return bytes(b for b in found if 48 <= b <= 57)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, by kind and start: leftmost non-overlapping matches of each kind that pass."""
    out, free, at = [], 0, text.find(b"@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((EMAIL, start, found.end()))
        free = found.end() if found else at + 1
        at = text.find(b"@", free)
    out += [(IP, m.start(), m.end()) for m in ADDRESS.finditer(text) if all(len(p.lstrip(b"0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(b"."))]
    for m in DIGITS.finditer(text):
        digits = only_digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((CARD, m.start(), m.end()))
    out += [(PHONE, m.start(), m.end()) for m in CALL.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


def other_forms(text: bytes, taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(kinds that it may be, as bits; start; end) of what looks like an identifier and touches no base span."""
    out, at, size = [], text.find(b"@"), len(text)
    spaced = text.translate(SPACED) if at >= 0 else b""
    while at >= 0:
        start, end = spaced.rfind(b" ", 0, at) + 1, spaced.find(b" ", at)
        end = size if end < 0 else end
        word = text[start:end].rstrip(b".!?)")
        if word.count(b"@") == 1 and 0 < word.find(b"@") < len(word) - 1:
            out.append((1 << EMAIL, start, start + len(word)))
        at = text.find(b"@", end)
    for m in NUMBER.finditer(text):
        start, end = m.span()
        digits = only_digits(m[0])
        if len(digits) < SHORTEST or (start and text[start - 1] in GLUE) or (end < size and text[end] in GLUE):
            continue
        start -= bool(start and text[start - 1] == 43)
        dotted = m[0].count(b".") >= 3 and not m[0].strip(b"0123456789.")
        out.append((1 << IP if dotted else 1 << PHONE | (1 << CARD if len(digits) >= 12 else 0), start, end))
    merged: list[list[int]] = []
    for a, b in sorted(taken):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts, ends = [a for a, _ in merged], [b for _, b in merged]
    return [x for x in out if bisect_right(ends, x[1]) == bisect_left(starts, x[2])]


def value_of(found: bytes) -> int:
    """64 bits of what is named: an address in lower case, a dotted number as it is, of other numbers the digits."""
    dotted = found.count(b".") >= 3 and not found.strip(b"0123456789.")
    kept = found.lower() if b"@" in found or dotted else only_digits(found)
    return int.from_bytes(hashlib.blake2b(kept, digest_size=8).digest(), "big", signed=True)


def rows_found(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[dict]]:
    """The mentions of each row of a chunk, with the hashes of the words before them."""
    kept, digit = np.flatnonzero(np.diff(offsets)), (data >= 48) & (data <= 57) | (data == 64)
    some = set(kept[np.add.reduceat(digit, offsets[kept]) > 0].tolist()) if len(kept) else set()
    words = words_of(PLAIN[data], offsets) if some else None
    grams = {g: gram_hashes(word_hashes(words), g) for g in ORDERS} if some else {}
    for i in range(len(offsets) - 1):
        if i not in some:
            yield []
            continue
        lo = int(offsets[i])
        text = data[lo : offsets[i + 1]].tobytes()
        base = base_spans(text)
        mentions = [(kind, 1 << kind, a, b) for kind, a, b in base] + [(None, may, a, b) for may, a, b in other_forms(text, [(a, b) for _, a, b in base])]
        if not mentions:
            yield []
            continue
        points = np.concatenate([[0], np.cumsum((data[lo : offsets[i + 1]] & 0xC0) != 0x80)])
        found = []
        for kind, may, a, b in mentions:
            at = int(np.searchsorted(words.starts, lo + a))
            before = at - int(words.bounds[i])
            aligned = at < len(words.starts) and int(words.starts[at]) == lo + a
            contexts = [int(grams[g][at - g].astype(np.int64)) for g in ORDERS if g <= before] if aligned else []
            found.append({"seed": kind, "may": may, "start": int(points[a]), "end": int(points[b]), "value": value_of(text[a:b]), "contexts": contexts})
        yield found


def mentions(docs: DataFrame) -> DataFrame:
    """(row, doc_id, found) for each row of docs: base spans (seed is their kind) by kind and start, then other forms."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for _, _, data, offsets in text_chunks(batch.column("text")) for x in rows_found(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(MENTION))], ["doc_id", "found"])

    return materialize(rows.mapInArrow(scan, f"doc_id long, found {MENTION_SQL}").withColumn("row", F.monotonically_increasing_id()), "mentions")


def places(docs: DataFrame, wanted: Bits) -> DataFrame:
    """(pattern, places): how often each run of words that wanted may have comes before a word, over whole texts."""
    broadcast = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [np.zeros(0, np.uint64)]
            for _, _, data, offsets in text_chunks(batch.column("text")):
                words = words_of(PLAIN[data], offsets)
                hashes, last = word_hashes(words), np.repeat(words.bounds[1:], np.diff(words.bounds))
                for g in ORDERS:
                    grams = gram_hashes(hashes, g)
                    grams = grams[np.arange(len(grams)) + g < last[: len(grams)]]
                    seen.append(grams[broadcast.value.may_have(grams)])
            keys, counts = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["pattern", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "pattern long, n long")
    return rows.groupBy("pattern").agg(F.sum("n").alias("places"))


def has_bit(bits: str, kind: int) -> Column:
    return F.col(bits).bitwiseAND(1 << kind) != 0


def scores(named: DataFrame, docs: DataFrame, support: int, prior: int, promoted: int, rounds: int) -> DataFrame:
    """(value, best, score): the kind of each value and its score in millionths, after the rounds of the graph.

    named has (seed, may, value, contexts). A pattern's confidence in a kind is the sum of the scores of what comes after
    it, over its places in all texts and prior; it is 0 unless `support` different values that come after it have a score
    of `promoted` or more. A value's score is 1 for its kinds as a seed, else, for kinds that it may be, that of the best
    pattern, less by as much as the pattern has under half of its mentions. All is in whole numbers."""
    spark = named.sparkSession
    values = named.groupBy("value").agg(F.bit_or(F.coalesce(F.expr("shiftleft(1, seed)"), F.lit(0))).alias("seeds"), F.bit_or("may").alias("may"), F.count("*").alias("all"))
    values = materialize(values, "values")
    pairs = named.select("value", F.explode("contexts").alias("pattern")).groupBy("pattern", "value").agg(F.count("*").alias("n"))
    pairs = materialize(pairs.join(values, "value"), "pairs")
    patterns = materialize(pairs.groupBy("pattern").agg(F.count("*").alias("values"), F.sum("n").alias("mentions"), F.bit_or("seeds").alias("seen")).filter(F.col("values") >= support), "patterns")
    n = patterns.count()
    if not n:
        return values.filter(F.lit(False)).select("value", F.lit(0).alias("best"), F.lit(0).cast("long").alias("score"))
    counted = patterns.join(places(docs, bitmap(patterns, "pattern", n)), "pattern", "left").select("pattern", (F.greatest("mentions", F.coalesce("places", F.lit(0))) + prior).alias("weight"))
    edges = materialize(salted_join(pairs, materialize(counted, "places")), "edges")
    seed_score = [F.when(has_bit("seeds", k), MILLION).otherwise(0).cast("long").alias(f"s{k}") for k in range(4)]
    current, total = values.select("value", *seed_score), None
    for turn in range(rounds):
        with_scores = edges.select("*", *seed_score) if turn == 0 else edges.join(current, "value")
        confident = with_scores.groupBy("pattern").agg(*[F.when(F.count_if(F.col(f"s{k}") >= promoted) >= support, F.floor(F.sum(F.col("n") * F.col(f"s{k}")) / F.first("weight"))).otherwise(0).alias(f"c{k}") for k in range(4)])
        confident = materialize(confident.filter(" or ".join(f"c{k} > 0" for k in range(4))), "confident")
        reached = salted_join(edges, confident).groupBy("value").agg(*[F.max(F.floor(F.col(f"c{k}") * F.least(2 * F.col("n"), F.col("all")) / F.col("all"))).alias(f"r{k}") for k in range(4)])
        new = [F.when(has_bit("seeds", k), MILLION).when(has_bit("may", k), F.coalesce(f"r{k}", F.lit(0))).otherwise(0).cast("long").alias(f"s{k}") for k in range(4)]
        current = materialize(values.join(reached, "value", "left").select("value", *new), "scores")
        was, total = total, current.agg(*[F.sum(f"s{k}") for k in range(4)]).first()
        if was == total:
            break
    score = F.greatest(*[F.col(f"s{k}") for k in range(4)])
    return current.select("value", (F.array_position(F.array(*[f"s{k}" for k in range(4)]), score) - 1).cast("int").alias("best"), score.alias("score"))


def salted_join(pairs: DataFrame, patterns: DataFrame, salts: int = 16) -> DataFrame:
    """pairs with patterns' columns, by pattern; the pairs of a frequent pattern go to several tasks."""
    dealt = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int")).join(dealt, ["pattern", "salt"]).drop("salt")


def identified(docs: DataFrame, support: int = 3, prior: int = 1, promoted: int = 500_000, rounds: int = 5) -> DataFrame:
    """(row, doc_id, base, spans) for each row of docs: arrays of (kind as a number, start, end) by kind and start.

    The base patterns' matches are seeds. The one, two or three words before each mention are its patterns; a graph of
    patterns and values is scored in rounds (`scores`), and what only looks like an identifier (another number of six
    digits or more, another word with an @) is added to spans once its score reaches `promoted`. So a phrase after which
    mostly seeds come finds the numbers that come after it in other forms, and these make their other contexts known.

    Spark runs the graph: mentions of all documents are a table without texts, frequent patterns are joined in salted
    parts, and patterns' places are counted in a second pass over all texts behind a bitmap of 16 MB at most.

    Null texts are empty and have no spans. A long text is scanned as a whole in linear time. A mention that stands inside
    a longer word has no patterns. Repeated rows each get their row and count each time; null doc_ids stay. Of two kinds with
    one score the first listed is taken. An empty table gives no rows. Other columns are ignored.
    """
    text_batches(docs.sparkSession)
    rows = mentions(docs)
    named = rows.select("row", F.inline("found"))
    judged = scores(named, docs, support, prior, promoted, rounds)
    found = named.filter("seed IS NULL").join(judged.filter(F.col("score") >= promoted), "value")
    found = found.groupBy("row").agg(F.collect_list(F.struct(F.col("best").alias("kind"), "start", "end")).alias("added"))
    base = F.transform(F.filter("found", lambda m: m["seed"].isNotNull()), lambda m: F.struct(m["seed"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    both = rows.select("row", "doc_id", base.alias("base")).join(found, "row", "left")
    return both.select("row", "doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))).alias("spans"))


def joined(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])))


def private_spans(docs: DataFrame) -> DataFrame:
    """identified's spans, one row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = {k})")).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return identified(docs).select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
