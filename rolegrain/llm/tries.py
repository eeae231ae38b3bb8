"""Conversation prefix tries: rebuilt conversations, tries of hash partitions, and spines for what is too large for one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegrain.llm.shared import materialize, parts

#: Bits of monotonically_increasing_id that count rows within a partition.
ROW_BITS = 33
#: Turns of the block's first conversation that a conversation may begin with, and conversations in a block.
MOST_BORROWED, BLOCK = 5, 100
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def digest(*values: Column) -> Column:
    """16 bytes of the SHA-256 of the values, each after its length."""
    return F.substring(F.unhex(F.sha2(F.concat(*[F.concat(F.length(v).cast("string"), F.lit(":"), v) for v in values]), 256)), 1, 16)


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, row, turn_digest, chars): a short row per turn, in order within and across parts. A range sort
    deals one conversation's turns to as many parts as they need; texts are read once and not shuffled."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    short = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest(role, text).alias("turn_digest"), F.length(text).cast("long").alias("chars"))
    short = materialize(short, "turn_digests")
    ordered = short.repartitionByRange("conv_id", "turn", "turn_digest").sortWithinPartitions("conv_id", "turn", "turn_digest")
    ordered = ordered.withColumn("id", F.monotonically_increasing_id())
    return materialize(ordered.select("conv_id", F.shiftright("id", ROW_BITS).alias("part"), F.col("id").bitwiseAND((1 << ROW_BITS) - 1).alias("row"), "turn_digest", "chars"), "turns")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: gid, conv_id, depth, turn_digest, chars; convs: conv_id, n_turns). gid is the digest of the first turn."""
    turns = turns_in_order(conversations)
    before = Window.partitionBy("conv_id").orderBy("part")
    spans = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    spans = spans.withColumn("offset", F.sum("n").over(before) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("conv_id")))
    spans = materialize(spans, "spans")  # a row per conversation and part
    block = F.col("conv_id") - F.col("conv_id") % BLOCK
    convs = spans.filter("offset = 0").select("conv_id", "total", block.alias("block"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_BORROWED + 1)).alias("h"))
    heads = convs.filter("conv_id = block").select("block", F.col("total").alias("there"))
    convs = convs.join(heads, "block", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0)))).drop("there")
    position = F.col("row") - F.col("first") + F.col("offset") + 1
    placed = turns.join(spans.join(convs.select("conv_id", "h", "k"), "conv_id"), ["conv_id", "part"])
    placed = materialize(placed.select("conv_id", "part", position.alias("position"), (position - F.col("h") + F.col("k")).alias("depth"), (position > F.col("h")).alias("own"), "h", "turn_digest", "chars"), "placed")
    head = placed.filter((F.col("conv_id") == block) & (F.col("position") <= MOST_BORROWED))
    head = head.groupBy(F.col("conv_id").alias("block")).agg(F.array_sort(F.collect_list(F.struct("position", "turn_digest", "chars"))).alias("head"))
    starts = placed.filter("position = h + 1").select("conv_id", F.col("turn_digest").alias("start"))
    gid = F.when(F.col("k") > 0, F.col("head")[0]["turn_digest"]).otherwise(F.col("start"))
    known = materialize(convs.join(head, "block", "left").join(starts, "conv_id", "left").select("conv_id", "k", (F.col("k") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("n_turns"), gid.alias("gid"), F.slice("head", 1, F.col("k").cast("int")).alias("borrowed")), "convs")
    own = placed.filter("own").join(spans.select("conv_id", "part").join(known.select("conv_id", "gid"), "conv_id"), ["conv_id", "part"]).select("gid", "conv_id", "depth", "turn_digest", "chars")
    taken = known.select("gid", "conv_id", F.inline("borrowed")).select("gid", "conv_id", F.col("position").alias("depth"), "turn_digest", "chars")
    return materialize(own.union(taken), "rebuilt"), known.select("conv_id", "n_turns")


def subtries(frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a partition's tries: children are pointers by (node, turn). A node is made after its parent, so
    going back over them is a postorder."""
    at: dict[tuple[int, bytes], int] = {}
    first, up, depth, chars, members, tops, ends = [], [], [], [], [], [], {}
    order = np.lexsort((frame.depth.to_numpy(), frame.conv_id.to_numpy()))
    columns = [frame[c].to_numpy()[order] for c in ("conv_id", "depth", "turn_digest", "chars", "gid")]
    node, last = -1, None
    for conv, level, turn, length, gid in zip(*(c.tolist() for c in columns)):
        if conv != last:
            if node >= 0:
                ends.setdefault(node, []).append(last)
            node, last = -1, conv
        key = (node, turn if node >= 0 else gid)
        child = at.get(key)
        if child is None:
            child = at[key] = len(first)
            first.append(conv), up.append(node), depth.append(level), chars.append(length), members.append(0), tops.append(gid if node < 0 else None)
        members[child] += 1
        node = child
    if node >= 0:
        ends.setdefault(node, []).append(last)
    children, leaves, saved = [0] * len(first), [0] * len(first), [0] * len(first)
    for i in range(len(first) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saved[i] += (members[i] - 1) * chars[i]
        if up[i] >= 0:
            children[up[i]] += 1
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
    sha = [hashlib.sha256(",".join(map(str, ends[i])).encode()).hexdigest() if i in ends else NO_ENDS for i in range(len(first))]
    parents = pd.array([first[p] if p >= 0 else None for p in up], dtype="Int64")
    return pd.DataFrame({"conv_id": first, "depth": depth, "parent_conv_id": parents, "n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": sha, "gid": tops})


def small_tries(turns: DataFrame, rows: int, most: int) -> DataFrame:
    """Nodes of all subtries of turns, dealt to tasks by hash of gid; gid stays with the top nodes."""
    deals = max(parts(turns.sparkSession), -(-4 * rows // most))
    bucket = F.pmod(F.xxhash64("gid"), F.lit(deals))
    return materialize(turns.groupBy(bucket.alias("bucket")).applyInPandas(subtries, f"{NODE}, gid binary"), "tries")


def hashes_of_ends(ends: DataFrame) -> DataFrame:
    """(gid, depth, sha): ids of each node in order through one running hash; a node's ids are never held together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            done = []
            for gid, depth, conv in zip(frame.gid.tolist(), frame.depth.tolist(), frame.conv_id.tolist()):
                if (gid, depth) != key:
                    if state:
                        done.append((*key, state.hexdigest()))
                    key, state = (gid, depth), hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield pd.DataFrame(done, columns=["gid", "depth", "sha"])
        if state:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["gid", "depth", "sha"])

    ordered = ends.select("gid", "depth", "conv_id").repartition("gid", "depth").sortWithinPartitions("gid", "depth", "conv_id")
    return ordered.mapInPandas(run, "gid binary, depth long, sha string")


def peel(large: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spine, rest, branches) of subtries that are too large for one task. One conversation of each is the spine;
    every other one follows it for some turns and then goes to the branch named by the turn that is next.

    spine: gid, depth, chars, n_convs, conv_id, sha, last (nothing deeper on it), alone (only the spine's own
    conversation is there); rest: the turns that are left, under their branch's gid; branches: gid, depth (of the top), up."""
    pick = large.groupBy("gid").agg(F.min_by("conv_id", F.xxhash64("conv_id", F.lit(turn))).alias("conv_id"))
    pivots = materialize(large.join(pick, ["gid", "conv_id"]).select("gid", "depth", F.col("turn_digest").alias("there"), "chars", "conv_id"), "pivots")
    met = large.join(pivots.select("gid", "depth", "there"), ["gid", "depth"], "left")
    off = F.min(F.when(~F.col("turn_digest").eqNullSafe(F.col("there")), F.struct("depth", "turn_digest")))
    paths = met.groupBy("gid", "conv_id").agg(off.alias("off"), F.max("depth").alias("longest"))
    branch = F.when(F.col("off").isNotNull(), digest(F.hex("gid"), F.col("off.depth").cast("string"), F.hex("off.turn_digest")))
    paths = materialize(paths.select("gid", "conv_id", F.coalesce(F.col("off.depth") - 1, "longest").alias("stay"), F.col("off.depth").alias("leaves_at"), branch.alias("branch")), "paths")
    # Beyond the last turn shared with another, the spine is one conversation's: no sums are needed there.
    shared = paths.join(pick.withColumnRenamed("conv_id", "pivot"), "gid").groupBy("gid").agg(F.max(F.when(F.col("conv_id") != F.col("pivot"), F.col("stay"))).alias("shared"), F.max(F.when(F.col("conv_id") == F.col("pivot"), F.col("stay"))).alias("length"))
    down = Window.partitionBy("gid").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    stays = paths.join(shared, "gid").groupBy("gid", F.least("stay", F.coalesce("shared", F.lit(0))).alias("depth")).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    marked = pivots.join(shared, "gid").withColumn("alone", F.col("depth") > F.coalesce("shared", F.lit(0))).withColumn("last", F.col("depth") == F.col("length"))
    together = marked.filter("not alone").join(stays, ["gid", "depth"], "left").withColumns({"n_convs": F.coalesce(F.sum("n").over(down), F.lit(0)), "conv_id": F.min("least").over(down)})
    columns = ["gid", "depth", "chars", "n_convs", "conv_id", "last", "alone"]
    spine = together.select(*columns).union(marked.filter("alone").withColumn("n_convs", F.lit(1).cast("long")).select(*columns))
    ends = hashes_of_ends(paths.filter("branch IS NULL").select("gid", F.col("stay").alias("depth"), "conv_id"))
    spine = materialize(spine.join(ends, ["gid", "depth"], "left").withColumn("sha", F.coalesce("sha", F.lit(NO_ENDS))), "spine")
    rest = large.join(paths.filter("branch IS NOT NULL").select("gid", "conv_id", "leaves_at", "branch"), ["gid", "conv_id"]).filter("depth >= leaves_at")
    rest = materialize(rest.select(F.col("branch").alias("gid"), "conv_id", "depth", "turn_digest", "chars"), "rest")
    branches = paths.filter("branch IS NOT NULL").select(F.col("branch").alias("gid"), F.col("gid").alias("up"), F.col("leaves_at").alias("depth")).distinct()
    return spine, rest, materialize(branches, "branches")


def spine_nodes(spine: DataFrame, branches: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes of the spines, when those of their branches are known: sums go up a spine by a window over its shared part."""
    hung = branches.join(tops.select("gid", "n_leaves", "saved_tokens"), "gid")
    hung = hung.groupBy(F.col("up").alias("gid"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_hung"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    above = spine.select("gid", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    rows = spine.join(hung, ["gid", "depth"], "left").join(above, ["gid", "depth"], "left").fillna(0, ["n_hung", "leaves", "saved"])
    rows = rows.withColumn("n_children", F.col("n_hung") + F.when(F.col("last"), 0).otherwise(1))
    down = Window.partitionBy("gid").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    # Where a lone end follows the shared part, its one leaf is counted at the end of that part.
    tail = spine.filter("alone").select("gid").distinct().withColumn("tail", F.lit(1))
    whole = rows.filter("not alone").join(tail, "gid", "left").withColumn("deepest", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("depth"))) == 1)
    own = F.when(F.col("n_children") == 0, 1).when(F.col("deepest") & F.col("tail").isNotNull(), 1).otherwise(0)
    whole = whole.withColumns({"n_leaves": F.sum(own + F.col("leaves")).over(down), "saved_tokens": F.sum((F.col("n_convs") - 1) * F.col("chars") + F.col("saved")).over(down)})
    lone = rows.filter("alone").withColumns({"n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long")})
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("sha").alias("ends_sha256"), F.when(F.col("parent_conv_id").isNull(), F.col("gid")).alias("gid")]
    return materialize(whole.select(*columns).union(lone.select(*columns)), "spine_nodes")


def prefix_trie(conversations: DataFrame, most_turns: int | None = None) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are dealt to tasks by hash of their first turn's digest; a task builds dictionary tries of what it
    has (`subtries`). A first turn with more than most_turns turns under it is split further: one conversation of it,
    chosen by hash, is the spine, and all others go on by the turn at which they leave it, as first turns of the
    next round, until every part fits. By default that is twice a shuffle partition's share, from 2,000 to 100,000. The number of rounds follows the logarithm of the conversations under one turn
    and not their length. Turns travel as 16 bytes of SHA-256 and a length. A conversation that nothing else shares is never
    held in one task however long it is; the shared part of a spine goes through a sorted, spillable window.

    Null roles and texts are empty. Turns are ordered by turn, null first; those of one turn by their digest, and
    repeated rows are turns of their own. Rows with null conv_id take no part. conv_id % 100 has the sign of conv_id. A long
    text is digested in the JVM where it is read. An empty table gives no rows, not even a root. Other columns are ignored.
    """
    turns, convs = rebuilt(conversations)
    totals = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.sum("n_turns").alias("turns")).first()
    spark = conversations.sparkSession
    if not totals.n:
        return spark.createDataFrame([], NODE)
    most_turns = most_turns or min(100_000, max(2_000, 2 * totals.turns // parts(spark)))
    rounds = []
    while True:
        sizes = materialize(turns.groupBy("gid").agg(F.count("*").alias("n")), "sizes")
        seen = sizes.agg(F.sum(F.when(F.col("n") <= most_turns, F.col("n"))).alias("small"), F.count_if(F.col("n") > most_turns).alias("large")).first()
        large = sizes.filter(F.col("n") > most_turns).select("gid")
        tries = small_tries(turns.join(large, "gid", "left_anti") if seen.large else turns, seen.small or 0, most_turns)
        if not seen.large:
            rounds.append((tries, None, None))
            break
        spine, rest, branches = peel(materialize(turns.join(large, "gid", "left_semi"), "large"), len(rounds))
        rounds.append((tries, spine, branches))
        turns = rest
    nodes, tops, level = [], None, None
    for r, (tries, spine, branches) in reversed(list(enumerate(rounds))):
        level = tries if spine is None else tries.union(spine_nodes(spine, branches, tops))
        tops = level.filter("gid IS NOT NULL")
        if r:
            _, over, hung = rounds[r - 1]
            above = hung.join(over.select(F.col("gid").alias("up"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above")), ["up", "depth"]).select("gid", "above")
            level = level.filter("gid IS NULL").drop("gid").union(tops.join(above, "gid").withColumn("parent_conv_id", F.col("above")).drop("above", "gid"))
        else:
            level = level.withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(totals.least))).drop("gid")
        nodes.append(level)
    under = tops.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = hashes_of_ends(convs.filter("n_turns = 0").select(F.lit(b"").alias("gid"), F.lit(0).cast("long").alias("depth"), "conv_id")).agg(F.max("sha").alias("sha"))
    root = under.join(ends).select(
        F.lit(totals.least).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(totals.n).cast("long").alias("n_convs"), "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return reduce(DataFrame.union, [*nodes, root])
