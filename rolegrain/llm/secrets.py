"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegrain.llm.shared import materialize

# The base patterns, in the order that breaks ties between spans with one start.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
#: A stretch that may be a credential of no named kind; it needs a digit, a letter and ten different characters.
OPAQUE = "[A-Za-z0-9+/_=-]{20,}"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "live": OPAQUE}

MARK = "\x01"
NAMES = list(KINDS)
#: Spans are masked within blocks of so many code points.
BLOCK = 4096


def pieces_of(text: Column, kind: str) -> Column:
    """array of (length, hash): text as what lies between matches and the matches in turn. The second, fourth and so on
    are the leftmost non-overlapping matches; hash is that of the secret if it passes the kind's condition, else null.

    Matches are fenced with a mark (one in the text becomes another character that no pattern takes, so
    lengths stay); Spark counts code points. A text without a match has no pieces."""
    pattern = KINDS[kind]
    if kind == "assign":
        secret, passes = (lambda x: F.regexp_extract(x, ASSIGN, 2)), (lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= 12)
    elif kind == "live":
        secret = lambda x: x
        passes = lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(x, ""))) >= 10)
    else:
        secret, passes = (lambda x: x), (lambda x: F.lit(True))
    fenced = F.split(F.regexp_replace(F.translate(text, MARK, "\x02"), pattern, f"{MARK}$0{MARK}"), MARK, -1)
    each = F.transform(fenced, lambda x, i: F.struct(F.length(x).alias("length"), F.when((i % 2 == 1) & passes(x), F.sha2(secret(x), 256)).alias("hash")))
    return F.when(text.rlike(pattern), each)


def scan(docs: DataFrame, owner: str, repository: list[str]) -> DataFrame:
    """A row without text per document, written once: id (its own), doc_id, text_hash, owner, repository, the pieces of
    each kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(owner).cast("string").alias("owner"), F.concat_ws("/", *[F.col(c).cast("string") for c in repository]).alias("repository"),
        *[pieces_of(text, kind).alias(kind) for kind in KINDS],
    )
    return materialize(found.withColumn("id", F.monotonically_increasing_id()), "secret_scan")


def candidates(found: DataFrame) -> DataFrame:
    """(id, owner, repository, rank, start, end, hash) of each base span, and of each opaque stretch that no base span
    touches. Ends are running sums over a text's pieces. A stretch is touched if a base span that starts no later
    ends behind its start, or the next base span starts before its end: two running windows, no pairs."""
    of_kind = [found.filter(F.col(kind).isNotNull()).select("id", "owner", "repository", F.lit(rank).alias("rank"), F.posexplode(kind).alias("at", "piece")) for rank, kind in enumerate(NAMES)]
    pieces = reduce(DataFrame.union, of_kind).select("id", "owner", "repository", "rank", "at", "piece.*")
    so_far = Window.partitionBy("id", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    spans = pieces.withColumn("end", F.sum("length").over(so_far).cast("int")).filter("hash IS NOT NULL").withColumn("start", F.col("end") - F.col("length"))
    base, first = F.col("rank") < F.lit(NAMES.index("live")), Window.partitionBy("id")
    reaches = F.max(F.when(base, F.col("end"))).over(first.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    follows = F.min(F.when(base, F.col("start"))).over(first.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    free = ~F.coalesce((reaches > F.col("start")) | (follows < F.col("end")), F.lit(False))
    return materialize(spans.withColumn("free", free).filter(base | F.col("free")).select("id", "owner", "repository", "rank", "start", "end", "hash"), "secret_candidates")


def judged(spans: DataFrame, max_owners: int) -> DataFrame:
    """spans with n_owners and n_repositories that hold their value, live (max_owners owners or fewer) and stays (a base
    span, or live)."""
    holders = spans.select("hash", "owner", "repository").distinct()
    by_owner = holders.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    owned = by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))
    live = F.col("n_owners") <= max_owners
    return spans.join(owned, "hash").withColumn("live", live).withColumn("stays", live | (F.col("rank") < NAMES.index("live")))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    names = F.array(*map(F.lit, NAMES))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])))


def secret_spans(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owner_specific,
    n_widely_copied, most_repositories.

    Candidate values (of base spans and opaque stretches) go by their SHA-256 only. A value in the texts of
    more than max_owners owners is a widely copied example; another is live-looking, and where it is an
    opaque stretch its span is added with the kind `live`. Base spans stay whatever their class.

    Null text is empty, null owners and repositories count as one owner and as the empty part. Repeated rows
    each get their row. Spans with one start go by kind as listed. A long text is scanned as a whole, and its spans
    are ordered by windows, in time that follows their number. An empty table gives no rows. Other columns are ignored.
    """
    found = scan(docs, owner, list(repository))
    place = F.struct("start", "rank", "end")
    of_kind = [F.count_if(F.col("rank") == k).alias(f"n_{kind}") for k, kind in enumerate(NAMES[:-1])]
    by_row = judged(candidates(found), max_owners).groupBy("id").agg(
        *of_kind, F.collect_list(F.when(F.col("rank") < NAMES.index("live"), place)).alias("base"), F.collect_list(F.when(F.col("stays"), place)).alias("spans"),
        F.count_if("live").alias("n_owner_specific"), F.count_if(~F.col("live")).alias("n_widely_copied"), F.max("n_repositories").alias("most_repositories"),
    )
    zero = [f"n_{kind}" for kind in NAMES[:-1]]
    counts = ["n_owner_specific", "n_widely_copied", "most_repositories"]
    return found.select("id", "doc_id").join(by_row, "id", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
        F.sha2(F.coalesce(joined(F.col("base")), F.lit("")), 256).alias("base_sha256"), F.coalesce(joined(F.col("spans")), F.lit("")).alias("spans"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
    )


def redact(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = 2, mask: str = "[secret]") -> DataFrame:
    """docs with each span of secret_spans replaced in text by mask (overlapping spans by one). Documents
    without a candidate pass untouched and are not shuffled.

    Null text stays null, null owners and repositories count as in secret_spans. Rows equal in doc_id and text are masked
    alike. A long text is masked by blocks of 4096 code points, in time that follows its length. An empty table stays
    empty; columns keep their names, whatever they are."""
    columns = docs.columns
    hit = F.coalesce(F.col("text").rlike("|".join(f"(?:{p})" for p in KINDS.values())), F.lit(False))
    found = scan(docs.filter(hit), owner, list(repository))
    stay = judged(candidates(found), max_owners).filter("stays")
    # Spans that overlap become one; then each is cut at the blocks' bounds, and the mask goes where it starts.
    before = Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True))
    groups = stay.withColumn("opens", opens).withColumn("group", F.count_if("opens").over(Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    whole = groups.groupBy("id", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cut = whole.select("id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))).alias("block"))
    low = F.col("block") * BLOCK
    parts = cut.select("id", "block", F.struct((F.greatest(F.col("start"), low) - low).cast("int").alias("start"), (F.least(F.col("end"), low + BLOCK) - low).cast("int").alias("end"), (F.col("start") >= low).alias("shown")).alias("part"))
    by_block = parts.groupBy("id", "block").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    by_text = by_block.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("block", "parts"))).alias("blocks"))
    known = materialize(found.select("id", "doc_id", "text_hash").join(by_text, "id").drop("id").dropDuplicates(["doc_id", "text_hash"]), "secret_spans")
    rows = docs.filter(hit).select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64("text") == F.col("r.text_hash"))
    both = rows.join(known.alias("r"), same, "left").select("row", "text", "blocks")

    def masked(block: Column, parts: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            between = F.substring(block, acc["at"] + 1, s["start"] - acc["at"])
            return F.struct(s["end"].alias("at"), F.concat(acc["out"], between, F.when(s["shown"], F.lit(mask)).otherwise(F.lit(""))).alias("out"))

        done = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(block, acc["at"] + 1, F.lit(BLOCK))))
        return F.coalesce(done, block)

    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    new = F.array_join(F.transform(blocks, lambda b, k: masked(b, F.try_element_at(F.col("blocks"), k.cast("long")))), "")
    text = F.when(F.col("blocks").isNull(), F.col("text")).otherwise(new)
    return docs.filter(~hit).unionByName(both.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in columns]))
