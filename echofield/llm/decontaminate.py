"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Every benchmark item has a 128-bit SimHash over its five-word shingles. Documents are read as word positions in
one generated, code-generated stage; a window as long as an item is taken wherever the alignment of a shared
shingle puts one, since a window without a shared shingle has similarity 0. (A window between two such alignments
can be better only where passages are moved around; tests measure the share of brute force's matches that is found.)
Equal windows are one content from then on, so a passage that a third of all documents hold is compared once.

Contents are fingerprinted; content and item meet if their fingerprints differ in at most ``radius`` bits. The
index finds all such pairs: the bits are divided into ``BLOCKS`` blocks, and the radius into shares t with
sum(t + 1) = radius + 1, so two fingerprints within the radius differ in at most t bits in at least one block. Items are
stored under every value within t bits of their own in each block, contents look up their own value: an equi-join on
(length, block, value). Blocks of 18 or 19 bits and t = 3 let one unrelated pair in 43 through to the Hamming distance.
Candidates are verified exactly: weighted Jaccard similarity of the shingle counts of content and item.

A pair of similarity 0.8 shares 8 of 9 shingles, which turns 15 % of the bits on average (19.4 of 128, standard
deviation 4.1); the radius of 27 reaches 98 % of the pairs at the threshold and nearly all above 0.85.

Items are matched in blocks of at most ``BLOCK_SHINGLES`` shingles, so that what is broadcast is bounded however
large the benchmark is; each block is one pass over the documents. Everything else is joined by shuffle.

Defined results
    null or empty text, or fewer than five words: no shingle, so no match. The same holds for such items.
    a document shorter than an item: its only window is the whole document. Long texts are read whole.
    repeated rows, or several texts, of one doc_id (null too): reported once, at the best window; which of them go is
    decided text by text. Ties: the first window. null item_id: an ordinary value.
    empty tables: empty result. Other columns are not read, whatever their names, and pass through
    ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import workspace

SHINGLE = 5
BITS, BLOCKS, RADIUS = 128, 7, 27
SIMILARITY = 0.8
#: Shingles of benchmark items that are broadcast at once (about 50 MB as a hash relation).
BLOCK_SHINGLES = 500_000
#: Identities of contaminated documents (24 bytes each) are broadcast up to this many, beyond it joined by shuffle.
BROADCAST_BAD = 200_000

CONTENT, ITEM = ["length", "c1", "c2"], ["k1", "k2"]


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def identity(value: Column) -> tuple[Column, Column]:
    return F.xxhash64(value), F.xxhash64(F.lit(5), value)


def shingle_at(words: Column, at: Column) -> Column:
    """Hash of the five words from position ``at`` (from 0)."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(SHINGLE)])


def shingle_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Explodes column ``words`` into (keep..., words, pos, shingle)."""
    starts = rows.filter(F.size("words") >= SHINGLE).select(*keep, "words", F.posexplode("words").alias("pos", "word"))
    return starts.filter(F.col("pos") <= F.size("words") - SHINGLE).select(*keep, "words", "pos", shingle_at(F.col("words"), F.col("pos")).alias("shingle"))


# --- fingerprints and their index


def fingerprints(rows: DataFrame, keep: list[str]) -> DataFrame:
    """SimHash over column ``words``: (keep..., fp0, fp1). Each shingle votes as often as it occurs.

    A sum counts the votes of two bits, one in each half of a long.
    """
    halves = [F.xxhash64(F.lit(11 + w), "shingle").alias(f"mixed{w}") for w in range(BITS // 64)]
    shingles = shingle_rows(rows, keep).select(*keep, *halves)
    both = (1 << 32) | 1
    votes = [
        F.sum(F.shiftrightunsigned(f"mixed{w}", i).bitwiseAND(F.lit(both))).alias(f"v{w}_{i}") for w in range(BITS // 64) for i in range(32)
    ]
    counted = shingles.groupBy(*keep).agg(F.count(F.lit(1)).alias("votes"), *votes)

    def word(w: int) -> Column:
        # a bit is set where it has more than half of the votes, so where votes - 2 * count is negative
        def bits(v: Column, i: Column) -> Column:
            low, high = v.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(v, 32)
            sign = lambda n: F.shiftrightunsigned(F.col("votes") - n * 2, 63)
            return F.call_function("shiftleft", sign(low), i).bitwiseOR(F.call_function("shiftleft", sign(high), i + 32))

        parts = F.transform(F.array(*[f"v{w}_{i}" for i in range(32)]), bits)
        return F.aggregate(parts, F.lit(0).cast("long"), lambda all_bits, some: all_bits.bitwiseOR(some))

    return counted.select(*keep, *[word(w).alias(f"fp{w}") for w in range(BITS // 64)])


def shares(radius: int, n: int = BLOCKS) -> list[int]:
    """Bits that may differ in each block, so that the radius cannot be kept beyond all of them: sum(t + 1) = radius + 1."""
    return [(radius + 1) // n - 1 + (i < (radius + 1) % n) for i in range(n)]


def widths(n: int = BLOCKS) -> list[int]:
    edges = [BITS * i // n for i in range(n + 1)]
    return [b - a for a, b in zip(edges, edges[1:])]


def block_values(n: int = BLOCKS) -> Column:
    """The blocks of the bits of fp0 and fp1 as an array of (block, value)."""
    out, a = [], 0
    for i, width in enumerate(widths(n)):
        w, shift = divmod(a, 64)
        value = F.shiftrightunsigned(f"fp{w}", shift)
        if shift + width > 64:
            value = value.bitwiseOR(F.shiftleft(f"fp{w + 1}", 64 - shift))
        out.append(F.struct(F.lit(i).alias("block"), value.bitwiseAND(F.lit((1 << width) - 1)).alias("value")))
        a += width
    return F.array(*out)


def near_values(spark: SparkSession, radius: int) -> DataFrame:
    """(block, flips): every change within a block's share of the radius, a table of a fixed size."""
    out = None
    for i, (width, t) in enumerate(zip(widths(), shares(radius))):
        some = spark.range(1 << width).filter(F.bit_count("id") <= t).select(F.lit(i).alias("block"), F.col("id").alias("flips"))
        out = some if out is None else out.unionByName(some)
    return out


def index_hits(contents: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """Rows of the block join, a pair once for each block that finds it, with ``distance``.

    ``contents`` has CONTENT, fp0 and fp1, ``items`` ITEM, length, fp0 and fp1.
    """
    bits = [f"fp{w}" for w in range(BITS // 64)]
    look = contents.select(*CONTENT, *bits, F.inline(block_values()))
    stored = items.select(*ITEM, "length", *bits, F.inline(block_values())).join(F.broadcast(near_values(contents.sparkSession, radius)), "block")
    stored = stored.select(*ITEM, "length", *[F.col(b).alias(f"item_{b}") for b in bits], "block", F.col("value").bitwiseXOR(F.col("flips")).alias("value"))
    distance = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"item_{b}"))) for b in bits), F.lit(0))
    return look.join(stored.hint("merge"), ["length", "block", "value"]).select(*CONTENT, *ITEM, distance.alias("distance"))


# --- matching


def windows_of(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Item-sized windows of the documents: (doc_id, t1, t2, start, length, c1, c2, words), words being the window's.

    ``anchors`` has (shingle, at, n): an item's shingle, its position there and the item's number of words; it
    is broadcast, at most BLOCK_SHINGLES rows.
    """
    t1, t2 = identity(F.col("text"))
    key = ["doc_id", "t1", "t2"]
    read = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), words_of(F.col("text")).alias("words"))
    hits = shingle_rows(read, key).join(F.broadcast(anchors), "shingle")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.size("words") - F.col("n")))
    cut = hits.select(*key, start.alias("start"), F.col("n").alias("length"), "words").select(
        *key, "start", "length", F.slice("words", F.col("start") + 1, F.col("length")).alias("words")
    )
    c1, c2 = identity(F.col("words"))
    return cut.groupBy(*key, "start", "length").agg(F.first("words").alias("words")).withColumns({"c1": c1, "c2": c2})


def found_windows(docs: DataFrame, items: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, t1, t2, item_id, start, length, similarity): every verified window; (t1, t2) tell texts apart."""
    k1, k2 = identity(F.col("words"))
    named = items.select("item_id", words_of(F.col("text")).alias("words")).withColumns({"k1": k1, "k2": k2})
    named = workspace.written(named.filter(F.size("words") >= SHINGLE).distinct(), "items")
    read = named.select(*ITEM, "words", F.size("words").alias("length")).distinct()
    n_blocks = max(1, -(-shingle_rows(read, ITEM).count() // (BLOCK_SHINGLES // 2)))
    found = None
    for b in range(n_blocks):
        part = read.filter(F.pmod("k1", F.lit(n_blocks)) == b)
        anchors = shingle_rows(part, ["length"]).select("shingle", F.col("pos").alias("at"), F.col("length").alias("n")).distinct()
        some = windows_of(docs, anchors)
        found = some if found is None else found.unionByName(some)
    windows = workspace.written(found.dropDuplicates(["doc_id", "t1", "t2", "start", "length"]) if n_blocks > 1 else found, "windows")
    contents = workspace.written(windows.groupBy(*CONTENT).agg(F.first("words").alias("words")), "contents")
    hits = index_hits(fingerprints(contents, CONTENT), fingerprints(read, [*ITEM, "length"]), radius)
    near = workspace.written(hits.filter(F.col("distance") <= radius).select(*CONTENT, *ITEM).distinct(), "near-contents")
    looked_at = contents.join(near.select(*CONTENT).distinct().hint("merge"), CONTENT, "left_semi")
    counts = shingle_rows(looked_at, CONTENT).groupBy(*CONTENT, "shingle").agg(F.count(F.lit(1)).alias("cw"))
    sizes = looked_at.select(*CONTENT, (F.size("words") - SHINGLE + 1).alias("nw"))
    item_counts = shingle_rows(read, ITEM).groupBy(*ITEM, "shingle").agg(F.count(F.lit(1)).alias("ci"))
    shared = (
        near.join(counts.hint("merge"), CONTENT)
        .join(item_counts.hint("merge"), [*ITEM, "shingle"])
        .groupBy(*CONTENT, *ITEM)
        .agg(F.sum(F.least("cw", "ci")).alias("both"))
        .join(sizes.hint("merge"), CONTENT)
    )
    union = F.col("nw") + (F.col("length") - SHINGLE + 1) - F.col("both")
    verified = shared.withColumn("similarity", F.col("both") / union).filter(F.col("similarity") >= similarity)
    verified = verified.join(named.select(*ITEM, "item_id").hint("merge"), ITEM).select(*CONTENT, "item_id", "similarity")
    places = windows.select("doc_id", "t1", "t2", "start", *CONTENT)
    return places.join(verified.hint("merge"), CONTENT).select("doc_id", "t1", "t2", "item_id", "start", "length", "similarity")


def matches(docs: DataFrame, items: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, length, similarity): the best window of each contaminated document and item.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    best = F.max(F.struct("similarity", (-F.col("start")).alias("neg"), "length"))
    return found_windows(docs, items, radius, similarity).groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", (-F.col("best.neg")).alias("start"), F.col("best.length").alias("length"), F.col("best.similarity").alias("similarity")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents in which a benchmark item was found; (doc_id, text) tells documents apart."""
    bad = workspace.written(found_windows(docs.select("doc_id", "text"), items).select("doc_id", "t1", "t2").distinct(), "contaminated")
    if bad.count() <= BROADCAST_BAD:
        bad = F.broadcast(bad)
    t1, t2 = identity(F.col("text"))
    rows = docs.select(F.struct("*").alias("__doc"), t1.alias("__t1"), t2.alias("__t2"))
    here = F.col("__doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("__t1") == F.col("t1")) & (F.col("__t2") == F.col("t2"))
    return rows.join(bad, here, "left_anti").select("__doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: benchmark items in the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
