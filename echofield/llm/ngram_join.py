"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. Every text is normalised to its lower-cased words; equal word sequences are one node (a 128-bit digest),
   so exact copies, however many, cost one row from here on.
2. Each node's five-word shingles give a MinHash signature, divided into bands. Rows a band and bands are chosen
   so that a pair at the threshold shares a band with the target probability.
3. Nodes are shuffled on band hashes. Bands with the same members are one bucket. A bucket is divided into blocks;
   in each, sketches, a byte for each MinHash, are compared around leaders: a member is covered by a leader that
   nearly equals it, and every member within reach of a leader is tied to it. The leaders of a bucket of several blocks
   are then compared in pairs of blocks. By the triangle inequality two members at the threshold end up tied through
   the leaders that cover them, while dissimilar members of a bucket stay apart, so shared boilerplate does not chain
   documents together. A bucket of near copies has few leaders, so it costs about its size, not its square.
4. Tied nodes form candidate groups. A group is divided into blocks bounded in nodes and shingles; each pair of
   blocks is one unit of work that holds at most two blocks of full shingle sets, counts what each two sets share (rare
   shingles pair by pair, common ones by matrix products over slices of columns), and returns for each node its number
   of verified links and a spanning forest of the links, so no more rows than nodes.
5. Connected components of the verified links are the classes.

Defined results
    one to four words: one shingle of all words. No word (null, empty, punctuation): no shingle, no link;
    such documents are copies of each other and share a class.
    repeated rows, and equal doc_ids on different texts: a row each; a class is told by its ``class_node``, and
    class_id is its smallest doc_id. null doc_id: an ordinary row; a class of such rows only has class_id null.
    empty table: empty result. Long texts are read whole, in slices of bounded memory.
    extra columns are not read by ``classify`` and pass through ``keep_one``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import workspace

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.9999
MAX_HASHES = 192
#: A block of a candidate group has about so many nodes, and so many shingles, at most.
BLOCK, BLOCK_SHINGLES = 1024, 600_000
#: Smaller groups are divided too, into blocks of this many nodes, up to this many blocks, to spread their work.
SPREAD_NODES, SPREAD_BLOCKS = 64, 16
#: Members of a bucket whose sketches are compared in one unit of work.
SKETCH_BLOCK = 512
#: Candidate nodes (16 bytes each) are broadcast up to this many, beyond it they are joined by shuffle.
BROADCAST_NODES = 200_000
#: Words hashed at once; columns of a dense product and pairs counted at once; shingles of more owners are dense.
SLICE, COLUMNS, PAIRS, DENSE_OWNERS = 400_000, 2048, 1 << 20, 32


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective bands that reach the recall with at most ``max_hashes`` hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        hit = similarity**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


def normalised(text: Column) -> Column:
    """Lower-cased runs of letters and digits, separated by one space."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def node_of(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shift and multiply, twice."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """64-bit hashes of word shingles, from prefix sums of a polynomial hash over the bytes."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.table = _mix(np.arange(1, 257, dtype=np.uint64))
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 2 * len(self.up))
            inverse = pow(self.BASE, -1, 1 << 64)
            self.up = np.cumprod(np.append(np.uint64(1), np.full(n, self.BASE, np.uint64)), dtype=np.uint64)
            self.down = np.cumprod(np.append(np.uint64(1), np.full(n, inverse, np.uint64)), dtype=np.uint64)

    def slices(self, raw: bytes) -> Iterator[np.ndarray]:
        """Shingle hashes in text order, for normalised bytes, a bounded slice at a time."""
        if not raw:
            return
        whole = np.frombuffer(raw, np.uint8)
        gaps = np.flatnonzero(whole == 32)
        starts = np.append(0, gaps + 1)
        ends = np.append(gaps, len(whole))
        width = min(SHINGLE, len(starts))
        for at in range(0, len(starts) - width + 1, SLICE):
            s = starts[at : min(at + SLICE, len(starts) - width + 1)]
            e = ends[at + width - 1 : at + width - 1 + len(s)]
            base = s[0]
            a = whole[base : e[-1]]
            self._powers(len(a))
            sums = np.zeros(len(a) + 1, np.uint64)
            np.cumsum(self.table[a] * self.up[: len(a)], dtype=np.uint64, out=sums[1:])
            yield _mix((sums[e - base] - sums[s - base]) * self.down[s - base] + (e - s).astype(np.uint64))

    def sets(self, raw: bytes) -> np.ndarray:
        parts = list(self.slices(raw))
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


class Signer:
    """Band hashes of a MinHash signature."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32)
        self.weights = _mix(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
        self.shingler = Shingler()

    def sign(self, raw: bytes) -> tuple[np.ndarray, bytes] | None:
        """Band hashes, and a byte for each MinHash."""
        least = None
        for hashes in self.shingler.slices(raw):
            h = (hashes >> np.uint64(32)).astype(np.uint32)
            for at in range(0, len(h), 256):
                part = (h[at : at + 256, None] * self.a + self.b).min(axis=0)
                least = part if least is None else np.minimum(least, part)
        if least is None:
            return None
        wide = _mix(least.reshape(self.bands, self.rows).astype(np.uint64) + self.weights)
        mixed = (wide * self.weights).sum(axis=1, dtype=np.uint64)
        bands = _mix(mixed + np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        return bands, (wide & np.uint64(255)).astype(np.uint8).tobytes()


def _cells(column: pa.Array) -> Iterator[bytes]:
    for cell in column:
        yield cell.as_buffer().to_pybytes()


def signatures(rows: DataFrame, bands: int, per_band: int) -> DataFrame:
    """(doc_id, t1, t2, node, size, bands, sketch) for rows of (doc_id, t1, t2, norm); size is about the number of words."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "t1", "t2", "node", "size", "bands", "sketch"]

    def sign(batches):
        signer = Signer(bands, per_band)
        for batch in batches:
            made = [signer.sign(raw) for raw in _cells(batch.column(5))]
            lists = pa.array([None if m is None else m[0].tolist() for m in made], pa.list_(pa.int64()))
            sketches = pa.array([None if m is None else m[1] for m in made], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], lists, sketches], names=names)

    spaces = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit("")))
    return rows.select("doc_id", "t1", "t2", node_of(F.col("norm")).alias("node"), spaces.cast("bigint").alias("size"), "norm").mapInArrow(
        sign, f"doc_id {kind}, t1 bigint, t2 bigint, node binary, size bigint, bands array<bigint>, sketch binary"
    )


#: Share of the allowed distance within which a leader covers a member.
COVER = 0.4


def reach(similarity: float, hashes: int, leaders: int) -> float:
    """Share of equal sketch bytes from which two rows are tied, with ``leaders`` leaders on the way between two members.

    With distances 1 - J: a leader is within 0.4 (1 - s) of a member that it covers, and two members within 1 - s of
    each other; five standard deviations of the estimate are allowed on top.
    """
    return max(0.0, 1 - (1 + COVER * leaders) * (1 - similarity) - 2.5 / math.sqrt(hashes))


def _ties(sketches: np.ndarray, left: np.ndarray, cover: float, tie: float) -> tuple[np.ndarray, list[int]]:
    """Root of each row, and the leaders: rows are tied to leaders among ``left``, which cover all of ``left``."""
    label = np.arange(len(sketches))
    open_rows = np.zeros(len(sketches), bool)
    open_rows[left] = True
    leaders = []
    for leader in left:
        if not open_rows[leader]:
            continue
        leaders.append(int(leader))
        same = (sketches == sketches[leader]).mean(axis=1)
        open_rows &= same < cover
        open_rows[leader] = False
        near = np.flatnonzero(same >= tie)
        label[np.isin(label, label[near])] = label[near].min()
    return label, leaders


UNIT = ["band", "lo", "hi"]
TIES = "node binary, other binary, band bigint, sketch binary"


def _tied(units: DataFrame, similarity: float, leaders: int) -> DataFrame:
    """TIES of rows (band, lo, hi, part, divided, node, sketch): ties, and leaders (other null) of divided buckets.

    ``leaders`` is 1 among members, 2 among leaders, each of which then stands for itself alone.
    """
    ordered = units.select(*UNIT, "part", "divided", "node", "sketch").repartition(*UNIT).sortWithinPartitions(*UNIT, "node")
    schema = pa.schema([("node", pa.binary()), ("other", pa.binary()), ("band", pa.int64()), ("sketch", pa.binary())])

    def compare(batches):
        unit, rows = None, []
        out: list[tuple] = []

        def done():
            divided = bool(rows) and rows[0][1]
            if len(rows) < 2 and not divided:
                return
            sketches = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
            left = np.flatnonzero(np.array([r[0] for r in rows]) < 2)
            cover = 1 - COVER * (1 - similarity) if leaders == 1 else 2.0
            label, chosen = _ties(sketches, left, cover, reach(similarity, sketches.shape[1], leaders))
            out.extend((rows[k][2], rows[label[k]][2], None, None) for k in range(len(rows)) if label[k] != k)
            if divided:
                out.extend((rows[k][2], None, unit[0], rows[k][3]) for k in chosen)

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            for *key, part, divided, node, sketch in zip(*[c.to_pylist() for c in batch.columns]):
                if key != unit:
                    done()
                    unit, rows = key, []
                rows.append((part, divided, node, sketch))
            if out:
                yield flush()
        done()
        if out:
            yield flush()

    return ordered.mapInArrow(compare, TIES)


def _block_of(n_blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), n_blocks.cast("long")).cast("int")


def similar_ties(nodes: DataFrame, similarity: float, block: int = SKETCH_BLOCK) -> DataFrame:
    """(node, other) ties of nodes that share a band and have similar sketches, from rows (node, bands, sketch).

    Ties connect any two nodes of one bucket whose similarity reaches the threshold; no more rows than members.
    """
    band_rows = nodes.filter(F.col("bands").isNotNull()).select("node", F.explode("bands").alias("band"))
    members = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"m{i}") for i in (1, 2)]
    buckets = band_rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *members).filter(F.col("n") > 1)
    buckets = buckets.groupBy("n", "m1", "m2").agg(F.min("band").alias("band"))
    shared = band_rows.join(buckets.select("band", "n"), "band")
    own = shared.groupBy("node").agg(F.collect_list(F.struct("band", "n")).alias("buckets"))
    n_blocks = F.ceil(F.col("b.n") / block).cast("int")
    placed = nodes.select("node", "sketch").join(own, "node").select("node", "sketch", F.explode("buckets").alias("b")).select(
        "node", "sketch", F.col("b.band").alias("band"), (n_blocks > 1).alias("divided"), _block_of(n_blocks).alias("lo")
    )
    found = workspace.written(_tied(placed.select("*", F.col("lo").alias("hi"), F.lit(0).alias("part")), similarity, 1), "ties", codec="none")
    ties = found.filter(F.col("other").isNotNull()).select("node", "other")
    leaders = found.filter(F.col("other").isNull()).select("band", "node", "sketch")
    if not leaders.limit(1).count():
        return ties
    sizes = leaders.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_blocks"))
    apart = leaders.join(sizes, "band").withColumn("block", _block_of(F.col("n_blocks"))).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    i, j = F.col("block"), F.col("to")
    pairs = apart.select(
        "band", F.least(i, j).alias("lo"), F.greatest(i, j).alias("hi"), F.when(i == j, 0).when(i < j, 1).otherwise(2).alias("part"), F.lit(False).alias("divided"), "node", "sketch"
    )
    return ties.unionByName(_tied(pairs, similarity, 2).select("node", "other"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (node, other): the smallest node of its component.

    Smallest labels spread along edges and are then looked up again at the label itself, which halves the
    distance in each round; each round is a written table.
    """
    both = edges.select("node", "other").unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
    both = workspace.written(both.distinct(), "edges", codec="none")
    labels = workspace.written(
        both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")), "labels", codec="none"
    )
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other")
            .groupBy("node")
            .agg(F.min("near").alias("near"))
        )
        step = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = workspace.written(
            step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels", codec="none"
        )
        moved = step.filter(F.col("old") != F.col("label")).limit(1).count()
        workspace.forget(labels)
        labels = step.select("node", "label")
        labels.written_path = step.written_path
        if not moved:
            workspace.forget(both)
            return labels


def _verify(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Boolean links between different sets at ``left`` and ``right``; shingles of one owner are not looked at."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    owner, starts = owner[order], np.concatenate(([0], np.cumsum(times)[:-1]))
    row, col = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros(len(left) * len(right), np.float32)
    for t in range(2, DENSE_OWNERS + 1):
        at = starts[times == t]
        for i in range(0, len(at), max(1, PAIRS // t**2)):
            owners = owner[at[i : i + max(1, PAIRS // t**2), None] + np.arange(t)]
            r, c = row[owners][:, :, None], col[owners][:, None, :]
            cell = (r * len(right) + c)[(r >= 0) & (c >= 0)]
            if len(cell):
                both += np.bincount(cell, minlength=len(both))
    both = both.reshape(len(left), len(right))
    common = np.flatnonzero(times > DENSE_OWNERS)
    for i in range(0, len(common), COLUMNS):
        some = common[i : i + COLUMNS]
        m = np.zeros((len(sets), len(some)), np.float32)
        m[owner[np.concatenate([np.arange(starts[k], starts[k] + times[k]) for k in some])], np.repeat(np.arange(len(some)), times[some])] = 1
        both += m[left] @ m[right].T
    sizes = np.array([len(s) for s in sets], float)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return (both >= similarity * union - 1e-6) & (both > 0)


def _forest(links: np.ndarray) -> np.ndarray:
    """Smallest member of each index's component, for a symmetric Boolean matrix."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified_links(members: DataFrame, similarity: float) -> DataFrame:
    """(node, links, texts, other) from rows (grp, part, n_copies, node, norm); ``part`` tells a unit's blocks apart.

    Rows of a unit must be adjacent in their partition. part 0: all pairs within; parts 1 and 2: pairs across.
    ``links`` counts linked documents, ``texts`` linked nodes, ``other`` is a node of the same component.
    """

    def check(batches):
        shingler = Shingler()
        unit, rows = None, []

        def done():
            if len(rows) < 2:
                return None
            part = np.array([r[0] for r in rows])
            sets = [shingler.sets(r[3]) for r in rows]
            n = len(rows)
            links = np.zeros((n, n), bool)
            if part[0] == 0:
                every = np.arange(n)
                links = _verify(sets, every, every, similarity)
                np.fill_diagonal(links, False)
            else:
                left, right = np.flatnonzero(part == 1), np.flatnonzero(part == 2)
                if len(left) and len(right):
                    across = _verify(sets, left, right, similarity)
                    links[np.ix_(left, right)] = across
                    links[np.ix_(right, left)] = across.T
            texts = links.sum(axis=1)
            documents = links @ np.array([r[1] for r in rows], np.int64)
            root = _forest(links)
            some = np.flatnonzero(texts)
            if not len(some):
                return None
            return pa.RecordBatch.from_pydict(
                {"node": [rows[i][2] for i in some], "links": documents[some], "texts": texts[some].astype(np.int64), "other": [rows[root[i]][2] for i in some]},
                schema=pa.schema([("node", pa.binary()), ("links", pa.int64()), ("texts", pa.int64()), ("other", pa.binary())]),
            )

        for batch in batches:
            for grp, part, copies, node, norm in zip(*[batch.column(i).to_pylist() for i in range(4)], _cells(batch.column(4))):
                if grp != unit:
                    if (out := done()) is not None:
                        yield out
                    unit, rows = grp, []
                rows.append((part, copies, node, norm))
        if (out := done()) is not None:
            yield out

    return members.select("grp", "part", "n_copies", "node", "norm").mapInArrow(check, "node binary, links bigint, texts bigint, other binary")


def candidate_groups(nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, label): the nodes that are tied to others, and the smallest node of each group."""
    # a node keeps a tie to its smallest other node and ties the rest to that one: the same groups, about one edge a node
    tied = similar_ties(nodes, similarity).groupBy("node").agg(F.array_sort(F.collect_set("other")).alias("others"))
    ends = F.concat(F.array("node"), F.slice("others", 2, F.greatest(F.size("others"), F.lit(1))))
    return components(tied.select(F.explode(ends).alias("node"), F.col("others")[0].alias("other")))


def text_identity(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(5), text).alias("t2")]


def classify(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, max_hashes: int = MAX_HASHES, block: int = BLOCK, spread: int = SPREAD_NODES) -> DataFrame:
    """(doc_id, t1, t2, node, class_node, class_id, n_links, n_texts, n_copies) for each row of (doc_id, text).

    class_node is the smallest node of the class, class_id its smallest doc_id, n_links the number of other documents
    that the document is linked to, copies included, n_texts the number of different texts among these that are not
    its own, n_copies the number of documents with its own words, itself included. (t1, t2) identify the text as it is.
    """
    bands, per_band = choose_bands(similarity, recall, max_hashes)
    read = docs.select("doc_id", *text_identity(F.col("text")), normalised(F.col("text")).alias("norm"))
    with workspace.small_batches(docs.sparkSession):
        signed = workspace.written(signatures(read, bands, per_band), "signatures", codec="none")
    made = [F.first(c).alias(c) for c in ("bands", "sketch", "size")]
    nodes = workspace.written(signed.groupBy("node").agg(*made, F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies")), "nodes", codec="none")
    groups = candidate_groups(nodes, similarity)
    spread_over = F.least(F.ceil(F.count(F.lit(1)) / spread), F.lit(SPREAD_BLOCKS))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / BLOCK_SHINGLES), spread_over, F.lit(1))
    grouped = groups.join(nodes.select("node", "size", "n_copies"), "node")
    sizes = grouped.groupBy("label").agg(blocks.cast("int").alias("n_blocks"), F.count(F.lit(1)).alias("n_nodes"))
    placed = workspace.written(
        workspace.spread_join(grouped, sizes, "label", "n_nodes", groups.count(), F.xxhash64("node")).select("node", "label", "n_copies", "n_blocks", F.pmod(F.xxhash64("node"), F.col("n_blocks").cast("long")).cast("int").alias("block")),
        "groups", codec="none"
    )
    wanted = placed.select("node")
    if placed.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    texts = (
        read.select(node_of(F.col("norm")).alias("node"), "norm")
        .join(wanted, "node", "left_semi")
        .groupBy("node")
        .agg(F.max("norm").alias("norm"))
    )
    i, j = F.col("block"), F.col("to")
    members = (
        placed.join(texts, "node")
        .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select(
            F.concat_ws("/", F.hex("label"), F.least(i, j), F.greatest(i, j)).alias("grp"),
            F.when(i == j, 0).when(i < j, 1).otherwise(2).alias("part"),
            "n_copies",
            "node",
            "norm",
        )
    )
    members = members.repartition("grp").sortWithinPartitions("grp", "node")
    with workspace.small_batches(docs.sparkSession):
        found = workspace.written(verified_links(members, similarity), "links", codec="none")
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("n_texts"))
    classes = components(found.select("node", "other"))
    labelled = nodes.select("node", "first_id", "n_copies").join(classes.join(links, "node"), "node", "left")
    labelled = labelled.select(
        "node",
        "first_id",
        "n_copies",
        F.coalesce("label", "node").alias("class_node"),
        (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
    )
    labelled = workspace.written(labelled, "classes", codec="none")
    workspace.forget(nodes, groups, placed, found, classes)
    n_nodes, n_rows = labelled.agg(F.count(F.lit(1)), F.sum("n_copies")).first()
    ids = labelled.groupBy("class_node").agg(F.min("first_id").alias("class_id"), F.count(F.lit(1)).alias("n_nodes"))
    per_node = workspace.spread_join(labelled, ids, "class_node", "n_nodes", n_nodes, F.xxhash64("node"))
    per_node = per_node.select("node", "class_node", "class_id", "n_links", "n_texts", "n_copies")
    rows = signed.select("doc_id", "t1", "t2", "node")
    # the place of a row in the written table, which is the same when a lost task runs again
    return workspace.spread_join(rows, per_node, "node", "n_copies", n_rows or 0, F.monotonically_increasing_id()).select(
        "doc_id", "t1", "t2", "node", "class_node", "class_id", "n_links", "n_texts", "n_copies"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class; columns as in ``docs``.

    The one of smallest doc_id stays, null doc_ids come last, ties of doc_ids go by digest; of rows that
    repeat both doc_id and text one stays. Only the (small) identities of what goes are joined with the documents.
    """
    found = workspace.written(classify(docs.select("doc_id", "text")), "classified", codec="none")
    key = ["doc_id", "t1", "t2"]
    units = found.groupBy("class_node", "node", *key).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node", "t1", "t2")
    keep = units.groupBy("class_node").agg(F.min(order).alias("k"), F.sum("n").alias("total")).filter(F.col("total") > 1)
    stays = F.col("k.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("k.t1") == F.col("t1")) & (F.col("k.t2") == F.col("t2"))
    away = workspace.spread_join(units, keep, "class_node", "total", found.count(), F.xxhash64(*key)).select(*key, stays.alias("stays"), "n").filter(~F.col("stays") | (F.col("n") > 1))
    away = workspace.written(away, "away", codec="none")
    rows = docs.select(F.struct("*").alias("__doc"), *[c.alias(f"__{n}") for c, n in zip(text_identity(F.col("text")), key[1:])])
    here = F.col("__doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("__t1") == F.col("t1")) & (F.col("__t2") == F.col("t2"))
    gone, repeated = away.select(*key), away.filter("stays").select(*key)
    n_gone, n_repeated = away.agg(F.count(F.lit(1)), F.count_if("stays")).first()
    if n_gone <= BROADCAST_NODES:
        gone, repeated = F.broadcast(gone), F.broadcast(repeated)
    kept = rows.join(gone, here, "left_anti").select("__doc.*")
    if n_repeated:
        one = rows.join(repeated, here, "left_semi").groupBy("__doc.doc_id", "__t1", "__t2").agg(F.first("__doc").alias("__doc"))
        kept = kept.unionByName(one.select("__doc.*"))
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: near-duplicate classes of all documents, and each document's number of links."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs).select("doc_id", "class_id", "n_links", "n_texts", "n_copies", F.hex("class_node").alias("class_key"))
