"""Language identification by nearest clustered centroids of TF-IDF n-gram vectors.

Texts become hashed byte bigram and trigram vectors of their letters (sublinear counts times inverse document
frequency, unit length). Each language has several centroids from spherical k-means; a text takes the language
of the centroid of greatest cosine. A text farther from its centroid than nearly all of that centroid's own
training texts is marked ``rejected``.

Document frequencies cover all training rows; centroids are fitted on at most ``per_lang`` different texts a
language (those of the smallest hashes) that hold letters. A text is counted in slices, so memory does not grow
with its length.

Defined results
    null text, or a text without letters: ``und``, score 0, rejected.
    letters but nothing learned (no training row): ``und``, score 0, rejected.
    ties: the centroid first in order of language. repeated rows, null doc_ids: each gets its result.
    very long texts: read whole. empty table: empty. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

DIMS = 4096
SLICE = 1 << 20
PER_LANG, CLUSTERS = 600, 3
#: Hash draws are whole numbers below this.
SCALE = 1 << 40


def gram_counts(raw: bytes) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams over runs of letters (ASCII letters and bytes from 128)."""
    letters = np.zeros(256, np.uint32)
    letters[97:123] = np.arange(97, 123)
    letters[128:] = np.arange(128, 256)
    total = np.zeros(DIMS, np.int64)
    text = np.concatenate((np.zeros(1, np.uint8), np.frombuffer(raw, np.uint8), np.zeros(2, np.uint8)))
    for at in range(0, len(text) - 2, SLICE):
        a = letters[text[at : at + SLICE + 2]]
        two = a[:-2] * 256 + a[1:-1]
        three = two * 256 + a[2:]
        codes = np.concatenate((two[(a[:-2] > 0) | (a[1:-1] > 0)], three[a[1:-1] > 0] + np.uint32(1 << 24)))
        mixed = codes * np.uint32(2654435761)
        total += np.bincount((mixed ^ (mixed >> np.uint32(15))) >> np.uint32(20), minlength=DIMS)
    return total


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32)


def _lowered(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    for text in pc.utf8_lower(pc.fill_null(column, "")):
        yield text.as_buffer().to_pybytes()


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows each hashed n-gram occurs, and the number of rows."""

    def count(batches):
        total, rows = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for raw in _lowered(batch.column(0)):
                total += gram_counts(raw) > 0
                rows += 1
        yield pa.RecordBatch.from_pydict({"gram": np.arange(DIMS + 1, dtype=np.int32), "n": np.append(total, rows)})

    got = docs.select("text").mapInArrow(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for r in got:  # DIMS + 1 rows
        out[r.gram] = r.n
    return out[:-1], int(out[-1])


def clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the row nearest the mean and then the farthest rows."""
    mean = vectors.mean(axis=0)
    chosen = [int((vectors @ mean).argmax())]
    while len(chosen) < min(k, len(vectors)):
        far = (vectors @ vectors[chosen].T).max(axis=1)
        far[chosen] = 2
        chosen.append(int(far.argmin()))
    centres = vectors[chosen]
    for _ in range(rounds):
        near = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[near == j].sum(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres.astype(np.float32)


@dataclass(frozen=True)
class CentroidModel:
    idf: np.ndarray
    centres: np.ndarray
    langs: tuple[str, ...]
    reach: np.ndarray

    def predict(self, raw: bytes) -> tuple[str, float, bool]:
        v = unit(gram_counts(raw), self.idf)
        cos = self.centres @ v
        j = int(cos.argmax())
        return self.langs[j], float(min(1.0, max(0.0, cos[j]))), bool(cos[j] < self.reach[j])


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG, k: int = CLUSTERS) -> CentroidModel:
    """Learn from rows of (text, lang); nothing else is read."""
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    df, n = document_frequencies(docs)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # a hash threshold leaves about twice the wanted rows of each language, whatever the input's size;
    # only these few are ranked
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    cutoff = sizes.select("lang", F.least(F.lit(float(SCALE)), F.lit(2.0 * SCALE * per_lang) / F.col("n")).alias("cutoff"))
    draw = F.pmod(F.xxhash64("text"), F.lit(SCALE))
    drawn = docs.withColumn("draw", draw).join(F.broadcast(cutoff), "lang").filter(F.col("draw") <= F.col("cutoff"))
    different = drawn.select("lang", "draw", "text").filter(has_letter()).distinct()
    order = Window.partitionBy("lang").orderBy("draw", F.xxhash64(F.lit(5), "text"))
    keyed = different.select("lang", "text", F.row_number().over(order).alias("rank"))
    chosen = keyed.filter(F.col("rank") <= per_lang).drop("rank")

    def vectors(batches):
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), _lowered(batch.column(1))):
                counts = gram_counts(raw)
                at = np.flatnonzero(counts)
                if not len(at):  # a vector of zeros is far from every centroid and would become one
                    continue
                yield pa.RecordBatch.from_pydict({"lang": [lang], "at": [at.astype(np.int32)], "n": [counts[at]]}, schema=pa.schema([("lang", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))]))

    by_lang: dict[str, list[np.ndarray]] = {}
    for r in sorted(chosen.mapInArrow(vectors, "lang string, at array<int>, n array<bigint>").collect(), key=lambda r: (r.lang, r.at, r.n)):
        counts = np.zeros(DIMS, np.int64)
        counts[r.at] = r.n
        by_lang.setdefault(r.lang, []).append(unit(counts, idf))
    centres, langs, reach = [], [], []
    for lang in sorted(by_lang):
        v = np.stack(by_lang[lang])
        c = clusters(v, k)
        near = (v @ c.T).argmax(axis=1)
        for j in range(len(c)):
            own = (v[near == j] @ c[j]) if (near == j).any() else np.zeros(1)
            centres.append(c[j])
            langs.append(lang)
            reach.append(0.8 * float(np.quantile(own, 0.01)))
    return CentroidModel(idf, np.stack(centres) if centres else np.zeros((0, DIMS), np.float32), tuple(langs), np.array(reach))


def identify(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row."""

    def predict(batches):
        for batch in batches:
            got = [
                model.predict(raw) if letter and model.langs else ("und", 0.0, True)
                for raw, letter in zip(_lowered(batch.column(1)), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", has_letter().alias("has_letter"))
    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out() -> Column:
    """Rows that nothing may be learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the language of every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
