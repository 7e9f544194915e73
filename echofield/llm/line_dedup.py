"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of ``(h1, h2, docs)``, bucketed and sorted by the 128-bit key hash. Each batch of documents is
aggregated to one row a key (its only exchanges) and merge-anti-joins the runs of settled keys (already found in
``min_docs`` documents, so nothing more need be counted) and all levelled runs: keys that no run holds are the batch's
own run, keys sighted again are a small table of further counts beside it. Bucketed runs are joined without exchange
or sort. When a level holds ``fanout`` runs they and their sightings are merged into one run of
the next level, as in a log-structured merge tree; keys that reach the threshold there move to a settled run.
A batch thus reads each run once, in order, and there are at most ``fanout - 1`` runs a level.

Defined results
    null or empty text: one empty line; an empty key is never dropped.
    repeated rows, equal or null doc_ids: each row is a document, counts as one and is returned.
    very long texts: split whole, at a cost linear in their length.
    empty table: empty result. Extra columns pass through; columns of the result replace equal names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: Settled keys are broadcast up to this many rows (16 bytes each), beyond it they are merge-joined.
BROADCAST_KEYS = 100_000
#: Documents that lose lines (about 80 bytes each), and these lines (4 bytes each), are broadcast up to these numbers.
BROADCAST_HITS, BROADCAST_LINES = 200_000, 2_000_000


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at its ends and with A-Z lower-cased (by the faster function where all is ASCII)."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    """All lines, split at the line feed alone."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def identified(docs: DataFrame) -> DataFrame:
    """Two 64-bit hashes of (doc_id, text) that tell documents apart, and the whole row."""
    return docs.select(
        F.xxhash64("doc_id", "text").alias("d1"),
        F.xxhash64(F.lit(1), "text", "doc_id").alias("d2"),
        F.struct("*").alias("doc"),
    )


def line_table(docs: DataFrame) -> DataFrame:
    """One row for each line with a key: row number, document, position and 128-bit key hash.

    ``row`` tells rows of equal doc_id and text apart; it is fixed once the table is written.
    """
    key = F.col("key")
    return (
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.xxhash64("doc_id", "text").alias("d1"),
            F.xxhash64(F.lit(1), "text", "doc_id").alias("d2"),
            F.col("text"),
        )
        .select("row", "d1", "d2", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .select("row", "d1", "d2", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length(key) >= 1)
        .select("row", "d1", "d2", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))
    )


KEY = ["h1", "h2"]


@dataclass
class Run:
    """Keys that no earlier run held, and further sightings of keys that one did."""

    keys: DataFrame
    again: DataFrame | None = None

    def tables(self) -> list[DataFrame]:
        return [self.keys] if self.again is None else [self.keys, self.again]


@dataclass
class LineRuns:
    """The levelled runs. ``levels[i]`` lists the runs of level i; ``settled`` the runs of frequent keys."""

    spark: SparkSession
    min_docs: int = 10
    fanout: int = 4
    levels: list[list[Run]] = field(default_factory=list)
    settled: list[DataFrame] = field(default_factory=list)

    def _written(self, df: DataFrame) -> DataFrame:
        with workspace.sorted_buckets(self.spark):
            return workspace.bucketed(df, "line-run", KEY)

    @staticmethod
    def _without(rows: DataFrame, *runs: DataFrame) -> DataFrame:
        for run in runs:
            rows = rows.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return rows

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``line_table`` rows; a document's lines must be in one batch."""
        batch = self._written(lines.select(*KEY, "row").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs")))
        known = [run.keys for level in self.levels for run in level]
        if not known and not self.settled:
            self._place(0, Run(batch))
            return
        own = self._written(self._without(batch, *self.settled, *known))
        again = self._written(self._without(batch, *self.settled, own))
        workspace.forget(batch)
        self._place(0, Run(own, again))

    def _place(self, level: int, run: Run) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        runs, self.levels[level] = self.levels[level], []
        tables = [t for run in runs for t in run.tables()]
        total = self._written(self._summed(tables))
        workspace.forget(*tables)
        frequent = F.col("docs") >= self.min_docs
        self.settled.append(self._written(total.filter(frequent).select(*KEY).distinct()))
        rest = self._written(self._without(total, self.settled[-1]))
        workspace.forget(total)
        if len(self.settled) >= self.fanout:
            old = self.settled
            self.settled = [self._written(_united(old).distinct())]
            workspace.forget(*old)
        self._place(level + 1, Run(rest))

    @staticmethod
    def _summed(tables: list[DataFrame]) -> DataFrame:
        return _united(tables).groupBy(*KEY).agg(F.sum("docs").alias("docs"))

    def frequent(self) -> DataFrame:
        """Keys found in at least ``min_docs`` documents over all batches: (h1, h2)."""
        left = [t for level in self.levels for run in level for t in run.tables()]
        found = self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        if self.settled:
            found = found.unionByName(_united(self.settled))
        if left:
            found = found.unionByName(self._summed(left).filter(F.col("docs") >= self.min_docs).select(*KEY))
        return workspace.written(found.distinct(), "frequent-lines", codec="none")

    def forget(self) -> None:
        workspace.forget(*self.settled, *[t for level in self.levels for run in level for t in run.tables()])


def _united(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables, read as plain files: a union of bucketed scans claims their partitioning, but a columnar one
    does not keep it (PySpark 4.1.2), so an aggregation above would come out in parts."""
    plain = [t.sparkSession.read.schema(t.schema).parquet(t.written_path) for t in tables]
    out = plain[0]
    for more in plain[1:]:
        out = out.unionByName(more)
    return out


#: Documents come in this many batches, more than a level of runs holds.
BATCHES, FANOUT = 6, 4


def frequent_line_keys(docs: DataFrame, min_docs: int = 10, batches: int = BATCHES, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """The line table of ``docs`` and the keys in at least ``min_docs`` documents, found batch by batch."""
    lines = line_table(docs).withColumn("batch", F.pmod(F.col("d1"), F.lit(batches)).cast("int"))
    lines = workspace.written(lines, "lines", ["batch"], "none")
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for batch in range(batches):
        runs.add(lines.filter(F.col("batch") == batch))
    frequent = runs.frequent()
    runs.forget()
    return lines.drop("batch"), frequent


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with the lines of frequent keys removed from ``text``, plus ``n_lines`` and ``n_dropped``."""
    lines, keys = frequent_line_keys(docs, min_docs, batches, fanout)
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    hit = lines.join(keys, ["h1", "h2"], "left_semi").groupBy("d1", "d2").agg(F.collect_set("pos").alias("gone"))
    hit = workspace.written(hit, "hits", codec="none")
    n_hit, n_lines = hit.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    # texts stay where they are while the places of what goes are few, else both sides are shuffled by document
    few = n_hit <= BROADCAST_HITS and n_lines <= BROADCAST_LINES
    hit = F.broadcast(hit) if few else hit.hint("shuffle_hash")
    gone = F.coalesce(F.col("gone"), F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("all_lines") - 1), gone)
    return (
        identified(docs)
        .join(hit, ["d1", "d2"], "left")
        .select("doc", gone.alias("gone"), lines_of(F.col("doc.text")).alias("all_lines"))
        .select(
            "doc",
            F.array_join(F.transform(kept, lambda p: F.col("all_lines")[p]), "\n").alias("kept_text"),
            F.size("all_lines").cast("long").alias("n_all"),
            F.size("gone").cast("long").alias("n_gone"),
        )
        .select("doc.*", F.col("kept_text").alias("__kept"), F.col("n_all").alias("__all"), F.col("n_gone").alias("__gone"))
        .withColumns({"text": F.col("__kept"), "n_lines": F.col("__all"), "n_dropped": F.col("__gone")})
        .drop("__kept", "__all", "__gone")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: frequent lines leave every document; the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_frequent_lines(docs, min_docs=10).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
l AS (
  SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM d),
k AS (
  SELECT rid, doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.rid, k.doc_id
"""
