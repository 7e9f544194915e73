"""WARC archives with a two-level capture index.

Executors write gzipped records into archive files of the shared folder; what they wrote comes back as index
entries. Entries are range-partitioned and sorted by reversed-host URL key and written as index parts: blocks
of ``BLOCK`` entries, each compressed, and after them a sparse directory with the first key, offset and length of
each block. A small table of the parts' first keys stands above. A lookup binary-searches the parts, then the
part's directory, reads the block by range, and then the record by range.

Each attempt of a task writes files of its own name, and only files named by entries are ever read, so a task
that was lost or run twice leaves no double records.

Records with equal payloads: that of the smallest page_id is a ``response``, the others are ``revisit`` records
that hold headers only. The query looks up the key of every page: sorted keys are searched in the parts and their
directories, each block that may hold one is read once by range, and the records found are read by range in archive
order, adjacent ones together. Digests are verified; a revisit takes payload size and digest from its response.

Defined results
    null or empty html: an empty payload. null url: key and target are empty.
    null page_id: sorts after all others, so it is a response only where its payload has no page_id at all.
    rows that repeat the response's page_id and payload: responses too. empty table: empty result.
    very long pages: a record each, read whole. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import store, workspace

BLOCK = 1000
#: Adjacent records are read together up to so many bytes.
RANGE = 8 << 20
FILE_BYTES = 512 << 20
#: Repeated payloads (about 40 bytes each) are broadcast up to this many, else joined by shuffle.
BROADCAST_DIGESTS = 100_000
DATE = "2024-01-01T00:00:00Z"
_NO_ID = 1 << 127
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, page_id bigint, file string, offset bigint, length bigint"


def url_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, then the rest: com,example,www)/path?query."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.regexp_replace(u, r"^.*?://", "")).otherwise(u)
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?#]*", ""))


def record_id(page_id: int | None) -> str:
    n = _NO_ID if page_id is None else page_id & ((1 << 64) - 1)
    return f"<urn:uuid:{uuid.UUID(int=n)}>"


def page_of(name: str) -> int | None:
    n = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    if n == _NO_ID:
        return None
    return n - (1 << 64) if n >= 1 << 63 else n


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not yet compressed."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record, its lengths and digest verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + 4 or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length differs")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and "sha1:" + digest_of(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError("a payload's digest differs")
    return fields, payload


def with_originals(pages: DataFrame) -> DataFrame:
    """Adds ``revisit`` and ``refers_to`` to rows of (page_id, url, html)."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), raw.alias("payload"), F.unhex(F.sha1(raw)).alias("sha1"))
    twice = workspace.written(
        rows.select("sha1", "page_id").groupBy("sha1").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).drop("n"),
        "repeated-payloads",
    )
    if twice.count() <= BROADCAST_DIGESTS:
        twice = F.broadcast(twice)
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return rows.join(twice, "sha1", "left").select(
        "page_id", "url", url_key(F.col("url")).alias("key"), "payload", revisit.alias("revisit"), F.when(revisit, F.col("original")).alias("refers_to")
    )


def write_archives(rows: DataFrame, root: str, level: int = 6) -> DataFrame:
    """Write the records below ``root``; the index entries, unsorted."""
    store.make_dir(root)

    def write(batches):
        context = TaskContext.get()
        name, number, out, offset, entries = f"{context.partitionId():06d}-{context.taskAttemptId()}", 0, None, 0, []
        schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries), schema.types)], schema=schema)
            entries.clear()
            return made

        for batch in batches:
            for key, page_id, url, payload, revisit, refers_to in zip(*[batch.column(c).to_pylist() for c in ("key", "page_id", "url", "payload", "revisit", "refers_to")]):
                if out is None:
                    file = f"{root}/{name}-{number:04d}.warc.gz"
                    out, offset, number = store.writer(file), 0, number + 1
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = packer.compress(record(page_id, url, payload, refers_to, revisit)) + packer.flush()
                out.write(data)
                entries.append((key, page_id, file, offset, len(data)))
                offset += len(data)
                if offset >= FILE_BYTES:
                    out.close()
                    out = None
                if len(entries) >= 4096:
                    yield flush()
        if out is not None:
            out.close()
        if entries:
            yield flush()

    return rows.select("key", "page_id", "url", "payload", "revisit", "refers_to").mapInArrow(write, ENTRY)


class CaptureIndex:
    """The two-level index: a table of parts, and in each part a directory of compressed blocks."""

    def __init__(self, spark: SparkSession, parts: DataFrame):
        #: (first_key, last_key, path, dir_offset, dir_length, blocks): one row for each part.
        self.spark, self.parts = spark, parts

    @classmethod
    def build(cls, entries: DataFrame, root: str) -> CaptureIndex:
        spark = entries.sparkSession
        store.make_dir(root)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = entries.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")

        def write(batches):
            context = TaskContext.get()
            path, out, offset, directory, block, last = None, None, 0, [], [], None

            def close_block():
                nonlocal offset
                data = zlib.compress("".join(block).encode())
                directory.append([block[0].split("\t", 1)[0], offset, len(data)])
                out.write(data)
                offset += len(data)
                block.clear()

            for batch in batches:
                for key, page_id, file, at, length in zip(*[c.to_pylist() for c in batch.columns]):
                    if out is None:
                        path = f"{root}/{context.partitionId():06d}-{context.taskAttemptId()}.idx"
                        out = store.writer(path)
                    last = json.dumps(key)
                    block.append(f"{last}\t{json.dumps([page_id, file, at, length])}\n")
                    if len(block) == BLOCK:
                        close_block()
            if out is None:
                return
            if block:
                close_block()
            tail = zlib.compress(json.dumps([[json.loads(k), o, n] for k, o, n in directory]).encode())
            out.write(tail)
            out.close()
            yield pa.RecordBatch.from_pydict({"first_key": [json.loads(directory[0][0])], "last_key": [json.loads(last)], "path": [path], "dir_offset": [offset], "dir_length": [len(tail)], "blocks": [len(directory)]})

        parts = ordered.mapInArrow(write, "first_key string, last_key string, path string, dir_offset bigint, dir_length bigint, blocks bigint")
        return cls(spark, workspace.written(parts, "index-parts"))

    def entries(self) -> DataFrame:
        """All entries, read from the blocks."""
        # one row for each block first, so that a long part is read by many tasks
        def directories(batches):
            for batch in batches:
                for path, offset, length in zip(*[batch.column(c).to_pylist() for c in ("path", "dir_offset", "dir_length")]):
                    blocks = _directory(path, offset, length)
                    yield pa.RecordBatch.from_pydict({"path": [path] * len(blocks), "at": [b[1] for b in blocks], "n": [b[2] for b in blocks]})

        def read(batches):
            for batch in batches:
                for path, at, n in zip(*[c.to_pylist() for c in batch.columns]):
                    rows = list(_block(path, at, n))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                        names=["key", "page_id", "file", "offset", "length"],
                    )

        blocks = self.parts.mapInArrow(directories, "path string, at bigint, n bigint")
        return blocks.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "path", "at").mapInArrow(read, ENTRY)

    def find(self, keys: DataFrame) -> DataFrame:
        """The entries of all ``key`` values of ``keys``: binary searches in sorted order, then blocks read by range.

        A key that fills many blocks (a hot host) is read by as many tasks.
        """
        # one row a part, as many as shuffle partitions
        parts = sorted((r.first_key.encode(), r.last_key.encode(), r.path, r.dir_offset, r.dir_length) for r in self.parts.collect())
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = keys.select("key").distinct().repartitionByRange(n, "key").sortWithinPartitions("key")

        def search(batches):
            directory = lru_cache(maxsize=4)(_searchable)
            firsts = [p[0] for p in parts]
            for batch in batches:
                out: list[tuple] = []
                for key in batch.column(0).to_pylist():
                    want = key.encode()
                    for first, last, path, offset, length in parts[max(0, bisect.bisect_left(firsts, want) - 1) : bisect.bisect_right(firsts, want)]:
                        if first <= want <= last:
                            starts, blocks = directory(path, offset, length)
                            out += [(path, o, size, key) for _, o, size in blocks[max(0, bisect.bisect_left(starts, want) - 1) : bisect.bisect_right(starts, want)]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["path", "at", "n", "key"])

        def read(batches):
            for batch in batches:
                for path, at, size, wanted in zip(*[c.to_pylist() for c in batch.columns]):
                    wanted = set(wanted)
                    rows = [e for e in _block(path, at, size) if e[0] in wanted]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                        names=["key", "page_id", "file", "offset", "length"],
                    )

        places = ordered.mapInArrow(search, "path string, at bigint, n bigint, key string")
        return places.groupBy("path", "at", "n").agg(F.collect_list("key").alias("keys")).mapInArrow(read, ENTRY)

    def lookup(self, key: str) -> list[tuple]:
        """Entries (key, page_id, file, offset, length) of one key, by two binary searches and range reads."""
        parts = sorted((r.first_key.encode(), r.last_key.encode(), r.path, r.dir_offset, r.dir_length) for r in self.parts.collect())  # one row a part
        want, out = key.encode(), []
        at = max(0, bisect.bisect_left([p[0] for p in parts], want) - 1)
        for first, last, path, offset, length in parts[at:]:
            if first > want:
                break
            if last < want:
                continue
            directory = _directory(path, offset, length)
            firsts = [b[0].encode() for b in directory]
            for _, o, n in directory[max(0, bisect.bisect_left(firsts, want) - 1) : bisect.bisect_right(firsts, want)]:
                out += [e for e in _block(path, o, n) if e[0] == key]
        return out


def _directory(path: str, offset: int, length: int) -> list[list]:
    with store.reader(path) as f:
        return json.loads(zlib.decompress(f.read_at(length, offset)))


def _searchable(path: str, offset: int, length: int) -> tuple[list[bytes], list[list]]:
    blocks = _directory(path, offset, length)
    return [b[0].encode() for b in blocks], blocks


def _block(path: str, offset: int, length: int) -> Iterator[tuple]:
    with store.reader(path) as f:
        for line in zlib.decompress(f.read_at(length, offset)).decode().splitlines():
            key, rest = line.split("\t", 1)
            yield (json.loads(key), *json.loads(rest))


def read_record(file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by a range read."""
    with store.reader(file) as f:
        return parse(zlib.decompress(f.read_at(length, offset), 31))


READ = "page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def read_archives(entries: DataFrame) -> DataFrame:
    """The records of the index entries, read in archive order, adjacent ones together."""
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("offset") / RANGE)
    ordered = entries.withColumn("stretch", stretch).repartition(n, "file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")

    def read(batches):
        def taken(run):
            file, start, end = run[0][0], run[0][1], run[-1][1] + run[-1][2]
            with store.reader(file) as f:
                data = f.read_at(end - start, start)
            rows = []
            for _, offset, length in run:
                fields, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                revisit = fields["WARC-Type"] == "revisit"
                rows.append((
                    page_of(fields["WARC-Record-ID"]), fields["WARC-Type"], None if revisit else len(payload),
                    fields["WARC-Payload-Digest"].removeprefix("sha1:"), page_of(fields["WARC-Refers-To"]) if revisit else None,
                ))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"])

        run: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                follows = run and row[0] == run[-1][0] and row[1] == run[-1][1] + run[-1][2]
                if run and (not follows or row[1] + row[2] - run[0][1] > RANGE):
                    yield taken(run)
                    run = []
                run.append(row)
        if run:
            yield taken(run)

    return ordered.mapInArrow(read, READ)


def captures(index: CaptureIndex, keys: DataFrame | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records of ``keys``, or of all.

    A revisit whose response is not among them has payload_bytes null.
    """
    read = workspace.written(read_archives(index.entries() if keys is None else index.find(keys)), "captures")
    responses = read.filter(F.col("record_type") == "response")
    revisits = read.filter(F.col("record_type") == "revisit")
    sizes = (
        responses.join(revisits.select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi")
        .groupBy(F.col("page_id").alias("original"), F.col("payload_digest").alias("digest"))
        .agg(F.max("payload_bytes").alias("size"))
    )
    resolved = revisits.join(
        sizes, (F.col("refers_to") == F.col("original")) & (F.col("payload_digest") == F.col("digest")), "left"
    ).select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return responses.select(resolved.columns).unionByName(resolved)


def archive(pages: DataFrame, root: str) -> CaptureIndex:
    """Write archives and index of (page_id, url, html) below ``root``."""
    entries = workspace.written(write_archives(with_originals(pages), f"{root}/archive"), "entries")
    return CaptureIndex.build(entries, f"{root}/index")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every page in a WARC archive, read back through the index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return captures(archive(pages, workspace.shared_dir(spark, "warc")), pages.select(url_key(F.col("url")).alias("key")))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT page_id, payload, hex,
         (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1), '' ORDER BY i)
          FROM range(32) r(i)) AS payload_digest,
         min(page_id) OVER (PARTITION BY hex) AS original
  FROM p)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM bits
"""
