"""Packing by the dot-product heuristic for vector bins.

An example needs several resources at once (tokens, a segment, loss-bearing tokens); a sequence offers a limit of
each. The open sequence takes, of the waiting examples that fit, the one of greatest weighted dot product between
its needs and what is left, both as shares of the limits: large examples go while there is room and the
resource that is scarce decides. With ``cut`` an example that does not fit may be divided: full sequences are cut
off long examples first, and when nothing fits, the largest waiting example fills the sequence up.

Rows are packed as they stream through a task, with a pool of at most ``pool`` waiting examples, so no shuffle
is needed, memory is bounded and a lost task is simply run again with the same result. What is left at the end of
a task is cut into sequences whose lengths are powers of two, which need no padding.

Defined results
    null or empty text: the end id alone. repeated rows: packed one by one, each with its own pieces.
    text that spells an added token of the file: that token's id, as the tokenizer gives.
    very long texts, runs of blanks or of one letter: encoded whole; full sequences leave at once, a tail waits.
    examples that exceed a limit and may not be cut: a sequence of their own, marked ``oversize``.
    empty table: empty result. Ties: the example that came first. null doc_id: an ordinary value.
    extra columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

END_ID = 1
TOKENIZER = "byte_bpe_50k.json"


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


@dataclass
class Example:
    """One waiting example: a span of a row's ids."""

    row: int
    start: int
    length: int
    loss: int


class Packer:
    """Packs examples; ``put`` and ``finish`` yield sequences as lists of examples."""

    def __init__(self, limits: Limits, pool: int = 512, cut: bool = False):
        self.limits, self.pool, self.cut = limits, pool, cut
        self.waiting: list[Example] = []

    def put(self, example: Example) -> Iterator[list[Example]]:
        size = self.limits.tokens
        if self.cut:
            # a full sequence at a time, as long as its loss-bearing tokens fit too
            while example.length >= size and self.limits.loss_tokens >= size:
                head, example = self._split(example, size)
                yield [head]
                if example is None:
                    return
        elif example.length > size or example.loss > self.limits.loss_tokens:
            yield [example]
            return
        self.waiting.append(example)
        if len(self.waiting) >= self.pool:
            yield from self._pack(self.pool // 2)

    def _split(self, e: Example, n: int) -> tuple[Example, Example | None]:
        """The first ``n`` tokens and the rest; loss-bearing tokens count from the end of an example."""
        if n >= e.length:
            return e, None
        rest_loss = min(e.loss, e.length - n)
        return Example(e.row, e.start, n, e.loss - rest_loss), Example(e.row, e.start + n, e.length - n, rest_loss)

    def _pack(self, leave: int) -> Iterator[list[Example]]:
        if not self.waiting:
            return
        caps = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], float)
        need = np.array([[e.length, 1, e.loss] for e in self.waiting], float) / caps
        items, alive = list(self.waiting), np.ones(len(self.waiting), bool)
        weight = need.mean(axis=0)  # scarce resources weigh more
        while int(alive.sum()) > leave:
            left, sequence = np.ones(3), []
            while True:
                fits = alive & (need <= left + 1e-12).all(axis=1)
                if fits.any():
                    at = int(np.where(fits, need @ (weight * left), -1.0).argmax())
                    alive[at] = False
                    sequence.append(items[at])
                    left = left - need[at]
                    continue
                room = int(min(round(left[0] * caps[0]), round(left[2] * caps[2])))
                if not (self.cut and alive.any() and room > 0 and left[1] * caps[1] >= 0.5):
                    break
                at = int(np.where(alive, need[:, 0], -1.0).argmax())
                head, rest = self._split(items[at], room)
                if rest is None:
                    break
                sequence.append(head)
                items[at], need[at] = rest, np.array([rest.length, 1, rest.loss]) / caps
                break
            yield sequence
        self.waiting = [e for e, a in zip(items, alive) if a]

    def finish(self) -> Iterator[list[Example]]:
        """What is left; with ``cut``, a last part sequence is divided into powers of two."""
        for sequence in self._pack(0):
            total = sum(e.length for e in sequence)
            if not self.cut or total == self.limits.tokens:
                yield sequence
                continue
            while total:
                n = 1 << (total.bit_length() - 1)
                total -= n
                part = []
                while n:
                    head, rest = self._split(sequence[0], n)
                    part.append(head)
                    n -= head.length
                    sequence = sequence[1:] if rest is None else [rest, *sequence[1:]]
                yield part


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A longer run of white space goes to the exact tokenizer: the fast one's pattern matcher backtracks over it.
LONG_BLANKS = 1000


class Encoder:
    """Ids of a byte-level BPE file, equal to those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    Text is divided at the file's added tokens, as the tokenizer does; the parts between go through a faster encoder
    with the file's own ranks and pre-token pattern, but for parts with very long runs of white space.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        odd = [t["content"] for t in added if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
        if odd or spec.get("normalizer") or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level files without normalizer and with plain added tokens are read")
        self.path, self._exact = path, None
        self.added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.at_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.long_blanks = re.compile(r"\s{%d}" % LONG_BLANKS)
        # byte-level BPE writes each byte as one printable character; spaces stand for themselves + 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in plain}
        chars.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def exact(self):
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.path)
        return self._exact

    def _plain(self, text: str) -> np.ndarray:
        if self.long_blanks.search(text):
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)

    def ids(self, text: str) -> np.ndarray:
        """The text's ids and the end id."""
        parts = self.at_added.split(text) if self.at_added else [text]
        made = [np.array([self.added[part]], np.uint32) if i % 2 else self._plain(part) for i, part in enumerate(parts) if part]
        return np.concatenate([*made, np.array([END_ID], np.uint32)])


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder a Python worker, kept between its tasks."""
    return Encoder(path)


SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, limits: Limits = Limits(), path: str | None = None, pool: int = 512) -> DataFrame:
    """Pieces of all documents: one row for each piece, with its sequence and its offset there."""
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType
    field = pa.int64() if kind.simpleString() == "bigint" else pa.string()
    rows = docs.select(F.col("doc_id") if field == pa.int64() else F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", field), *[(c, pa.int64()) for c in COLUMNS]])

    def pack(batches):
        encoder, packer = encoder_of(path), Packer(limits, pool, cut=True)
        held: dict[int, tuple] = {}
        left: dict[int, int] = {}
        sequence_id = (TaskContext.get().partitionId() << 40) - 1
        out: list[tuple] = []

        def emit(sequences):
            nonlocal sequence_id
            for sequence in sequences:
                sequence_id += 1
                offset = 0
                for e in sequence:
                    doc_id, ids, base, total = held[e.row]
                    crc = zlib.crc32(ids[e.start - base : e.start - base + e.length].astype("<u4").tobytes())
                    out.append((doc_id, e.start, e.length, crc, total, sequence_id, offset))
                    offset += e.length
                    left[e.row] -= e.length
                    if not left[e.row]:
                        del held[e.row], left[e.row]

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out.clear()
            return batch

        row = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = encoder.ids(text.as_py())
                n = len(ids)
                held[row], left[row] = (doc_id.as_py(), ids, 0, n), n
                # nothing precedes the first id, so it bears no loss
                emit(packer.put(Example(row, 0, n, n - 1)))
                if row in held and left[row] < n:  # of a long document only the tail still waits
                    base = n - left[row]
                    held[row] = (held[row][0], ids[base:].copy(), base, n)
                row += 1
                if len(out) >= 8192:
                    yield flush()
        emit(packer.finish())
        if out:
            yield flush()

    name = "bigint" if field == pa.int64() else "string"
    return rows.mapInArrow(pack, f"doc_id {name}, {SCHEMA}")


def pack_examples(examples: DataFrame, limits: Limits, pool: int = 512) -> DataFrame:
    """Whole examples (``example_id``, ``tokens``, ``loss_tokens``) into sequences, none of them cut.

    Returns example_id, sequence_id, slot, offset and oversize. Nulls count as 0 tokens.
    """
    rows = examples.select(
        F.col("example_id").cast("string").alias("example_id"),
        F.coalesce(F.col("tokens").cast("bigint"), F.lit(0)).alias("tokens"),
        F.coalesce(F.col("loss_tokens").cast("bigint"), F.lit(0)).alias("loss_tokens"),
    )

    def pack(batches):
        packer, names, sequence_id, row = Packer(limits, pool), {}, (TaskContext.get().partitionId() << 40) - 1, 0

        def made(sequences):
            nonlocal sequence_id
            for sequence in sequences:
                sequence_id += 1
                lengths = [e.length for e in sequence]
                big = sum(lengths) > limits.tokens or sum(e.loss for e in sequence) > limits.loss_tokens
                yield pa.RecordBatch.from_pydict({
                    "example_id": [names.pop(e.row) for e in sequence],
                    "sequence_id": [sequence_id] * len(sequence),
                    "slot": list(range(len(sequence))),
                    "offset": [int(x) for x in np.cumsum([0, *lengths[:-1]])],
                    "oversize": [big] * len(sequence),
                }, schema=pa.schema([("example_id", pa.string()), ("sequence_id", pa.int64()), ("slot", pa.int64()), ("offset", pa.int64()), ("oversize", pa.bool_())]))

        for batch in batches:
            for name, tokens, loss in zip(*[c.to_pylist() for c in batch.columns]):
                names[row] = name
                yield from made(packer.put(Example(row, 0, tokens, loss)))
                row += 1
        yield from made(packer.finish())

    return rows.mapInArrow(pack, "example_id string, sequence_id bigint, slot bigint, offset bigint, oversize boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents into sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
