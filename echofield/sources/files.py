"""Files by path or URI: sizes, digests and range reads."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def locate(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share; a local one only on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="echofield-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def regular_size(path: str) -> int:
    """Size of a regular file; anything else is an error."""
    system, name = locate(path)
    info = system.get_file_info(name)
    if info.type != fs.FileType.File:
        raise ValueError(f"not a regular file: {path}")
    return info.size


def read_range(path: str, start: int, size: int) -> bytes:
    system, name = locate(path)
    with system.open_input_file(name) as f:
        data = f.read_at(size, start)
    if len(data) != size:
        raise ValueError(f"{path} ended within a range")
    return data


def read_all(path: str, most: int) -> bytes:
    size = regular_size(path)
    if size > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    return read_range(path, 0, size)


def sha256_of(path: str, chunk: int = 1 << 22) -> str:
    """Digest of a file, read in chunks."""
    digest, size = hashlib.sha256(), regular_size(path)
    system, name = locate(path)
    with system.open_input_file(name) as f:
        for at in range(0, size, chunk):
            digest.update(f.read_at(min(chunk, size - at), at))
    return digest.hexdigest()


def strict_json(data: bytes) -> dict:
    """A JSON object without repeated keys and without NaN or infinities."""

    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a key occurs twice")
        return out

    def finite(name):
        raise ValueError(f"{name} is not JSON")

    value = json.loads(data.decode("utf-8"), object_pairs_hook=unique, parse_constant=finite)
    if not isinstance(value, dict):
        raise ValueError("not a JSON object")
    return value
