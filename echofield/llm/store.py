"""Random access to files in any store that the executors share, by URI.

Hadoop's names of object stores are read by those that pyarrow knows.
"""

from __future__ import annotations

from pyarrow import fs


#: Hadoop's scheme -> what pyarrow calls it, or the folder where executors have it mounted.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "dbfs:/": "file:///dbfs/", "wasb://": "abfs://", "wasbs://": "abfss://"}


def resolved(uri: str) -> str:
    for theirs, ours in SCHEMES.items():
        if uri.startswith(theirs):
            return ours + uri[len(theirs) :].lstrip("/")
    if uri.startswith("file:"):
        return "file:///" + uri[5:].lstrip("/")
    return uri if "://" in uri else f"file://{uri}"


def _open(uri: str):
    return fs.FileSystem.from_uri(resolved(uri))


def make_dir(uri: str) -> None:
    system, path = _open(uri)
    system.create_dir(path, recursive=True)


def writer(uri: str):
    system, path = _open(uri)
    return system.open_output_stream(path, compression=None)


def reader(uri: str):
    system, path = _open(uri)
    return system.open_input_file(path)
