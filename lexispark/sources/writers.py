"""Writers of files that Spark doesn't write itself: archives and compressed lines, one file for each partition."""

from __future__ import annotations

import bz2
import io
import lzma
import tarfile
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame


def filesystem(path: str):
    """The file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _zip(rows: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in rows:
            z.writestr(name, data)
    return out.getvalue()


def _tar(mode: str) -> Callable[[list[tuple[str, bytes]]], bytes]:
    def write(rows: list[tuple[str, bytes]]) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode=mode) as t:
            for name, data in rows:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    return write


def _joined(compress: Callable[[bytes], bytes]) -> Callable[[list[tuple[str, bytes]]], bytes]:
    return lambda rows: compress(b"".join(data for _, data in rows))


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


#: Archives have members; other kinds have the data of all rows, one after the other.
KINDS = {"zip": _zip, "tar.gz": _tar("w:gz"), "tar.bz2": _tar("w:bz2"), "xz": _joined(lzma.compress), "bz2": _joined(bz2.compress), "zst": _joined(_zstd), "plain": _joined(bytes)}


def write_files(members: DataFrame, path: str, kind: str, suffix: str, each: bool = False) -> int:
    """Writes a file in a folder for each partition of members (name string, data binary) that has rows, or for each row; the number of files. What a file gets is held in memory."""

    def run(batches):
        rows = ((n, bytes(d)) for pdf in batches for n, d in zip(pdf["name"], pdf["data"]))
        fs, folder = filesystem(path)
        for k, own in enumerate([r] for r in rows) if each else enumerate(filter(None, [list(rows)])):
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/part-{TaskContext.get().partitionId():05d}-{k:05d}{suffix}", compression=None) as out:
                out.write(KINDS[kind](own))
            yield pd.DataFrame({"rows": [len(own)]})

    return members.select("name", "data").mapInPandas(run, "rows long").count()


def write_named(members: DataFrame, path: str) -> int:
    """Writes members (name string, data binary) as files of those names in a folder; the number of files. A name that repeats leaves one of its files."""

    def run(batches):
        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        for pdf in batches:
            for name, data in zip(pdf["name"], pdf["data"]):
                with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    out.write(bytes(data))
            yield pd.DataFrame({"rows": [1] * len(pdf)})

    return members.select("name", "data").mapInPandas(run, "rows long").count()
