"""Byte ranges, streamed digests and placement of files in any store that Arrow's file systems reach; runs inside tasks.

A task never holds a whole file: reads are ranges or chunks. What is written gets a staged name first and its own name by
a move, so that no half file is ever seen under its name.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.plans.lineage import cut

CHUNK = 1 << 20
STAGED = "_staged"
#: Files of one task on average.
FILES_A_TASK = 64


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI or a local path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def chunks(uri: str, size: int = CHUNK) -> Iterator[bytes]:
    store, path = at(uri)
    with store.open_input_stream(path, buffer_size=0) as f:
        while part := f.read(size):
            yield part


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key, a task for about FILES_A_TASK of them."""
    n = rows.count()
    return rows.repartition(max(1, -(-n // FILES_A_TASK)), key)


def hashed(files: DataFrame, path: str = "path", chunk: int = CHUNK) -> DataFrame:
    """files (path) and length, chunks, sha256 and md5 of what each holds, read in chunks: no file has to fit in memory or in
    a cell, so there is no bound on its size. A null path has nulls; a path that can't be read fails the job."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b[path]:
                sha, md5, length, n = hashlib.sha256(), hashlib.md5(), 0, 0
                for part in chunks(p, chunk) if p is not None else ():
                    sha.update(part)
                    md5.update(part)
                    length, n = length + len(part), n + 1
                out.append((p, length, n, sha.hexdigest(), md5.hexdigest()) if p is not None else (None,) * 5)
            yield pd.DataFrame(out, columns=["path", "length", "chunks", "sha256", "md5"])

    return _dealt(files.select(path), path).mapInPandas(work, "path string, length long, chunks long, sha256 string, md5 string")


def listed(spark: SparkSession, folder: str, pattern: Column | None = None) -> DataFrame:
    """path and length of all files under a folder. Folders are listed by tasks, one level of the tree after the other; no
    file is opened, and files of no bytes count."""
    todo, found = cut(spark.range(1).select(F.lit(folder).alias("path"))), []

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["path"]:
                store, top = at(folder)
                prefix = folder[: len(folder.rstrip("/")) - len(top.rstrip("/"))]
                own = store.get_file_info(top)
                infos = [own] if own.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, allow_not_found=True))
                yield pd.DataFrame([(prefix + i.path, -1 if i.type == fs.FileType.Directory else i.size) for i in infos], columns=["path", "length"])

    while not todo.isEmpty():
        step = cut(_dealt(todo, "path").mapInPandas(level, "path string, length long"))
        found.append(step.filter("length >= 0"))
        todo = step.filter("length < 0").select("path")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.filter(pattern) if pattern is not None else out


def copied(source: str, target: str, link: bool) -> tuple[str, int]:
    """target with what source holds: a hard link where both are local and on one device, else a copy in chunks. ('hardlink'
    or 'copy', bytes)."""
    (a, source_path), (b, target_path) = at(source), at(target)
    b.create_dir(os.path.dirname(target_path), recursive=True)
    if link and isinstance(a, fs.LocalFileSystem) and isinstance(b, fs.LocalFileSystem):
        try:
            os.link(source_path, target_path)
            return "hardlink", os.path.getsize(target_path)
        except OSError:
            pass
    size = 0
    with b.open_output_stream(target_path) as out:
        for part in chunks(source):
            out.write(part)
            size += len(part)
    return "copy", size


def publish(staged: str, target: str, size: int) -> None:
    """Moves a staged file to its name. It may run again after any failure: once moved, the file is found in place."""
    (a, source_path), (_, target_path) = at(staged), at(target)
    a.create_dir(os.path.dirname(target_path), recursive=True)
    if a.get_file_info(source_path).type == fs.FileType.NotFound:
        placed = a.get_file_info(target_path)
        if placed.type == fs.FileType.NotFound or placed.size != size:
            raise FileNotFoundError(f"neither staged nor in place: {target}")
        return
    a.move(source_path, target_path)


def written(rows: DataFrame, folder: str) -> DataFrame:
    """rows (name, content: binary) as files folder/name: name and length. Each is staged and then moved to its name, so it is
    whole or not there; a retried or speculative attempt writes the same file again."""
    top = folder.rstrip("/")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["name"], b["content"]):
                staged, target = f"{top}/{STAGED}/{uuid.uuid4().hex}", f"{top}/{name}"
                (store, staged_path), (_, target_path) = at(staged), at(target)
                for path in (staged_path, target_path):
                    store.create_dir(os.path.dirname(path), recursive=True)
                with store.open_output_stream(staged_path) as out:
                    out.write(content)
                store.move(staged_path, target_path)
            yield pd.DataFrame({"name": b["name"], "length": b["content"].map(len)})

    done = cut(rows.select("name", "content").mapInPandas(work, "name string, length long"))
    store, stage = at(f"{top}/{STAGED}")
    if store.get_file_info(stage).type == fs.FileType.Directory:
        store.delete_dir(stage)
    return done


def materialised(files: DataFrame, folder: str, link: bool = True, copy: Callable[[str, str, bool], tuple[str, int]] = copied) -> DataFrame:
    """files (source, name) placed as folder/name: source, name, mode and length of each, read from a manifest.

    Two phases. First every task attempt stages its files under names of its own, and what the attempts that succeeded have
    staged becomes the manifest (Spark's commit: a retried or speculative attempt adds nothing twice). Then the manifest's
    files are moved to their names. A failure leaves no half file under any name, and the job can simply run again; staged
    leftovers go at the end. A name that stands twice is an error; a file that is in place already is replaced.
    """
    twice = files.groupBy("name").count().filter("count > 1").head()
    if twice:
        raise ValueError(f"two files for the name {twice.name}")
    stage = f"{folder.rstrip('/')}/{STAGED}-{uuid.uuid4().hex}"

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for source, name in zip(b["source"], b["name"]):
                staged = f"{stage}/{uuid.uuid4().hex}"
                out.append((source, name, staged, *copy(source, staged, link)))
            yield pd.DataFrame(out, columns=["source", "name", "staged", "mode", "length"])

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for staged, name, size in zip(b["staged"], b["name"], b["length"]):
                publish(staged, f"{folder.rstrip('/')}/{name}", size)
            yield b[["source", "name", "mode", "length"]]

    store, stage_path = at(stage)
    try:
        manifest = cut(_dealt(files.select("source", "name"), "name").mapInPandas(first, "source string, name string, staged string, mode string, length long"))
        return cut(_dealt(manifest, "name").mapInPandas(second, "source string, name string, mode string, length long"))
    finally:
        if store.get_file_info(stage_path).type != fs.FileType.NotFound:
            store.delete_dir(stage_path)
