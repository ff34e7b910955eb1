"""Frames of video containers (YUV4MPEG2) as a data source with random access, and a sink that writes such containers.

Frames of a container have one size, so a frame number is a byte range. Filters on the frame number and the path are pushed
down: a task then opens only the ranges of the frames that are wanted, and sampled frames of long videos cost their own
bytes. Without such filters a file is read in pieces of its bytes.

    register(spark)
    spark.read.format("frames").option("corrupt", "skip").load("/videos").filter("frame % 15 = 0 and frame < 300")
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from sightline.plans.lineage import cut
from sightline.sources.store import at

SCHEMA = "path string, frame long, fps double, width int, height int, chroma string, content binary, bytes_read long"
MAGIC, FRAME, SUFFIX, HEAD = b"YUV4MPEG2", b"FRAME\n", ".y4m", 1024
#: Bytes of a task, and what opening a file counts as.
PIECE, OPEN = 64 << 20, 1 << 20
#: Frame numbers that frames_at() pushes down at most; more are joined.
MOST_PUSHED = 10_000


@dataclass(frozen=True)
class Container:
    """The header of a container: frame i begins at start + i * stride."""

    width: int
    height: int
    fps: float
    chroma: str
    start: int

    @property
    def size(self) -> int:
        w, h = self.width, self.height
        half = (w + 1) // 2
        return w * h + {"mono": 0, "420": 2 * half * ((h + 1) // 2), "422": 2 * half * h, "444": 2 * w * h}[self.chroma]

    @property
    def stride(self) -> int:
        return len(FRAME) + self.size


def header(head: bytes, path: str = "") -> Container:
    line, newline, _ = head.partition(b"\n")
    parts = line.split(b" ")
    if not newline or parts[0] != MAGIC:
        raise ValueError(f"not a frame container: {path}")
    tags = {p[:1].decode(): p[1:].decode() for p in parts[1:] if p}
    top, _, bottom = tags.get("F", "0:1").partition(":")
    chroma = tags.get("C", "420")
    kind = next((k for k in ("mono", "420", "422", "444") if chroma.startswith(k)), None)
    if kind is None or chroma[len(kind) :].startswith(("p1", "alpha", "9", "1")):
        raise ValueError(f"frames of {chroma} can't be read: {path}")
    return Container(int(tags["W"]), int(tags["H"]), int(top) / int(bottom or 1), kind, len(line) + 1)


@dataclass
class Wanted:
    """What filters leave: frame numbers (None: all) within bounds, and paths (None: all)."""

    frames: set[int] | None = None
    low: int = 0
    high: float = float("inf")
    paths: set[str] | None = None

    def take(self, f: Filter) -> bool:
        """Takes a filter over, if it is of a kind that needs no second look."""
        if not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or len(f.attribute) != 1 or f.attribute[0] not in ("frame", "path"):
            return False
        values = set(f.value) if isinstance(f, In) else {f.value}
        values.discard(None)
        name = f.attribute[0]
        if isinstance(f, (EqualTo, In)):
            now = getattr(self, name + "s")
            setattr(self, name + "s", values if now is None else now & values)
            return True
        if name == "path":
            return False
        (value,) = values or {float("inf")}
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, value + isinstance(f, GreaterThan))
        else:
            self.high = min(self.high, value - isinstance(f, LessThan))
        return True

    def few(self) -> bool:
        return self.frames is not None or self.high < float("inf")

    def of(self, first: int, last: int) -> Iterable[int]:
        first, last = max(first, self.low), min(last, self.high)
        if self.frames is not None:
            return sorted(i for i in self.frames if first <= i <= last)
        return range(int(first), int(last) + 1)


@dataclass
class Pieces(InputPartition):
    """Files with the bytes, from and to, in which a task's frames begin."""

    parts: list[tuple[str, int, int]] = field(default_factory=list)

    def __init__(self, parts: list[tuple[str, int, int]]):
        super().__init__(None)
        self.parts = parts


class FrameReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.path, self.skip = options["path"], options.get("corrupt", "raise") == "skip"
        self.piece = int(options.get("pieceBytes", PIECE))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """From the listing alone: no file is opened here. Where only few frames are wanted, a file is one piece."""
        store, top = at(self.path)
        prefix = self.path[: len(self.path.rstrip("/")) - len(top.rstrip("/"))]
        info = store.get_file_info(top)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
        files = sorted((prefix + i.path, i.size) for i in files if i.type == fs.FileType.File and i.path.endswith(SUFFIX) and not os.path.basename(i.path).startswith(("_", ".")))
        out, now, weight = [], [], 0
        for path, size in files:
            if self.wanted.paths is not None and path not in self.wanted.paths:
                continue
            step = size if self.wanted.few() else self.piece
            for lo in range(0, size, max(1, step)):
                cost = OPEN + (0 if self.wanted.few() else min(step, size - lo))
                if now and weight + cost > self.piece:
                    out.append(Pieces(now))
                    now, weight = [], 0
                now.append((path, lo, min(size, lo + step)))
                weight += cost
        return [*out, Pieces(now)]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for path, lo, hi in partition.parts:
            store, inner = at(path)
            with store.open_input_file(inner) as f:
                size, head = f.size(), f.read(HEAD)
                c, spent = header(head, path), len(head)
                first = max(0, -(-(lo - c.start) // c.stride))
                last = -(-(min(hi, size) - c.start) // c.stride) - 1
                for i in self.wanted.of(first, last):
                    f.seek(c.start + i * c.stride)
                    raw = f.read(c.stride)
                    spent += len(raw)
                    if len(raw) < c.stride or not raw.startswith(FRAME):
                        if self.skip:
                            continue
                        raise ValueError(f"frame {i} of {path} can't be read")
                    values = (path, i, c.fps, c.width, c.height, c.chroma, raw[len(FRAME) :], spent)
                    types = (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)


class FrameSource(DataSource):
    """path, frame (from 0), fps, width, height, chroma, content (the planes as stored) and bytes_read (of its file, by its
    task so far). Options: corrupt (raise, or skip frames that are cut off or don't begin as frames do) and pieceBytes."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(FrameSource)


def read_frames(spark: SparkSession, path: str, corrupt: str = "raise") -> DataFrame:
    register(spark)
    return spark.read.format("frames").option("corrupt", corrupt).load(path)


def frames_at(spark: SparkSession, path: str, indices: DataFrame, corrupt: str = "skip") -> DataFrame:
    """The frames whose numbers stand in indices (frame), of every container under the path. Up to MOST_PUSHED numbers are
    pushed down, and only their bytes are read; more are joined."""
    wanted = indices.select("frame").filter("frame is not null").distinct()
    few = [r.frame for r in wanted.limit(MOST_PUSHED + 1).collect()]
    frames = read_frames(spark, path, corrupt)
    return frames.filter(F.col("frame").isin(few)) if len(few) <= MOST_PUSHED else frames.join(wanted, "frame", "left_semi")


def write_frames(rows: DataFrame, folder: str, fps: int = 30) -> DataFrame:
    """rows (video, frame, width, height, content: gray bytes) as one mono container for each video, folder/video.y4m: video,
    path, frames and bytes of each.

    A container is one sequential file, so a video is written by one task, a row at a time. Frames of a video must be
    numbered 0, 1, ... and have one size. A file gets its name when it is whole.
    """
    top = folder.rstrip("/")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, video, staged, size, count = None, None, None, 0, 0

        def finish() -> pd.DataFrame:
            out.close()
            path = f"{top}/{video}{SUFFIX}"
            at(staged)[0].move(at(staged)[1], at(path)[1])
            return pd.DataFrame([(video, path, count, size)], columns=["video", "path", "frames", "bytes"])

        for b in batches:
            for v, i, w, h, content in zip(b["video"], b["frame"], b["width"], b["height"], b["content"]):
                if out is None or v != video:
                    if out is not None:
                        yield finish()
                    video, staged, shape, count = v, f"{top}/_staged/{uuid.uuid4().hex}", (w, h), 0
                    store, inner = at(staged)
                    store.create_dir(os.path.dirname(inner), recursive=True)
                    out = store.open_output_stream(inner)
                    head = MAGIC + f" W{w} H{h} F{fps}:1 Cmono\n".encode()
                    out.write(head)
                    size = len(head)
                if i != count or (w, h) != shape or len(content) != w * h:
                    raise ValueError(f"frame {i} of video {v}: expected number {count} of {shape[0]} x {shape[1]} pixels")
                out.write(FRAME + content)
                count, size = count + 1, size + len(FRAME) + len(content)
        if out is not None:
            yield finish()

    dealt = rows.select(F.col("video").cast("string").alias("video"), "frame", "width", "height", "content").repartition(n, "video").sortWithinPartitions("video", "frame")
    return cut(dealt.mapInPandas(work, "video string, path string, frames long, bytes long"))
