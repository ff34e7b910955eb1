"""Frame containers, streamed digests and placed files."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from sightline.sources import frames, store

SIZE = 6 * 4


def container(path, n, start=0):
    with open(path, "wb") as f:
        f.write(b"YUV4MPEG2 W6 H4 F30000:1001 Ip Cmono\n")
        for i in range(start, start + n):
            f.write(b"FRAME\n" + bytes((i + j) % 251 for j in range(SIZE)))


def pixels(i):
    return bytes((i + j) % 251 for j in range(SIZE))


def test_frames_are_read_by_their_ranges(spark, tmp_path):
    container(tmp_path / "long.y4m", 10_000)
    wanted = [0, 1, 77, 500, 4999, 5000, 7777, 9998, 9999, 12_345]
    df = frames.read_frames(spark, str(tmp_path)).filter(F.col("frame").isin(wanted))
    got = {r.frame: r for r in df.collect()}
    assert {i: bytes(r.content) for i, r in got.items()} == {i: pixels(i) for i in wanted[:-1]}
    # a header and nine frames, of ten thousand
    assert max(r.bytes_read for r in got.values()) <= frames.HEAD + 9 * (SIZE + 6)
    assert df.rdd.getNumPartitions() == 1
    few = frames.read_frames(spark, str(tmp_path)).filter("frame >= 20 and frame < 25 and frame % 2 = 1")
    assert sorted(r.frame for r in few.collect()) == [21, 23] and max(r.bytes_read for r in few.collect()) <= frames.HEAD + 5 * (SIZE + 6)
    assert got[77].fps == pytest.approx(29.97, abs=1e-3) and (got[77].width, got[77].height, got[77].chroma) == (6, 4, "mono")


def test_pieces_cover_every_frame_once(spark, tmp_path):
    container(tmp_path / "a.y4m", 1003)
    container(tmp_path / "b.y4m", 0)
    container(tmp_path / "c.y4m", 1)
    frames.register(spark)
    df = spark.read.format("frames").option("pieceBytes", 997).load(str(tmp_path))
    rows = df.select("path", "frame", "content").collect()
    assert sorted((os.path.basename(r.path), r.frame) for r in rows) == [("a.y4m", i) for i in range(1003)] + [("c.y4m", 0)]
    assert all(bytes(r.content) == pixels(r.frame) for r in rows) and df.rdd.getNumPartitions() > 20
    one = df.filter(F.col("path") == f"{tmp_path}/c.y4m")
    assert one.count() == 1


def test_corrupt_frames_raise_or_are_skipped(spark, tmp_path):
    path = tmp_path / "bad.y4m"
    container(path, 50)
    raw = bytearray(path.read_bytes())
    start = raw.index(b"\n") + 1
    raw[start + 7 * (SIZE + 6)] = 0  # frame 7 does not begin as frames do
    path.write_bytes(raw[:-3])  # the last one is cut off
    with pytest.raises(Exception, match="frame 7 of"):
        frames.read_frames(spark, str(path)).collect()
    assert sorted(r.frame for r in frames.read_frames(spark, str(path), "skip").collect()) == [i for i in range(49) if i != 7]
    indices = spark.createDataFrame([(7,), (8,), (8,), (None,), (49,), (60,)], "frame long")
    assert [r.frame for r in frames.frames_at(spark, str(path), indices).collect()] == [8]
    (tmp_path / "none.y4m").write_bytes(b"not a video")
    with pytest.raises(Exception, match="not a frame container"):
        frames.read_frames(spark, str(tmp_path / "none.y4m")).collect()
    with pytest.raises(Exception, match="absent"):
        frames.read_frames(spark, str(tmp_path / "absent")).collect()


def test_headers():
    assert frames.header(b"YUV4MPEG2 W5 H3 F25:1\nFRAME").size == 15 + 2 * 3 * 2
    assert frames.header(b"YUV4MPEG2 W5 H3 F25:1 C422\n").size == 15 + 2 * 3 * 3
    assert frames.header(b"YUV4MPEG2 W5 H3 F25:1 C444 XA=b\n").size == 45
    with pytest.raises(ValueError, match="420p10"):
        frames.header(b"YUV4MPEG2 W5 H3 C420p10\n")


def test_containers_are_written_whole(spark, tmp_path):
    rows = spark.createDataFrame([(v, i, 6, 4, pixels(i * 3 + v)) for v in (1, 2, 3) for i in range(40)], "video long, frame long, width int, height int, content binary").repartition(7)
    made = {r.video: r for r in frames.write_frames(rows, str(tmp_path / "out")).collect()}
    assert {r.frames for r in made.values()} == {40} and made["2"].bytes == os.path.getsize(made["2"].path)
    back = frames.read_frames(spark, str(tmp_path / "out")).collect()
    assert {(os.path.basename(r.path), r.frame, bytes(r.content)) for r in back} == {(f"{v}.y4m", i, pixels(i * 3 + v)) for v in (1, 2, 3) for i in range(40)}
    with pytest.raises(Exception, match="expected number"):
        frames.write_frames(rows.filter("frame <> 5"), str(tmp_path / "gap"))
    assert not [f for f in os.listdir(tmp_path / "gap") if f.endswith(".y4m")]


def test_digests_are_streamed(spark, tmp_path):
    big = tmp_path / "sparse.bin"
    with open(big, "wb") as f:
        f.truncate((96 << 20) + 5)
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "a b.bin").write_bytes(b"xyz")
    names = [str(big), str(tmp_path / "empty.bin"), "file:" + str(tmp_path / "a b.bin"), None]
    got = {r.path: r for r in store.hashed(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert (got[names[0]].chunks, got[names[0]].length) == (97, (96 << 20) + 5)
    whole = hashlib.sha256()
    for _ in range(96):
        whole.update(bytes(1 << 20))
    whole.update(bytes(5))
    assert got[names[0]].sha256 == whole.hexdigest()
    assert got[names[1]].md5 == hashlib.md5(b"").hexdigest() and got[names[1]].chunks == 0
    assert got[names[2]].sha256 == hashlib.sha256(b"xyz").hexdigest() and got[None].sha256 is None


def test_listing_goes_down_the_tree(spark, tmp_path):
    for name in ("a/1.txt", "a/b/c/2.txt", "3.txt"):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345"[: int(name[-5])])
    os.makedirs(tmp_path / "nothing")
    assert {(r.path, r.length) for r in store.listed(spark, str(tmp_path)).collect()} == {(f"{tmp_path}/a/1.txt", 1), (f"{tmp_path}/a/b/c/2.txt", 2), (f"{tmp_path}/3.txt", 3)}


def files_below(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(folder) for n in names if not n.endswith(".crc")}


def test_files_are_placed_whole_or_not_at_all(spark, tmp_path):
    source, target = tmp_path / "source", tmp_path / "target"
    os.makedirs(source)
    want = {}
    for i in range(30):
        (source / f"{i}.bin").write_bytes(bytes([i]) * 1000)
        want[f"part{i % 3}/{i}.jpg"] = bytes([i]) * 1000
    files = spark.createDataFrame([(str(source / f"{i}.bin"), f"part{i % 3}/{i}.jpg") for i in range(30)], "source string, name string")

    def fails_midway(source, target, link):
        if source.endswith("/17.bin"):
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as f:
                f.write(b"half")
            raise OSError("lost midway")
        return store.copied(source, target, link)

    with pytest.raises(Exception, match="lost midway"):
        store.materialised(files, str(target), copy=fails_midway)
    assert files_below(target) == {}
    for link, mode in ((True, "hardlink"), (False, "copy")):
        done = store.materialised(files, str(target), link)
        assert {r["mode"]: r["count"] for r in done.groupBy("mode").count().collect()} == {mode: 30}
        assert files_below(target) == want
    with pytest.raises(ValueError, match="two files"):
        store.materialised(files.union(files.limit(1)), str(target))
    assert files_below(target) == want


def test_publishing_again_changes_nothing(tmp_path):
    (tmp_path / "staged").write_bytes(b"abc")
    for _ in range(2):
        store.publish(str(tmp_path / "staged"), str(tmp_path / "to/name"), 3)
    assert (tmp_path / "to/name").read_bytes() == b"abc"
    with pytest.raises(FileNotFoundError):
        store.publish(str(tmp_path / "gone"), str(tmp_path / "to/other"), 3)
