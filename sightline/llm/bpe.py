"""Byte-level BPE encoding and decoding with a global distinct-word shuffle.

Texts are put together in blocks of about `BLOCK_CHARS` characters, in the order in which they are
scanned, and the matches of the split pattern are the words. Only the distinct words of a block travel:
they are dealt to buckets by hash, each distinct word of a bucket is encoded once, and its ids go back to
the blocks that hold it, where texts are put together again by the positions of their words. Words and ids
travel as packed bytes, so this costs a small part of what one row for each position would. A bucket is
read as a stream; a worker holds the distinct words of one bucket, or one block.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import small_batches

#: Characters of a block. A longer text is a block of its own.
BLOCK_CHARS = 24_000_000

#: Texts whose ids leave a worker together.
BATCH = 64
#: Words of a bucket whose ids a worker remembers.
KNOWN = 1 << 20

_ROW = "bucket int, block string, kind int, body binary"


def load_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to ids, from a rank file: a base64 token and its id on each line."""
    pairs = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: the neighbouring pair of parts whose union has the lowest rank is merged (the
    leftmost of equal ones) until none has a rank. A heap makes it n log n for a word of n bytes."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue  # one of its parts has been merged since
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _pack(parts: list[bytes]) -> bytes:
    sizes = np.array([len(p) for p in parts], "<u4").tobytes()
    return zlib.compress(len(parts).to_bytes(4, "little") + sizes + b"".join(parts), 1)


def _unpack(body: bytes) -> list[bytes]:
    raw = zlib.decompress(body)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate([[4 + 4 * n], ends[:-1]])
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[str, list, list[str]]]:
    """(name, ids, texts) of successive blocks of a partition; a name tells the partition and the block's number."""
    task, ids = None, []
    texts: list[str] = []
    size = k = 0
    for b in batches:
        if b.num_rows:
            task = b.column(2)[0].as_py()
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if texts and size + len(t or "") > chars:
                yield f"{task}.{k}", ids, texts
                ids, texts, size, k = [], [], 0, k + 1
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1])
    if texts:
        yield f"{task}.{k}", ids, texts


def _pieces(texts: pa.Array, pattern: str, spaced: bool) -> tuple[dict[str, int], list[np.ndarray], list[int], list[int], list[int]]:
    """The distinct words of a block's texts with their numbers, for each text the numbers of its pieces, for each piece where its words begin and
    end in a list of numbers of words, and this list. With spaced (see encode), a text is cut at every space before a character that
    is no blank, and each distinct piece is split once; else its words are its pieces."""
    import regex

    split, blank = regex.compile(pattern), regex.compile(r"\s")
    number: dict[str, int] = defaultdict(count().__next__)
    if not spaced:
        places = [np.array(list(map(number.__getitem__, split.findall(t))), np.uint32) for t in texts.to_pylist()]
        return number, places, list(range(len(number))), list(range(1, len(number) + 1)), list(range(len(number)))
    lists = pc.split_pattern(texts, " ")
    ends, coded = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
    at, known = coded.indices.to_numpy().copy(), coded.dictionary
    # what can't follow a space as a piece: nothing, and blanks
    begins = pc.utf8_slice_codeunits(known, 0, 1).dictionary_encode()
    odd = np.array([not c or blank.match(c) is not None for c in begins.dictionary.to_pylist()], bool)[begins.indices.to_numpy()]
    # others are numbered behind these: firsts, which have no space before them, and the words of texts with such blanks, which are split whole
    more: dict[tuple[bool, str], int] = defaultdict(count(len(known)).__next__)
    starts = ends[:-1]
    wrong = odd[at]
    wrong[starts] = False
    whole = np.flatnonzero(np.add.reduceat(wrong, starts) if len(starts) else starts)
    if 2 * len(whole) > len(starts):
        return _pieces(texts, pattern, False)
    at[starts] = [more[True, k] for k in known.take(pa.array(at[starts])).to_pylist()]
    places = np.split(at, ends[1:-1]) if len(starts) else []
    for i in whole.tolist():
        places[i] = np.array([more[False, w] for w in split.findall(texts[i].as_py())], at.dtype)
    # pieces are split all at once: each begins with a match of its own
    plain = known.filter(pa.array(~odd))
    spaces = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (" ", plain, "")))
    joined = str(memoryview(spaces.buffers()[2])[: pc.sum(pc.binary_length(spaces)).as_py()], "utf-8") if len(plain) else ""
    found = split.findall(joined)
    lo, hi = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    hi[~odd] = np.searchsorted(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), np.cumsum(pc.utf8_length(spaces).to_numpy()), "right")
    lo[~odd] = np.concatenate([[0], hi[~odd][:-1]])[: len(plain)]
    lo, hi = lo.tolist(), hi.tolist()
    for first, k in more:
        own = split.findall(k) if first else [k]
        lo.append(len(found))
        found += own
        hi.append(len(found))
    return number, places, lo, hi, list(map(number.__getitem__, found))


def _by_bucket(words: dict[str, object], buckets: int) -> dict[int, tuple[list[bytes], list[int]]]:
    """Distinct words, dealt by hash, and their numbers. Words stay in the order in which a block's texts
    first have them, so that both sides list them alike."""
    out: dict[int, tuple[list[bytes], list[int]]] = defaultdict(lambda: ([], []))
    digest = xxhash.xxh64_intdigest
    for i, w in enumerate(words):
        w = w.encode("utf-8", "replace")
        own, numbers = out[digest(w) % buckets]
        own.append(w)
        numbers.append(i)
    return out


def _mark(words: list[bytes]) -> bytes:
    return xxhash.xxh64_digest(b"\0".join(words))


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, int, bytes]]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "kind", "body")))


def _batches(rows: Iterator[tuple[int, str, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]]), pa.array([row[2]], pa.int32()), pa.array([row[3]], pa.binary())], names=["bucket", "block", "kind", "body"])


def _ranks(ranks_file: bytes) -> dict[bytes, int]:
    ranks = load_ranks(ranks_file)
    if len(set(ranks.values())) != len(ranks) or any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("the ranks must be distinct and cover all bytes")
    return ranks


def _bytes_of(ids: list[int], table: dict[int, bytes]) -> bytes:
    """The bytes of tokens in order, by the table of token bytes."""
    return b"".join(map(table.__getitem__, ids))


def _by_id(ranks: dict[bytes, int]) -> np.ndarray:
    """The bytes of each token at its id; an id without one has None, which can't be joined."""
    out = np.full(max(ranks.values()) + 1, None, object)
    for token, i in ranks.items():
        out[i] = token
    return out


def decode(rows: DataFrame, ranks_file: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows and out: the bytes of the tokens whose ids stand in an array column, in order, by the table of token bytes (a
    vocabulary, whose size doesn't depend on the data). No ids give no bytes; null gives null; an id that the table lacks, and
    a null id, fail the job."""
    small_batches(rows.sparkSession)
    table = rows.sparkSession.sparkContext.broadcast({i: token for token, i in _ranks(ranks_file).items()})

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        return pa.array([_bytes_of(x.values.to_pylist(), table.value) if x.is_valid else None for x in lists], pa.binary())

    return rows.withColumn(out, joined(F.col(ids)))


def round_trip(docs: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, spaced: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 and bypassed (see encode). What is decoded is a row's ids as they were put
    together, not its words, and in the task that has them, so that ids need not travel."""
    return encode(docs, ranks_file, pattern, id_col, text, block_chars, back=True, spaced=spaced).drop("ids")


def encode(docs: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, back: bool = False, spaced: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256 (of the decimal ids, joined by commas), ids and bypassed for each row. With back, ids are null
    and there is decoded_sha256, of the bytes that they decode to.

    A null text counts as empty (no ids). Repeated rows are encoded like any other; no rows give no rows. A block
    that finds words other than those it sent (a task that was run again over rows in another order)
    encodes the missing ones itself, so its result is the same; bypassed tells how many words of a row's block that were.

    spaced: the pattern matches every character, has a match begin at every space before a character that is no blank, and what it
    matches before that space doesn't depend on what follows it. Texts are split piece by piece then, each distinct piece of a
    block once; texts where a space stands before another blank are split whole,
    and so are all of a block if most are such.
    """
    ranks = _ranks(ranks_file)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # a vocabulary: its size doesn't depend on the data
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the partition's number in the scan itself: the task's own number would count the other side of a union
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.spark_partition_id().alias("part"))
    id_type = slim.schema["id"].dataType

    def send_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for name, _, texts in _blocks(it, block_chars):
                seen = _pieces(pa.array(texts, pa.large_string()), pattern, spaced)[0]
                for bucket, (words, _) in _by_bucket(seen, buckets).items():
                    yield bucket, name, 0, _pack(words)

        return _batches(rows())

    def encode_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value

        def rows():
            at, known = None, {}
            for bucket, block, _, body in _streams(it):
                if bucket != at:
                    at, known = bucket, {}
                ids = []
                for w in (words := _unpack(body)):
                    if (e := known.get(w)) is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        e = known[w] = np.array(encode_word(w, table), "<u4").tobytes()
                    ids.append(e)
                yield bucket, block, 0, _mark(words) + _pack(ids)

        return _batches(rows())

    def send_texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for name, ids, texts in _blocks(it, block_chars):
                sink = pa.BufferOutputStream()
                held = pa.table({"id": pa.array(ids), "text": pa.array(texts, pa.large_string())})
                with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(held)
                yield -1, name, 1, sink.getvalue().to_pybytes()

        return _batches(rows())

    def reassemble(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        tokens = _by_id(table) if back else None
        at, came = None, {}
        for bucket, block, kind, body in _streams(it):
            if block != at:
                at, came = block, {}
            if not kind:
                came[bucket] = body
                continue
            held = pa.ipc.open_stream(body).read_all()
            # each text becomes the numbers of its pieces by position; ids are kept for each word, then for each piece
            number, places, begins, ends, numbers_of = _pieces(held.column("text").combine_chunks(), pattern, spaced)
            held = held.drop_columns("text")
            ids, listed, bypassed = [b""] * len(number), [""] * len(number), 0
            for k, (words, numbers) in _by_bucket(number, buckets).items():
                sent = came.pop(k, b"")
                if sent[:8] == _mark(words):
                    packed = _unpack(sent[8:])
                else:
                    packed = [np.array(encode_word(w, table), "<u4").tobytes() for w in words]
                    bypassed += len(words)
                names = list(map(str, np.frombuffer(b"".join(packed), "<u4").tolist()))
                at_token = 0
                for i, e in zip(numbers, packed):
                    end = at_token + len(e) // 4
                    ids[i], listed[i] = e, "".join([x + "," for x in names[at_token:end]])
                    at_token = end
            del number
            each, names = [ids[i] for i in numbers_of], [listed[i] for i in numbers_of]
            ids, listed = [b"".join(each[a:b]) for a, b in zip(begins, ends)], ["".join(names[a:b]) for a, b in zip(begins, ends)]
            del each, names, begins, ends, numbers_of
            for lo in range(0, len(places), BATCH):
                part = [p.tolist() for p in places[lo : lo + BATCH]]
                shas = [hashlib.sha256("".join(map(listed.__getitem__, p))[:-1].encode()).hexdigest() for p in part]
                whole = [b"".join(map(ids.__getitem__, p)) for p in part]
                sizes = np.array([len(w) // 4 for w in whole], np.int64)
                if back:
                    lists = pa.nulls(len(part), pa.list_(pa.int32()))
                    decoded = pa.array([hashlib.sha256(b"".join(tokens[np.frombuffer(w, "<u4")].tolist())).hexdigest() for w in whole], pa.string())
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(whole), "<u4").astype(np.int32)))
                    decoded = pa.nulls(len(part), pa.string())
                cols = [held.column("id").slice(lo, BATCH).combine_chunks(), pa.array(sizes), pa.array(shas, pa.string()), lists, decoded, pa.array([bypassed] * len(part), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "ids_sha256", "ids", "decoded_sha256", "bypassed"])

    ids = slim.mapInArrow(send_words, _ROW).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(encode_words, _ROW)
    blobs = slim.mapInArrow(send_texts, _ROW)
    both = ids.union(blobs).repartition(buckets, "block").sortWithinPartitions("block", "kind")
    schema = f"id {id_type.simpleString()}, n_tokens long, ids_sha256 string, ids array<int>, decoded_sha256 string, bypassed long"
    out = both.mapInArrow(reassemble, schema).withColumnRenamed("id", id_col)
    return out if back else out.drop("decoded_sha256")
