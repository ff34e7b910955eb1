"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared vertically: 64 of them share one machine word per bit, a query's bits are
XORed against those planes one plane at a time, and carry-save counters hold all 64 distances at once.
A word whose 64 counters have all passed the radius is abandoned.

Candidates come from the pigeonhole principle, which loses nothing: the 64 bits are cut into `blocks`
parts, and two fingerprints within `radius` bits agree on at least blocks - radius of them. Each choice
of that many parts is one table; rows of a table that agree on its parts are compared with each other.
Only distinct fingerprints take part, so a large group of copies counts once. A task yields a spanning
star for each linked group instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import bucketed, by_second, compared, components, cut, discard, linked_groups, release, small_batches

#: Pairs of (query, word of 64 fingerprints) that are compared together; bounds the working memory.
TILE = 1 << 15
#: Parity bits of a set of shingle hashes, by which most pairs that are not similar are ruled out.
PARITIES = 1024
#: The share of rows that common shingles are looked for in, how often one stands there at least, and how many are noted at most.
SAMPLE, COMMON, NOTED = 16, 3, 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash, unsigned: majority bits of the XXH64 (seed 42) of all word shingles, repeats included.
    A-Z are lower-cased and words are runs without ASCII white space. Fewer words than `shingle` make
    one shingle; null and texts without words give 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    n = len(words) - shingle + 1
    total = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = [digest(b" ".join(words[i : i + shingle]), 42) for i in range(start, min(n, start + (1 << 16)))]
        total += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and fp: the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    slim = docs.select(*keep, F.col(text).alias("_text"))
    schema = slim.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("_text").to_pylist()], np.uint64).view(np.int64)
            cols = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fps, pa.int64())], names=[*keep, "fp"])

    return slim.mapInArrow(run, schema)


def block_masks(blocks: int, radius: int) -> list[int]:
    """A mask of the agreeing bits for each choice of blocks - radius of the blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


class Sliced:
    """Fingerprints in groups, held as bit planes: a group starts a new word, and a word has 64 lanes."""

    def __init__(self, fps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.fps = fps
        sizes = ends - starts
        self.words = (sizes + 63) // 64
        self.first_word = np.concatenate([[0], np.cumsum(self.words)])
        total = int(self.first_word[-1])
        self.row_of = np.full(total * 64, -1, np.int64)
        group = np.repeat(np.arange(len(starts)), sizes)
        within = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = np.repeat(starts, sizes) + within
        lanes = self.first_word[group] * 64 + within
        self.row_of[lanes] = rows
        self.rows, self.lanes, self.group_of = rows, lanes, group
        padded = np.zeros(total * 64, np.uint64)
        padded[lanes] = fps[rows]
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # plane p, word w: bit l is bit p of the fingerprint in lane l of the word
        self.planes = np.ascontiguousarray(np.packbits(bits.reshape(total, 64, 64).transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8").reshape(64, total)
        self.live = np.ascontiguousarray(np.packbits((self.row_of >= 0).reshape(total, 64), axis=1, bitorder="little")).view("<u8").reshape(total)

    def within(self, queries: np.ndarray, words: np.ndarray, radius: int) -> np.ndarray:
        """For each pair of a query row and a word: a mask of the lanes within the radius."""
        live = self.live[words].copy()
        out = np.zeros(len(words), np.uint64)
        order, q, w = np.arange(len(words)), self.fps[queries], words
        counters = [np.zeros(len(words), np.uint64) for _ in range(max(1, radius.bit_length()))]
        over = ~live
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        for p in range(64):
            carry = self.planes[p][w] ^ (np.uint64(0) - ((q >> np.uint64(p)) & np.uint64(1)))
            for c in counters:  # carry-save: half adders over all lanes
                carry, c[:] = c & carry, c ^ carry
            over |= carry
            if p % 8 == 7:
                past = over | self._above(counters, radius)
                stay = past != ones
                if not stay.all():  # abandon the words in which every lane is past the radius
                    order, q, w, over = order[stay], q[stay], w[stay], over[stay]
                    counters = [c[stay] for c in counters]
                    if not len(order):
                        return out
        out[order] = ~(over | self._above(counters, radius))
        return out

    @staticmethod
    def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
        """A mask of the lanes whose counter is above the radius, compared bit by bit from the top."""
        above = np.zeros_like(counters[0])
        equal = ~above
        for i in reversed(range(len(counters))):
            if radius >> i & 1:
                equal &= counters[i]
            else:
                above |= equal & counters[i]
                equal &= ~counters[i]
        return above


def group_links(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int) -> np.ndarray:
    """For each row the smallest row of its own group that it reaches over links within the radius."""
    label = np.arange(len(fps))
    sliced = Sliced(fps, starts, ends)
    n_words = sliced.words[sliced.group_of]  # for each lane's row: the words it is compared with
    done = np.cumsum(n_words)
    at = 0
    while at < len(done):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + TILE, "right")))
        reps = n_words[at:stop]
        q = np.repeat(sliced.rows[at:stop], reps)
        first = sliced.first_word[sliced.group_of[at:stop]]
        w = np.repeat(first, reps) + np.arange(len(q)) - np.repeat(np.cumsum(reps) - reps, reps)
        # the triangle above the diagonal is enough
        keep = (w + 1) * 64 > np.repeat(sliced.lanes[at:stop], reps)
        q, w = q[keep], w[keep]
        for lo in range(0, len(q), TILE):
            hits = sliced.within(q[lo : lo + TILE], w[lo : lo + TILE], radius)
            some = np.flatnonzero(hits)
            for s in range(0, len(some), 4096):
                pick = some[s : s + 4096]
                lanes = np.unpackbits(hits[pick].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                k, lane = np.nonzero(lanes)
                a, b = q[lo + pick[k]], sliced.row_of[w[lo + pick[k]] * 64 + lane]
                _unite(label, a[a != b], b[a != b])
        at = stop
    return _roots(label)


def _roots(label: np.ndarray) -> np.ndarray:
    while (label != (up := label[label])).any():
        label = up
    return label


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hook the roots of linked rows to smaller ones until each link has one root; label is changed."""
    while True:
        label[:] = _roots(label)
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart]))


def _stars(batches: Iterator[pa.RecordBatch], radius: int, most: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Sorted rows (k, part, fp) to edges (a, b). Whole groups are put together up to `most` rows; a
    group is held as 8 bytes a row."""
    keys: list[np.ndarray] = []
    fps: list[np.ndarray] = []

    def flush(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)])
        starts = np.flatnonzero(new)
        ends = np.concatenate([starts[1:], [len(k)]])
        some = ends - starts > 1
        if some.any():
            label = group_links(f.view(np.uint64), starts[some], ends[some], radius)
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(f[moved]), pa.array(f[label[moved]])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys.append(np.stack([batch.column("k").to_numpy(zero_copy_only=False), batch.column("part").to_numpy(zero_copy_only=False)], axis=1))
        fps.append(batch.column("fp").to_numpy(zero_copy_only=False))
        if sum(map(len, fps)) >= most:
            k, f = np.concatenate(keys), np.concatenate(fps)
            edge = np.flatnonzero((k[1:] != k[:-1]).any(axis=1))
            if len(edge):  # the last group may go on in the next batch
                end = edge[-1] + 1
                yield from flush(k[:end], f[:end])
                keys, fps = [k[end:]], [f[end:]]
            else:
                keys, fps = [k], [f]
    if fps:
        yield from flush(np.concatenate(keys), np.concatenate(fps))


def edges(distinct: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that connect all that lie within the radius."""
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in block_masks(blocks, radius)]
    rows = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(masks)])).alias("t")
    ).select(F.col("t.k").cast("long").alias("k"), F.col("t.part").alias("part"), "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "k", "part").sortWithinPartitions("k", "part", "fp").mapInArrow(lambda it: _stars(it, radius), "a long, b long").distinct()


def near_groups(prints: DataFrame, radius: int = 3, blocks: int = 5, id_col: str = "doc_id") -> DataFrame:
    """prints (id_col, fp) to id_col, fp, component_id: the smallest id reachable over links of at most
    `radius` differing bits, itself included. Null ids take part and never name a component unless all
    its ids are null (then null). Repeated rows stay repeated. No rows give no rows."""
    slim = cut(prints.select(F.col(id_col).alias("id"), "fp"))
    distinct = cut(slim.groupBy("fp").agg(F.min("id").alias("first_id")))
    found = components(edges(distinct.select("fp"), radius, blocks))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = named.join(least, "root").select("fp", "component_id")
    return slim.join(label, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex16(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; words and hashes are those of fingerprint(), less the last
    bit, so that they are positive."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(1, np.int64)
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n) >> np.uint64(1)).view(np.int64)


def common_shingles(slim: DataFrame, shingle: int) -> np.ndarray:
    """Ascending hashes of shingles that several of one in SAMPLE texts have, the most frequent NOTED of them at most. It sets
    the order of prefixes and nothing else; results are the same with any."""

    @F.arrow_udf("array<long>")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t, shingle) for t in texts.to_pylist()], pa.list_(pa.int64()))

    some = slim.filter(F.pmod(F.xxhash64("rid"), F.lit(SAMPLE)) == 0).select(F.explode(sets(F.col("text"))).alias("h"))
    top = some.groupBy("h").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(NOTED).select("h").toArrow()
    return np.sort(top.column("h").to_numpy())


def in_order(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Ascending hashes as numbers in the order of prefixes: those that aren't common come first, as negative numbers."""
    if not len(common):
        return hashes + np.int64(-(1 << 63))
    known = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
    return np.concatenate([hashes[~known] + np.int64(-(1 << 63)), hashes[known]])


def likely_pairs(prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """prints (node, fp) to pairs (a, b), a < b: stars that connect all nodes over links of at most `radius` differing bits. Equal
    fingerprints meet at the least of their nodes."""
    heads = cut(prints.groupBy("fp").agg(F.min("node").alias("head"), F.max("node").alias("last")))
    same = prints.join(heads.filter("head <> last"), "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    found = edges(heads.select("fp"), radius, blocks)
    for x in "ab":
        found = found.join(heads.select(F.col("fp").alias(x), F.col("head").alias(f"{x}_node")), x)
    return cut(same.union(found.select(F.least("a_node", "b_node"), F.greatest("a_node", "b_node"))))


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One document of each linked group stays: the one with the smallest doc_id (nulls last; a tie goes to the
    smaller text hash, then to the earlier row). Columns are those of docs; no rows give no rows.

    First come the SimHashes (`likely_pairs`): texts whose fingerprints are within 3 bits, found by bit-sliced comparison and
    verified. What they can't find, as most texts of a similarity near the limit differ in more bits, is completed below.

    Every two texts are linked whose sets of `shingle`-word shingles have a Jaccard similarity of 0.8 or more; null and
    blank texts are alike. Such sets share one of the first n / 5 + 1 hashes of each in any common order, so no link is lost, and candidates
    are verified on the whole sets. Shingles that many texts have come last (`common_shingles`), so that a passage of many texts
    doesn't make pairs of all that have it. What two texts share of these hashes bounds what they can share at all, so most
    others are never fetched. Texts of equal sets count as one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # texts, and below the lists of hashes, lie in buckets: they are joined by their number several times
    filed = bucketed(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*docs.columns).alias("row")), "rid")
    release(spark)
    slim = filed.select("rid", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("th"), F.col("row.text").alias("text"))

    parity = [f"b{i}" for i in range(PARITIES // 64)]
    common = common_shingles(slim, shingle)
    release(spark)

    @F.arrow_udf(f"fp long, n long, s1 long, s2 long, ps array<long>, {', '.join(f'{b} long' for b in parity)}")
    def prints(texts: pa.Array) -> pa.Array:
        sets = [shingles(t, shingle) for t in texts.to_pylist()]
        digests = [pa.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], pa.uint64()).view(pa.int64()) for seed in (1, 2)]
        marks = pa.array([fingerprint(t, shingle) for t in texts.to_pylist()], pa.uint64()).view(pa.int64())
        # one hash more than the prefix of n // 5 + 1
        cols = [pa.array([len(s) for s in sets], pa.int64()), *digests, pa.array([in_order(s, common)[: len(s) // 5 + 2] for s in sets], pa.list_(pa.int64()))]
        odd = np.stack([np.bincount(s & (PARITIES - 1), minlength=PARITIES) & 1 for s in sets]) if sets else np.zeros((0, PARITIES), np.int64)
        words = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<i8")
        return pa.StructArray.from_arrays([marks, *cols, *(pa.array(np.ascontiguousarray(w)) for w in words.T)], ["fp", "n", "s1", "s2", "ps", *parity])

    @F.arrow_udf("array<long>")
    def whole(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t, shingle) for t in texts.to_pylist()], pa.list_(pa.int64()))

    found = cut(slim.withColumn("p", prints(F.col("text"))).select("rid", "id", "th", "p.*"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "th", "rid")
    classes = cut(found.groupBy("s1", "s2").agg(F.min(first).alias("first")).select("first.*"))
    own = bucketed(found.join(classes.select("rid"), "rid", "left_semi").select(F.col("rid").alias("node"), "fp", "n", "ps", *parity), "node")
    discard(found)
    release(spark)
    k = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = own.select("node", F.explode_outer(F.slice("ps", 1, (F.col("n") / 5).cast("int") + 1)).alias("part")).select("part", "node").repartition(k, "part")

    # intersection / union >= 4 / 5, in whole numbers
    reaches = lambda common, n, m: common * 9 >= (n + m) * 4
    enough = lambda a, b: reaches(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))

    def near(a: str, b: str) -> Column:
        """Sets that can be similar: of n + m hashes at most (n + m) / 9 are in one of them alone, and each of those can
        change one parity bit."""
        apart = [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in parity]
        sized = F.least(f"{a}.n", f"{b}.n") * 5 >= F.greatest(f"{a}.n", f"{b}.n") * 4
        return sized & (sum(apart[1:], apart[0]) * 9 <= F.col(f"{a}.n") + F.col(f"{b}.n"))

    def possible(a: str, b: str) -> Column:
        """Up to the lesser of the last hashes both lists are whole; beyond it the smaller rest can be shared at most."""
        top = F.least(F.element_at(f"{a}.ps", -1), F.element_at(f"{b}.ps", -1))
        rest = [F.col(f"{x}.n") - F.size(F.filter(f"{x}.ps", lambda h: h <= top)) for x in (a, b)]
        return reaches(F.size(F.array_intersect(f"{a}.ps", f"{b}.ps")) + F.least(*rest), F.col(f"{a}.n"), F.col(f"{b}.n"))

    def verify(pairs: DataFrame) -> DataFrame:
        lists = own.select("node", F.struct("n", "ps").alias("body"))
        left = cut(compared(pairs, lists, possible))
        nodes = left.select(F.col("a").alias("rid")).union(left.select("b")).distinct()
        bodies = cut(slim.join(nodes, "rid", "left_semi").select(F.col("rid").alias("node"), whole(F.col("text")).alias("body")))
        return compared(left, bodies, enough)

    facts_of = lambda nodes: own.join(nodes, "node", "left_semi").select("node", F.struct("n", *parity).alias("body"))
    again = lambda crowded: by_second(crowded, own.join(crowded.select("node").distinct(), "node", "left_semi").select("node", "ps"))
    groups = cut(linked_groups(rows, facts_of, near, verify, again, likely_pairs(own.select("node", "fp"))))
    # of a group the first by id stays, which need not be its root
    placed = groups.join(classes, F.col("node") == F.col("rid")).select("root", "node", F.struct("none", "id", "th", "rid").alias("first"))
    least = placed.groupBy("root").agg(F.min("first").alias("least")).select(F.col("least.rid").alias("node"))
    lost = placed.select("node").join(least, "node", "left_anti")
    stay = classes.select("rid").join(lost, F.col("rid") == F.col("node"), "left_anti")
    return filed.join(stay.hint("shuffle_hash"), "rid", "left_semi").select("row.*")
