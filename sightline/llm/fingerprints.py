"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL functions only.

A paragraph is a line with any text; a document's paragraphs are a set of 64-bit digests. A sketch has
three sub-tables of eight cells; each digest adds itself to one cell of each: to a count, to the XOR of
the digests, and to the XOR of their checksums. Sketches subtract cell by cell. In a difference, a cell of
count 1 or -1 whose checksum fits holds one digest, which is peeled off all its cells, until no cell is
left: what was peeled is what one version has and the other has not. If cells remain, the difference is
retried larger, with another seed: the table becomes 4 ** n blocks of such cells, as many as the two sets
need by their sizes, and a seeded hash gives each digest its block and its cells. Blocks that still can't
be peeled are retried alone, four times as large and with the next seed, until none is left.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.common import let

SUBTABLES, CELLS = 3, 8
#: Bits of a hash that give the cells; the bits above give the block.
CELL_BITS = 9
ROUNDS = 9
#: Digests that a block is expected to hold at most.
LOAD = 6.0
#: The last try. A try fails with a chance below 1/20 for a block and each has another seed, so that none gets there.
LAST_TRY = 24

_FOUND = "array<struct<k:bigint,c:int>>"
_BLOCKS = "array<struct<a:array<bigint>,b:array<bigint>>>"


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs; none for null and blank texts."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def _hash(key: Column, seed: Column | None) -> Column:
    """The bits that place a digest: its own at first, then those of a seeded hash."""
    return key if seed is None else F.xxhash64(key, seed)


def _place(bits: Column, sub: int) -> Column:
    return F.shiftrightunsigned(bits, 3 * sub).bitwiseAND(F.lit(CELLS - 1))


def _xor(keys: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(of(k)))


def sketch(keys: Column, seed: Column | None = None) -> Column:
    """The cells of a set of digests, sub-table by sub-table."""
    places = F.sequence(F.lit(0).cast("long"), F.lit(CELLS - 1).cast("long"))

    def cells(placed: Column) -> Column:
        def cell(sub: int) -> Callable[[Column], Column]:
            def made(i: Column) -> Column:
                mine = F.filter(placed, lambda x: _place(x["at"], sub) == i)
                return let(mine, lambda xs: F.struct(F.size(xs).alias("c"), _xor(xs, lambda x: x["k"]).alias("k"), _xor(xs, lambda x: x["h"]).alias("h")))

            return made

        return F.concat(*[F.transform(places, cell(s)) for s in range(SUBTABLES)])

    return let(F.transform(keys, lambda k: F.struct(k.alias("k"), _hash(k, seed).alias("at"), F.xxhash64(k).alias("h"))), cells)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def text_of(cells: Column) -> Column:
    """A sketch as a string: 8, 16 and 16 hexadecimal digits for each cell."""
    return F.array_join(F.transform(cells, lambda x: F.lower(F.concat(F.lpad(F.hex(x["c"]), 8, "0"), F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["h"]), 16, "0")))), "")


def peel(difference: Column, seed: Column | None = None) -> Column:
    """The digests k of a difference with c = 1 (only in the first) or -1 (only in the second); null if
    cells remain that can't be peeled."""
    start = F.struct(difference.alias("cells"), F.array().cast(_FOUND).alias("found"))

    def step(state: Column, _: Column) -> Column:
        pure = F.array_distinct(
            F.transform(F.filter(state["cells"], lambda x: (F.abs(x["c"]) == 1) & (x["h"] == F.xxhash64(x["k"]))), lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c")))
        )

        def strip(ps: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                sub = F.floor(i / CELLS).cast("int")
                place = lambda k: let(_hash(k, seed), lambda h: F.when(sub == 0, _place(h, 0)).when(sub == 1, _place(h, 1)).otherwise(_place(h, 2)))
                mine = F.filter(ps, lambda p: place(p["k"]) == i % CELLS)
                return let(mine, lambda ms: F.when(F.size(ms) == 0, x).otherwise(
                    F.struct(
                        (x["c"] - F.aggregate(ms, F.lit(0), lambda a, p: a + p["c"])).alias("c"),
                        x["k"].bitwiseXOR(_xor(ms, lambda p: p["k"])).alias("k"),
                        x["h"].bitwiseXOR(_xor(ms, lambda p: F.xxhash64(p["k"]))).alias("h"),
                    )
                ))

            return F.when(F.size(ps) == 0, state).otherwise(F.struct(F.transform(state["cells"], one).alias("cells"), F.concat(state["found"], ps).alias("found")))

        return let(pure, strip)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return let(done, lambda s: F.when(F.forall(s["cells"], lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0)), s["found"]))


def _dealt(blocks: Column, times: Column, seed: Column) -> Column:
    """Every block (a, b) as 4 ** times blocks, by two bits of the seeded hash each time: 4 passes over the digests a time."""

    def quarter(block: Column, level: Column) -> Column:
        shift = (F.lit(CELL_BITS) + 2 * (level - 1)).cast("int")
        mine = lambda keys, q: F.filter(keys, lambda k: F.call_function("shiftrightunsigned", _hash(k, seed), shift).bitwiseAND(F.lit(3)) == q)
        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), lambda q: F.struct(mine(block["a"], q).alias("a"), mine(block["b"], q).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), times), blocks, lambda parts, level: F.flatten(F.transform(parts, lambda p: quarter(p, level))))


def grown(a: Column, b: Column) -> Column:
    """(found, tries) of two sets of digests from tables that grow; the first try was the plain sketch."""
    times = F.greatest(F.lit(1), F.ceil(F.log2((F.size(a) + F.size(b)) / LOAD) / 2).cast("int"))
    start = F.struct(F.array().cast(_FOUND).alias("found"), F.array(F.struct(a.alias("a"), b.alias("b"))).cast(_BLOCKS).alias("left"), F.lit(1).alias("tries"))

    def peeled(block: Column, seed: Column) -> Column:
        empty = F.size(block["a"]) + F.size(block["b"]) == 0
        return F.when(empty, F.array().cast(_FOUND)).otherwise(peel(subtract(sketch(block["a"], seed), sketch(block["b"], seed)), seed))

    def step(state: Column, seed: Column) -> Column:
        blocks = _dealt(state["left"], F.when(seed == 2, times).otherwise(1), seed)
        tried = F.transform(blocks, lambda p: F.struct(p.alias("block"), peeled(p, seed).alias("found")))

        def split(xs: Column) -> Column:
            new = F.flatten(F.transform(F.filter(xs, lambda x: x["found"].isNotNull()), lambda x: x["found"]))
            left = F.transform(F.filter(xs, lambda x: x["found"].isNull()), lambda x: x["block"])
            return F.struct(F.concat(state["found"], new).alias("found"), left.alias("left"), seed.alias("tries"))

        return F.when(F.size(state["left"]) == 0, state).otherwise(let(tried, split))

    done = F.aggregate(F.sequence(F.lit(2), F.lit(LAST_TRY)), start, step)
    return let(done, lambda s: F.when(F.size(s["left"]) == 0, F.struct(s["found"].alias("found"), s["tries"].alias("tries"))).otherwise(F.raise_error(F.lit("a difference can't be peeled"))))


def compared(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """rows and, for each name in pairs, an array of the digests on one side only (k, and c = 1 for the
    first or -1 for the second side), and name_tries, the number of tables that it took. pairs: columns of
    digests (x, y) whose sketches are x_sketch and y_sketch. Only a row whose sketches can't be peeled pays for larger ones.
    """

    def found(a: str, b: str) -> Column:
        direct = peel(subtract(F.col(f"{a}_sketch"), F.col(f"{b}_sketch")))
        return let(direct, lambda d: F.when(d.isNotNull(), F.struct(d.alias("found"), F.lit(1).alias("tries"))).otherwise(grown(F.col(a), F.col(b))))

    rows = rows.withColumns({f"_{k}": found(a, b) for k, (a, b) in pairs.items()})
    rows = rows.withColumns({x: y for k in pairs for x, y in ((k, F.col(f"_{k}.found")), (f"{k}_tries", F.col(f"_{k}.tries")))})
    return rows.drop(*[f"_{k}" for k in pairs])


def likeness(a: str, b: str, found: str) -> Column:
    """Jaccard similarity of two sets of digests, from the number of digests that are on one side only."""
    both, d = F.size(a) + F.size(b), F.size(found)
    return F.when(both == 0, 1.0).otherwise((both - d) / (both + d))


def ranges(docs: DataFrame, id_col: str) -> list[int]:
    """Ascending bounds that deal the ids into ranges of about equal size, one for each shuffle partition."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.filter(F.col(id_col).isNotNull()).approxQuantile(id_col, [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    return sorted({int(x) for x in cuts})


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, text (null: empty), own (its digests), next_text and next_own: those of the next row in
    descending order of id (nulls last, ties by text hash); the first row follows the last.

    Ids are dealt into ranges, so that no task orders all rows; the top row of a range is sent to the range
    above as well, where it follows the last one. A table of one row is followed by itself.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    bounds = ranges(docs, id_col)
    coarse, fine = bounds[::64], F.lit(bounds or [0]).cast("array<bigint>")
    if bounds:
        block = F.size(F.filter(F.lit(coarse).cast("array<bigint>"), lambda b: b <= F.col("id")))
        at = let(block, lambda k: F.when(k == 0, 0).otherwise((k - 1) * 64 + F.size(F.filter(F.slice(fine, (k - 1) * 64 + 1, 64), lambda b: b <= F.col("id")))))
    else:
        at = F.lit(0)
    rows = rows.withColumn("part", F.when(F.col("id").isNull(), -1).otherwise(at).cast("int"))
    tops = rows.groupBy("part").agg(F.max(F.struct("id", "th")).alias("top"))
    tops = sorted(tops.select("part", "top.id", "top.th").collect(), key=lambda r: r.part)  # one slim row for each range
    spark = docs.sparkSession
    # the range above each one; the lowest is followed by the topmost
    goes = [(r.part, tops[(i + 1) % len(tops)].part, r.id, r.th) for i, r in enumerate(tops)]
    # one row for each shuffle partition; as a literal, for rows sent from Python would start Python workers
    listed = F.from_json(F.lit(json.dumps([dict(zip(("part", "up", "top_id", "top_th"), g)) for g in goes])), "array<struct<part:int,up:int,top_id:bigint,top_th:bigint>>")
    sent = F.broadcast(spark.range(1, numPartitions=1).select(F.inline(listed)))
    is_top = F.col("id").eqNullSafe(F.col("top_id")) & (F.col("th") == F.col("top_th"))
    to = F.explode(F.when(is_top, F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")), F.struct(F.col("up").alias("part"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")))))
    dealt = rows.join(sent, "part").select("id", "text", "th", to.alias("to")).select("id", "text", "th", F.col("to.part").alias("part"), F.col("to.guest").alias("guest"), digests(F.col("text")).alias("own"))
    order = Window.partitionBy("part").orderBy("guest", F.col("id").desc_nulls_last(), F.desc("th"))
    return (
        dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_own", F.lead("own").over(order)).filter("guest = 0").select(F.col("id").alias(id_col), "text", "own", "next_text", "next_own")
    )


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the number
    of tables (edit_tries, next_tries) that it took to peel the differences.

    The edited text has the last half (rounded down) of a text's code points replaced by the first as many
    of the next one's. Null counts as empty; two texts without paragraphs are alike (1.0). Order and
    repetition of paragraphs don't count. Repeated rows follow each other; no rows give no rows.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs, id_col, text).withColumn("edited", F.concat(F.expr("left(text, cast(length(text) - floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.select(id_col, n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own", digests(F.col("edited")).alias("new"))
    rows = rows.withColumns({f"{c}_sketch": sketch(F.col(c)) for c in ("own", "new", "next_own")})
    rows = compared(rows, {"by_edit": ("own", "new"), "by_next": ("own", "next_own")})
    return rows.select(
        id_col, "n_chars", "edited_sha256", text_of(F.col("own_sketch")).alias("fingerprint"), text_of(F.col("new_sketch")).alias("edited_fingerprint"),
        likeness("own", "new", "by_edit").alias("near_edited"), likeness("own", "next_own", "by_next").alias("near_next"),
        F.col("by_edit_tries").alias("edit_tries"), F.col("by_next_tries").alias("next_tries"),
    )
