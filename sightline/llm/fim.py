"""Fill-in-middle transformation on ropes.

A text is a balanced tree: its leaves hold runs of at most LEAF units (words of ASCII letters, or any other single code
point), and every node caches the units and the code points below it. A text is split at a unit rank by walking down one
path; no more than one leaf is scanned. The three pieces of a document are subtrees, joined in another order with
sentinel leaves between them. The way back cuts the output's own tree at its sentinels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import small_batches

LEAF = 256
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are left plain, and of the others so many are spm.
PLAIN_SHARE, SPM_SHARE, SEED = 10, 20, 1

_UNIT = r"(?:[A-Za-z]++|[^A-Za-z])"
_RUN = re.compile(_UNIT + f"{{1,{LEAF}}}+")
_UNITS = re.compile(_UNIT)
_SENTINEL = re.compile("|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))


class Rope:
    """A leaf (text) or an inner node (left, right); units and chars count what is below."""

    __slots__ = ("chars", "left", "right", "text", "units")

    def __init__(self, text: str = "", units: int = 0, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        self.units = left.units + right.units if left is not None and right is not None else units
        self.chars = left.chars + right.chars if left is not None and right is not None else len(text)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                out.append(node.text)
            else:
                todo += (node.right, node.left)
        return "".join(out)


def leaf(text: str) -> Rope:
    return Rope(text, len(_UNITS.findall(text)))


def rope(text: str) -> Rope:
    """The balanced tree of a text; all of its leaves but the last have LEAF units."""
    runs = [m.group() for m in _RUN.finditer(text)]
    level = [Rope(x, LEAF) for x in runs[:-1]] + [leaf(x) for x in runs[-1:]]
    while len(level) > 1:
        level = [join(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0] if level else Rope()


def join(*parts: Rope) -> Rope:
    """The parts in a row; empty ones leave no node."""
    out = None
    for part in parts:
        if part.chars:
            out = part if out is None else Rope(left=out, right=part)
    return out or Rope()


def split(node: Rope, rank: int) -> tuple[Rope, Rope]:
    """What stands before and from the unit of that rank (from 0)."""
    before, after = [], []
    while node.left is not None:
        if rank <= node.left.units:
            after.append(node.right)
            node = node.left
        else:
            before.append(node.left)
            rank -= node.left.units
            node = node.right
    if 0 < rank < node.units:
        at = re.compile(_UNIT + f"{{{rank}}}+").match(node.text).end()
        a, b = Rope(node.text[:at], rank), Rope(node.text[at:], node.units - rank)
    else:
        a, b = (node, Rope()) if rank else (Rope(), node)
    return join(*before, a), join(b, *reversed(after))


def rank_at(node: Rope, char: int) -> int:
    """The units before a code point offset that is a unit's edge."""
    rank = 0
    while node.left is not None:
        if char <= node.left.chars:
            node = node.left
        else:
            rank, char, node = rank + node.left.units, char - node.left.chars, node.right
    return rank + len(_UNITS.findall(node.text, 0, char))


def rearranged(text: str, h: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output) of a text, by four numbers: two choose the cuts, two the form."""
    whole = rope(text)
    n = whole.units
    if not text or _SENTINEL.search(text) or h[2] % 100 >= 100 - PLAIN_SHARE:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    rest, suffix = split(whole, high)
    prefix, middle = split(rest, low)
    p, s, m = (Rope(x, 3) for x in (PREFIX, SUFFIX, MIDDLE))
    form = "spm" if h[3] % 100 < SPM_SHARE else "psm"
    out = join(s, suffix, p, prefix, m, middle) if form == "spm" else join(p, prefix, s, suffix, m, middle)
    return n, form, prefix.chars, middle.chars, str(out)


def restored(output: str, form: str) -> str:
    """The text, from output and form alone: the output's tree is split at its sentinels, and the pieces are put in order."""
    if form == "plain":
        return output
    whole, pieces = rope(output), {}
    for mark in reversed(list(_SENTINEL.finditer(output))):  # from the right, so that what stands before keeps its ranks
        whole, tail = split(whole, rank_at(whole, mark.start()))
        pieces[mark.group()] = split(tail, 3)[1]
    return str(join(pieces[PREFIX], pieces[MIDDLE], pieces[SUFFIX]))


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """id_col, n (units), form, prefix_chars, middle_chars and output, one row for each row of docs.

    A null text is empty, and an empty text plain. A null id counts as the empty string in the hash. Repeated rows get equal
    results, equal ids equal numbers. Extra columns play no part; no rows give no rows. A text is one string in a task,
    at most BATCH_ROWS of them at a time.
    """
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"), digest.alias("digest"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [rearranged(t, tuple(int(d[8 * i : 8 * i + 8], 16) for i in range(4))) for t, d in zip(b.text, b.digest)]
            out = pd.DataFrame(found, columns=["n", "form", "prefix_chars", "middle_chars", "output"]).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
            yield pd.concat([b[["id"]].reset_index(drop=True), out], axis=1)

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInPandas(work, schema).withColumnRenamed("id", id_col)


def restore(rows: DataFrame) -> DataFrame:
    """rows (form, output, others) and restored: the text before the transformation. A null output stays null."""
    small_batches(rows.sparkSession)

    @F.pandas_udf("string")
    def texts(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else restored(o, f) for o, f in zip(output, form)], dtype=object)

    return rows.withColumn("restored", texts("output", "form"))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """What transform() gives, with digests of the output and of the text restored from it."""
    both = restore(transform(docs, id_col, text))
    return both.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
