"""Chat formatting by incremental black-box rendering.

A template is a function of a list of turns. Each conversation is rendered turn by turn; where the output with one more
turn begins with the output before, the rest is the new turn's span. A template for which that fails rewrites history:
the turn is marked with the part of the old output that it leaves, and nothing of the conversation is under the loss
mask. Where a turn's own text stands in its span is found by rendering the turn with another text.

A template may declare that it looks back a fixed number of turns and otherwise only adds to its output (`lookback`);
then each comparison begins that many turns back. The declaration is not taken on trust: after 1, 2, 4, 8 and so on turns and
at the end of a conversation the whole prefix is rendered and must be the spans so far, which takes a few times the
conversation's length in all. One that declares nothing is
rendered whole at every turn, which takes the square of a conversation's turns. A conversation is one stream in one
task, as what is put out for it is in sequence.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import small_batches

Turn = tuple[str, str]


class Template(Protocol):
    #: Turns before a turn that its span depends on, besides whether it is the first; None if nothing is known.
    lookback: int | None

    def render(self, turns: list[Turn]) -> str: ...

    def read(self, span: str) -> Turn:
        """Role and text, read back from a turn's span."""
        ...


class BracketTemplate:
    """`<s>` opens a conversation; `[INST] text [/INST]` is a user's turn, ` text </s>` an assistant's, and
    `[TURN role] text [/TURN]` one of any other role.

    Inside texts and roles a control string gets a backslash behind its first character, one more for those
    that have some already; so no control string is left, and taking one away restores the text.
    """

    #: A turn's span is its own; only the first has the opening mark before it.
    lookback = 0
    #: The names that follow < or [ in control strings.
    _NAME = r"(?=/?s>|/?INST\]|/?TURN)"
    _PLAIN, _MARKED = re.compile(r"([<\[])(\\*)" + _NAME), re.compile(r"([<\[])\\(\\*)" + _NAME)

    def escape(self, text: str) -> str:
        return self._PLAIN.sub(r"\1\\\2", text)

    def unescape(self, text: str) -> str:
        return self._MARKED.sub(r"\1\2", text)

    def turn(self, role: str, text: str) -> str:
        text = self.escape(text)
        if role == "user":
            return f"[INST] {text} [/INST]"
        if role == "assistant":
            return f" {text} </s>"
        role = self.escape(role)
        return f"[TURN {len(role)} {role}] {text} [/TURN]"

    def render(self, turns: list[Turn]) -> str:
        return "<s>" + "".join(self.turn(r, t) for r, t in turns)

    def read(self, span: str) -> Turn:
        span = span.removeprefix("<s>")
        if span.startswith("[INST] "):
            return "user", self.unescape(span[7:-8])
        if span.startswith("[TURN "):
            size, _, rest = span[6:].partition(" ")
            return self.unescape(rest[: int(size)]), self.unescape(rest[int(size) + 2 : -8])
        return "assistant", self.unescape(span[1:-5])


class Placed(NamedTuple):
    """What one more turn adds: how many characters of the output before stay, the span behind them, and where the turn's
    text begins and ends in that span (both 0 if it can't be told). The output before was left as it was if stable."""

    kept: int
    span: str
    start: int
    end: int
    stable: bool


def place(template: Template, before: list[Turn], turn: Turn, old: str | None = None) -> Placed:
    """Compare the outputs without (old, if it is known) and with the turn. The text's place is what is left between the
    parts that stay when the text is another one."""
    role, text = turn
    if old is None:
        old = template.render(before) if before else ""
    new = template.render([*before, turn])
    if not new.startswith(old):
        kept = next((i for i, (x, y) in enumerate(zip(old, new)) if x != y), min(len(old), len(new)))
        return Placed(kept, new[kept:], 0, 0, False)
    span = new[len(old) :]
    # a probe that differs from the text at both ends, so that nothing of the text counts as surroundings
    mark = "\x02" if text[:1] == "\x01" or text[-1:] == "\x01" else "\x01"
    probe = template.render([*before, (role, mark)])
    if not probe.startswith(old):
        return Placed(len(old), span, 0, 0, False)
    head, _, tail = probe[len(old) :].rpartition(mark)
    if not (span.startswith(head) and span.endswith(tail) and len(head) + len(tail) <= len(span)):
        return Placed(len(old), span, 0, 0, False)
    return Placed(len(old), span, len(head), len(span) - len(tail), True)


class _Open:
    """A conversation being rendered: the turns that later spans depend on, and the whole output if they may depend on all."""

    def __init__(self, conv, template: Template) -> None:
        self.conv, self.template, self.back = conv, template, template.lookback
        self.recent: list[Turn] = []
        self.output, self.size, self.n = "", 0, 0
        self.turns: list[Turn] = []
        self.spans: list[str] = []

    def add(self, role: str, text: str) -> tuple:
        turn = (role, text)
        if self.back is None:
            got = place(self.template, self.recent, turn, self.output)
            self.output = self.output[: got.kept] + got.span
            self.recent.append(turn)
            kept = got.kept
        else:
            # one turn stands for all that are before the window, so that the first turn's marks are not put out again
            before = self.recent if self.n <= self.back else [("", ""), *self.recent]
            got = place(self.template, before, turn)
            kept = self.size if got.stable else None
            self.recent = [*self.recent, turn][max(0, len(self.recent) + 1 - self.back) :]
            if kept is None:
                raise ValueError(f"the template declares a look-back of {self.back} turns, but changes earlier output in conversation {self.conv}")
            self.turns.append(turn)
            self.spans.append(got.span)
        self.size = kept + len(got.span)
        self.n += 1
        if not self.n & (self.n - 1):
            self.check()
        return self.conv, self.n, role, got.span, kept, got.start, got.end, got.stable

    def check(self) -> None:
        """Holds the spans of a declared look-back against the whole prefix, rendered at once."""
        if self.turns:
            self.spans = ["".join(self.spans)]
            if self.template.render(self.turns) != self.spans[0]:
                raise ValueError(f"the template declares a look-back of {self.back} turns, but its output of {self.n} turns is another one in conversation {self.conv}")


SPANS = "conv_id long, n long, role string, span string, kept long, text_start int, text_end int, stable boolean"


def spans(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """The formatted conversations of turns (conv_id, turn, role, text): a row for each turn with n (from 1), its role, its
    span of the output, kept (characters of the output before that stay), text_start and text_end (where its text
    stands in the span) and stable. A conversation's output is its spans behind each other, each put behind the first
    `kept` characters so far. Rows of a conversation are in one partition, in order.

    Rows are put in order of turn (nulls first; ties by role, then text). Null texts and roles count as empty; rows with
    a null conv_id are one conversation. Repeated rows are turns of their own. No rows give no rows.
    """
    template = template or BracketTemplate()
    small_batches(turns.sparkSession)
    slim = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Open | None = None
        for b in batches:
            out = []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now is None or conv != now.conv:
                    if now is not None:
                        now.check()
                    now = _Open(conv, template)
                out.append(now.add(role, text))
            yield _batch(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), SPANS)
        if now is not None:
            now.check()

    return slim.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SPANS)


def _batch(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in schema.split(", ")])


class _Read:
    """A conversation being read back from its spans."""

    def __init__(self, conv, template: Template) -> None:
        self.conv, self.template = conv, template
        self.n = self.size = self.loss = 0
        self.stable = True
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, span: str, kept: int, start: int, end: int, stable: bool) -> None:
        self.n += 1
        self.size = kept + len(span)
        self.stable &= stable
        if not self.stable:
            return
        role, text = self.template.read(span)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        if role == "assistant":
            under = self.template.unescape(span[start:end])
            self.loss += len(under)
            self.masked.update(under.encode("utf-8", "replace"))

    def row(self) -> tuple:
        whole = self.stable
        return self.conv, self.n, self.turns.hexdigest() if whole else None, self.loss if whole else 0, self.masked.hexdigest() if whole else hashlib.sha256().hexdigest(), self.size, not whole


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """spans() to conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and rewrites for each
    conversation, read from the spans alone. rewrites tells that the template changed what it had put out before: then
    turns can't be told apart (turns_sha256 is null), nothing is under the loss mask, and formatted_chars is the length of
    the last output. formatted must be as spans() leaves it: a conversation's rows together and in order."""
    template = template or BracketTemplate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        now: _Read | None = None
        for b in batches:
            done = []
            for conv, *turn in zip(*(b.column(c).to_pylist() for c in ("conv_id", "span", "kept", "text_start", "text_end", "stable"))):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Read(conv, template)
                now.add(*turn)
            if done:
                yield _batch(done, kinds, DIGESTS)
        if now is not None:
            yield _batch([now.row()], kinds, DIGESTS)

    return formatted.select("conv_id", "span", "kept", "text_start", "text_end", "stable").mapInArrow(run, DIGESTS)


def format_all(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """read_back() of spans()."""
    return read_back(spans(turns, template), template)
