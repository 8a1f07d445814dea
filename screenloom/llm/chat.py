"""Chat formatting with spans found by incremental black-box rendering.

A template is any function from turns to text. Successive prefixes of a conversation are
rendered; what a prefix adds to the one before is the span of its last turn, and output that
does not begin with the output before it shows a template that rewrites history. A probe in
place of the turn's text shows where in the span the text stands.

By default every prefix is rendered whole, whatever its length, so rewriting is seen at any turn;
that holds a conversation in one task, and its work grows with the square of its turns. Where a
template's output for a turn is known to depend on at most ``context`` turns before it, that can
be stated: every turn is then rendered over that many turns before it, ``WHOLE`` at least, so that
a conversation of any length streams through in bounded memory.

Defined cases: texts of any length are taken whole; rows go by turn, then role, then text, nulls first; null texts and roles are
empty; a null conversation id is a conversation; repeated rows are turns; an empty table gives
an empty result; other columns of the input are not carried. A conversation whose history the
template rewrites, or with a piece that the reader's pattern doesn't fit, cannot be read back
from its pieces: its digests and loss figures are null, and ``rewritten`` tells the first case.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
START, END = "<|im_start|>", "<|im_end|>\n"
PROBE = "﷐probe﷑"
#: Turns before a turn that it is rendered over at least, also where a template is said to need fewer.
WHOLE = 64
PIECE = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """No ``<|`` is left in the text, so no control string is; ``unescape`` undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def chat_markup(turns: list[Turn]) -> str:
    """The template in use: each turn between marks, control strings escaped."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}" for role, text in turns)


class Renderer:
    """Takes a conversation's turns one by one; gives each turn's span.

    ``add`` returns (piece, text start, text end, rewritten): offsets count from the piece's
    start, which is where the output first differs from the one before.
    """

    def __init__(self, template: Callable[[list[Turn]], str], context: int | None = None):
        self.template, self.context = template, None if context is None else max(context, WHOLE)
        self.turns: list[Turn] = []
        self.shown = ""

    def add(self, role: str, text: str) -> tuple[str, int, int, bool]:
        if self.context is not None and len(self.turns) > self.context:
            self.turns = self.turns[-self.context :]
            self.shown = self.template(self.turns)
        before = self.shown
        now = self.template([*self.turns, (role, text)])
        probe = PROBE
        while probe in now or probe in before or probe in role or probe in text:
            probe += PROBE[-1]  # in the end longer than any run of it
        probed = self.template([*self.turns, (role, probe)])
        rewritten = not now.startswith(before)
        keep = len(before)
        if rewritten:
            keep = next((k for k, (x, y) in enumerate(zip(before, now, strict=False)) if x != y), min(len(before), len(now)))
        at = probed.find(probe)
        # a template that drops or transforms the text shows no probe: then nothing is masked
        a, e = (at - keep, len(now) - (len(probed) - at - len(probe)) - keep) if at >= keep else (0, 0)
        self.turns.append((role, text))
        self.shown = now
        return now[keep:], a, max(a, e), rewritten


def ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(
    conversations: DataFrame, template: Callable[[list[Turn]], str] = chat_markup, context: int | None = None, learn: str = "assistant"
) -> DataFrame:
    """conv_id, first, piece, loss_start, loss_end, rewritten: the output, a row for each turn.

    A conversation's pieces follow each other in one partition; ``first`` marks where one
    begins. Offsets are code points in the piece; only turns of the role to learn have a mask.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, renderer = object(), None
        for b in batches:
            out = []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                first = renderer is None or conv != at
                if first:
                    at, renderer = conv, Renderer(template, context)
                piece, a, e, rewritten = renderer.add(role, text)
                out.append((conv, first, piece, a if role == learn else 0, e if role == learn else 0, rewritten))
            names = ["conv_id", "first", "piece", "loss_start", "loss_end", "rewritten"]
            kinds = [pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return ordered(conversations).select("conv_id", "role", "text").mapInArrow(
        run, "conv_id long, first boolean, piece string, loss_start long, loss_end long, rewritten boolean"
    )


def parse_markup(piece: str) -> Turn | None:
    """Role and text of a piece of ``chat_markup``."""
    found = PIECE.fullmatch(piece)
    return (unescape(found[1]), unescape(found[2])) if found else None


def read_back(
    formatted: DataFrame, parse: Callable[[str], Turn | None] = parse_markup, plain: Callable[[str], str] = unescape
) -> DataFrame:
    """Digests of every conversation, from its formatted pieces alone.

    The pieces stream by; a conversation is never held, only its running digests. ``parse``
    reads a piece of the template in use, ``plain`` undoes its escapes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def done() -> tuple:
            conv, n, turns, chars, loss, total, rewritten, fine = state
            return (conv, n, *((turns.hexdigest(), chars, loss.hexdigest()) if fine and not rewritten else (None, None, None)), total, rewritten)

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        table = lambda rows: pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            out = []
            for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "first", "piece", "loss_start", "loss_end", "rewritten")), strict=True):
                conv, first, piece, a, e, rewritten = r
                if first:
                    if state:
                        out.append(done())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False, True]
                turn = parse(piece)
                state[7] &= turn is not None
                role, text = turn or ("", "")
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                masked = plain(piece[a:e])
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(piece)
                state[6] |= rewritten
            if out:
                yield table(out)
        if state:
            yield table([done()])

    return formatted.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean",
    )
