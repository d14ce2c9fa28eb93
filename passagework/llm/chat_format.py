"""Chat formatting by rendering successive turn prefixes of a template that is a black box.

`render(turns)` gets a list of (role, text) and gives a string. Rendering one turn more and comparing with
the output before locates that turn's span; rendering it with an empty text locates its text inside the
span. A prefix that is no prefix of the next output means that the template rewrites history: the
conversation is then reported with `rewritten` true and without spans.

Prefixes longer than `window` turns are rendered from a later first turn on; at each such change the last
turn must render alike under the old and the new start, and at the end the pieces must be what the template makes
of all turns. So the work grows with a conversation's length, not with its square; only where that does not hold
(a template that numbers or drops turns, or refuses a later start) every prefix is rendered whole.

Rows of a conversation meet sorted in one task but are read as a stream; memory is that of its own output.
Defined cases: null role or text is empty; equal turn numbers are ordered by role, then text; repeated rows
are turns of their own; null turns come first; rows without conv_id are one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import columns_apart, frugal

Turn = tuple[str, str]
_MARKED = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)


def escape(text: str, also: str = "") -> str:
    """Every character that could open a control string, and the backslash itself, gets a backslash before it."""
    return _MARKED.sub(lambda m: m[0] if m[0] == ":" and m[0] not in also else "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_template(turns: list[Turn]) -> str:
    return "".join(f"### {escape(role, ':')}: {escape(text)}</turn>\n" for role, text in turns)


def read_turns(formatted: str) -> list[Turn]:
    """The turns of a text that `turn_template` made."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def spans(turns: list[Turn], render: Callable[[list[Turn]], str], window: int = 128) -> tuple[str, list[tuple[int, int, int, int]] | None]:
    """The formatted text and, for each turn, start and end of the turn and of its text; None if history is rewritten."""
    if len(turns) > window:
        whole = render(turns)
        try:
            text, found = _pieces(turns, render, window)
        except Exception:  # a template may refuse what does not start at the first turn
            text, found = whole, None
        if found is not None and text == whole:
            return text, found
    return _pieces(turns, render, len(turns))


def _pieces(turns: list[Turn], render: Callable[[list[Turn]], str], window: int) -> tuple[str, list[tuple[int, int, int, int]] | None]:
    out, found, size = [], [], 0
    first, before = 0, render([])
    size = len(before)
    out.append(before)
    for k, (role, _) in enumerate(turns):
        if k - first >= window:
            later = k - window // 2
            old = before[len(render(turns[first : k - 1])) :]
            start = render(turns[later : k - 1])
            moved = render(turns[later:k])
            if moved != start + old:
                return render(turns), None
            first, before = later, moved
        now = render(turns[first : k + 1])
        if not now.startswith(before):
            return render(turns), None
        empty = render([*turns[first:k], (role, "")])
        own = now[len(before) :]
        head = len(commonprefix([own, empty[len(before) :]]))
        tail = len(empty) - len(before) - head
        found.append((size, size + len(own), size + head, size + len(own) - tail))
        out.append(own)
        size += len(own)
        before = now
    return "".join(out), found


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    key, turns = (), []
    for b in batches:
        for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
            if (conv,) != key:
                if turns:
                    yield key[0], turns
                key, turns = (conv,), []
            turns.append((role or "", text or ""))
    if turns:
        yield key[0], turns


_OUT = "conv_id bigint, formatted string, rewritten boolean, loss_start array<int>, loss_end array<int>"


def _formatted(render: Callable[[list[Turn]], str], trained: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        kinds = [pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "formatted", "rewritten", "loss_start", "loss_end"])
        for conv, turns in _conversations(batches):
            text, found = spans(turns, render, window)
            loss = [] if found is None else [s[2:] for s, t in zip(found, turns) if t[0] == trained]
            rows.append((conv, text, found is None, [a for a, _ in loss], [z for _, z in loss]))
            size += len(text)
            if size > 4_000_000:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    return run


def format_chats(conversations: DataFrame, render: Callable[[list[Turn]], str] = turn_template, trained: str = "assistant", window: int = 128) -> DataFrame:
    """For each conversation: conv_id, formatted, rewritten, and the loss mask as spans of code points in `formatted`."""
    rows = columns_apart(conversations, {"conv_id": ("conv_id", "bigint"), "turn": ("turn", "bigint"), "role": ("role", "string"), "text": ("text", "string")})
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(frugal(_formatted(render, trained, window)), _OUT)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for conv, text, starts, ends in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
            turns = read_turns(text)
            loss = "".join(unescape(text[a:z]) for a, z in zip(starts, ends))
            digest = hashlib.sha256()
            for role, own in turns:
                digest.update(f"{role}\n{own}\n".encode())
            rows.append((conv, len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        if rows:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def digests(formatted: DataFrame) -> DataFrame:
    """What `format_chats` with `turn_template` made, read back from its text and mask."""
    return formatted.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(frugal(_read_back), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
