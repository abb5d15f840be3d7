"""Chat formatting: a declarative template, a finite-state machine over roles, and loss flags per segment.

TEMPLATE names for each role what opens and closes a turn and whether its text is learnt; ORDER is the machine
(state -> role -> state). A conversation's rows, ordered by turn, become segments (text, loss); their
concatenation is the formatted text. Control strings inside a text are broken by an escape after their first
character, and the escape character is doubled, so that a formatted text holds control strings only where
the template put them, and can be read back exactly. Turns of other roles, and conversations whose order the
machine rejects, are formatted too and flagged.

Rows are dealt by conversation and sorted within a task, and conversations are then built one at a time, so memory
is bounded by the longest conversation. Cases: null text or role counts as empty; rows with equal turns
are ordered by role, then text, null turns first; repeated rows are turns of their own; rows without conv_id
are one conversation without an id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE: dict[str, tuple[str, str, bool]] = {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
ORDER = {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
FINAL = {"user", "assistant"}

CONTROL = [x for o, c, _ in TEMPLATE.values() for x in (o, c)] + list(OTHER)
_control = "|".join(re.escape(x) for x in sorted(CONTROL, key=len, reverse=True))
_ESCAPE = re.compile(rf"\\|(?=(?:{_control})).", re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TOKENS = re.compile(f"({_control})")
_OPENS = {o: (r, c, loss) for r, (o, c, loss) in TEMPLATE.items()}


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\-", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def segments(turns: list[tuple[str, str]]) -> list[tuple[str, bool]]:
    out = []
    for role, text in turns:
        if role in TEMPLATE:
            open_, close, loss = TEMPLATE[role]
            out += [(open_, False), (escape(text), loss), (close, False)]
        else:
            out += [(OTHER[0] + escape(role) + OTHER[1], False), (escape(text), False), (OTHER[2], False)]
    return out


def check_order(turns: list[tuple[str, str]]) -> str | None:
    """What the machine objects to, if anything."""
    state = "start"
    for i, (role, _) in enumerate(turns):
        after = ORDER[state].get(role)
        if after is None:
            return f"turn {i}: {role or 'no role'} after {state}"
        state = after
    return None if state in FINAL else f"ends after {state}"


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    parts, turns, i = _TOKENS.split(formatted), [], 1
    while i < len(parts):
        if parts[i] == OTHER[0]:
            turns.append((unescape(parts[i + 1]), unescape(parts[i + 3])))
            i += 6
        else:
            turns.append((_OPENS[parts[i]][0], unescape(parts[i + 1])))
            i += 4
    return turns


SCHEMA = "conv_id long, formatted string, segments array<struct<text:string,loss:boolean>>, valid boolean, error string"


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    at, turns = None, []
    for b in batches:
        for conv, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if turns and conv != at:
                yield at, turns
                turns = []
            at = conv
            turns.append((role or "", text or ""))
    if turns:
        yield at, turns


def dealt(rows: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> one row per conversation: SCHEMA."""

    def run(batches):
        kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        part: list[tuple] = []
        size = 0

        def flush():
            cols = list(zip(*part, strict=True))
            segs = pa.array([[{"text": t, "loss": x} for t, x in s] for s in cols[2]], kind)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), segs, pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.string())], names=["conv_id", "formatted", "segments", "valid", "error"])

        for conv, turns in _conversations(batches):
            s, error = segments(turns), check_order(turns)
            part.append((conv, "".join(t for t, _ in s), s, error is None, error))
            size += len(part[-1][1])
            if size > 1 << 22 or len(part) >= 2000:
                yield flush()
                part, size = [], 0
        if part:
            yield flush()

    return dealt(rows).mapInArrow(run, SCHEMA)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of conversations, read back from their formatted texts and segments."""

    def run(batches):
        for b in batches:
            out = []
            for conv, text, segs, valid in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                turns = read_back(text)
                learnt = "".join(unescape(s["text"]) for s in segs if s["loss"])
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text), valid))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return formatted.select("conv_id", "formatted", "segments", "valid").mapInArrow(run, DIGESTS)
