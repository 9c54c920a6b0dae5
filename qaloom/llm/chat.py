"""Chat formatting with typed content parts.

A visitor flattens a turn's parts, in order: text is escaped, an image, audio or document part
becomes a placeholder, and its reference, place and expanded token count are recorded.  Each turn
is one formatted piece; a conversation is its pieces by turn, so that one of any length needs no
task to hold it.

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings begin with ``<|``.  In texts and roles ``<``, k backslashes and ``|`` get one
backslash more, which reading back takes away: so no text forms a control string, and none changes.

Defined results: a null text is an empty one, and so is a null role; turns of one number are
ordered by their formatted pieces, null turns come first; repeated rows are turns of their own; a
null conversation id is an id like others, and ids keep their 64 bits beside it; no rows give no
rows; extra columns don't matter.  Parts that are no JSON, or nested too deeply to read, leave the
turn its text and say so in ``fault``.  A part of no known type counts as its text; a number, null
or truth value among parts is nothing; a width, height, length or page count that is no positive
number counts as missing.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|break|>"
TRAINED_ROLES = ("assistant",)
TOKENS_PER_TILE_SIDE = 28  # pixels of an image's side for one token
TOKENS_PER_SECOND = 25  # of audio
TOKENS_PER_PAGE = 256  # of a document
KINDS = ("text", "image", "audio", "document")
MOST_NUMBER = 1e9  # a larger measure counts as missing
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*)" + re.escape(END) + r"\n", re.S)

PIECES = (
    "conv_id long, turn long, formatted string, loss array<struct<start:long,end:long>>, "
    "attachments array<struct<kind:string,ref:string,place:long,tokens:long>>, expanded_tokens long, fault string"
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int64()), ("tokens", pa.int64())]))


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "<" in text else text


def _number(part: dict, key: str, default: float) -> float:
    """A positive, finite number of a part, or the default."""
    x = part.get(key)
    good = isinstance(x, int | float) and not isinstance(x, bool) and 0 < x <= MOST_NUMBER
    return x if good else default


class Flattener:
    """Visits content parts in order; ``text`` is what they become."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.length = 0
        self.attachments: list[tuple[str, str, int, int]] = []

    @property
    def text(self) -> str:
        return "".join(self.out)

    def visit(self, part: Any) -> None:
        """A string, a list of parts, or a part with a type; an unknown type counts as its text."""
        if isinstance(part, str):
            self.put(escape(part))
        elif isinstance(part, list):
            for x in part:
                self.visit(x)
        elif isinstance(part, dict):
            kind = part.get("type")
            getattr(self, f"visit_{kind}" if kind in KINDS else "visit_text")(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        self.put(escape(text if isinstance(text, str) else ""))

    def visit_image(self, part: dict) -> None:
        side = lambda k: math.ceil(_number(part, k, 1) / TOKENS_PER_TILE_SIDE)
        self.attach("image", part, side("width") * side("height"))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil(_number(part, "seconds", 0) * TOKENS_PER_SECOND))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, math.ceil(_number(part, "pages", 1)) * TOKENS_PER_PAGE)
        self.visit(part.get("parts") or [])

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        ref = part.get("ref")
        self.attachments.append((kind, ref if isinstance(ref, str) else "", self.length, tokens))
        self.put(f"<|{kind}|>")

    def put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)


def _flat(text: str | None, parts: str | None) -> tuple[Flattener, str | None]:
    """The visited parts, or text; and what was wrong with the parts."""
    if parts is not None:
        flat = Flattener()
        try:
            flat.visit(json.loads(parts))
            flat.text.encode()
        except RecursionError:
            fault = "parts nested too deeply"
        except ValueError:  # no JSON, or half a character
            fault = "parts are no JSON"
        else:
            return flat, None
    else:
        fault = None
    flat = Flattener()
    flat.visit(text or "")
    return flat, fault


def format_turn(role: str | None, text: str | None, parts: str | None = None) -> tuple[str, list[tuple[int, int]], list[tuple[str, str, int, int]], str | None]:
    """(formatted piece, spans under the loss mask, attachments with their places in the piece, fault)."""
    head = START + escape(role or "").replace("\n", BREAK) + "\n"
    flat, fault = _flat(text, parts)
    body = flat.text
    loss = [(len(head), len(head) + len(body))] if role in TRAINED_ROLES else []
    return head + body + END + "\n", loss, [(k, r, at + len(head), n) for k, r, at, n in flat.attachments], fault


def read_turn(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted piece; attachments stay placeholders."""
    found = _TURN.fullmatch(piece)
    return unescape(found[1].replace(BREAK, "\n")), unescape(found[2])


def format_chat(df: DataFrame, parts_col: str | None = None) -> DataFrame:
    """One row per turn of ``df`` (conv_id, turn, role, text): see PIECES.

    ``parts_col``: JSON of a turn's content parts, which replaces its text where it isn't null.
    Places and spans count code points of the piece.
    """
    parts = F.col(f"`{parts_col}`") if parts_col else F.lit(None)
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), parts.cast("string").alias("parts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turn(*x) for x in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            cols = [
                pa.array([x[0] for x in done], pa.string()),
                pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in done], _SPANS),
                pa.array([[dict(zip(("kind", "ref", "place", "tokens"), a, strict=True)) for a in x[2]] for x in done], _FOUND),
                pa.array([sum(a[3] for a in x[2]) for x in done], pa.int64()),
                pa.array([x[3] for x in done], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["conv_id", "turn", "formatted", "loss", "attachments", "expanded_tokens", "fault"])

    return rows.mapInArrow(work, PIECES)


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation, from its formatted pieces alone: digests of its turns and of the text under the loss mask.

    Pieces stream by in order, and digests grow with them: no conversation is held whole.
    """
    ordered = pieces.select("conv_id", "turn", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def finish() -> None:
            if state is not None:
                rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, piece, loss in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if state is None or conv != now:
                    finish()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                piece = piece.as_py()
                role, text = read_turn(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    under = unescape(piece[span["start"] : span["end"]])
                    state[2] += len(under)
                    state[3].update(under.encode())
                state[4] += len(piece)
            yield out()
        finish()
        yield out()

    return ordered.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
