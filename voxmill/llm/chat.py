"""Chat formatting with typed content parts.

A message's content is plain text or a list of typed parts (text, image,
audio, document). A visitor flattens the parts into one string in which every
attachment is an ordered placeholder such as `<image:0>`, and records the
attachment's reference and how many tokens its placeholder stands for.

Template of a turn:  ### role: content </turn>\\n

Inside roles and texts every backslash, `#` and `<` gets a backslash before
it (in roles `:` too), so no text can hold a turn mark or a placeholder, and
removing the backslashes gives the text back exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
LOSS_ROLES = ("assistant",)

_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
STRETCH = 1 << 20  # code points that are unescaped at once
_HEAD = re.compile(r"### ((?:[^\\:]++|\\.)*+): ", re.DOTALL)  # possessive, so that nothing is remembered for going back
_HOLDER = re.compile(r"\\.|<(image|audio|document):(\d+)>", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return "".join(_unescaped(text))


def _unescaped(text: str) -> Iterator[str]:
    """The text without its escapes, in stretches."""
    at = 0
    while at < len(text):
        end = min(at + STRETCH, len(text))
        back = end
        while back > at and text[back - 1] == "\\":
            back -= 1
        end += (end - back) % 2  # not between a backslash and what it escapes
        part = text[at:end]
        yield _ESCAPED.sub(r"\1", part) if "\\" in part else part
        at = end


@dataclass(frozen=True)
class Costs:
    """How many tokens a placeholder stands for."""

    patch: int = 14  # pixels a side of an image patch; one token each
    audio_per_second: float = 25.0
    tokens_per_page: int = 512
    unknown: int = 1


@dataclass
class Flat:
    """What the visitor collects."""

    costs: Costs
    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[int, str, str | None, int]] = field(default_factory=list)  # number, kind, reference, tokens
    first: int = 0  # number of the first placeholder

    def visit(self, part: dict | str | None) -> None:
        if isinstance(part, str):
            part = {"type": "text", "text": part}
        kind = (part or {}).get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part or {})

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        w, h = part.get("width"), part.get("height")
        self._hold("image", part, math.ceil(w / self.costs.patch) * math.ceil(h / self.costs.patch) if w and h else self.costs.unknown)

    def visit_audio(self, part: dict) -> None:
        s = part.get("seconds")
        self._hold("audio", part, math.ceil(s * self.costs.audio_per_second) if s else self.costs.unknown)

    def visit_document(self, part: dict) -> None:
        self._hold("document", part, (part.get("pages") or 0) * self.costs.tokens_per_page or self.costs.unknown)

    def visit_other(self, part: dict) -> None:
        raise ValueError(f"no content part of type {part.get('type')!r}")

    def _hold(self, kind: str, part: dict, tokens: int) -> None:
        number = self.first + len(self.attachments)
        self.pieces.append(f"<{kind}:{number}>")
        self.attachments.append((number, kind, part.get("ref"), tokens))

    @property
    def content(self) -> str:
        return "".join(self.pieces)


@dataclass
class Turn:
    text: str  # the formatted turn
    loss: tuple[int, int] | None  # code points of the turn that count towards the loss
    attachments: list[tuple[int, str, str | None, int]]


def format_turn(role: str | None, parts: Iterable[dict | str | None] | str | None, first: int = 0, loss_roles: tuple[str, ...] = LOSS_ROLES, costs: Costs = Costs()) -> Turn:  # noqa: B008
    flat = Flat(costs, first=first)
    for part in [parts] if parts is None or isinstance(parts, str) else parts:
        flat.visit(part)
    head, content = OPEN + escape_role(role or "") + COLON, flat.content
    return Turn(head + content + CLOSE, (len(head), len(head) + len(content)) if (role or "") in loss_roles else None, flat.attachments)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation; placeholders stay as they are. Raises ValueError if anything else is in it."""
    out, at = [], 0
    while at < len(formatted):
        m = _HEAD.match(formatted, at)
        end = formatted.find(CLOSE, m.end()) if m else -1  # in a text, < has a backslash before it
        if end < 0:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(formatted[m.end() : end])))
        at = end + len(CLOSE)
    return out


def placeholders(formatted: str) -> list[tuple[str, int]]:
    """The attachments' placeholders in order."""
    return [(m[1], int(m[2])) for m in _HOLDER.finditer(formatted) if m[1]]


def _by_conversation(df: DataFrame, conv: str, turn: str, role: str, content: str) -> DataFrame:
    """Rows of a conversation together and in order, in streams that never hold more than a batch."""
    own = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(content).alias("content"))
    order = ["conv", "turn", "role"] + (["content"] if own.schema["content"].dataType.simpleString() == "string" else [])
    return own.repartition("conv").sortWithinPartitions(*order)


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", loss_roles: tuple[str, ...] = LOSS_ROLES, costs: Costs = Costs()) -> DataFrame:  # noqa: B008
    """One row per turn: conv, turn, formatted, begin (its code-point offset in the conversation), loss_begin and loss_end (in the conversation, or null), attachments (number, kind, ref, tokens), expanded_tokens.

    content is a string, or an array of structs with type, text, ref, width,
    height, seconds, pages (any may be missing). The formatted conversation is
    the concatenation of its rows in order of begin. Rows are ordered by turn,
    nulls first, ties by role and text. Null role and content count as empty;
    rows with null conv form one conversation. Repeated rows stay.
    """
    bounded_batches(df.sparkSession)
    kinds = {c: df.schema[c].dataType.simpleString() for c in (conv, turn)}
    names = ["conv", "turn", "formatted", "begin", "loss_begin", "loss_end", "attachments", "expanded_tokens"]
    held = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, number = object(), 0, 0
        for batch in (part for whole in batches for part in slices(whole, 3)):
            rows = []
            for key, who, parts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if key != last:
                    last, at, number = key, 0, 0
                t = format_turn(who, parts, number, loss_roles, costs)
                a, b = t.loss or (None, None)
                rows.append((t.text, at, None if a is None else at + a, None if b is None else at + b, [dict(zip(("number", "kind", "ref", "tokens"), x, strict=True)) for x in t.attachments], sum(x[3] for x in t.attachments)))
                at, number = at + len(t.text), number + len(t.attachments)
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), held, pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names)

    schema = f"conv {kinds[conv]}, turn {kinds[turn]}, formatted string, begin long, loss_begin long, loss_end long, attachments array<struct<number:int,kind:string,ref:string,tokens:long>>, expanded_tokens long"
    out = _by_conversation(df, conv, turn, role, content).mapInArrow(run, schema)
    return out.withColumnsRenamed({"conv": conv, "turn": turn})


class _Digest:
    """What is read back from one conversation, turn by turn."""

    def __init__(self) -> None:
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: str, loss: tuple[int, int] | None) -> None:
        for role, text in read_turns(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        if loss:
            for own in _unescaped(formatted[loss[0] : loss[1]]):
                self.loss.update(own.encode())
                self.loss_chars += len(own)
        self.chars += len(formatted)

    @property
    def row(self) -> tuple:
        return (self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def digests(formatted: DataFrame, conv: str = "conv_id", in_order: bool = False) -> DataFrame:
    """One row per conversation of format_chat()'s output: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text.

    A conversation's turns pass as a stream, so its length has no bound. The
    rows may come from anywhere, as a stored table; in_order says that they
    are format_chat()'s very output, which has conversations together and in
    order, and saves a shuffle.
    """
    kind = formatted.schema[conv].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, key_type = None, None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [key_type, *types], strict=True)], names)

        for batch in (part for whole in batches for part in slices(whole, 1)):
            done, key_type = [], batch.schema.field(0).type
            for key, text, at, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or key != last:
                    if digest is not None:
                        done.append((last, *digest.row))
                    last, digest = key, _Digest()
                digest.add(text, None if a is None else (a - at, b - at))
            yield out(done)
        if digest is not None:
            yield out([(last, *digest.row)])

    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    own = formatted.select(F.col(conv).alias("conv"), "formatted", "begin", "loss_begin", "loss_end")
    if not in_order:
        own = own.repartition("conv").sortWithinPartitions("conv", "begin")
    return own.mapInArrow(run, schema).withColumnRenamed("conv", conv)
