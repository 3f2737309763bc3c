"""Chat formatting with typed content parts.

A message is plain text or a list of typed parts. A visitor flattens the parts: text stays, and each image, audio or
document becomes a placeholder in its place, with an attachment reference and the number of tokens it expands to.
Turns are marked by control strings. Where a text holds a control string (of this template or of other well-known
ones), a backslash after its first character takes its meaning away; one more is added where backslashes already
stand there, so that ``unescape`` restores every text exactly.

Turns are rendered row by row; the reader then streams each conversation's output in order of turn (null first; ties
by role, then text) and keeps only running digests, so that a conversation of any length needs constant memory. A
digest of a whole conversation is sequential by its definition, so the rows of one conversation pass through one task.

Defined cases: null text and null role count as empty; a null conv_id is a conversation of its own; repeated rows are
turns each; an empty table gives no conversations; other columns are ignored.
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

#: Control strings that a text must not be able to speak. ``<|`` opens every mark of this template.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<pad>", "<start_of_turn>", "<end_of_turn>")

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>\n"

_controls = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL)
_escape = re.compile(f"(?:{_controls})")
_unescape = re.compile(f"(?:{'|'.join(re.escape(c[0]) + r'\\+' + re.escape(c[1:]) for c in CONTROL)})")
_turns = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _escape.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _unescape.sub(lambda m: m[0][0] + m[0][2:], text)


@dataclass
class Flat:
    """A message after the visit: rendered text, attachments (kind, index, ref, tokens, offset in the text), tokens of all placeholders."""

    text: str = ""
    attachments: list[tuple[str, int, str, int, int]] = field(default_factory=list)
    expanded_tokens: int = 0


class PartVisitor:
    """Flattens typed parts in order. The rates say how many tokens a placeholder stands for."""

    def __init__(self, patch: int = 28, audio_tokens_per_second: float = 25.0, tokens_per_page: int = 512):
        self.patch, self.audio, self.page = patch, audio_tokens_per_second, tokens_per_page

    def flatten(self, parts: list[dict]) -> Flat:
        out = Flat()
        for p in parts:
            getattr(self, f"visit_{p.get('type') or 'text'}", self.visit_other)(p, out)
        return out

    def visit_text(self, part: dict, out: Flat) -> None:
        out.text += escape(part.get("text") or "")

    def visit_image(self, part: dict, out: Flat) -> None:
        self._attach("image", part, math.ceil((part.get("width") or self.patch) / self.patch) * math.ceil((part.get("height") or self.patch) / self.patch), out)

    def visit_audio(self, part: dict, out: Flat) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.audio)), out)

    def visit_document(self, part: dict, out: Flat) -> None:
        self._attach("document", part, max(1, part.get("pages") or 1) * self.page, out)

    def visit_other(self, part: dict, out: Flat) -> None:
        raise ValueError(f"unknown part type {part.get('type')!r}")

    def _attach(self, kind: str, part: dict, tokens: int, out: Flat) -> None:
        index = len(out.attachments)
        out.attachments.append((kind, index, part.get("ref") or "", tokens, len(out.text)))
        out.text += f"<|{kind}:{index}|>"
        out.expanded_tokens += tokens


_RENDERED = "formatted string, loss_start long, loss_end long, attachments array<struct<kind:string,index:int,ref:string,tokens:int,offset:int>>, expanded_tokens long"
_attachment = pa.list_(pa.struct([("kind", pa.string()), ("index", pa.int32()), ("ref", pa.string()), ("tokens", pa.int32()), ("offset", pa.int32())]))


def format_turns(conversations: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """conv_id, turn and each turn's rendered text with its span under the loss mask (code points; null without one).

    A column ``parts`` (array of structs with type, text, ref, width, height, seconds, pages, as far as needed) is
    visited where it is there and not null; else ``text`` is the message.
    """
    visitor = visitor or PartVisitor()
    has_parts = "parts" in conversations.columns
    kinds = {f.name: f.dataType.simpleString() for f in conversations.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            parts = b.column("parts").to_pylist() if has_parts else [None] * b.num_rows
            for role, text, p in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), parts, strict=True):
                flat = visitor.flatten(p if p is not None else [{"type": "text", "text": text}])
                head = f"{TURN}{escape(role or '')}{BODY}"
                span = (len(head), len(head) + len(flat.text)) if role == "assistant" else (None, None)
                rows.append((head + flat.text + END, *span, [dict(zip(("kind", "index", "ref", "tokens", "offset"), a, strict=True)) for a in flat.attachments], flat.expanded_tokens))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.int64(), _attachment, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("conv_id", "turn", "role", "text")), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["conv_id", "turn", "role", "text", *(x.split()[0] for x in re.split(r", (?=[a-z_]+ )", _RENDERED))])

    columns = ["conv_id", "turn", "role", "text", *["parts"] * has_parts]
    return conversations.select(*columns).mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role {kinds['role']}, text {kinds['text']}, {_RENDERED}")


class _Reader:
    """Running digests of one conversation's formatted output."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n, self.loss_chars, self.chars = 0, 0, 0

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        for role, text in _turns.findall(formatted):
            self.n += 1
            self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        if start is not None:
            text = unescape(formatted[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(formatted)

    def row(self, conv_id) -> tuple:
        return conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted turns say, read from the formatted text and mask alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, current, rows, key_type = None, None, [], None

        def out():
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], names=names)

        for b in batches:
            key_type = b.schema.field("conv_id").type
            for conv, text, start, end in zip(*(b.column(x).to_pylist() for x in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if reader is None or conv != current:
                    if reader is not None:
                        rows.append(reader.row(current))
                    reader, current = _Reader(), conv
                reader.add(text, start, end)
            if len(rows) > 4096:
                yield out()
        if reader is not None:
            rows.append(reader.row(current))
            yield out()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss_start", "loss_end")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
