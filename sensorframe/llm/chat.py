"""Chat formatting: typed content parts become one marked text with placeholders, attachments and a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import partitions
from sensorframe.session import stored

START, END = "<|im_start|>", "<|im_end|>"
# Turns whose numbers share the quotient by this one are written by one task: 1,024 turns in the usual numbering.
BLOCK = 1 << 10
# A longer stretch of a conversation is written as several pieces; characters, cut between turns.
PIECE = 1 << 20

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
_ATTACHMENTS = "array<struct<number:long,kind:string,ref:string,start:long,tokens:long>>"


def text_part(text: Column) -> Column:
    """A plain text as content of one text part."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    parts = [F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in none.items()]]
    return F.array(F.struct(*parts))


def escape(text: str) -> str:
    """No control string is left in the text: every ``<`` that backslashes and ``|`` follow gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Visitor:
    """Walks the parts of a content. Each kind has a method that adds its text, or its placeholder and token count.

    An image takes a token for each started square of ``patch`` pixels, a sound ``per_second`` tokens for each second,
    a document ``per_page`` for each page; a size that is missing counts as one square, second or page. A part of
    another kind counts as text. Neighbouring text parts are joined before control strings are escaped, so that
    two parts cannot form one together.
    """

    patch: int = 28
    per_second: int = 25
    per_page: int = 512
    written: list[str] = field(default_factory=list)
    plain: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str | None, int, int]] = field(default_factory=list)
    length: int = 0

    def content(self, parts: list[dict | None] | None) -> str:
        self.written, self.plain, self.attachments, self.length = [], [], [], 0
        for part in parts or ():
            if part is not None:
                getattr(self, f"visit_{part['kind']}", self.visit_text)(part)
        self._flush()
        return "".join(self.written)

    def visit_text(self, part: dict) -> None:
        self.plain.append(part["text"] or "")

    def visit_image(self, part: dict) -> None:
        across, down = (ceil(max(part[side] or 1, 1) / self.patch) for side in ("width", "height"))
        self._placeholder("image", part["ref"], across * down)

    def visit_audio(self, part: dict) -> None:
        self._placeholder("audio", part["ref"], max(1, ceil((part["seconds"] or 1) * self.per_second)))

    def visit_document(self, part: dict) -> None:
        self._placeholder("document", part["ref"], max(part["pages"] or 1, 1) * self.per_page)

    def _flush(self) -> None:
        if self.plain:
            self._write(escape("".join(self.plain)))
            self.plain = []

    def _write(self, text: str) -> None:
        self.written.append(text)
        self.length += len(text)

    def _placeholder(self, kind: str, ref: str | None, tokens: int) -> None:
        self._flush()
        self.attachments.append((kind, ref, self.length, tokens))
        self._write(f"<|{kind}|>")


class _Piece:
    """A stretch of turns in the writing."""

    def __init__(self, key: tuple, number: int):
        self.key, self.number = key, number
        self.texts, self.length, self.turns, self.loss, self.attachments = [], 0, 0, [], []

    def add(self, role: str, content: str, attachments: list[tuple], learned: bool) -> None:
        head = f"{START}{_escape_role(role)}\n"
        at = self.length + len(head)
        self.texts += [head, content, END, "\n"]
        self.length = at + len(content) + len(END) + 1
        self.turns += 1
        if learned:
            self.loss.append({"start": at, "end": at + len(content)})
        for kind, ref, start, tokens in attachments:
            number = len(self.attachments)
            self.attachments.append({"number": number, "kind": kind, "ref": ref, "start": at + start, "tokens": tokens})

    def row(self) -> tuple:
        tokens = sum(a["tokens"] for a in self.attachments)
        return (*self.key, self.number, "".join(self.texts), self.turns, self.loss, self.attachments, tokens)


def _writer(visitor: Visitor, learned: frozenset[str], longest: int, names: list[str]):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, schema = None, None
        for batch in batches:
            if schema is None:
                span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
                mark = [("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())]
                kinds = [batch.schema.field("conv").type, pa.int64(), pa.int64(), pa.string(), pa.int64()]
                kinds += [pa.list_(span), pa.list_(pa.struct(mark)), pa.int64()]
                schema = pa.schema(list(zip(names, kinds, strict=True)))
            done = []
            for conv, block, role, parts in zip(*(batch.column(c).to_pylist() for c in ("conv", "block", "role", "parts")), strict=True):
                if piece is None or piece.key != (conv, block) or piece.length >= longest:
                    number = piece.number + 1 if piece is not None and piece.key == (conv, block) else 0
                    if piece is not None:
                        done.append(piece.row())
                    piece = _Piece((conv, block), number)
                content = visitor.content(parts)
                piece.add(role or "", content, visitor.attachments, role in learned)
            yield _batch(done, schema)
        if piece is not None:
            yield _batch([piece.row()], schema)

    return write


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def format_chat(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    learned: tuple[str, ...] = ("assistant",),
    visitor: Visitor | None = None,
    block: int = BLOCK,
    piece: int = PIECE,
) -> DataFrame:
    """Rows (conv, block, piece, formatted, n_turns, loss, attachments, tokens), in partitions sorted by the first three.

    Turns of a conversation in order of their whole number, equal numbers by role and content, are written as
    ``<|im_start|>role``, a line end, the content, ``<|im_end|>`` and a line end. ``parts_col`` holds the content as
    typed parts (``PARTS``): text is escaped, so that it holds no control string and can be read back by
    ``read_turns``; an image, sound or document becomes a placeholder. ``attachments`` lists these in order with their
    reference, place and expanded token count, ``tokens`` is their sum. ``loss`` are the spans of contents of the
    ``learned`` roles. Places are code points in ``formatted``, end exclusive.

    A conversation is one row, unless its turn numbers go beyond ``block`` or its text beyond ``piece`` characters;
    then its rows follow each other by block and piece, and their texts joined are the whole. So a conversation
    with a third of all turns is dealt over many tasks, and none holds more than one piece and one turn.

    Null parts or texts count as empty, a null role as an empty one, null turn numbers come first; turns with a null
    conversation are one conversation; repeated rows are repeated turns. An empty table gives no rows; other
    columns are not looked at.
    """
    number = F.col(turn_col).cast("long")
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.coalesce(F.floor(number / block).cast("long"), F.lit(-(1 << 62))).alias("block"),
        number.alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(parts_col).cast(PARTS).alias("parts"),
    )
    rows = rows.repartitionByRange(partitions(turns.sparkSession), "conv", "block")
    rows = rows.sortWithinPartitions("conv", "block", "turn", "role", "parts")
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, block long, piece long, formatted string, n_turns long, loss array<struct<start:long,end:long>>"
    schema += f", attachments {_ATTACHMENTS}, tokens long"
    names = [c.split(" ")[0] for c in ("conv", "block", "piece", "formatted", "n_turns", "loss", "attachments", "tokens")]
    return rows.mapInArrow(_writer(visitor or Visitor(), frozenset(learned), piece, names), schema)


_TURN = re.compile(re.escape(START) + r"(.*)\n((?s:.*?))" + re.escape(END) + r"\n")
_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document)\|>")


def plain_text(content: str) -> str:
    """Formatted content without its placeholders, unescaped."""
    return unescape(_PLACEHOLDER.sub("", content))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and plain text of every turn of a formatted piece."""
    return [(_unescape_role(m[1]), plain_text(m[2])) for m in _TURN.finditer(formatted)]


def read_loss(formatted: str, loss: list[dict]) -> list[str]:
    """Plain texts under the loss mask, in order."""
    return [plain_text(formatted[s["start"] : s["end"]]) for s in loss]


_PIECE_ROWS = (
    "block long, piece long, n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long, "
    "turns_sha256 string, loss_sha256 string"
)


def _rows(schema: str, kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    columns = [("conv", kind), *[(n, kinds[t]) for n, t in (c.split(" ") for c in schema.split(", "))]]
    return _batch(rows, pa.schema(columns))


def _read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the conversations that lie within a partition, and the pieces of the others."""
    conv, held, opened, kind = None, [], True, None

    def left() -> list[tuple]:
        if opened:  # it may have begun in the partition before, or go on in the next one
            return [(*p, None, None) for p in held]
        turns, loss = (hashlib.sha256(b"".join(p[i] for p in held)).hexdigest() for i in (4, 6))
        total = [sum(p[i] for p in held) for i in (3, 5, 7)]
        return [(conv, None, None, total[0], None, total[1], None, total[2], turns, loss)]

    for batch in batches:
        kind, out = batch.schema.field("conv").type, []
        columns = (batch.column(c).to_pylist() for c in ("conv", "block", "piece", "formatted", "loss"))
        for now, block, piece, formatted, loss in zip(*columns, strict=True):
            if held and now != conv or sum(len(p[4]) for p in held) > PIECE:
                long = now == conv
                opened = opened or long
                out += left()
                held, opened = [], long
            conv, turns, learned = now, read_turns(formatted), "".join(read_loss(formatted, loss))
            data = "".join(f"{role}\n{text}\n" for role, text in turns).encode()
            held.append((conv, block, piece, len(turns), data, len(learned), learned.encode(), len(formatted)))
        yield _rows(_PIECE_ROWS, kind, out)
    if held:
        opened = True
        yield _rows(_PIECE_ROWS, kind, left())


_DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state, kind = None, None, None

    def row() -> tuple:
        return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    for batch in batches:
        kind, out = batch.schema.field("conv").type, []
        columns = (batch.column(c).to_pylist() for c in ("conv", "n_turns", "turns", "loss_chars", "loss", "formatted_chars"))
        for now, n, turns, chars, loss, formatted in zip(*columns, strict=True):
            if state is None or now != conv:
                if state is not None:
                    out.append(row())
                conv, state = now, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += n
            state[1].update(turns)
            state[2] += chars
            state[3].update(loss)
            state[4] += formatted
        yield _rows(_DIGESTS, kind, out)
    if state is not None:
        yield _rows(_DIGESTS, kind, [row()])


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """Rows (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from ``format_chat``'s rows.

    ``turns_sha256`` is over role, line end, plain text and line end of every turn, ``loss_sha256`` over the plain texts
    under the loss mask. A conversation within one partition is done there, in the order it lies in. The others, at most
    two a partition and those over ``PIECE`` bytes, follow each other piece by piece through a running digest, as SHA-256
    allows no other way; memory there is one piece. An empty table gives no rows.
    """
    kind = pieces.schema["conv"].dataType.simpleString()
    read = stored(pieces.mapInArrow(_read_pieces, f"conv {kind}, {_PIECE_ROWS}"))
    whole = read.where("turns is null").select("conv", *[c.split(" ")[0] for c in _DIGESTS.split(", ")])
    parts = read.where("turns is not null").repartition(partitions(pieces.sparkSession), "conv")
    joined = parts.sortWithinPartitions("conv", "block", "piece").mapInArrow(_join_pieces, f"conv {kind}, {_DIGESTS}")
    return whole.unionByName(joined)
