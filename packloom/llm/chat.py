"""Chat formatting: turns of typed content parts become marked-up text with a loss mask.

A turn holds parts in order: text, images, audio and documents.  A visitor flattens them into one
body, in which every attachment is a placeholder; its reference and the number of tokens that the
placeholder stands for are recorded beside it, in the order of the placeholders.  A turn becomes

    <turn:ROLE>
    BODY</turn>

and a conversation is its turns' texts one after the other.  Every ``<`` and ``\\`` of a text is
escaped, so no text can hold a control string, not even one that two neighbouring parts make
together, and unescaping gives the text back.  ``loss`` are the places (code points, end
excluded) of the text parts that a model learns from.

A turn is formatted by itself, so formatting shuffles nothing and a conversation may be of any length.
Null texts and null parts are empty, a null role is the empty role, and a part of an unknown type
counts as text.  Rows without a conversation id are one conversation.  Turns come by number,
numbers before none; rows of one number come by role, then by text, and repeated rows are turns
of their own.  Other columns are ignored, and an empty table has no conversations.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packloom.llm.common import blocks

#: Tokens that attachments expand to: images by tiles of so many pixels, audio by seconds, documents by pages.
TILE, TILE_TOKENS, IMAGE_TOKENS = 512, 170, 85
AUDIO_TOKENS, PAGE_TOKENS = 25, 600
LEARNED = "assistant"

PART = "struct<type string, text string, ref string, width bigint, height bigint, seconds double, pages bigint>"
_SPANS = T.ArrayType(T.StructType().add("begin", "long").add("end", "long"))
_ATTACHMENTS = T.ArrayType(
    T.StructType().add("kind", "string").add("ref", "string").add("tokens", "long").add("begin", "long"))

_ROLE = {"\\": "\\\\", "<": "\\lt;", ">": "\\gt;", "\n": "\\nl;"}
_PLAIN = {"\\\\": "\\", "\\lt;": "<", "\\gt;": ">", "\\nl;": "\n"}
_ESCAPED = re.compile(r"\\(?:\\|lt;|gt;|nl;)")
_TURN = re.compile(r"<turn:([^>\n]*)>\n(.*?)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\lt;")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda found: _PLAIN[found.group()], text) if "\\" in text else text


def _positive(value) -> float:
    return value if value is not None and math.isfinite(value) and value > 0 else 0


class Flattener:
    """Visits the parts of one turn; ``pieces`` are its body, ``texts`` the places of text in it."""

    def __init__(self, begin: int):
        self.at = begin
        self.pieces: list[str] = []
        self.texts: list[tuple[int, int]] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['type']}" if part["type"] in ("image", "audio", "document") else "visit_text")(part)

    def visit_text(self, part: dict) -> None:
        text = escape(part["text"] or "")
        if not text:
            return
        if self.texts and self.texts[-1][1] == self.at:
            self.texts[-1] = (self.texts[-1][0], self.at + len(text))
        else:
            self.texts.append((self.at, self.at + len(text)))
        self._add(text)

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil(max(1, _positive(part["width"])) / TILE) * math.ceil(max(1, _positive(part["height"])) / TILE)
        self._attach("image", part, IMAGE_TOKENS + TILE_TOKENS * tiles)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(_positive(part["seconds"]) * AUDIO_TOKENS))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, int(_positive(part["pages"]))) * PAGE_TOKENS)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part["ref"], "tokens": tokens, "begin": self.at})
        self._add(f"<{kind}>")

    def _add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.at += len(piece)


def format_turn(role: str | None, parts: list[dict | None], learned: str = LEARNED) -> tuple[str, list[dict], list[dict]]:
    """Text of a turn, places under the loss mask, and attachments."""
    head = f"<turn:{''.join(_ROLE.get(c, c) for c in role or '')}>\n"
    flat = Flattener(len(head))
    for part in parts:
        flat.visit(part)
    loss = [{"begin": a, "end": b} for a, b in flat.texts] if role == learned else []
    return f"{head}{''.join(flat.pieces)}</turn>\n", loss, flat.attachments


def format_turns(turns: DataFrame, learned: str = LEARNED) -> DataFrame:
    """``conv_id, turn, role, formatted, loss, attachments, expanded_tokens``: every turn formatted.

    ``turns`` has ``conv_id, turn, role`` and ``text``, or ``parts`` (see ``PART``); a row whose
    parts are null has its text as its one part.  ``expanded_tokens`` is the sum over its attachments.
    """
    plain = F.array(F.struct(
        F.lit("text").alias("type"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("ref"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in (("width", "bigint"), ("height", "bigint"), ("seconds", "double"), ("pages", "bigint"))]))
    parts = plain if "parts" not in turns.columns else F.col("parts") if "text" not in turns.columns else F.coalesce("parts", plain)
    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.coalesce(parts, F.array()).alias("parts"))
    # Batches are cut by the size of their texts before Python unpacks them.
    sizes = F.transform("parts", lambda p: F.coalesce(F.octet_length(p["text"]), F.lit(0)).cast("bigint"))
    sized = rows.withColumn("size", F.aggregate(sizes, F.lit(0).cast("bigint"), lambda total, n: total + n))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 4):
            made = [format_turn(role, parts, learned) for role, parts in zip(batch[2].to_pylist(), batch[3].to_pylist(), strict=True)]
            texts, losses, attachments = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([
                batch[0], batch[1], batch[2], pa.array(texts, pa.string()),
                pa.array(losses, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                pa.array(attachments, pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("begin", pa.int64())]))),
                pa.array([sum(a["tokens"] for a in found) for found in attachments], pa.int64())],
                ["conv_id", "turn", "role", "formatted", "loss", "attachments", "expanded_tokens"])

    schema = T.StructType([*rows.schema.fields[:3], T.StructField("formatted", T.StringType()), T.StructField("loss", _SPANS),
                           T.StructField("attachments", _ATTACHMENTS), T.StructField("expanded_tokens", T.LongType())])
    return sized.mapInArrow(work, schema)


def read_turn(formatted: str, loss: list[dict]) -> tuple[str, str, list[dict]]:
    """Role, body and mask of a formatted turn, unescaped; the mask's places are those in the body.

    Placeholders stay in the body as they are written.
    """
    found = _TURN.fullmatch(formatted)
    if found is None:
        raise ValueError("not a formatted turn")
    role, body, begin = unescape(found.group(1)), found.group(2), found.start(2)
    pieces, spans, at, length = [], [], 0, 0
    for span in loss:
        first, last = span["begin"] - begin, span["end"] - begin
        before, learned = unescape(body[at:first]), unescape(body[first:last])
        spans.append({"begin": length + len(before), "end": length + len(before) + len(learned)})
        length, at = spans[-1]["end"], last
        pieces += [before, learned]
    return role, "".join([*pieces, unescape(body[at:])]), spans


def read_turns(formatted: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, loss, chars`` read back from formatted turns; ``chars`` counts the formatted ones."""
    rows = formatted.select("conv_id", "turn", "formatted", "loss")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 2):
            texts = batch[2].to_pylist()
            roles, bodies, losses = zip(*map(read_turn, texts, batch[3].to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([
                batch[0], batch[1], pa.array(roles, pa.string()), pa.array(bodies, pa.string()),
                pa.array(losses, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                pa.array(map(len, texts), pa.int64())], ["conv_id", "turn", "role", "text", "loss", "chars"])

    schema = T.StructType([*rows.schema.fields[:2], T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("loss", _SPANS), T.StructField("chars", T.LongType())])
    return rows.mapInArrow(work, schema)


class _Digest:
    """Running digests of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, loss: list[dict], chars: int) -> None:
        self.turns += 1
        self.chars += chars
        self.all.update(f"{role}\n{text}\n".encode())
        for span in loss:
            self.learned.update(text[span["begin"]:span["end"]].encode())
            self.loss_chars += span["end"] - span["begin"]

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: turns, and lengths and digests of its texts and of what is under the mask, read back.

    Turns are read back where they lie.  They are then sorted by conversation and stream through
    running digests, so a conversation of any length takes the memory of one batch; a digest of
    one text can only be taken from its beginning to its end, so that step is one task's for a
    conversation.
    """
    read = read_turns(formatted)
    schema = T.StructType([
        read.schema["conv_id"], *[T.StructField(name, kind) for name, kind in (
            ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()),
            ("formatted_chars", T.LongType()))]])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kind = None, None

        def rows_of(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds], strict=True)], schema.names)

        for batch in blocks(batches, 3):
            done, kind = [], batch.schema.field(0).type
            for conv_id, role, text, loss, chars in zip(*(batch[i].to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if current is None or current.conv_id != conv_id:
                    done += [] if current is None else [current.row()]
                    current = _Digest(conv_id)
                current.add(role, text, loss, chars)
            if done:
                yield rows_of(done)
        if current is not None:
            yield rows_of([current.row()])

    order = [F.asc_nulls_last("turn"), F.asc("role"), F.asc("text")]
    return read.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(work, schema)
