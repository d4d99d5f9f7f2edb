"""Chat formatting with typed content parts.

A message is a role and a list of parts (text, image, audio, document). A visitor flattens
the parts of a turn in order: text is escaped, every other part becomes a placeholder,
an attachment reference and a count of expanded tokens. A turn is written as

    <|turn|>role<|says|>content<|done|>

Control strings inside roles and texts are escaped reversibly: a ``\\`` goes after the first
character of every control string, and in front of every ``\\`` that is there already. The loss
mask of an assistant turn is its content; placeholders carry no loss.

Turns are formatted one by one, so no conversation is gathered in one row. ``digests`` reads the
written turns back in order: rows are dealt by conversation and sorted, and hashes run along;
a task holds one batch of rows, however long a conversation is.

Null texts and roles are empty; null parts are skipped. Adjacent text parts are escaped as one text. A
part of an unknown type is a document; a size that is no positive number counts as not given; a part that
is no object is text. Turns with equal numbers are ordered by
role and text; repeated rows are repeated turns. A null conv_id is one conversation.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
PLACES = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings that a text must not bring in: this template's, and those of common others.
CONTROL = (
    TURN, SAYS, DONE, *PLACES.values(), "<|endoftext|>", "<|im_start|>", "<|im_end|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL) + r"|\\")
#: Tokens that one attachment stands for, if its part does not say: fixed for images, by length else.
TOKENS = {"image": 256, "audio": 50, "document": 1}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """The inverse of ``escape``: a pair of backslashes is one; a lone one goes."""
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        out.append(text[at:k])
        if text[k + 1 : k + 2] == "\\":
            out.append("\\")
            at = k + 2
        else:
            at = k + 1
    out.append(text[at:])
    return "".join(out)


@dataclass
class Flat:
    """What a visitor has written of one turn."""

    content: str = ""
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0


def number(part: dict, name: str, default: float = 1) -> float:
    """A size of a part; what is no positive finite number counts as not given."""
    try:
        value = float(part.get(name) or default)
    except (TypeError, ValueError):
        return default
    return value if 0 < value < 1e15 else default


class Visitor:
    """Walks typed parts in order. A new kind of part is a new ``visit_`` method."""

    def __init__(self, role: str):
        self.trained, self.flat = role == "assistant", Flat()

    def visit(self, parts: list[dict]) -> Flat:
        run: list[str] = []  # adjacent text parts are one text: a control string may span them
        for part in filter(None, parts if isinstance(parts, list) else [parts]):
            part = part if isinstance(part, dict) else {"text": part}
            kind = str(part.get("type") or "text")
            if kind == "text":
                run.append(str(part.get("text") or ""))
                continue
            self.visit_text("".join(run))
            run = []
            getattr(self, f"visit_{kind}", self.visit_document)(part)
        self.visit_text("".join(run))
        return self.flat

    def visit_text(self, raw: str) -> None:
        text = escape(raw)
        start = len(self.flat.content)
        self.flat.content += text
        if self.trained and text:
            self.flat.loss.append((start, start + len(text)))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.flat.attachments.append({"kind": kind, "ref": part.get("ref") or "", "at": len(self.flat.content), "tokens": tokens})
        self.flat.content += PLACES[kind]
        self.flat.tokens += tokens

    def visit_image(self, part: dict) -> None:
        """A tile of 256 tokens for every 512 x 512 pixels begun; one tile if the size is not known."""
        tiles = max(1, -(-int(number(part, "width")) // 512) * -(-int(number(part, "height")) // 512))
        self._attach("image", part, int(number(part, "tokens", 0)) or TOKENS["image"] * tiles)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, int(number(part, "tokens", 0)) or int(TOKENS["audio"] * max(1.0, number(part, "seconds"))))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, int(number(part, "tokens", 0)) or TOKENS["document"] * max(1, len(str(part.get("text") or "")) // 4))


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, Flat]:
    """A turn as written, and its parts with places counted from the start of the turn."""
    role = role or ""
    head = TURN + escape(role) + SAYS
    flat = Visitor(role).visit(parts)
    flat.loss = [(a + len(head), b + len(head)) for a, b in flat.loss]
    for x in flat.attachments:
        x["at"] += len(head)
    return head + flat.content + DONE, flat


def read_turn(written: str, loss: list[tuple[int, int]]) -> tuple[str, str, str]:
    """Role, text and text under the loss mask of a written turn."""
    says = written.index(SAYS)
    role, content = written[len(TURN) : says], written[says + len(SAYS) : -len(DONE)]
    return unescape(role), unescape(content), "".join(unescape(written[a:b]) for a, b in loss)


FORMATTED = (
    "conv_id bigint, turn bigint, role string, written string, loss array<struct<start:int,end:int>>, "
    "attachments array<struct<kind:string,ref:string,at:int,tokens:bigint>>, n_expanded bigint"
)


def format_turns(turns: DataFrame) -> DataFrame:
    """One written turn per row of (conv_id, turn, role, parts): ``parts`` is a JSON list of parts."""
    loss_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turn(r.as_py(), json.loads(p.as_py() or "[]")) for r, p in zip(batch.column("role"), batch.column("parts"), strict=True)]
            yield pa.record_batch([
                batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array([w for w, _ in done], pa.string()),
                pa.array([[{"start": a, "end": b} for a, b in f.loss] for _, f in done], loss_type),
                pa.array([f.attachments for _, f in done], kinds), pa.array([f.tokens for _, f in done], pa.int64()),
            ], ["conv_id", "turn", "role", "written", "loss", "attachments", "n_expanded"])

    return turns.select("conv_id", "turn", "role", "parts").mapInArrow(run, FORMATTED)


def text_parts(conversations: DataFrame) -> DataFrame:
    """Turns of plain text as one text part each."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit("")).alias("role"), F.to_json(F.array(part)).alias("parts"))


def digests(written: DataFrame) -> DataFrame:
    """Per conversation, from the written turns: counts and digests of roles, texts and text under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_expanded"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        now, key = None, None

        def row() -> list:
            return [key, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4], now[5]]

        for batch in batches:
            ended = []
            for conv, written, loss, tokens in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "written", "loss", "n_expanded")), strict=True):
                if now is None or conv != key:
                    if now is not None:
                        ended.append(row())
                    key, now = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text, learned = read_turn(written, [(x["start"], x["end"]) for x in loss])
                now[0] += 1
                now[1].update(f"{role}\n{text}\n".encode())
                now[2] += len(learned)
                now[3].update(learned.encode())
                now[4] += len(written)
                now[5] += tokens
            if ended:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*ended, strict=True), kinds, strict=True)], names)
        if now is not None:
            yield pa.record_batch([pa.array([c], k) for c, k in zip(row(), kinds, strict=True)], names)

    ordered = written.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "written")
    return ordered.select("conv_id", "written", "loss", "n_expanded").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_expanded bigint")
