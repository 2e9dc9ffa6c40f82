"""Chat formatting with typed content parts.

A turn's content is a list of parts (text, image, audio, document).  A visitor flattens them in
order: text is escaped, the others become placeholders, and each placeholder adds an attachment
reference and the number of tokens that it stands for after expansion.  A part of any other type
becomes the placeholder <|other|> of no tokens, its type kept in the reference.

Template: <|im_start|>ROLE\\nCONTENT<|im_end|>\\n for each turn.  Inside roles and texts a backslash
becomes two and "<|" becomes "<\\|", so no text can hold a control string, and unescape() undoes it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Placeholder kinds and the tokens that one attachment expands to when its size is not given.
PLACEHOLDERS = {"image": 576, "audio": 750, "document": 1024}
#: Code points of one output row; a longer conversation comes in several.
PART_CHARS = 16_000_000
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def escape_role(role: str) -> str:
    """Roles end at the line break, so one inside a role is escaped too."""
    return escape(role).replace("\n", "\\n")


@dataclass
class Flattened:
    """What the visitor gathers over a conversation."""

    out: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[dict] = field(default_factory=list)
    expanded: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)


class PartVisitor:
    """Visits the parts of turns; visit_<type> handles one type."""

    def __init__(self, trained_roles: tuple[str, ...] = ("assistant",), expansion: dict[str, int] | None = None):
        self.trained, self.expansion = trained_roles, PLACEHOLDERS | (expansion or {})

    def visit_text(self, part: dict, to: Flattened, trained: bool) -> None:
        begin = to.length
        to.write(escape(part.get("text") or ""))
        if trained and to.length > begin:
            to.loss.append((begin, to.length))

    def _attachment(self, part: dict, to: Flattened) -> None:
        tokens = part.get("tokens")
        tokens = self.expansion.get(part["type"], 0) if tokens is None else int(tokens)
        to.attachments.append({"position": to.length, "type": part["type"], "ref": part.get("ref"), "tokens": tokens})
        to.expanded += tokens
        to.write(f"<|{part['type'] if part['type'] in PLACEHOLDERS else 'other'}|>")

    visit_image = visit_audio = visit_document = visit_other = lambda self, part, to, trained: self._attachment(part, to)

    def turn(self, role: str | None, parts: list[dict], to: Flattened) -> None:
        role = role or ""
        to.write(START + escape_role(role) + "\n")
        for part in parts:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part, to, role in self.trained)
        to.write(END + "\n")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from the formatted text; placeholders stay."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


_FORMATTED = "part int, formatted string, n_turns long, loss_spans array<struct<begin:long,end:long>>, attachments array<struct<position:long,type:string,ref:string,tokens:long>>, expanded_tokens long"
_ATTACHMENT = pa.struct([("position", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])


def format_conversations(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per conversation: (conv, part, formatted, n_turns, loss_spans, attachments, expanded_tokens).

    turns has a row for each turn; with `parts`, that column (array of struct with type, text, ref,
    tokens) is a turn's content, else the one text is. loss_spans are code point ranges of
    `formatted` that hold trained text (still escaped). Rows are ordered by turn, then role and
    text, so ties and repeated rows come out alike each time; null turns come first. Null texts,
    parts and roles are empty, null conversation ids form one conversation, an empty table gives no rows.

    Turns are dealt by conversation and sorted (with spill) within the partition. A conversation of
    more than `part_chars` code points comes in several rows, part 0, 1, ..., each of whole turns with
    positions and numbers of its own, one after the other; so a worker holds no more than that and
    one turn, however many rows a conversation has.
    """
    kind = turns.schema[conv].dataType.simpleString()
    said = F.col(f"`{text}`") if parts is None else F.array_join(F.transform(F.col(f"`{parts}`"), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    cols = [F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(said, F.lit("")).alias("text")]
    if parts:
        cols.append(F.col(f"`{parts}`").alias("parts"))
    dealt = turns.select(*cols).repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    types = [pa.int32(), pa.string(), pa.int64(), pa.list_(_SPAN), pa.list_(_ATTACHMENT), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = PartVisitor(trained_roles)
        done: list[tuple] = []
        size, now, part, state, n, key_type = 0, None, 0, None, 0, None

        def flush() -> pa.RecordBatch:
            nonlocal size
            c = list(zip(*done, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array(c[0], key_type), *(pa.array(v, t) for v, t in zip(c[1:], types, strict=True))], ["conv", "part", "formatted", "n_turns", "loss_spans", "attachments", "expanded_tokens"])
            done.clear()
            size = 0
            return out

        def close() -> None:
            nonlocal size
            if state is not None:
                done.append((now, part, "".join(state.out), n, [{"begin": a, "end": b} for a, b in state.loss], state.attachments, state.expanded))
                size += state.length

        for batch in batches:
            key_type = batch.column(0).type
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                columns = [rows.column(0).to_pylist(), rows.column(2).to_pylist(), rows.column(4 if parts else 3).to_pylist()]
                for k, who, content in zip(*columns, strict=True):
                    other = state is None or k != now
                    if other or state.length > part_chars:
                        close()
                        if size > 4_000_000:
                            yield flush()
                        now, part, state, n = k, 0 if other else part + 1, Flattened(), 0
                    visitor.turn(who, (content or []) if parts else [{"type": "text", "text": content}], state)
                    n += 1
        close()
        if done:
            yield flush()

    return dealt.mapInArrow(run, f"conv {kind}, {_FORMATTED}").withColumnRenamed("conv", conv)


def conversation_digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Reads each formatted conversation back: (conv, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_attachments, expanded_tokens).

    A conversation's rows must come one after the other, as format_conversations() gives them; the
    digests run over its parts, one row in hand.
    """
    kind = formatted.schema[conv].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, numbers, key_type = None, None, pa.null()

        def close() -> None:
            if numbers is not None:
                n, chars, length, attached, expanded = numbers
                done.append((now, n, turns_sha.hexdigest(), chars, loss_sha.hexdigest(), length, attached, expanded))

        def flush() -> pa.RecordBatch:
            c = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c[0], key_type), *(pa.array(v, pa.string() if name.endswith("sha256") else pa.int64()) for name, v in zip(names[1:], c[1:], strict=True))], names)

        for batch in batches:
            key_type = batch.column(0).type
            for k, part, text, spans, attachments, expanded in zip(*(batch.column(i) for i in range(6)), strict=True):
                k = k.as_py()
                if numbers is None or k != now or part.as_py() == 0:
                    close()
                    now, numbers, turns_sha, loss_sha = k, [0] * 5, hashlib.sha256(), hashlib.sha256()
                text = text.as_py()
                for role, said in parse(text):
                    turns_sha.update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                    numbers[0] += 1
                for s in spans.as_py():
                    loss = unescape(text[s["begin"] : s["end"]])
                    loss_sha.update(loss.encode("utf-8", "replace"))
                    numbers[1] += len(loss)
                numbers[2] += len(text)
                numbers[3] += len(attachments)
                numbers[4] += expanded.as_py()
                if len(done) >= 4096:
                    yield flush()
        close()
        if done:
            yield flush()

    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"
    return formatted.select(F.col(conv).alias("conv"), "part", "formatted", "loss_spans", "attachments", "expanded_tokens").mapInArrow(run, schema).withColumnRenamed("conv", conv)
