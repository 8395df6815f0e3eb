"""Chat formatting with typed content parts.

A turn's content is a list of parts ``struct<kind, text, ref, size>``: ``text`` carries a text, ``image``,
``audio`` and ``document`` carry a reference and a size (pixels, milliseconds, pages).  A visitor walks the
parts in order, writes texts as they are (escaped) and every other part as a numbered placeholder
``<|image 1|>``, and records each attachment's place, reference and the number of tokens that the placeholder
expands to.

A formatted turn is ``### Role: text</turn>`` and a line end.  Inside a text, role name or reference the escape
character and every control string are escaped with a backslash, so that reading back gives the text
exactly.  The loss mask covers the texts of assistant turns: [loss_start, loss_end) in code points of the
formatted turn, empty for others.

Nulls: a null role or text is empty; a null list of parts has no parts; a null size counts as 0.  A turn of
an unknown part kind raises.  Rows are formatted each for itself; ``read_back`` streams the turns of a conversation
in order (turn, role, formatted text; null conversation ids form one conversation) and holds one turn at a time, so a
conversation may be of any length.  Repeated turns stand one after the other.  A long text is one row, held once as text and once formatted.
An empty table gives an empty result.  Only the named columns are read, so further columns and their names don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.common import small_batches

OPEN, MID, CLOSE, END = "### ", ": ", "</turn>", "</turn>\n"
LOSS_ROLE = "assistant"
PIXELS_A_TOKEN, MS_A_TOKEN, TOKENS_A_PAGE = 28 * 28, 40, 400
PART = "struct<kind:string,text:string,ref:string,size:bigint>"
FORMATTED = ("formatted string, loss_start int, loss_end int, expanded_tokens long, "
             "attachments array<struct<place:int,kind:string,ref:string,tokens:bigint>>")
_CONTROL = re.compile(r"\\|###|</turn>|<\|")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|<\||:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\\\|\\###|\\</turn>|\\<\||\\:)*): (.*)</turn>\n", re.S)
_PLACEHOLDER = re.compile(r"(\\\\|\\###|\\</turn>|\\<\|)|<\|(image|audio|document) (\d+)\|>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


@dataclass
class Visitor:
    """Writes the parts of one turn in order; ``pieces`` is the escaped text with placeholders."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part["kind"]
        if kind not in ("text", "image", "audio", "document"):
            raise ValueError(f"unknown content part {kind!r}")
        getattr(self, f"visit_{kind}")(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        self._attach(part, -(-(part["size"] or 0) // PIXELS_A_TOKEN))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, -(-(part["size"] or 0) // MS_A_TOKEN))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part["size"] or 0) * TOKENS_A_PAGE)

    def _attach(self, part: dict, tokens: int) -> None:
        place = len(self.attachments) + 1
        self.pieces.append(f"<|{part['kind']} {place}|>")
        self.attachments.append({"place": place, "kind": part["kind"], "ref": part["ref"], "tokens": tokens})


def format_turn(role: str | None, parts: list[dict] | None) -> dict:
    """One turn as text, its loss span in code points, its attachments and what these expand to."""
    v = Visitor()
    for part in parts or []:
        v.visit(part)
    head = OPEN + escape(role or "").replace(":", "\\:") + MID
    body = "".join(v.pieces)
    loss = len(body) if role == LOSS_ROLE else 0
    return {"formatted": head + body + END, "loss_start": len(head), "loss_end": len(head) + loss,
            "expanded_tokens": sum(a["tokens"] for a in v.attachments), "attachments": v.attachments}


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn, unescaped (placeholders stay as written)."""
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def parse_parts(body: str, attachments: list[dict]) -> list[dict]:
    """The parts of an escaped body: texts between placeholders, and the attachments that these name."""
    parts, at, by = [], 0, {a["place"]: a for a in attachments}
    for m in _PLACEHOLDER.finditer(body):
        if m[1]:
            continue
        if m.start() > at:
            parts.append({"kind": "text", "text": unescape(body[at: m.start()]), "ref": None})
        parts.append({"kind": m[2], "text": None, "ref": by[int(m[3])]["ref"]})
        at = m.end()
    if at < len(body):
        parts.append({"kind": "text", "text": unescape(body[at:]), "ref": None})
    return parts


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size"))).cast(f"array<{PART}>")


def part(kind: str, ref: Column, size: Column) -> Column:
    """An image (pixels), audio (milliseconds) or document (pages) part."""
    return F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("text"), ref.alias("ref"), size.cast("bigint").alias("size")).cast(PART)


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per turn: conv_id, turn, and the columns of FORMATTED."""
    small_batches(turns.sparkSession)
    cols = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"),
                        F.col(parts).alias("parts"))
    kinds = pa.list_(pa.struct([("place", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [format_turn(r, p) for r, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            of = lambda k, t: pa.array([x[k] for x in out], t)  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), of("formatted", pa.string()), of("loss_start", pa.int32()), of("loss_end", pa.int32()),
                                              of("expanded_tokens", pa.int64()), of("attachments", kinds)],
                                             ["conv_id", "turn", "formatted", "loss_start", "loss_end", "expanded_tokens", "attachments"])

    return cols.mapInArrow(run, f"conv_id long, turn long, {FORMATTED}")


def attached(formatted: DataFrame) -> DataFrame:
    """conv_id, n_attachments, expanded_tokens, attachments_sha256 of each conversation: the attachments that the placeholders of its
    formatted turns name, read back from the text (kind, space, reference, space, tokens, line end each, by turn and place)."""
    kinds = "conv_id long, turn long, place int, kind string, ref string, tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for c, turn, text, attachments in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "formatted", "attachments")), strict=True):
                by = {a["place"]: a for a in attachments}
                parts = [p for p in parse_parts(_TURN.fullmatch(text)[2], attachments) if p["kind"] != "text"]
                found += [(c, turn, k, p["kind"], p["ref"], by[k]["tokens"]) for k, p in enumerate(parts, 1)]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(types)], [x.split()[0] for x in kinds.split(", ")])

    small_batches(formatted.sparkSession)
    each = F.sort_array(F.collect_list(F.struct("turn", "place", "kind", "ref", "tokens")))
    line = lambda x: F.concat(x["kind"], F.lit(" "), x["ref"], F.lit(" "), x["tokens"].cast("string"), F.lit("\n"))
    return formatted.mapInArrow(run, kinds).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_attachments"), F.sum("tokens").alias("expanded_tokens"), F.sha2(F.array_join(F.transform(each, line), ""), 256).alias("attachments_sha256"))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from the formatted turns alone: digests of its turns and of its masked text.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end a turn), loss_chars, loss_sha256,
    formatted_chars, n_attachments, expanded_tokens.
    """
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
              "n_attachments long, expanded_tokens long")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def row() -> tuple:
            c, n, turns, chars, loss, size, files, tokens = state
            return c, n, turns.hexdigest(), chars, loss.hexdigest(), size, files, tokens

        for b in batches:
            done = []
            for c, text, lo, hi, files, tokens in zip(*(b.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_start", "loss_end", "files", "expanded_tokens")), strict=True):
                if state is None or state[0] != c:
                    if state is not None:
                        done.append(row())
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, body = parse_turn(text)
                state[1] += 1
                state[2].update(f"{role}\n{body}\n".encode())
                masked = unescape(text[lo:hi])
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(text)
                state[6] += files
                state[7] += tokens
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done, strict=True), types, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(), types, strict=True)], names)

    small_batches(formatted.sparkSession)
    rows = formatted.withColumn("files", F.size("attachments").cast("long")).drop("attachments")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return rows.mapInArrow(run, schema)
