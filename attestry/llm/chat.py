r"""Chat formatting from typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them in order: text is
escaped, the others become placeholders ``<image 1>`` with the attachment they stand for and the tokens they
expand to. A turn is written ``### role: body </turn>`` and a newline. Texts and roles have ``\``, ``<`` and ``#`` (roles also
``:``) written with a backslash before them, so that neither marks nor placeholders can be forged, and reading
back gives the same characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

PARTS = "array<struct<type: string, text: string, uri: string, units: int>>"
#: Tokens that one unit of an attachment expands to: an image's tile, a second of audio, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
END = " </turn>\n"

_MARKS = re.compile(r"([\\<#])")
_ROLE_MARKS = re.compile(r"([\\<#:])")
_BACK = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"### ((?:\\.|[^\\:])*): ", re.S)


class PartVisitor:
    """Flattens the parts of one turn; ``body``, ``attachments`` and ``tokens`` hold the outcome."""

    def __init__(self, unit_tokens: dict[str, int]):
        self.unit_tokens, self.body, self.attachments, self.tokens = unit_tokens, [], [], 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        if kind in self.unit_tokens:
            self.visit_attachment(kind, part)
        else:
            self.visit_text(part)

    def visit_text(self, part: dict) -> None:
        self.body.append(_MARKS.sub(r"\\\1", part.get("text") or ""))

    def visit_attachment(self, kind: str, part: dict) -> None:
        at = len(self.attachments) + 1
        n = self.unit_tokens[kind] * max(0, part.get("units") or 0)
        self.body.append(f"<{kind} {at}>")
        self.attachments.append({"kind": kind, "uri": part.get("uri"), "number": at, "tokens": n})
        self.tokens += n


def _turns(unit_tokens: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, bodies, held, tokens = [], [], [], []
            for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                v = PartVisitor(unit_tokens)
                for p in parts or ():
                    v.visit(p or {})
                heads.append(f"### {_ROLE_MARKS.sub(r'\\\1', role or '')}: ")
                bodies.append("".join(v.body))
                held.append(v.attachments)
                tokens.append(v.tokens)
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("uri", pa.string()), ("number", pa.int32()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(heads, pa.string()), pa.array(bodies, pa.string()), pa.array(held, kinds), pa.array(tokens, pa.int64())], names=["conv_id", "turn", "role", "head", "body", "held", "tokens"])

    return run


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts, spans = [], []
        for turns in batch.column(1):
            out, loss, at = [], [], 0
            for t in turns:
                head, body = t["head"].as_py(), t["body"].as_py()
                if t["role"].as_py() == "assistant":
                    loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
                out += (head, body, END)
                at += len(head) + len(body) + len(END)
            texts.append("".join(out))
            spans.append(loss)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, span), *batch.columns[2:]], names=["conv_id", "formatted", "loss", "attachments", "expanded_tokens"])


def format_chats(turns: DataFrame, unit_tokens: dict[str, int] | None = None) -> DataFrame:
    """(conv_id, formatted, loss, attachments, expanded_tokens) of each conversation in ``turns``.

    ``turns``: conv_id long, turn long, role string, parts (``PARTS``). Turns come in order of turn (nulls
    first), then role and body, so ties and repeated rows have one order. A null role, text or list of parts is empty; a part of an unknown type is
    text. ``loss``: the spans of assistants' bodies in ``formatted``, in code points. ``attachments``: in
    order, (turn, kind, uri, number in its turn, tokens). A conversation is one row: its turns are
    formatted apart, and only the finished turns meet. An empty table gives no row.
    """
    prepare(turns.sparkSession)
    rows = turns.select("conv_id", "turn", "role", "parts")
    held = "array<struct<kind: string, uri: string, number: int, tokens: bigint>>"
    done = rows.mapInArrow(_turns(unit_tokens or UNIT_TOKENS), f"conv_id long, turn long, role string, head string, body string, held {held}, tokens long")
    every = F.array_sort(F.collect_list(F.struct("turn", "role", "body", "head", "held")))
    # array_sort puts null fields last within structs, so nulls are given their place first
    done = done.withColumn("turn", F.coalesce("turn", F.lit(-(2**63)))).withColumn("role", F.coalesce("role", F.lit("")))
    whole = done.groupBy("conv_id").agg(every.alias("turns"), F.sum("tokens").alias("expanded_tokens"))
    listed = F.flatten(F.transform("turns", lambda t: F.transform(t["held"], lambda h: F.struct(t["turn"].alias("turn"), h["kind"].alias("kind"), h["uri"].alias("uri"), h["number"].alias("number"), h["tokens"].alias("tokens")))))
    whole = whole.select("conv_id", "turns", listed.alias("attachments"), "expanded_tokens")
    kinds = "array<struct<turn: bigint, kind: string, uri: string, number: int, tokens: bigint>>"
    return whole.mapInArrow(_assembled, f"conv_id long, formatted string, loss array<struct<start: bigint, `end`: bigint>>, attachments {kinds}, expanded_tokens long")


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; placeholders are left out of the text."""
    out, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        stop = formatted.index(END, head.end())
        body = formatted[head.end() : stop]
        out.append((_BACK.sub(r"\1", head[1]), unescaped(body)))
        at = stop + len(END)
    return out


def unescaped(body: str) -> str:
    # a pair of backslashes is one character, so placeholders are looked for between escapes only
    if "<" in body.replace("\\\\", "").replace("\\<", ""):
        body = re.sub(r"(\\.)|<(?:image|audio|document) \d+>", lambda m: m[1] or "", body, flags=re.S)
    return _BACK.sub(r"\1", body) if "\\" in body else body


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        turns, masked = [], []
        for text, loss in zip(batch.column(1), batch.column(2), strict=True):
            text = text.as_py()
            turns.append([{"role": r, "text": t} for r, t in parse_chat(text)])
            masked.append("".join(unescaped(text[s["start"].as_py() : s["end"].as_py()]) for s in loss))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(turns, kind), pa.array(masked, pa.string())], names=["conv_id", "formatted", "turns", "loss_text"])


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_text) read back from ``formatted`` and ``loss`` alone."""
    return chats.select("conv_id", "formatted", "loss").mapInArrow(_read, "conv_id long, formatted string, turns array<struct<role: string, text: string>>, loss_text string")
