"""Chat formatting by a grammar whose rendering is reparsed until it gives the turns back.

A turn is written as ``<|role|>NAME<|text|>BODY<|end|>``. Inside a name or body
every control string is escaped, so the deterministic parser below recovers the
turns from any sequence of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doselake.llm.common import text_or_empty


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the escape sign, and foreign strings never to appear in plain form."""

    role: str = "<|role|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    escape: str = "\\"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.role, self.text, self.end, *self.foreign)


class GrammarError(ValueError):
    """The rendered text is not a sequence of blocks."""


def escape(body: str, t: Template) -> str:
    """Double the escape sign, then break each control string after its first character."""
    if t.escape in body:
        body = body.replace(t.escape, t.escape * 2)
    for c in t.controls:
        if c in body:
            body = body.replace(c, c[0] + t.escape + c[1:])
    return body


def unescape(body: str, t: Template) -> str:
    """Drop each escape sign and keep the sign that follows it as it is."""
    if t.escape not in body:
        return body
    parts, out = body.split(t.escape), []
    # an empty part between two signs is a doubled sign
    i, out = 1, [parts[0]]
    while i < len(parts):
        if parts[i] == "" and i + 1 < len(parts):
            out += [t.escape, parts[i + 1]]
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return "".join(out)


def parse_block(block: str, t: Template) -> tuple[str, str]:
    """Role and text of one block, or ``GrammarError``."""
    if not block.startswith(t.role) or not block.endswith(t.end):
        raise GrammarError(block[:40])
    name, mark, body = block[len(t.role):len(block) - len(t.end)].partition(t.text)
    if not mark or any(c in name or c in body for c in t.controls):
        raise GrammarError(block[:40])
    return unescape(name, t), unescape(body, t)


def render_turn(role: str, text: str, t: Template = Template()) -> tuple[str, int, int]:
    """The block of a turn and the span of its text in it, checked by the parser.

    Plain text is tried first; where the parser does not return the turn, its
    content is escaped, and checked again. An escape that still fails (a
    template whose marks contain the escape sign) is an error, never a silent loss.
    """
    name, body = role, text
    for attempt in range(2):
        block = f"{t.role}{name}{t.text}{body}{t.end}"
        try:
            if parse_block(block, t) == (role, text):
                start = len(t.role) + len(name) + len(t.text)
                return block, start, start + len(body)
        except GrammarError:
            pass
        if attempt == 0:
            name, body = escape(role, t), escape(text, t)
    raise GrammarError("the template cannot express this turn")


BLOCKS = "conv_id bigint, seq bigint, block string, start bigint, text_start bigint, text_end bigint, loss boolean"


def format_conversations(
    conversations: DataFrame, template: Template = Template(), learn: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """Rendered blocks of all conversations: the formatted text of a conversation is its blocks by ``seq``.

    ``start`` is where the block begins in the conversation's text, and
    ``text_start, text_end`` the span of the turn's text there; ``loss`` marks
    the roles of ``learn``. All positions are code points.

    Turns go by ``turn`` (null first), then role, then text. Null role or text
    is empty; rows with a null ``conv_id`` form one conversation; repeated rows
    are repeated turns. Turns are rendered one by one before the shuffle; after
    it, sorted rows stream past a running offset, so a conversation that holds a
    third of all turns needs the memory of one batch. Other columns are not read.
    """
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        text_or_empty("role").alias("role"), text_or_empty("text").alias("text"),
    )

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [render_turn(a, b, template) for a, b in zip(f["role"], f["text"], strict=True)]
            yield pd.DataFrame({
                "conv_id": f["conv_id"].astype("Int64"), "turn": f["turn"].astype("Int64"), "role": f["role"],
                "text": f["text"], "block": [m[0] for m in made], "a": [m[1] for m in made],
                "b": [m[2] for m in made], "loss": f["role"].isin(learn),
            })

    rendered = turns.mapInPandas(
        render, "conv_id bigint, turn bigint, role string, text string, block string, a bigint, b bigint, loss boolean"
    )
    ordered = rendered.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text"
    ).drop("turn", "role", "text")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seq, at = object(), 0, 0
        for f in frames:
            ids = [None if pd.isna(x) else int(x) for x in f["conv_id"]]
            seqs, starts = [], []
            for conv, block in zip(ids, f["block"], strict=True):
                if conv != key:
                    key, seq, at = conv, 0, 0
                seqs.append(seq)
                starts.append(at)
                seq, at = seq + 1, at + len(block)
            start = pd.Series(starts, index=f.index, dtype="int64")
            yield pd.DataFrame({
                "conv_id": pd.array(ids, "Int64"), "seq": seqs, "block": f["block"].values, "start": start.values,
                "text_start": (start + f["a"]).values, "text_end": (start + f["b"]).values, "loss": f["loss"].values,
            })

    return ordered.mapInPandas(place, BLOCKS)


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(blocks: DataFrame, template: Template = Template()) -> DataFrame:
    """Parse the blocks of ``format_conversations`` and digest what they say, one row per conversation.

    Must follow it directly: it relies on the blocks of a conversation being
    together and in order in one partition. Digests are fed turn by turn.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None

        def row() -> dict:
            n, turns, chars, loss, size = state
            return {"conv_id": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                    "loss_sha256": loss.hexdigest(), "formatted_chars": size}

        for f in frames:
            done = []
            for conv, seq, block, start, a, b, learn in zip(
                f["conv_id"], f["seq"], f["block"], f["start"], f["text_start"], f["text_end"], f["loss"], strict=True
            ):
                if seq == 0:
                    if state is not None:
                        done.append(row())
                    key = None if pd.isna(conv) else int(conv)
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_block(block, template)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if learn:
                    said = unescape(block[a - start:b - start], template)
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(block)
            yield _frame(done)
        if state is not None:
            yield _frame([row()])

    def _frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])
        out["conv_id"] = out["conv_id"].astype("Int64")
        return out.astype({"n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})

    return blocks.mapInPandas(read, READ)
