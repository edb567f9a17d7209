"""Chat formatting with a grammar round trip.

Grammar: a conversation is a row of turns, ``<|im_start|>`` role LF text ``<|im_end|>`` LF. A turn is rendered, read again by
the deterministic parser below, and compared with its source; while they differ, more of the text is escaped. Escaping
puts a backslash into a control-like opening (``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|``), and the parser takes one
backslash out of every such opening that has one, so every text can be recovered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Their assistant texts are what a model is trained on.
LOSS_ROLE = "assistant"
CONTROL = re.compile(r"<(?=\|im_(?:start|end)\|>)")
OPENING = re.compile(r"<(?=\\*\|)")
ESCAPED = re.compile(r"<\\(?=\\*\|)")
#: What each level escapes: nothing, control strings, every opening.
LEVELS = (None, CONTROL, OPENING)
#: Characters of a role that would end it or look like escapes.
ROLE_CODES = {"%": "%25", "\n": "%0A", "<": "%3C"}
ROLE_ESCAPED = re.compile("%(25|0A|3C)")


class Parser:
    """Reads rendered text piece by piece; pieces may end anywhere."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str, int]]:
        """Role, text and length of the rendered text of each turn that is complete."""
        self.rest += text
        while True:
            if not START.startswith(self.rest[:len(START)]):
                raise ValueError("a turn has to start here")
            line = self.rest.find("\n", len(START))
            end = self.rest.find(END, line + 1) if line >= 0 else -1
            stop = end + len(END) + 1
            if end < 0 or len(self.rest) < stop:
                return
            if self.rest[stop - 1] != "\n":
                raise ValueError("a turn has to end here")
            role, body = self.rest[len(START):line], self.rest[line + 1:end]
            self.rest = self.rest[stop:]
            yield ROLE_ESCAPED.sub(lambda m: chr(int(m[1], 16)), role), ESCAPED.sub("<", body), end - line - 1

    def close(self) -> None:
        if self.rest:
            raise ValueError("the last turn is not complete")


def render_turn(role: str, text: str) -> tuple[str, int]:
    """The rendered turn that reads back as its source, and the first level of escaping that does so."""
    for level, pattern in enumerate(LEVELS):
        name = "".join(ROLE_CODES.get(c, c) for c in role) if level else role
        piece = f"{START}{name}\n{pattern.sub(lambda m: m[0] + chr(92), text) if pattern else text}{END}\n"
        parser = Parser()
        try:
            turns = [(r, t) for r, t, _ in parser.feed(piece)]
            parser.close()
        except ValueError:
            continue
        if turns == [(role, text)]:
            return piece, level
    raise AssertionError("escaping every opening always reads back")


def format_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, piece, level)``: the rendered text of each turn, rendered where the row is.

    The pieces of a conversation in order of turn (null first; ties by role and piece) are its formatted text. Null roles and
    texts are empty, null conversations are one conversation, repeated rows stay repeated turns. Other columns are not read.
    """
    source = turns.select(F.col(conversation).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                          F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render_turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role")), pa.array([m[0] for m in made], pa.string()),
                                              pa.array([m[1] for m in made], pa.int32())], ["conv_id", "turn", "role", "piece", "level"])

    return source.mapInArrow(rendered, "conv_id long, turn long, role string, piece string, level int")


def in_order(pieces: DataFrame) -> DataFrame:
    """Pieces sorted within tasks, each conversation in one; a task streams through its rows and never holds a conversation."""
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece")


class Reading:
    """Digests of one conversation, fed in order."""

    def __init__(self) -> None:
        self.parser, self.turns, self.loss = Parser(), hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def feed(self, piece: str) -> None:
        self.chars += len(piece)
        for role, text, _ in self.parser.feed(piece):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == LOSS_ROLE:
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def result(self, conv_id: int | None) -> tuple:
        self.parser.close()
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read from the formatted text alone: digests of its turns and of the text under the loss mask.

    A digest runs over a conversation from start to end, so one task reads it, in a stream of bounded memory, however
    long it is. No pieces give no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in RESULT.split(", "))])
        now, open_id, done = None, None, []
        for batch in batches:
            for conv_id, piece in zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist()):
                if now is None or conv_id != open_id:
                    done += [now.result(open_id)] if now else []
                    now, open_id = Reading(), conv_id
                now.feed(piece)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        done += [now.result(open_id)] if now else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return in_order(pieces).select("conv_id", "piece").mapInArrow(read, RESULT)


def loss_spans(piece: str) -> list[tuple[int, int]]:
    """Start and end of the text under the loss mask in a rendered piece; it may hold escapes."""
    spans, at, parser = [], 0, Parser()
    while at < len(piece):
        line = piece.index("\n", at)
        end = piece.index(END, line + 1)
        if [r for r, _, _ in parser.feed(piece[at:end + len(END) + 1])] == [LOSS_ROLE]:
            spans.append((line + 1, end))
        at = end + len(END) + 1
    return spans
