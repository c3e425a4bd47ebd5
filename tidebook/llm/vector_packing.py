"""Vector bin packing of tokenised examples under limits on tokens, segments and loss-bearing tokens.

An example is a list of parts, each a text and whether its tokens bear loss: a document is one bearing part, a
conversation has its turns.  Its ids are its parts' ids in a row and a closing id.  Every example has a vector of demands
(tokens, one segment, loss-bearing tokens), every sequence a vector of what is left of its limits; both are taken as shares of
the limits.  A sequence takes, again and again, the example that fits with the largest dot product of the two, so what
is plentiful in the sequence is what the next example uses.  When none fits whole, the largest one gives as many of its
first ids as the limits let in and its rest goes back to the others.  A sequence of a power of two is not padded:
one that ends below its limit, because segments, loss or examples have run out, gives back what is beyond the last
power of two.  So no sequence is padded, and about one example a sequence is cut.

Examples are packed where they are read.  A task keeps a pool of examples, of at most ``POOL`` ids and one batch,
and closes sequences from it; nothing is shuffled, no group of rows meets anywhere, and a lost task packs its own rows
again without touching others.  Each task ends with at most eleven short sequences.  Which examples meet depends on how the
input is split into tasks, and so do sequence ids (task and number in it); what is guaranteed does not.

Defined cases: a null or empty text is the closing id alone; a null part, or a null list of parts, has no ids; repeated rows
and ids are packed once each; a null id packs like any other; an empty table gives no rows; other columns are ignored,
whatever their names; texts of any length are taken whole.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import table
from tidebook.llm.packing import _BYTE_SIGNS, tokenizer_path

TOKENIZER_FILE = "byte_bpe_50k.json"
#: The id that ends an example.
END = 1
#: Ids that a task holds before it closes sequences.
POOL = 1_000_000


class Limits(NamedTuple):
    """What a sequence may hold."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("loss_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)

class Encoder:
    """Token ids of whole texts under a byte-level vocabulary in a ``tokenizers`` file.

    The merges are tiktoken's, over that file's vocabulary, where every token is reached by merges, so its rank is its id: the ids
    are those of ``tokenizers`` in half the time.  What its splitting pattern gives up, white space over long stretches, goes
    to ``tokenizers`` itself.
    """

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        byte_of = {chr(sign): byte for byte, sign in _BYTE_SIGNS.items()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if not text:
            return b""
        try:
            ids = self.fast.encode(text, allowed_special="all")
        except ValueError:
            ids = self.plain.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


class _Example:
    """Ids of one row that are not placed yet, from ``start`` on, and which of them bear loss."""

    __slots__ = ("doc", "ids", "start", "tokens", "bearing", "loss")

    def __init__(self, doc: int | None, ids: bytes, bearing: np.ndarray | None):
        self.doc, self.ids, self.start = doc, ids, 0
        #: Bearing ids before each place; None if all are.
        self.bearing = bearing
        self.count()

    def count(self) -> None:
        self.tokens = len(self.ids) // 4 - self.start
        self.loss = self.bears(self.tokens)

    def bears(self, n: int) -> int:
        """How many of the next ``n`` ids bear loss."""
        return n if self.bearing is None else int(self.bearing[self.start + n] - self.bearing[self.start])

    def most(self, tokens: int, loss: int) -> int:
        """The largest number of next ids within both limits."""
        tokens = min(tokens, self.tokens)
        if self.bearing is None:
            return min(tokens, loss)
        return min(tokens, bisect_left(self.bearing, int(self.bearing[self.start]) + loss + 1, lo=self.start) - self.start - 1)


class Packer:
    """The pool of a task, by kinds of examples with equal demands, and the sequences closed from it."""

    def __init__(self, limits: Limits = Limits()):
        if min(limits) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits = limits
        self.pooled = 0
        self.kinds: dict[tuple[int, int, bool], int] = {}
        self.waiting: list[list[_Example]] = []
        self.demand = np.zeros((64, 3))
        self.tokens, self.loss = np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.bearing, self.there = np.zeros(64, bool), np.zeros(64, bool)

    def add(self, example: _Example) -> None:
        """Put an example, or the rest of one, into the pool."""
        example.count()
        if not example.tokens:
            return
        self.pooled += example.tokens
        # what is beyond the limits makes no difference to the next sequence
        key = min(example.tokens, self.limits.tokens), min(example.loss, self.limits.loss), bool(example.bears(1))
        k = self.kinds.get(key)
        if k is None:
            k = self.kinds[key] = len(self.waiting)
            self.waiting.append([])
            if k == len(self.there):
                self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
                columns = (self.tokens, self.loss, self.bearing, self.there)
                self.tokens, self.loss, self.bearing, self.there = (np.concatenate([a, np.zeros_like(a)]) for a in columns)
            self.tokens[k], self.loss[k], self.bearing[k] = key
            self.demand[k] = key[0] / self.limits.tokens, 1 / self.limits.segments, key[1] / self.limits.loss
        self.waiting[k].append(example)
        self.there[k] = True

    def _take(self, k: int) -> _Example:
        example = self.waiting[k].pop()
        self.there[k] = bool(self.waiting[k])
        self.pooled -= example.tokens
        return example

    def _next(self, left: Limits, whole: bool) -> _Example | None:
        """The example with the largest dot product of its demand and what is left, of those that fit whole or by an id."""
        if whole:
            ok = self.there & (self.tokens <= left.tokens) & (self.loss <= left.loss)
        else:
            ok = self.there & ~self.bearing if left.loss == 0 else self.there
        if not ok.any():
            return None
        rest = np.array(left) / self.limits
        return self._take(int(np.argmax(np.where(ok, self.demand @ rest, -1.0))))

    def close(self) -> list[tuple[_Example, int, int]]:
        """One more sequence from a pool that is not empty: examples, starts and lengths in their order."""
        placed: list[tuple[_Example, int, int]] = []
        left = self.limits
        cut = []  # an example has at most one piece in a sequence
        while left.tokens and left.segments:
            example = self._next(left, whole=True) or self._next(left, whole=False)
            if example is None:
                break
            n = example.most(left.tokens, left.loss)
            left = Limits(left.tokens - n, left.segments - 1, left.loss - example.bears(n))
            placed.append((example, example.start, n))
            example.start += n
            if n < example.tokens:
                cut.append(example)
        filled = self.limits.tokens - left.tokens
        extra = 0 if filled == self.limits.tokens else filled - (1 << (filled.bit_length() - 1))
        while extra:  # back to the last power of two
            example, start, n = placed.pop()
            example.start = start + max(0, n - extra)
            if n > extra:
                placed.append((example, start, n - extra))
            if example not in cut:
                cut.append(example)
            extra -= min(n, extra)
        for example in cut:
            self.add(example)
        return placed


def _rows(batches, limits: Limits, tokenizer: str, end: int, task: int) -> Iterator:
    """Pieces of a task's examples, a batch at a time."""
    import pyarrow as pa

    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    encoder = _encoders[tokenizer]
    packer = Packer(limits)
    closing = np.array([end], "<u4").tobytes()
    types = [pa.int64()] * len(PIECE.names)
    sequence = task << 36

    def closed(down_to: int):
        nonlocal sequence
        while packer.pooled > down_to:
            out: list[list] = [[] for _ in types]
            for _ in range(1000):
                if packer.pooled <= down_to:
                    break
                offset = 0
                for example, start, n in packer.close():
                    crc = zlib.crc32(memoryview(example.ids)[4 * start : 4 * (start + n)])
                    loss = n if example.bearing is None else int(example.bearing[start + n] - example.bearing[start])
                    row = (example.doc, start, n, crc, len(example.ids) // 4, loss, sequence, offset)
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                    offset += n
                sequence += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=PIECE.names)

    for batch in batches:
        for doc, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = [(encoder.encode(p["text"]), bool(p["loss"])) for p in parts.as_py() or () if p is not None]
            ids = b"".join([i for i, _ in found]) + closing
            bearing = None
            if not all(loss for _, loss in found):
                # the closing id bears loss if the last part does
                flags = np.repeat([loss for _, loss in found] + [found[-1][1]], [len(i) // 4 for i, _ in found] + [1])
                bearing = np.concatenate([[0], np.cumsum(flags)])
            packer.add(_Example(doc, ids, bearing))
            if packer.pooled > POOL:
                yield from closed(POOL // 2)
    yield from closed(0)


_encoders: dict[str, Encoder] = {}


def pack(
    df: DataFrame, parts: Column, id_col: str = "doc_id", limits: Limits = Limits(), tokenizer: str = TOKENIZER_FILE, end: int = END
) -> DataFrame:
    """One row per piece of every example: its ids, its loss-bearing ids and its place.

    ``parts`` is an array of structs ``text`` and ``loss``: the parts of an example in order.  ``doc_id`` is the row's id.
    """

    def run(batches):
        from pyspark import TaskContext

        return _rows(batches, limits, tokenizer, end, TaskContext.get().partitionId())

    kind = "array<struct<text:string,loss:boolean>>"
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), parts.cast(kind).alias("parts")).mapInArrow(run, PIECE)


def documents_as_parts(text_col: str = "text") -> Column:
    """A text whose ids all bear loss."""
    return F.array(F.struct(F.col(f"`{text_col}`").cast("string").alias("text"), F.lit(True).alias("loss")))


def conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, parts): the turns of each conversation in order, of which the assistant's bear loss.

    The turns of one conversation are one example and must fit into a task; equal turn numbers are ordered by role and text.
    """
    turn = F.struct(*[F.col(f"`{c}`").alias(a) for c, a in ((turn_col, "turn"), (role_col, "role"), (text_col, "text"))])
    turns = F.array_sort(F.collect_list(turn))
    parts = F.transform(turns, lambda x: F.struct(x["text"].alias("text"), F.coalesce(x["role"] == "assistant", F.lit(False)).alias("loss")))
    return df.groupBy(F.col(f"`{id_col}`").alias("conv_id")).agg(parts.alias("parts"))


def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids without padding."""
    return pack(table(spark, sf_dir, "documents"), documents_as_parts())
