"""Best-fit packing of tokenised documents by exact-complement hashing.

Documents are tokenised, ended by id 0, and only those longer than a sequence are cut.  How pieces share sequences
depends on nothing but how many pieces of each length there are: a table of at most ``SEQUENCE`` counts, whatever
the input.  The plan is made on that table.  It goes through the lengths from the longest down; for each it looks
up single lengths, pairs and triples whose sum is exactly the gap, and uses as many of them as are available.  What
is left is placed by best fit, longest first.  The gaps may be those of whole sequences or those that longer pieces
have left; both orders are laid out, and best fit alone, and the fewest sequences win.  A plan is a list of runs: *n*
pieces of one length, by rank, go to *n* consecutive sequences at one offset.  Its size depends on the number of
lengths, not on the number of pieces.

Pieces then get their rank among the pieces of their length.  Lengths are split into as many hash buckets as their
pieces need, and equal pieces are counted first, so a length or a document that a third of all pieces share is numbered
by many tasks.

Defined cases: a null or empty text is the one id 0; repeated documents are packed once each; a null id packs like
any other; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import TOKENIZER_FILE, shared_checkpoint, table

SEQUENCE = 2048
#: Pieces of one length that are numbered by one task.
BUCKET_PIECES = 512
#: Copies of one piece that are written out by one row of the plan.
COPIES = 65_536
#: Most pieces of a combination that fills a gap exactly; the plan takes the layout with the fewest sequences.
COMBINED = (3, 2, 1)
#: Buckets whose sizes are added up by one task.
BUCKETS = 1024
#: Words whose ids a worker remembers, some 200 bytes each; more make it faster.
CACHE_WORDS = 800_000

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 up."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


_BYTE_SIGNS = _byte_signs()


class WordEncoder:
    """Token ids of texts, remembered by white-space-separated word.

    The tokeniser replaces white space by single spaces and never joins across them, so a text's ids are its
    words' ids in a row.  Only ASCII white space separates here; any other stays inside a word for the tokeniser.
    It also ignores case and never joins a letter and a comma or full stop, so words are remembered in lower case and
    without such an ending; texts that may hold a special token keep their case.
    """

    def __init__(self, path: str, cache_words: int | None = None):
        self.most = cache_words or CACHE_WORDS
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.endings = {c: self._ids([c])[0] for c in (b",", b".")}

    def _ids(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of words that are not known yet."""
        ended = [w for w in words if w[-1:] in self.endings and w[-2:-1].isalnum()]
        stems = dict.fromkeys(w[:-1] for w in ended)
        ended_set = set(ended)
        plain = [w for w in words if w not in ended_set and w not in stems]
        plain += [w for w in stems if w not in self.known]
        odd = []
        tokenize, pack = self.model.tokenize, struct.pack
        for w in plain:
            if w.isalpha() and w.islower():  # ASCII letters stand for themselves
                tokens = tokenize(w.decode("ascii"))
            else:
                text = w.decode("utf-8", "replace")
                if not (text.isalpha() and text.islower() and max(text) <= "\u00ff"):
                    odd.append(w)
                    continue
                tokens = tokenize(w.decode("latin-1").translate(_BYTE_SIGNS))  # one word to the tokeniser: straight to its model
            ids = [t.id for t in tokens]
            self.known[w] = pack(f"<{len(ids)}I", *ids)
        self.known.update(zip(odd, self._ids(odd), strict=True))
        for w in ended:
            self.known[w] = self.known[w[:-1]] + self.endings[w[-1:]]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without the closing id."""
        found = []
        for text in texts:
            words = (text if b"<|" in text else text.lower()).split() if text else []
            missing = [w for w in dict.fromkeys(words) if w not in self.known]
            if missing and len(self.known) + len(missing) > self.most:
                self.known.clear()
                missing = list(dict.fromkeys(words))
            self._learn(missing)
            found.append(b"".join(map(self.known.__getitem__, words)))
        return found


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """Where the public tokeniser's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict[tuple, WordEncoder] = {}


def pieces_of(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER_FILE, sequence: int = SEQUENCE, cache_words: int | None = None
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the crc32 of its ids.

    ``cache_words`` bounds what a worker remembers (``CACHE_WORDS`` by default).
    """

    def run(batches):
        import pyarrow as pa

        key = tokenizer, cache_words
        if key not in _encoders:
            _encoders[key] = WordEncoder(tokenizer_path(tokenizer), cache_words)
        encoder = _encoders[key]
        step = 4 * sequence
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode([text.as_py()])[0] + b"\0\0\0\0"
                for k, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    for column, v in zip(out, (doc, k, a // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=PIECE.names)

    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text")
    ).mapInArrow(run, PIECE)


class _Layout:
    """One way to lay pieces out: runs by length, from exact complements of so many pieces at most, then best fit."""

    def __init__(self, counts: dict[int, int], sequence: int, combined: int):
        self.sequence = sequence
        self.left = np.zeros(sequence + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.used = np.zeros(sequence + 1, dtype=np.int64)
        self.runs: dict[int, list[tuple[int, int, int]]] = {}
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of (first sequence, number)
        self.sequences = 0
        self._complements(combined)
        for length in range(sequence, 0, -1):
            while self.left[length] > 0:
                self._fit(length)

    def _place(self, length: int, n: int, first: int, offset: int) -> None:
        """The next ``n`` pieces of this length go to sequences ``first`` and up."""
        self.runs.setdefault(length, []).append((int(self.used[length]), first, offset))
        self.used[length] += n
        self.left[length] -= n

    def _open(self, gap: int, most: int) -> tuple[int, int]:
        """Take at most ``most`` sequences with this gap: the first of them and their number."""
        first, n = self.gaps[gap].pop()
        if n > most:
            self.gaps[gap].append((first + most, n - most))
        elif not self.gaps[gap]:
            del self.gaps[gap]
        return first, min(n, most)

    def _take(self, lengths: tuple[int, ...]) -> None:
        """Fill new sequences with a combination, as often as its pieces are available."""
        n = min(int(self.left[x]) // lengths.count(x) for x in lengths)
        first, offset = self.sequences, 0
        self.sequences += n
        for x in lengths:
            self._place(x, n, first, offset)
            offset += x

    def _single(self, gap: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        return (gap,) if gap > 0 and self.left[gap] > taken.count(gap) else None

    def _pair(self, gap: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        """The pair with this sum that is available most often, of equals the one whose longer length is longest."""
        if gap < 2:
            return None
        long = np.arange(gap - 1, (gap - 1) // 2, -1)
        free = self.left.copy()
        for x in taken:
            free[x] -= 1
        often = np.where(long == gap - long, free[long] // 2, np.minimum(free[long], free[gap - long]))
        at = int(np.argmax(often))
        return (int(long[at]), int(gap - long[at])) if often[at] > 0 else None

    def _triple(self, gap: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        sums = self._pair_sums()
        for x in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if self.left[x] > taken.count(x) and sums[gap - x] and (pair := self._pair(gap - x, (*taken, x))):
                return (x, *pair)
        return None

    def _pair_sums(self) -> np.ndarray:
        """Index of the sums of two available lengths; a length may stand twice in a sum even if it has one piece."""
        there = np.fft.rfft(self.left > 0, 2 * self.sequence)
        return np.fft.irfft(there * there, 2 * self.sequence) > 0.5

    def _complements(self, combined: int) -> None:
        """Exact complements of whole sequences, from the longest length down."""
        for length in range(self.sequence, 0, -1):
            gap = self.sequence - length
            if gap == 0 and self.left[length]:
                self._take((length,))
            for find in (self._single, self._pair, self._triple)[:combined]:
                while self.left[length] > 0 and (rest := find(gap, (length,))):
                    self._take((length, *rest))

    def _fit(self, length: int) -> None:
        """Pieces of this length fill the smallest gap that holds them, or new sequences; alike ones together.

        A gap that a piece has gone into is the smallest for the next one, until no further piece fits.
        """
        want = int(self.left[length])
        gap = min((g for g in self.gaps if g >= length), default=self.sequence)
        each = min(gap // length, want)
        many = want // each
        if gap in self.gaps:
            first, many = self._open(gap, many)
        else:
            first = self.sequences
            self.sequences += many
        for k in range(each):
            self._place(length, many, first, self.sequence - gap + k * length)
        if gap > each * length:
            self.gaps.setdefault(gap - each * length, []).append((first, many))


class Plan:
    """The layout with the fewest sequences: for each length, by rank, the first sequence and the offset of each run."""

    def __init__(self, counts: dict[int, int], sequence: int = SEQUENCE):
        best = min((_Layout(counts, sequence, n) for n in COMBINED), key=lambda layout: layout.sequences)
        self.sequences = best.sequences
        self.by_length = {
            length: tuple(np.array(column, dtype=np.int64) for column in zip(*runs, strict=True))
            for length, runs in best.runs.items()
        }


def _ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Pieces with their rank among the pieces of their length.

    Equal pieces are counted before that and written out again in parts, as a document repeated for a third of all rows
    would meet in one task.
    """
    kinds = shared_checkpoint(pieces.groupBy(*PIECE.names).agg(F.count("*").alias("copies")))
    rows = [(length, -(-n // BUCKET_PIECES)) for length, n in counts.items()]  # at most SEQUENCE of them
    buckets = pieces.sparkSession.createDataFrame(rows, "length long, buckets long")
    order = ("doc_id", "piece", "ids_crc32", "start")
    dealt = kinds.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64(*order), F.col("buckets")))
    sizes = dealt.groupBy("length", "bucket").agg(F.sum("copies").alias("n"))
    # sizes are added up inside groups of buckets, then group by group: a length may have billions of pieces
    sizes = sizes.withColumn("many", F.floor(F.col("bucket") / BUCKETS))
    until = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("length", "many").agg(F.sum("n").alias("n"))
    groups = groups.select("length", "many", F.coalesce(F.sum("n").over(until("length", "many")), F.lit(0)).alias("group_rank"))
    inside = sizes.withColumn("in_rank", F.coalesce(F.sum("n").over(until("length", "many", "bucket")), F.lit(0)))
    starts = inside.join(groups, ["length", "many"]).select("length", "bucket", (F.col("group_rank") + F.col("in_rank")).alias("start_rank"))
    within = Window.partitionBy("length", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        dealt.withColumn("before", F.coalesce(F.sum("copies").over(within), F.lit(0)))
        .join(starts, ["length", "bucket"])
        .select(*PIECE.names, "copies", (F.col("start_rank") + F.col("before")).alias("rank"))
    )
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))
    parts = numbered.where("copies > 1").withColumn("at", at).repartition(*order, "at")
    last = F.least(F.col("at") + COPIES, F.col("copies")) - 1
    several = parts.select(*PIECE.names, F.explode(F.sequence(F.col("rank") + F.col("at"), F.col("rank") + last)).alias("rank"))
    return numbered.where("copies = 1").drop("copies").unionByName(several)


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces with sequence_id and offset.  ``pieces`` is read twice: give it checkpointed."""
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan(counts, sequence).by_length)  # bounded by the number of lengths
    ranked = _ranked(pieces, counts)
    result = T.StructType([*PIECE.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        import pyarrow as pa

        runs = plan.value
        for batch in batches:
            lengths, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            seq, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                here = np.flatnonzero(lengths == length)
                start, first, place = runs[int(length)]
                at = np.searchsorted(start, ranks[here], side="right") - 1
                seq[here] = first[at] + ranks[here] - start[at]
                offset[here] = place[at]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in PIECE.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seq), pa.array(offset)], names=result.names)

    return ranked.mapInArrow(run, result)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return pack(shared_checkpoint(pieces_of(table(spark, sf_dir, "documents"))))
