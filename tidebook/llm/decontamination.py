"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts are normalised byte by byte: ``A-Z`` become lower case and every other ASCII byte that is no letter or digit
becomes a space, so position ``i`` of the normalised text is position ``i`` of the original.  The words between the
spaces are joined by single spaces and scanned once; a match is turned back into word numbers, and those into
code-point offsets of the original text.

A *window* is ``window`` consecutive words of an item; an item with fewer words (but at least one) is one window.

The automaton lives in executor memory, so its nodes are bounded: items are cut into segments of ``SEGMENT`` windows
(a segment has the words of its windows, so neighbours overlap), the letters of a segment's windows are a bound on its
nodes, and segments are dealt by hash into blocks of about ``BLOCK_NODES``.  Each block is one automaton and one pass,
and each pass writes what it found before the next block starts; the driver holds the segments of one block at a time.
A node takes about 40 bytes.  Ordinary benchmarks are one block and one pass, without a shuffle of documents.

Defined cases: a null or wordless text has 0 words and is never contaminated; a null or wordless item has no
windows; an item with a null id marks words but is not listed among the items; repeated item ids count once;
repeated documents are judged one by one; an empty benchmark hits nothing; other columns are carried through.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import fresh, shared_checkpoint, table

WINDOW = 10
#: Windows in a segment of an item, and nodes of a block's automaton.
SEGMENT = 512
BLOCK_NODES = 4_000_000

#: ASCII bytes that belong to words: digits and letters; everything from 0x80 up belongs to words, too.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("words", T.ArrayType(SPAN)),
        T.StructField("spans", T.ArrayType(SPAN)),
    ]
)

_automata: dict[str, object] = {}


def normalise(raw: bytes) -> list[bytes]:
    """The words of a text."""
    return raw.translate(_FOLD).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All windows of an item."""
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def _automaton(key: str, items: list[tuple[str | None, bytes]], window: int):
    """Build the automaton once per Python worker; patterns are space-framed words, so they match whole words only."""
    if key not in _automata:
        import ahocorasick

        _automata.clear()  # a worker keeps the automaton of one block

        owners: dict[str, tuple[int, set[str]]] = {}
        for item_id, raw in items:
            for words in windows_of(normalise(raw), window):
                pattern = (b" " + b" ".join(words) + b" ").decode("latin-1")
                owners.setdefault(pattern, (len(words), set()))[1].update([item_id] if item_id is not None else [])
        machine = ahocorasick.Automaton()
        for pattern, (n, ids) in owners.items():
            machine.add_word(pattern, (n, frozenset(ids)))
        if owners:
            machine.make_automaton()
        _automata[key] = machine if owners else None
    return _automata[key]


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _spans(raw: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Code-point offsets of word ranges in the original text."""
    data = np.frombuffer(raw, dtype=np.uint8)
    word = np.frombuffer(raw.translate(_FOLD), dtype=np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in ranges]


def _scan(machine, raw: bytes | None) -> dict:
    words = normalise(raw) if raw else []
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    if machine is not None and words:
        joined = b" " + b" ".join(words) + b" "
        last, count = 0, 0
        for end, (n, ids) in machine.iter(joined.decode("latin-1")):
            count += joined.count(b" ", last, end)  # spaces before the closing one: words up to here
            last = end
            ranges.append((count - n, count))
            items |= ids
    merged = _merge(ranges)
    return {
        "n_words": len(words),
        "n_hit": sum(b - a for a, b in merged),
        "items": sorted(items),
        "words": [{"start": a, "end": b} for a, b in merged],
        "spans": _spans(raw, merged) if merged else [],
    }


def _joined(old: dict, new: dict, raw: bytes | None) -> dict:
    """The findings of two blocks in one text."""
    merged = _merge([(w["start"], w["end"]) for w in [*old["words"], *new["words"]]])
    return {
        "n_words": new["n_words"],
        "n_hit": sum(b - a for a, b in merged),
        "items": sorted({*old["items"], *new["items"]}),
        "words": [{"start": a, "end": b} for a, b in merged],
        "spans": _spans(raw, merged) if merged else [],
    }


def segments(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Rows (item_id, words, nodes): pieces of items of at most ``SEGMENT`` windows, and a bound on their nodes."""
    shape = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("words", T.BinaryType()), T.StructField("nodes", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], []]
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normalise(raw) if raw else []
                for i in range(0, max(1, len(words) - window + 1) if words else 0, SEGMENT):
                    part = words[i : i + SEGMENT + window - 1]
                    nodes = sum(sum(map(len, w)) + len(w) + 1 for w in windows_of(part, window))
                    for column, v in zip(out, (item, b" ".join(part), nodes), strict=True):
                        column.append(v)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.binary(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=shape.names)

    items = benchmark.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("binary"))
    return items.mapInArrow(run, shape).distinct()


def _pass(rows: DataFrame, names: list[str], text_col: str, old: str | None, out: str, shared, window: int) -> DataFrame:
    """Columns ``names`` and ``out``: the findings of one block, joined to those of the blocks before in ``old``.

    Columns travel under positional names, so that none can clash.
    """
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    before = F.col(f"`{old}`") if old else F.lit(None).cast(RESULT)
    source = rows.select(*kept, F.col(f"`{text_col}`").cast("binary").alias("t"), before.alias("o"))
    shape = T.StructType([*source.schema.fields[: len(names)], T.StructField("r", RESULT)])
    key = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        machine, kind = _automaton(key, shared.value, window), to_arrow_type(RESULT)
        for batch in batches:
            texts, olds = (batch.column(len(names) + k).to_pylist() for k in (0, 1))
            found = [_scan(machine, raw) if o is None else _joined(o, _scan(machine, raw), raw) for o, raw in zip(olds, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, type=kind)], names=shape.names)

    return source.mapInArrow(run, shape).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("r").alias(out))


def annotate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_nodes: int = BLOCK_NODES,
    out: str = "contamination",
    carry: list[str] | None = None,
) -> DataFrame:
    """Documents with a struct column: n_words, n_hit, items, merged word ranges and their spans in the original."""
    names = list(docs.columns if carry is None else carry)
    if out in names:
        raise ValueError(f"column {out!r} exists already; choose another name for the result")
    parts = shared_checkpoint(segments(benchmark, item_id_col, item_text_col, window))
    blocks = max(1, -(-(parts.agg(F.sum("nodes")).first()[0] or 0) // block_nodes))
    found, old = docs, None
    for k in range(blocks):
        rows = parts.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k).collect()  # one block
        shared = docs.sparkSession.sparkContext.broadcast([(r["item_id"], bytes(r["words"])) for r in rows])
        last = k == blocks - 1
        kept = names if last else [*docs.columns]
        now = out if last else fresh(docs.columns, f"found_{k % 2}")
        found = _pass(found, kept, text_col, old, now, shared, window)
        if not last:
            found, old = shared_checkpoint(found), now
    return found


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``annotate`` over all documents and the whole benchmark."""
    hit = annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return hit.select(
        "doc_id",
        "contamination.n_words",
        "contamination.n_hit",
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("contamination.n_hit") > 0).alias("contaminated"),
    )


def _ascii_lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: DuckDB: every document window of each item-window length is looked up among the item windows.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all({_ascii_lower('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         coalesce(regexp_extract_all({_ascii_lower('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), win AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)
), hit AS (
  SELECT win.r, win.i, win.n, p.item_id FROM win JOIN p ON win.n = p.n AND win.s = p.s
), words AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def digest(ids: list[str]) -> str:
    """The digest of a list of item ids, as the query gives it."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
