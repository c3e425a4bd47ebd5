"""Periodic runs of words in texts: stretches that repeat one block four times or more, and the texts without the repeats.

The suffix automaton of a word sequence has one state for each set of end positions that some substrings share.  States are
visited from the longest down; each hands its ordered set to its suffix link, the smaller set into the larger.  Two
end positions that become neighbours in a state are the ends of equal stretches of the state's length, and of no
longer ones; if their distance is not above that length, they seed a square.  The seeds of one run have one period and
one start, so the last end of them ends the run.  From three periods on a distance between neighbours is the smallest period:
a smaller one would put a further end position between them.

Before that, a text is narrowed to the stretches that can hold a run: every sequence of *k* words inside a run comes
again in it, at least as often as ``_times`` says.  What is left out cannot be part of a run, so nothing is lost, and prose
hardly meets the automaton.  A text is handled whole, alone, in one task, in time n log n and memory in proportion.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; repeated rows and ids are
handled one by one; other columns stay, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import fresh, let, map_text, table
from tidebook.llm.sharding import _crc_table

#: A run holds its period at least so many times (3 or more) and at least so many words.
LEAST_EXPONENT, LEAST_LENGTH = 4, 6
#: Lengths of the word sequences that are counted to narrow a text.
GRAMS = (1, 3, 5)
#: Rounds of narrowing; any number gives the same runs.
ROUNDS = 8

RUNS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "runs",
            T.ArrayType(
                T.StructType(
                    [T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]
                )
            ),
        ),
        T.StructField("collapsed", T.StringType()),
    ]
)


def _automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and own end position (-1: none) of each state, the first of which is the empty string."""
    length, link, own, ways = [0], [-1], [-1], [{}]
    last = 0
    for i, w in enumerate(words):
        now = len(length)
        length.append(i + 1)
        link.append(0)
        own.append(i)
        ways.append({})
        p = last
        while p != -1 and w not in ways[p]:
            ways[p][w] = now
            p = link[p]
        if p != -1:
            q = ways[p][w]
            if length[q] != length[p] + 1:  # q stands for longer strings, too: split off the shorter ones
                part = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                own.append(-1)
                ways.append(ways[q].copy())
                while p != -1 and ways[p].get(w) == q:
                    ways[p][w] = part
                    p = link[p]
                link[q] = q = part
            link[now] = q
        last = now
    return length, link, own


def _squares(words: list[int]) -> dict[tuple[int, int], int]:
    """(period, start) of each seeded run: its last end.  Positions are kept negative, so a state's own one goes last."""
    length, link, own = _automaton(words)
    ends: list[list[int] | None] = [None] * len(length)
    came: list[list[int]] = [[] for _ in length]
    after: dict[int, int] = {}
    found: dict[tuple[int, int], int] = {}
    for v in np.argsort(-np.array(length), kind="stable")[:-1].tolist():
        mine = ends[v]
        if own[v] >= 0:
            if mine is None:
                mine = [-own[v]]
            else:
                insort(mine, -own[v])
                came[v].append(-own[v])
        for x in came[v]:
            at = bisect_left(mine, x)
            for a, b in ((at - 1, at), (at, at + 1)):
                if a < 0 or b == len(mine):
                    continue
                late, early = mine[a], mine[b]
                if after.get(late) == early:
                    continue  # neighbours in a longer state
                after[late] = early
                if early - late <= length[v]:
                    key = early - late, 1 - early - length[v]
                    found[key] = max(found.get(key, 0), -late)
        ends[v], came[v] = None, []
        u = link[v]
        if u == 0:
            continue
        if ends[u] is None:
            ends[u] = mine
            continue
        small, large = sorted((mine, ends[u]), key=len)
        for x in small:
            insort(large, x)
        came[u] += small
        ends[u] = large
    return found


def _times(k: int, exponent: int, least: int) -> int:
    """How often every sequence of k words inside a run comes in that run, at least."""
    return min((max(least, exponent * period) - k + 1) // period for period in range(1, least + k + 1))


def _stretches(words: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """Stretches, from and up to, that hold all runs of the sequence; a run lies whole in one of them."""
    wanted = [(k, times) for k in GRAMS if (times := _times(k, exponent, least)) > 1]
    todo, done = [(0, len(words), 0)], []
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < least:
            continue
        for k, times in wanted if depth < ROUNDS else ():
            grams = words[lo : hi - k + 1].astype(np.uint64)
            for j in range(1, k):  # sequences that meet in one number only let more through
                grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[lo + j : hi - k + 1 + j].astype(np.uint64)
            _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
            good = counts[which] >= times
            if not good.all():
                edges = np.flatnonzero(np.diff(good.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                todo += [(lo + a, lo + b - 1 + k, depth + 1) for a, b in edges.tolist()]
                break
        else:
            done.append((lo, hi))
    return done


def runs_of(words: list, exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, by start, then period.

    A run has a smallest period, holds it ``exponent`` times and ``least`` words, and cannot be extended with it.
    """
    if exponent < 3:
        raise ValueError("runs of less than three periods are not supported")
    least = max(least, exponent)
    if len(words) < least:
        return []
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    numbers = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    found = set()
    for lo, hi in _stretches(numbers, exponent, least):
        for (period, start), end in _squares(numbers[lo:hi].tolist()).items():
            if (n := end - start + 1) >= max(least, exponent * period):
                found.add((lo + start, n, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, n, period in runs:
        edges[start + period] += 1
        edges[start + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def annotate(df: DataFrame, text_col: str = "text", out: str = "periodic", exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> DataFrame:
    """Append a struct ``out``: n_words, runs and the collapsed text, its words joined by single spaces."""

    def batch_fn():
        def annotated(texts):
            found = []
            for text in texts:
                words = text.split() if text else []  # of bytes: white space of ASCII alone
                runs = runs_of(words, exponent, least)
                found.append({"n_words": len(words), "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "collapsed": b" ".join(collapsed(words, runs))})
            return found

        return annotated

    return map_text(df, text_col, batch_fn, RUNS, out, binary=True)


def with_periods(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of which one in ten, by the id's crc32, repeats a block from some word on; null ids and texts stay."""
    h = F.crc32(F.col(f"`{id_col}`").cast("long").cast("string").cast("binary"))
    text = F.col(f"`{text_col}`")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        first = g % n
        period = 1 + F.floor((n - first) / (3 + g % 8))
        at = F.struct(first.alias("first"), period.alias("period"))
        word = lambda p: F.transform(words, lambda w, i: F.when(i >= p["first"], F.get(words, (p["first"] + (i - p["first"]) % p["period"]).cast("int"))).otherwise(w))
        return F.when(n > 0, let(at, lambda p: F.array_join(word(p), " "))).otherwise(text)

    return df.withColumn(text_col, F.when(h % 10 == 0, let(words, planted)).otherwise(text))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, one in ten of which is given a period, and digests of runs and collapsed texts."""
    docs = with_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = fresh(docs.columns, "periodic")
    found = annotate(docs, out=out)
    runs = F.col(f"{out}.runs")
    more = lambda a, r: r["length"] * a["period"] > a["length"] * r["period"]
    best = F.aggregate(runs, runs[0], lambda a, r: F.when(more(a, r), r).otherwise(a))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.when(F.size(runs) > 0, best).alias("best"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col(f"{out}.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def _oracle() -> str:
    """DuckDB: equal sequences of three words at one distance, next to each other, make a run."""
    digits = "list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda s: CAST('0x' || s AS BIGINT))"
    crc = f"xor(list_reduce({digits}, lambda c, v: xor(c >> 8, ({_crc_table()})[(xor(c, v) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
    return f"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, {crc} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sized AS (
  SELECT *, h // 10 % len(w) AS a, 1 + (len(w) - h // 10 % len(w)) // (3 + h // 10 % 8) AS p FROM split
), texts AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM sized
), grams AS (
  SELECT r, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g, len(w) AS n FROM texts, unnest(range(len(w) - 2)) AS t(i)
), equal AS (
  SELECT a.r, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.r = b.r AND a.g = b.g AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), marked AS (
  SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS stretch FROM equal
), long AS (
  SELECT r, q, min(i) AS s, count(*) + 2 + q AS n FROM marked GROUP BY r, q, stretch HAVING count(*) + 2 + q >= greatest({LEAST_LENGTH}, {LEAST_EXPONENT} * q)
), runs AS MATERIALIZED (
  SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.r = x.r AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.n >= x.s + x.n)
), per AS (
  SELECT r, count(*) AS n_runs, arg_min({{'s': s, 'n': n, 'q': q}}, {{'x': -CAST(n AS DOUBLE) / q, 's': s, 'q': q}}) AS best,
         string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r
), kept AS (
  SELECT r, string_agg(w[i + 1], ' ' ORDER BY i) AS words FROM texts JOIN per USING (r), unnest(range(len(w))) AS t(i)
  WHERE NOT EXISTS (SELECT 1 FROM runs x WHERE x.r = texts.r AND i >= x.s + x.q AND i < x.s + x.n) GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.n AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
       CAST(1000 * best.n // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(CASE WHEN n_runs IS NULL THEN array_to_string(w, ' ') ELSE coalesce(words, '') END) AS collapsed_sha256
FROM texts LEFT JOIN per USING (r) LEFT JOIN kept USING (r)
"""


ORACLE_SQL = _oracle()
