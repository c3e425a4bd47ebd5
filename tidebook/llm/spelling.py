"""Spelling variants of words: words that differ by one letter, and the far more frequent word that each is a form of.

A word's anagram key is the sum of a power of each of its letters, whatever their order.  Two words one letter apart have
keys that differ by the value of the letter added or removed, or by that of an exchange.  So every word is entered
under its own key and under its key less each of its letters: what is added or removed meets a whole word there, what is
exchanged meets the other word less the other letter.  Entries are joined on key and a checksum of the order of the letters
that are left, as anagrams of frequent letters would else meet by the thousand, and the letters' order is then compared
itself.  A pair of words meets once only: an exchange at its place, a letter out of several equal ones at the first.
A place in the join holds at most the words that one letter more can make, so no group grows with the input.

A word's form is its near word with the most occurrences, if it has ``RATIO`` times the word's own at least.  Forms
lead on to further forms; as occurrences grow tenfold each time, the way to the last one is short and is halved in each round.

Defined cases: null and empty texts have no words; repeated rows and ids count each time; a null id counts as an empty one in
the checksum that misspells words; other columns are ignored, whatever their names; an empty table gives no rows.  Words
of any length are handled; a word of n letters makes n + 1 entries.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import shared_checkpoint, table
from tidebook.llm.sharding import _crc_table

#: Shortest words, fewest occurrences, and how much more frequent a form is.
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: Power of a letter's code point in its word's key.
POWER = 5
#: Different words that a task counts before it hands them on.
TASK_WORDS = 400_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

COUNTS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
ENTRY = T.StructType([T.StructField("key", T.LongType()), T.StructField("at", T.IntegerType()), *COUNTS.fields])

#: Changes a word of a text, given the text's id and the word.
Change = Callable[[int | None, str], str]


def misspelt(doc_id: int | None, word: str) -> str:
    """The word without one letter, if 31 divides the crc32 of id and word."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, change: Change | None = None) -> DataFrame:
    """(word, n): occurrences of all words of so many letters, in lower case (of ASCII letters alone), changed if asked for."""

    def run(batches):
        import pyarrow as pa

        total: Counter[str] = Counter()

        def handed():
            return pa.RecordBatch.from_arrays([pa.array(total, pa.string()), pa.array(total.values(), pa.int64())], names=COUNTS.names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                here: Counter[str] = Counter()
                for word, n in Counter(_RUN.findall(text.as_py() or "")).items():
                    if len(word) >= least_letters:
                        here[word.lower() if word.isascii() else word.translate(_LOWER)] += n
                if change is None:
                    total.update(here)
                    continue
                for word, n in here.items():
                    word = change(doc, word)
                    if len(word) >= least_letters:
                        total[word] += n
                if len(total) > TASK_WORDS:
                    yield handed()
                    total.clear()
        yield handed()

    read = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return read.mapInArrow(run, COUNTS).groupBy("word").agg(F.sum("n").alias("n"))


def _entries(words: DataFrame) -> DataFrame:
    """Every word under its key (at -1) and, for each place, under its key less that letter (at 2 * place, or one more if the
    letter before is the same)."""

    def run(batches):
        import pyarrow as pa

        values = {c: c**POWER for c in range(256)}
        crc = zlib.crc32
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first in range(0, len(words), 2000):
                keys, ats, which = [], [], []
                for k, word in enumerate(words[first : first + 2000], first):
                    raw = word.encode("latin-1")
                    whole = sum(map(values.__getitem__, raw))
                    keys.append((whole, crc(raw)))
                    ats.append(-1)
                    before, begun = -1, 0
                    for i, c in enumerate(raw):
                        keys.append((whole - values[c], crc(raw[i + 1 :], begun)))
                        ats.append(2 * i + (c == before))
                        before, begun = c, crc(raw[i : i + 1], begun)
                    which += [k] * (len(raw) + 1)
                # the anagram key in the upper bits, folded, the checksum of the order in the lower
                joined = [((a % 0x7FFFFFFF) << 32) | order for a, order in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(joined, pa.int64()), pa.array(ats, pa.int32()), pa.array([words[k] for k in which], pa.string()), pa.array([counts[k] for k in which], pa.int64())],
                    names=ENTRY.names,
                )

    return words.select("word", "n").mapInArrow(run, ENTRY)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words one letter apart, both ways round.

    ``words`` has one row a word, of letters up to U+00FF, and its occurrences.
    """
    entries = _entries(words)
    a, b = entries.alias("a"), entries.alias("b")
    one, two = F.col("a.at"), F.col("b.at")

    def rest(side: str):
        word, place = F.col(f"{side}.word"), F.shiftright(f"{side}.at", 1)
        return F.concat(F.substr(word, F.lit(1), place), F.substr(word, place + 2))

    added = (one == -1) & (two >= 0) & (two % 2 == 0)
    exchanged = (one >= 0) & (F.shiftright(one, 1) == F.shiftright(two, 1)) & (F.col("a.word") < F.col("b.word"))
    # one expression, of which no part moves below the join, so that both sides read one exchange of the entries
    same = F.when(added, F.col("a.word") == rest("b")).when(exchanged, rest("a") == rest("b")).otherwise(False)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & same)
    ways = F.array(
        *[
            F.struct(F.col(f"{x}.word").alias("word"), F.col(f"{x}.n").alias("n"), F.col(f"{y}.word").alias("other"), F.col(f"{y}.n").alias("other_n"))
            for x, y in ("ab", "ba")
        ]
    )
    return met.select(F.inline(ways))


def _last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where following ``form`` from each word ends, half of the way in each round."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # a row that has moved on to a last form does not match any more
        moved = shared_checkpoint(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row (word, n) of a table of distinct words."""
    most = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), most.alias("most"))
    is_form = -F.col("most.less") >= ratio * F.col("n")
    known = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("most.form")).alias("form"),
        F.when(is_form, -F.col("most.less")).alias("form_n"),
    )
    known = shared_checkpoint(known)
    roots = _last_forms(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all words of documents, some of which are misspelt."""
    counts = count_words(table(spark, sf_dir, "documents"), change=misspelt)
    words = shared_checkpoint(counts.where(F.col("n") >= LEAST_COUNT))
    return variants(words).select("word", "n", "n_near", "form", "form_n", "root")


def _oracle() -> str:
    """DuckDB: words joined on what is left of them without one letter."""
    digits = "list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)), '..'), lambda s: CAST('0x' || s AS BIGINT))"
    crc = f"xor(list_reduce({digits}, lambda c, v: xor(c >> 8, ({_crc_table()})[(xor(c, v) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents
), here AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM split WHERE length(w) >= {LEAST_LETTERS} GROUP BY ALL
), hashed AS (
  SELECT w, n, {crc} AS h FROM here
), words AS MATERIALIZED (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST_LETTERS} AND sum(n) >= {LEAST_COUNT}
), less AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) AS t(i)
), near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT x.word, x.n, count(near.other) AS n_near, arg_min({{'word': o.word, 'n': o.n}}, {{'less': -o.n, 'word': o.word}}) AS top
  FROM words x LEFT JOIN near ON near.word = x.word LEFT JOIN words o ON o.word = near.other GROUP BY ALL
), forms AS MATERIALIZED (
  SELECT word, n, n_near, CASE WHEN top.n >= {RATIO} * n THEN top.word END AS form, CASE WHEN top.n >= {RATIO} * n THEN top.n END AS form_n FROM best
), walk AS (
  SELECT word, word AS root FROM forms UNION SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL
)
SELECT f.word, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form, CAST(f.form_n AS BIGINT) AS form_n, walk.root
FROM forms f JOIN walk ON walk.word = f.word JOIN forms e ON e.word = walk.root AND e.form IS NULL
"""


ORACLE_SQL = _oracle()
