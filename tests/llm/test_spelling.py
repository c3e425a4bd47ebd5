"""Spelling variants: pairs against every pair by hand, forms and roots by hand, the query against its SQL."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

from compare import assert_same

from tidebook.llm import spelling as S


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(counts: dict[str, int], ratio=10):
    """(word, n, n_near, form, form_n, root) of every word, from all pairs."""
    beside = {w: [o for o in counts if near(w, o)] for w in counts}
    forms = {}
    for w, others in beside.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return sorted((w, n, len(beside[w]), forms[w], counts.get(forms[w]), root(w)) for w, n in counts.items())


def rows(df):
    return sorted(map(tuple, df.select("word", "n", "n_near", "form", "form_n", "root").collect()))


def vocabulary(seed, n, letters="abé", lengths=(7, 9), most=3000):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))): int(10 ** rng.uniform(0.3, 5)) % most + 2 for _ in range(n)}


def test_variants_equal_those_by_hand(spark):
    for seed, n, letters in ((1, 150, "abé"), (2, 250, "ab"), (3, 200, "aßþ×z")):
        words = vocabulary(seed, n, letters)
        assert rows(S.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == by_hand(words)


def test_every_pair_comes_once_each_way(spark):
    words = {"aaaaaaa": 5, "aaaaaaaa": 6, "aaaaaab": 7, "baaaaaa": 8, "aaabaaa": 9, "aabaaaaa": 4, "abababa": 2, "bababab": 2}
    found = [(r.word, r.other) for r in S.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long")).collect()]
    assert sorted(found) == sorted((a, b) for a, b in itertools.product(words, words) if near(a, b))


def test_anagrams_are_not_near(spark):
    words = {"".join(p): 2 for p in itertools.islice(itertools.permutations("abcdefg"), 0, 5040, 7)}
    found = S.near_pairs(spark.createDataFrame([*words.items(), ("abcdefgh", 3)], "word string, n long"))
    assert {(r.word, r.other) for r in found.collect()} == {("abcdefg", "abcdefgh"), ("abcdefgh", "abcdefg")}


def test_forms_lead_on(spark):
    words = {"lettera": 2, "letterab": 20, "letterabc": 200, "letterabcd": 2000, "letterabcde": 20_000, "letterabcdef": 199_999, "apart__": 1}
    del words["apart__"]
    got = {r[0]: (r[3], r[5]) for r in rows(S.variants(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert got["lettera"] == ("letterab", "letterabcde") and got["letterabcde"] == (None, "letterabcde")


def test_ties_go_to_the_smallest_word(spark):
    words = {"wordsaa": 2, "wordsab": 20, "wordsac": 20, "Àordsaa": 20}
    got = {r[0]: r[3] for r in rows(S.variants(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert got["wordsaa"] == "wordsab"


def words_by_hand(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def query_of(spark, folder, docs):
    spark.createDataFrame(docs, "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return S.op12_spelling(spark, str(folder))


def test_query_equals_sql(spark, small, sql):
    assert_same(S.op12_spelling(spark, small), sql, S.ORACLE_SQL)


def test_query_equals_hand(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    known = [*vocabulary(7, 60, "abÀé"), "Überschrift", "überschrift", "x" * 3000, "short"]
    docs = [(i, " ".join(rng.choice(known) for _ in range(40)) + ", A1b2c3 " + rng.choice(known).upper()) for i in range(120)]
    docs += [(None, "Überschrift überschrift " * 30), (5, None), (6, ""), (7, "1234 !!"), (7, "doubled doubled"), (7, "doubled doubled"), (-1, "naïveté " * 50)]
    want = by_hand(words_by_hand(docs))
    assert rows(query_of(spark, tmp_path, docs)) == want
    monkeypatch.setattr(S, "TASK_WORDS", 3)
    assert rows(S.op12_spelling(spark, str(tmp_path))) == want
    assert rows(query_of(spark, tmp_path / "none", [])) == []


def test_columns_of_the_table_do_not_clash(spark):
    df = spark.createDataFrame([(1, "Certain certain words", "w", 3, 4)], "doc_id long, text string, word string, n int, key int")
    assert [tuple(r) for r in S.count_words(df).collect()] == [("certain", 2)]


def test_entries_are_shuffled_once(spark):
    """Both sides of the join read one exchange of the entries."""
    words = spark.createDataFrame([(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}xx", 2) for i in range(600)], "word string, n long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = S.near_pairs(words)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ReusedExchange") >= 1
