"""Personal data: base spans against the contract's patterns, what the model may add, redaction."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import pii as P

DOCS = "doc_id long, text string"


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    """Start, kind and end by the plain patterns, failing matches dropped."""
    text, found = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return [f"{P.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def check(rows, texts):
    for r in rows:
        want, spans = base_spans(texts[r.doc_id]), r.spans.split(",") if r.spans else []
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in P.KINDS[:4]], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        added = [s for s in spans if s not in want]
        assert [s for s in spans if s in want] == want
        places = [tuple(map(int, s.split(":")[1:])) for s in want]
        assert all(not (int(s.split(":")[1]) < b and a < int(s.split(":")[2])) for s in added for a, b in places)
        order = [(int(s.split(":")[1]), P.KINDS.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)


def test_query_on_whole_documents(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = P.op10_pii(spark, small).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_query_on_made_up_documents(spark, tmp_path):
    rng = random.Random(9)
    pieces = ["a", "Z9", "@", ".", "-", "%", "x@y.z", "12", "255", "256", "1.2.3.4", "4111111111111111", "5500 0000-0000 0004", "0", " ", "+", "(", ")", "+1 (555) 010-9999", "é", "日本", "\n", "007", "_", "😀", "x" * 70, "phone: ", "555-010-1234", "123-45-6789", "GB82 WEST 1234 5698 7654 32"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += [None, "", "1." * 3000, "1" * 5000, "9999999999999999999999.1.1.1", "a@b" * 2000, "+1" * 2000, "mail a@b.c " * 3000, "٣٣٣.1.1.1", "1.2.3.4.5.6.7.8.9", "a@b.c%d@e.f@g.h.i"]
    spark.createDataFrame(list(enumerate(texts)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    check(P.op10_pii(spark, str(tmp_path)).collect(), dict(enumerate(texts)))


def test_redaction(spark):
    rows = [(1, "Ring +1 555 010 9999 or mail é.x a.b@c.de, 10.0.0.1!", "k"), (2, None, "k"), (3, "", "k"), (4, "clean text 12 34", "k"), (4, "clean text 12 34", "k"), (None, "card 4111 1111 1111 1111", "k")]
    got = {(r.doc_id, r.cands, r.text) for r in P.redact(spark.createDataFrame(rows, f"{DOCS}, cands string")).collect()}
    assert got == {(1, "k", "Ring <phone> or mail é.x <email>, <ip>!"), (2, "k", None), (3, "k", ""), (4, "k", "clean text 12 34"), (None, "k", "card <card>")}


def test_boosted_trees_as_columns(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.unique(np.stack([rng.integers(0, n, 300) for n in P.LEVELS], axis=1), axis=0)
    good = ((x[:, 1] > 3) & (x[:, 5] < 2)).astype(float) * 20
    model = P.fit(x, good, 20 - good)
    margin = model.margin(x)
    assert ((margin > 0) == (good > 0)).mean() > 0.95
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<int>").select(model.column(F.col("x")).alias("z"))
    assert np.allclose(sorted(r.z for r in df.collect()), sorted(margin))


def test_empty_table_and_main_path(spark, tmp_path, small):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.op10_pii(spark, str(tmp_path)).count() == 0
    plan = P.op10_pii(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_spans_of_a_document_do_not_depend_on_the_corpus(spark, tmp_path):
    planted = "SSN: 123-45-6789, then Tel 555-010-1234, then GB82 WEST 1234 5698 7654 32"
    spans = {f"{k}:{planted.index(x)}:{planted.index(x) + len(x)}" for k, x in (("identity", "123-45-6789"), ("local_phone", "555-010-1234"), ("account", "GB82 WEST 1234 5698 7654 32"))}
    others = [f"part 555-{i % 900 + 100}-{i:04d} or 123-45-{i:04d} and GB82 WEST 1234 5698 {i:04d} 33" for i in range(1, 1500)]
    for name, texts in (("small", [planted]), ("large", [planted, *others])):
        spark.createDataFrame(list(enumerate(texts)), DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        row = P.op10_pii(spark, f"{tmp_path}/{name}").where("doc_id = 0").first()
        assert set(row.spans.split(",")) == spans, name


def planted(rng, n):
    """Texts with local phone numbers, identity numbers and accounts, some behind telling words, and numbers like them.

    Returns texts and, for each, the spans that are personal data.
    """
    words = ["red", "stone", "walks", "over", "lamps", "and", "quiet", "rivers"]
    filler = lambda k: " ".join(rng.choice(words) for _ in range(k))
    texts, true = [], []
    for i in range(n):
        number = f"{rng.randint(2, 9)}{rng.randint(0, 99):02d}-{rng.randint(2, 9)}{rng.randint(0, 99):02d}-{rng.randint(0, 9999):04d}"
        lot = f"{rng.choice('01')}{rng.randint(0, 99):02d}-{rng.randint(0, 999):03d}-{rng.randint(0, 9999):04d}"
        body = f"{filler(6)} lot {lot} {filler(20)}"
        if rng.random() < 0.7:  # a contact line: the mail address is near, the telling word only sometimes there
            told = rng.choice(["Tel ", "phone: ", "call ", "", ""]) if rng.random() < 0.95 else ""
            line = f"{rng.choice(words)}.{i}@mail.example | {told}{number}"
            texts.append(f"{body}\n{line}\n{filler(9)}")
            true.append({(texts[-1].index(number), texts[-1].index(number) + len(number))})
        else:
            texts.append(f"{body} {filler(8)}")
            true.append(set())
    return texts, true


def test_the_model_adds_what_no_validator_passes(spark, tmp_path):
    """Numbers without a telling word in contact lines are found, lot numbers in running text are left alone."""
    texts, true = planted(random.Random(4), 1200)
    spark.createDataFrame(list(enumerate(texts)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = P.op10_pii(spark, str(tmp_path)).collect()
    check(rows, dict(enumerate(texts)))
    right = found = wanted = untold = 0
    for r in rows:
        got = {tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("local_phone")}
        right, found, wanted = right + len(got & true[r.doc_id]), found + len(got), wanted + len(true[r.doc_id])
        untold += sum(not re.search(P.HINT, texts[r.doc_id][max(0, a - P.CONTEXT) : a]) for a, _ in got)
    assert right >= 0.95 * found and right >= 0.95 * wanted and untold > 100


def test_a_kind_without_evidence_gets_nothing(spark, tmp_path):
    """Numbers that no telling word and no context sets apart stay, however many there are."""
    rng = random.Random(6)
    texts = [f"part {rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(0, 9999):04d} is in stock" for _ in range(400)]
    spark.createDataFrame(list(enumerate(texts)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert all(r.spans == "" for r in P.op10_pii(spark, str(tmp_path)).collect())


def test_redaction_of_very_long_texts(spark):
    text = "quiet words here " * 40_000 + "a.b@c.de" + " 10.0.0.1" * 2000 + " é"
    df = spark.createDataFrame([(1, text, 5, True)], f"{DOCS}, cands int, left_out boolean")
    row = P.redact(df).first()
    assert row.text == "quiet words here " * 40_000 + "<email>" + " <ip>" * 2000 + " é" and (row.cands, row.left_out) == (5, True)


def test_copies_of_a_text_are_in_one_fold(spark):
    df = spark.createDataFrame([(i % 40, f"text {i % 40}") for i in range(200)] + [(99, None)], DOCS)
    sides = df.select("doc_id", P.fold_of(F.col("text")).alias("out")).distinct().collect()
    assert len(sides) == 41 and {r.out for r in sides} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 5, 20, 60, 300, 3000])
def test_an_untold_number_is_found_or_left_at_any_size(spark, tmp_path, n):
    """What a document gets does not depend on how many others there are, with what validators pass and without."""
    contact = "red.stone@mail.example | 412-555-0199 and quiet rivers"
    plain = "the part 412-555-0199 is in stock"
    failing = "paid with 4111 1111 1111 1112 at the door"
    texts, _ = planted(random.Random(n), n)
    spark.createDataFrame(list(enumerate([contact, plain, failing, *texts])), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.spans for r in P.op10_pii(spark, str(tmp_path)).where("doc_id < 3").collect()}
    at = contact.index("412")
    assert rows == {0: f"email:0:22,local_phone:{at}:{at + 12}", 1: "", 2: ""}


def test_thresholds_by_hand():
    at = lambda scores, good, bad: P.threshold(np.array(scores, float), np.array(good, float), np.array(bad, float), 0.5)
    assert at([], [], []) == 0.0  # the odds of the share
    assert at([2.0, -1.0], [3, 0], [0, 3]) == 0.0
    assert at([2.0, 0.4, -1.0], [3, 0, 0], [0, 40, 3]) == np.nextafter(0.4, 1)  # data speak against the middle one
    assert at([2.0, -0.4, -1.0], [3, 40, 0], [0, 0, 3]) == -0.4  # and for it
    assert at([2.0], [0], [100]) > 2.0
    # what is far below does not ride along with many good ones above
    assert at([2.0, -3.0], [1000, 0], [0, 1]) == 0.0
    for n in range(30):  # each further candidate that is none moves a level's share a little, until it falls below
        assert (at([0.5], [0], [n]) <= 0.5) == (P.DOUBT / (1 + np.exp(-0.5)) >= 0.5 * (n + P.DOUBT))
