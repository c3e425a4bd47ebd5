"""The pipeline: what each stage keeps, changes and returns."""

from __future__ import annotations

import itertools

import corpus_pipeline as C
import pytest

from tidebook.llm import decontamination, pii, quality, simhash
from tidebook.llm import queries as registry


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """Input and output of every stage, written and read again."""
    docs, found = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, small).write.parquet(path)
        found[name] = (docs, spark.read.parquet(path))
        docs = found[name][1]
    return found


def test_names_and_columns(stages, spark, small):
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    columns = spark.read.parquet(f"{small}/documents.parquet").columns
    assert all(out.columns == columns for name, (_, out) in stages.items() if name != "packing")


def test_quality_keeps_what_scores_well(stages, spark, small):
    docs, out = stages["quality"]
    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    kept = {r.doc_id for r in quality.annotate(docs, model).collect() if r.quality_score.score >= quality.THRESHOLD}
    assert {r.doc_id for r in out.collect()} == kept and 0 < len(kept) < docs.count()


def test_one_of_each_group_of_near_copies_stays(stages):
    """Against all pairs of texts by the Jaccard similarity of their 5-word shingles."""
    docs, out = stages["near_duplicates"]
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text.encode() if r.text else None, 5)) for r in docs.collect()}
    lowest = {d: d for d in sets}

    def find(d):
        while lowest[d] != d:
            d = lowest[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (not x or len(x & y) >= 0.8 * len(x | y)):
            a, b = find(a), find(b)
            lowest[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d in sets if lowest[d] == d)


def test_contaminated_documents_go(stages, spark, small):
    docs, out = stages["decontamination"]
    found = decontamination.annotate(docs, spark.read.parquet(f"{small}/benchmark.parquet"))
    clean = {r.doc_id for r in found.collect() if r.contamination.n_hit == 0}
    assert {r.doc_id for r in out.collect()} == clean


def test_personal_data_is_replaced(stages):
    docs, out = stages["personal_data"]
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, out))
    assert before.keys() == after.keys()
    left = out.select(pii.candidates(out.text).alias("c")).selectExpr("explode(c) AS c").where("c.valid AND c.kind < 4").count()
    assert left == 0
    assert any("<email>" in (t or "") for t in after.values())
    assert sum(before[k] == after[k] for k in before) > 0


def test_packing_holds_every_document(stages):
    docs, out = stages["packing"]
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}


def test_run_equals_the_stages(stages, spark, small):
    pieces = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert pieces(C.run(spark, small)) == pieces(stages["packing"][1])


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_empty_and_odd_tables(spark, small, name):
    stage = dict(C.STAGES)[name]
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    assert stage(spark, docs, small).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None, 1.0), (1, "", "en", "s", 0, 2.0), (1, "", "en", "s", 0, 2.0)], "doc_id long, text string, lang string, source string, n_chars long, quality_score double")
    rows = stage(spark, odd, small).collect()
    if name == "personal_data":
        assert len(rows) == 3 and all(r.quality_score for r in rows)
    if name == "packing":
        assert len(rows) == 3


def test_registry():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)
