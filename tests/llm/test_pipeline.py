from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import language_id, packing, quality, secret_scan
from spanloom.llm.common import stored
from spanloom.llm.wordpiece_cache import ids_of

from .test_documents import FIELDS, ODD, SCHEMA, WORDS, base_counts, check_packing, slow_base


@pytest.fixture(scope="module")
def stages(spark, small):
    """Each stage's input and output, as the pipeline runs them."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, small)
        after = stored(got)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_and_columns(stages):
    assert [n for n, _, _ in stages] == ["language_id", "quality_rules", "near_duplicates", "secret_scan", "packing"]
    for _, before, after in stages[:-1]:
        assert after.schema == before.schema and after.count() <= before.count()
        assert after.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0


def test_language_stage(stages):
    _, before, after = stages[0]
    model = language_id.train(before.where(~language_id.held_out()))
    keep = [r for r in before.collect() if (p := model.predict(r.text))[0] != "und" and p[1] >= 0.5]
    assert Counter(after.collect()) == Counter(keep)


def test_quality_stage(stages):
    _, before, after = stages[1]
    verdicts = {r.doc_id: r.kept for r in quality.judged(before).collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert verdicts[r.doc_id] and not base_counts(texts[r.doc_id])[-1]
        assert set(r.text.split("\n")) <= set(texts[r.doc_id].split("\n"))
    assert {r.doc_id for r in after.collect()} == {d for d, ok in verdicts.items() if ok}


def test_duplicate_stage(stages):
    _, before, after = stages[2]
    docs = sorted((r.doc_id, r.text) for r in before.collect())
    words = [[c.lower() if c.isascii() else c for c in WORDS.findall(t or "")] for _, t in docs]
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    group = list(range(len(docs)))
    for i, a in enumerate(grams):
        for j in range(i):
            if group[i] != group[j] and len(a & grams[j]) >= 0.8 * len(a | grams[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert sorted(r.doc_id for r in after.collect()) == sorted({docs[g][0] for g in group})


def test_secret_stage(stages):
    _, before, after = stages[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    got = {r.doc_id: r.text for r in after.collect()}
    assert set(got) == set(texts)
    for doc_id, text in texts.items():
        base = slow_base(text)
        assert base or got[doc_id] == text or "<secret>" in got[doc_id]
        for kind, a, b in base:
            value = secret_scan.ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]
            assert value not in got[doc_id]


def test_packing_stage(stages):
    _, before, after = stages[4]
    rows = [tuple(r[c] for c in FIELDS) for r in after.collect()]
    n = check_packing(rows, [(r.doc_id, r.text) for r in before.collect()], ids_of(packing.default_vocabulary()))
    assert n <= -(-sum(r[3] for r in rows) // 2048) + 1


def test_run_gives_the_last_stage(spark, small, stages):
    got = Counter(tuple(r[c] for c in FIELDS[:5]) for r in corpus_pipeline.run(spark, small).collect())
    assert got == Counter(tuple(r[c] for c in FIELDS[:5]) for r in stages[-1][2].collect())


def test_odd_and_empty_documents(spark, tmp_path):
    for name, rows in (("odd", ODD), ("none", [])):
        docs = spark.createDataFrame(rows, SCHEMA)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == list(FIELDS) and (name == "odd" or out.count() == 0)


def test_stages_keep_the_callers_columns(spark, small):
    """Columns that bear the names of what the stages compute pass through them as they are."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    mine = {c: F.lit(f"my {c}") for c in ("score", "LANG_PRED", "kept", "n_words", "clean_text", "lost_chars", "__words", "__lines", "__some", "__judged_kept", "__lang_pred", "__doc_id", "__n", "secrets", "fp", "copy", "root")}
    docs = stored(docs.withColumns(mine))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, small))
        assert docs.count() > 0 and docs.columns[-len(mine) :] == list(mine)
        assert docs.select(*mine).distinct().collect() == [tuple(f"my {c}" for c in mine)]
