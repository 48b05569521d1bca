"""The pipeline against a brute-force version, stage by stage."""

import numpy as np

import corpus_pipeline
from tests.llm.test_formats import check_packing
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_substring_dedup import brute as substring_brute
from typeloom.llm.language_id import LanguageId, decide, learnable
from typeloom.llm.quality_rules import QualityRules, posterior, text_stats


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept, tables = set(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert after.columns == columns and after.dtypes == spark.read.parquet(f"{sf}/documents.parquet").dtypes
        tables[name] = {r.doc_id: r for r in after.collect()} if name != "packing" else after.collect()
        if name == "language":
            op = LanguageId()
            model = op.fit(learnable(docs))
            kept = {d for d, r in rows.items() if not decide(model, r.text, op.margin)[2]}
            assert set(tables[name]) == kept and len(kept) > 0.9 * len(rows)
        elif name == "quality":
            stats = QualityRules().stats(docs)
            prior, acc = QualityRules().fit(stats)
            good = {r.k: r.kept for r in QualityRules().score(stats, prior, acc).collect()}
            kept = {d for d in kept if good[d]}
            assert set(tables[name]) == kept
            assert all(text_stats(rows[d].text)[0] >= 20 for d in kept)
        elif name == "near_dedup":
            groups = near_brute([(d, rows[d].text) for d in kept], 80, 100)
            kept = {d for d, _, c in groups if d == c}
            assert set(tables[name]) == kept
        elif name == "substring_dedup":
            import hashlib

            want = {d: (n, k, h) for d, n, k, h in substring_brute([(d, rows[d].text) for d in kept])}
            kept = {d for d in kept if want[d][0] > want[d][1]}
            assert set(tables[name]) == kept
            for d in kept:
                text = tables[name][d].text
                assert text == rows[d].text if want[d][1] == 0 else hashlib.sha256(text.encode()).hexdigest() == want[d][2]
                assert tables[name][d].n_chars == len(text)
            before = tables[name]
        else:
            used, least = check_packing(tables[name], [(d, r.text) for d, r in before.items()])
            assert used <= least + max(2, least // 50)
        docs = after


def test_stages_on_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "words " * 30, "en", "s", 5), (3, "a", "en", None, 1), (3, "a", "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, "")
            if name != "packing":
                assert out.columns == odd.columns
            out.collect()


def test_near_keeps_one_row_of_each_group_whatever_the_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(None, a), (None, a + " more"), (4, a), (4, b), (4, b), (3, b + " more"), (None, "alone in the world with null"), (None, None), (None, None), (9, ""), (9, "")]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near(spark, df, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(4, a), (3, b + " more"), (None, "alone in the world with null"), (None, None), (9, "")], key=str)


def test_posterior_is_a_probability():
    p = posterior(np.array([[1, -1]]), 0.5, np.array([[[0.3, 0.2, 0.5], [0.1, 0.1, 0.8]]] * 2))
    assert 0 < p[0] < 1
