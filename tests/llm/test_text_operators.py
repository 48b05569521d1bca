"""Language ID, licences, classifiers and rules: planted cases and odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from typeloom.llm import cotraining, language_id, license_scan, quality_rules
from typeloom.llm.cotraining import CoTraining, View, platt
from typeloom.llm.language_id import Compressors, LanguageId, decide
from typeloom.llm.license_scan import KNOWN, LicenseScan
from typeloom.llm.quality_rules import QualityRules, fit, posterior, text_stats

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "12345 !!"), (5, "one"), (5, "one"), (None, "a word"), (7, "x" * 100000), (8, "y z " * 30000), (9, "Ünï çødé text")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "en", "s", 3, "clash") for d, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, k string")


# language ---------------------------------------------------------------


def test_language_is_right_on_held_out_documents(spark, sf):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = language_id.op2(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_language_of_odd_rows(spark, odd):
    model = Compressors({"en": b"the cat sat on the mat and ran", "fr": "le chat était sur la table et".encode()}, 6, 1024, ["en", "fr"])
    got = LanguageId().predict(odd, model).collect()
    assert len(got) == len(ODD)
    by = Counter((r.c0, r.lang_pred, r.rejected) for r in got)
    for d in (1, 2, 3, 4):
        assert by[(d, "und", True)] == 1
    assert by[(5, "en", True)] == 2  # a tie goes to the first language, and is rejected
    assert LanguageId().predict(odd.limit(0), model).count() == 0
    none = LanguageId().fit(odd.where("false"))
    assert {r.lang_pred for r in LanguageId().predict(odd, none).collect()} == {"und"}


def test_long_texts_are_judged_by_all_their_pieces():
    model = Compressors({"a": b"alpha beta gamma delta " * 9, "b": b"uno dos tres cuatro " * 9}, 6, 64, ["a", "b"])
    text = "uno dos tres " * 10 + "alpha beta gamma delta " * 50
    assert decide(model, text, 0.01)[0] == "a"
    assert decide(model, text[::-1], 0.9)[2]


# licences ----------------------------------------------------------------


def test_known_texts_have_an_anchor_and_find_themselves(spark):
    assert all(re.search(license_scan.ANCHORS, t.lower()) for _, t in KNOWN)
    rows = [(i, f"Copyright (c) 20{i:02d} Someone\n\n{t.upper().replace(' ', '  ')}\n") for i, (_, t) in enumerate(KNOWN)]
    got = {r.doc_id: r for r in LicenseScan()(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, _) in enumerate(KNOWN):
        assert got[i].whole_license == name or name in got[i].licenses


def test_equivalent_spellings_lines_and_odd_rows(spark, odd):
    rows = [(1, "Some prose.\nLicenced under the Apache Licence - version 2.0\nMore."), (2, "Licensed under the Apache License, Version 2.0, with changes."), (3, "licensed under cc-by-nc 4.0"), (4, "a\nReleased under the MIT License.\nReleased under the MIT Licence\n")]
    got = {r.doc_id: (r.n_matches, r.licenses, r.whole_license) for r in LicenseScan()(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, "", None), 2: (0, "", None), 3: (1, "CC-BY-NC-4.0", "CC-BY-NC-4.0"), 4: (2, "MIT", None)} or got[4] == (2, "MIT", None)
    out = LicenseScan()(odd).collect()
    assert len(out) == len(ODD) and all(r.n_matches == 0 and r.licenses == "" for r in out)
    assert LicenseScan()(odd.limit(0)).count() == 0


def test_the_plan_is_native(spark, sf):
    plan = license_scan.op3(spark, sf)._jdf.queryExecution().executedPlan().toString()
    nodes = re.findall(r"^[\s:+|-]*(?:\*\(\d+\) )?([A-Za-z]+)", plan, re.M)  # names of operators, not what literals say
    assert len(nodes) > 3 and not any(re.search("Python|Pandas|Arrow", n) for n in nodes)
    assert "BroadcastHashJoin" in plan


# rules -------------------------------------------------------------------


def brute_stats(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    c = Counter(win)
    cover = {j for i, w in enumerate(win) if c[w] > 1 for j in range(i, i + 8)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(cover))


def test_statistics_equal_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if len(r.text) < 20000]
    for t in texts + [t for _, t in ODD if not t or len(t) < 20000] + ["a b c d e f g h " * 3 + "x", "l\nl\n l\n\n\nl"]:
        assert text_stats(t)[:5] == brute_stats(t)


def test_rules_query_finds_the_planted_junk(spark, sf):
    got = {r.doc_id: r for r in quality_rules.op8(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    for r in got.values():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    long = [x for x in labels if not got[x.doc_id].base_failed]
    assert sum(got[x.doc_id].kept == bool(x.quality) for x in long) >= 0.95 * len(long)


def test_rules_on_odd_rows(spark, odd):
    got = QualityRules()(odd).collect()
    assert len(got) == len(ODD) and all(r.base_failed for r in got)
    assert QualityRules()(odd.limit(0)).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    y = np.where(rng.random(20000) < 0.8, 1, -1)
    acc = np.array([0.95, 0.9, 0.8, 0.75, 0.85])
    votes = np.where(rng.random((20000, 5)) < acc, y[:, None], -y[:, None]) * (rng.random((20000, 5)) < 0.8)
    votes = np.concatenate([votes, np.ones((20000, 1), int)], axis=1)  # a rule that always votes good
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, found = fit(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.03
    assert np.abs(found[:5, 1, 2] - 0.8 * acc).max() < 0.04 and np.abs(found[:5, 0, 0] - 0.8 * acc).max() < 0.04
    assert abs(np.log(found[5, 1, 2] / found[5, 0, 2])) < 0.01
    assert ((posterior(votes, prior, found) > 0.5) == (y > 0)).mean() > 0.93


# co-training -------------------------------------------------------------


def test_cotraining_is_right_on_labels_it_never_saw(spark, sf):
    got = {r.doc_id: r for r in cotraining.op4(spark, sf).collect()}
    unseen = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sum(got[r.doc_id].kept == bool(r.quality) for r in unseen) >= 0.85 * len(unseen)


def test_cotraining_on_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = CoTraining()(odd, none).collect()
    assert len(got) == len(ODD) and all(abs(r.quality_prob - 0.5) < 1e-6 for r in got)
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, 1), (None, 1), (8, None), (9, 7)], "doc_id long, quality int")
    assert CoTraining()(odd, labels).count() == len(ODD)
    assert CoTraining()(odd.limit(0), labels).count() == 0


def test_platt_ignores_a_view_that_points_the_wrong_way():
    o = np.linspace(-3, 3, 200)
    y = (o > 0).astype(float)
    assert platt(o, y, np.ones(200), 0.0)[0] > 0
    assert platt(-o, y, np.ones(200), 0.0) == (0.0, 0.0)


def test_view_scores_follow_counts():
    c = np.zeros((2, 2, 16))
    c[0, :, 3] = 50
    c[1, :, 9] = 50
    v = View(c)
    odds = v.odds(np.array([[9, 9], [3, 3], [9, 3]]))
    assert odds[0] > 0 > odds[1] and abs(odds[2]) < 1e-9


def test_cotraining_keeps_sources_apart(spark):
    # these five had one hash bin: src4 is bad, the others are good, rare is in no label
    names = ["src4", "src10", "src12", "src13", "src15"]
    rows = [(i, "the same words of every text", "en", names[i % 5] if i < 1000 else "rare", 30) for i in range(1005)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(1000) if i % 2], "doc_id long, quality int")
    got = {r.doc_id: r.meta_prob for r in CoTraining()(df, labels).collect()}
    bad, good = max(got[i] for i in range(0, 1000, 5)), min(got[i] for i in range(1000) if i % 5)
    assert bad < 0.3 and good > 0.9
    assert all(bad < got[i] < good for i in range(1000, 1005))  # what was never learned says nothing


def test_long_licences_and_known_texts_without_anchors(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(want, open(f"/usr/share/common-licenses/{n}", encoding="utf-8").read()) for n, want in names.items()]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert all(r.whole_license == r.doc_id for r in LicenseScan()(df).collect())
    mine = spark.createDataFrame([("a", "Take it and run.\nreally"), ("b", "take it")], "doc_id string, text string")
    assert {r.doc_id: r.licenses for r in LicenseScan(known=(("mine", "take it, and run"),))(mine).collect()} == {"a": "mine", "b": ""}


def test_licences_are_found_by_row_whatever_the_key(spark):
    rows = [(1, "Released under the MIT License."), (1, "plain prose"), (None, "Released under the MIT License."), (None, None), (None, "Licensed under CC0 1.0.\nno\nLicensed under CC0 1.0.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = Counter(tuple(r) for r in LicenseScan()(df).collect())
    assert got == Counter([(1, 1, "MIT", "MIT"), (1, 0, "", None), (None, 1, "MIT", "MIT"), (None, 0, "", None), (None, 2, "CC0-1.0", None)])


def auc(scores, truth):
    order = np.argsort(scores, kind="stable")
    _, inverse, n = np.unique(np.array(scores)[order], return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[inverse]
    y = np.array(truth)[order]
    return (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_views_and_their_combination_rank_labels_they_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in cotraining.op4(spark, sf).collect()}
    unseen = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    truth = [r.quality for r in unseen]
    text, meta, both = (auc([got[r.doc_id][c] for r in unseen], truth) for c in ("text_prob", "meta_prob", "quality_prob"))
    print(text, meta, both)
    assert text >= 0.95 and both >= 0.95 and meta >= 0.4


def test_many_values_are_joined_in_parts_with_the_same_result(spark, monkeypatch):
    rows = [(i, f"some words {i % 7} of a text", None if i % 11 == 0 else "en", f"s{i % 9}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 9 != 0)) for i in range(0, 400, 2)], "doc_id long, quality int")
    few = {r.doc_id: r.meta_prob for r in CoTraining()(df, labels).collect()}
    monkeypatch.setattr(cotraining, "BROADCAST_VALUES", 0)
    many = {r.doc_id: r.meta_prob for r in CoTraining()(df, labels).collect()}
    assert len(many) == 400 and all(abs(few[i] - many[i]) < 1e-9 for i in few)


def test_words_decide_where_texts_look_alike(spark):
    rng = np.random.default_rng(4)
    good, bad, plain = ([f"{c}{i:03d}" for i in range(60)] for c in "gbp")
    rows, labels = [], []
    for i in range(600):
        own = good if i % 2 else bad
        rows.append((i, " ".join(rng.choice(own + plain, 40)), "en", f"s{rng.integers(5)}"))
        if i < 400:
            labels.append((i, i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in CoTraining()(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert sum((got[i].text_prob > 0.5) == bool(i % 2) for i in range(400, 600)) >= 195


def test_quality_counts_letters_of_all_scripts_and_variety_of_any_length():
    names = quality_rules.STATS
    s = dict(zip(names, text_stats("Ünï – 日本。 🙂 A1")))
    assert (s["n_letters"], s["n_upper"], s["n_digits"]) == (6, 2, 1)
    words = [f"w{i}" for i in range(90)]
    for n in (90, 9000, 90000):
        s = dict(zip(names, text_stats(" ".join(words[i % 90] for i in range(n)))))
        assert 0.85 <= s["n_varied"] / n <= 1
    h = np.array([1, 2, 2, 3, 1, 1, 1], np.uint64)
    assert quality_rules.varied_words(h, 3) == 2 + 2 + 1


def test_a_language_of_short_texts_is_learned_and_copies_count_once(spark):
    rows = [(i, f"uno dos tres {i % 9}", "es") for i in range(60)] + [(100 + i, "the one and the same", "en") for i in range(500)] + [(700, "alpha and beta with gamma", "en")]
    model = LanguageId(per_language=2).fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.order) == {"en", "es"}
    assert model.dictionaries["en"].decode().split("\n").count("the one and the same") == 1 and b"alpha" in model.dictionaries["en"]
