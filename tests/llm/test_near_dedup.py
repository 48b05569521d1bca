import random
from collections import defaultdict

import pytest

from typeloom.llm.near_dedup import NearDuplicates, op7, shingle_set


def brute(rows, num, den):
    sets = {}
    for i, (d, t) in enumerate(rows):
        w = [bytes(x) for x in (t or "").encode().lower().split()]
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        c = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < i:
                    c[j] += 1
        for j, n in c.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                up[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return sorted(((d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in op7(spark, sf).collect()]
    assert sorted((x[:3] for x in got), key=str) == brute(rows, 85, 100)
    assert all(x[3] == (x[0] == x[2]) for x in got)


def test_chains_pivots_and_hot_groups(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(150)]
    rows, d = [], 1000
    for step in range(60):  # a drifting chain: neighbours are near, ends are not
        base = list(base)
        base[(step * 37) % len(base)] = f"n{step}"
        rows.append((d + (step * 17) % 60, " ".join(base)))
    for k in range(40):  # a star of copies with one or two edits
        e = list(base)
        for _ in range(rng.randint(0, 3)):
            e[rng.randrange(len(e))] = rng.choice(vocab)
        rows.append((k, " ".join(e)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for t in ((85, 100), (80, 100)):
        got = [tuple(r) for r in NearDuplicates(threshold=t)(df).collect()]
        assert sorted(got, key=str) == brute(rows, *t)


def template_pages(n, common=170, own=30, seed=3):
    rng = random.Random(seed)
    frame = [f"t{i}" for i in range(common)]
    return [(i, " ".join(frame + [f"{rng.randrange(10**9)}" for _ in range(own)])) for i in range(n)]


def test_a_template_does_not_bring_all_pairs_together(spark, monkeypatch):
    counts = {"met": 0, "compared": 0}
    compare = NearDuplicates._compare

    def counted(self, met, sets, stages):
        counts["met"] += met.select(*(["id", "pid"])).distinct().count()
        put = stages.put

        def seen(df, label, large=True):
            out = put(df, label, large)
            counts["compared"] += out.count() if label == "possible" else 0
            return out

        monkeypatch.setattr(stages, "put", seen)
        out = compare(self, met, sets, stages)
        monkeypatch.setattr(stages, "put", put)
        return out

    monkeypatch.setattr(NearDuplicates, "_compare", counted)
    n = 1000
    rows = template_pages(n)
    rows += [(n + k, rows[0][1] + f" again{k}") for k in range(20)]  # near copies among them are still found
    got = [tuple(r) for r in NearDuplicates(threshold=(85, 100))(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert {g[0] for g in got if g[2] == 0} == {0, *range(n, n + 20)}
    assert all(g[0] == g[2] for g in got if 0 < g[0] < n)
    assert counts["met"] < 10 * n and counts["compared"] < n


def test_bound_of_common_shingles_is_never_too_low():
    import numpy as np

    from typeloom.llm.near_dedup import histogram, most_common, prefix_length

    rng = np.random.default_rng(9)
    for n, extra in ((1, 0), (7, 1), (200, 30), (1023, 2), (5000, 700)):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        t = np.unique(np.concatenate((s[extra:], rng.integers(0, 1 << 63, 2 * extra, dtype=np.uint64))))
        both = most_common(histogram(s), histogram(t))
        assert both >= len(np.intersect1d(s, t))
    assert histogram(np.arange(0, 512 * 300, 512, dtype=np.uint64)) == b"" and most_common(b"", histogram(s)) is None
    assert [int(prefix_length(np.int64(n), 85, 100)) for n in (1, 2, 7, 100)] == [1, 1, 2, 16]


def test_nulls_empty_ties_and_clashing_columns(spark):
    rows = [(1, None, 1, "x"), (2, "", 2, "x"), (3, " \t\n", 3, None), (4, "a b", 4, "x"), (5, "A B", 5, "x"), (5, "A B", 5, "x"), (None, "a b c d e f", 6, "x"), (None, None, 7, "x"), (9, "a b c d e f", 8, "x"), (8, "a b c d e", 9, "x"), (7, "x " * 30000, 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, cls string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in NearDuplicates()(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (None, 2, 9), (None, 0, None), (9, 2, 9), (8, 1, 8), (7, 1, 7)], key=str)
    assert NearDuplicates()(df.limit(0)).count() == 0


def test_short_sequences_do_not_meet_full_shingles():
    assert len(shingle_set("a b c d e")) == 1
    assert set(shingle_set("a b c d")) != set(shingle_set("a b c d e"))


@pytest.mark.parametrize("n", [1, 2, 8191, 8192, 8193])
def test_sketch_is_the_minimum_over_all_shingles(n):
    import numpy as np

    from typeloom.llm.near_dedup import MinHasher

    h = MinHasher(3, 2, 1)
    s = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    low = np.array([min((int(x) * int(m[0]) + int(a[0])) % (1 << 64) for x in s[:64]) for m, a in zip(h.mul, h.add)], np.uint64)
    if n <= 64:
        from typeloom.llm.common import mix

        out = h.salt
        for c in low.reshape(6, 2).T:
            out = mix(out, c)
        assert (out == h.sketch(s)).all()
    assert (h.sketch(s) == h.sketch(s[::-1])).all()
