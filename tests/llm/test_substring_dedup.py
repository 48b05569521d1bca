import hashlib
import random
from collections import Counter

import numpy as np

from typeloom.llm.substring_dedup import Blocks, SubstringDedup, factors, matches, op10, packed, unpacked


def brute(rows, window=35):
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in docs for i in range(len(w) - window + 1))
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(r[2] for r in want) > 0
    assert sorted((tuple(r) for r in op10(spark, sf).collect()), key=str) == want


def test_removal_keeps_other_columns_and_handles_odd_rows(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(50)) for _ in range(n))
    p, q = line(35), line(36)
    texts = [None, "", "  \n", "one", p, f"{line(9)} {p}\n{line(50)}", f"{line(4)} {p} {p}", q, f"{q} {line(3)}", f"{line(3)} {q[: q.rindex(' ')]} {line(40)}", "same " * 36, "other " * 35, line(5000), "x" * 200000, "y z " * 40]
    texts += [texts[4], texts[12]]
    rows = [(i // 2, t, f"k{i}", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "rid long, text string, at string, lo int")
    got = SubstringDedup().remove(df)
    assert got.columns == df.columns
    by = {r.lo: r for r in got.collect()}
    assert len(by) == len(texts) and all(by[i].at == f"k{i}" and by[i].rid == i // 2 for i in by)
    want = {d: (n, k, h) for d, n, k, h in brute([(i, t) for i, t in enumerate(texts)])}
    for i, t in enumerate(texts):
        if want[i][1] == 0:
            assert by[i].text == t
        else:
            assert hashlib.sha256(by[i].text.encode()).hexdigest() == want[i][2]
    assert SubstringDedup().remove(df.limit(0)).count() == 0


def test_random_small_vocabulary_equals_brute_force(spark):
    rng = random.Random(11)
    pieces = [[rng.choice("abc") for _ in range(rng.randint(1, 12))] for _ in range(6)]
    rows = [(i, " ".join(x for _ in range(rng.randint(0, 12)) for x in rng.choice(pieces))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window, gram in ((6, 3), (9, 4)):
        got = {r.doc_id: r.text for r in SubstringDedup(window=window, gram=gram).remove(df).collect()}
        want = {d: (k, h) for d, _, k, h in brute(rows, window)}
        assert sum(k for k, _ in want.values()) > 0
        for d, t in rows:
            assert hashlib.sha256(" ".join(got[d].split()).encode()).hexdigest() == want[d][1]


def test_blocks_cover_every_window_once_in_any_slice():
    h = np.random.default_rng(1).integers(0, 4, 70000).astype(np.uint64)
    b = Blocks(h, 35, 16)
    assert b.lo[0] == 0 and b.hi[-1] == len(h) - 35
    assert (b.lo[1:] == b.hi[:-1] + 1).all()
    assert (b.place >= 0).all() and (b.place <= 35 - 16).all()
    lo, hi, place = unpacked(packed(b.lo, b.hi, b.place))
    assert (lo == b.lo).all() and (hi == b.hi).all() and (place == b.place).all()


def test_matches_grow_from_the_anchor_and_stop_at_the_first_other_word():
    x = np.arange(1, 14, dtype=np.uint64)[None].repeat(4, axis=0)
    y = x.copy()
    y[1, 2], y[2, 9], y[3, [0, 4, 8, 12]] = 99, 99, 99
    first, last = matches(x, y, 5, 3)
    assert list(zip(first.tolist(), last.tolist())) == [(0, 13), (3, 13), (0, 9), (5, 8)]


def test_factors_are_greedy():
    start, end = factors(np.array([3, 0, 30, 4]), np.array([3, 1, 31, 9]), 5)
    assert list(zip(start.tolist(), end.tolist())) == [(0, 14), (30, 36)]
