"""HTML, media, BPE and packing: round trips and library equality."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict
from html import unescape

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from typeloom.llm import bpe, media, packing
from typeloom.llm.html_extract import Extractor, HtmlExtract, decode, features, labels, nodes, op1
from typeloom.llm.html_dom import parse
from typeloom.llm.html_training import pages

# HTML ---------------------------------------------------------------------


def test_generated_pages_held_out():
    e = Extractor.of()
    hit = miss = 0
    for p in pages(120, 4242):
        order = nodes(parse(p))
        y = labels(order)
        got = set(decode(order, e.trees.predict(features(order, e.scores)).tolist()))
        want = {i for i, v in enumerate(y) if v and order[i].tag == "#text"}
        hit += len(got & want)
        miss += len(got ^ want)
    assert miss <= 0.02 * hit


def test_a_page_with_everything(spark):
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href=a>A</a></li></ul></nav><div class="cookie-banner">We use cookies.</div>
<article><h1>Head &amp; line</h1><p>One   two<b>three</b> four.<br>five</p><div class=ad>Buy now.</div><p>Last &lt;x&gt; caf&eacute;.</article>
<section class="comments"><p>Reader says no.</p></section><aside class="sidebar"><p>Related text.</p></aside><form><label>Mail</label></form><footer>&copy; me</footer><script>var a="</p>";</script>"""
    rows = [(1, "u", html), (2, None, None), (3, "u", ""), (4, "u", "<p"), (4, "u", "<<<>>>&&&"), (None, "u", html), (6, "u", "<div>" * 3000), (7, "u", "<body><article><p>" + "word. " * 50000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = HtmlExtract()(df).collect()
    assert len(got) == len(rows)
    want = "Head & line\nOne twothree four. five\nLast <x> café."
    assert [r.text for r in got if r.page_id in (1, None)] == [want, want]
    assert all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert HtmlExtract()(df.limit(0)).count() == 0


def plain_article(page):
    """The text of a page's article, read without any model."""
    inner = page.split("<article>")[1].split("</article>")[0]
    inner = re.sub(r"<(div|aside|form|section)\b[^>]*>.*?</\1>", "", inner, flags=re.S) if "<div" in inner else inner
    blocks = re.split(r"</?(?:p|h[1-6]|ul|ol|li|blockquote)\b[^>]*>", inner)
    return "\n".join(t for t in (" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks) if t)


def test_pages_table_has_the_articles_text(spark, sf):
    got = op1(spark, sf).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(got) == len(html)
    for r in got:
        assert r.text == plain_article(html[r.page_id]) and r.n_chars == len(r.text)


def test_the_model_in_the_file_is_what_training_gives():
    a, b = Extractor.of(), Extractor.trained()
    x = features(nodes(parse(pages(1, 5)[0])), a.scores)
    assert a.scores.odds.keys() == b.scores.odds.keys() and np.allclose(a.trees.predict(x), b.trees.predict(x))


def test_links_without_a_word_on_them_are_no_article():
    html = "<body><div class=article><h1>A head line</h1>" + "<p>Some words that say something, and then some more of it. It goes on.</p>" * 6 + "</div><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div></body>"
    assert "One" not in Extractor.of().texts([html])[0]


LONG = 200_000
HOSTILE = {"quotes": "<a b='\" ", "quotes and an end": "<p c=\"x'>t</p>", "open drawings": "<svg>", "options": "<option>x", "comments": "<!--", "marked sections": "<![CDATA[", "declarations": "<!", "signs": "<", "ends": "</section>", "paragraphs": "<p>x", "items": "<li><dd><td>", "a reference": "&#1"}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    piece = HOSTILE[name]
    page = "<div>" * 20_000 + piece * (LONG // len(piece)) + ("1" * LONG + ";" if name == "a reference" else "")
    start = time.perf_counter()
    nodes(parse(page))
    assert time.perf_counter() - start < 3


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/pdiv bal=\"'!-&;", max_size=80))
def test_the_reader_never_fails(s):
    order = nodes(parse(s))
    assert order[0].tag == "#root" and all(n.parent is not None for n in order[1:])


def test_decoding_is_the_best_consistent_choice():
    rng = random.Random(2)
    for _ in range(40):
        order = nodes(parse("<div>a<div>b<p>c</p></div><p>d</p></div>"))
        odds = [rng.uniform(-2, 2) for _ in order]
        at = {id(n): i for i, n in enumerate(order)}
        best, pick = 0.0, []
        for mask in range(1 << (len(order) - 1)):
            on = {0} | {i + 1 for i in range(len(order) - 1) if mask >> i & 1}
            ok = all(at[id(order[i].parent)] in on for i in on if i) and all(odds[i] > 0 if order[i].tag == "#text" else any(at[id(c)] in on for c in order[i].children) for i in on if i)
            total = sum(odds[i] for i in on if i)
            if ok and total > best:
                best, pick = total, sorted(i for i in on if order[i].tag == "#text")
        assert decode(order, odds) == pick


# media --------------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=3000))
def test_image_round_trip(raw):
    p = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
    assert media.from_png(media.to_png(p)) == p


def test_media_query_and_split_reading(spark, sf, tmp_path):
    rows = [(1, None), (2, ""), (3, "x" * 576), (4, "x" * 577), (5, "é" * 1000), (5, "é" * 1000), (-7, "t"), (None, "t"), (9, "long " * 200000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, name string").repartition(3)
    op = media.MediaArchives(split=3000)  # far less than an archive: members are found by their ranges
    assert op.write(df, f"file://{tmp_path}/a") == len(rows)
    got = op.features(op.read(spark, f"file://{tmp_path}/a")).collect()
    want = sorted((d, len((t or "").encode()), hashlib.sha256(media.payload_of(t)).hexdigest(), zlib.crc32(media.payload_of(t)[-32:])) for d, t in [(d if d is not None else 10**6, t) for d, t in rows])
    assert sorted((r.doc_id if r.doc_id is not None else 10**6, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.error is None and r.payload_bytes % 576 == 0 for r in got)
    assert op.write(df.limit(0), f"file://{tmp_path}/b") == 0
    assert op.features(op.read(spark, f"file://{tmp_path}/b")).count() == 0


def test_media_query_over_the_whole_table(spark, sf):
    """Every column, the stored form read by another library's PNG rules."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = media.op5(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        rows = b"".join(b"\0" + p[i : i + 576] for i in range(0, len(p), 576))
        chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
        image = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (576).to_bytes(4, "big") + (len(p) // 576).to_bytes(4, "big") + b"\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")
        counts = np.bincount(np.frombuffer(p, np.uint8), minlength=256)
        feature = "".join(f"{int(counts[16 * i : 16 * i + 16].sum()) * 999 // len(p):03x}" for i in range(16)) + f"-{int((counts * np.arange(256)).sum()) * 100 // len(p):05d}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert (r.media_bytes, r.media_sha256, r.feature, r.error) == (len(image), hashlib.sha256(image).hexdigest(), feature, None)


def test_torn_archives_and_foreign_files_are_rows_with_errors(spark, tmp_path):
    import zipfile

    op = media.MediaArchives()
    op.write(spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").coalesce(1), str(tmp_path))
    whole = next(tmp_path.glob("*.zip"))
    (tmp_path / "_committed").write_text(f"{whole.name}\ntorn.zip\nforeign.zip")
    (tmp_path / "torn.zip").write_bytes(whole.read_bytes()[:-200])
    with zipfile.ZipFile(tmp_path / "foreign.zip", "w") as z:
        z.writestr("a.txt", "no image")
    (tmp_path / "attempt.zip").write_bytes(whole.read_bytes())  # not committed: not there
    got = op.features(op.read(spark, str(tmp_path))).collect()
    assert len(got) == 22 and sum(r.error is None for r in got) == 20 and sum(r.doc_id is None for r in got) == 2


def test_parts_of_a_directory_hold_each_entry_once(tmp_path):
    import io

    out = io.BytesIO()
    w = media.ArchiveWriter(out)
    for i in range(50):
        w.add(f"{i:08d}-PK\x01\x02-{i}".encode(), bytes([i]) * i)
    w.close()
    raw = out.getvalue()
    n, length, start = media.ending(io.BytesIO(raw), len(raw))
    whole = raw[start : start + length]
    every = media.entries(whole, True, length, True)
    assert n == 50 == len(every)
    for step in (1, 13, 60, 61, 1000):
        found = []
        for at in range(0, length, step):
            found += media.entries(whole[at : at + step + 5 * media.ENTRY], at == 0, min(step, length - at), True)
        assert found == every


def test_a_damaged_member_does_not_stop_the_others(spark, tmp_path):
    op = media.MediaArchives()
    op.write(spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").coalesce(1), str(tmp_path))
    f = next(tmp_path.glob("*.zip"))
    raw = bytearray(f.read_bytes())
    at = raw.index(b"IDAT", 400)
    raw[at + 6] ^= 0xFF
    f.write_bytes(raw)
    op.split = 1 << 20
    got = op.features(op.read(spark, str(tmp_path))).collect()
    assert len(got) == 20 and sum(r.error is not None for r in got) == 1


def test_archives_are_plain_zip_files(spark, tmp_path):
    import zipfile

    media.MediaArchives().write(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1), str(tmp_path))
    with zipfile.ZipFile(next(tmp_path.glob("*.zip"))) as z:
        assert z.testzip() is None and len(z.namelist()) == 2


# BPE ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def both(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False), len(ids)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdeé'sΣς<|>endoftx 1!\n", max_size=80)))
def test_encoding_equals_the_library(text):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json")) if not hasattr(test_encoding_equals_the_library, "t") else test_encoding_equals_the_library.t
    test_encoding_equals_the_library.t = t
    assert next(bpe.model().texts([text])) == both(t, text)


def test_bpe_on_documents_and_odd_texts(spark, sf, library):
    texts = [None, "", " ", "<|endoftext|>x<|startoftext|>", "a" * 5000, "ab" * 70, "日本語 👩‍👩‍👧", "İ ΟΔΟΣ", "՘ new"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    got = bpe.BpeCodec().encode(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (" ".join(map(str, r.ids)), r.decoded, r.n_tokens) == both(library, texts[r.doc_id])
    assert bpe.BpeCodec().encode(df.limit(0)).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op6(spark, sf).collect():
        ids, text, n = both(library, docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_array_and_scalar_trees_agree():
    m = bpe.model()
    rng = random.Random(1)
    raws = ["".join(rng.choice("abcdehinorst") for _ in range(rng.randint(1, 64))).encode() for _ in range(300)]
    assert m.encode_words(raws) == [m.word_scalar(r) for r in raws]
    assert m.decode(m.word_scalar(b"hello")) == "hello</w>"


def test_places_of_long_words_stay_below_the_rank(monkeypatch):
    m = bpe.model()
    raw = b"the rest of another word" * 3
    want = m.word_scalar(raw)
    monkeypatch.setattr(bpe, "_SHIFT", 3)  # as 24 is to a word of over 16 million bytes
    assert m.word_scalar(raw) == want


# packing ------------------------------------------------------------------


def test_byte_encoding_equals_the_library(spark, sf):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + ["a<|endoftext|>b", " " * 200000, "x\n\n  y", "é日本", ""]
    for x in texts:
        assert packing.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids


def check_packing(rows, docs, size=1024):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.no_padding()
    library.no_truncation()
    ids = {}
    for d, t in docs:  # every row's ids by the library, not by the operator
        ids[d] = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for d, rs in by.items():
        rs.sort(key=lambda r: r.piece)
        assert [(r.start, r.length) for r in rs] == packing.cut(len(ids[d]), size)
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(seqs), -(-sum(r.length for r in rows) // size)


def test_a_row_that_all_pieces_are_is_spread_over_groups(spark):
    df = spark.createDataFrame([(1, "the same short text")] * 3000, "doc_id long, text string")
    rows = packing.Packing()(df).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3000
    n = rows[0].length
    assert len({r.sequence_id for r in rows}) == -(-3000 // (1024 // n))


def test_packing_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, least = check_packing(packing.op9(spark, sf).collect(), docs)
    assert used <= least + max(2, least // 50)


def test_packing_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "a b c"), (4, "word " * 5000), (None, "x"), (6, "y " * 1023), (7, "y " * 1024)]
    df = spark.createDataFrame([(*d, 1, "l") for d in docs] + [(3, "a b c", 1, "l")], "doc_id long, text string, length int, salt string")
    got = packing.Packing()(df).collect()
    assert sum(r.doc_id == 3 for r in got) == 2
    one = [r for r in got if r.doc_id != 3] + [r for r in got if r.doc_id == 3][:1]
    assert {r.doc_id for r in one} == {d for d, _ in docs}
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.Packing()(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=8), st.integers(1, 40))
def test_the_fullest_combination(available, room):
    used = packing.fullest(dict(available), room)
    assert all(n <= available[k] for k, n in used.items())
    sums = {0}
    for k, n in available.items():
        sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= room}
    assert sum(k * n for k, n in used.items()) == max(sums)


def test_slots_hold_every_piece_once():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 33, 500)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    s = packing.Slots(packing.pack(counts, 32))
    rank = np.zeros(500, np.int64)
    for k in counts:
        rank[lengths == k] = np.arange(counts[k])
    seq, off = s.place(lengths, rank)
    spots = {(int(q), int(o) + j) for q, o, n in zip(seq, off, lengths) for j in range(n)}
    assert len(spots) == lengths.sum() and max(o for _, o in spots) < 32 and len(set(seq.tolist())) == s.bins
