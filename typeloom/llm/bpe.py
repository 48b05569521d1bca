"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves' left sides: leaf i holds the merge rank of
symbol i with its right neighbour (and i itself, so that of equal ranks the
leftmost is least).  The root is the next merge; applying it changes three
leaves, each updated along one path to the root, until no pair can merge.

Words of ordinary length are encoded many at a time: one numpy array per tree
level holds the level of all words, and each step does one merge in every word
that still has one.  Longer words take a scalar tree with the same rules.  Words
are cached per process, within a bound that affects speed only.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, read

_NONE = np.iinfo(np.int64).max
_SHIFT = 24  # places in a word, more in a longer one; a rank is kept above them
_WIDE = 64  # symbols of a word that still goes into an array tree
CACHE_WORDS = 300_000
_MODELS: dict[str, "Bpe"] = {}


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Bpe:
    """A tokenizer file with a BPE model over bytes and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback"):
            raise ValueError(f"{path}: not a plain BPE model")
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern).findall
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols])
        self.last = np.array([vocab[s + self.suffix] for s in symbols])
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.n = max(self.tokens) + 1
        pairs = np.array([vocab[a] * self.n + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = np.append(pairs[order], _NONE), np.append(order, -1)
        self.merged = np.array([vocab[a + b] for a, b in merges])
        self.table = {int(p): (r, int(self.merged[r])) for r, p in reversed(list(enumerate(pairs.tolist())))}
        self.cache: dict[bytes, tuple[str, str, int]] = {}
        self.words: dict[str | int, tuple[str, str, int]] = {}
        self.id_text = [str(i) for i in range(self.n)]
        self.path, self.library = path, None
        self.assigned: set[str] = set()
        self.byte_of = {s: b for b, s in enumerate(symbols)}

    # one word -------------------------------------------------------------

    def word_scalar(self, raw: bytes) -> list[int]:
        """Token ids of one word's bytes, by a segment tree over its pairs."""
        sym = [int(self.inner[b]) for b in raw[:-1]] + [int(self.last[raw[-1]])]
        n = len(sym)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << max(0, n - 1).bit_length()
        shift = max(_SHIFT, n.bit_length())
        tree = [_NONE] * (2 * size)

        def key(i: int) -> int:
            j = nxt[i]
            found = self.table.get(sym[i] * self.n + sym[j]) if j < n else None
            return found[0] << shift | i if found else _NONE

        for i in range(n):
            tree[size + i] = key(i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def update(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                tree[i] = min(tree[2 * i], tree[2 * i + 1])

        while (top := tree[1]) != _NONE:
            i = top & (1 << shift) - 1
            j = nxt[i]
            sym[i] = int(self.merged[top >> shift])
            sym[j] = -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            update(j, _NONE)
            update(i, key(i))
            if prev[i] >= 0:
                update(prev[i], key(prev[i]))
        return [s for s in sym if s >= 0]

    # many words -----------------------------------------------------------

    def _keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        pair = left * self.n + right
        j = np.searchsorted(self.pairs, pair)
        out = self.ranks[j] << _SHIFT | at
        out[(self.pairs[j] != pair) | (left < 0) | (right < 0)] = _NONE
        return out

    def words_array(self, raws: list[bytes], width: int) -> np.ndarray:
        """Symbols of words of at most ``width`` (a power of two) bytes: one row
        a word, -1 where a symbol was merged away or never was."""
        m = len(raws)
        size = np.fromiter(map(len, raws), np.int64, m)
        row = np.repeat(np.arange(m), size)
        col = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        sym = np.full((m, width + 1), -1, np.int64)  # the last column stands for "no neighbour"
        sym[row, col] = self.inner[np.frombuffer(b"".join(raws), np.uint8)]
        sym[np.arange(m), size - 1] = self.last[np.frombuffer(bytes(r[-1] for r in raws), np.uint8)]
        place = np.arange(width)
        nxt = np.broadcast_to(place + 1, (m, width)).copy()
        prev = np.broadcast_to(place - 1, (m, width)).copy()
        levels = [self._keys(sym[:, :-1].ravel(), sym[:, 1:].ravel(), np.tile(place, m)).reshape(m, width)]
        while levels[-1].shape[1] > 1:
            levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))

        def update(w: np.ndarray, i: np.ndarray, value: np.ndarray | int) -> None:
            levels[0][w, i] = value
            for down, up in zip(levels, levels[1:]):
                i = i >> 1
                up[w, i] = np.minimum(down[w, 2 * i], down[w, 2 * i + 1])

        live = np.flatnonzero(levels[-1][:, 0] != _NONE)
        while len(live):
            top = levels[-1][live, 0]
            i = top & (1 << _SHIFT) - 1
            j = nxt[live, i]
            sym[live, i] = self.merged[top >> _SHIFT]
            sym[live, j] = -1
            k = nxt[live, j]
            nxt[live, i] = k
            inside = k < width
            prev[live[inside], k[inside]] = i[inside]
            update(live, j, _NONE)
            update(live, i, self._keys(sym[live, i], sym[live, k], i))
            p = prev[live, i]
            has = p >= 0
            w, p, q = live[has], p[has], i[has]
            update(w, p, self._keys(sym[w, p], sym[w, q], p))
            live = live[levels[-1][live, 0] != _NONE]
        return sym[:, :-1]

    def encode_words(self, raws: list[bytes]) -> list[list[int]]:
        """Token ids of words given by their bytes, none empty."""
        out: list[list[int]] = [[]] * len(raws)
        by: dict[int, list[int]] = {}
        for k, raw in enumerate(raws):
            by.setdefault(1 << (len(raw) - 1).bit_length(), []).append(k)
        for width, at in by.items():
            if width > _WIDE:
                for k in at:
                    out[k] = self.word_scalar(raws[k])
                continue
            for i in range(0, len(at), 1 << 15):
                part = at[i : i + (1 << 15)]
                sym = self.words_array([raws[k] for k in part], width)
                keep = sym >= 0
                ends = np.cumsum(keep.sum(axis=1)).tolist()
                flat = sym[keep].tolist()
                start = 0
                for k, end in zip(part, ends):
                    out[k] = flat[start:end]
                    start = end
        return out

    # texts ----------------------------------------------------------------

    def pretokens(self, chunk: str) -> list[str | int]:
        """A chunk without ASCII white space as words, and ids of special tokens."""
        if chunk.isascii() and "<" not in chunk:
            return self.find(chunk.lower())
        parts = self.split_special(chunk) if self.split_special else [chunk]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif not part:
                continue
            elif part.isascii():
                out += self.find(part.lower())
            elif not (self.assigned.issuperset(part) or self._known(part)):
                out += self._foreign(part)
            else:
                # lower-casing here is by character: no final sigma
                out += self.find(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def _known(self, part: str) -> bool:
        """Are all characters in this Python's tables?  Remembers those that are."""
        new = {c for c in part if unicodedata.category(c) != "Cn"}
        self.assigned |= new
        return new.issuperset(part)

    def _foreign(self, part: str) -> list[str]:
        """Words of a chunk with characters newer than this Python's tables, of
        which the libraries' tables may differ: by the tokenizers library's own
        normalizer and splitter."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        tk = self.library
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in tk.pre_tokenizer.pre_tokenize_str(tk.normalizer.normalize_str(part))]

    def learn(self, chunks: set[bytes]) -> None:
        """Encode chunks into the cache: (ids, tokens, number of ids)."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        words, pretokens = self.words, self.pretokens
        split = [(c, pretokens(c.decode())) for c in chunks]
        fresh = list({w for _, ws in split for w in ws}.difference(words, self.special.values()))
        name, token = self.id_text, self.tokens
        for w, ids in zip(fresh, self.encode_words([w.encode() for w in fresh])):
            words[w] = (" ".join([name[i] for i in ids]), " ".join([token[i] for i in ids]), len(ids))
        for i in self.special.values():
            words[i] = (name[i], token[i], 1)
        cache = self.cache
        for c, ws in split:
            if len(ws) == 1:
                cache[c] = words[ws[0]]
            else:
                found = [words[w] for w in ws]
                cache[c] = (" ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found]))

    def texts(self, texts: list[str | None]) -> Iterator[tuple[str, str, int]]:
        """(ids joined by one space, decoded text, number of ids) of each text.
        The vocabulary has no decoder, so tokens are joined by one space."""
        split = [t.encode().split() if t else [] for t in texts]
        wanted = set().union(*split)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        self.learn(wanted.difference(self.cache))
        get = self.cache.__getitem__
        for chunks in split:
            found = [x for x in map(get, chunks) if x[2]]
            yield " ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found])

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def model(path: str | None = None) -> Bpe:
    """The model of a file; one per process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _MODELS:
        _MODELS[path] = Bpe(path)
    return _MODELS[path]


_GROUP_BYTES = 8 << 20


def _grouped(part: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    keys, texts, weight = [], [], 0
    for key, text in zip(part.column(0).to_pylist(), part.column(1)):
        t = text.as_py()
        keys.append(key)
        texts.append(t)
        weight += len(t or "")
        if weight >= _GROUP_BYTES:
            yield keys, texts
            keys, texts, weight = [], [], 0
    if keys:
        yield keys, texts


def _run(path: str | None, full: bool, schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def one():
            for part in parts:
                for keys, texts in _grouped(part):
                    for key, (ids, decoded, n) in zip(keys, bpe.texts(texts)):
                        if full:
                            yield key, n, [int(i) for i in ids.split()], decoded
                        else:
                            yield key, n, sha(ids), sha(decoded)

        # the caches hold no cycles, and a collector would walk them again and again
        gc.disable()
        try:
            yield from batches(one(), schema, (lambda r: 8 * r[1] + len(r[3])) if full else None)
        finally:
            gc.enable()

    return run


class BpeCodec:
    """Encodes and decodes every text of a table.

    Defined results: null and empty texts have no tokens; special tokens written
    in a text are those tokens; of merges of equal rank the leftmost comes first;
    very long texts and words are encoded whole, words beyond the array form's
    length one at a time; repeated rows get equal results; an empty table gives an
    empty result.  Only key and text are read.
    """

    def __init__(self, key: str = "doc_id", text: str = "text", *, path: str | None = None):
        self.key, self.text, self.path = key, text, path

    def _apply(self, df: DataFrame, full: bool) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = df.schema[self.key].dataType
        names, types = (("ids", "decoded"), (pa.list_(pa.int32()), pa.string())) if full else (("ids_sha256", "decoded_sha256"), (pa.string(), pa.string()))
        schema = pa.schema([("k", to_arrow_type(kind)), ("n_tokens", pa.int64()), *zip(names, types)])
        ddl = f"k {kind.simpleString()}, n_tokens long, " + ("ids array<int>, decoded string" if full else "ids_sha256 string, decoded_sha256 string")
        return df.select(F.col(self.key).alias("k"), F.col(self.text).alias("t")).mapInArrow(_run(self.path, full, schema), ddl).withColumnRenamed("k", self.key)

    def encode(self, df: DataFrame) -> DataFrame:
        """``(key, n_tokens, ids, decoded)``."""
        return self._apply(df, True)

    def digests(self, df: DataFrame) -> DataFrame:
        """``(key, n_tokens, ids_sha256, decoded_sha256)``."""
        return self._apply(df, False)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BpeCodec().digests(read(spark, sf_dir, "documents"))
