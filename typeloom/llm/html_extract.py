"""Main text of HTML pages: boosted trees over DOM nodes, decoded on the tree.

Every element and every block of text gets features (size, density and links of
its subtree, scores of its tag and attribute tokens, depth, siblings, the same
of its ancestors) and a log-odds of belonging to the article from boosted trees.
Decoding finds the most likely choice for the whole tree in which no chosen node
has an ancestor that was not chosen, so an article block in a rejected sidebar
cannot come back, nor can a rejected block keep its children.

The trees are trained on generated pages (``html_training``) by ``python -m
typeloom.llm.html_extract``, which writes ``html_model.json``: numbers of some
tens of kilobytes, which travel with the task.  Other sizes of training sets are
trained where they are asked for.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import batches, read
from .html_dom import Node, parse
from .html_training import MARK, pages

MODEL = Path(__file__).with_name("html_model.json")
#: Generated pages, and the seed, of the model in the file.
TRAINING, SEED = 1500, 17
_PUNCTUATION = str.maketrans("", "", ".,;:!?")


def nodes(root: Node) -> list[Node]:
    """All nodes in page order, the root first: parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


class Scores:
    """Log-odds of tags and attribute tokens, with smoothing, from labels."""

    def __init__(self) -> None:
        self.odds: dict[str, float] = {}

    def fit(self, trees: list[list[Node]], labels: list[list[int]]) -> "Scores":
        seen: dict[str, list[int]] = {}
        for order, ys in zip(trees, labels):
            for node, y in zip(order, ys):
                for t in {f"<{node.tag}>", *node.tokens}:
                    seen.setdefault(t, [0, 0])[y] += 1
        self.odds = {t: math.log((b + 1.0) / (a + 1.0)) for t, (a, b) in seen.items() if a + b >= 3}
        return self


def features(order: list[Node], scores: Scores) -> np.ndarray:
    """One row of numbers per node."""
    n = len(order)
    at = {id(node): i for i, node in enumerate(order)}
    parent = [at[id(node.parent)] if node.parent else 0 for node in order]
    chars, links, elements, blocks, items, stops, controls = ([0] * n for _ in range(7))
    for i, node in enumerate(order):
        if node.tag == "#text":
            chars[i], links[i], blocks[i] = len(node.text), node.link, 1
            stops[i] = len(node.text) - len(node.text.translate(_PUNCTUATION))
        else:
            elements[i] = 1
            items[i] = node.tag == "li"
            controls[i] = node.tag in ("form", "button", "fieldset", "label")
    before, total = [0] * n, 0
    for i in range(n):
        before[i] = total
        total += chars[i]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for column in (chars, links, elements, blocks, items, stops, controls):
            column[p] += column[i]
    odds = scores.odds
    low, high, own = [0.0] * n, [0.0] * n, [0.0] * n
    rows = []
    places: dict[int, int] = {}
    for i, node in enumerate(order):
        p = parent[i]
        tag = odds.get(f"<{node.tag}>", 0.0)
        values = [odds[t] for t in node.tokens if t in odds]
        own[i] = min([tag, *values]) if i else 0.0
        least, most = (min(values), max(values)) if values else (0.0, 0.0)
        low[i] = min(low[p], own[i]) if i else 0.0
        high[i] = max(high[p], most, tag) if i else 0.0
        siblings = len(order[p].children)
        place = places.get(p, 0)
        places[p] = place + 1
        size = chars[i]
        rows.append(
            (
                node.depth, tag, least, most, low[p], high[p], own[p], node.tag == "#text", math.log1p(size), links[i] / size if size else 0.0,
                math.log1p(elements[i]), math.log1p(size / (elements[i] + 1)), stops[i] / size if size else 0.0, place / siblings if siblings else 0.0, siblings,
                before[i] / total if total else 0.0, size / total if total else 0.0, items[i] / (elements[i] + 1), controls[i] / (elements[i] + 1),
                math.log1p(size / (blocks[i] or 1)), links[p] / chars[p] if chars[p] else 0.0, math.log1p(chars[p] / (elements[p] + 1)), chars[p] / total if total else 0.0, len(values),
            )
        )
    return np.array(rows, float)


def labels(order: list[Node]) -> list[int]:
    """1 for marked text and everything it lies in; the marks are removed."""
    at = {id(node): i for i, node in enumerate(order)}
    y = [0] * len(order)
    for i in range(len(order) - 1, -1, -1):
        node = order[i]
        if MARK in node.text:
            node.text = node.text.replace(MARK, "").strip()
            y[i] = 1
        if y[i] and node.parent:
            y[at[id(node.parent)]] = 1
    return y


class Extractor:
    """Scores and trees, and extraction with them."""

    def __init__(self, scores: Scores, trees: BoostedTrees):
        self.scores, self.trees = scores, trees

    @staticmethod
    @lru_cache(maxsize=2)
    def of(n: int = TRAINING, seed: int = SEED) -> "Extractor":
        """The model in the file, or one trained now if another is asked for."""
        if (n, seed) != (TRAINING, SEED):
            return Extractor.trained(n, seed)
        m = json.loads(MODEL.read_text())
        scores = Scores()
        scores.odds = m["odds"]
        trees = BoostedTrees(len(m["feature"]), m["depth"])
        trees.base, trees.feature, trees.leaf = m["base"], np.array(m["feature"], np.int64), np.array(m["leaf"])
        trees.cut = np.array([[math.inf if c is None else c for c in row] for row in m["cut"]])
        return Extractor(scores, trees)

    def save(self) -> None:
        t = self.trees
        cut = [[None if math.isinf(c) else c for c in row] for row in t.cut.tolist()]
        m = {"odds": self.scores.odds, "depth": t.depth, "base": t.base, "feature": t.feature.tolist(), "cut": cut, "leaf": t.leaf.tolist()}
        MODEL.write_text(json.dumps(m, sort_keys=True) + "\n")

    @staticmethod
    def trained(n: int = TRAINING, seed: int = SEED) -> "Extractor":
        """From ``n`` generated pages; half give the token scores, all the trees."""
        made = [nodes(parse(p)) for p in pages(n, seed)]
        ys = [labels(order) for order in made]
        scores = Scores().fit(made[::2], ys[::2])
        x = np.concatenate([features(order, scores) for order in made])
        return Extractor(scores, BoostedTrees(trees=50, depth=4).fit(x, np.array([v for y in ys for v in y], float)))

    def texts(self, htmls: list[str | None]) -> list[str]:
        made = [nodes(parse(h)) for h in htmls]
        x = np.concatenate([features(order, self.scores) for order in made])
        odds = self.trees.predict(x).tolist()
        out, start = [], 0
        for order in made:
            out.append("\n".join(order[i].text for i in decode(order, odds[start : start + len(order)])))
            start += len(order)
        return out


def decode(order: list[Node], odds: list[float]) -> list[int]:
    """Chosen text blocks, in page order: of all sets of nodes that hold the
    parents of their members, the one with the greatest sum of log-odds.  The
    root is always chosen; text is chosen only where its own log-odds are above 0,
    and an element only with some text below it."""
    at = {id(node): i for i, node in enumerate(order)}
    gain = [0.0] * len(order)  # the best sum of a subtree whose top is chosen; none if that cannot be
    for i in range(len(order) - 1, 0, -1):
        node = order[i]
        if node.tag == "#text":
            gain[i] = odds[i] if odds[i] > 0 else -math.inf
        else:
            below = [gain[at[id(c)]] for c in node.children]
            gain[i] = odds[i] + (sum(g for g in below if g > 0) or max(below, default=-math.inf))
    out, stack = [], [0]
    while stack:
        i = stack.pop()
        if order[i].tag == "#text":
            out.append(i)
            continue
        below = [at[id(c)] for c in order[i].children]
        chosen = [c for c in below if gain[c] > 0]
        if i and not chosen:  # an element that is worth it in spite of what it must hold
            chosen = [max(below, key=gain.__getitem__)]
        stack += reversed(chosen)
    return out


_GROUP = 200


def _run(extractor: Extractor, schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one():
            for part in parts:
                keys, urls = part.column(0).to_pylist(), part.column(1).to_pylist()
                for i in range(0, len(keys), _GROUP):
                    group = part.column(2).slice(i, _GROUP).to_pylist()
                    for k, u, t in zip(keys[i : i + _GROUP], urls[i : i + _GROUP], extractor.texts(group)):
                        yield k, u, t, len(t)

        yield from batches(one(), schema, lambda r: r[3])

    return run


class HtmlExtract:
    """Main text of every row's page.

    Defined results: a null or empty page, and one without an article, have an
    empty text; malformed markup never fails; a very long page is read whole, in
    time linear in it; a node whose log-odds are 0 is not chosen; repeated rows
    get equal texts; an empty table gives an empty result.  Only the three named
    columns are read.
    """

    def __init__(self, key: str = "page_id", url: str = "url", html: str = "html", *, training_pages: int = TRAINING, seed: int = SEED):
        self.key, self.url, self.html, self.training_pages, self.seed = key, url, html, training_pages, seed

    def __call__(self, df: DataFrame) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [df.schema[c].dataType for c in (self.key, self.url)]
        schema = pa.schema([("k", to_arrow_type(kinds[0])), ("u", to_arrow_type(kinds[1])), ("text", pa.string()), ("n_chars", pa.int64())])
        ddl = f"k {kinds[0].simpleString()}, u {kinds[1].simpleString()}, text string, n_chars long"
        source = df.select(F.col(self.key).alias("k"), F.col(self.url).alias("u"), F.col(self.html).alias("h"))
        out = source.mapInArrow(_run(Extractor.of(self.training_pages, self.seed), schema), ddl)
        return out.toDF(self.key, self.url, "text", "n_chars")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HtmlExtract()(read(spark, sf_dir, "pages"))


if __name__ == "__main__":
    Extractor.trained().save()
