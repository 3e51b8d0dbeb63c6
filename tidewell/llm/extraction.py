"""Main text of web pages by block features and a trained decision tree (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.blocks import blocks, features
from tidewell.llm.columns import only
from tidewell.llm.html_examples import labelled_pages

MAX_DEPTH = 8


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = MAX_DEPTH) -> tuple | bool:
    """A binary decision tree by Gini impurity: ``(feature, threshold, below, above)`` or a leaf."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return bool(share > 0.5)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            a, b = labels[low].mean(), labels[~low].mean()
            impurity = low.mean() * a * (1 - a) + (1 - low.mean()) * b * (1 - b)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut, low)
    if best is None or best[0] >= share * (1 - share) - 1e-12:
        return bool(share > 0.5)
    _, f, cut, low = best
    return (f, float(cut), grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1))


def decide(tree: tuple | bool, row: tuple[float, ...]) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@lru_cache(maxsize=1)
def block_tree() -> tuple | bool:
    """The tree of the labelled table; training takes milliseconds."""
    rows, labels = [], []
    for page, wanted in labelled_pages():
        found = features(blocks(page))
        if len(found) != len(wanted):
            raise ValueError(f"{len(found)} blocks, {len(wanted)} labels: {page[:80]}")
        rows += found
        labels += wanted
    return grow(np.array(rows, float), np.array(labels, float))


def main_text(page: str | None, tree: tuple | bool) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if decide(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    A page becomes a flat list of text blocks; the tree judges each by its
    number of words, its link density, those of the blocks before and after,
    and the elements around it.  Main blocks are joined in page order.  Null
    and empty pages give an empty text; pages are read whole, whatever their
    length; broken markup is read as far as it goes; repeated rows are
    extracted each; other columns are not read.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    tree = block_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py(), tree) for h in batch[2]], pa.string())
            yield pa.RecordBatch.from_arrays([batch[0].cast(pa.int64()), batch[1].cast(pa.string()), texts], schema=schema)

    found = only(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
