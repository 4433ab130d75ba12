"""Page boilerplate mixed with main content (problem 4).

Every page becomes a tree (``pages``); the trained graphical model (``page_model``) gives each leaf the probability that it belongs to the
main body; the lines of the leaves above one half are the body. Pages need nothing of each other, so that the operator is one
Arrow pass without a shuffle, and only the model (a few hundred numbers) is shared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.packed import unpacked
from weftline.llm.page_model import Flat, Model, marginals
from weftline.llm.pages import Trees, add_page
from weftline.llm.residue import Residue, chunk_scores, learn, read_chunks

#: Pages whose trees are worked on at once, and characters of text.
BLOCK_PAGES, BLOCK_CHARS = 400, 2_000_000


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded size."""
    begin = 0
    while begin < len(texts):
        end, chars = begin, 0
        while end < len(texts) and end - begin < BLOCK_PAGES and (end == begin or chars < BLOCK_CHARS):
            chars += len(texts[end] or "")
            end += 1
        yield begin, end
        begin = end


def read_pages(model: Model, texts: list[str | None]) -> tuple[Trees, np.ndarray]:
    """Trees of some texts and each node's probability of being body."""
    t = Trees()
    for i, text in enumerate(texts):
        if text:
            add_page(t, i, text)
    p, _, _ = marginals(model, Flat(t))
    return t, p[:, 1] if len(p) else np.zeros(0)


def lines_of(t: Trees, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pages and numbers of the lines that show a leaf of a main body, in order, each once."""
    if not t.lines:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    page, no, node = np.fromiter(chain.from_iterable(t.lines), np.int64, 3 * len(t.lines)).reshape(-1, 3).T
    body = p[node] > 0.5
    found = np.unique((page[body] << 32) + no[body])
    return found >> 32, found & 0xFFFFFFFF


def body_of(t: Trees, p: np.ndarray, n: int) -> list[str]:
    """The plain text of each of n pages' main body, passages separated by a line end."""
    parts: list[list[str]] = [[] for _ in range(n)]
    for node, passage in t.text.items():
        if p[node] > 0.5:
            parts[t.page[node]].append(passage)
    return ["\n".join(x) for x in parts]


def body_lines(pages: DataFrame, residue: Residue | bool = True) -> DataFrame:
    """tbl, rec_id, line_no of every line that shows visible letters or digits of the main body. Lines are counted from 0 by "\\n".

    pages: tbl, rec_id, text. Null, empty and blank texts and JSON have no lines; neither have records that the residue model (the given one, or
    with True one learnt from these pages) finds to hold no content. Equal rows have equal results. Other columns are not read.
    """
    chunks = read_chunks(pages, lines=True)
    shared = pages.sparkSession.sparkContext.broadcast(learn(chunks) if residue is True else residue or None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in unpacked(batches):
            of, no = data[6], data[7]
            if shared.value is not None:
                _, score = chunk_scores(shared.value, data)
                kept = ~(score[of] > 0)
                of, no = of[kept], no[kept]
            at = pa.array(of)
            tbl, rec = pa.array([k for k, _ in data[0]], pa.string()), pa.array([k for _, k in data[0]], pa.int64())
            yield pa.RecordBatch.from_arrays([tbl.take(at), rec.take(at), pa.array(no, pa.int32())], names=["tbl", "rec_id", "line_no"])

    return chunks.mapInArrow(run, "tbl string, rec_id long, line_no int")


def body_text(pages: DataFrame, residue: Residue | bool = True) -> DataFrame:
    """tbl, rec_id, text: the plain text of each page's main body, passages separated by a line end; empty where there is none. Rows as in ``body_lines``."""
    chunks = read_chunks(pages, texts=True)
    shared = pages.sparkSession.sparkContext.broadcast(learn(chunks) if residue is True else residue or None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in unpacked(batches):
            gone = chunk_scores(shared.value, data)[1] > 0 if shared.value is not None else np.zeros(len(data[0]), bool)
            out = ["" if g else x for g, x in zip(gone, data[8])]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in data[0]], pa.string()), pa.array([k for _, k in data[0]], pa.int64()), pa.array(out, pa.string())], names=["tbl", "rec_id", "text"])

    return chunks.mapInArrow(run, "tbl string, rec_id long, text string")
