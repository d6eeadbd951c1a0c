"""Ranked search and decontamination against plain loops."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import PASSAGE, edge_rows, prose
from wardflow.llm import op12_ranked_search as op12
from wardflow.llm import op13_decontamination as op13
from wardflow.llm import words as words_module

ASCII_LOWER = {a: a + 32 for a in range(ord("A"), ord("Z") + 1)}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


ITEM_ROWS = [
    (1, PASSAGE),
    (2, " ".join(PASSAGE.split(" ")[:12])),
    (3, "two WORDS"),
    (4, None),
    (5, ""),
    (6, " ?! "),
    (None, "same line of words"),
    (7, "word " * 30),
    (7, "one"),
    (10, "漢字とかな交じり文。"),
    (11, "nothing of this stands anywhere else at all"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEM_ROWS, "item_id long, text string")


def plain_contamination(docs, items, n=10):
    windows = {}
    for item_id, text in items:
        found = plain_words(text)
        size = min(n, len(found))
        for i in range(len(found) - size + 1 if size else 0):
            windows.setdefault(tuple(found[i : i + size]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        found, hit, ids = plain_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(found) - size + 1):
                if tuple(found[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    ids |= windows[tuple(found[i : i + size])]
        names = sorted(str(x) for x in ids if x is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((doc_id, len(found), len(hit), len(names), digest, bool(hit)))
    return sorted(map(str, out))


def test_word_bytes_are_the_pattern():
    import pyarrow as pa

    texts = [x[1] for x in edge_rows()] + ["a", "b", "", None, "é", "A-b_c 9", "x" * 9, "y"]
    found = words_module.words_of(pa.array(texts).slice(3), words_module.WORD_BYTES)
    flat = [w for t in texts[3:] for w in plain_words(t)]
    assert found.words.to_pylist() == flat
    assert found.counts.tolist() == [len(plain_words(t)) for t in texts[3:]]
    assert words_module.count_words(pa.array(texts), words_module.WORD_BYTES).tolist() == [len(plain_words(t)) for t in texts]


@pytest.mark.parametrize("at_once", [words_module.BLOCK_BYTES, 200])
def test_contamination(spark, docs, items, monkeypatch, at_once):
    """Also with the items in many blocks: what earlier blocks found is kept."""
    monkeypatch.setattr(op13, "query_blocks", lambda df, key: words_module.query_blocks(df, key, at_once))
    got = sorted(str(tuple(r)) for r in op13.contamination(docs, items).collect())
    assert got == plain_contamination([r[:2] for r in edge_rows()], ITEM_ROWS)


def test_contamination_of_empty_tables(spark, docs, no_docs, items):
    assert op13.contamination(no_docs, items).collect() == []
    clean = op13.contamination(docs, items.limit(0)).collect()
    assert len(clean) == len(edge_rows()) and not any(r["contaminated"] for r in clean)


def test_remove_spans_and_documents(spark, docs, items):
    named = docs.withColumn("n_hit", docs["size"]).withColumn("runs", docs["spans"])
    cut = op13.remove_spans(named, items)
    assert cut.columns == named.columns and cut.count() == len(edge_rows())
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    before, after = prose(2, 90), prose(3, 60)
    assert plain_words(left[11]) == plain_words(before) + plain_words(after)
    assert left[4] is None and left[8] == "" and left[1] == prose(1, 120)
    kept = {r["doc_id"] for r in op13.remove_documents(named, items).collect()}
    assert 11 not in kept and 12 not in kept and {1, 3, 4, 5, 6, 16} <= kept
    assert {r["n_hit"] for r in op13.remove_documents(named, items).collect()} == {9}


def test_long_text(spark, items):
    text = (prose(50, 2000) + " ") * 150 + PASSAGE
    got = op13.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), items).first()
    assert got["n_words"] == len(plain_words(text)) and got["n_hit"] == 70 and got["n_items"] == 2


# Ranked search


def plain_ranking(docs, items, k):
    """Every score worked out, then sorted."""
    held = [(doc_id, Counter(plain_words(text))) for doc_id, text in docs]
    held = [(doc_id, terms, sum(terms.values())) for doc_id, terms in held if terms]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    holders = Counter(t for _, terms, _ in held for t in terms)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, terms, n in held:
            norm = 50 + 50 * n * n_docs // n_terms
            score = 0
            for term in set(plain_words(text)) & set(terms):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[term] + 1)))
                score += weight * (10**9 * terms[term] // (1000 * terms[term] + 20 * norm))
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item_id, rank, doc_id, -score))
    return sorted(map(str, out))


SEARCH_DOCS = [
    *(r[:2] for r in edge_rows()),
    *((100 + i, prose(i % 40, 30 + i % 7)) for i in range(200)),
    *((400 - i, "same short text here") for i in range(70)),
]
SEARCH_ITEMS = [*ITEM_ROWS, (20, prose(5, 40)), (20, prose(5, 40)), (21, "same text"), (22, "漢字とかな交じり文 Ωμέγα"), (23, prose(7, 60))]


@pytest.mark.parametrize("block_docs, at_once, cells, k", [(4096, 1 << 20, 1 << 14, 5), (16, 300, 64, 50)])
def test_ranked_documents(spark, monkeypatch, block_docs, at_once, cells, k):
    """In one block, and in many blocks of documents and of items, with few cells looked at in a step."""
    monkeypatch.setattr(op12, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(op12, "_CELLS_AT_ONCE", cells)
    monkeypatch.setattr(op12, "query_blocks", lambda df, key: words_module.query_blocks(df, key, at_once))
    docs = spark.createDataFrame(SEARCH_DOCS, "doc_id long, text string").repartition(3)
    docs = docs.withColumn("rank", docs["doc_id"]).withColumn("terms", docs["text"])
    items = spark.createDataFrame(SEARCH_ITEMS, "item_id long, text string")
    got = op12.ranked_documents(docs, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_ranking(SEARCH_DOCS, SEARCH_ITEMS, k)


def test_ranked_search_of_empty_tables(spark, docs, no_docs, items):
    assert op12.ranked_documents(no_docs, items).collect() == []
    assert op12.ranked_documents(docs, items.limit(0)).collect() == []
    blank = docs.withColumn("text", docs["text"].substr(1, 0))
    assert op12.ranked_documents(blank, items).collect() == []


@pytest.mark.parametrize("n_rows, n_columns", [(1, 1), (3, 200), (500, 9), (64, 64)])
def test_treap(n_rows, n_columns):
    """Packing keeps every cell; the descent finds the best columns with all ties of the last one."""
    draw = np.random.default_rng(n_rows)
    grid = draw.integers(1, 30, (n_rows, n_columns)) * (draw.random((n_rows, n_columns)) < 0.2)
    grid[0, 0] = 7
    rows, columns = np.nonzero(grid)
    tree = op12.Treap.of_points(rows, columns, grid[rows, columns])
    again = op12.Treap.unpacked(*tree.packed())
    assert (again.masks == tree.masks).all() and (again.maxima == tree.maxima).all() and again.levels == tree.levels
    assert tree.maxima[0] == grid.max()
    for k in (1, 4, 50):
        wanted = np.sort(draw.choice(n_rows, min(n_rows, 6), replace=False))
        weights = draw.integers(0, 9, len(wanted))
        scores = weights @ grid[wanted]
        found, sums = again.best(wanted, weights, k, 1)
        assert (scores[found] == sums).all() and len(set(found.tolist())) == len(found)
        last = np.sort(scores)[::-1][min(k, n_columns) - 1]
        assert set(np.flatnonzero(scores >= max(1, last))) <= set(found.tolist())


def test_index_holds_every_document(spark, monkeypatch):
    monkeypatch.setattr(op12, "BLOCK_TEXT", 5000)
    docs = spark.createDataFrame(SEARCH_DOCS, "doc_id long, text string").coalesce(1)
    stats = op12.statistics(docs)
    assert stats.n_docs == sum(bool(plain_words(t)) for _, t in SEARCH_DOCS)
    index = op12.build_index(docs, stats)
    assert index.count() > 5
    held = Counter()
    for row in index.collect():
        held.update(dict(zip(row["terms"], row["held_by"])))
    assert held == Counter(t for _, text in SEARCH_DOCS for t in set(plain_words(text)))
