import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from tallymill.llm import balltree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def slow_terms(text):
    return TERM.findall((text or "").translate(FOLD))


def slow_search(docs, items, k):
    """Every document against every query: (query number, rank, id, score)."""
    held = [(key, slow_terms(text)) for key, text in docs]
    held = [(key, len(t), Counter(t)) for key, t in held if t]
    total, length = len(held), sum(n for _, n, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for number, (_, text) in enumerate(items):
        scores = []
        for key, n, counts in held:
            m = 100 - 50 + (50 * n * total) // length
            score = sum(
                floor(1000 * log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * counts[t]) // (1000 * counts[t] + 20 * m))
                for t in set(slow_terms(text))
                if t in counts
            )
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(number, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_terms(odd_texts):
    for text in [*odd_texts, "A-b_c é9É Z\x7f\x80x ½"]:
        assert [t.decode() for t in balltree.terms_of(text)] == slow_terms(text)


@pytest.fixture(scope="module")
def table(words):
    rng = random.Random(21)
    common, texts = words[:12], []
    for n in range(700):
        texts.append(" ".join(rng.choices(words, k=rng.randint(1, 60)) + rng.choices(common, k=20)))
        if n % 7 == 0:
            texts += [texts[-1]] * rng.randint(1, 4)
    rng.shuffle(texts)
    docs = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(30)] + [(30, texts[3]), (31, None), (32, "never-seen words?"), (30, texts[3])]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"TREE_DOCS": 60, "LEAF_DOCS": 4}, {"BLOCK_ITEMS": 7, "SUBSPACES": 16}, {"BLOCK_TERMS": 50, "LEAF_DOCS": 1}])
def test_search_as_every_document_against_every_query(spark, table, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(balltree, name, value)
    docs, items = table
    frame, asked = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id int, text string")
    found = balltree.search(frame.repartition(5), asked.coalesce(1), k=10).collect()
    wanted = slow_search(docs, items, 10)
    assert Counter(tuple(r) for r in found) == Counter((items[q][0], *rest) for q, *rest in wanted)
    assert found and {r.item_id for r in found}.isdisjoint({31, 32})


def test_bounds_hold_and_pass_over(table):
    """No vector of a ball is above its bound, and some subtrees are not visited."""
    rng = np.random.default_rng(3)
    width, rows = 300, []
    for n in range(1500):
        terms = np.sort(rng.choice(width, 12, replace=False)) if n % 3 else np.arange(n % 40, n % 40 + 12)
        rows.append((terms, rng.integers(1, 2**35, 12)))
    vectors = balltree.Vectors(np.arange(0, 12 * 1500 + 1, 12), np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows]))
    queries = [np.sort(rng.choice(width, 6, replace=False)) for _ in range(20)]
    tree, search = balltree.Tree(vectors, width), balltree.Search(queries, width, 3)
    dense = np.zeros((1500, width), np.int64)
    for i, (t, v) in enumerate(rows):
        dense[i, t] = v
    exact = np.array([dense[:, q].sum(axis=1) for q in queries])

    def members(node):
        return node.rows.tolist() if node.children is None else [r for c in node.children for r in members(c)]

    for node in tree.nodes:
        assert (search.bounds(node) >= exact[:, members(node)].max(axis=1)).all()
    search.add(tree, list(range(1500)))
    for q, best in enumerate(search.best):
        assert [(-s, i) for s, _, i in best] == sorted(((int(x), i) for i, x in enumerate(exact[q]) if x > 0), key=lambda x: (-x[0], x[1]))[:3]
    assert search.passed > 0


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "two one"), (None, "one two"), ("c", "")], "key string, body string")
    items = spark.createDataFrame([("x", "One"), (None, "two")], "name string, question string")
    found = balltree.search(docs, items, 2, "key", "body", "name", "question").collect()
    assert sorted(((r.item_id or "", r.rank, r.doc_id) for r in found)) == [("", 1, "a"), ("", 2, "b"), ("x", 1, "a"), ("x", 2, "b")]


def test_odd_documents(docs, no_docs, odd_texts):
    items = docs.selectExpr("doc_id as item_id", "text", "rank", "'?' as query", "'?' as doc_id") if "rank" in docs.columns else docs.selectExpr("doc_id as item_id", "text", "'?' as rank", "'?' as query", "'?' as doc_id")
    found = balltree.search(docs, items, 5).collect()
    given = [(r.doc_id, r.text) for r in docs.collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    wanted = Counter((asked[q][0], *rest) for q, *rest in slow_search(given, asked, 5))
    assert Counter(tuple(r) for r in found) == wanted
    assert balltree.search(no_docs, items, 5).collect() == [] and balltree.search(docs, items.where("false"), 5).collect() == []
