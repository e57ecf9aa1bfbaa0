import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallymill.llm import substrings


def slow_removed(texts, window=35):
    """(n_words, n_removed, kept) of every text, from all windows."""
    words = [(t or "").encode().split() for t in texts]
    times = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if times[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


@pytest.fixture(scope="module")
def shared(words):
    """Texts with passages of 34 to 90 words in common, whole copies, a period and one text inside another."""
    rng = random.Random(31)
    passages = [" ".join(rng.choices(words, k=k)) for k in (34, 35, 36, 60, 90)]
    texts = []
    for n in range(300):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 80)))]
        if n % 4 == 0:
            parts.insert(rng.randint(0, 1), passages[n % 5])
        if n % 9 == 0:
            parts.append(passages[n % 5].replace(" ", "\n ", 3))
        texts.append(" ".join(parts))
    texts += [texts[7]] * 40 + ["one two three " * 30, texts[0] + " " + texts[1], "  \t ", "", None]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("sizes", [{}, {"PART_BYTES": 2000, "SHARD_BYTES": 5000}, {"PART_BYTES": 500, "SHARD_BYTES": 100, "BUCKETS": 3}])
def test_removed_as_by_all_windows(spark, shared, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(substrings, name, value)
    frame = spark.createDataFrame(list(enumerate(shared)), "doc_id bigint, text string").repartition(4)
    found = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.remove_repeated(frame).collect()}
    wanted = slow_removed(shared)
    assert [found[i] for i in range(len(shared))] == wanted
    assert 40 < sum(removed > 0 for _, removed, _ in wanted) < 200


def test_another_window(spark, shared):
    frame = spark.createDataFrame(list(enumerate(shared)), "key bigint, body string")
    found = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.remove_repeated(frame, "key", "body", window=4).collect()}
    assert [found[i] for i in range(len(shared))] == slow_removed(shared, 4)


def test_merged_estimates_are_never_too_low():
    rng = np.random.default_rng(4)
    cells = [np.unique(rng.integers(0, 3000, rng.integers(1, 400))).astype(np.uint32) for _ in range(30)]
    times = [rng.integers(1, 3, len(c)) for c in cells]
    true = Counter()
    for c, t in zip(cells, times, strict=True):
        for x, n in zip(c.tolist(), t.tolist(), strict=True):
            true[x] += n
    found = substrings.merged_estimates(cells, times)
    over = [e - true[x] for c, es in zip(cells, found, strict=True) for x, e in zip(c.tolist(), es.tolist(), strict=True)]
    assert min(over) == 0 and np.mean(np.array(over) > 0) < 0.2


def test_equal_hashes_do_not_remove(monkeypatch, shared):
    """Estimates may be as wrong as they like: exact digests decide."""
    part = substrings.Part(pa.chunked_array([shared]))
    found, which, times = substrings._different(part.digests(np.arange(len(part.at))))
    rows = list(part.without(np.flatnonzero(times[which] > 1)))
    assert rows == slow_removed(shared)


def test_long_words(monkeypatch):
    """Words longer than a step are hashed by themselves; hashes are equal exactly if windows are."""
    monkeypatch.setattr(substrings, "STEP", 64)
    texts = [" ".join("x" * (i * 13 % 150 + 1) + str(i % 40) for i in range(200)), "y" * 1000, "y" * 1000 + " z"]
    part = substrings.Part(pa.chunked_array([texts]), 5)
    keys = [part.text[part.starts[a] : part.stops[a + 4]] for a in part.at.tolist()]
    assert len(set(part.hashes().tolist())) == len(set(keys))
    by_key = {}
    assert all(by_key.setdefault(k, h) == h for k, h in zip(keys, part.hashes().tolist(), strict=True))


def test_odd_documents(docs, no_docs):
    found = substrings.remove_repeated(docs).collect()
    given = docs.select("doc_id", "text").collect()
    wanted = slow_removed([r.text for r in given])
    assert Counter(map(tuple, found)) == Counter((r.doc_id, *w) for r, w in zip(given, wanted, strict=True))
    assert substrings.remove_repeated(no_docs).collect() == []


def test_texts_are_not_shuffled_again(spark, shared):
    frame = spark.createDataFrame(list(enumerate(shared)), "doc_id bigint, text string")
    plan = substrings.remove_repeated(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1
