import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallymill.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps):
    """Smallest id reachable, over all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprints(odd_texts):
    for text in odd_texts:
        if not text or len(text) < 20_000:
            assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_odd_documents(docs, no_docs):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    ids = defaultdict(set)
    for r in docs.collect():
        ids[r.doc_id].add(r.text)
    by_fp = defaultdict(list)
    for r in found:
        by_fp[r.fp].append(r)
    assert {r.component_id for r in by_fp[0]} == {0}
    assert all(len({r.component_id for r in rows}) == 1 for rows in by_fp.values())
    assert simhash.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("pairwise", [64, 2])
def test_links_and_components_as_all_pairs(spark, monkeypatch, pairwise):
    """Chains, a dense ball of near copies, and strangers; by pairs and by stars."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(150)]
    chain = [fps[0]]
    for _ in range(25):
        chain.append(chain[-1] ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    ball = [fps[1] ^ 1 << rng.randrange(16) ^ 1 << rng.randrange(20) for _ in range(60)]
    far = [fps[2] ^ 0b111, fps[2] ^ 0b111000 << 30]
    values = [*fps, *chain, *ball, *far, 0, 3, 1 << 63, *fps[:5]]
    rng.shuffle(values)
    rows = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "doc_id bigint, fp bigint")
    found = {r.doc_id: r.component_id for r in simhash._assign(rows).collect()}
    assert [found[i] for i in range(len(values))] == slow_components(values)


def test_no_quadratic_links(spark):
    """A group of identical texts makes one fingerprint, and so no link."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"))
    assert simhash.links(simhash.fingerprints(rows).select("fp").distinct()).count() == 0
    assert {r.component_id for r in simhash.near_duplicates(rows).collect()} == {0}


def test_keep_first(docs, no_docs, spark):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    fps = [simhash.fingerprint(r.text) for r in rows]
    assert len(fps) == len(set(fps))
    assert set(fps) == {simhash.fingerprint(r.text) for r in docs.collect()}
    assert simhash.keep_first(no_docs).collect() == []
    alone = spark.createDataFrame([(None, "only rows without an id"), (None, "only rows without an id"), (None, "another text entirely")], "doc_id bigint, text string")
    assert sorted(r.text for r in simhash.keep_first(alone).collect()) == ["another text entirely", "only rows without an id"]


def slow_similar(texts, least):
    """Smallest position reachable, over all pairs of sets of five-word shingles."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [i for i in range(len(texts)) if find(i) == i]


def near_copies(words):
    """Texts, copies of each with one word changed, and a group around one text that its members reach only in part."""
    rng = random.Random(4)

    def changed(text, n):
        parts = text.split()
        for at in rng.sample(range(len(parts)), n):
            parts[at] = "changed" + str(rng.randrange(10**6))
        return " ".join(parts)

    texts = [" ".join(rng.choices(words, k=100)) for _ in range(60)]
    texts += [changed(t, 1) for t in texts[:40]]
    texts += [changed(texts[50], n % 6) for n in range(150)]
    chain = [texts[51]]
    for _ in range(12):
        chain.append(changed(chain[-1], 1))
    return [*texts, *chain, None, "", "one two", "One  two", "one three"]


@pytest.mark.parametrize("block", [512, 8])
def test_keep_first_by_similarity(spark, words, monkeypatch, block):
    """Planted near copies against all pairs; two bits over three words find few of them."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    texts = near_copies(words)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in simhash.keep_first(frame, shingle=5, similarity=0.8).collect())
    assert kept == slow_similar(texts, 0.8)
    assert not set(kept) & set(range(60, 100))
    assert len({r.doc_id for r in simhash.keep_first(frame).collect()} & set(range(60, 100))) > 20


def test_stage_drops_near_copies(spark, words):
    import corpus_pipeline

    texts = near_copies(words)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == slow_similar(texts, 0.8)


@pytest.mark.parametrize("how", [{}, {"shingle": 5, "similarity": 0.8}])
def test_keep_first_where_texts_share_an_id(spark, how):
    """One row of each component, whatever its id names elsewhere."""
    a, b, c = ("first of the texts here", "quite another one it is", "a third text with no copy")
    for rows, wanted in (
        ([(1, a), (1, b)], [(1, a), (1, b)]),
        ([(0, a), (1, a), (1, b)], [(0, a), (1, b)]),
        ([(1, a), (1, b), (2, b), (2, c), (None, c), (None, a)], [(1, a), (1, b), (2, c)]),
    ):
        kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string"), **how).collect()
        assert sorted(map(tuple, kept)) == wanted


@pytest.mark.parametrize("n", [1, 4, 5, 8, 13, 30, 70, 90, 300, 1000])
def test_similar_sets_meet_and_tally(n):
    """Two sets at the similarity share a list of the positional index and the least number of positional bytes."""
    rng = np.random.default_rng(n)
    classes = simhash.size_classes(0.8)
    most = np.array([c.most for c in classes])
    drop = add = 0
    while n - drop >= 0.8 * (n + add):
        drop, add = (drop + 1, add) if drop <= add else (drop, add + 1)
    drop, add = (drop - 1, add) if drop > add else (drop, add - 1)
    for _ in range(200):
        a = rng.integers(0, 1 << 64, n, np.uint64)
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 64, add, np.uint64)])
        held = []
        for x in (a, b):
            own = int(np.searchsorted(most, len(x)))
            keys, marks = simhash.positional([x, x], np.array([own, own + 1]), 0.8)
            held.append({own + i: (set(keys[i].tolist()), marks[i]) for i in (0, 1)})
        met = [c for c in held[0].keys() & held[1].keys() if held[0][c][0] & held[1][c][0]]
        assert met
        assert all((held[0][c][1] == held[1][c][1]).sum() >= classes[c].least for c in met)


def test_positions_hold_simhashes():
    """Each position's content is the majority of its own shingles, also of very many."""
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 64, 3000, np.uint64)
    starts = np.array([0, 1, 256, 258, 1400])
    held = np.diff(starts, append=len(hashes))
    votes = simhash._votes(hashes, starts, held)
    for found, a, n in zip(votes.tolist(), starts, held, strict=True):
        assert found == [sum(h >> b & 1 for h in hashes[a : a + n].tolist()) for b in range(63, -1, -1)]


def test_stage_goes_through_the_positional_index(spark, words, monkeypatch):
    """Without lists, or with a tally that none reaches, no near copy is found."""
    import corpus_pipeline

    texts = near_copies(words)[:100]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert len(slow_similar(texts, 0.8)) == 60
    monkeypatch.setattr(simhash, "_tallied", lambda pairs, marks, similarity: pairs.select("a", "b").where("false"))
    assert corpus_pipeline.near_dedup(spark, frame, "").count() == 100
