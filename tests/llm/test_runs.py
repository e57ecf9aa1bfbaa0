import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tallymill.llm import queries as llm
from tallymill.llm import runs
from tallymill.llm.common import read

SF = "/root/testdata/sf0.001"


def slow_runs(ids):
    """Every period at every place."""
    ids, out = np.array(ids, np.int64), []
    for q in range(1, len(ids) // 3 + 1):
        same = np.concatenate(([0], (ids[:-q] == ids[q:]).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(same))
        for b, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - b + q >= max(24, 3 * q):
                part = ids[b : e + q]
                if not any((part[:-p] == part[p:]).all() for p in range(1, q)):
                    out.append((b, e - b + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    kinds, ids = rng.choice([1, 2, 2, 3, 5, 20]), []
    while len(ids) < rng.choice([30, 80, 200, 400]):
        choice = rng.random()
        if choice < 0.5:
            p = rng.randint(1, rng.choice([3, 10, 40]))
            period = [rng.randrange(kinds) for _ in range(p)]
            if rng.random() < 0.3 and p > 2:
                period = (period[: p // 2] * 4)[:p] + period[:1]
            ids += [period[i % len(period)] for i in range(rng.randint(1, p * rng.randint(3, 8)))]
        elif choice < 0.7 and ids:
            at = rng.randrange(len(ids))
            ids += ids[at : at + rng.randint(1, 60)]
        else:
            ids += [rng.randrange(kinds) for _ in range(rng.randint(1, 10))]
    return ids


def test_runs_as_every_period_at_every_place():
    rng = random.Random(11)
    found = 0
    for _ in range(800):
        ids = repetitive(rng)
        wanted = slow_runs(ids)
        assert runs.runs_of(ids) == wanted, ids
        found += len(wanted)
    assert found > 400


def test_grammar_spells_the_text():
    rng = random.Random(12)
    for _ in range(200):
        ids = repetitive(rng)
        base = max(ids) + 1
        rules, seq, starts = runs.grammar(ids, base)

        def spell(symbol):
            return [symbol] if symbol < base else [w for part in rules[symbol - base] for w in spell(part)]

        assert [w for s in seq for w in spell(s)] == ids
        at = 0
        for s, start in zip(seq, starts, strict=True):
            assert start == at
            at += len(spell(s))
        # nothing is left that occurs twice without overlap
        last = {}
        for i, pair in enumerate(zip(seq, seq[1:], strict=False)):
            assert last.setdefault(pair, i) in (i, i - 1)


@pytest.mark.parametrize(("ids", "wanted"), [([], []), ([7] * 23, []), ([7] * 24, [(0, 24, 1)]), (list(range(8)) * 3, [(0, 24, 8)]), (list(range(9)) * 3 + [0], [(0, 28, 9)])])
def test_shortest_runs(ids, wanted):
    assert runs.runs_of(ids) == wanted


def test_long_periodic_texts():
    """Near linear: one word, a long period, a line between strangers, a Fibonacci word."""
    n = 100_000
    assert runs.runs_of([0] * n) == [(0, n, 1)]
    assert runs.runs_of(list(range(n // 4)) * 4) == [(0, n, n // 4)]
    rng = random.Random(13)
    lines = [w for _ in range(4000) for w in [*range(12), *[20 + rng.randrange(10**9) for _ in range(9)]]]
    assert runs.runs_of(lines) == []
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    assert all(length >= 3 * q for _, length, q in runs.runs_of(b))


def with_tail(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_on_whole_table(spark):
    given = {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}
    found = {r.doc_id: r for r in llm.op13_periodic_runs(spark, SF).collect()}
    assert set(found) == set(given)
    several = 0
    for key, text in given.items():
        words = with_tail(key, (text or "").encode().split())
        number = {}
        wanted = slow_runs([number.setdefault(w, len(number)) for w in words])
        r = found[key]
        assert r.n_runs == len(wanted)
        several += len(wanted)
        best = min(wanted, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if wanted else None)
        kept = [w for i, w in enumerate(words) if not any(b + q <= i < b + n for b, n, q in wanted)]
        assert r.runs_sha256 == hashlib.sha256("".join(f"{b},{n},{q}\n" for b, n, q in wanted).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
    assert several > 10


def test_strongest_run_compares_exactly(spark):
    rows = spark.createDataFrame([([(5, 31, 10), (1, 28, 9), (9, 28, 9)],), ([],), ([(4, 2**30, 2**28), (3, 2**30 + 1, 2**28)],)], "runs array<struct<start bigint, length bigint, period bigint>>")
    found = [r.best for r in rows.select(runs.strongest(rows.runs).alias("best")).collect()]
    assert [b and tuple(b) for b in found] == [(1, 28, 9), None, (3, 2**30 + 1, 2**28)]


def test_odd_documents(docs, no_docs, odd_texts):
    found = runs.detect(docs).collect()
    assert len(found) == docs.count()
    by_text = {}
    for r in found:
        assert r.n_words >= 0 and r.collapsed is not None
        by_text.setdefault((r.n_words, r.collapsed), set()).add(tuple(map(tuple, r.runs)))
    assert all(len(x) == 1 for x in by_text.values())
    assert runs.detect(no_docs).collect() == []
    tails = runs.with_periodic_tails(docs).collect()
    assert len(tails) == docs.count() and {r.text for r in tails if r.doc_id is None} == {odd_texts[-1], None}
    assert runs.with_periodic_tails(no_docs).collect() == []
