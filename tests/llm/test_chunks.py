import hashlib
import random

import pytest

from tallymill.llm import chunks


def slow_ends(raw):
    """Byte by byte."""
    out, begin, h = [], 0, 0
    for i, b in enumerate(raw):
        h = ((h << 1) + int(chunks._GEAR[b])) % (1 << 32)
        length = i + 1 - begin
        mask = int(chunks._STRICT) if length < chunks.USUAL else int(chunks._LOOSE)
        if length >= chunks.MOST or (length >= chunks.LEAST and h & mask == 0):
            out.append(i + 1)
            begin = i + 1
    return out + ([len(raw)] if begin < len(raw) else [])


def test_chunks_as_byte_by_byte(odd_texts):
    for text in [t or "" for t in odd_texts] + ["a" * 700, "ab" * 13]:
        raw = text.encode()[:30_000]
        assert chunks.ends(raw) == slow_ends(raw)


def test_likeness(odd_texts):
    long = odd_texts[-2]
    own = chunks.entries(long)
    assert chunks.likeness(own, own) == 1 and chunks.likeness(own, chunks.entries("")) == 0
    assert chunks.likeness(chunks.entries(""), chunks.entries("")) == 1 and chunks.likeness(chunks.entries(""), own) == 0
    shifted = chunks.entries("a new beginning " + long)
    assert chunks.likeness(own, shifted) > 0.9
    assert chunks.likeness(own, chunks.entries(long[: len(long) // 2])) == pytest.approx(0.5, abs=0.1)
    assert chunks.parsed(chunks.written(own)).tolist() == own.tolist()


@pytest.mark.parametrize("range_rows", [8000, 3])
def test_neighbours(docs, no_docs, monkeypatch, range_rows, spark):
    monkeypatch.setattr(chunks, "RANGE_ROWS", range_rows)
    found = chunks.with_neighbours(docs).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert len(found) == len(rows)
    plain = sorted({r.doc_id: r for r in docs.where("doc_id is not null and doc_id <> 8").collect()}.items(), reverse=True)
    by_id = {r.doc_id: r for r in found}
    for (doc_id, own), (next_id, following) in zip(plain, plain[1:], strict=False):
        if doc_id - next_id == 1:
            changed = chunks.edited(own.text or "", following.text or "")
            r = by_id[doc_id]
            assert r.n_chars == len(own.text or "")
            assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            assert r.fingerprint == chunks.written(chunks.entries(own.text or ""))
            assert r.edited_fingerprint == chunks.written(chunks.entries(changed))
            assert r.near_next == chunks.likeness(chunks.entries(own.text or ""), chunks.entries(following.text or ""))
    # every row is the successor of one row: all edited texts of a permutation
    assert chunks.with_neighbours(no_docs).collect() == []
    one = spark.createDataFrame([(5, "only one document here")], "doc_id bigint, text string")
    assert chunks.with_neighbours(one).first().near_next == 1.0


def test_the_ring_is_closed(spark, monkeypatch):
    """Over many small ranges: the successor of the lowest id is the highest, and no link is lost."""
    monkeypatch.setattr(chunks, "RANGE_ROWS", 7)
    rng = random.Random(11)
    ids = [*rng.sample(range(-500, 5000), 200), *range((1 << 60), (1 << 60) + 30)]
    texts = {i: f"{i} " + "".join(rng.choices("abcdef ", k=60)) for i in ids}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    order = sorted(ids, reverse=True)
    wanted = {i: hashlib.sha256(chunks.edited(texts[i], texts[j]).encode()).hexdigest() for i, j in zip(order, order[1:] + order[:1], strict=True)}
    assert {r.doc_id: r.edited_sha256 for r in chunks.with_neighbours(frame).collect()} == wanted
