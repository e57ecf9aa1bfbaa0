import random

import pytest

from tallymill.llm import unigram
from tallymill.llm.tokens import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


def all_segmentations(word, pieces):
    """(score, tokens) of every way to cut a word, in the order of its cuts."""
    if not word:
        yield 0.0, 0
        return
    for end in range(1, len(word) + 1):
        head = word[:end]
        own = [(pieces.scores_of[head], 1)] if head in pieces.scores_of else []
        if end == 1:
            own.append((pieces.worst * len(head.encode()), len(head.encode())))
        for score, n in own:
            for rest, more in all_segmentations(word[end:], pieces):
                yield score + rest, n + more


def slow_count(word, pieces):
    found = list(all_segmentations(word, pieces))
    top = max(s for s, _ in found)
    return min(n for s, n in found if abs(s - top) < 1e-9)


@pytest.mark.parametrize("scores", ["zipf", "file"])
def test_counts_as_over_all_segmentations(words, scores):
    pieces = unigram.load(PATH, scores)
    short = sorted({unigram.MARK + w[:9] for w in words[:150]}) + ["▁", "▁漢字é😀", "▁xq\x00z", "▁▁a"]
    found = unigram.count_words(short, pieces)
    assert found == {w: slow_count(w, pieces) for w in short}


def test_trie_and_loop_agree(words, monkeypatch):
    pieces = unigram.load(PATH)
    rng = random.Random(5)
    many = [unigram.MARK + "".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(300)] + [unigram.MARK + "x" * 299, unigram.MARK + "z" * 5000]
    found = unigram.count_words(many, pieces)
    assert all(found[w] == unigram.count_one(w, pieces) for w in many)
    assert unigram.count_words([], pieces) == {}


def test_odd_documents(docs, no_docs, monkeypatch):
    pieces = unigram.load(PATH)
    rows = unigram.count_tokens(docs, PATH).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    for r in rows:
        if r.doc_id is not None and r.doc_id != 8:
            own = (texts[r.doc_id] or "").encode().split()
            assert r.n_words == len(own)
            assert r.n_tokens == sum(unigram.count_one(unigram.MARK + w.decode(), pieces) for w in own)
    assert unigram.count_tokens(no_docs, PATH).collect() == []
