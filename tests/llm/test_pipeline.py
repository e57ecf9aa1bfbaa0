import os
import sys
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

from tallymill.llm import pii, quality, tokens  # noqa: E402
from tallymill.session import write_once  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave."""
    from tallymill.llm.common import read

    docs, out = read(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = write_once(stage(spark, docs, SF), name)
        out[name] = (given.collect(), docs.collect(), given.columns, docs.columns)
    return out


def test_stages_return_documents(stages):
    assert list(stages) == ["quality", "near_dedup", "pii", "mix", "pack"]
    for name, (_, _, before, after) in stages.items():
        assert name == "pack" or before == after


def test_quality_stage(stages, spark):
    from tallymill.llm.common import read

    given, kept, *_ = stages["quality"]
    labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    assert set(kept) <= set(given)
    ids = {r.doc_id for r in kept}
    good = [r.doc_id in ids for r in given if labels.get(r.doc_id) == 1]
    bad = [r.doc_id in ids for r in given if labels.get(r.doc_id) == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15


def test_dedup_stage(stages):
    """All pairs of sets of five-word shingles."""
    given, kept, *_ = stages["near_dedup"]
    given = sorted(given, key=lambda r: r.doc_id)
    number, sets = {}, []
    for r in given:
        words = r.text.encode().lower().split()
        shingles = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
        sets.append(np.array(sorted({number.setdefault(x, len(number)) for x in shingles})))
    holders = {}
    root = list(range(len(given)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in enumerate(sets):
        shared = Counter(j for x in own.tolist() for j in holders.get(x, ()))
        for j, n in shared.items():
            if n >= 0.8 * (len(own) + len(sets[j]) - n):
                root[max(find(i), find(j))] = min(find(i), find(j))
        for x in own.tolist():
            holders.setdefault(x, []).append(i)
    wanted = [r.doc_id for i, r in enumerate(given) if find(i) == i]
    assert sorted(r.doc_id for r in kept) == wanted and len(wanted) < len(given)


def test_pii_stage(stages, spark):
    given, kept, *_ = stages["pii"]
    model = pii.train(spark.createDataFrame(given))
    wanted = {r.doc_id: pii.redact(r.text, pii.all_spans(r.text, model)[1]) for r in given}
    assert {r.doc_id: r.text for r in kept} == wanted
    assert all(r.n_chars == len(r.text) and not pii.base_spans(r.text)[0] for r in kept)


def test_mix_stage(stages):
    given, kept, *_ = stages["mix"]
    assert set(kept) <= set(given) and len(kept) > len(set(kept))
    before, after = Counter(), Counter()
    for rows, into in ((given, before), (kept, after)):
        for r in rows:
            into[r.source] += len(r.text)
    assert abs(sum(after.values()) / sum(before.values()) - 1) < 0.3


def test_pack_stage(stages):
    given, pieces, *_ = stages["pack"]
    tokenizer = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4").tobytes() for r in given}
    found = Counter()
    for r in pieces:
        assert ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)] == r.ids
        found[r.doc_id] += r.length
    wanted = Counter()
    for r in given:
        wanted[r.doc_id] += len(ids[r.doc_id]) // 4
    assert found == wanted
    windows = {}
    for r in pieces:
        windows[r.sequence_id] = windows.get(r.sequence_id, 0) + r.length
    assert max(windows.values()) <= 2048 and sum(windows.values()) > 0.97 * 2048 * len(windows)


def test_pipeline_of_no_documents(spark):
    from tallymill.llm.common import read

    docs = read(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_run_is_all_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == stages["pack"][3] and rows.count() == len(stages["pack"][1])


def test_models_are_the_same_again(spark):
    from tallymill.llm.common import read

    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    a, b = (quality.train(docs.repartition(n), labels, per_class=50) for n in (2, 5))
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights)
