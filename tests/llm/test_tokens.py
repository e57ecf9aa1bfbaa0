import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymill.llm import packing, rangecoder, tokenfile, tokens
from tallymill.session import new_path

PATH = tokens.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


ODD = [
    "a,b. c.,! d(e) f_g h's i-j ÄÖ.. ß! µ ª º ×÷ É.", "<|x|> <|EndOfText|><|endoftext|>y", 'a`b a\\b <a> "q"', "7 x 7 y a7b",
    "K Å å Ǆ ẞ ﬁ Σς", "!!\x1c!! a\x85b\xa0c​d", "H̱ ẖ Å", "'s 't we'LL don't", "", "  ",
]


def test_ids_are_the_librarys(library, odd_texts):
    coder = tokens.Encoder(PATH)
    assert coder.by_word
    texts = [t or "" for t in odd_texts] + ODD
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert got == library(text).tobytes(), text[:50]


def test_forgetting_changes_nothing(library, monkeypatch, words):
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    coder = tokens.Encoder(PATH)
    for i in range(0, 400, 40):
        text = " ".join(words[i : i + 40])
        assert coder.encode([text])[0] == library(text).tobytes()


def test_pieces_are_cut_as_by_the_library(library, monkeypatch):
    rng = random.Random(4)
    signs = ["a", "b", "Z", "é", "É", "×", "÷", "ß", "ÿ", "ñ", "\u0331", "ж", "字", "9", ".", ",", "'", "'s", "<|", "`", " ", " ", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "\0"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(600)]
    for group in (1, 500, 1 << 22):
        monkeypatch.setattr(tokens, "GROUP_CHARS", group)
        for text, got in zip(texts, tokens.Encoder(PATH).encode(texts), strict=True):
            assert got == library(text).tobytes(), repr(text)
    assert tokens.Encoder(PATH).encode([]) == [] and tokens.Encoder(PATH).encode(["", " \n"]) == [b"", b""]


def test_a_full_memory_keeps_what_came_last(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    coder, calls = tokens.Encoder(PATH), []

    class Model:
        def tokenize(self, part, own=coder.model):
            calls.append(part)
            return own.tokenize(part)

    coder.model = Model()
    first, second = (" ".join(f"{c}{d}" for d in "abcdefghijklmno") for c in "xy")
    wanted = coder.encode([first])
    coder.encode([second])
    assert len(calls) == 30
    # neither a sign behind a word nor its case makes it a new piece
    assert coder.encode([first, first.upper()]) == wanted * 2 and len(coder.encode([second.replace(" ", ", ")])[0]) > 0
    assert calls[30:] == [","]


def test_other_tokenizers_go_text_by_text():
    coder = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    assert not coder.by_word
    assert len(coder.encode(["two  spaces", ""])[1]) == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, rangecoder.MOST_ID + 1, n).astype(np.uint32) for n in (1, 3, 700, 700, 2)]
    blocks += [np.zeros(4096, np.uint32), np.full(300, rangecoder.MOST_ID, np.uint32), np.arange(4096, dtype=np.uint32)]
    blocks += [np.minimum(rng.zipf(1.3, 4096), 49407).astype(np.uint32)]
    coded = rangecoder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, rangecoder.decode(coded), strict=True))
    # a block does not depend on its group
    assert [rangecoder.encode([b])[0] for b in blocks] == coded
    assert len(coded[5]) < 200 and len(coded[-1]) < 2 * 4096
    assert rangecoder.encode([]) == [] and rangecoder.decode([]) == []


def test_carries_round_trip():
    """Long runs of the last symbol push the code to its upper end."""
    rng = np.random.default_rng(6)
    for _ in range(30):
        block = np.where(rng.random(2000) < 0.97, rangecoder.MOST_ID, rng.integers(0, 9, 2000)).astype(np.uint32)
        assert np.array_equal(rangecoder.decode(rangecoder.encode([block]))[0], block)


def test_damage_is_noticed():
    coded = bytearray(rangecoder.encode([np.arange(500, dtype=np.uint32)])[0])
    coded[40] ^= 1
    with pytest.raises(ValueError):
        rangecoder.decode([bytes(coded)])
    with pytest.raises(ValueError):
        rangecoder.decode([b"not"])
    with pytest.raises(ValueError):
        rangecoder.encode([np.array([rangecoder.MOST_ID + 1], np.uint32)])


def test_joined_checksums():
    a, b = b"alpha" * 13, b"\x00beta" * 999
    assert rangecoder.join_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert rangecoder.join_crc32(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


def test_joining_makes_no_polynomials_anew(monkeypatch):
    whole = bytes(range(256)) * 70
    cuts = [*range(0, 16384, 777), len(whole)]
    join = lambda: [rangecoder.join_crc32(zlib.crc32(whole[:c]), zlib.crc32(whole[c:]), len(whole) - c) for c in cuts]
    assert set(join()) == {zlib.crc32(whole)}
    made, times = [], rangecoder._times
    monkeypatch.setattr(rangecoder, "_times", lambda a, b: made.append(a) or times(a, b))
    assert set(join()) == {zlib.crc32(whole)} and not made


def test_a_context_not_seen_has_the_distribution_of_order_0():
    model = rangecoder._Model(2, 4096)
    model.seen[:300, 0] = 3 * 32 + 7  # row 3 of the first block: always symbol 7
    model.seen[:300, 1] = (8 + 1) * 32 + 20
    model.anew(300, 2)
    total = 1 << 14
    sizes = np.diff(model.starts.astype(int), append=total)
    assert (sizes > 0).all() and (sizes.sum(axis=1) == total).all()
    assert sizes[0, 7] > 0.9 * total and sizes[3, 7] > 0.9 * total and sizes[8, 20] > 0.9 * total
    model.seen[:30, 0] = 3 * 32 + 9
    model.seen[:30, 1] = (8 + 2) * 32 + 20
    model.anew(30, 2)
    sizes = np.diff(model.starts.astype(int), append=total)
    assert sizes[0, 9] > 0.07 * total and sizes[0, 7] > 0.8 * total


def test_blocks_end_about_where_distributions_change():
    rng = np.random.default_rng(7)
    lengths = [1, 15, 16, 17, 32, 33, 511, 512, 513, 1024, 1025, 3583, 3584, 3585, 4095, 4096]
    blocks = [np.minimum(rng.zipf(1.2, n), 60_000).astype(np.uint32) for n in lengths]
    coded = rangecoder.encode(blocks)
    assert [rangecoder.encode([b])[0] for b in blocks] == coded
    assert all(np.array_equal(a, b) for a, b in zip(blocks, rangecoder.decode(coded[::-1])[::-1], strict=True))


@pytest.mark.parametrize("together", [1024, 1])
def test_token_files(spark, docs, no_docs, library, monkeypatch, together):
    monkeypatch.setattr(tokenfile, "TOGETHER", together)
    out = new_path(spark, "token-test")
    tokenfile.write(docs, out, PATH)
    found = sorted(tokenfile.digests(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((r.doc_id for r in docs.select("doc_id").collect()), key=lambda i: (i is not None, i or 0))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
        wanted = [np.append(library(t), np.uint32(1)).astype("<u4") for t in texts[r.doc_id]]
        assert (r.n_tokens, r.ids_crc32) in [(len(w), zlib.crc32(w.tobytes())) for w in wanted]
    empty = new_path(spark, "token-test")
    tokenfile.write(no_docs, empty, PATH)
    assert tokenfile.digests(spark, empty).collect() == []


def slow_tightest(open_windows, need):
    return min((c for c in open_windows if c >= need), default=-1)


def test_best_fit_as_by_hand():
    rng = random.Random(2)
    lengths = [rng.choice([1, 2, 100, 1024, 2047, 2048, rng.randint(1, 2048)]) for _ in range(3000)]
    of, offset, n = packing.best_fit(lengths, 2048)
    open_windows, used = [], 0
    for need in sorted(lengths, reverse=True):
        best = slow_tightest(open_windows, need)
        if best < 0:
            used += 1
            open_windows.append(2048 - need)
        else:
            open_windows.remove(best)
            open_windows.append(best - need)
    assert n == used
    by_window = {}
    for w, o, length in zip(of, offset, lengths, strict=True):
        by_window.setdefault(w, []).append((o, length))
    for pieces in by_window.values():
        at = 0
        for o, length in sorted(pieces):
            assert o == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("group", [1 << 22, 5000])
def test_packing(docs, no_docs, library, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_IDS", group)
    rows = packing.pack(docs, PATH).collect()
    sequences, pieces = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and 0 < r.length <= 2048
        sequences.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    padding = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and {r.padded_length for r in parts} == {at if at & (at - 1) == 0 else 2048}
        padding += parts[0].padded_length - at
    assert padding < 2048 * 12 + 0.03 * sum(r.length for r in rows)
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    for (doc_id, n), parts in pieces.items():
        if doc_id is not None and doc_id != 8:
            whole = b"".join(r.ids for r in sorted(parts, key=lambda r: r.start))
            assert whole == np.append(library(texts[doc_id]), np.uint32(1)).astype("<u4").tobytes() and n == len(whole) // 4
    assert sum(r.length for r in rows) == sum(len(library(r.text)) + 1 for r in docs.collect())
    assert packing.pack(no_docs, PATH).collect() == []


def test_a_task_packs_what_it_reads(docs):
    plan = packing.pack(docs, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert packing.pack(docs, PATH).agg(F.sum("length")).first()[0] > 0
