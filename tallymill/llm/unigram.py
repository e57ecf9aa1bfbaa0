"""Token counts under a unigram model, by dynamic programming over a trie of words.

A text's tokens are those of its words (maximal runs without white space), each after the word mark.
A word's tokens are the segmentation into vocabulary pieces with the highest sum of scores and, of
those that tie, the fewest pieces; a character that no piece covers costs its bytes. The distinct
words of a slice of documents are put into a trie, and the forward scores are computed once per
shared prefix, level by level in whole arrays: a node takes over its parent's open pieces, moves
each along the pieces' own trie, and keeps the best score and count at which a piece can end. The
counts at the terminal nodes are stored per word, and a document's count is a sum over its words.

Scores are those of a Zipf distribution over the ranks in the vocabulary file (``log(1 / (rank +
1))``), as the file's own scores are merge ranks and no probabilities; ``scores="file"`` takes the
file's. Words are remembered by a worker process up to a fixed number.

Nothing is shuffled and no word leaves its task; memory is bounded by the slice and by
``REMEMBERED``. A word of over ``LONG`` characters is scored on its own in a loop.

Defined cases: a NULL or empty text has no words and no tokens; repeated rows are counted each time;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
REMEMBERED = 600_000
LONG = 300
SLICE_ROWS = 2048
#: A byte of a character without a piece costs this much more than the worst piece.
PENALTY = 10.0


class Pieces:
    """A vocabulary as a trie: transitions by sorted (state, character), and a score per state (-inf: no piece ends)."""

    def __init__(self, pieces: dict[str, float]):
        self.scores_of = pieces
        self.worst = min(pieces.values()) - PENALTY
        self.longest = max(map(len, pieces))
        states: dict[tuple[int, str], int] = {}
        terminal: dict[int, float] = {}
        for piece, score in pieces.items():
            at = 0
            for c in piece:
                at = states.setdefault((at, c), len(states) + 1)
            terminal[at] = score
        keys = np.array([q << 21 | ord(c) for q, c in states], np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.array(list(states.values()), np.int64)[order]
        self.score = np.full(len(states) + 1, -np.inf)
        for state, score in terminal.items():
            self.score[state] = score

    def move(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states after a character; 0 where there is none."""
        wanted = state << 21 | char
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.targets[at], 0)


def load(path: str, scores: str = "zipf") -> Pieces:
    """The pieces of a sentencepiece file but its control, byte and unused ones."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = -log(len(pieces) + 1) if scores == "zipf" else model.get_score(i)
    return Pieces(pieces)


def _utf8_size(char: np.ndarray) -> np.ndarray:
    return 1 + (char >= 0x80).astype(np.int64) + (char >= 0x800) + (char >= 0x10000)


def count_one(word: str, pieces: Pieces) -> int:
    """Of a long word, start by start."""
    n, known = len(word), pieces.scores_of
    best, count = [0.0] + [-np.inf] * n, [0] * (n + 1)
    for start in range(n):
        size = len(word[start].encode())
        for end, score, more in [
            (start + 1, pieces.worst * size, size),
            *((e, known[p], 1) for e in range(start + 1, min(n, start + pieces.longest) + 1) if (p := word[start:e]) in known),
        ]:
            total, tokens = best[start] + score, count[start] + more
            if total > best[end] or (total == best[end] and tokens < count[end]):
                best[end], count[end] = total, tokens
    return count[n]


def count_words(words: list[str], pieces: Pieces) -> dict[str, int]:
    """Tokens of each distinct word; the word mark in front is part of it."""
    counts = {w: count_one(w, pieces) for w in words if len(w) > LONG}
    words = sorted({w for w in words if 0 < len(w) <= LONG})
    if not words:
        return counts
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    # words that are longer than the depth, in order; the trie node of each
    alive = np.arange(len(words))
    node = np.zeros(len(words), np.int64)
    best, count = np.zeros(1), np.zeros(1, np.int64)
    # open pieces: where those of node i begin, their state, and score and count before them
    begin, state = np.zeros(2, np.int64), np.zeros(0, np.int64)
    before, before_count = np.zeros(0), np.zeros(0, np.int64)
    result = np.zeros(len(words), np.int64)
    for depth in range(int(sizes.max())):
        longer = sizes[alive] > depth
        alive, node = alive[longer], node[longer]
        char = chars[first[alive] + depth]
        new = np.ones(len(alive), bool)
        new[1:] = (node[1:] != node[:-1]) | (char[1:] != char[:-1])
        parent, own = node[new], char[new]
        node = np.cumsum(new) - 1
        # the parent's open pieces, and a piece that begins here
        held = begin[parent + 1] - begin[parent]
        child = np.repeat(np.arange(len(parent)), held + 1)
        start = np.cumsum(held + 1) - (held + 1)
        inside = np.arange(len(child)) - start[child]
        fresh = inside == held[child]
        take = np.where(fresh, 0, begin[parent[child]] + inside)
        if len(state):
            from_state = np.where(fresh, 0, state[take])
            base = np.where(fresh, best[parent[child]], before[take])
            base_count = np.where(fresh, count[parent[child]], before_count[take])
        else:
            from_state, base, base_count = np.zeros(len(child), np.int64), best[parent[child]], count[parent[child]]
        moved = pieces.move(from_state, own[child])
        total = np.where(moved > 0, base + pieces.score[moved], -np.inf)
        top = np.maximum.reduceat(total, start)
        size = _utf8_size(own)
        by_bytes, bytes_count = best[parent] + pieces.worst * size, count[parent] + size
        high = np.maximum(top, by_bytes)
        fewest = np.minimum.reduceat(np.where(total == high[child], base_count + 1, 1 << 60), start)
        fewest = np.minimum(fewest, np.where(by_bytes == high, bytes_count, 1 << 60))
        best, count = high, fewest
        going = moved > 0
        state, before, before_count = moved[going], base[going], base_count[going]
        begin = np.concatenate(([0], np.cumsum(np.bincount(child[going], minlength=len(parent)))))
        ended = sizes[alive] == depth + 1
        result[alive[ended]] = count[node[ended]]
    counts.update(zip(words, result.tolist(), strict=True))
    return counts


_loaded: dict[tuple[str, str], tuple[Pieces, dict[bytes, int]]] = {}


def _worker(path: str, scores: str) -> tuple[Pieces, dict[bytes, int]]:
    if (path, scores) not in _loaded:
        _loaded[path, scores] = (load(path, scores), {})
    return _loaded[path, scores]


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", scores: str = "zipf") -> DataFrame:
    """doc_id, n_words, n_tokens, one row per row of ``df``."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = _worker(path, scores)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                words = [t.encode().split() for t in part.column(1).to_pylist()]
                if len(known) > REMEMBERED:
                    known.clear()
                fresh = {MARK + w.decode(): w for w in set().union(*words).difference(known)}
                for word, n in count_words(list(fresh), pieces).items():
                    known[fresh[word]] = n
                totals = [sum([known[w] for w in ws]) for ws in words]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, words), pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "n_words", "n_tokens"]
                )

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint")
