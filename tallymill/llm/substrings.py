r"""Words of passages that occur again, removed: count-min sketches first, exact counts of the rest.

A window is ``WINDOW`` consecutive words of one text. Every word covered by a window whose words
also start anywhere else is removed; windows are judged on the input. Steps:

1. The texts are written once, dealt into parts of about ``PART_BYTES``, bucketed by part: later steps read
   a part in one task without shuffling a text again.
2. Each part takes the hash of every window, reduced to the different ones. The sketch has as many
   shards as the input has ``SHARD_BYTES``, and each shard ``DEPTH`` rows of counters, at least
   ``LOAD`` times as many as it gets entries, so it grows with the input and fills nowhere.
   A part sends a shard 32 bits of each of its hashes and whether it saw that hash more than once; that
   is the part's sketch of the shard in sparse form. The shard merges the sketches of all parts
   and answers each of them with one bit per hash: whether the estimate, which is never too low, is 2 or more.
3. Only windows estimated repeated are counted exactly, by the 128-bit digest of their words, in the
   same way: each part sends its different digests, dealt by digest, and gets one bit back for each.
4. Each part removes the words that its repeated windows cover.

A window that is repeated everywhere costs each part one entry, so no shard depends on how often. A long
text is one part of its own; its windows are numbers of 8 bytes. Nothing goes through the driver but
the size of the input.

Defined cases: words are runs of anything but ASCII white space, told apart by case; a NULL or empty text has no
words and the kept text ''; rows repeated are copies of each other, so all their windows are repeated; ids
may be NULL, repeated and of any type; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from tallymill.llm.common import SLICE_ROWS
from tallymill.session import new_path, write_once

WINDOW = 35
PART_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
DEPTH = 2
LOAD = 4
#: Bytes hashed at a time, and words longer than that are hashed by themselves.
STEP = 1 << 20
#: Spark's own limit of buckets; beyond it a bucket holds several parts, one after another.
BUCKETS = 100_000

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_ROWS = np.array([0x9E3779B1, 0x85EBCA77], np.uint32)
_FLAGS = "part bigint, step int, shard bigint, bits binary"


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.empty(max(1, n), np.uint64)
    out[0], have = 1, 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(factor, have, 1 << 64))
        have += more
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


class Part:
    """The words of a part's texts, one after another, and the hashes of its windows."""

    def __init__(self, texts: pa.ChunkedArray, window: int = WINDOW):
        words, plain = [], []
        for at in range(0, len(texts), SLICE_ROWS):
            for text in texts.slice(at, SLICE_ROWS).to_pylist():
                some = b" ".join((text or "").encode().split())
                words.append(some.count(b" ") + 1 if some else 0)
                if some:
                    plain.append(some)
        self.words = np.array(words, np.int64)
        self.text = b" ".join(plain)
        self.window = window
        gaps = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32)
        self.starts = np.concatenate(([0], gaps + 1)) if self.text else np.zeros(0, np.int64)
        self.stops = np.concatenate((gaps, [len(self.text)])) if self.text else np.zeros(0, np.int64)
        #: The first words of the windows.
        ends = np.cumsum(self.words)
        last = np.repeat(ends, self.words) - window
        self.at = np.flatnonzero(np.arange(len(self.starts)) <= last)

    def hashes(self) -> np.ndarray:
        """One per window."""
        own = _mixed(self._word_hashes())
        prefix = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * _powers(_FACTOR, len(own))[: len(own)], out=prefix[1:])
        return _mixed((prefix[self.at + self.window] - prefix[self.at]) * _powers(_INVERSE, len(own))[self.at])

    def _word_hashes(self) -> np.ndarray:
        n = len(self.starts)
        own = np.zeros(n, np.uint64)
        raw = np.frombuffer(self.text, np.uint8)
        power, inverse = _powers(_FACTOR, 2 * STEP), _powers(_INVERSE, 2 * STEP)
        long = np.flatnonzero(self.stops - self.starts > STEP).tolist()
        for i in long:
            own[i] = xxh3_64_intdigest(self.text[self.starts[i] : self.stops[i]])
        for a, b in zip([0, *[i + 1 for i in long]], [*long, n], strict=True):
            while a < b:
                base = int(self.starts[a])
                upto = min(b, int(np.searchsorted(self.starts, base + STEP)))
                size = int(self.stops[upto - 1]) - base
                prefix = np.zeros(size + 1, np.uint64)
                np.cumsum((raw[base : base + size].astype(np.uint64) + np.uint64(1)) * power[:size], out=prefix[1:])
                first, last = self.starts[a:upto] - base, self.stops[a:upto] - base
                own[a:upto] = (prefix[last] - prefix[first]) * inverse[first]
                a = upto
        return own

    def digests(self, some: np.ndarray) -> np.ndarray:
        """Two numbers for the words of each of ``some`` windows."""
        first, last = self.starts[self.at[some]].tolist(), self.stops[self.at[some] + self.window - 1].tolist()
        text = memoryview(self.text)
        raw = b"".join([xxh3_128_digest(text[a:b]) for a, b in zip(first, last, strict=True)])
        return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)

    def without(self, repeated: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """n_words, n_removed and the kept text of each text, if ``repeated`` windows go."""
        edge = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(edge, self.at[repeated], 1)
        np.add.at(edge, self.at[repeated] + self.window, -1)
        keep = np.cumsum(edge[:-1]) == 0
        at = 0
        for n in self.words.tolist():
            mine = keep[at : at + n]
            kept = int(mine.sum())
            text = self.text[self.starts[at] : self.stops[at + n - 1]] if n else b""
            if kept < n:
                words = text.split(b" ")
                text = b" ".join([words[i] for i in np.flatnonzero(mine).tolist()])
            yield n, n - kept, text.decode()
            at += n


def _dealt(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ascending 64-bit keys the shards they go to, and each shard's first and last place."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    if not len(shard):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    return shard[first].astype(np.int64), first, np.append(first[1:], len(keys))


def _sent(part: int, keys: np.ndarray, load: np.ndarray, times: np.ndarray, shards: int) -> pa.Table:
    """A row for each shard that gets some of the ascending keys."""
    rows = [(s, load[a:b].tobytes(), np.packbits(times[a:b] > 1).tobytes()) for s, a, b in zip(*_dealt(keys, shards), strict=True)]
    return pa.table(
        {
            "part": pa.array(np.full(len(rows), part, np.int64)),
            "shard": pa.array([r[0] for r in rows], pa.int64()),
            "load": pa.array([r[1] for r in rows], pa.binary()),
            "twice": pa.array([r[2] for r in rows], pa.binary()),
        }
    )


def _answers(rows: pa.Table, step: int, found: list[np.ndarray]) -> pa.Table:
    return pa.table(
        {
            "part": rows["part"],
            "step": pa.array(np.full(rows.num_rows, step, np.int32)),
            "shard": rows["shard"],
            "bits": pa.array([np.packbits(f).tobytes() for f in found], pa.binary()),
        }
    )


def _flags(answers: pa.Table, step: int, keys: np.ndarray, shards: int) -> np.ndarray:
    """The answers to ascending keys."""
    of = {s: bits for s, k, bits in zip(*[answers[c].to_pylist() for c in ("shard", "step", "bits")], strict=True) if k == step}
    flags = np.zeros(len(keys), bool)
    for s, a, b in zip(*_dealt(keys, shards), strict=True):
        flags[a:b] = np.unpackbits(np.frombuffer(of[s], np.uint8), count=b - a)
    return flags


def merged_estimates(cells: list[np.ndarray], times: list[np.ndarray]) -> list[np.ndarray]:
    """Count-min estimates of each sketch's entries once all sketches are merged."""
    total = sum(map(len, cells))
    bits = max(10, int(LOAD * total).bit_length())
    shift = np.uint32(32 - min(32, bits))
    sketch = np.zeros((DEPTH, 1 << min(32, bits)), np.uint32)
    for row, factor in zip(sketch, _ROWS, strict=True):
        for c, t in zip(cells, times, strict=True):
            np.add.at(row, (c * factor) >> shift, t.astype(np.uint32))
    return [np.min([row[(c * factor) >> shift] for row, factor in zip(sketch, _ROWS, strict=True)], axis=0) for c in cells]


def _estimate(rows: pa.Table) -> pa.Table:
    """One shard: merge the parts' sketches and answer which entries have an estimate of 2 or more."""
    cells = [np.frombuffer(x, np.uint32) for x in rows["load"].to_pylist()]
    times = [1 + np.unpackbits(np.frombuffer(x, np.uint8), count=len(c)) for x, c in zip(rows["twice"].to_pylist(), cells, strict=True)]
    return _answers(rows, 0, [e >= 2 for e in merged_estimates(cells, times)])


def _exact(rows: pa.Table) -> pa.Table:
    """One shard of digests: which of them occur twice, in two parts or in one."""
    digests = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in rows["load"].to_pylist()]
    times = [1 + np.unpackbits(np.frombuffer(x, np.uint8), count=len(d)) for x, d in zip(rows["twice"].to_pylist(), digests, strict=True)]
    every = np.concatenate(digests)
    order = np.lexsort((every[:, 1], every[:, 0]))
    ordered = every[order]
    first = np.flatnonzero(np.append(True, (ordered[1:] != ordered[:-1]).any(axis=1)))
    total = np.add.reduceat(np.concatenate(times).astype(np.int64)[order], first)
    twice = np.empty(len(every), bool)
    twice[order] = np.repeat(total > 1, np.diff(np.append(first, len(every))))
    cuts = np.cumsum([len(d) for d in digests])[:-1]
    return _answers(rows, 1, np.split(twice, cuts))


def _different(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different digests in order, which of them each one is, and how often each occurs."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    ordered = digests[order]
    first = np.append(True, (ordered[1:] != ordered[:-1]).any(axis=1)) if len(order) else np.zeros(0, bool)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(first) - 1
    return ordered[first], which, np.diff(np.append(np.flatnonzero(first), len(order)))


def _write_parts(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """part, doc_id, text, bucketed by part, and the bytes of all texts."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = PART_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(at, SLICE_ROWS)
                lengths = np.array([len(t) if t else 0 for t in some.column(1).to_pylist()], np.int64)
                before = done + np.cumsum(lengths) - lengths
                done += int(lengths.sum())
                yield pa.RecordBatch.from_arrays([pa.array((task << 32) + before // most), *some.columns], ["part", "doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.mapInArrow(run, f"part bigint, doc_id {kind}, text string")
    name = f"tallymill_parts_{uuid.uuid4().hex}"
    buckets = min(BUCKETS, 2 * (size // PART_BYTES) + 8)
    dealt.write.bucketBy(buckets, "part").option("path", new_path(spark, "parts")).format("parquet").saveAsTable(name)
    return spark.table(name), size


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and text (the kept words, one space between), one row per row of ``df``.

    A task needs about 20 times ``PART_BYTES`` or ``SHARD_BYTES``; with larger executors both may grow, which
    makes the rows between parts and shards fewer (their number is the product of both numbers).
    """
    parts, size = _write_parts(df, id_col, text_col)
    shards = 1 + size // SHARD_BYTES

    def sketch(rows: pa.Table) -> pa.Table:
        keys, times = np.unique(Part(rows["text"], window).hashes(), return_counts=True)
        return _sent(rows["part"][0].as_py(), keys, (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), times, shards)

    def likely(part: Part, answers: pa.Table) -> np.ndarray:
        """The windows with an estimate of 2 or more."""
        keys, which = np.unique(part.hashes(), return_inverse=True)
        return np.flatnonzero(_flags(answers, 0, keys, shards)[which])

    def digest(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _sent(0, np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64), np.zeros(0), shards)
        part = Part(rows["text"], window)
        found, _, times = _different(part.digests(likely(part, answers)))
        return _sent(rows["part"][0].as_py(), found[:, 0], found, times, shards)

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        part = Part(rows["text"], window)
        some = likely(part, answers)
        found, which, _ = _different(part.digests(some))
        kept = list(part.without(some[_flags(answers, 1, found[:, 0], shards)[which]]))
        columns = zip(*kept, strict=True) if kept else ([], [], [])
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.table([rows["doc_id"], *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_words", "n_removed", "text"])

    sent = "part bigint, shard bigint, load binary, twice binary"
    estimates = write_once(parts.groupBy("part").applyInArrow(sketch, sent).groupBy("shard").applyInArrow(_estimate, _FLAGS), "estimates")
    digests = parts.groupBy("part").cogroup(estimates.groupBy("part")).applyInArrow(digest, sent)
    answers = estimates.unionByName(write_once(digests.groupBy("shard").applyInArrow(_exact, _FLAGS), "repeated"))
    kind = parts.schema["doc_id"].dataType.simpleString()
    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        remove, f"doc_id {kind}, n_words bigint, n_removed bigint, text string"
    )
