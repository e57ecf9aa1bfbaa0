r"""Periodic runs of words, found in a grammar of the text instead of the text.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` words and ``TIMES``
periods long, that neither neighbouring word extends. Per text:

1. Words become numbers and Re-Pair compresses them: the most frequent pair of neighbours becomes a new
   symbol, until no pair is left twice. What repeats in the text is a rule once.
2. A run lies in a lowest node of the derivation, where it crosses the boundary between two children.
   So the runs that cross the boundary are computed once per rule, on the rule's first place in the
   text, and once per boundary of the start sequence.
3. Found runs are translated to all places of their rule in the derivation. Stretches of one period
   that overlap by a period or more are the same run, seen in part from several nodes: they are merged.

Periods to try at a boundary come from the four words next to it. A run has half of its length on
one side, so there these ``ANCHOR`` words recur one period away, and the half period behind them as well;
hashes of the text's prefixes compare that for all recurrences at once, words decide. A period that a shorter one
explains is passed over, so a text of one word repeated is not tried at every length.

A text is worked on by itself: a task holds one slice of rows, nothing is shuffled, and a very long text
costs near its length.

Defined cases: words are runs of anything but ASCII white space, told apart by case; a NULL or empty text
has no words, no runs and the collapsed text ''; rows repeated are treated alike; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import SLICE_ROWS

LEAST = 24
TIMES = 3
ANCHOR = 4

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def grammar(ids: list[int], base: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Rules, the start sequence and where each of its symbols begins; symbol ``base + k`` stands for rule k."""
    n = len(ids)
    pairs = list(zip(ids, ids[1:], strict=False))
    times = Counter(pairs)
    places: dict[tuple[int, int], set[int]] = {p: set() for p, c in times.items() if c > 1}
    if not places:
        return [], ids, list(range(n))
    for i, p in enumerate(pairs):
        if p in places:
            places[p].add(i)
    seq, rules = list(ids), []
    after, before = list(range(1, n + 1)), list(range(-1, n))
    waiting = [(-len(at), p) for p, at in places.items()]
    heapify(waiting)
    while waiting:
        count, pair = heappop(waiting)
        found = places.get(pair)
        if found is None:
            continue
        if len(found) != -count:
            # pairs that lost places wait again with the number they have now
            if len(found) > 1:
                heappush(waiting, (-len(found), pair))
            continue
        del places[pair]
        a, b = pair
        new, fresh = base + len(rules), set()
        done = 0
        for i in sorted(found):
            j = after[i]
            if seq[i] != a or j == n or seq[j] != b:
                continue
            left, right = before[i], after[j]
            if left >= 0:
                other = places.get((seq[left], a))
                if other is not None:
                    other.discard(left)
                made = (seq[left], new)
                places.setdefault(made, set()).add(left)
                fresh.add(made)
            if right < n:
                other = places.get((b, seq[right]))
                if other is not None:
                    other.discard(j)
                made = (new, seq[right])
                places.setdefault(made, set()).add(i)
                fresh.add(made)
            seq[i], seq[j] = new, -1
            after[i] = right
            before[right] = i
            done += 1
        if done:
            rules.append(pair)
        for made in fresh:
            at = places.get(made)
            if at is None:
                continue
            if len(at) > 1:
                heappush(waiting, (-len(at), made))
            else:
                del places[made]
    starts = [i for i in range(n) if seq[i] >= 0]
    return rules, [seq[i] for i in starts], starts


class _Text:
    """The numbered words of a text with hashes of its prefixes and the places of its repeated anchors."""

    def __init__(self, ids: list[int]):
        self.ids = np.array(ids, np.int64)
        n = len(ids)
        self.powers, self.inverse = _powers(_FACTOR, n + 1), _powers(_INVERSE, n + 1)
        mixed = (self.ids.view(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * self.powers[:n], out=self.prefix[1:])
        grams = self.hashes(np.arange(max(0, n - ANCHOR + 1)), ANCHOR)
        order = np.argsort(grams, kind="stable")
        ordered = grams[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else np.zeros(0, np.int64)
        self.order, self.bounds = order, np.append(first, len(order))
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.repeat(np.arange(len(first)), np.diff(self.bounds))
        self.repeated = np.zeros(n + ANCHOR, bool)
        self.repeated[: len(order)] = np.diff(self.bounds)[self.group] > 1

    def hashes(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.prefix[at + length] - self.prefix[at]) * self.inverse[at]

    def others(self, at: int) -> np.ndarray:
        """The places, ascending, of the anchor at ``at``."""
        g = self.group[at]
        return self.order[self.bounds[g] : self.bounds[g + 1]]

    def forward(self, i: int, j: int, stop: int) -> int:
        """How many words from i on equal those from j > i on, before ``stop``."""
        done, step = 0, 32
        while j + done < stop:
            upto = min(stop, j + done + step)
            size = upto - j - done
            differ = np.flatnonzero(self.ids[i + done : i + done + size] != self.ids[j + done : upto])
            if len(differ):
                return done + int(differ[0])
            done += size
            step *= 4
        return done

    def backward(self, i: int, j: int, stop: int) -> int:
        """How many words before i equal those before j > i, not before ``stop``."""
        done, step = 0, 32
        while i - done > stop:
            size = min(step, i - done - stop)
            differ = np.flatnonzero(self.ids[i - done - size : i - done] != self.ids[j - done - size : j - done])
            if len(differ):
                return done + size - 1 - int(differ[-1])
            done += size
            step *= 4
        return done


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], have = 1, 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(factor, have, 1 << 64))
        have += more
    return out


def crossing(text: _Text, lo: int, cut: int, hi: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of the stretch from lo to hi that hold the words on both sides of ``cut``."""
    found: list[tuple[int, int, int]] = []
    most = (hi - lo) // TIMES

    def try_periods(periods: np.ndarray, right: bool) -> None:
        at = 0
        while at < len(periods):
            q = int(periods[at])
            # a shorter period whose run reaches so far leaves no room for this one
            far = max(((e - cut if right else cut - b) - p for b, e, p in found if 2 * p <= q), default=0)
            if q <= far:
                at = bisect_right(periods, far, at)
                continue
            at += 1
            # with period q: words i and i + q are equal for all i from cut - back to cut + on
            on = text.forward(cut, cut + q, hi) if right else text.forward(cut - q, cut, hi) - q
            back = text.backward(cut, cut + q, lo) if right else text.backward(cut - q, cut, lo) + q
            b, e = cut - back, cut + on + q
            if e - b < max(LEAST, TIMES * q) or not b < cut < e:
                continue
            if any(p < q and q % p == 0 and x <= b and e <= y for x, y, p in found):
                continue
            if (b, e, q) not in found:
                found.append((b, e, q))

    def likely(places: np.ndarray, right: bool) -> np.ndarray:
        """The distances at which also the half period beside the anchor recurs."""
        q = places - cut if right else cut - ANCHOR - places[::-1]
        half = np.maximum(ANCHOR, q // 2)
        q, half = (x[(cut + q + half <= hi) if right else (cut - q - half >= lo)] for x in (q, half))
        near, far = (cut, cut + q) if right else (cut - half, cut - q - half)
        return q[text.hashes(near, half) == text.hashes(far, half)]

    if text.repeated[cut] and cut + ANCHOR <= hi:
        places = text.others(cut)
        a, b = np.searchsorted(places, [cut + 1, min(cut + most, hi - ANCHOR) + 1])
        if a < b:
            try_periods(likely(places[a:b], True), True)
    if cut - ANCHOR >= lo and text.repeated[cut - ANCHOR]:
        places = text.others(cut - ANCHOR)
        a, b = np.searchsorted(places, [max(lo, cut - ANCHOR - most), cut - ANCHOR])
        if a < b:
            try_periods(likely(places[a:b], False), False)
    # a period found from the other side may divide one found before
    return [r for r in found if not any(p < r[2] and r[2] % p == 0 and x <= r[0] and r[1] <= y for x, y, p in found)]


def runs_of(ids: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers from 0 on, by start, then period."""
    if len(ids) < LEAST:
        return []
    base = max(ids) + 1
    rules, seq, starts = grammar(ids, base)
    if not rules:
        return []
    text = _Text(ids)
    if not text.repeated.any():
        return []
    sizes: list[int] = []
    for a, b in rules:
        sizes.append((sizes[a - base] if a >= base else 1) + (sizes[b - base] if b >= base else 1))

    # places of the rules that are long enough for a run, from the start sequence down
    places: list[list[int]] = [[] for _ in rules]
    for symbol, at in zip(seq, starts, strict=True):
        if symbol >= base:
            places[symbol - base].append(at)
    for k in range(len(rules) - 1, -1, -1):
        a, b = rules[k]
        if sizes[k] < LEAST:
            continue
        if a >= base and sizes[a - base] >= LEAST:
            places[a - base] += places[k]
        if b >= base and sizes[b - base] >= LEAST:
            shift = sizes[a - base] if a >= base else 1
            places[b - base] += [p + shift for p in places[k]]

    parts: dict[int, set[tuple[int, int]]] = {}
    for k, (a, _) in enumerate(rules):
        if sizes[k] < LEAST:
            continue
        lo = min(places[k])
        for b, e, q in crossing(text, lo, lo + (sizes[a - base] if a >= base else 1), lo + sizes[k]):
            parts.setdefault(q, set()).update((p + b - lo, p + e - lo) for p in places[k])
    cuts = np.array(starts[1:], np.int64)
    # next to a run's boundary a repeated anchor begins or ends
    for cut in cuts[text.repeated[cuts] | text.repeated[np.maximum(cuts - ANCHOR, 0)]].tolist():
        for b, e, q in crossing(text, 0, cut, len(ids)):
            parts.setdefault(q, set()).add((b, e))

    out = []
    for q, stretches in parts.items():
        whole: list[list[int]] = []
        for b, e in sorted(stretches):
            if whole and whole[-1][1] - b >= q:
                whole[-1][1] = max(whole[-1][1], e)
            else:
                whole.append([b, e])
        out += [(b, e - b, q) for b, e in whole]
    return sorted(out, key=lambda r: (r[0], r[2]))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, one row per row of ``df``."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                sizes, runs, collapsed = [], [], []
                for text in part.column(1).to_pylist():
                    words = split_words(text)
                    number: dict[bytes, int] = {}
                    found = runs_of([number.setdefault(w, len(number)) for w in words])
                    sizes.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    collapsed.append(b" ".join(collapse(words, found)).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: the first start, then the smallest period."""
    return F.aggregate(
        F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))),
        F.get(runs, F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )


def with_periodic_tails(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, a tenth of the texts (by a hash of the id) continued with one period of their words from some word on.

    Rows without an id stay as they are.
    """
    text, key = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    h = F.crc32(key.cast("string").cast("binary"))
    rows = df.select(key.alias("doc_id"), text.alias("text"), h.alias("h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.expr("h div 10"), F.size("words").cast("bigint")
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("a", F.when(n > 0, F.pmod(g, n)))
    rows = rows.withColumn("p", 1 + F.expr("(size(words) - a) div (3 + (h div 10) % 8)"))
    i = "cast(i as bigint)"
    tail = F.expr(f"transform(words, (w, i) -> if({i} < a, w, words[cast(a + ({i} - a) % p as int)]))")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))
