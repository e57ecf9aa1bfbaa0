"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes at fixed positions. Two fingerprints that differ in at most
``BITS`` = 2 bits differ in at most two bytes, so they share at least ``MATCHES`` = 6 positional
bytes. A posting list per single byte would hold 1/256 of all fingerprints and make pairs without
end; the index therefore has one list per choice of six positions and their bytes (28 lists per
distinct fingerprint). Every pair that can reach the minimum meets in one of them, and a list holds
only fingerprints that agree in 48 bits, at most 65,536. Per pair in a list the shared positional
bytes are tallied, pairs that reach the minimum are kept and their bits compared.

Long lists (a dense group of near copies) are linked through stars instead of pairs: two values of
the two free bytes are within two bits exactly if some 16-bit value is within one bit of both.

Copies are collapsed to one fingerprint before the index, so the size of a group of copies costs
one partial aggregate. Components are found by label propagation with pointer jumping over tables
written to the shared folder.

``keep_first(similarity=...)`` asks for texts whose sets of word shingles are that similar (Jaccard),
which a radius of a few bits does not find: two texts of 100 words that differ in one differ in about
five bits, spread over all bytes. The same index is therefore built over wider fingerprints, in which
a change stays in its place: each shingle is dealt to one position by its hash and votes there only,
so a position holds the SimHash of its own shingles, and texts that differ in k shingles differ in at
most k positions. How many positions there are depends on the size of the sets, in classes; a text is
indexed in its class and in the next one, as two similar texts lie at most one class apart. Then
as above: there is a list per position and its content, pairs that meet in a list tally the positional
bytes they share, and those that reach the minimum are verified, by their whole sets of shingles.
At a similarity of 0.8 sets of up to 93 shingles have more positions than similar texts have changes
(those whose shingles leave too many positions empty share a list), so no pair is missed. Of longer texts a sample of positions is kept:
``LISTED`` have lists, in which a pair at a similarity of 0.8 meets with probability 0.999995, and
``TALLIED`` are tallied, with a minimum five standard errors below what such a pair shares.

Of a long list each member is first compared with its two ends; then, inside a list, whatever these
comparisons left in different components is tallied and verified with each other. That happens
between blocks of members that lie in memory with
their sets: a link found connects its components at once, which spares the pairs between them, and only
links are returned, no pairs. So a group of close copies costs time in proportion to its
size, and no candidate is passed over because its list is long.

Defined cases: a NULL or empty text has fingerprint zero and is linked like any other; rows
repeated in the input are repeated in the output; a NULL id takes part in its component but never
names it (``component_id`` is NULL only if no member has an id); columns other than id and text are
not read; an empty table gives an empty result. ``keep_first`` keeps one row of each component, also
where rows of different components share an id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations
from math import ceil, exp, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tallymill.llm.common import SLICE_ROWS, slices, working
from tallymill.session import write_once

BITS = 2
MATCHES = 8 - BITS
#: Lists up to this length are compared pair by pair, longer ones through stars. Both are exact.
PAIRWISE = 64
SHINGLE = 3
SEED = 42
#: Positions of a wide fingerprint that have lists, and those whose bytes are tallied.
LISTED = 24
TALLIED = 64
#: Shingles that a position has in a long text.
PER_POSITION = 4
#: Shingles of texts whose fingerprints are made at a time.
SET_ROWS = 1 << 18
#: Members of a list, and bytes of their sets, that a block holds when all are compared with all.
BLOCK = 512
BLOCK_BYTES = 4 << 20


def _shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, in order; a shorter text is one shingle."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    stops = ends[shingle - 1 :] - 1 if len(words) >= shingle else np.array([len(joined)])
    return np.fromiter(
        (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)),
        np.uint64,
        n,
    )


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text as a signed integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = _shingle_hashes(words, shingle)
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (bigint), one row per row of ``df``."""
    kind = df.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("simhash")
        for batch in batches:
            fps: list[int] = []
            for part in slices(iter([batch])):
                fps += [fingerprint(t, shingle) for t in part["text"]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint")


def _byte_mask(positions: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _free_bits(mask: int) -> list[int]:
    """The single bits, as signed integers, that a mask leaves free."""
    bits = [1 << b if b < 63 else -(1 << 63) for b in range(64)]
    return [bit for bit in bits if not bit & mask]


CHOICES = [_byte_mask(p) for p in combinations(range(8), MATCHES)]


def shared_bytes(a: Column, b: Column) -> Column:
    """How many positional bytes two fingerprints share."""
    x = a.bitwiseXOR(b)
    return sum(
        (F.when(x.bitwiseAND(F.lit(_byte_mask((p,)))) == 0, 1).otherwise(0) for p in range(1, 8)),
        F.when(x.bitwiseAND(F.lit(_byte_mask((0,)))) == 0, 1).otherwise(0),
    )


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints; their components are those of all close pairs."""
    postings = distinct.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(CHOICES)])
        ).alias("p"),
    )
    lists = (
        postings.groupBy("p.c", "p.key")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .where(F.size("fps") > 1)
    )
    lists = write_once(lists, "simhash-lists")

    def close(a: Column, b: Column) -> Column:
        return (shared_bytes(a, b) >= MATCHES) & (F.bit_count(a.bitwiseXOR(b)) <= BITS)

    def pairs(fps: Column) -> Column:
        return F.flatten(
            F.transform(
                fps,
                lambda a, i: F.transform(
                    F.filter(F.slice(fps, i + 2, F.size(fps)), lambda b: close(a, b)),
                    lambda b: F.struct(a.alias("a"), b.alias("b")),
                ),
            )
        )

    near = lists.where(F.size("fps") <= PAIRWISE).select(F.explode(pairs(F.col("fps"))).alias("x")).select("x.a", "x.b")

    # one-bit flips inside the two free bytes, and the value itself
    flips = F.array(*[F.array(F.lit(0).cast("bigint"), *[F.lit(bit) for bit in _free_bits(m)]) for m in CHOICES])
    members = (
        lists.where(F.size("fps") > PAIRWISE)
        .select("c", F.explode("fps").alias("fp"))
        .select("fp", F.explode(F.element_at(flips, F.col("c") + 1)).alias("bit"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("centre"))
        .distinct()
    )
    firsts = members.groupBy("centre").agg(F.min("fp").alias("a"))
    stars = members.join(firsts, "centre").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return near.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (smallest node reachable) of every node of ``edges`` (a, b)."""
    both = write_once(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = write_once(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels"
    )
    while True:
        of_next = (
            both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("m"))
        )
        hooked = labels.join(of_next, labels.node == F.col("n")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("new"))
        roots = labels.select(F.col("node").alias("r"), F.col("label").alias("up"))
        stepped = write_once(
            hooked.join(roots, F.col("new") == F.col("r")).select("node", F.least("new", "up").alias("label"), (F.least("new", "up") < F.col("old")).alias("moved")),
            "labels",
        )
        labels = stepped.select("node", "label")
        if stepped.where("moved").isEmpty():
            return labels


def _shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(_shingle_hashes(words, shingle))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _node(words: list[bytes]) -> int:
    """What texts of the same words share, as a signed integer."""
    return int(np.uint64(xxh64_intdigest(b" ".join(words), SEED)).view(np.int64))


class SizeClass(NamedTuple):
    """Sets of up to ``most`` shingles: how many positions their fingerprints have, and how many of the
    tallied bytes similar ones share at least. ``full``: a text with shingles in over ``changes``
    positions shares one with every similar text."""

    most: int
    changes: int
    positions: int
    least: int
    full: bool


@cache
def size_classes(similarity: float) -> list[SizeClass]:
    """In ascending order; similar sets lie in the same class or in neighbouring ones."""
    found, before, most = [], 0, 1
    while before < 1 << 40:
        # sets of a and b shingles at the similarity differ in (a + b) (1 - similarity) / (1 + similarity)
        differ = 2 * most * (1 - similarity) / (1 + similarity)
        changes = int(differ + 1e-9)
        enough = [n for n in range(changes + 1, LISTED + 1) if not changes or _seldom_fewer(before + 1, n) > changes]
        positions = enough[0] if enough else max(LISTED, ceil(most / PER_POSITION))
        least = TALLIED - changes  # positions that do not exist are alike
        if positions > TALLIED:
            same = exp(-differ / positions)
            least = max(1, int(TALLIED * same - 5 * sqrt(TALLIED * same * (1 - same))))
        found.append(SizeClass(most, changes, positions, least, bool(enough)))
        before, most = most, int(most / similarity) + 1
    return found


def _seldom_fewer(shingles: int, positions: int) -> float:
    """Positions with a shingle: the mean less three standard deviations."""
    x = shingles / positions
    spread = positions * (exp(-x) - (1 + x) * exp(-2 * x))
    return positions * (1 - (1 - 1 / positions) ** shingles) - 3 * sqrt(max(0, spread))


_DEAL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _votes(hashes: np.ndarray, starts: np.ndarray, held: np.ndarray) -> np.ndarray:
    """How many hashes of each group set each of the 64 bits."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    # sums of bytes, eight at once, over pieces of a group that can't overflow a byte
    pieces = np.flatnonzero((np.arange(len(hashes)) - np.repeat(starts, held)) % 255 == 0)
    sums = np.add.reduceat(bits.view(np.uint64), pieces, axis=0).view(np.uint8)
    return np.add.reduceat(sums, np.searchsorted(pieces, starts), axis=0, dtype=np.int32) if len(pieces) > len(starts) else sums.astype(np.int32)


def positional(sets: list[np.ndarray], numbers: np.ndarray, similarity: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Of sets of shingles, each with the number of a class: the keys of its lists there, and its positional bytes."""
    classes = size_classes(similarity)
    changes, positions = (np.array([getattr(c, x) for c in classes])[numbers] for x in ("changes", "positions"))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    item, hashes = np.repeat(np.arange(len(sets)), sizes), np.concatenate([np.zeros(0, np.uint64), *sets])
    place = (hashes * _DEAL >> np.uint64(20)) % positions[item].astype(np.uint64)
    kept = place < TALLIED
    slot, hashes = item[kept] * TALLIED + place[kept].astype(np.int64), hashes[kept]
    # numbers of 16 bits are sorted by digits
    order = np.argsort(slot.astype(np.uint16) if len(sets) <= SLICE_ROWS else slot, kind="stable")
    slot, hashes = slot[order], hashes[order]
    marks = np.zeros(len(sets) * TALLIED, np.uint8)
    starts = np.flatnonzero(np.diff(slot, prepend=-1))
    prints = np.zeros(0, np.uint64)
    if len(slot):
        held = np.diff(starts, append=len(slot))
        prints = np.packbits(2 * _votes(hashes, starts, held) > held[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)
    slot = slot[starts]
    marks[slot] = prints * _MIX >> np.uint64(56)
    of, place = slot // TALLIED, slot % TALLIED
    filled = np.bincount(of, minlength=len(sets))
    listed = place < LISTED
    of, place = of[listed], place[listed]
    keys = (prints[listed] ^ (place + numbers[of] * LISTED + 1).astype(np.uint64) * _DEAL) * _MIX
    found = np.split(keys.view(np.int64), np.cumsum(np.bincount(of, minlength=len(sets)))[:-1]) if sets else []
    full = np.array([c.full for c in classes])[numbers]
    for i in np.flatnonzero(full & (sizes > 0) & (filled <= changes)):
        found[i] = np.append(found[i], 0)
    return found, marks.reshape(-1, TALLIED)


def _sets_of(batch: pa.RecordBatch, shingle: int, nodes: list[int]) -> Iterator[list[np.ndarray]]:
    """The sets of shingles of the texts, few at a time; what their words have in common goes to ``nodes``."""
    for part in slices(iter([batch])):
        sets, held = [], 0
        for words in map(_words, part["text"]):
            nodes.append(_node(words))
            sets.append(_shingles(words, shingle))
            held += len(sets[-1])
            if held > SET_ROWS:
                yield sets
                sets, held = [], 0
        yield sets


def _positional_rows(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """doc_id, fp (of the words), class, keys and marks there, keys and marks in the next class, one row per row of ``df``."""
    kind = df.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    none = np.zeros(0, np.uint64)

    def listed(keys: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, keys)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([none.view(np.int64), *keys]), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("simhash")
        most = np.array([c.most for c in size_classes(similarity)])
        for batch in batches:
            nodes, numbers = [], []
            keys, marks = ([], []), ([], [])
            for sets in _sets_of(batch, shingle, nodes):
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                number = np.searchsorted(most, sizes)
                numbers += number.tolist()
                # of a small set no set of the next class is a copy
                reaches = sizes >= similarity * (most[number] + 1)
                following = [s if r else none for s, r in zip(sets, reaches, strict=True)]
                for i, (given, wanted) in enumerate(((sets, reaches | True), (following, reaches))):
                    found, held = positional(given, number + i, similarity)
                    keys[i].extend(found)
                    marks[i].extend(m.tobytes() if w else None for m, w in zip(held, wanted, strict=True))
            columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(numbers, pa.int32())]
            for i in (0, 1):
                columns += [listed(keys[i]), pa.array(marks[i], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "class", "keys", "marks", "next_keys", "next_marks"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint, class int, keys array<bigint>, marks binary, next_keys array<bigint>, next_marks binary")


def _shingle_sets(df: DataFrame, text_col: str, wanted: DataFrame, shingle: int) -> DataFrame:
    """fp and its set of shingle hashes, for the texts that are ``wanted`` (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("simhash")
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [_shingles(_words(t), shingle).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["fp", "members"])

    texts = _with_number(df.select(F.col(text_col).cast("string").alias("text")), "text", "fp", lambda t: _node(_words(t)))
    texts = texts.join(wanted, "fp", "left_semi").select("fp", "text").dropDuplicates(["fp"])
    return write_once(texts.mapInArrow(run, "fp bigint, members binary"), "simhash-sets")


def _with_number(df: DataFrame, text_col: str, name: str, of: Callable[[str | None], int]) -> DataFrame:
    """``df`` with a last column: a number of the text. (Spark runs a function of a row again for each filter it derives.)"""
    names = df.columns
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").alias(name))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("simhash")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = [of(t) for t in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.int64())], part.schema.names)

    return rows.mapInArrow(run, schema)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("simhash")
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                few, many = sorted((len(x), len(y)))
                shared = len(np.intersect1d(x, y, assume_unique=True)) if few >= similarity * many else 0
                keep.append(shared >= similarity * (few + many - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of_b = sets.select(F.col("fp").alias("b"), F.col("members").alias("y"))
    of_a = sets.select(F.col("fp").alias("a"), F.col("members").alias("x"))
    rows = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "x", "y")
    return write_once(rows.mapInArrow(run, "a bigint, b bigint"), "simhash-pairs")


def _tallied(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b), met in the lists of class c, that share enough positional bytes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("simhash")
        least = np.array([c.least for c in size_classes(similarity)])
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, TALLIED) for i in (3, 4))
            enough = (x == y).sum(axis=1) >= least[batch.column(2).to_numpy()]
            yield batch.select(["a", "b"]).filter(pa.array(enough, pa.bool_()))

    of_a = marks.select(F.col("fp").alias("a"), "c", F.col("marks").alias("x"))
    of_b = marks.select(F.col("fp").alias("b"), "c", F.col("marks").alias("y"))
    rows = pairs.join(of_b, ["b", "c"]).join(of_a, ["a", "c"]).select("a", "b", "c", "x", "y")
    return write_once(rows.mapInArrow(run, "a bigint, b bigint"), "simhash-tallied")


def similar_links(df: DataFrame, rows: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between texts; their components are those of all pairs that meet, tally enough and are similar enough."""
    names = ["class", "keys", "marks", "next_keys", "next_marks"]
    distinct = write_once(rows.groupBy("fp").agg(*[F.first(c).alias(c) for c in names]), "simhash-distinct")

    def lists_of(keys: str, c: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(c.alias("c"), k.alias("key")))

    following = F.col("class") + 1
    postings = distinct.select("fp", F.explode(F.concat(lists_of("keys", F.col("class")), lists_of("next_keys", following))).alias("p")).select("fp", "p.*")
    marks = distinct.select("fp", F.col("class").alias("c"), "marks").unionByName(
        distinct.where("next_marks is not null").select("fp", following.alias("c"), F.col("next_marks").alias("marks"))
    )
    lists = postings.groupBy("c", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("n")).where("n > 1")
    members = write_once(postings.join(write_once(lists, "simhash-lists"), ["c", "key"]), "simhash-members")

    ends = members.select("c", F.explode(F.array("low", "high")).alias("a"), F.col("fp").alias("b")).where("a <> b")
    ends = ends.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("c").alias("c"))
    pairs = _tallied(ends, marks, similarity)
    compared = pairs.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(members.where("n > 3").select("fp"))
    sets = _shingle_sets(df, text_col, compared.distinct(), shingle)
    near = _verified(pairs, sets, similarity)

    # lists of up to three are done: each pair has one of the two ends
    labels = components(near).withColumnRenamed("node", "fp")
    left = members.where("n > 3").join(labels, "fp", "left").select("c", "key", "fp", F.coalesce("label", "fp").alias("label"))
    left = write_once(left.join(sets.select("fp", F.octet_length("members").alias("bytes")), "fp"), "simhash-left")
    several = left.groupBy("c", "key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where("x <> y")
    left = left.drop("bytes")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = left.join(several.select("c", "key", blocks.alias("blocks")), ["c", "key"]).join(marks, ["fp", "c"]).join(sets, "fp")
    dealt = dealt.withColumn("own", F.pmod(F.hash("fp"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("c", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "label", "own", "marks", "members")

    def compare(rows: pa.Table) -> pa.Table:
        found = _open_links(rows, similarity)
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    further = write_once(dealt.groupBy("c", "key", "i", "j").applyInArrow(compare, "a bigint, b bigint"), "simhash-further")
    return near.unionByName(further).distinct()


def _open_links(rows: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links between members of one block, or two, of a list that are not connected yet; a link found connects what it joins."""
    working("simhash")
    fps, labels, own = (rows[c].to_numpy().copy() for c in ("fp", "label", "own"))
    one_block = rows["i"][0] == rows["j"][0]
    marks = np.frombuffer(b"".join(rows["marks"].to_pylist()), np.uint8).reshape(len(fps), TALLIED)
    least = size_classes(similarity)[rows["c"][0].as_py()].least
    sets = [np.frombuffer(x, np.uint64) for x in rows["members"].to_pylist()]
    sizes = np.array([len(x) for x in sets])
    found = []
    for at, mine in enumerate(sets):
        # pairs inside a block of two are another group's
        other = at + 1 + np.flatnonzero((labels[at + 1 :] != labels[at]) & (one_block | (own[at + 1 :] != own[at])))
        other = other[np.minimum(sizes[other], len(mine)) >= similarity * np.maximum(sizes[other], len(mine))]
        other = other[(marks[other] == marks[at]).sum(axis=1) >= least]
        if not len(other):
            continue
        every = np.concatenate([sets[o] for o in other])
        same = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
        shared = np.add.reduceat(same, np.cumsum(sizes[other]) - sizes[other], dtype=np.int64)
        for o in other[shared >= similarity * (len(mine) + sizes[other] - shared)].tolist():
            if labels[o] != labels[at]:
                found.append((int(fps[at]), int(fps[o])))
                labels[labels == labels[o]] = labels[at]
    return found


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: one row per row of ``df``."""
    rows = write_once(fingerprints(df, id_col, text_col, shingle), "simhash")
    return _assign(rows)


def _assign(rows: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    distinct = write_once(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    labels = components(links(distinct.select("fp")) if edges is None else edges)
    named = distinct.join(labels, distinct.fp == labels.node, "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_fp = named.join(smallest, "label").select("fp", "label", "component_id")
    return rows.join(write_once(of_fp, "simhash-components"), "fp").select("doc_id", "fp", "component_id", "label")


def hex_digits(fp: Column) -> Column:
    """Sixteen lower-case hexadecimal digits of a bigint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float | None = None
) -> DataFrame:
    """The rows of ``df``, one of each component: that with its smallest id, then its smallest text.

    Components are those of fingerprints within ``BITS`` bits or, with a ``similarity``, of texts whose
    sets of shingles are that similar.
    """
    if similarity is None:
        rows = write_once(fingerprints(df, id_col, text_col, shingle), "simhash")
        found = write_once(_assign(rows), "simhash-assigned")

        def fp_of(text: str | None) -> int:
            return fingerprint(text, shingle)

    else:
        rows = write_once(_positional_rows(df, id_col, text_col, shingle, similarity), "simhash-wide")
        edges = similar_links(df, rows, text_col, shingle, similarity)
        found = write_once(_assign(rows.select("doc_id", "fp"), edges), "simhash-assigned")

        def fp_of(text: str | None) -> int:
            return _node(_words(text))

    key = F.col(f"`{id_col}`")
    names = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("_tm_id"), F.col("fp").alias("_tm_of"), F.col("label").alias("_tm_label")).distinct()
    ids = names.where("_tm_id is not null").select("_tm_id").distinct()
    order = [F.col(f"`{c}`") for c, kind in df.dtypes if c in (id_col, text_col) or kind in ("string", "bigint", "int")]

    def one_per(rows: DataFrame, of: Column | str) -> DataFrame:
        numbered = rows.withColumn("_tm_n", F.row_number().over(Window.partitionBy(of).orderBy(*order))).where("_tm_n = 1")
        return numbered.select(*[f"`{c}`" for c in df.columns])

    # an id of one fingerprint lies in one component; rows of other ids, or of none, are told apart by theirs
    spread = found.join(ids, F.col("doc_id") == F.col("_tm_id"), "left_semi").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y"))
    spread = write_once(spread.where("x <> y").select(F.col("doc_id").alias("_tm_spread")), "simhash-spread")
    plain = ids.join(spread, F.col("_tm_id") == F.col("_tm_spread"), "left_anti")
    named = one_per(df.join(plain, key == F.col("_tm_id"), "left_semi"), key)
    others = df.where(key.isNull()).unionByName(df.join(spread, key == F.col("_tm_spread"), "left_semi"))
    if others.isEmpty():
        return named
    others = _with_number(others, text_col, "_tm_fp", fp_of)
    others = others.join(names, key.eqNullSafe(F.col("_tm_id")) & (F.col("_tm_fp") == F.col("_tm_of")))
    return named.unionByName(one_per(others, "_tm_label"))
