"""Document fingerprints from content-defined chunks.

A gear hash runs over the UTF-8 bytes of a text; where its low bits are zero a chunk may end. The
chunking is normalised: below the usual size more bits must be zero, above it fewer, so sizes stay
close to the usual one and a chunk depends on nothing but the ``GEAR_BITS`` bytes before its ends. A
change in one place leaves the chunks elsewhere as they are, also where everything behind is shifted.

A fingerprint is the set of the chunks' digests with their lengths, written in order: ten
hexadecimal digits each, eight of the digest and two of the length. The likeness of one fingerprint
to another is containment: the share of its bytes that lie in chunks which the other has too.

``neighbours`` finds for each document its successor in descending order of ids with one shuffle:
ids are cut at quantiles into ranges, the first document of each range is also sent to the range
before it, and each range is sorted and streamed. Neither a range nor a text is ever held with all
others.

Defined cases: a NULL text counts as empty; the empty text has the empty fingerprint, which is like
itself (1) and like no other (0); repeated rows are neighbours of each other, ids that tie are
ordered by hash and text; a NULL id comes last; a single document is its own successor; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from tallymill.operators.chunking import add_chunk

LEAST, USUAL, MOST = 12, 32, 255
GEAR_BITS = 32
STRICT_BITS, LOOSE_BITS = 6, 4
SEED = 4
#: Rows of a range of ids, about.
RANGE_ROWS = 8_000
MOST_RANGES = 10_000

_GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)
_STRICT = np.uint32(((1 << STRICT_BITS) - 1) << (GEAR_BITS - STRICT_BITS))
_LOOSE = np.uint32(((1 << LOOSE_BITS) - 1) << (GEAR_BITS - LOOSE_BITS))


def gear(raw: bytes) -> np.ndarray:
    """The rolling hash after each byte: the sum of the last 32 gear values, each shifted by its age."""
    h = _GEAR[np.frombuffer(raw, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        older = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += older
    return h


def ends(raw: bytes) -> list[int]:
    """Where the chunks of a text end."""
    size = len(raw)
    if not size:
        return []
    h = gear(raw)
    loose = np.flatnonzero((h & _LOOSE) == 0)
    at = (loose + 1).tolist()
    strict = ((h[loose] & _STRICT) == 0).tolist()
    out, begin = [], 0
    for end, hard in zip(at, strict, strict=True):
        while end - begin > MOST:
            begin += MOST
            out.append(begin)
        length = end - begin
        if length >= USUAL or (hard and length >= LEAST):
            out.append(end)
            begin = end
    while size - begin > MOST:
        begin += MOST
        out.append(begin)
    if begin < size:
        out.append(size)
    return out


def entries(text: str) -> np.ndarray:
    """The distinct chunks of a text: digest in the upper bits, length in the lowest eight."""
    raw = text.encode()
    cuts = ends(raw)
    found = {(xxh32_intdigest(raw[a:b], SEED) << 8) | (b - a) for a, b in zip([0, *cuts], cuts, strict=False)}
    return np.array(sorted(found), np.uint64)


def written(chunks: np.ndarray) -> str:
    return chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    """The chunks of a written fingerprint."""
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    whole = np.zeros((len(raw), 8), np.uint8)
    whole[:, 3:] = raw
    return whole.view(">u8").reshape(-1).astype(np.uint64)


def likeness(own: np.ndarray, other: np.ndarray) -> float:
    """The share of the length of ``own`` in chunks that ``other`` has."""
    if not len(own):
        return float(not len(other))
    shared = own[np.isin(own, other, assume_unique=True)]
    return float((shared & np.uint64(255)).sum() / (own & np.uint64(255)).sum())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint, one row per row of ``df``."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [written(entries(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many code points of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_ranges(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """doc_id, text, part (range number, in descending order of ids), guest: the first row of the next range once more. And how many ranges."""
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    n = ids.count()
    parts = min(MOST_RANGES, n // RANGE_ROWS + 1)
    cuts: list[float] = []
    if parts > 1:
        shares = [(i + 1) / parts for i in range(parts - 1)]
        found = ids.agg(F.percentile_approx("doc_id", shares, 20 * parts)).first()[0]
        cuts = sorted({float(c) for c in found or ()})
    # the ranges from the highest ids to the lowest; ids that tie stay together

    def with_part(df: DataFrame) -> DataFrame:
        # a border is a chunk of its own; it goes with the ids above it
        chunk = add_chunk(df, F.col("doc_id"), cuts, "chunk")
        above = len(cuts) - F.floor((F.col("chunk") + 1) / 2).cast("int")
        return chunk.withColumn("part", F.coalesce(above, F.lit(len(cuts) + 1))).drop("chunk")

    # one row per range, so small; descending: the range before has the higher ids
    heads = with_part(ids).groupBy("part").agg(F.max("doc_id").alias("head")).collect()
    filled = sorted(r["part"] for r in heads)
    head = {r["part"]: r["head"] for r in heads}
    before = {p: filled[i - 1] for i, p in enumerate(filled)}  # of the first range: the last
    table = df.sparkSession.createDataFrame([(p, head[p], before[p]) for p in filled] or [(-1, None, -1)], "h_part int, h_id bigint, h_before int")
    placed = with_part(rows)
    is_head = (F.col("part") == F.col("h_part")) & F.col("doc_id").eqNullSafe(F.col("h_id"))
    both = placed.join(F.broadcast(table), is_head, "left")
    to = F.array_compact(F.array(F.struct("part", F.lit(False).alias("guest")), F.when(F.col("h_part").isNotNull(), F.struct(F.col("h_before").alias("part"), F.lit(True).alias("guest")))))
    return both.select("doc_id", "text", F.explode(to).alias("to")).select("doc_id", "text", "to.part", "to.guest"), len(cuts) + 2


def with_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows, parts = in_ranges(df, id_col, text_col)
    # the guest closes its range; of rows that tie for the head only the first is needed, so it sorts the same way
    order = [F.col("part"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ordered = rows.repartitionById(parts, "part").sortWithinPartitions(*order).select("doc_id", "text", "part", "guest")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # id, text, chunks, part of the row whose successor is to come
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, part, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[3] != part:
                    raise RuntimeError(f"range {held[3]} has no successor")
                if held is None and guest:
                    continue  # the range is closed already
                chunks = entries(text)
                if held is not None:
                    own, before = held[2], held[1]
                    changed = edited(before, text)
                    other = entries(changed)
                    digest = hashlib.sha256(changed.encode()).hexdigest()
                    out.append((held[0], len(before), digest, written(own), written(other), likeness(own, other), likeness(own, chunks)))
                held = None if guest else (doc_id, text, chunks, part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, _TYPES, strict=True)], names
            )

    return ordered.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
