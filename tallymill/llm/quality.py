"""A factorisation machine that scores documents for quality.

Inputs of a score are hashed lower-cased words (square root of their count, scaled to length one),
binned structure statistics of the text, and optional metadata columns; labels, language, source
and id never are. The pairwise part is taken in linear time from the square of the sum less the sum
of the squares of the factors.

The model is fitted with Adam on a bounded sample of labelled rows (at most ``per_class`` of each
class, those with the smallest hash of their id, so the same at every run) in the driver; scoring
runs over every whole text in the tasks. Everything the driver holds is bounded by ``per_class`` and
``FEATURES``.

Defined cases: a NULL text counts as empty, an empty text gets the score of its structure bins; a
row repeated is scored each time; an id with several labels counts with their mean, rounded up from
one half; without labels of both classes every score is the share of label 1 (one half if there are
none); other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh32_intdigest

from tallymill.llm.common import SLICE_ROWS, remembers, working

#: Documents below this score are predicted to have label 0.
THRESHOLD = 0.3
#: Buckets of hashed features, words and bins together.
FEATURES = 1 << 16
FACTORS = 8
PER_CLASS = 3000
EPOCHS = 6
#: A small sample is passed over more often, up to this many steps.
STEPS = 300
BATCH = 128
SEED = 20
#: Words whose bucket a task remembers.
REMEMBERED = 200_000


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxh32_intdigest(word, SEED) % FEATURES
        return found


_buckets = _Buckets()
remembers("quality", _buckets.clear)


def _lin(x: float, top: float, bins: int = 20) -> int:
    return int(min(max(x / top, 0.0), 1.0) * bins)


def structure(raw: bytes, words: list[bytes], counts: Counter) -> list[int]:
    """Binned statistics of a text: shapes of words and lines, repetition, case, signs."""
    n, size = max(1, len(words)), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    letters = sum(map(len, words)) / n
    fours = list(zip(words, words[1:], words[2:], words[3:], strict=False))
    return [
        int(log2(len(words) + 1)),
        _lin(letters, 16),
        _lin(len(counts) / n, 1),
        _lin(max(counts.values(), default=0) / n, 0.5),
        _lin(share(bytes(range(65, 91))), 0.5),
        _lin(share(b"0123456789"), 0.2),
        _lin(share(b"#*$%&<>|"), 0.2),
        _lin(share(b"|"), 0.1),
        _lin(share(b"!"), 0.2),
        _lin(share(b".,;:"), 0.2),
        _lin(share(bytes(range(128, 256))), 0.3),
        _lin(len({x.strip() for x in lines}) / max(1, len(lines)), 1),
        _lin(n / max(1, len(lines)), 100),
        _lin(sum(a == b for a, b in pairwise(words)) / n, 0.5),
        _lin(len(set(fours)) / max(1, len(fours)), 1),
        _lin(sum(len(w) == 1 for w in words) / n, 0.3),
    ]


def features(text: str | None, metadata: Sequence[object] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets (uint16) and their values (float32) of one document."""
    raw = (text or "").encode()
    words = raw.lower().split()
    counts = Counter(words)
    get = _buckets.__getitem__
    bins = [xxh32_intdigest(b"\x00s%d=%d" % (i, x), SEED) % FEATURES for i, x in enumerate(structure(raw, words, counts))]
    bins += [xxh32_intdigest(f"\x00m{i}={x}".encode(), SEED) % FEATURES for i, x in enumerate(metadata)]
    tf = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(tf):
        tf /= np.sqrt((tf**2).sum())
    at = np.concatenate([np.fromiter(map(get, counts), np.int64, len(counts)), np.array(bins, np.int64)])
    value = np.concatenate([tf, np.full(len(bins), 1 / np.sqrt(len(bins)))])
    distinct, place = np.unique(at, return_inverse=True)
    return distinct.astype(np.uint16), np.bincount(place, value, len(distinct)).astype(np.float32)


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # (FEATURES,)
    factors: np.ndarray  # (FEATURES, FACTORS)

    def logits(self, at: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of rows that lie one behind the other, row i from first[i] on."""
        vx = self.factors[at] * value[:, None]
        s = np.add.reduceat(vx, first, axis=0)
        q = np.add.reduceat(vx * vx, first, axis=0)
        return self.bias + np.add.reduceat(self.weights[at] * value, first) + 0.5 * (s * s - q).sum(axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], prior: float | None = None) -> Model:
    """From (label, buckets, values). ``prior``: the share of label 1 beyond the sample."""
    labels = np.array([r[0] for r in rows], np.float64)
    ones = labels.sum()
    share = prior if prior is not None else (ones / len(rows) if rows else 0.5)
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    rng = np.random.default_rng(SEED)
    model = Model(bias, np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, FACTORS)))
    if not 0 < ones < len(rows):
        model.factors[:] = 0
        return model
    # each class counts with its share beyond the sample
    weight = np.where(labels == 1, share / ones, (1 - share) / (len(rows) - ones)) * len(rows)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("w", model.weights), ("v", model.factors))}
    step = 0
    epochs = max(EPOCHS, STEPS * BATCH // len(rows))
    for epoch in range(epochs):
        rate = 0.03 / (1 + EPOCHS * epoch / epochs)
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), BATCH):
            chosen = order[begin : begin + BATCH]
            sizes = np.array([len(rows[i][1]) for i in chosen])
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            at = np.concatenate([rows[i][1] for i in chosen]).astype(np.int64)
            x = np.concatenate([rows[i][2] for i in chosen]).astype(np.float64)
            row = np.repeat(np.arange(len(chosen)), sizes)
            v = model.factors[at]
            s = np.add.reduceat(v * x[:, None], first, axis=0)
            error = (_sigmoid(model.logits(at, x, first)) - labels[chosen]) * weight[chosen] / len(chosen)
            distinct, place = np.unique(at, return_inverse=True)
            g = error[row] * x
            grad_v = (s[row] - v * x[:, None]) * g[:, None]
            grads = {
                "w": np.bincount(place, g, len(distinct)),
                "v": np.stack([np.bincount(place, grad_v[:, f], len(distinct)) for f in range(FACTORS)], axis=1),
            }
            step += 1
            model.bias -= rate * error.sum()
            for name, values in (("w", model.weights), ("v", model.factors)):
                g, (m1, m2) = grads[name] + 1e-5 * values[distinct], moments[name]
                m1[distinct] = 0.9 * m1[distinct] + 0.1 * g
                m2[distinct] = 0.999 * m2[distinct] + 0.001 * g * g
                values[distinct] -= rate * (m1[distinct] / (1 - 0.9**step)) / (np.sqrt(m2[distinct] / (1 - 0.999**step)) + 1e-8)
    return model


def crc_fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL for a NULL id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def _feature_rows(df: DataFrame, n_metadata: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("quality")
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                extra = list(zip(*[part.column(2 + i).to_pylist() for i in range(n_metadata)], strict=True)) or [()] * part.num_rows
                made = [features(t, m) for t, m in zip(part.column(1).to_pylist(), extra, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())],
                    ["label", "at", "value"],
                )

    return df.mapInArrow(run, "label int, at binary, value binary")


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    metadata: Sequence[str] = (),
    per_class: int = PER_CLASS,
) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("l_id"))
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    )
    count = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_hash = [F.xxhash64("l_id"), F.col("l_id")]
    chosen = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(*by_hash).limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    extra = [F.col(f"`{m}`").alias(f"m{i}") for i, m in enumerate(metadata)]
    rows = docs.select(F.col(f"`{id_col}`").alias("own_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *extra)
    rows = rows.join(F.broadcast(chosen), F.col("own_id") == F.col("l_id"))
    # one row of each id, or repeated ids would break the bound on the sample
    names = [f"m{i}" for i in range(len(metadata))]
    first = Window.partitionBy("l_id").orderBy(F.xxhash64("text"), *names)
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("label", "text", *names)
    rows = _feature_rows(rows, len(names))
    found = [(r["label"], np.frombuffer(r["at"], np.uint16), np.frombuffer(r["value"], np.float32)) for r in rows.collect()]
    found.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    total = sum(count.values())
    return fit(found, count.get(1, 0) / total if total else None)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", metadata: Sequence[str] = ()) -> DataFrame:
    """doc_id and score (0 to 1), one row per row of ``df``."""
    extra = [F.col(f"`{m}`").alias(f"m{i}") for i, m in enumerate(metadata)]
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *extra)
    kind = rows.schema["doc_id"].dataType.simpleString()
    run = _scorer(model, len(metadata), 1, "score")
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def with_score(df: DataFrame, model: Model, text_col: str = "text", metadata: Sequence[str] = ()) -> DataFrame:
    """``df`` with a last column _tm_score."""
    names = df.columns
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").alias("_tm_text"), *[F.col(f"`{m}`").alias(f"_tm_m{i}") for i, m in enumerate(metadata)])
    schema = T.StructType([*df.schema.fields, T.StructField("_tm_score", T.DoubleType())])
    return rows.mapInArrow(_scorer(model, len(metadata), len(names), "_tm_score"), schema)


def _scorer(model: Model, n_metadata: int, passthrough: int, name: str):
    """Of batches whose first columns pass through, followed by the text and the metadata."""
    small = Model(model.bias, model.weights.astype(np.float32), model.factors.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("quality")
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                extra = list(zip(*[part.column(passthrough + 1 + i).to_pylist() for i in range(n_metadata)], strict=True)) or [()] * part.num_rows
                scores = []
                for text, more in zip(part.column(passthrough).to_pylist(), extra, strict=True):
                    at, value = features(text, more)
                    scores.append(float(_sigmoid(small.logits(at.astype(np.int64), value, np.zeros(1, np.int64)))[0]))
                arrays = [part.column(i) for i in range(passthrough)] + [pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names[:passthrough], name])

    return run
