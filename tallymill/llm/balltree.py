r"""Ranked lexical search by exact inner products in ball trees.

A document is a sparse vector of whole numbers, one per query term it holds: the term's weight times its
damped number of occurrences. A query is the 0/1 vector of its terms, so its score is an inner product. Steps:

1. Queries are taken in blocks of at most ``BLOCK_ITEMS`` queries and ``BLOCK_TERMS`` different terms, so
   that what travels to the tasks is bounded, whatever the number of queries. All documents are counted
   once per block; kept are their length and their counts of the block's terms.
2. Number and length of all documents and the terms' document counts are partial aggregates.
3. Each task builds ball trees over ``TREE_DOCS`` vectors at a time: a node has the centroid of its vectors and
   the radius around it that holds them all; it is cut in half between two distant members, down to
   ``LEAF_DOCS``. A query visits nodes best bound first. No vector of a ball has a larger inner product than
   that of the centroid plus the query's length times the radius; a subtree whose bound is below the query's
   k-th score so far is passed over. Sparse texts are far from each other in all directions but a
   query looks in few, so radius and length are taken in each of ``SUBSPACES`` subspaces (with one
   radius nothing was passed over). At leaves scores are exact sums of integers.
4. Each task returns at most k rows a query; they are cut to k in two steps, the first by groups of tasks.

Bounds are floating-point numbers rounded to the safe side. With at most ``BLOCK_TERMS`` summands the relative error
of a sum stays below 1e-10; radii are taken from squares, enlarged by ``SAFE`` of the largest ones, bounds by
``SAFE`` of themselves and by one. So a subtree is only passed over if no document in it can count.

Defined cases: a NULL or empty text has no terms, counts for nothing and is never found; a query
without terms has no rows, nor has one that no document scores above 0 for; rows repeated in either table count each
and are ranked each; of equal scores smaller ids come first, NULL ids last; ids may be of any type that has an
order; other columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import SLICE_ROWS
from tallymill.session import write_once

BLOCK_ITEMS = 4096
BLOCK_TERMS = 200_000
TREE_DOCS = 4096
LEAF_DOCS = 32
SAFE = 1e-9
#: Subspaces, by the term's number, that have a radius of their own.
SUBSPACES = 4096
#: Groups of tasks whose rows are cut to k before those of all are.
GROUPS = 128

_OTHER = bytes(c for c in range(128) if not chr(c).isalnum())
_LETTERS = bytes(range(65, 91))
_FOLD = bytes.maketrans(_OTHER + _LETTERS, b" " * len(_OTHER) + _LETTERS.lower())


def terms_of(text: str | None) -> list[bytes]:
    """Maximal stretches of ASCII letters and digits and of all other characters from U+0080 on; only A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(id, different terms) of the queries, as many as a block may have."""
    block: list[tuple[object, list[bytes]]] = []
    seen: set[bytes] = set()
    for row in items.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).toLocalIterator():
        found = sorted(set(terms_of(row[1])))
        if block and (len(block) >= BLOCK_ITEMS or len(seen.union(found)) > BLOCK_TERMS):
            yield block
            block, seen = [], set()
        block.append((row[0], found))
        seen.update(found)
    if block:
        yield block


def counted(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats) and the counts of the numbered terms, of the documents that have a term."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                keep, sizes, terms, counts, ends = [], [], [], [], [0]
                for i, text in enumerate(part.column(1).to_pylist()):
                    words = terms_of(text)
                    if not words:
                        continue
                    found = Counter([known[w] for w in words if w in known])
                    keep.append(i)
                    sizes.append(len(words))
                    terms += found.keys()
                    counts += found.values()
                    ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(keep, pa.int32())),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())),
                    ],
                    ["doc_id", "n", "terms", "counts"],
                )

    return write_once(rows.mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, counts array<int>"), "term-counts")


@dataclass
class Vectors:
    """Sparse rows: row i has ``values`` at ``terms`` from ``ends[i]`` to ``ends[i + 1]``."""

    ends: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def take(self, rows: np.ndarray) -> Vectors:
        sizes = (self.ends[1:] - self.ends[:-1])[rows]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(ends[-1]) + np.repeat(self.ends[rows] - ends[:-1], sizes)
        return Vectors(ends, self.terms[at], self.values[at])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of ``values``, one per entry, of each row."""
        total = np.concatenate(([0.0], np.cumsum(values)))
        return total[self.ends[1:]] - total[self.ends[:-1]]


@dataclass
class Node:
    terms: np.ndarray
    centroid: np.ndarray
    radii: np.ndarray
    children: tuple[Node, Node] | None = None
    rows: np.ndarray | None = None
    dense: np.ndarray | None = None


class Tree:
    """A ball tree over vectors of whole numbers below 2**46."""

    def __init__(self, vectors: Vectors, width: int):
        self.width = width
        rows = np.arange(len(vectors.ends) - 1)
        squares = np.array([float(np.square(vectors.values[a:b], dtype=np.float64).sum()) for a, b in zip(vectors.ends[:-1], vectors.ends[1:], strict=True)])
        self.nodes: list[Node] = []
        self.root = self._node(vectors, rows, squares)

    def _node(self, vectors: Vectors, rows: np.ndarray, squares: np.ndarray) -> Node:
        middle = np.bincount(vectors.terms, vectors.values, self.width) / len(rows)
        terms = np.flatnonzero(middle)
        length = float(np.square(middle).sum())
        apart = squares + length - 2 * vectors.sums(vectors.values * middle[vectors.terms])
        node = Node(terms, middle[terms], self._radii(vectors, middle))
        self.nodes.append(node)
        if len(rows) <= LEAF_DOCS:
            node.rows = rows
            node.dense = np.zeros((len(rows), len(terms)), np.int64)
            node.dense[np.repeat(np.arange(len(rows)), np.diff(vectors.ends)), np.searchsorted(terms, vectors.terms)] = vectors.values
            return node
        # between the member farthest from the middle and that farthest from it
        one, of_one = self._from(vectors, squares, int(apart.argmax()))
        _, of_two = self._from(vectors, squares, one)
        order = np.argsort(of_one - of_two, kind="stable")
        halves = np.sort(order[: len(order) // 2]), np.sort(order[len(order) // 2 :])
        node.children = tuple(self._node(vectors.take(half), rows[half], squares[half]) for half in halves)
        return node

    def _radii(self, vectors: Vectors, middle: np.ndarray) -> np.ndarray:
        """Per subspace the greatest distance of a member from the middle, rounded up."""
        n = len(vectors.ends) - 1
        rows, group = np.repeat(np.arange(n), np.diff(vectors.ends)), vectors.terms % SUBSPACES
        centre = np.bincount(np.arange(self.width) % SUBSPACES, np.square(middle), SUBSPACES)
        # |x - c|^2 = |c|^2 + sum over the entries of x of x (x - 2 c)
        change = vectors.values * (vectors.values - 2 * middle[vectors.terms])
        key = rows * SUBSPACES + group
        some, place = np.unique(key, return_inverse=True)
        apart = np.bincount(place, change, len(some)) + centre[some % SUBSPACES]
        large = np.bincount(place, np.square(vectors.values, dtype=np.float64), len(some)) + centre[some % SUBSPACES]
        most = np.zeros(SUBSPACES)
        np.maximum.at(most, some % SUBSPACES, np.maximum(apart, 0) + SAFE * large)
        # members without an entry in a subspace lie at its origin
        absent = np.bincount(some % SUBSPACES, minlength=SUBSPACES) < n
        most[absent] = np.maximum(most[absent], centre[absent] * (1 + SAFE))
        return np.sqrt(most)

    def _from(self, vectors: Vectors, squares: np.ndarray, row: int) -> tuple[int, np.ndarray]:
        """The member farthest from a member, and the squared distances of all."""
        dense = np.zeros(self.width)
        part = slice(vectors.ends[row], vectors.ends[row + 1])
        dense[vectors.terms[part]] = vectors.values[part]
        apart = squares + squares[row] - 2 * vectors.sums(vectors.values * dense[vectors.terms])
        return int(apart.argmax()), apart


class Search:
    """The best documents of a block's queries among the trees seen so far."""

    def __init__(self, queries: list[np.ndarray], width: int, k: int):
        self.queries, self.k, self.width = queries, k, width
        # a query's length in each subspace that it has terms in
        owner = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
        terms = np.concatenate(queries) if queries else np.zeros(0, np.int64)
        key, sizes = np.unique(owner * SUBSPACES + terms % SUBSPACES, return_counts=True)
        self.of_length, self.subspace, self.lengths = key // SUBSPACES, key % SUBSPACES, np.sqrt(sizes)
        self.owners = owner[np.argsort(terms, kind="stable")]
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=width))))
        self.best: list[list[tuple]] = [[] for _ in queries]
        self.least = np.ones(len(queries))
        self.visited = self.passed = 0

    def bounds(self, node: Node) -> np.ndarray:
        """An upper bound of each query's inner products in the ball."""
        begin, sizes = self.ends[node.terms], self.ends[node.terms + 1] - self.ends[node.terms]
        upto = np.cumsum(sizes)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - (upto - sizes), sizes)
        inner = np.bincount(self.owners[at], np.repeat(node.centroid, sizes), len(self.queries))
        inner += np.bincount(self.of_length, self.lengths * node.radii[self.subspace], len(self.queries))
        return inner * (1 + SAFE) + 1

    def add(self, tree: Tree, ids: list) -> None:
        bound = {id(node): self.bounds(node) for node in tree.nodes}
        for q in np.flatnonzero(bound[id(tree.root)] >= self.least).tolist():
            self._walk(q, tree, bound, ids)

    def _walk(self, q: int, tree: Tree, bound: dict[int, np.ndarray], ids: list) -> None:
        terms, best, least = self.queries[q], self.best[q], self.least[q]
        waiting = [(-bound[id(tree.root)][q], 0, tree.root)]
        made = 0
        while waiting:
            top, _, node = heappop(waiting)
            if -top < least:
                self.passed += 1 + len(waiting)
                break
            if node.children:
                for child in node.children:
                    made += 1
                    heappush(waiting, (max(top, -bound[id(child)][q]), made, child))
                continue
            self.visited += 1
            at = np.searchsorted(node.terms, terms)
            at[at == len(node.terms)] = 0
            scores = node.dense[:, at[node.terms[at] == terms]].sum(axis=1)
            for i in np.flatnonzero(scores >= least).tolist():
                key = ids[node.rows[i]]
                insort(best, (-int(scores[i]), key is None, key if key is not None else 0))
                if len(best) > self.k:
                    best.pop()
            if len(best) == self.k:
                least = max(least, -best[-1][0])
        self.least[q] = least


def damped(n: int, counts: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What the counts of a document of n terms are worth, in millionths."""
    m = 100 - 50 + (50 * n * documents) // length
    counts = counts.astype(np.int64)
    return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


def _searched(vectors: DataFrame, block: list[tuple[object, list[bytes]]], number: dict[bytes, int], k: int) -> DataFrame:
    """query, doc_id, score: the rows of each task."""
    documents, length = vectors.agg(F.count("*"), F.sum("n")).first()
    weights = np.zeros(len(number), np.int64)
    if documents:
        for term, df in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[term] = floor(1000 * log((2 * documents + 2) / (2 * df + 1)))
    queries = [np.sort(np.array([number[t] for t in terms], np.int64)) for _, terms in block]
    shared = vectors.sparkSession.sparkContext.broadcast((queries, weights))
    kind = vectors.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        search = Search(queries, len(weights), k)
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, TREE_DOCS):
                part = batch.slice(at, TREE_DOCS)
                lists = part.column(2)
                ends = lists.offsets.to_numpy().astype(np.int64)
                terms = lists.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64)
                counts = part.column(3).flatten().to_numpy()
                ends = ends - ends[0]
                sizes = part.column(1).to_pylist()
                worth = [damped(n, counts[a:b], documents, length) for n, a, b in zip(sizes, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                values = np.concatenate(worth) * weights[terms]
                search.add(Tree(Vectors(ends, terms, values), len(weights)), part.column(0).to_pylist())
        rows = [(q, None if none else key, -score) for q, best in enumerate(search.best) for score, none, key in best]
        if rows:
            of_query, keys, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(of_query, pa.int32()), pa.array(keys, id_type), pa.array(scores, pa.int64())], ["query", "doc_id", "score"])

    held = vectors.where(F.size("terms") > 0).select("doc_id", "n", "terms", "counts")
    return held.mapInArrow(run, f"query int, doc_id {kind}, score bigint")


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """item_id, rank (1 to k), doc_id, score: the best documents of each query, among all."""
    spark = docs.sparkSession
    item_field = items.select(F.col(f"`{item_col}`").alias("item_id")).schema
    found = None
    for block in blocks(items, item_col, item_text_col):
        number = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        rows = _searched(counted(docs, number, id_col, text_col), block, number, k)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        rows = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"query int, item_id {item_field[0].dataType.simpleString()}")
        rows = write_once(rows.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), "found")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        key = docs.select(F.col(f"`{id_col}`").alias("doc_id")).schema[0].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {item_field[0].dataType.simpleString()}, rank int, doc_id {key}, score bigint")
    return found
