"""Token-id files: documents as ids in ascending order of id, coded in blocks (``rangecoder``).

A file set is a folder of Parquet files, so that a store commits them whole and a lost task leaves
nothing behind. A row is one block: part, block, first (ids of the part before it), n_ids, code, and
the documents that have ids in it: first_doc (number of the first one in its part), doc_ids and
doc_ends (where each ends inside the block). Blocks are cut after a fixed number of ids, also inside
a document, so a huge text is many blocks and nothing grows with it.

Writing: rows are dealt to ranges of ids (with a hash of the text, so rows that repeat an id spread),
sorted in their range, encoded and coded in one pass. Reading: any set of rows can be decoded alone;
a part's place among all ids comes from the sizes of the parts before it, one number each. Pieces of
a document that lies in several blocks are put together by joining their checksums.

Defined cases: a NULL or empty text is the end id alone; rows that repeat an id are written one
after another, in the order of a hash of their texts; a NULL id comes first; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.llm import rangecoder, tokens

END_ID = 1
#: Blocks that a task codes together, at most.
TOGETHER = 2048
SLICE_ROWS = 2048

SCHEMA = "part int, block bigint, first bigint, n_ids int, code binary, first_doc bigint, doc_ids array<bigint>, doc_ends array<int>"
_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int64()),
        ("first", pa.int64()),
        ("n_ids", pa.int32()),
        ("code", pa.binary()),
        ("first_doc", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_ends", pa.list_(pa.int32())),
    ]
)


def write(df: DataFrame, out: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Write the documents of ``df`` to the folder ``out``, with the tokenizers file at ``path``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = tokens.encoder(path), TaskContext.get().partitionId()
        waiting: list[bytes] = []  # ids not yet coded, by document
        ids: list[int | None] = []  # of the documents from number first_doc on
        ends: list[int] = []  # where these end in the part
        total = done = first_doc = block = 0

        def coded(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, ids, ends, done, first_doc, block
            flat = np.frombuffer(b"".join(waiting), "<u4")
            whole = len(flat) if last else len(flat) // rangecoder.BLOCK * rangecoder.BLOCK
            at_doc = 0
            for at in range(0, whole, TOGETHER * rangecoder.BLOCK):
                upto = min(whole, at + TOGETHER * rangecoder.BLOCK)
                parts = [flat[i : min(upto, i + rangecoder.BLOCK)] for i in range(at, upto, rangecoder.BLOCK)]
                made = []
                for piece, code in zip(parts, rangecoder.encode(parts), strict=True):
                    reach = done + len(piece)
                    here = bisect_right(ends, reach, at_doc)
                    # a document that goes on in the next block is in this one too
                    goes_on = here < len(ends) and (here == at_doc or ends[here - 1] < reach)
                    held = slice(at_doc, here + goes_on)
                    made.append((part, block, done, len(piece), code, first_doc + at_doc, ids[held], [min(e, reach) - done for e in ends[held]]))
                    at_doc, block, done = here, block + 1, reach
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _ARROW, strict=True)], schema=_ARROW)
            waiting, ids, ends, first_doc = [flat[whole:].tobytes()], ids[at_doc:], ends[at_doc:], first_doc + at_doc

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part_rows = batch.slice(at, SLICE_ROWS)
                ids += part_rows.column(0).to_pylist()
                for x in coder.encode(part_rows.column(1).to_pylist()):
                    waiting += [x, end]
                    total += len(x) // 4 + 1
                    ends.append(total)
                if total - done >= TOGETHER * rangecoder.BLOCK:
                    yield from coded(last=False)
        if total > done:
            yield from coded(last=True)

    ordered.mapInArrow(run, SCHEMA).write.parquet(out)


def read_pieces(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Decode all blocks: part, doc (its number in the part), doc_id, block, start (in the part), n,
    crc (of its ids as little-endian unsigned 32-bit integers) and, if wanted, these ids."""
    blocks = spark.read.schema(SCHEMA).parquet(folder)
    names = ["part", "doc", "doc_id", "block", "start", "n", "crc", *["ids"] * with_ids]
    types = [pa.int32(), *[pa.int64()] * 6, *[pa.binary()] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = -(-batch.num_rows // TOGETHER)  # about equally large, as a small one takes longer for each id
            for g in range(groups):
                at, upto = batch.num_rows * g // groups, batch.num_rows * (g + 1) // groups
                rows = batch.slice(at, upto - at).to_pylist()
                made = []
                for row, ids in zip(rows, rangecoder.decode([r["code"] for r in rows]), strict=True):
                    raw, begin = ids.tobytes(), 0
                    for k, (doc_id, end) in enumerate(zip(row["doc_ids"], row["doc_ends"], strict=True)):
                        own = raw[4 * begin : 4 * end]
                        place = (row["part"], row["first_doc"] + k, doc_id, row["block"], row["first"] + begin)
                        made.append((*place, end - begin, zlib.crc32(own), *[own] * with_ids))
                        begin = end
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)

    schema = "part int, doc bigint, doc_id bigint, block bigint, start bigint, n bigint, crc bigint"
    return blocks.mapInArrow(run, schema + ", ids binary" * with_ids)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""
    docs = read_pieces(spark, folder, with_ids=False).groupBy("part", "doc").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("start").alias("start"),
        F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("block", "n", "crc"))).alias("pieces"),
    )
    # one row per part: how many ids lie before it
    sizes = spark.read.schema(SCHEMA).parquet(folder).groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    placed = docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "pieces")
    whole = placed.where(F.size("pieces") == 1).select("doc_id", "start", "n_tokens", F.col("pieces")[0]["crc"].alias("ids_crc32"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for rows in batch.column(3).to_pylist():
                crc = rows[0]["crc"]
                for r in rows[1:]:
                    crc = rangecoder.join_crc32(crc, r["crc"], 4 * r["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], names)

    cut = placed.where(F.size("pieces") > 1)
    return whole.unionByName(cut.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))
