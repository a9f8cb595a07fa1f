"""Best-fit packing by sums of squares.

A document goes where the sum, over residual gaps, of the squared number of open bins with that gap becomes smallest:
into a bin of gap g the sum changes by 2 (N[g - s] - N[g]) + 2, or by 1 - 2 N[g] where it fills the bin, and in a new bin
by 2 N[C - s] + 1. Only the counts by gap matter, so a placement is one pass over at most C numbers. Of choices that change
the sum alike the smallest gap is taken, and a new bin only where it is smaller than all (a change of odd size, which a bin
that is not filled cannot have).

Documents are dealt at random into groups of bounded size, packed side by side; within a group long pieces come first,
ties in size in row order. A group leaves a few open bins, which is a small share of its tens of thousands.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens
from .common import small, together

PIECES = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset for each size; bins count from 0."""
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        # change of the sum in a bin of each gap s .. capacity - 1, filled where the gap is s, and in a new bin
        g, least = 0, 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if s < capacity:
            change = 2 * (count[0 : capacity - s] - count[s:capacity]) + 2
            change[0] = 1 - 2 * count[s]
            change[count[s:capacity] == 0] = 1 << 40
            k = int(change.argmin())
            if change[k] <= least:
                g = k + s
        if g:
            b = open_at[g].pop()
            count[g] -= 1
        else:
            b, g = used, capacity
            used += 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            open_at[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


@C.small_batches
def pieces(spark: SparkSession, docs: DataFrame, *, tokenizer: str, cut: str, end_id: int, capacity: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A staged row a piece (PIECES). Only documents longer than capacity are cut; their first piece may be shorter."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def rows(batches):
        enc, end = tokens.encoder(tokenizer, cut), np.array([end_id], "<u4").tobytes()
        for b in together(small(batches)):
            out: list[list] = [[] for _ in range(5)]
            for d, x in zip(b.column(0).to_pylist(), enc(b.column(1).to_pylist()), strict=True):
                x += end
                n, at, k = len(x) // 4, 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if not at else capacity
                    for c, v in zip(out, (d, k, at, size, zlib.crc32(x[4 * at : 4 * (at + size)])), strict=True):
                        c.append(v)
                    at, k = at + size, k + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    out = src.mapInArrow(rows, PIECES.split(", ", 1)[1])
    return C.stage(spark, out.select(F.monotonically_increasing_id().alias("rid"), "*"), "pieces")


def pack_pieces(spark: SparkSession, cut_up: DataFrame, *, capacity: int, group_rows: int = 150_000) -> DataFrame:
    """cut_up with sequence_id and offset. Groups are dealt by row, so no key makes a large one."""
    groups = max(1, -(-cut_up.count() // group_rows))
    schema = PIECES.replace("rid long, ", "") + ", sequence_id long, offset long"

    def one(key, t):
        t = t.sort_by([("length", "descending"), ("rid", "ascending")])
        bins, at = pack(t["length"].to_numpy(), capacity)
        t = t.drop_columns(["rid", "_g"])
        return t.append_column("sequence_id", pa.array(key[0].as_py() * (1 << 40) + bins)).append_column("offset", pa.array(at))

    dealt = cut_up.withColumn("_g", F.pmod(F.xxhash64("rid"), F.lit(groups)))
    return dealt.groupBy("_g").applyInArrow(one, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, *, tokenizer: str, cut: str, end_id: int, capacity: int = 2048, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row a piece.

    A null text is empty and yields its end id alone. Repeated rows are packed as often as they occur, a null doc_id is
    kept as it is, other columns are ignored, and an empty table gives an empty one.
    """
    return pack_pieces(spark, pieces(spark, docs, tokenizer=tokenizer, cut=cut, end_id=end_id, capacity=capacity, **how), capacity=capacity)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a piece of every document, with its sequence and place.

    Null and empty texts are their end id alone; repeated rows and null doc_ids are packed like others; pieces of one size
    are placed in row order; further columns are not read; no documents give no rows.
    """
    return pack_public(spark, C.table(spark, sf_dir, "documents"))


def pack_public(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark, docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), cut="blanks", end_id=0)


C.travels(__name__)
