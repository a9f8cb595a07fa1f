"""Token ids in files of directly addressable codes.

A code splits each id into chunks of 8 bits, lowest first, one level a chunk. A level holds the chunks of the ids that
reach it, a bitmap that says which of them go on, and a rank directory: the set bits before every 512th. The k-th id of a
file is read by following its bit from level to level; nothing around it is decoded.

File (little-endian): b"QDAC", u32 version 1, u64 documents, u64 ids, u32 levels; i64 doc_id and u8 null flag for each
document; u64 start of each document and of the end; then for each level u64 n, n chunk bytes, ceil(n/8) bitmap bytes
(lowest bit first), u32 or, in files of 2^32 ids and more, u64 for every 512th position; u32 crc32 of all before.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import tokens
from .common import small, together

MAGIC, STEP = b"QDAC", 512
GROUP = 1024  # parts whose files are summed up together


def encode(ids: np.ndarray, starts: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """The bytes of a file. starts has one more entry than there are documents."""
    v = np.asarray(ids, np.uint32)
    levels, out = [], []
    while len(v) or not levels:
        more = v > 0xFF
        rank = np.concatenate(([0], np.cumsum(np.add.reduceat(more, np.arange(0, len(v), STEP), dtype=np.int64))[:-1])) if len(v) else np.zeros(0)
        levels.append(struct.pack("<Q", len(v)) + (v & 0xFF).astype(np.uint8).tobytes() + np.packbits(more, bitorder="little").tobytes() + rank.astype("<u8" if len(ids) >> 32 else "<u4").tobytes())
        v = v[more] >> np.uint32(8)
    out.append(MAGIC + struct.pack("<IQQI", 1, len(doc_ids), len(ids), len(levels)))
    out.append(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.append(np.asarray(starts, "<u8").tobytes())
    body = b"".join(out + levels)
    return body + struct.pack("<I", zlib.crc32(body))


class Codes:
    """A file's bytes, or a memory map of them, with random access."""

    def __init__(self, data):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("no file of codes")
        _, docs, self.n, n_levels = struct.unpack_from("<IQQI", data, 4)
        at = 28
        take = lambda kind, n, p: (np.frombuffer(data, kind, n, p), p + np.dtype(kind).itemsize * n)
        self.doc_ids, at = take("<i8", docs, at)
        self.null, at = take("u1", docs, at)
        self.starts, at = take("<u8", docs + 1, at)
        self.starts = self.starts.astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks, at = take("u1", n, at + 8)
            bits, at = take("u1", -(-n // 8), at)
            rank, at = take("<u8" if self.n >> 32 else "<u4", -(-n // STEP), at)
            self.levels.append((chunks, bits, rank))
        self.end = at

    def verify(self, data) -> None:
        if struct.unpack_from("<I", data, self.end)[0] != zlib.crc32(memoryview(data)[: self.end]):
            raise ValueError("checksum differs")

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        _, bits, rank = self.levels[level]
        block = at // STEP
        full = rank[block].astype(np.int64)
        first, last = block * (STEP // 8), at >> 3
        for k in range(STEP // 8):  # whole bytes between the directory's position and ours
            here = first + k
            on = here < last
            if not on.any():
                break
            full[on] += POP[bits[here[on]]]
        rest = (at & 7) > 0
        full[rest] += POP[bits[last[rest]] & ((1 << (at[rest] & 7)) - 1).astype(np.uint8)]
        return full

    def access(self, at) -> np.ndarray:
        """The ids at these positions, each on its own."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("no such id")
        out, who = np.zeros(len(at), np.uint32), np.arange(len(at))
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[who] |= chunks[at].astype(np.uint32) << np.uint32(8 * k)
            on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            who, at = who[on], at[on]
            if not len(at):
                break
            at = self._rank(k, at)
        return out

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids of a range: one rank a level, and nothing outside the range."""
        out, who = np.zeros(end - start, np.uint32), np.arange(end - start)
        for k, (chunks, bits, _) in enumerate(self.levels):
            if end <= start:
                break
            out[who] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * k)
            on = np.unpackbits(bits[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 : (start & 7) + end - start].astype(bool)
            who = who[on]
            start = int(self._rank(k, np.array([start]))[0]) if len(who) else 0
            end = start + len(who)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.starts[k + 1]))


POP = np.array([bin(i).count("1") for i in range(256)], np.int64)
MANIFEST = "part int, seq int, file string, n_docs long, n_ids long, n_bytes long"


@C.small_batches
def write(spark: SparkSession, docs: DataFrame, path: str, *, tokenizer: str, cut: str, end_id: int, text: str = "text", doc_id: str = "doc_id", file_ids: int = 4_000_000, part_bytes: int = 12 << 20) -> DataFrame:
    """Encodes every text (null: empty), appends end_id, and writes files in ascending doc_id order under path.

    Returns the manifest, a staged row a file, with ``base``: the ids in all files before. Null doc_ids come first;
    equal ones are ordered by text. A task writes under a name of its own, and only a finished task's files enter the
    manifest, so a lost or repeated task leaves no trace in it. A document is never cut; a file is closed once it has
    file_ids ids. An empty table has no files.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = C.parts(src, part_bytes, C.shuffle_partitions(spark))
    src = src.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def save(batches):
        from pyspark import TaskContext

        part, seq, rows = TaskContext.get().partitionId(), 0, []
        enc, end = tokens.encoder(tokenizer, cut), struct.pack("<I", end_id)
        store, top = fs.FileSystem.from_uri(path)
        store.create_dir(top, recursive=True)
        ids, sizes, raw = [], [], []

        def close():
            nonlocal seq
            starts = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64) // 4)))
            data = encode(np.frombuffer(b"".join(raw), "<u4"), starts, ids)
            name = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex[:8]}.dac"
            with store.open_output_stream(posixpath.join(top, name)) as f:
                f.write(data)
            rows.append((part, seq, name, len(ids), int(starts[-1]), len(data)))
            seq += 1
            ids.clear(), sizes.clear(), raw.clear()

        held = 0
        for b in together(small(batches)):
            for k, x in zip(b.column(0).to_pylist(), enc(b.column(1).to_pylist()), strict=True):
                ids.append(k), raw.append(x + end), sizes.append(len(x) + 4)
                held += sizes[-1]
                if held >= 4 * file_ids:
                    close()
                    held = 0
        if ids:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["part", "seq", "file", "n_docs", "n_ids", "n_bytes"])

    rows = C.stage(spark, src.mapInArrow(save, MANIFEST), "manifest")
    # of runs of parts first: only a row for GROUP parts goes through the window without a key
    rows = rows.withColumn("run", F.expr(f"part div {GROUP}"))
    ahead = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = rows.groupBy("run").agg(F.sum("n_ids").alias("n_ids")).select("run", ahead(Window.orderBy("run")).alias("run_base"))
    rows = rows.withColumn("base", ahead(Window.partitionBy("run").orderBy("part", "seq"))).join(runs, "run")
    return C.stage(spark, rows.select("part", "seq", "file", "n_docs", "n_ids", "n_bytes", (F.col("base") + F.col("run_base")).alias("base")), "bases")


def read(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def load(batches):
        store, top = fs.FileSystem.from_uri(path)
        for b in small(batches):
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(posixpath.join(top, name)) as f:
                    data = f.read_buffer()
                c = Codes(data)
                c.verify(data)
                crc, cuts = [], np.flatnonzero(np.diff(c.starts // (1 << 18), prepend=-1)).tolist() + [len(c.doc_ids)]
                for a, z in zip(cuts, cuts[1:]):  # documents that lie together are read at once
                    first = int(c.starts[a])
                    raw = memoryview(c.span(first, int(c.starts[z])).astype("<u4").tobytes())
                    at = (4 * (c.starts[a : z + 1] - first)).tolist()
                    crc += [zlib.crc32(raw[i:j]) for i, j in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c.doc_ids, pa.int64(), mask=c.null.astype(bool)), pa.array(c.starts[:-1] + base, pa.int64()), pa.array(np.diff(c.starts), pa.int64()), pa.array(crc, pa.int64())], names=names)

    files = manifest.count()
    return manifest.select("file", "base").repartition(max(1, min(files, 1 << 20)), "file").mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_uri(spark: SparkSession, path: str) -> str:
    """path with the scheme of the store that Spark would take it to be in, as workers need it; s3a and s3n are s3 there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    scheme, _, rest = uri.partition(":")
    return {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + (rest if rest.startswith("//") else "//" + rest)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read back from the files that were written.

    Null and empty texts are their end id alone; repeated rows are documents of their own; null doc_ids come first;
    further columns are not read; no documents give no rows.
    """
    import public_tokenizers

    path = store_uri(spark, C.new_path(spark, "dac"))
    manifest = write(spark, C.table(spark, sf_dir, "documents"), path, tokenizer=public_tokenizers.path("word_bpe_49k.json"), cut="words", end_id=1)
    return read(spark, manifest, path)


C.travels(__name__)
