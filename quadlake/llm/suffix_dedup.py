"""Removal of repeated byte strings with per-shard suffix arrays.

Every string of ``length`` bytes has an anchor: of its 32-byte grams, the one with the least hash, the leftmost of equals.
Equal strings have equal anchors at equal places, so strings with different anchors need not be compared. The starts that
share an anchor are a run, and a run with the bytes that its strings cover is a context: one for about 185 bytes of text.

1. Contexts are counted by anchor hash and by digest. A context that occurs twice is repeated as a whole, and one whose
   anchor has no other context is not repeated at all. Neither needs its bytes to travel; copies end here.
2. What is left, a row for each distinct context, is dealt into shards by anchor. A shard sorts its suffixes by
   Larsson-Sadakane refinement, finds common prefixes by Kasai's rule, and reads equal strings off neighbours.
3. An anchor with more than ``shard_contexts`` contexts is spread over several shards. Their strings, one of each kind a
   shard, are merged by binary search in sorted digests, dealt by digest, so that no shard meets the whole group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .common import small

GRAM = 32
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def words(buf: bytes, kind: str) -> np.ndarray:
    """The 8 bytes from each position on as an integer; buf has 8 bytes more than there are positions."""
    return np.ndarray((len(buf) - 8,), kind, buf, 0, (1,))


def gram_hashes(buf: bytes) -> np.ndarray:
    """A hash of the GRAM bytes at each position."""
    with np.errstate(over="ignore"):
        x = words(buf + bytes(8), "<u8").astype(np.uint64)
        n = max(0, len(buf) - GRAM + 1)
        h = np.zeros(n, np.uint64)
        for k, m in enumerate(MIX):
            h ^= x[8 * k : 8 * k + n]
            h *= np.uint64(m)
            h ^= h >> np.uint64(29)
        return h


PLACE = np.uint64((1 << 24) - 1)


def anchored(buf: bytes, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor, over texts that lie one after another in buf (under 2^24 bytes): text, key, first start, number of starts."""
    fits = np.flatnonzero(sizes >= length)
    none = np.zeros(0, np.int64)
    if not len(fits):
        return none, none, none, none
    h = gram_hashes(buf)
    w = length - GRAM + 1
    n = len(h)
    packed = np.full(-(-n // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
    packed[:n] = (h & ~PLACE) | np.arange(n, dtype=np.uint64)
    block = packed.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    count = sizes[fits] - length + 1
    text = np.repeat(fits, count)
    at = np.arange(len(text)) + np.repeat(starts[fits] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    place = (least[at] & PLACE).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return text[first], h[place[first]].view(np.int64), at[first], np.diff(np.append(first, len(at)))


ANCHORS = "did long, tid long, key long, c1 long, c2 long, l int, n int"


def anchors(src: DataFrame, length: int) -> DataFrame:
    """A row a context: the text (did, tid), its anchor's hash, digest (c1, c2), first start and number of starts."""

    def rows(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in small(batches):
            did, tid = b.column(0).to_numpy(), b.column(1).to_numpy()
            body = [x.as_py() for x in b.column(2)]
            for group in groups(body, 1 << 21):
                buf = b"".join(body[i] for i in group)
                sizes = np.array([len(body[i]) for i in group], np.int64)
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                for lo in range(0, len(buf) if len(group) == 1 else 1, 1 << 23):  # one long text goes by in pieces that overlap
                    piece = buf[lo : lo + (1 << 23) + length - 1] if len(group) == 1 else buf
                    text, key, at, n = anchored(piece, starts, np.array([len(piece)]) if len(group) == 1 else sizes, length)
                    if not len(text):
                        continue
                    view = memoryview(piece)
                    d = np.frombuffer(b"".join([digest(view[s:e]) for s, e in zip(at.tolist(), (at + n + (length - 1)).tolist())]), "<i8").reshape(-1, 2)
                    who = np.array(group)[text]
                    cols = [did[who], tid[who], key, d[:, 0], d[:, 1], (at - starts[text] + lo).astype(np.int32), n.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["did", "tid", "key", "c1", "c2", "l", "n"])

    return src.mapInArrow(rows, ANCHORS)


def groups(body: list[bytes], most: int):
    """Indexes of texts that go together; a text of over ``most`` bytes goes alone."""
    held, size = [], 0
    for i, x in enumerate(body):
        if held and size + len(x) > most:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(x)
    if held:
        yield held


def suffix_array(buf: bytes) -> np.ndarray:
    """The order of all suffixes, by Larsson-Sadakane refinement: groups sorted by h bytes are sorted by the groups h
    further on, and groups of one are left alone. Kasai's rule needs the order to be complete."""
    n = len(buf)
    key = words(buf + bytes(8), ">u8").astype(np.uint64)
    order = np.argsort(key)
    sorted_key = key[order]
    first = np.append(True, sorted_key[1:] != sorted_key[:-1])
    del key, sorted_key
    group = np.empty(n + 1, np.int64)  # of each position: where its group starts in the order; -1 past the end
    group[n] = -1
    group[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    at = np.flatnonzero(~(first & np.append(first[1:], True)))
    h = 8
    while len(at):
        p = order[at]
        both = (group[p] << 32) | (group[np.minimum(p + h, n)] + 1)
        s = np.argsort(both)
        p, both = p[s], both[s]
        order[at] = p
        first = np.append(True, both[1:] != both[:-1])
        group[p] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        at = at[~(first & np.append(first[1:], True))]
        h *= 2
    return order


def common_prefixes(buf: bytes, order: np.ndarray, most: int, lane: int = 64) -> np.ndarray:
    """Bytes, up to ``most``, that each suffix shares with the one before it in the order. Kasai's rule, that a suffix
    shares at most one byte less than the one before it in the text, runs down many lanes of the text at once."""
    n = len(buf)
    x = words(buf + bytes(most + 16), ">u8")
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    out = np.zeros(n, np.int32)
    lanes = np.arange(0, n, lane)
    have = np.zeros(len(lanes), np.int64)
    for d in range(min(lane, n)):
        i = lanes + d
        i = i[i < n]
        have = np.maximum(have[: len(i)] - 1, 0)
        j = before[i]
        have[j < 0] = 0
        todo = np.flatnonzero(j >= 0)
        while len(todo):
            a, b = x[i[todo] + have[todo]].astype(np.uint64), x[np.minimum(j[todo] + have[todo], n)].astype(np.uint64)
            z = a ^ b
            same = np.zeros(len(z), np.int64)
            for k in range(1, 9):
                same += z < np.uint64(1 << (64 - 8 * k)) if k < 8 else z == 0
            room = np.minimum(most, n - np.maximum(i[todo], j[todo])) - have[todo]
            have[todo] += np.minimum(same, room)
            todo = todo[(same == 8) & (room > 8)]
        out[i] = have
    return out[order]


def classes(buf: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of their suffixes, and for each whether its string equals the one before it."""
    order = suffix_array(buf)
    lcp = common_prefixes(buf, order, length)
    mine = np.zeros(len(buf), bool)
    mine[starts] = True
    at = np.flatnonzero(mine[order])
    shared = np.zeros(len(at), bool)
    if len(at) > 1:
        shared[1:] = np.minimum.reduceat(lcp[: at[-1] + 1], at[:-1] + 1) >= length
    return order[at], shared


FOUND = "did long, tid long, s int, e int, bucket int, strings binary"
STRING = np.dtype([("d1", "<i8"), ("d2", "<i8"), ("did", "<i8"), ("tid", "<i8"), ("s", "<i4"), ("asks", "u1")])


def _shards(contexts: DataFrame, length: int, shard_bytes: int, buckets: int) -> DataFrame:
    """Intervals of bytes that repeat (bucket null), and from groups that are split one string of each kind: sorted arrays
    of STRING, a row a shard and bucket of digests. A string that asks is one that its own shard has only once."""

    def solve(rows):
        import xxhash

        buf = b"".join(x[5] for x in rows)
        base = np.concatenate(([0], np.cumsum([len(x[5]) for x in rows])[:-1])).astype(np.int64)
        n = np.array([x[4] for x in rows], np.int64)
        who = np.repeat(np.arange(len(rows)), n)
        p = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        start = base[who] + p
        owner = np.empty(len(buf), np.int64)
        owner[start] = np.arange(len(who))
        at, shared = classes(buf, start, length)
        k = owner[at]  # index into who and p, in suffix order
        twice = shared | np.append(shared[1:], False)
        single = np.array([x[6] == 1 for x in rows])[who]
        hit = np.zeros(len(who), bool)
        hit[k] = twice
        good = hit & single
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.astype(np.int8), [0]))))
        out: list[list] = [[] for _ in range(6)]

        def add(*v):
            for c, y in zip(out, v, strict=True):
                c.append(y)

        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            while s < e:  # a run may go on from one context into the next
                c = int(who[s])
                z = min(e, s + int(n[c] - p[s]))
                add(rows[c][0], rows[c][1], rows[c][3] + int(p[s]), rows[c][3] + int(p[z - 1]) + length, None, None)
                s = z
        split = np.array([x[7] for x in rows])[who]
        view = memoryview(buf)
        mine = k[~shared & split[k]]  # the first of each kind
        if len(mine):
            t = np.zeros(len(mine), STRING)
            d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[x : x + length]) for x in start[mine].tolist()]), "<i8").reshape(-1, 2)
            ids = np.array([x[:2] for x in rows], np.int64)[who[mine]]
            t["d1"], t["d2"], t["did"], t["tid"] = d[:, 0], d[:, 1], ids[:, 0], ids[:, 1]
            t["s"] = np.array([x[3] for x in rows])[who[mine]] + p[mine]
            t["asks"] = single[mine] & ~hit[mine]
            t = t[np.lexsort((t["d2"], t["d1"], t["d1"] % buckets))]
            ends = np.flatnonzero(np.append(np.diff(t["d1"] % buckets) != 0, True)) + 1
            for a, z in zip([0, *ends.tolist()], ends.tolist()):
                add(None, None, None, None, int(t["d1"][a] % buckets), t[a:z].tobytes())
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["did", "tid", "s", "e", "bucket", "strings"])

    def rows(batches):
        held, size, last = [], 0, None
        for b in small(batches):
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                group = (x[8], x[9])
                if size >= shard_bytes and group != last:
                    yield solve(held)
                    held, size = [], 0
                held.append(x)
                size += len(x[5])
                last = group
        if held:
            yield solve(held)

    return contexts.mapInArrow(rows, FOUND)


def _merge(strings: DataFrame, length: int) -> DataFrame:
    """Of strings from several shards, those that ask and that another shard has too, found by binary search."""

    def search(rows: list[bytes]):
        t = np.concatenate([np.frombuffer(x, STRING) for x in rows])
        t = t[np.lexsort((t["d2"], t["d1"]))]
        # a shard gives each kind once, so a digest found twice comes from two shards
        asks = np.flatnonzero(t["asks"])
        first, last = (np.searchsorted(t["d1"], t["d1"][asks], side) for side in ("left", "right"))
        several = np.flatnonzero(last - first > 1)
        found = [k for k, a, z, v in zip(several.tolist(), first[several].tolist(), last[several].tolist(), t["d2"][asks[several]].tolist()) if np.searchsorted(t["d2"][a:z], v, "right") - np.searchsorted(t["d2"][a:z], v, "left") > 1]
        got = t[asks[found]]
        got = got[np.lexsort((got["s"], got["tid"], got["did"]))]
        # starts that follow one another make one range
        new = np.append(True, (np.diff(got["s"]) != 1) | (np.diff(got["tid"]) != 0) | (np.diff(got["did"]) != 0)) if len(got) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        end = got["s"][np.append(at[1:], len(got)) - 1] + length if len(at) else got["s"]
        return pa.RecordBatch.from_arrays([pa.array(got["did"][at]), pa.array(got["tid"][at]), pa.array(got["s"][at]), pa.array(end.astype(np.int32))], names=["did", "tid", "s", "e"])

    def rows(batches):
        held, last = [], None
        for b in small(batches):
            for bucket, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and bucket != last:
                    yield search(held)
                    held = []
                held.append(x)
                last = bucket
        if held:
            yield search(held)

    return strings.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "strings").mapInArrow(rows, "did long, tid long, s int, e int")


@C.small_batches
def repeats(spark: SparkSession, docs: DataFrame, *, length: int = 400, text: str = "text", doc_id: str = "doc_id", shard_contexts: int = 2000, shard_bytes: int = 1 << 20) -> DataFrame:
    """did, tid, spans: for each row with repeated bytes, byte ranges (s, e) that strings of ``length`` bytes cover which start
    elsewhere too. A row is known by did (its doc_id, null: 0) and tid (a hash of its text)."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    src = identified(docs, text, doc_id)
    runs = C.stage(spark, anchors(src.select("did", "tid", "body"), length), "anchors")
    kinds = runs.groupBy("key", "c1", "c2").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("did", "tid", "l", "n")).alias("rep"))
    kinds = C.stage(spark, kinds, "contexts")
    shared = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    need = kinds.join(shared, "key").select("key", "c1", "c2", "cnt", "rep.*", F.ceil(F.col("m") / F.lit(shard_contexts)).alias("subs"))
    need = need.withColumn("sub", F.pmod(F.xxhash64("c1", "c2"), F.col("subs")))
    wanted = need.groupBy("did", "tid").agg(F.collect_list(F.struct("key", "sub", "l", "n", "cnt", (F.col("subs") > 1).alias("split"))).alias("w"))
    contexts = src.join(wanted, ["did", "tid"]).select("did", "tid", F.col("body"), F.explode("w").alias("w"))
    contexts = contexts.select("did", "tid", "w.key", "w.l", "w.n", F.substring(F.col("body"), F.col("w.l") + 1, F.col("w.n") + F.lit(length - 1)).alias("ctx"), "w.cnt", "w.split", F.col("w.key").alias("k"), "w.sub")
    dealt = contexts.repartition("k", "sub").sortWithinPartitions("k", "sub")
    buckets = 16 * C.shuffle_partitions(spark)
    found = C.stage(spark, _shards(dealt, length, shard_bytes, buckets), "found")
    whole = runs.join(kinds.where("cnt > 1").select("key", "c1", "c2"), ["key", "c1", "c2"]).select("did", "tid", F.col("l").alias("s"), (F.col("l") + F.col("n") + F.lit(length - 1)).alias("e"))
    spans = whole.unionByName(found.where("bucket IS NULL").select("did", "tid", "s", "e")).unionByName(_merge(found.where("bucket IS NOT NULL"), length))
    return C.stage(spark, spans.groupBy("did", "tid").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")


def identified(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("did"), F.xxhash64(body).alias("tid"), body.alias("body"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<s:int,e:int>>, kept binary"


@C.small_batches
def remove_repeats(spark: SparkSession, docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", digest: bool = False, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans and kept (the bytes that stay) for every row; with digest kept_sha256 in place of the last two.

    Bytes are removed that any string of ``length`` bytes covers which also starts elsewhere, in this text or another, judged
    on the input. All copies go: none is kept as the first. A null text is empty; texts shorter than ``length`` stay whole;
    repeated rows are copies of each other. Other columns are ignored, and an empty table gives an empty one.
    """
    spans = repeats(spark, docs, text=text, doc_id=doc_id, **how)
    both = identified(docs, text, doc_id).join(spans, ["did", "tid"], "left").select("doc_id", "body", "spans")
    tail = "kept_sha256 string" if digest else KEPT.split(", n_spans long, ")[1]

    def rows(batches):
        for b in small(batches):
            sizes, gone, count, kept, ranges = [], [], [], [], []
            for x, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                x = x.as_py()
                cut = merged([(y["s"], y["e"]) for y in spans or ()])
                sizes.append(len(x))
                gone.append(sum(e - s for s, e in cut))
                count.append(len(cut))
                ends = [0, *(e for _, e in cut)]
                kept.append(b"".join(x[s:e] for s, e in zip(ends, [*(s for s, _ in cut), len(x)])))
                ranges.append([{"s": s, "e": e} for s, e in cut])
            cols = [b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64())]
            if digest:
                cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
                names = ["kept_sha256"]
            else:
                cols += [pa.array(ranges, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(kept, pa.binary())]
                names = ["spans", "kept"]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", *names])

    out = both.mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, " + tail)
    return C.stage(spark, out, "digests") if digest else out


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, with the bytes that go and a digest of those that stay.

    Null and empty texts have no bytes; repeated rows are copies of each other and go whole from 400 bytes on; further
    columns are not read; no documents give no rows.
    """
    return remove_repeats(spark, C.table(spark, sf_dir, "documents"), digest=True)


C.travels(__name__)
