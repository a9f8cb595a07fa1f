"""SimHash near-deduplication with BK-trees.

A fingerprint has a bit for each position that more than half of a text's shingle hashes set. Fingerprints within
``radius`` bits are linked. Of radius + 1 disjoint blocks of bits, two such fingerprints agree in at least one, so each
distinct fingerprint goes to the shards that its blocks name, and each shard becomes a BK-tree: the children of a node
are keyed by their integer distance to it, and a search follows only edges within the radius of the distance found.

Trees are not broadcast: all of them together grow with the corpus. The fingerprints that search a tree are its own
members, so they come with it. A shard of over ``shard_rows`` is split by blocks of the bits that are still free, which
misses no link for the same reason; bits that run out end the splitting. Within a shard a search that meets fingerprints
already joined need not report them again, so a shard gives fewer links than it has members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import components, exact_dedup
from .common import small

TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, shingle: int) -> int:
    """As a signed 64-bit integer; 0 for a text without words."""
    import xxhash

    words = text.translate(TO_LOWER).split()  # bytes are split at exactly the six separators
    n = len(words)
    if not n:
        return 0
    if n < shingle:
        spans = [b" ".join(words)]
    elif shingle == 3:
        spans = [b"%b %b %b" % w for w in zip(words, words[1:], words[2:])]
    else:
        spans = [b" ".join(w) for w in zip(*(words[k:] for k in range(shingle)))]
    h = xxhash.xxh64_intdigest
    return majority(np.fromiter((h(s, 42) for s in spans), np.uint64, len(spans)))


def majority(v: np.ndarray) -> int:
    """The bits that more than half of these hashes set, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(v), 1 << 16):  # bounded however long the text is
        ones += np.unpackbits(v[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(v), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """The other columns of docs, and fp."""
    rest = [c for c in docs.columns if c != text]
    src = docs.select(*rest, F.coalesce(F.col(text), F.lit("")).cast("binary").alias(text))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest) + ", fp long"

    def rows(batches):
        for b in small(batches):
            fp = pa.array([fingerprint(x.as_py(), shingle) for x in b.column(len(rest))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), fp], names=[*rest, "fp"])

    return src.mapInArrow(rows, schema)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class BKTree:
    """A tree over distinct fingerprints, built and searched for many of them at once, level by level."""

    def __init__(self, fps: np.ndarray):
        n = len(fps)
        self.fps = fps
        parent = np.zeros(n, np.int64)  # the node under which each fingerprint still has to find its place
        left = np.arange(1, n)
        keys, kids = [], []
        while len(left):
            edge = parent[left] * 65 + distance(fps[left], fps[parent[left]])
            order = np.argsort(edge, kind="stable")
            edge, left = edge[order], left[order]
            first = np.append(True, edge[1:] != edge[:-1])
            keys.append(edge[first])
            kids.append(left[first])
            parent[left] = np.repeat(left[first], np.diff(np.append(np.flatnonzero(first), len(left))))
            left = left[~first]
        k = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(k)
        self.keys = k[order]
        self.kids = (np.concatenate(kids) if kids else np.zeros(0, np.int64))[order]

    def search(self, queries: np.ndarray, radius: int):
        """Yields (queries, nodes) within the radius, a level of the tree at a time."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        while len(q):
            d = distance(queries[q], self.fps[node]).astype(np.int64)
            hit = d <= radius
            yield q[hit], node[hit]
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
            n = hi - lo
            q, start = np.repeat(q, n), np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            node = self.kids[np.arange(len(q)) + start]


def joined(fps: np.ndarray, radius: int, block: int = 256, pivots: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the radius connects, fewer than there are fingerprints.

    A few pivots first gather what lies around them. If that makes one large cluster, as a group of copies does, only
    the others search the tree: pairs within the cluster are connected already.
    """
    n = len(fps)
    root = np.arange(n)
    a, b = [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def join(q: np.ndarray, node: np.ndarray) -> None:
        new = root[q] != root[node]
        for i, j in zip(q[new].tolist(), node[new].tolist()):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(i)
                b.append(j)

    def flatten() -> None:
        while (root[root] != root).any():
            root[:] = root[root]

    if n > 2 * pivots:
        for p in np.linspace(0, n - 1, pivots).astype(int).tolist():
            close = np.flatnonzero(distance(fps, fps[p]) <= radius)
            join(np.full(len(close), p), close)
            flatten()
    most = np.bincount(root, minlength=n)
    rest = np.flatnonzero(root != most.argmax()) if most.max() > n // 4 else np.arange(n)
    tree = BKTree(fps)
    for s in range(0, len(rest), block):
        here = rest[s : s + block]
        for q, node in tree.search(fps[here], radius):
            join(here[q], node)
            flatten()
    return np.array(a, np.int64), np.array(b, np.int64)


def _blocks(bits: list[int], radius: int) -> list[int]:
    """Masks of radius + 1 disjoint blocks of the free bits, about equal."""
    if len(bits) <= radius:
        return []
    cuts = [len(bits) * k // (radius + 1) for k in range(radius + 2)]
    out = []
    for x, y in zip(cuts, cuts[1:]):
        m = sum(1 << i for i in bits[x:y])
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def links(spark: SparkSession, fps: DataFrame, *, radius: int, shard_rows: int) -> DataFrame:
    """a, b: links among the distinct fps (a column fp) that connect all that lie within the radius, directly or not."""
    # A shard is named by the bits its members agree in (mask, value). Level 0 is cut by four blocks; too large a shard
    # by blocks of what its mask leaves free.
    todo = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    out, masks = None, [0]
    for depth in range(4):
        level = []
        for m in masks:
            free = [i for i in range(64) if not (m >> i) & 1]
            level.append((m, [m | x if (m | x) < 1 << 63 else (m | x) - (1 << 64) for x in _blocks(free, radius)]))
        pairs = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.array(*(F.lit(x).cast("long") for x in xs)).alias("xs")) for m, xs in level))
        cut = todo.select("fp", F.explode(F.filter(pairs, lambda p: p["m"] == F.col("mask"))[0]["xs"]).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        cut = C.stage(spark, cut, "shards")
        sizes = cut.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        last = depth == 3
        fit = sizes if last else sizes.where(F.col("n") <= shard_rows)
        here = cut.join(fit.select("mask", "value"), ["mask", "value"], "left_semi")
        got = C.stage(spark, _search(here, radius), "found")
        out = got if out is None else out.unionByName(got)
        if last:
            break
        over = C.stage(spark, sizes.where(F.col("n") > shard_rows).select("mask", "value"), "large")
        if not over.head(1):
            break
        todo = cut.join(over, ["mask", "value"], "left_semi").select("fp", "mask").distinct()
        masks = [r[0] for r in over.select("mask").distinct().collect()]  # at most 4, 16, 64
    return out


def whole_groups(batches, keys: int):
    """The columns of batches that are sorted by their first ``keys`` columns, cut so that no group of equal keys is parted:
    a group is held until it ends, and nothing beyond it and a batch."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not b.num_rows:
            continue
        cut = 0
        if held and any(held[0][k][0] != cols[k][0] for k in range(keys)):
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        new = np.zeros(b.num_rows - 1, bool)
        for k in range(keys):
            new |= cols[k][1:] != cols[k][:-1]
        at = np.flatnonzero(new)
        if len(at):
            cut = int(at[-1]) + 1
            yield [np.concatenate(c) for c in zip(*held, [c[:cut] for c in cols], strict=True)]
            held = []
        held.append([c[cut:] for c in cols])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def spans(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal keys start and end."""
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    at = [0, *(np.flatnonzero(new) + 1).tolist(), len(keys[0])]
    return list(zip(at, at[1:]))


def _search(shards: DataFrame, radius: int) -> DataFrame:
    def rows(batches):
        for mask, value, fp in whole_groups(batches, 2):
            a, b = [], []
            for s, e in spans(mask, value):
                if e - s == 2:
                    if ((int(fp[s]) ^ int(fp[s + 1])) & (1 << 64) - 1).bit_count() > radius:
                        continue
                    i, j = np.zeros(1, np.int64), np.ones(1, np.int64)
                else:
                    i, j = joined(fp[s:e].view(np.uint64), radius)
                if len(i):
                    a.append(fp[s + i])
                    b.append(fp[s + j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    dealt = shards.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return dealt.mapInArrow(rows, "a long, b long")


@C.small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, *, shingle: int = 5, radius: int = 3, text: str = "text", doc_id: str = "doc_id", shard_rows: int = 20_000) -> DataFrame:
    """doc_id, fingerprint, component_id, text_sha256 for every row.

    component_id is the smallest doc_id that links reach. Null and empty texts, and those of blanks alone, have the
    fingerprint zero and are linked like any other; fewer words than a shingle make one shingle. Null doc_ids are larger
    than others here: they name a component only if it has no other. Repeated rows repeat. No rows give no rows.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("text_sha256"), F.col(text).alias("text"))
    rows = C.stage(spark, fingerprints(src, "text", shingle), "fingerprints")
    fps = C.stage(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    found = components.components(spark, links(spark, fps, radius=radius, shard_rows=shard_rows))
    roots = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    roots = C.stage(spark, roots, "roots")
    least = C.stage(spark, roots.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")  # so that AQE can split the join
    named = C.stage(spark, roots.join(least, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_sha256")


BANDS = 5
_rng = np.random.default_rng(7)
ODD = (_rng.integers(0, 1 << 63, BANDS, np.uint64) << np.uint64(1)) | np.uint64(1)
ADD = _rng.integers(0, 1 << 63, BANDS, np.uint64)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; none for a text without words."""
    import xxhash

    words = text.translate(TO_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    spans = [b" ".join(words)] if len(words) < shingle else [b" ".join(w) for w in zip(*(words[k:] for k in range(shingle)))]
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(s, 42) for s in spans), np.uint64, len(spans)))


def minima(v: np.ndarray) -> list[int]:
    """BANDS minima of a shingle set."""
    if not len(v):
        return [0] * BANDS
    with np.errstate(over="ignore"):
        return [int((((v ^ (v >> np.uint64(29))) * m + c) ^ np.uint64(k)).min().view(np.int64)) for k, (m, c) in enumerate(zip(ODD, ADD))]


class Shard:
    """Sets of 64-bit hashes by the ranks of their elements, rarest first."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets])
        self.values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.rank = np.empty(len(count), np.int64)
        self.rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        ids = self.rank[at]
        self.ids = ids[np.lexsort((ids, self.owner))]
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.mark = np.zeros(len(count), bool)

    def of(self, i: int) -> np.ndarray:
        return self.ids[self.start[i] : self.start[i + 1]]

    def ranks(self, x: np.ndarray) -> np.ndarray:
        """Of those of these hashes that any set has."""
        at = np.minimum(np.searchsorted(self.values, x), len(self.values) - 1)
        return self.rank[at[self.values[at] == x]]

    def similarity(self, ids: np.ndarray, n: int, who: np.ndarray) -> np.ndarray:
        """Of a set of n hashes, of which these ids are here, with those of ``who``, on whole sets."""
        out = np.zeros(len(who))
        self.mark[ids] = True
        part = np.cumsum(self.size[who]) >> 22  # some four million elements at a time
        for s, e in spans(part) if len(who) else ():
            size = self.size[who[s:e]]
            ends = np.cumsum(size)
            here = np.arange(ends[-1]) + np.repeat(self.start[who[s:e]] - (ends - size), size)
            both = np.add.reduceat(self.mark[self.ids[here]], ends - size, dtype=np.int64)
            out[s:e] = both / (n + size - both)
        self.mark[ids] = False
        return out


def similar_pairs(sets: list[bytes], similarity: float, pivots: int | list[int] = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that connect what pairs of at least this Jaccard similarity connect, fewer than there are sets; and the
    distances of all sets from each pivot. Pivots are given by their places, or in number, to be spread over the sets.

    No pair is missed. x and y share at least similarity * max(len x, len y) shingles, so among the shingles of each in any
    one order, here rarest first, the first len - ceil(similarity * len) + 1 have one in common. And as one less the
    similarity is a metric, their distances from a pivot differ by no more than their own distance. What passes both is
    counted out on whole sets. Pairs connected already are passed over, and equal sets are linked to the first of them.
    """
    first: dict[bytes, int] = {}
    a, b, at, same = [], [], [], np.zeros(len(sets), np.int64)
    for i, x in enumerate(sets):
        j = first.setdefault(x, i)
        if j != i:
            a.append(j)
            b.append(i)
        elif x:
            at.append(i)
        same[i] = j
    n, room = len(at), 1 - similarity + 1e-9
    place = {x: k for k, x in enumerate(at)}
    if isinstance(pivots, int):
        chosen = np.linspace(0, n - 1, pivots).astype(int).tolist() if n > 2 * pivots else []
    else:
        chosen = [place.get(int(same[p]), -1) for p in pivots]  # -1: the empty set
    far = np.ones((len(chosen), n))
    if n:
        shard = Shard([np.frombuffer(sets[i], "<u8") for i in at])
        size, root, done = shard.size, np.arange(n), np.zeros(n, bool)
        prefix = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
        leads = np.arange(len(shard.ids)) - shard.start[shard.owner] < prefix[shard.owner]
        order = np.argsort(shard.ids[leads], kind="stable")
        post, tokens = shard.owner[leads][order], shard.ids[leads][order]

        def join(i: int, who: np.ndarray) -> None:
            """Links i to one of each of the clusters that these sets, all similar to it, are in."""
            roots, k = np.unique(root[who], return_index=True)
            k = k[roots != root[i]]
            a.extend([at[i]] * len(k))
            b.extend(at[w] for w in who[k].tolist())
            root[np.isin(root, roots)] = root[i]

        for k, p in enumerate(chosen):
            if p >= 0:
                alike = shard.similarity(shard.of(p), size[p], np.arange(n))
                far[k] = 1 - alike
                join(p, np.flatnonzero(alike >= similarity))
        for i in np.flatnonzero(root != np.bincount(root).argmax()).tolist() if chosen else range(n):
            mine = shard.of(i)[: prefix[i]]
            lo, hi = np.searchsorted(tokens, mine), np.searchsorted(tokens, mine, side="right")
            who = np.unique(np.concatenate([post[x:y] for x, y in zip(lo.tolist(), hi.tolist())]))
            who = who[~done[who] & (np.minimum(size[who], size[i]) >= similarity * np.maximum(size[who], size[i]) - 1e-9)]
            if len(chosen) and len(who):
                who = who[np.abs(far[:, who] - far[:, i, None]).max(0) <= room]
            while len(who := who[root[who] != root[i]]):
                now, who = who[:64], who[64:]  # one that is similar spares the others of its cluster
                alike = now[shard.similarity(shard.of(i), size[i], now) >= similarity]
                if len(alike):
                    join(i, alike)
            done[i] = True
    distances = np.ones((len(chosen), len(sets)))
    for i in range(len(sets)):
        k = place.get(int(same[i]), -1)
        distances[:, i] = far[:, k] if k >= 0 else [0.0 if p < 0 else 1.0 for p in chosen]
    return np.array(a, np.int64), np.array(b, np.int64), distances


def _shared_sets(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: links within groups of texts (band, key, tid, shingles) that each fit into a task."""

    def search(batches):
        for band, key, tid, sets in whole_groups(batches, 2):
            a, b = [], []
            for s, e in spans(band, key):
                if e - s > 1:
                    i, j, _ = similar_pairs(sets[s:e].tolist(), similarity)
                    a.append(tid[s + i])
                    b.append(tid[s + j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    dealt = members.select("band", "key", "tid", "shingles").repartition("band", "key").sortWithinPartitions("band", "key", "tid")
    return dealt.mapInArrow(search, "a long, b long")


MEMBER = 99  # the slot of rows that are no pivots


def _large_groups(spark: SparkSession, big: DataFrame, similarity: float, shard_texts: int, pivots: int = 16) -> DataFrame:
    """a, b: links within groups too large for a task (band, key, n, tid, shingles), without a lost pair.

    Members are dealt into shards that all get the group's pivots; a shard links what it can see, and gives each member's
    distances from the pivots. What then is not in its group's largest cluster asks the others: members are dealt anew, by
    their nearest pivot, and a query goes to those shards whose distances from every pivot come within 1 - similarity of
    its own. Queries stream past the members of a shard.
    """
    big = C.stage(spark, big, "large")
    slot = F.pmod(F.xxhash64("tid", F.lit(1)), F.lit(pivots)).cast("int")
    chosen = C.stage(spark, big.groupBy("band", "key", "n", slot.alias("slot")).agg(F.min("tid").alias("tid")), "chosen")
    chosen = C.stage(spark, big.select("band", "key", "tid", "shingles").join(chosen, ["band", "key", "tid"]), "pivots")
    subs = F.ceil(F.col("n") / F.lit(shard_texts))
    cols = ["band", "key", "sub", "slot", "tid", "shingles"]
    rows = big.select("band", "key", F.pmod(F.xxhash64("tid"), subs).alias("sub"), F.lit(MEMBER).alias("slot"), "tid", "shingles")
    rows = rows.unionByName(chosen.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), subs - 1))).select(*cols))
    found = "a long, b long, band int, key long, tid long, d array<double>"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
    names = ["a", "b", "band", "key", "tid", "d"]

    def solve(batches):
        for band, key, sub, slots, tid, sets in whole_groups(batches, 3):
            for s, e in spans(band, key, sub):
                p = int((slots[s:e] < MEMBER).sum())
                i, j, d = similar_pairs(sets[s:e].tolist(), similarity, list(range(p)))
                yield pa.RecordBatch.from_arrays([pa.array(tid[s + i]), pa.array(tid[s + j]), *(pa.nulls(len(i), t) for t in kinds[2:])], names=names)
                m = e - s - p
                yield pa.RecordBatch.from_arrays([pa.nulls(m, kinds[0]), pa.nulls(m, kinds[1]), pa.array(band[s + p : e], kinds[2]), pa.array(key[s + p : e]), pa.array(tid[s + p : e]), pa.array(list(d[:, p:].T), kinds[5])], names=names)

    dealt = rows.select(*cols).repartition("band", "key", "sub").sortWithinPartitions("band", "key", "sub", "slot", "tid")
    got = C.stage(spark, dealt.mapInArrow(solve, found), "solved")
    linked = got.where("a IS NOT NULL").select("a", "b")
    roots = components.components(spark, linked)
    placed = got.where("a IS NULL").select("band", "key", "tid", "d").join(roots, F.col("tid") == F.col("node"), "left")
    placed = C.stage(spark, placed.select("band", "key", "tid", "d", F.coalesce("root", "tid").alias("cluster"), F.array_position("d", F.array_min("d")).cast("int").alias("slot")), "placed")
    most = C.stage(spark, placed.groupBy("band", "key", "cluster").count().groupBy("band", "key").agg(F.max_by("cluster", F.struct("count", "cluster")).alias("main")), "most")
    asking = C.stage(spark, placed.join(most, ["band", "key"]).where("cluster <> main").drop("main"), "asking")
    if not asking.head(1):
        return linked
    ends = [x for k in range(pivots) for x in (F.min(F.try_element_at("d", F.lit(k + 1))).alias(f"lo{k}"), F.max(F.try_element_at("d", F.lit(k + 1))).alias(f"hi{k}"))]
    blocks = placed.groupBy("band", "key", "slot").agg(F.count(F.lit(1)).alias("many"), *ends)
    blocks = C.stage(spark, blocks.withColumn("parts", F.ceil(F.col("many") / F.lit(shard_texts))), "blocks")
    cols = ["band", "key", "slot", "part", "asks", "tid", "cluster", "d", "shingles"]
    part = F.pmod(F.xxhash64("tid"), F.col("parts"))
    held = placed.join(blocks.select("band", "key", "slot", "parts"), ["band", "key", "slot"]).withColumn("part", part).withColumn("asks", F.lit(0))
    room = 1 - similarity + 1e-9
    within = [F.coalesce(F.try_element_at("d", F.lit(k + 1)).between(F.col(f"lo{k}") - room, F.col(f"hi{k}") + room), F.lit(True)) for k in range(pivots)]
    meets = within[0]
    for x in within[1:]:
        meets = meets & x
    sent = asking.drop("slot").join(blocks, ["band", "key"]).where(meets).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("asks", F.lit(1))
    both = held.select(*cols[:-1]).unionByName(sent.select(*cols[:-1])).join(big.select("band", "key", "tid", "shingles"), ["band", "key", "tid"])

    def answer(batches):
        last, members = None, []
        shard = None
        for b in batches:
            band, key, slots, parts, asks, tid, cluster, far, sets = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            a, o = [], []
            for k in range(b.num_rows):
                at = (band[k], key[k], slots[k], parts[k])
                if at != last:
                    last, members, shard = at, [], None
                if not asks[k]:
                    members.append((tid[k], cluster[k], far[k], np.frombuffer(sets[k], "<u8")))
                    continue
                if shard is None and members:
                    shard = Shard([m[3] for m in members])
                    ids, clusters, fars = np.array([m[0] for m in members]), np.array([m[1] for m in members]), np.array([m[2] for m in members])
                mine = np.frombuffer(sets[k], "<u8")
                if shard is None or not len(mine):
                    continue
                who = np.flatnonzero((clusters != cluster[k]) & (np.abs(fars - far[k]).max(1) <= room) & (np.minimum(shard.size, len(mine)) >= similarity * np.maximum(shard.size, len(mine)) - 1e-9))
                mine = shard.ranks(mine), len(mine)
                seen: list[int] = []
                while len(who):
                    now, who = who[:64], who[64:]
                    alike = now[shard.similarity(*mine, now) >= similarity]
                    for c, x in zip(clusters[alike].tolist(), ids[alike].tolist()):
                        if c not in seen:
                            seen.append(c)
                            a.append(tid[k])
                            o.append(x)
                    who = who[~np.isin(clusters[who], seen)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(o, pa.int64())], names=["a", "b"])

    dealt = both.select(*cols).repartition("band", "key", "slot", "part").sortWithinPartitions("band", "key", "slot", "part", "asks", "tid")
    return linked.unionByName(C.stage(spark, dealt.mapInArrow(answer, "a long, b long"), "answers"))


def _near_fingerprints(spark: SparkSession, texts: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """a, b: links among texts (tid, fp) that connect all whose fingerprints lie within the radius, directly or not."""
    first = C.stage(spark, texts.groupBy("fp").agg(F.min("tid").alias("first")), "distinct")
    found = links(spark, first, radius=radius, shard_rows=shard_rows)
    ends = [first.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_tid")) for x in "ab"]
    apart = found.join(ends[0], "a").join(ends[1], "b").select(F.col("a_tid").alias("a"), F.col("b_tid").alias("b"))
    return texts.join(first, "fp").where("tid <> first").select(F.col("tid").alias("a"), F.col("first").alias("b")).unionByName(apart)


@C.small_batches
def similar(spark: SparkSession, docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, radius: int = 3, text: str = "text", doc_id: str = "doc_id", shard_texts: int = 2000, shard_rows: int = 20_000) -> DataFrame:
    """doc_id, text_sha256, rid, component for every row: texts are linked whose SimHashes lie within ``radius`` bits, and
    those whose sets of shingles have at least this similarity.

    SimHashes are those of the sets, so repeats do not move them, and the shards' BK-trees find all that lie within the
    radius. They alone would lose texts at the similarity, which differ by some ten bits; those are found in groups named by
    minima of the shingle set: a pair at the similarity shares one of five but for 0.03 %. All pairs of a group count that
    are similar on their whole sets of 64-bit shingle hashes, however long the texts and however large the group: one of
    over shard_texts texts is dealt to several tasks. Groups of the same texts, told by 128 bits, are one. Texts without
    words are equal, and have no SimHash. Of repeated rows each is a row. component is the smallest rid reached.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("b"))
    src = src.select("doc_id", F.sha2("b", 256).alias("text_sha256"), "b")

    def rows(batches):
        for b in small(batches):
            sets = [shingle_set(x.as_py(), shingle) for x in b.column(2)]
            fps = pa.array([majority(v) if len(v) else None for v in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps, pa.array([minima(v) for v in sets], pa.list_(pa.int64()))], names=["doc_id", "text_sha256", "fp", "mins"])

    got = src.mapInArrow(rows, "doc_id long, text_sha256 string, fp long, mins array<long>")
    all_rows = C.stage(spark, got.select(F.monotonically_increasing_id().alias("rid"), "*"), "profiles")
    # equal texts are one in what follows
    texts = all_rows.groupBy("text_sha256").agg(F.min("rid").alias("tid"), F.first("fp").alias("fp"), F.first("mins").alias("mins"))
    near = _near_fingerprints(spark, texts.where("fp IS NOT NULL").select("tid", "fp"), radius, shard_rows)
    keys = texts.select("text_sha256", "tid", F.posexplode("mins").alias("band", "key"))
    who = [F.bit_xor(F.xxhash64("tid", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    groups = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), *who).where("n > 1")
    shared = groups.groupBy("n", "x1", "x2").agg(F.min(F.struct("band", "key")).alias("g")).select("g.band", "g.key", "n")
    shared = C.stage(spark, shared, "shared")
    members = C.stage(spark, keys.join(shared, ["band", "key"]), "members")

    # Whole sets only of texts that share a minimum; the shingles of others are not needed again.
    def whole(batches):
        for b in small(batches):
            sets = [shingle_set(x.as_py(), shingle).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["text_sha256", "shingles"])

    asked = src.select("text_sha256", "b").join(members.select("text_sha256").distinct(), "text_sha256", "left_semi")
    sets = asked.groupBy("text_sha256").agg(F.first("b").alias("b")).mapInArrow(whole, "text_sha256 string, shingles binary")
    large = bool(shared.where(F.col("n") > shard_texts).head(1))
    if large:
        sets = C.stage(spark, sets, "sets")
    members = members.join(sets, "text_sha256").select("band", "key", "n", "tid", "shingles")
    links_ = _shared_sets(members.where(F.col("n") <= shard_texts) if large else members, similarity)
    if large:
        links_ = links_.unionByName(_large_groups(spark, members.where(F.col("n") > shard_texts), similarity, shard_texts))
    found = components.components(spark, links_.unionByName(near))
    named = C.stage(spark, texts.select("text_sha256", "tid").join(found, F.col("tid") == F.col("node"), "left").select("text_sha256", F.coalesce("root", "tid").alias("component")), "named")
    return C.stage(spark, all_rows.select("doc_id", "text_sha256", "rid").join(named, "text_sha256"), "similar")


def deduplicate(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """One row of each component of similar texts, that with the smallest doc_id (null is largest); all columns as they were."""
    found = similar(spark, docs, **how)
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_sha256")).alias("k"))
    keep = best.select(F.col("k.doc_id").alias("keep"), F.col("k.text_sha256").alias("sha")).distinct()
    return exact_dedup.one_of_each(spark, docs, keep)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, with its fingerprint and the smallest doc_id that links reach.

    Null texts, empty ones and those of blanks alone have the fingerprint zero; repeated rows repeat; null doc_ids name no
    component that has another; further columns are not read; no documents give no rows.
    """
    return near_duplicates(spark, C.table(spark, sf_dir, "documents"), shingle=3).select("doc_id", "fingerprint", "component_id")


C.travels(__name__)
