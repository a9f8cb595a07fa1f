"""The corpus queries against brute force, on a small table with nulls, empty, long, repeated and tied rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from quadlake.llm import entry, exact_dedup, matroska, mixing, packing, sharding, simhash, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    base = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    t = base["text"].tolist()
    words = t[3].split(" ")
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (5, 9)]
    more = [None, "", " \n\t", "one", "one two", t[0], t[0], t[5], *near, t[1] * 12, "İstanbul ÇA Ünï  x \x1c y", "<|endoftext|> a  b\n\n c", "a<|endoftext|>b", "x <|STARTOFTEXT|> y <|startoftext|>z", "é" * 3000, "a 's 12 34, b", None]
    extra = pd.DataFrame({"doc_id": range(100_000, 100_000 + len(more)), "text": more, "lang": ["en"] * len(more), "source": ["zz"] * (len(more) - 2) + [None, "a"], "n_chars": [len(x or "") for x in more]})
    docs = pd.concat([base, extra], ignore_index=True)
    labels = pd.read_parquet("/root/testdata/sf0.001/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [tuple(None if x is None or x != x else x for x in r) for r in docs.itertuples(index=False)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([tuple(map(int, r)) for r in labels.itertuples(index=False)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_exact(spark, sf):
    got = {r.doc_id: r for r in exact_dedup.op8(spark, sf[0]).collect()}
    groups = defaultdict(list)
    for d, t, *_ in sf[1]:
        groups[t or ""].append(d)
    assert len(got) == len(sf[1])
    for t, ids in groups.items():
        for d in ids:
            r = got[d]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), d == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_names_are_verified(spark):
    """Weak block keys collide; the naming must notice and still tell texts apart. Small blocks make many levels."""
    texts = ["ab" * k + "c" for k in range(40)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = exact_dedup.exact_duplicates(spark, docs, block_bytes=4, key_bits=8).collect()
    assert all(r.group_size == 2 and r.keep_id == (r.doc_id % 40) + 40 for r in got)


def test_mix(spark, sf):
    got = {r.doc_id: r for r in mixing.op1(spark, sf[0]).collect()}
    size = {d: len(WORD.findall(t or "")) for d, t, *_ in sf[1]}
    source = {d: s for d, _, _, s, _ in sf[1]}
    totals = Counter()
    for d, n in size.items():
        totals[source[d]] += n
    order = sorted((s for s in totals if s is not None)) + ([None] if None in totals else [])
    weight = {s: Fraction((5, 2, 1)[k % 3]) for k, s in enumerate(order)}
    target, left, total = {}, set(order), Fraction(sum(size.values()))
    while left:
        share = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if share * weight[s] > 3 * totals[s]}
        target |= {s: Fraction(3 * totals[s]) for s in over} if over else {s: share * weight[s] for s in left}
        left -= over or left
    taken = Counter()
    for d, r in got.items():
        assert r.size == size[d] and r.source_size == totals[source[d]] and abs(r.target - float(target[source[d]])) < 1e-6 * (1 + r.target)
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[source[d]] += r.taken
    biggest = {s: max(size[d] for d in size if source[d] == s) for s in order}
    for s in order:
        assert abs(taken[s] - float(target[s])) <= max(0.02 * float(target[s]), biggest[s]), s
    again = {r.doc_id: r.taken for r in mixing.op1(spark, sf[0]).collect()}
    assert again == {d: r.taken for d, r in got.items()}


def test_media(spark, sf):
    got = {r.doc_id: r for r in matroska.op2(spark, sf[0]).collect()}
    for d, t, *_ in sf[1]:
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        media = matroska.mux(p)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_lacing_and_unknown_sizes(spark):
    frames = [b"a" * 5, b"b" * 300, b"c" * 2, b"d" * 700]
    body = matroska.uint(matroska.TIME, 7)
    for kind in (matroska.XIPH, matroska.EBML_LACING):
        body += matroska.element(matroska.SIMPLE, matroska.block(frames, 3, kind))
    body += matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, matroska.block(frames[:1], 4)) + matroska.uint(0xFB, 1))
    unknown = matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska.AUDIO + matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body + matroska.element(matroska.CUES, b"")
    data = matroska.HEAD + unknown
    p = matroska.parse(data)
    assert [data[o : o + s] for _, _, o, s, _ in p.packets] == [*frames, *frames, frames[0]]
    assert p.packets[0][1] == 10_000_000 and not p.packets[-1][4]
    docs = spark.createDataFrame([(1, data), (2, b"junk"), (3, None), (4, data[:-400])], "doc_id long, media binary")
    rows = matroska.packet_table(docs).collect()
    assert Counter(r.doc_id for r in rows) == {1: 9, 2: 1, 4: 1} and all(r.error for r in rows if r.doc_id != 1)


def ids_of(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_files(spark, sf):
    got = {r.doc_id: r for r in token_files.op3(spark, sf[0]).collect()}
    rows = sorted(sf[1], key=lambda r: r[0])
    start = 0
    for (d, *_), ids in zip(rows, ids_of("word_bpe_49k.json", [r[1] for r in rows])):
        ids = [*ids, 1]
        r = got[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), d
        start += len(ids)


def test_random_access():
    v = np.random.default_rng(1).integers(0, 1 << 20, 5000).astype(np.uint32)
    c = token_files.Codes(token_files.encode(v, np.array([0, 10, 5000]), [7, None]))
    at = np.random.default_rng(2).integers(0, 5000, 700)
    assert (c.access(at) == v[at]).all() and (c.span(1234, 4321) == v[1234:4321]).all() and (c.document(0) == v[:10]).all()


def test_packing(spark, sf):
    got = packing.op7(spark, sf[0]).collect()
    ids = {r[0]: [*x, 0] for r, x in zip(sf[1], ids_of("byte_bpe_50k.json", [r[1] for r in sf[1]]))}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for d, x in ids.items():
        at = 0
        for k, r in enumerate(sorted(pieces[d], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(np.array(x[at : at + r.length], "<u4").tobytes()))
            assert len(x) <= 2048 or k == 0 or r.length == 2048
            at += r.length
        assert at == len(x) and (len(x) > 2048 or len(pieces[d]) == 1)
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= 1.02 * sum(map(len, ids.values())) / 2048 + 2


@pytest.mark.parametrize("cap", [12, 100])
def test_sums_of_squares(cap):
    """Every placement against all others that were open to it, the squares counted anew for each."""

    def cost(left):
        return sum(v * v for v in Counter(g for g in left if g).values())

    r = np.random.default_rng(3)
    for _ in range(20):
        sizes = r.integers(1, cap + 1, 60).tolist()
        bins, offsets = packing.pack(np.array(sizes), cap)
        left = []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            tried = {}
            for b in [*range(len(left)), None]:
                gap = cap if b is None else left[b]
                if gap >= sizes[i]:
                    after = [*left, cap] if b is None else list(left)
                    after[len(left) if b is None else b] -= sizes[i]
                    tried[b] = cost(after), b is None, gap
            b = None if bins[i] == len(left) else int(bins[i])
            assert tried[b] == min(tried.values())  # of equals the smallest gap, a new bin last
            if b is None:
                left.append(cap)
            assert offsets[i] == cap - left[bins[i]]
            left[bins[i]] -= sizes[i]


def test_sharding(spark, sf):
    got = sharding.op6(spark, sf[0]).collect()
    assert len(got) == len(sf[1])
    text = {r[0]: (r[1] or "").encode() for r in sf[1]}
    slots = defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32, r.law) == (len(text[r.doc_id]) + 8, zlib.crc32(text[r.doc_id]), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a", 1), (None, "a", 2), (5, None, 3), (5, None, 3)], "doc_id long, text string, shard int")
    got = sharding.shard_rows(spark, docs, [1.0, 2.0]).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.doc_id is None}) == 1 and len({(r.shard, r.slot) for r in got}) == 4


def fingerprint(t):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    w = WORD.findall(low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(n)]


def test_simhash(spark, sf):
    got = {r.doc_id: r for r in simhash.op5(spark, sf[0]).collect()}
    rows = sorted(sf[1], key=lambda r: r[0])
    fp = [fingerprint(r[1]) for r in rows]
    root = components(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        assert (got[r[0]].fingerprint, got[r[0]].component_id) == (f"{fp[i]:016x}", rows[root[i]][0])


@pytest.mark.parametrize("shard_rows", [20_000, 10])
def test_links_of_close_fingerprints(spark, shard_rows):
    r = np.random.default_rng(5)
    centre = r.integers(0, 1 << 62, 40)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in r.choice(63, k, replace=False)) for c in centre for k in (0, 1, 2, 3, 5, 6)} | {1 << k for k in range(20)} | {0})
    root = components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = simhash.links(spark, df, radius=3, shard_rows=shard_rows)
    pairs = {(a, b) for a, b in links.collect()}
    at = {x: i for i, x in enumerate(fps)}
    edges = {(at[a], at[b]) for a, b in pairs} | {(at[b], at[a]) for a, b in pairs}
    assert all((fps[i] ^ fps[j]).bit_count() <= 3 for i, j in edges)
    assert components(len(fps), lambda i, j: (i, j) in edges) == root


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"  # smaller tables have too few labels to learn from
    got = toxicity.op9(spark, d).toPandas()
    docs = pd.read_parquet(f"{d}/documents.parquet")
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"]) and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    both = got.merge(docs, on="doc_id")
    assert (both.groupby("text")["score"].nunique() == 1).all()
    x = got.merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    x = x[x["held_out"]]
    hit = int(((x["predicted"] == 1) & (x["toxic"] == 1)).sum())
    print("held out", len(x), "toxic", int(x["toxic"].sum()), "predicted", int(x["predicted"].sum()), "hit", hit)
    assert hit >= 0.8 * x["toxic"].sum() and hit >= 0.8 * x["predicted"].sum()


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet")
    pred = {r.doc_id: r.predicted for r in toxicity.op9(spark, sf[0]).collect()}
    held = {r.doc_id: r.text for r in corpus_pipeline.clean(spark, docs, sf[0]).collect()}
    assert set(held) == {d for d, p in pred.items() if not p}
    left = docs.where(docs.doc_id.isin(list(held)))
    assert corpus_pipeline.exact(spark, left, sf[0]).columns == docs.columns
    held2 = {r.doc_id: r.text for r in corpus_pipeline.exact(spark, left, sf[0]).collect()}
    last = {}
    for d, t in held.items():
        last[t or ""] = max(d, last.get(t or "", -1))
    assert set(held2) == set(last.values())
    left = docs.where(docs.doc_id.isin(list(held2)))
    held3 = {r.doc_id for r in corpus_pipeline.near(spark, left, sf[0]).collect()}
    ids = sorted(held2)
    sh = [shingles(held2[d]) for d in ids]
    root = components(len(ids), lambda i, j: len(sh[i] & sh[j]) >= 0.8 * len(sh[i] | sh[j]) if sh[i] or sh[j] else True)
    assert held3 == {ids[k] for k in root}
    left = docs.where(docs.doc_id.isin(list(held3)))
    copies = Counter(r.doc_id for r in corpus_pipeline.mixed(spark, left, sf[0]).collect())
    want = {r.doc_id: r.copies for r in mixing.mix(spark, left).collect() if r.copies}
    assert copies == want
    assert {r.doc_id for r in corpus_pipeline.packed(spark, left, sf[0]).collect()} == held3


NO_DOCS, NO_LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def written(spark, docs, labels, d):
    docs.write.mode("overwrite").parquet(f"{d}/documents.parquet")
    labels.write.mode("overwrite").parquet(f"{d}/labels.parquet")
    return d


def test_empty_tables(spark, tmp_path):
    """No documents and no labels: every query and stage gives no rows."""
    docs = spark.createDataFrame([], NO_DOCS)
    d = written(spark, docs, spark.createDataFrame([], NO_LABELS), str(tmp_path))
    for name, query in entry.queries().items():
        assert query(spark, d).collect() == [], name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).collect() == [], name


CLASHES = ["_h", "_d", "_s", "_sha", "_th", "_i", "_copies", "_keep", "copies", "size", "rid", "keep", "sha", "d", "h", "s", "i", "th", "name", "level", "key", "n", "_text", "_y", "_id", "fp", "mask", "tid", "did", "body", "spans", "shard", "_bucket", "media", "term", "a.b"]


def test_clashing_columns_and_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows and columns of our own names: the queries read past them, and stages keep them as
    they were. No label at all: the lexicon votes."""
    texts = [None, "", "a b c d e f", "a b c d e f", "a b c d e g", "you idiot moron trash scum", "x " * 700, "mail me@x.org now", None]
    rows = [(None if i == 4 else i // 2, t, None, None if i % 3 else f"s{i % 2}", None, *(f"{c}{i}" if i % 2 else None for c in CLASHES)) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2]]
    docs = spark.createDataFrame(rows, NO_DOCS + "".join(f", `{c}` string" for c in CLASHES))
    plain = docs.select(*NO_DOCS.replace(" long", "").replace(" string", "").split(", "))
    d, e = (written(spark, x, spark.createDataFrame([], NO_LABELS), str(tmp_path / k)) for k, x in (("clash", docs), ("plain", plain)))
    for name, query in entry.queries().items():
        if name == "op7_sum_of_squares_packing":
            assert query(spark, d).count() == query(spark, e).count() == len(rows)
            continue
        got, want = (sorted(map(repr, query(spark, x).collect())) for x in (d, e))
        assert got == want and len(got) == len(rows), name
    whole = Counter(map(repr, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        kept = Counter(map(repr, out.collect()))
        assert set(kept) <= set(whole) and kept, name
        if name == "toxicity":
            assert not any("idiot" in x for x in kept) and sum(kept.values()) == len(rows) - 1
        elif name != "mix_sources":
            assert all(kept[x] <= 1 for x in kept), name


def test_labelled_rows_are_bounded(spark):
    docs = spark.createDataFrame([(k % 5, f"text {k}") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(5)] * 3, NO_LABELS)
    got = toxicity.labelled(docs, labels, 3).collect()
    assert 0 < len(got) <= 3 and all(r.text == min(f"text {k}" for k in range(r.doc_id, 50, 5)) for r in got)


def test_many_voters(spark):
    """More stems than a long has bits, each with a vote of its own."""
    stems = [f"{a}{b}{c}x" for a in "bcdfgh" for b in "aeiou" for c in "klmn"][:100]
    texts = [f"{w} fine {w}" for w in stems for _ in range(12)] + ["all is well here"] * 9000
    model, votes = toxicity.fit(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(i, 0, int(i < 1200)) for i in range(len(texts))], NO_LABELS))
    assert len({v[0] for v in model.voters} & {w[:3] for w in stems}) > 64
    assert max(max(r.votes, default=0) for r in votes.collect()) > 64


def test_multipliers_solve_the_dual(spark):
    """Each source's multiplier against bisection on its own sum."""
    r = np.random.default_rng(8)
    counts = [(s, int(n), int(r.integers(1, 30))) for s in "abcd" for n in set(r.integers(1, 400, 40).tolist())]
    sizes = spark.createDataFrame(counts, "source string, size long, n long")
    goal = mixing.targets(sizes, (5, 2, 1), 3.0)
    want = {g.source: g for g in goal.collect()}
    for g in mixing.multipliers(spark, sizes, goal, 3.0, 40, 1e-9).collect():
        mine = np.array([(n, k) for s, n, k in counts if s == g.source], float)
        words = lambda lam: (mine[:, 0] * mine[:, 1] * np.minimum(3.0, np.exp(lam * mine[:, 0] / g.x_unit))).sum()
        if g.full:
            assert want[g.source].target == want[g.source].cap
            continue
        lo, hi = -50.0, 50.0
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if words((lo + hi) / 2) < want[g.source].target else (lo, (lo + hi) / 2)
        assert abs(g.lam - lo) < 1e-6 and abs(words(g.lam) - want[g.source].target) < 1e-6 * want[g.source].target


def test_copies_never_exceed_the_most(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 7), "only" if k else "other") for k in range(300)], "doc_id long, text string, source string")
    assert all(r.copies <= 2 for r in mixing.mix(spark, docs, most=2.0, weights=(1, 50)).collect())


@pytest.mark.parametrize(("name", "cut"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "blanks")])
@pytest.mark.parametrize(("entries", "chars"), [(400_000, 8 << 20), (40, 300)])
def test_pieces_are_learned_once(sf, name, cut, entries, chars):
    """Ids are the library's on whole texts, whatever the cache holds; of many copies' pieces each is encoded once."""
    from quadlake.llm import tokens

    enc = tokens.Encoder(public_tokenizers.path(name), cut, entries, chars)
    texts = [t or "" for _, t, *_ in sf[1]] + ["", " ", "\n", "a\tb", "x" * 70 + " y", "y " + "x" * 70, "\tz", "a b\nc", "\nq", "q \n", "it's, it's.", "Σας Σ", "\x00a a"]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.t.encode_batch(texts, add_special_tokens=False)]
    assert [x for i in range(0, len(texts), 100) for x in enc(texts[i : i + 100])] == want
    assert enc(texts) == want and enc([]) == []
    learned, plain = [], enc._learn
    enc._learn = lambda new: learned.extend(new) or plain(new)
    words = [f"zq{chr(97 + k)}w" for k in range(20)]
    enc([" ".join(["a", *words, "b"])] * 50)
    assert sorted(set(words) & set(learned)) == words and len(learned) == len(set(learned))


def test_batches_put_together():
    """Every row in its order, in batches that end once they hold so many rows or bytes."""
    import pyarrow as pa
    from quadlake.llm import common

    sizes = [3, 0, 5, 9, 1, 1, 1]
    batches = [pa.RecordBatch.from_pydict({"n": pa.array(range(10 * k, 10 * k + s), pa.int64())}) for k, s in enumerate(sizes)]
    want = [x for b in batches for x in b.column(0).to_pylist()]
    for rows, size, lengths in ((8, 1 << 20, [8, 9, 3]), (100, 64, [8, 9, 3]), (100, 1 << 20, [20])):
        got = list(common.together(iter(batches), rows, size))
        assert [x for b in got for x in b.column(0).to_pylist()] == want and [b.num_rows for b in got] == lengths
    assert list(common.together(iter([]))) == []
