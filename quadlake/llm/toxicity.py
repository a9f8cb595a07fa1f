"""Toxicity by weak supervision.

Voters are words of a built-in lexicon, and word stems mined from labelled rows: a stem becomes a voter if its documents
are toxic more often than chance and the number of candidates allow for. Each voter fires or abstains on every document.

A stem may have to occur twice, or as a certain share of the words, to count: stems that ordinary words share with
abusive ones tell the classes apart by their density alone.

A generative label model then learns, from how often voters fire together over all documents, how accurate each is:
given the class, voters of a block (those that fire together, as those of one language do) are independent up to a few
pairs, so their covariances have rank one apart from the diagonal. Pairs that stick out are taken as correlated, left out
of the fit, and share one vote. The model's posterior labels train a logistic classifier on votes, hits and density.

Learning touches labels of at most ``labelled_rows`` rows, those first in the order of a hash; counts of votes and of
joint votes cover every document. Scores depend on the text alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .common import small

LEXICON = "idiot moron stupid trash scum loser pathetic worthless disgusting clown dumbass jerk imbecile cretin vermin filth bastard retard bitch asshole whore slut fuck shit".split()
SEPARATORS = " \t\n\x0b\x0c\r"


@dataclass
class Model:
    voters: list[tuple[str, bool, int, float]]  # text, whether it is a whole word, least hits, least hits per word
    alpha: list[float] = field(default_factory=list)  # firing rate on toxic documents
    beta: list[float] = field(default_factory=list)  # on others
    share: list[float] = field(default_factory=list)  # of a vote, less for correlated voters
    block: list[int] = field(default_factory=list)
    prior: float = 0.1
    weights: list[float] = field(default_factory=list)

    @property
    def m(self) -> int:
        return len(self.voters)


def finder(voters: list[tuple[str, bool, int, float]]):
    """A function from a text to (the voters that fire, hits, words); words are one more than separators."""
    import ahocorasick

    a = ahocorasick.Automaton()
    terms = sorted({(w, whole) for w, whole, _, _ in voters})
    at: dict[str, list[tuple[int, bool]]] = {}
    for i, (w, whole) in enumerate(terms):
        at.setdefault(w, []).append((i, whole))
    for w, v in at.items():
        a.add_word(w, (len(w), v))
    if at:
        a.make_automaton()
    place = {t: i for i, t in enumerate(terms)}
    rules = [(k, place[w, whole], least, rate) for k, (w, whole, least, rate) in enumerate(voters)]

    def find(text: str | None) -> tuple[list[int], int, int]:
        if not text:
            return [], 0, 0
        low = text.lower()
        words = sum(map(text.count, SEPARATORS)) + 1
        counts: dict[int, int] = {}
        for end, (n, who) in a.iter(low) if at else ():
            if end >= n and low[end - n].isalpha():
                continue
            for i, whole in who:
                if not whole or end + 1 == len(low) or not low[end + 1].isalpha():
                    counts[i] = counts.get(i, 0) + 1
        if not counts:
            return [], 0, words
        votes = [k for k, i, least, rate in rules if (c := counts.get(i, 0)) >= least and c >= rate * words]
        return votes, sum(counts.values()), words

    return find


def vectors(m: int, votes: list[list[int]], hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the classifier sees: each vote, their number, hits and hits a hundred words on a log scale, and a constant."""
    out = np.zeros((len(votes), m + 4))
    for row, on in zip(out, votes):
        row[on] = 1
        row[m] = len(on)
    out[:, m + 1], out[:, m + 2], out[:, m + 3] = np.log1p(hits), np.log1p(100 * hits / np.maximum(words, 1)), 1
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, _y and text of the labelled rows to learn from, at most ``rows``; repeated labels of a document count as toxic
    if one is, and of rows that share a doc_id the least text is taken."""
    ok = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    some = ok.groupBy("doc_id").agg(F.max("toxic").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = some.select(F.col("doc_id").alias("_id"), "_y")
    got = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    return got.groupBy("doc_id", "_y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


LEVELS = ((1, 0.0), (2, 0.0), (2, 0.004), (2, 0.01))  # least hits, least hits per word


def mine(sample: DataFrame, lengths: tuple[int, ...] = (3, 4, 5, 6, 7, 8)) -> tuple[list[tuple[str, bool, int, float]], float, int]:
    """Stems at a level whose documents are toxic beyond chance; the share of toxic rows; the rows. A candidate with t
    toxic of n documents stands if n KL(t/n, prior) exceeds the log of the number of candidates by 3, and t/n is over one
    half. Of stems that start one another, the one with the largest such gain becomes a voter."""
    size = sample.groupBy("_y").count().collect()
    t_all = sum(r["count"] for r in size if r["_y"])
    n_all = sum(r["count"] for r in size)
    if not t_all or t_all == n_all:
        return [], (t_all + 1) / (n_all + 10), n_all
    prior = t_all / n_all
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), 1)
    heads = lambda w: F.array_distinct(F.array(*(F.substring(w, 1, n) for n in lengths)))
    per_doc = sample.select("_y", (F.length("text") - F.length(F.translate("text", SEPARATORS, "")) + 1).alias("words"), F.monotonically_increasing_id().alias("d"), F.flatten(F.transform(words, heads)).alias("h"))
    per_doc = per_doc.select("d", "_y", "words", F.explode("h").alias("w")).groupBy("d", "_y", "words", "w").agg(F.count(F.lit(1)).alias("c"))
    fires = [(F.col("c") >= least) & (F.col("c") >= rate * F.col("words")) for least, rate in LEVELS]
    sums = [x for k, f in enumerate(fires) for x in (F.count_if(f & (F.col("_y") == 1)).alias(f"t{k}"), F.count_if(f).alias(f"n{k}"))]
    terms = per_doc.groupBy("w").agg(*sums)
    flat = terms.select("w", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"t{k}").alias("t"), F.col(f"n{k}").alias("n")) for k in range(len(LEVELS))))).alias("x")).select("w", "x.*")
    flat = flat.where((F.col("t") >= 2) & (2 * F.col("t") > F.col("n")))
    flat = C.stage(sample.sparkSession, flat, "terms")
    many = 10 * max(flat.count(), 100)
    p = F.col("t") / F.col("n")
    gain = F.col("n") * (p * F.log(p / prior) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - prior))).otherwise(0.0))
    # the vocabulary of the labelled rows, which are bounded, bounds this too
    found = flat.withColumn("gain", gain).where(F.col("gain") > math.log(many) + 3).orderBy(F.desc("gain"), "w", "k").collect()
    kept: list[tuple[str, bool, int, float]] = []
    stems, starts = set(), set()
    for r in found:
        heads_ = {r["w"][:n] for n in range(1, len(r["w"]) + 1)}
        if r["w"] not in starts and not heads_ & stems:
            kept.append((r["w"], False, *LEVELS[r["k"]]))
            stems.add(r["w"])
            starts |= heads_
    return kept, prior, n_all


VOTES = "doc_id long, votes array<int>, hits long, words long"


def vote_table(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and votes of every row."""
    voters = model.voters

    def rows(batches):
        find = finder(voters)
        for b in small(batches):
            got = [find(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.list_(pa.int32())), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "votes", "hits", "words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, VOTES)


def moments(votes: DataFrame, m: int) -> tuple[int, np.ndarray]:
    """Documents, and how many each pair of voters fires on together; on the diagonal, each alone. m (m + 1) / 2 sums."""
    total = votes.count()
    fired = votes.where("size(votes) > 0").groupBy(F.col("votes").alias("on")).count()
    pairs = fired.select("count", "on", F.explode("on").alias("i")).select("count", "i", F.explode("on").alias("j")).where("i <= j").groupBy("i", "j").agg(F.sum("count").alias("n")).collect()
    out = np.zeros((m, m))
    for r in pairs:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["n"]
    return total, out


def label_model(model: Model, total: int, joint: np.ndarray, truth: np.ndarray, y: np.ndarray) -> None:
    """Fills alpha, beta, share and block. truth and y (votes and labels of the labelled rows) set the classes' shares and
    stand in where a block has under three voters, which covariances alone cannot tell apart."""
    m, n = model.m, max(total, 1)
    p = np.diag(joint) / n
    cov = joint / n - np.outer(p, p)
    block = np.arange(m)
    for i in range(m):  # voters that fire together far more often than by chance
        for j in range(i):
            if joint[i, j] >= 3 and joint[i, j] > 3 * n * p[i] * p[j]:
                block[block == block[i]] = block[j]
    pos, neg = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    alpha = (truth[y == 1].sum(0) + 0.5) / (pos + 1) if len(y) else np.full(m, 0.2)
    beta = (truth[y == 0].sum(0) + 0.5) / (neg + 1) if len(y) else np.full(m, 0.002)
    share = np.ones(m)
    for b in set(block.tolist()):
        who = np.flatnonzero((block == b) & (p > 0))
        if len(who) < 3:
            continue
        own = truth[:, who].any(1) if len(y) else np.zeros(0, bool)
        prior = (float((own & (y == 1)).sum()) + 0.5) / (len(y) + 5) if len(y) else 0.5 * model.prior
        s = cov[np.ix_(who, who)]
        use = ~np.eye(len(who), dtype=bool)
        for _ in range(4):  # a rank-one fit off the diagonal, then without the pairs that stick out
            u = np.sqrt(np.maximum(np.abs(s[use]).mean(), 1e-18)) * np.ones(len(who))
            for _ in range(200):
                d = (use * u**2).sum(1)
                u = np.where(d > 0, np.maximum((use * s) @ u, 0) / np.maximum(d, 1e-18), u)
            rest = (s - np.outer(u, u)) / np.sqrt(np.outer(p[who], p[who]) / n + 1e-18)
            odd = (rest > 6) & (s > 1.5 * np.outer(u, u)) & ~np.eye(len(who), dtype=bool)
            if not (odd & use).any() or (use & ~odd).sum(1).min() < 2:
                break
            use &= ~odd
        gap = u / math.sqrt(prior * (1 - prior))
        a, c = p[who] + (1 - prior) * gap, p[who] - prior * gap
        good = gap > 1e-6
        alpha[who] = np.where(good, np.clip(a, 1e-4, 0.98), alpha[who])
        beta[who] = np.where(good, np.clip(c, 0.2 * beta[who], None), beta[who])
        odd = ~use & ~np.eye(len(who), dtype=bool)
        share[who] = 1 / (1 + odd.sum(1))
    beta = np.maximum(beta, 1e-5)
    model.alpha, model.beta, model.share, model.block = np.maximum(alpha, 1e-4).tolist(), beta.tolist(), share.tolist(), block.tolist()


def posterior(model: Model, v: np.ndarray) -> np.ndarray:
    """P(toxic | votes). Silence counts only in blocks that have a vote: other languages say nothing."""
    a, b, s, block = (np.array(x) for x in (model.alpha, model.beta, model.share, model.block))
    same = (block[:, None] == block[None, :]).astype(float)
    awake = (v @ same > 0).astype(float)
    on, off = s * np.log(a / b), s * np.log(np.clip(1 - a, 0.02, 1) / np.clip(1 - b, 0.02, 1))
    z = math.log(model.prior / (1 - model.prior)) + v @ on + (awake * (1 - v)) @ off
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method for soft labels; the last column is the constant and isn't shrunk."""
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = np.diag(pen)
        for k in range(0, len(x), 4096):
            part = x[k : k + 4096]
            h += part.T @ (part * (q[k : k + 4096] * (1 - q[k : k + 4096]) + 1e-9)[:, None])
        step = np.linalg.solve(h, x.T @ (y - q) - pen * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@C.small_batches
def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled_rows: int = 20_000) -> tuple[Model, DataFrame]:
    """The model, and the staged votes of every row of docs. Without usable labels the lexicon alone votes."""
    sample = C.stage(spark, labelled(docs, labels, labelled_rows), "labelled")
    found, prior, n = mine(sample)
    model = Model([(w, True, 1, 0.0) for w in LEXICON if not any(w.startswith(v[0]) for v in found)] + found, prior=min(max(prior, 0.01), 0.5))
    m = model.m
    votes = C.stage(spark, vote_table(docs, model), "votes")
    total, joint = moments(votes, m)
    known = vote_table(sample, model).join(sample.select(F.col("doc_id").alias("_d"), "_y").distinct(), F.col("doc_id") == F.col("_d")).select("votes", "hits", "words", "_y").toPandas()  # a row a labelled document
    x = vectors(m, known.votes.tolist(), known.hits.to_numpy(np.int64), known.words.to_numpy(np.int64))
    y = known["_y"].to_numpy(np.int64) if n else np.zeros(0, np.int64)
    label_model(model, total, joint, x[:, :m], y)
    if n:
        q = posterior(model, x[:, :m])
        silent = ~x[:, :m].any(1)  # no voter of any block: as rarely toxic as such labelled rows are
        q[silent] = (y[silent].sum() + 0.5) / (silent.sum() + 5)
        model.weights = logistic(x, q).tolist()
    else:
        model.weights = [2.0] * m + [0.0, 1.0, 0.0, -4.0]
    C.unstage(spark, sample)
    return model, votes


def score(model: Model, votes: list[list[int]], hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(vectors(model.m, votes, hits, words) @ np.array(model.weights), -30, 30)))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, labelled_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted, hits for every row.

    Null and empty texts get the score of a text without votes. Rows repeat as they are; equal texts score alike. A null
    doc_id is not held out, and has no label. Other columns are ignored; an empty table gives an empty one.
    """
    model, votes = fit(spark, docs, labels, labelled_rows)

    def rows(batches):
        for b in small(batches):
            got = score(model, b.column(1).to_pylist(), b.column(2).to_numpy(), b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64()), b.column(2)], names=["doc_id", "score", "hits"])

    out = votes.mapInArrow(rows, "doc_id long, score double, hits long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")


@C.small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score under the threshold, all columns as they were, whatever their names."""
    model, votes = fit(spark, docs, labels)
    C.unstage(spark, votes)
    at = docs.columns.index("text")

    def clean(batches):
        find = finder(model.voters)
        for b in small(batches):
            got = [find(t) for t in b.column(at).to_pylist()]
            scores = score(model, [g[0] for g in got], np.array([g[1] for g in got]), np.array([g[2] for g in got]))
            yield b.filter(pa.array(scores < threshold))

    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names with dots don't pass through Arrow
    return C.stage(spark, plain.mapInArrow(clean, plain.schema), "clean").toDF(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, with its score.

    Null and empty texts score as texts without votes; equal texts score alike, repeated rows repeat; a null doc_id has no
    label and is not held out; further columns are not read. No documents give no rows; without labels the lexicon votes.
    """
    return toxicity(spark, C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


C.travels(__name__)
