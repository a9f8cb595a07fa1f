"""Personal data: patterns, and terms that give away what the patterns protect.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers. What they spell are the protected
entities, and so are the parts they share with others: an address's domain and the words before its @, the first three
parts of an IP address, the first six digits of a card or phone number. Terms that stand in one text with an entity are
then judged by the corpus: with N rows, an entity e in n_e of them, a term t in n_t, and both in n_et, the pointwise
mutual information log2(n_et N / (n_e n_t)) says how many of the entity's log2(N / n_e) bits the term discloses. From a
share ``alpha`` of them on a term goes, wherever it stands in the corpus: it is cut to its first letters where they
disclose less than that, and removed where they do not.

What counts as evidence are k texts that are not near copies of one another. They must be more than chance gives: with
x = n_e n_t / N expected, k log(k / x) - k + x has to exceed the log of the number of pairs judged by 3. One text is no
evidence, as each of its rare words would then disclose whatever stands in it; two can be.

All of it is DataFrame code. Corpus counts are partial sums over rows, shuffled once a term and task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

# Kinds in the order of ties, and their patterns. Each matches what its plain form matches from left to
# right: look-behinds hold starts to where a run begins, and possessive counts never give back, so the time is linear.
KINDS = ("email", "ip", "card", "phone", "general", "removed")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}]{3,}"
MARK = "\uffff"  # what letters and digits of base spans become where terms are looked for
FREE = r"(?<![\p{L}\p{N}\uFFFF])[\p{L}\p{N}]{3,}+(?![\p{L}\p{N}\uFFFF])"

SPAN = "array<struct<kind:int,s:int,e:int,v:string>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Whether the digits of v pass Luhn's check."""
    d = _digits(v)
    n = F.length(d)

    def weighed(i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = x * 2
        return F.when((n - i) % 2 == 0, x).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + weighed(i)) % 10 == 0


def _small_parts(v: Column) -> Column:
    bare = lambda x: F.ltrim(x, F.lit("0"))
    return F.forall(F.split(v, r"\."), lambda x: (F.length(bare(x)) <= 3) & (F.coalesce(F.substring(bare(x), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def _found(text: Column, pattern: str, gate: Column) -> Column:
    """The matches of a pattern from left to right, with the code points between them: an array of (gap, v)."""
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(got))
    return F.when(gate, F.zip_with(gaps, got, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("v"))))


def _placed(found: Column, kind, keep=None, room: int = 256) -> Column:
    """Gaps summed up to places; each match that is kept knows where it starts and ends, in code points. kind is a number or
    a function of a match. Matches go by in runs of ``room``, so that no long array is copied for every match."""
    kind_of = kind if callable(kind) else lambda x: F.lit(kind)
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.length(x["v"])
        more = F.concat(acc["out"], F.array(F.struct(kind_of(x).alias("kind"), s.alias("s"), e.alias("e"), x["v"].alias("v"))))
        return F.struct(e.alias("at"), (F.when(keep(x), more).otherwise(acc["out"]) if keep else more).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), none.alias("out"))
        return F.aggregate(part, start, step, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

    runs = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(found) - 1, F.lit(room)).cast("int")), lambda k: F.slice(found, k * room + 1, F.lit(room)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.coalesce(F.flatten(F.aggregate(runs, start, run, lambda acc: acc["out"])), none)


def base_spans(docs: DataFrame, text: str = "_text") -> DataFrame:
    """docs with ``spans``: kind, start, end and spelling of every base span, by start, then kind."""
    t = F.col(text)
    # A plan of its own for the raw matches: what follows reads them often, and regular expressions run once.
    raw = docs.select(
        "*",
        _found(t, EMAIL, F.contains(t, F.lit("@"))).alias("_email"),
        _found(t, IP, t.rlike(r"[0-9]\.[0-9]")).alias("_ip"),
        _found(t, CARD, t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")).alias("_card"),
        _found(t, PHONE, F.contains(t, F.lit("+"))).alias("_phone"),
    )
    n = lambda x: F.length(_digits(x["v"]))
    spans = F.concat(
        _placed(F.col("_email"), 0),
        F.filter(_placed(F.col("_ip"), 1), lambda x: _small_parts(x["v"])),
        F.filter(_placed(F.col("_card"), 2), lambda x: _luhn(x["v"])),
        F.filter(_placed(F.col("_phone"), 3), lambda x: n(x).between(9, 15)),
    )
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"), x["v"].alias("v"))))
    return raw.withColumn("spans", F.transform(order, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))).drop("_email", "_ip", "_card", "_phone")


def _terms(text: Column) -> Column:
    """Terms as they are found in a text, each then in lower case: that may add a mark, which would end a term."""
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def _head(term: Column, letters: int) -> Column:
    return F.concat(F.substring(term, 1, letters), F.lit("*"))


def _masked(text: Column, spans: Column) -> Column:
    """text, as long as before, without the letters and digits of its base spans."""
    text = F.translate(text, MARK, " ")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = F.greatest(acc["at"], x["s"])
        hidden = F.regexp_replace(F.substring(text, s + 1, x["e"] - s), r"[\p{L}\p{N}]", MARK)
        here = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s - acc["at"]), hidden)
        return F.when(x["e"] <= acc["at"], acc).otherwise(F.struct(x["e"].alias("at"), here.alias("out")))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _entities(x: Column) -> Column:
    """What a base span spells, and its parts, each named by its kind."""
    v = F.lower(x["v"])
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), x["kind"] + 1)
    words = F.regexp_extract_all(F.substring_index(v, "@", 1), F.lit("[a-z]{3,}"), F.lit(0))
    parts = F.when(x["kind"] == 0, F.concat(F.array(F.concat(F.lit("@"), F.substring_index(v, "@", -1))), F.transform(words, lambda w: F.concat(w, F.lit("@")))))
    parts = parts.when(x["kind"] == 1, F.array(F.concat(F.substring_index(v, ".", 3), F.lit(".")))).otherwise(F.array(F.concat(F.substring(_digits(v), 1, 6), F.lit("*"))))
    return F.transform(F.concat(F.array(v), parts), lambda p: F.concat(kind, F.lit(":"), p))


COPIES = 4  # minima by which near copies are told: two texts that share nine of ten words share one but for 0.01 %


def told_terms(spark: SparkSession, base: DataFrame, letters: int) -> tuple[DataFrame, DataFrame]:
    """Of rows with base spans: rid, minima, the entities that two different texts hold, and the terms outside of base
    spans with their first letters. And n_e of each such entity. Others have no evidence to give."""
    free = F.transform(F.regexp_extract_all(_masked(F.col("_text"), F.col("spans")), F.lit(FREE), F.lit(0)), F.lower)
    held = base.where("size(spans) > 0").select("rid", "text_hash", F.array_distinct(F.flatten(F.transform("spans", _entities))).alias("entities"), F.array_distinct(free).alias("w"))
    held = C.stage(spark, held, "held")
    one = held.select("rid", "text_hash", F.explode("entities").alias("entity"))
    mentioned = one.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), (F.min("text_hash") != F.max("text_hash")).alias("two")).where("two").drop("two")
    mentioned = C.stage(spark, mentioned, "entities")
    known = one.join(mentioned.select("entity"), "entity").groupBy("rid").agg(F.collect_list("entity").alias("entities"))
    minima = F.array(*(F.array_min(F.transform("w", lambda x, k=k: F.xxhash64(x, F.lit(k)))) for k in range(COPIES)))
    terms = F.array_distinct(F.concat("w", F.transform("w", lambda x: _head(x, letters))))
    return C.stage(spark, held.select("rid", "w").join(known, "rid").select("rid", minima.alias("minima"), "entities", terms.alias("terms")), "told"), mentioned


def disclosing(spark: SparkSession, src: DataFrame, base: DataFrame, rows: int, *, alpha: float, support: int, letters: int) -> DataFrame:
    """term, kind: terms that disclose a share of at least alpha of an entity's information, and whether to cut or remove
    them. Of one term and several entities the strictest verdict holds."""
    told, mentioned = told_terms(spark, base, letters)
    pairs = told.agg(F.sum(F.size("entities").cast("long") * F.size("terms"))).first()[0] or 1  # not fewer than are judged
    near = told.select("minima", "terms", F.explode("entities").alias("entity")).select("minima", "entity", F.explode("terms").alias("term"))
    words = F.array_distinct(_terms(F.col("_text")))
    seen = src.select(F.explode(F.array_distinct(F.concat(words, F.transform(words, lambda w: _head(w, letters))))).alias("term"))
    corpus = seen.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    joint = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).where("n_et > 1")
    all_rows = F.lit(float(rows))
    pmi = F.log2(F.col("n_et") * all_rows / (F.col("n_e") * F.col("n_t")))
    info = F.log2(all_rows / F.col("n_e"))
    enough = joint.join(corpus, "term").join(mentioned, "entity").where((info > 0) & (pmi >= alpha * info))
    enough = C.stage(spark, enough.select("entity", "term", "n_e", "n_t"), "enough")
    # a near copy of a text adds nothing: of each minimum the different ones count, and the least of these counts
    alike = near.join(enough.select("entity", "term"), ["entity", "term"], "left_semi").select("entity", "term", F.posexplode("minima").alias("m", "v")).distinct()
    alike = alike.groupBy("entity", "term", "m").agg(F.count(F.lit(1)).alias("k")).groupBy("entity", "term").agg(F.min("k").alias("k"))
    k, x = F.col("k").cast("double"), F.col("n_e") * F.col("n_t") / all_rows
    beyond = (k > x) & (k * F.log(k / x) - k + x > math.log(pairs) + 3)
    scored = enough.join(alike, ["entity", "term"]).where((F.col("k") >= support) & beyond).select("entity", "term")
    full = scored.where(~F.endswith("term", F.lit("*"))).withColumn("head", _head(F.col("term"), letters))
    heads = scored.where(F.endswith("term", F.lit("*"))).select("entity", F.col("term").alias("head"), F.lit(True).alias("tells"))
    cut = F.when(F.col("tells"), F.lit(5)).otherwise(F.lit(4))
    return full.join(heads, ["entity", "head"], "left").groupBy("term").agg(F.max(cut).alias("kind"))


def occurrences(spark: SparkSession, src: DataFrame, terms: DataFrame) -> DataFrame:
    """A staged row a text that holds terms: text_hash, and ``more``, the places where they stand outside of base spans."""
    held = src.select(F.xxhash64("_text").alias("text_hash"), F.explode(F.array_distinct(_terms(F.col("_text")))).alias("term")).join(terms, "term")
    told = held.groupBy("text_hash").agg(F.map_from_entries(F.collect_set(F.struct("term", "kind"))).alias("told"))
    texts = src.withColumn("text_hash", F.xxhash64("_text")).join(told, "text_hash").groupBy("text_hash").agg(F.first("_text").alias("_text"), F.first("told").alias("told"))
    rows = base_spans(texts).select("text_hash", "told", _found(_masked(F.col("_text"), F.col("spans")), FREE, F.lit(True)).alias("_words"))
    kind = lambda x: F.try_element_at("told", F.lower(x["v"]))
    return C.stage(spark, rows.select("text_hash", _placed(F.col("_words"), kind, lambda x: kind(x).isNotNull()).alias("more")), "more")


def personal_spans(spark: SparkSession, docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", alpha: float = 0.9, support: int = 2, letters: int = 3, keep_text: bool = False) -> DataFrame:
    """doc_id, text_hash and spans of every row, by start, then kind; with keep_text the text too (staged with the spans).

    A null or empty text has no spans. Repeated rows are rows of their own, and copies of a text count as often as they
    occur, but copies and near copies are one text as evidence. Other columns are ignored; an empty table gives an empty one.
    alpha over 1 adds no terms; no row is ever without its base spans.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    src = docs.select(F.col(doc_id).alias("doc_id"), body.alias("_text"))
    found = base_spans(src)
    kept = F.col("_text") if keep_text else F.when(F.size("spans") > 0, F.col("_text"))
    base = C.stage(spark, found.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("_text").alias("text_hash"), kept.alias("_text"), "spans"), "personal")
    rows = base.count()
    terms = C.stage(spark, disclosing(spark, src, base, max(rows, 1), alpha=alpha, support=support, letters=letters), "terms")
    added = occurrences(spark, src.select("_text"), terms)
    every = F.concat("spans", F.coalesce(F.col("more"), F.array().cast(SPAN)))
    order = F.array_sort(F.transform(every, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"), x["v"].alias("v"))))
    cols = ["doc_id", "text_hash", *(["_text"] if keep_text else [])]
    return base.join(added, "text_hash", "left").select(*cols, order.alias("spans"))


def sanitise(spark: SparkSession, docs: DataFrame, *, letters: int = 3, **how) -> DataFrame:
    """doc_id, sanitised and spans of every row: base spans become their kind in brackets, general terms their first
    letters and a star, removed terms nothing. Spans that overlap are replaced by the one that starts first."""
    got = personal_spans(spark, docs, letters=letters, keep_text=True, **how)
    kind = lambda x: F.element_at(F.array(*(F.lit(k) for k in KINDS)), x["kind"] + 1)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        word = F.substring(F.col("_text"), x["s"] + 1, x["e"] - x["s"])
        put = F.when(x["kind"] < 4, F.concat(F.lit("["), kind(x), F.lit("]"))).when(x["kind"] == 4, F.concat(F.substring(word, 1, letters), F.lit("*"))).otherwise(F.lit(""))
        here = F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, x["s"] - acc["at"]), put)
        return F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(x["e"].alias("at"), here.alias("out")))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.length("_text")))
    return got.select("doc_id", F.aggregate("spans", start, step, rest).alias("sanitised"), F.transform("spans", lambda x: F.struct(kind(x).alias("kind"), x["s"].alias("start"), x["e"].alias("end"))).alias("spans"))


def _joined(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*(F.lit(k) for k in KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, with its personal data counted and located.

    Null and empty texts have none; repeated rows and null doc_ids are rows of their own; matches that overlap with others of
    their kind go to the leftmost, and spans that start together are in the order of kinds; further columns are not read; no
    documents give no rows.
    """
    got = personal_spans(spark, C.table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = _joined(F.filter("spans", lambda x: x["kind"] < 4))
    return got.select("doc_id", n(0).alias("n_email"), n(1).alias("n_ip"), n(2).alias("n_card"), n(3).alias("n_phone"), F.sha2(base, 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
