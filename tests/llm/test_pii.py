"""Personal data: base spans against Python's regular expressions, and the disclosing terms against a brute-force count."""

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from quadlake.llm import pii

PLAIN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for k, (name, p) in enumerate(PLAIN):
        for m in p.finditer(text or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in v.split(".")) if name == "ip" else True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def texts():
    r = random.Random(3)
    bits = ["a@b.c", "_d@e.f", "x@y", "é", "😀", " ", ".", "-", "+1 (555) 123-4567", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "300.1.2.3.4", "0001.2.3.04", "1 2 3", "12", "@", "%", "word ", "\n", "4", "9999999999999999999999"]
    made = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    return [*made, "", None, "1" * 5000, "a" * 5000 + "@", "1 " * 3000, "+" * 2000, "1.2.3.4." * 500, "a@b.c_d@e.f"]


def test_base_spans(spark):
    rows = [(i, t, 0, "k") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid int, spans string")
    got = {r.doc_id: r.spans for r in pii.personal_spans(spark, docs, support=10**6).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        assert [(x.s, x.kind, x.e) for x in got[i]] == brute(t), t


def disclosed(texts, alpha, support, reach=60, letters=3):
    """(entity, term) pairs by counting, and whether the first letters tell too."""
    terms = lambda t: {x for w in re.findall(r"[^\W_]{3,}", t.lower()) for x in (w, w[:letters] + "*")}
    n_t, n_e, n_et, ctx = {}, {}, {}, {}
    for i, t in enumerate(texts):
        for x in terms(t):
            n_t[x] = n_t.get(x, 0) + 1
        spans = brute(t)
        for s, k, e in spans:
            entity = f"{PLAIN[k][0]}:{t[s:e].lower()}"
            n_e.setdefault(entity, set()).add(i)
            lo, hi = max(0, s - reach), min(len(t), e + reach)
            for m in re.finditer(r"[^\W_]{3,}", t[lo:hi]):
                a, b = m.start() + lo, m.end() + lo
                if (a == lo and lo > 0) or (b == hi and hi < len(t)) or any(a < y and x < b for x, _, y in spans):
                    continue
                for w in (m.group().lower(), m.group().lower()[:letters] + "*"):
                    n_et.setdefault((entity, w), set()).add(i)
                    ctx.setdefault((entity, w), set()).add(t[lo:hi])
    out = set()
    for (e, w), rows in n_et.items():
        info = math.log2(len(texts) / len(n_e[e]))
        if len(ctx[e, w]) >= support and info > 0 and math.log2(len(rows) * len(texts) / (len(n_e[e]) * n_t[w])) >= alpha * info - 1e-12:
            out.add((e, w))
    return {(e, w): (e, w[:letters] + "*") in out for e, w in out if not w.endswith("*")}


def corpus():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    out = []
    for i in range(200):
        t = " ".join(word() for _ in range(30))
        if i % 10 == 0:
            t += f" write to Zorblax of abcdzzz town at z.blax@mail.example.com now {word()}"
        if i % 10 in (0, 5):
            t += " common phrase"
        out.append(t)
    return out


def test_disclosing_terms(spark):
    made = corpus()
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_spans(spark, docs).collect()}
    want = disclosed(made, 0.9, 3)
    assert ("email:z.blax@mail.example.com", "zorblax") in want
    for i, t in enumerate(made):
        found = {(t[x.s : x.e].lower(), x.kind == 5) for x in got[i] if x.kind >= 4}
        near = {(w, tells) for (e, w), tells in want.items() if re.search(rf"\b{w}\b", t.lower()) and e.split(":")[1] in t}
        assert found == near, t
        assert [(x.s, x.kind, x.e) for x in got[i] if x.kind < 4] == brute(t)
    kinds = {x.kind for s in got.values() for x in s}
    assert 4 in kinds or 5 in kinds


def test_sanitised_text(spark):
    docs = spark.createDataFrame([(1, "call +1 (555) 123-4567 or a.b@c.de!"), (2, None), (None, "plain")], "doc_id long, text string")
    got = {r.doc_id: r.sanitised for r in pii.sanitise(spark, docs).collect()}
    assert got == {1: "call [phone] or [email]!", 2: "", None: "plain"}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_spans(spark, docs).collect() == []


def test_digest_columns(spark, tmp_path):
    made = [("a@b.cd and 1.2.3.4"), "none"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op10(spark, str(tmp_path)).collect()}
    assert (got[0].n_email, got[0].n_ip, got[0].spans) == (1, 1, "email:0:6,ip:11:18")
    assert got[0].base_sha256 == hashlib.sha256(b"email:0:6,ip:11:18").hexdigest() and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()


def filler(n, seed):
    r = random.Random(seed)
    return [" ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(12)) for _ in range(n)]


def added(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_spans(spark, docs).collect()}
    return [{t[x.s : x.e].lower() for x in got[i] if x.kind >= 4} for i, t in enumerate(texts)]


def test_rare_entities_are_judged(spark):
    """Two texts name a person beside an address; two others an employer beside different addresses of one domain."""
    a = filler(2004, 5)
    a[10] += " Zorblax p@one.example"
    a[700] = "Zorblax " + a[700] + " p@one.example"
    a[900] += " Quuxcorp ann@two.example"
    a[1500] += " ben@two.example Quuxcorp"
    a[1800] += " Lonely q@three.example"  # one text is no evidence
    got = added(spark, a)
    assert got[10] == got[700] == {"zorblax"} and got[900] == got[1500] == {"quuxcorp"} and not got[1800]
    assert not any(x for i, x in enumerate(got) if i not in (10, 700, 900, 1500))


def test_near_copies_are_no_evidence(spark):
    a = filler(2000, 6)
    long = " ".join(filler(10, 7))
    a[3], a[4], a[5] = (f"{long} Zorblax p@one.example {w}" for w in ("uuuu", "vvvv", "uuuu"))
    assert not any(added(spark, a))


def test_disclosing_terms_go_everywhere(spark):
    """Far from the entity, twice in a text, and in texts without it; not inside of a base span."""
    a = filler(2000, 8)
    far = " ".join(filler(3, 9))  # more than 60 code points
    for i in range(0, 200, 10):
        a[i] = f"Zorblax {a[i]} {a[i + 1]} {a[i + 2]} z@mail.example {a[i + 3]}"
    a[40] += f" {far} (ZORBLAX)"
    a[1001] += " zorblax"
    a[1002] = "zorblax@other.example " + a[1002]
    got = added(spark, a)
    assert all(x == ({"zorblax"} if i in (*range(0, 200, 10), 1001) else set()) for i, x in enumerate(got))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(a)], "doc_id long, text string")
    out = {r.doc_id: r.sanitised for r in pii.sanitise(spark, docs).collect()}
    assert not any("zorblax" in t.lower() for t in out.values())


def test_terms_are_lowered_alike(spark):
    """Lower case may add a mark that ends a term: it is made after terms are found, in both places."""
    got = spark.createDataFrame([("İSTANBUL Straße",)], "t string").select(pii._terms(F.col("t")).alias("a"), F.transform(F.regexp_extract_all("t", F.lit(pii.FREE), F.lit(0)), F.lower).alias("b")).first()
    assert got.a == got.b == ["İSTANBUL".lower(), "straße"]
