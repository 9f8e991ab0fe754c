import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import pii, registry

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) if int(c) < 5 else 2 * int(c) - 9) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


TEXTS = [
    None,
    "",
    "mail a.b@c.de, x@y and z@w.q_r@s.t; @b.c a@b.c@d.e",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 1.2.3 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 5500 0000 0000 0004 1 2",
    "call +1 (988) 555-2485 now, +1+22 333 44 55, +12 34",
    "😀é 😀 bob@mail.example.com 😀 +33 1 23 45 67 89 ünd 10.0.0.1" * 3,
    "password=7602ad27cf5550de1c token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"",
    "a" * 50000 + " " + "1.2." * 3000 + "x@y.z " * 700,
    "the plain text of a clean document, of the year 1999.",
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.detect(df).collect()}


def test_base_spans_equal_brute_force(found):
    for i, text in enumerate(TEXTS):
        assert [(s.kind, s.s, s.e) for s in found[i].base] == base(text or ""), i


def test_base_spans_stay_and_clean_text_has_none(found):
    for r in found.values():
        assert {(s.kind, s.s, s.e) for s in r.base} <= {(s.kind, s.s, s.e) for s in r.spans}
    assert found[9].spans == []


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in registry.op7_pii(spark, sf_dir).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in want) for x in pii.BASE)


def test_secrets_are_added_and_redacted(spark):
    rows = [(i, f"thst password={i:04d}ad27cf5550de1c and", "k") for i in range(40)] + [(99, "write to bob@mail.example.com.", "k"), (100, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[3].text == "thst password=<SECRET> and" and out[3].spans == "k"
    assert out[99].text == "write to <EMAIL>." and out[100].text is None


def brute_em(counts, rounds):
    """Label model of one kind with arrays over (row, labeler), rows repeated as often as they occur."""
    v = np.array([v for _, v, n in counts for _ in range(n)])
    q = 1 / (1 + np.exp(-v.sum(1)))
    for _ in range(rounds):
        prior = np.array([(1 - q).sum() + 1, q.sum() + 1])
        trust = np.empty((v.shape[1], 2, 3))
        for j in range(v.shape[1]):
            for y, w in ((0, 1 - q), (1, q)):
                each = np.array([w[v[:, j] == t].sum() + (2.0 if t == (1 if y else -1) else 1.0) for t in (-1, 0, 1)])
                trust[j, y] = each / each.sum()
        log = [np.log(prior[y] / prior.sum()) + sum(np.log(trust[j, y, v[:, j] + 1]) for j in range(v.shape[1])) for y in (0, 1)]
        q = 1 / (1 + np.exp(log[0] - log[1]))
    return trust, q


def test_em_equals_brute_force_and_is_by_kind():
    card = [("card", (1, 1, 1, 1), 60), ("card", (-1, -1, 0, -1), 60), ("card", (1, 1, -1, 1), 40), ("card", (-1, -1, -1, -1), 40)]
    phone = [("phone", (0, -1, 1, 1), 30), ("phone", (1, 1, 0, -1), 50), ("phone", (0, 0, 0, 1), 20)]
    trust, likely = pii.label_model(card + phone, pii.Params())
    for rows, own in ((card, likely[:4]), (phone, likely[4:])):
        want, q = brute_em(rows, 40)
        kind = rows[0][0]
        for j in range(4):
            for y in (0, 1):
                assert [trust[kind, j, y, t] for t in (-1, 0, 1)] == pytest.approx(list(want[j, y]), abs=1e-9)
        first = np.cumsum([0, *[n for *_, n in rows]])[:-1]
        assert own == pytest.approx(list(q[first]), abs=1e-9)
    assert trust["card", 0, 1, 1] > 0.8 > trust["card", 2, 1, 1]
    assert trust["card", 1, 1, 1] != trust["phone", 1, 1, 1]


def test_classifier_uses_features_besides_votes():
    counts = [("secret", (0, 1, 1, 1), (2, 2, 2), 500), ("secret", (0, 1, 1, 1), (0, 0, 3), 5), ("secret", (-1, -1, 0, -1), (0, 0, 3), 500)]
    model = pii.fit(counts, pii.Params())
    column = lambda v, f: [*(t + 1 for t in v), *f]
    secret = pii.KINDS.index("secret")
    assert model.score(secret, column((0, 1, 1, 1), (2, 2, 2))) > 0.9
    assert model.score(secret, column((0, 1, 1, 1), (0, 0, 3))) < model.score(secret, column((0, 1, 1, 1), (2, 2, 2)))
    assert model.score(secret, column((-1, -1, 0, -1), (0, 0, 3))) < 0.1
    assert model.score(pii.KINDS.index("card"), column((1, 1, 1, 1), (1, 3, 1))) < 0.01  # no row of that kind


CANDIDATES = [
    ("email", "bob (at) mail (dot) com", "write to "), ("email", "x [at] a.invalid", ""), ("ip", "10.0.0.1", "server "), ("ip", "999.1.1.1", ""), ("ip", "1:2:3:4:5:6:7:8", "host "),
    ("card", "4111 1111 1111 1111", "Visa "), ("card", "9111 1111 1111 1112", "order "), ("phone", "+49 30 1234567", "call "), ("phone", "911-555-1234", ""), ("phone", "415-555-1234", "+1 "),
    ("secret", "changeme123456", "password="), ("secret", "ghp_1234567890abcdef", "token: "), ("secret", "abcdefghijklmnop", "key="),
]


def test_votes_equal_brute_force(spark):
    def brute(kind, t, ctx):
        d = re.sub("[^0-9]", "", t)
        small = all(p.isdigit() and int(p) <= 255 for p in t.split("."))
        sign = lambda c: 1 if c else -1
        form = {
            "email": lambda: sign(re.search(r"^[A-Za-z0-9._%+-]+(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]+)+$", t)),
            "ip": lambda: sign(":" in t or small),
            "card": lambda: sign(len(d) >= 13 and luhn(d)),
            "phone": lambda: int(bool(t[0] == "+" or re.search(r"\+[0-9]{1,3} ?$", ctx)) and 8 <= len(d) <= 15),
            "secret": lambda: sign(re.search("[0-9]", t) and re.search("[A-Za-z]", t) and len(t) >= 16),
        }[kind]()
        top = (re.findall("[a-z0-9-]+$", t.lower()) or [""])[0]
        area = (re.findall(r"([0-9]{3})\)?[ .-][0-9]{3}[ .-][0-9]{4}$", t) or [""])[0]
        issuer = any(d.startswith(p) and len(d) == n for p, n in pii.CARD_PREFIXES)
        gazetteer = {
            "email": lambda: -1 if top in pii.RESERVED_DOMAINS else int(top in pii.TOP_DOMAINS),
            "ip": lambda: -1 if t.split(".")[0] in pii.SPECIAL_BLOCKS else int(":" in t or small),
            "card": lambda: sign(issuer),
            "phone": lambda: int(any(t[1:].startswith(c) for c in pii.CALLING_CODES)) if t[0] == "+" else -1 if area[0] in "01" or area in pii.SERVICE_CODES else 1,
            "secret": lambda: -1 if any(t.lower().startswith(w) for w in pii.PLACEHOLDERS) else int(any(t.startswith(w) for w in pii.TOKEN_PREFIXES) or bool(re.search("[0-9]", t))),
        }[kind]()
        against = re.search(pii.AGAINST, ctx)
        words = [r"\bip\b" if w == "ip" else w for w in pii.CONTEXT[kind].split()]
        context = -1 if against else int(bool(re.search("(?i)" + "|".join(words), ctx)))
        shape = sign(re.search(r"^[^@(\[]{2,}", t)) if kind == "email" else sign(len(set(d)) >= 4)
        return [form, gazetteer, context, shape]

    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CANDIDATES)], "i int, kind string, t string, ctx string")
    x = F.struct("kind", "t", "ctx")
    rows = {r.i: r for r in df.select("i", pii.votes(x).alias("v"), pii.features(x).alias("f")).collect()}
    for i, (kind, t, ctx) in enumerate(CANDIDATES):
        assert rows[i].v == brute(kind, t, ctx), (kind, t)
        assert all(0 <= f < n for f, n in zip(rows[i].f, pii.FEATURES.values(), strict=True))


def test_candidates_that_overlap_base_spans_go(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 3)
    rng = random.Random(4)
    span = "struct<kind:string,s:int,e:int,t:string,ctx:string>"
    rows = []
    for i in range(60):
        base = [("email", a, a + rng.randrange(1, 40), "b", "") for a in (rng.randrange(200) for _ in range(rng.randrange(8)))]
        wide = [("phone", a, a + rng.randrange(1, 12), f"w{n}", "") for n, a in enumerate(rng.randrange(200) for _ in range(rng.randrange(12)))]
        rows.append((i, base, wide))
    df = spark.createDataFrame(rows, f"i int, base array<{span}>, wide array<{span}>")
    got = {r.i: sorted(x.t for x in r.c) for r in df.select("i", pii._clear(F.col("base"), F.col("wide")).alias("c")).collect()}
    for i, base, wide in rows:
        assert got[i] == sorted(w[3] for w in wide if not any(w[1] < b[2] and b[1] < w[2] for b in base)), i


def test_work_grows_with_the_matches(spark):
    one = "10.0.0.1 and 999.2.3.4, bob@mail.example.com; 415-555-0123\n"
    took = []
    for n in (2_000, 25_000):  # 100,000 addresses and numbers
        df = spark.createDataFrame([(1, one * n)], "doc_id long, text string")
        pii.detect(df, model=pii.fit([], pii.Params())).collect()
        began = time.perf_counter()
        r = pii.detect(df, model=pii.fit([], pii.Params())).selectExpr("size(base) AS n", "element_at(base, -1) AS last").first()
        took.append(time.perf_counter() - began)
        assert r.n == 2 * n and r.last.kind == "ip" and r.last.s == len(one) * (n - 1)
    assert took[1] < 30 * took[0] + 5


def test_marks_in_the_text_and_odd_columns(spark):
    df = spark.sql("SELECT 1 AS doc_id, concat(char(1), 'a@b.c', char(1), char(2), ' +1 555 123 4567') AS text, 2 AS SPANS, 3 AS `x.y`, 4 AS _both")
    r = pii.detect(df)
    assert r.columns == ["doc_id", "text", "x.y", "_both", "base", "spans"]
    assert [(s.kind, s.s, s.e) for s in r.first().base] == [("email", 1, 6), ("phone", 9, 24)]
    assert pii.redact(df).first().text == "\x01<EMAIL>\x01\x02 <PHONE>"


def test_redaction_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 2)
    texts = ["😀 a@b.c, x@y.z é 10.0.0.1 +49 30 1234567 and 4111 1111 1111 1111 end", "a@b.c", "", "none", "a@1.2.3.4 10.1.1.1" * 3]
    out = {r.i: r.text for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    for i, t in enumerate(texts):
        at, want = 0, ""
        for kind, a, b in sorted(base(t), key=lambda x: (x[1], -x[2])):
            if a >= at:
                want += t[at:a] + f"<{kind.upper()}>"
            at = max(at, b)
        assert out[i] == want + t[at:]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, base int")
    assert pii.detect(df).count() == 0 and pii.redact(df).columns == df.columns
