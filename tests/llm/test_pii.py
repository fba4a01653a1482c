from __future__ import annotations

import hashlib
import random
import re
import time

from cases import ODD_TEXTS, empty_documents, odd_documents
from pyspark.sql import functions as F

from tessera.llm import pii, stages

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m.group() if c in "0123456789")
            if (kind == "ip" and any(int(p) > 255 for p in m.group().split("."))
                    or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check_base(rows, docs):
    texts = sorted(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect(), key=str)
    want = []
    for doc_id, text in texts:
        spans = brute(text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        want.append((doc_id, *[sum(k == kind for k, _, _ in spans) for kind, _ in PATTERNS], digest))
    got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def noisy(n, seed=7):
    rng = random.Random(seed)
    bits = ["a", "B.c", "@", "x@y", ".com", ".", "1", "255", "256", "10.0.0.1", "+", "+49 ", "(0)", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "-", " ", "é😀", "\n", "0000", "192.168.1", "%", "_", "378282246310005", "+1 (988) 555-2485"]
    return ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(n)]


def test_base_spans_on_noise(spark):
    docs = spark.createDataFrame(list(enumerate(noisy(3000))), "doc_id long, text string")
    check_base(pii.detect(docs, model=pii.SpanModel()).collect(), docs)


def test_odd_rows(spark):
    docs = odd_documents(spark, clash=["spans", "_text", "_base", "_spans", "kind", "_raw"])
    check_base(pii.detect(docs).collect(), docs)


def test_documents_with_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.detect(docs).collect()
    check_base(rows, docs)
    texts = dict(docs.select("doc_id", "text").collect())
    more = 0
    for r in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        base = brute(texts[r.doc_id] or "")
        assert set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        for kind, a, b in set(spans) - set(base):
            more += 1
            assert kind == "secret" and re.search("AKIA|token|password", texts[r.doc_id][a:b]), texts[r.doc_id][a:b]
    assert more


def test_long_runs_take_linear_time(spark):
    def runs(n):
        return ["a" * n, "1" * n, "a@" + "b." * n, "+" * n, "+1" + "-" * n, "1." * (n // 50)]

    short = spark.createDataFrame(list(enumerate(runs(1000))), "doc_id long, text string")
    check_base(pii.detect(short, model=pii.SpanModel()).collect(), short)
    long = spark.createDataFrame(list(enumerate(runs(200_000))), "doc_id long, text string")
    rows = sorted(pii.detect(long, model=pii.SpanModel()).collect())
    assert [tuple(r[1:5]) for r in rows] == [(0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 1000, 0, 0)]


def test_redaction(spark):
    docs = spark.createDataFrame([(0, "é a@b.co, 10.0.0.1 and +1 (988) 555-2485!"), (1, "none"), (2, ""), (3, None)],
                                 "doc_id long, text string")
    rows = pii.with_spans(docs.withColumnRenamed("text", "t"), F.col("t"), pii.SpanModel())
    out = dict(rows.select("doc_id", pii.redacted(F.col("_text"), F.col("_spans"))).collect())
    assert out == {0: "é [EMAIL], [IP] and [PHONE]!", 1: "none", 2: "", 3: ""}


def test_overlapping_spans_are_redacted_once(spark):
    spans = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(k).alias("kind"))
                      for a, b, k in [(2, 6, "card"), (4, 9, "phone"), (9, 10, "ip")]])
    assert spark.range(1).select(pii.redacted(F.lit("0123456789ab"), spans)).first()[0] == "01[CARD][IP]ab"


def test_empty(spark):
    assert pii.detect(empty_documents(spark)).count() == 0


def test_long_secrets_are_whole(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("ABCDEFabcdefghijkmnpqrstuvwxyz23456789-_") for _ in range(1000))
    texts = [f"the key is password={long} and more", f'"token": x token: "{long}", end', f"api_key = {long}", f"secret={long[:201]}"]
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(-1 - i, t) for i, t in enumerate(texts)]
    docs = given.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {r.doc_id: r.spans for r in pii.detect(docs).where("doc_id < 0").collect()}
    for i, t in rows:
        found = [tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s.startswith("secret:")]
        at = t.index(long[:201])
        assert any(a <= at and b >= at + len(long[:201] if i == -4 else long) for a, b in found), (i, spans[i])
    out = stages.redact(spark, docs, "").where("doc_id < 0").collect()
    assert len(out) == len(rows) and all("[SECRET]" in r.text and long[-50:] not in r.text for r in out)


def test_long_tokens_are_proposed(spark):
    key = hashlib.sha512(b"x").hexdigest()
    spans = spark.createDataFrame([(f"({key}) {key * 9}",)], "t string").select(pii.candidates(F.col("t"))).first()[0]
    assert {x.s for x in spans if x.kind == "secret"} == {key, key * 9}


def test_a_secret_needs_no_other_row(spark):
    """Strict secret formats are found whatever else the table holds, also where nothing can be learned."""
    secret = spark.createDataFrame([(1, "password = hunter2hunter2"), (2, "nothing here")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.detect(secret).collect()}
    assert got[1].startswith("secret:") and got[2] == ""
    redacted = {r.doc_id: r.text for r in stages.redact(spark, secret.selectExpr(
        "doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars"), "").collect()}
    assert "hunter2" not in redacted[1] and redacted[2] == "nothing here"


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    rows = [(1, f"card 4111 1111 1111 1111 and token AKIA{i:016d}"[:60]) for i in range(500)] + [(2, "plain words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(pii.detect(docs).collect()) == 501


def test_many_matches_in_one_text(spark):
    """Spans and redaction of a text with tens of thousands of matches, and every size around the blocks."""
    def made(n):
        parts, spans, at = [], [], 0
        for i in range(n):
            word = (f"a{i}@b.org", f"10.0.{i % 256}.7", f"password=x{i:09d}", f"+49 30 {i:07d}")[i % 4]
            kind = ("email", "ip", "secret", "phone")[i % 4]
            gap = " é𝄞 und " * (1 + i % 3)
            parts += [gap, word]
            spans.append((kind, at + len(gap), at + len(gap) + len(word)))
            at += len(gap) + len(word)
        return "".join(parts), spans

    sizes = [0, 1, 2, 255, 256, 257, 513, 1025, 32_000]
    texts = {n: made(n) for n in sizes}
    docs = spark.createDataFrame([(n, t) for n, (t, _) in texts.items()], "doc_id long, text string")
    rows = pii.with_spans(docs.withColumnRenamed("text", "t"), F.col("t"), pii.SpanModel())
    began = time.time()
    got = {r.doc_id: r for r in rows.select("doc_id", "_spans", pii.redacted(F.col("_text"), F.col("_spans")).alias("new")).collect()}
    assert time.time() - began < 60
    for n, (text, spans) in texts.items():
        assert sorted((s.kind, s.start, s.end) for s in got[n]._spans) == sorted(spans)
        out, last = [], 0
        for kind, start, end in spans:
            out += [text[last:start], f"[{kind.upper()}]"]
            last = end
        assert got[n].new == "".join(out) + text[last:]


def test_overlaps_by_binary_search(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        edges = sorted(rng.sample(range(60), 2 * rng.randint(0, 12)))
        spans = list(zip(edges[::2], edges[1::2]))
        start = rng.randint(0, 59)
        rows.append((spans, (start, start + rng.randint(1, 9))))
    df = spark.createDataFrame(rows, "spans array<struct<start:long,end:long>>, x struct<start:long,end:long>")
    got = [r[0] for r in df.select(pii._overlaps(F.col("x"), [F.col("spans")])).collect()]
    assert got == [any(a < x[1] and x[0] < b for a, b in spans) for spans, x in rows]


PLANTED = {"phone": ["(030) 1234 5678", "555-123-4567", "(212) 555 0147", "0171/2345678", "089 12345678"],
           "email": ["john (at) mail (dot) com", "ann.lee [at] post.example.org", "kim(at)uni-x.edu"],
           "card": ["4111.1111.1111.1111", "5500 - 0000 - 0000 - 0004"],
           "secret": ["kD93hQx0PzLw7TnB2vRs", "Zx81mNq0LpW3vTy6RbKs9QhJc2Fd4UgE"]}
DECOYS = ["on 2024-03-15 we", "from 1990-1995 in", "a total of 12.345.678 units", "pi is 3.14159265358979", "from 12.05.2021 on",
          "isbn 978-3-16-148410-0", "commit 9fceb02d0ae598e95dc970b74767f19372d61af8", "the getElementByIdFromCacheEntry call",
          "meet me (at) Berlin. Then", "row 12345678901 of", "a Donaudampfschifffahrtsgesellschaft", "page 10-12 of 1000 (2001)"]


def planted(spark, per_form):
    cues = ["call {} today", "it is {}, he said", "({}) and so on", "Contact: {}", "see {} for more"]
    rows = [(kind, form, cues[i % len(cues)].format(form)) for kind, forms in PLANTED.items() for form in forms for i in range(per_form)]
    rows += [("", d, d) for d in DECOYS for _ in range(per_form)]
    return rows


def check_planted(spark, rows, docs):
    spans = {r.doc_id: r.spans for r in pii.detect(docs).where("doc_id < 0").collect()}
    hit, wrong, n = {}, [], {}
    for i, (kind, form, text) in enumerate(rows):
        got = [(k, text[int(a):int(b)]) for k, a, b in (s.split(":") for s in spans[-1 - i].split(",") if s)]
        if kind:
            n[kind] = n.get(kind, 0) + 1
            found = any(k == kind and form in s for k, s in got)
            hit[kind] = hit.get(kind, 0) + found
            if not found:
                wrong.append(("missed", text, got))
        elif got:
            wrong.append(("extra", text, got))
    recall = {k: hit[k] / n[k] for k in n}
    extra = sum(w[0] == "extra" for w in wrong)
    assert min(recall.values()) >= 0.8, (recall, wrong[:20])
    assert extra <= 0.02 * sum(hit.values()), [w for w in wrong if w[0] == "extra"][:20]


def test_other_forms_are_found(spark):
    """Forms that no base pattern matches, and runs that only look like them: alone, and among documents."""
    rows = planted(spark, 5)
    own = spark.createDataFrame([(-1 - i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    check_planted(spark, rows, own)
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    check_planted(spark, rows, given.unionByName(own))


def test_every_document_teaches(spark, monkeypatch):
    """Examples of all rows, of more than twenty thousand documents and of repeated and null ids."""
    stored, store = [], pii.materialise

    def kept(df, name):
        stored.append(store(df, name))
        return stored[-1]

    monkeypatch.setattr(pii, "materialise", kept)
    n = 20_500
    docs = spark.range(n).selectExpr("case when id % 10 = 0 then null when id % 10 = 1 then 7 else id end as doc_id",
                                     "concat('a password=x', lpad(id, 9, '0'), ' b') as text")
    pii.fit(docs)
    strict = stored[0].where("kind = 'secret' and label = 1 and f_equals = 1")
    assert strict.agg(F.sum("weight")).first()[0] == n
