import hashlib
import re
import time

from fixtures import SF, documents, odd_texts

from tariffloom.llm.pii import find_pii, op1_pii, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, (text or "") if k != "email" or "@" in (text or "") else "") if passes(k, m.group())]


TRICKY = [
    "a@b.com_x@c.d and a@b a@b.c.d. é@x.yz 𝒳a+b@mail.example.com",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1..2.3.4 999.1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111 5 4111111111111111 9 41111111111111111111 12  34",
    "+1 (017) 555-7713 +12 345 67 + 1 +1234567890123456 ++49 30 123456-7 +1.",
    "IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00. call (415) 555-1234 or 415-555-1234x",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" but 04dbebab91ab85687d33eeaaf9ac699e1188f962',
    "x" * 3000 + "@" + "1" * 3000 + " " + "1 " * 5000 + "+" + "1-" * 5000,
    ".".join(["a"] * 1000) + "@" + ".".join(["b"] * 1000),
]


def test_base_spans_equal_plain_regular_expressions(spark):
    docs = documents(spark, TRICKY + odd_texts()).unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 doc_id", "text"), allowMissingColumns=True)
    for r in find_pii(docs).collect():
        assert [(s.kind, s.start, s.end) for s in r.pii if s.kind in PATTERNS] == brute(r.text)
        assert all((r.text or "")[s.start : s.end] == s.text for s in r.pii)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op1_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in PATTERNS]
        assert [x for x in r.spans.split(",") if x.split(":")[0] in PATTERNS] == [f"{k}:{a}:{b}" for k, a, b in spans]


def test_checks_and_context(spark):
    found = {r.doc_id: [(s.kind, s.text) for s in r.pii] for r in find_pii(documents(spark, TRICKY)).collect()}
    assert ("iban", "DE89 3704 0044 0532 0130 00") in found[4] and "iban" not in {k for k, t in found[4] if "DE88" in t}
    assert ("local_phone", "(415) 555-1234") in found[4] and len([k for k, _ in found[5] if k == "secret"]) == 1


def test_redaction(spark):
    docs = documents(spark, ["mail a@b.com now", None, "none", "+1 (017) 555-7713, 1.2.3.4", "card 4111 1111 1111 1111"])
    out = redact(docs)
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["mail <EMAIL> now", None, "none", "<PHONE>, <IP>", "card <CARD>"]
    assert out.columns == docs.columns
    assert redact(documents(spark, [])).collect() == []


def test_clashing_names(spark):
    names = ["spans", "__text", "t", "row", "m_email", "p_card", "at.b"]
    docs = spark.createDataFrame([(1, "mail a@b.com now", *names)], ["doc_id", "text", *names])
    assert find_pii(docs).columns == [*docs.columns, "pii"] and find_pii(docs).first()["pii"][0]["text"] == "a@b.com"
    assert tuple(redact(docs).first()) == (1, "mail <EMAIL> now", *names) and redact(docs).columns == docs.columns
    assert find_pii(find_pii(docs)).columns == [*docs.columns, "pii"]


def test_time_grows_in_proportion_to_the_text(spark):
    many = spark.createDataFrame([(1, " , ".join(str(k) for k in range(120_000)) + " a@b.com")], "doc_id long, text string")
    start = time.time()
    assert [s["kind"] for s in find_pii(many).first()["pii"]] == ["email"]
    assert time.time() - start < 30
