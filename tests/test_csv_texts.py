"""Whole CSV texts against a plain walk over their characters."""

import random

from tariffloom import sources


def walk(text):
    """Records of fields, one character after the other."""
    records, record, field, quoted, i = [], [], "", False, 0
    text += "\n" if text.count('"') % 2 == 0 else '"\n'
    while i < len(text):
        c = text[i]
        if quoted and c == '"' and text[i + 1 : i + 2] == '"':
            field, i = field + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif quoted or c not in ",\r\n":
            field += c
        else:
            record, field = [*record, field.strip()], ""
            if c != ",":
                i += text[i : i + 2] == "\r\n"
                records, record = [*records, record] if any(record) else records, []
        i += 1
    return records


def test_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(['"', '"', ",", "\n", "\r\n", "\r", "a", "b ", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    rows = sources.csv_records(spark.createDataFrame(list(enumerate(texts)), "f int, t string"), "f", "t").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.f, r.line)):
        got.setdefault(r.f, []).append(r.fields)
    cut = lambda fields: fields[: max(i for i, x in enumerate(fields) if x) + 1]
    for f, t in enumerate(texts):
        assert [cut(r) for r in got.get(f, [])] == [cut(r) for r in walk(t)], t


def test_long_and_odd(spark):
    long = '3902,C1,t,"' + 'x ""y"", \n' * 50000 + '"\n' + "a,b," * 20000
    files = spark.createDataFrame([("long", long), ("none", None), ("empty", ""), ("heads", "hs,code\nHS,code\n"), ("late", "1,x\nhs,code\n")], "f string, t string")
    rows, bad = sources.requirement_rows(files, "f", "t")
    (only,) = rows.collect()
    assert (only.f, only.line, only.hs, only.title) == ("long", 1, "3902", "t") and only.requirement == ('x "y", \n' * 50000).strip()
    assert sorted((r.f, r.line, r.raw, r.reason) for r in bad.collect()) == [("heads", 2, "HS", "not an HS code"), ("late", 1, "1", "not an HS code"), ("late", 2, "hs", "not an HS code"), ("long", 2, "a", "not an HS code")]
    assert rows.where("f = 'x'").count() == 0
