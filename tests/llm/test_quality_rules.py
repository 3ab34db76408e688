import re
from collections import Counter

import duckdb
from fixtures import SF, SF2, documents, odd_texts

from tariffloom.llm.quality_rules import OP6_SQL, op6_quality_rules, rule_verdicts, text_measures, without_frequent_lines


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(at)
    covered = {j for i, w in enumerate(at) if many[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    docs = documents(spark, odd_texts() + ["a b c d e f g h " * 3, "# * | <é>\n\n# * | <é>\n \n \n", "\x0ba\x0cb\r\nc"]).unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 doc_id", "text"), allowMissingColumns=True)
    texts = [(r.doc_id, brute(r.text)) for r in docs.collect()]
    got = [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in text_measures(docs).collect()]
    assert sorted(got, key=str) == sorted(texts, key=str)


def test_query_against_sql(spark):
    for sf in (SF, SF2):
        con = duckdb.connect()
        con.execute(f"create view documents as from '{sf}/documents.parquet'")
        assert sorted(map(tuple, op6_quality_rules(spark, sf).collect())) == sorted(con.execute(OP6_SQL).fetchall())


def test_frequent_lines(spark):
    own = [f"own {i} " + " ".join(f"w{i}x{k}" for k in range(25)) for i in range(30)]
    docs = documents(spark, [t + "\nAll rights  RESERVED 2024" for t in own] + ["All rights reserved 1999 " * 1 + "\n" + "short tail of few words here " * 1] + [own[0]] * 40)
    got = {r.doc_id: r for r in rule_verdicts(docs, least=8, share=0.05).collect()}
    assert all(got[i].n_frequent_words == 4 and got[i].kept for i in range(30) if i % 5)
    assert got[35].n_frequent_words == 0 and got[35].kept
    clean = {r.doc_id: r.text for r in without_frequent_lines(docs, least=8, share=0.05).collect()}
    assert clean[1] == own[1] and clean[35] == own[0]


def test_depleted_document_is_rejected(spark):
    line = " ".join(f"menu{k}" for k in range(22))
    docs = documents(spark, [line + f"\nx{i} y{i}" for i in range(60)])
    got = rule_verdicts(docs).collect()
    assert not any(r.base_failed for r in got) and {r.kept for r in got if r.n_frequent_words} == {False}


def test_empty_table(spark):
    assert rule_verdicts(documents(spark, [])).collect() == [] and without_frequent_lines(documents(spark, [])).collect() == []


def test_rows_with_one_id_or_none_are_judged_alone(spark):
    line, own = " ".join(f"menu{k}" for k in range(22)), " ".join(f"own{k}" for k in range(30))
    rows = [(i, f"{line}\nx{i} y{i}", "a") for i in range(60)] + [(5, own, "a"), (None, f"{line}\nz q", "a"), (None, own, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.n_words, r.n_frequent_words, r.kept) for r in rule_verdicts(docs).collect() if r.doc_id in (5, None)), key=str)
    assert got == sorted([(5, 24, 22, False), (5, 30, 0, True), (None, 24, 22, False), (None, 30, 0, True)], key=str)
    clean = sorted(((r.doc_id, r.text) for r in without_frequent_lines(docs).collect() if r.doc_id in (5, None)), key=str)
    assert clean == sorted([(5, "x5 y5"), (5, own), (None, "z q"), (None, own)], key=str)
