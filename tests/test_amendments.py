"""Amending notifications as their text has them."""

from datetime import date

from tariffloom.operators import amendments as A

ENTRIES = [("160", "I", "Newsprint Provided that nothing shall apply after the 31st March, 2026", "Nil Nil 2.5%"), ("140", "I", "Pulp after the 31st March, 2026", "5%"), ("9A", "I", "Goods", "10%"), ("160", "II", "Other", "1%")]
SCHEMA = 'serial string, `table` string, description string, rate_text string'


def run(spark, *texts):
    entries = spark.createDataFrame(ENTRIES, SCHEMA)
    notices = spark.createDataFrame([(f"{k:02}/2026", date(2026, k % 12 + 1, 1), t) for k, t in enumerate(texts, 1)], "notification string, day date, text string")
    out, bad = A.amend(entries, notices)
    return {(r.serial, r.table): r for r in out.collect()}, sorted((r.notification, r.position, r.k, r.reason) for r in bad.collect())


FIRST = """G.S.R. 77(E).- In the said notification, in TABLE I,- (1) against S. No. 140,- (a) in column (3), in the proviso, for the figures, letters and word “31st March,
2026”, the figures, letters and word “31st March, 2028”; (b) in column (6), for the figure “3”, the figure “4”;
(2)  against S. No. 160, in column (4), for the entry “Nil”, at both the places, the entry “5%” shall be substituted; (3) S. No. 9A and the entries relating thereto shall be omitted;"""


def test_three_instructions(spark):
    out, bad = run(spark, FIRST)
    assert bad == []
    assert out["140", "I"].description == "Pulp after the 31st March, 2028" and out["140", "I"].amended_by == ["01/2026 (sunset)"] and out["140", "I"].stale_by == ["01/2026 (condition)"]
    assert out["160", "I"].rate_text == "5% 5% 2.5%" and out["9A", "I"].omitted_by == "01/2026"
    assert out["160", "II"].rate_text == "1%" and out["160", "II"].amended_by == []


def test_in_order_of_issue_and_only_where_the_words_stand(spark):
    rate = lambda old, new: f"(1) against S. No. 140, in column (4), for the entry “{old}”, the entry “{new}”"
    out, bad = run(spark, rate("5%", "7.5%"), rate("5%", "6%"), rate("9%", "1%"), rate("6%", "1%"))
    # the second still finds 5% inside 7.5%, as the text holds it
    assert out["140", "I"].rate_text == "7.1%" and [b[0] for b in bad] == ["03/2026"] and bad[0][3] == "old_absent"


def test_misnumbered_unknown_and_corrigenda(spark):
    texts = ["(1) S. No. 140 and the entries relating thereto shall be omitted (3) S. No. 160 and the entries relating thereto shall be omitted", "G.S.R. 5, at page 160, in lines 3 and 4, for “x” read “y”", "(1) in the said table, something new", "(1) S. No. 999 and the entries relating thereto shall be omitted", None, "in the LISTS appended to TABLE I, in List 140, after item 3"]
    out, bad = run(spark, *texts)
    assert bad == [("01/2026", None, None, "misnumbered"), ("03/2026", 1, 0, "no_form"), ("04/2026", 1, 0, "unknown_serial")]
    assert all(r.omitted_by is None and r.stale_by == [] for r in out.values())


def test_named_parts(spark):
    notices = spark.createDataFrame([("n", date(2026, 1, 1), "in the LISTS appended to TABLE I, in List 33, after"), ("p", date(2026, 1, 1), "at page 12, in lines 3 and 4, read")], "notification string, day date, text string")
    got = {r.notification: r for r in A.read(notices)[0].collect()}
    assert (got["n"].serial, got["n"]["table"], got["n"]["list"]) == (None, "I", "33") and (got["p"].serial, got["p"].page, got["p"].lines) == (None, "12", "3 and 4")


def test_empty(spark):
    out, bad = run(spark)
    assert len(out) == 4 and bad == []
