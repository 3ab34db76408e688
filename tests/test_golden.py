"""Published figures and stated cases."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tariffloom.functions import codes as C
from tariffloom.functions import text as T
from tariffloom.operators import duty as D
from tariffloom.operators import joins as J
from tariffloom.operators.parsing import chunked
from tariffloom.sources import read_csv, read_json_or_empty


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def job(spark, lines, fx, charges, percent, amount, bcd, exempt, igst, aidc=None):
    items = spark.createDataFrame([(1, k + 1, Decimal(q), Decimal(p), Decimal(bcd), exempt and Decimal(exempt), Decimal("10"), Decimal(igst), None) for k, (q, p) in enumerate(lines)], "invoice long, sl_no int, quantity decimal(12,2), unit_price decimal(14,2), bcd_rate decimal(8,4), exempt_percent decimal(5,2), sws_rate decimal(8,4), igst_rate decimal(8,4), cess_rate decimal(8,4)")
    invoice = spark.createDataFrame([(1, Decimal(fx), Decimal(charges), percent and Decimal(percent), amount and Decimal(amount))], "invoice long, fx decimal(8,4), charges decimal(12,2), insurance_percent decimal(8,4), insurance_amount decimal(12,2)")
    return D.item_duty(D.valued(items.withColumn("aidc_rate", F.lit(aidc).cast("decimal(8,4)")).withColumn("health_cess_rate", F.lit(None).cast("decimal(8,4)")), invoice.withColumn("charges_home", (F.col("charges") * F.col("fx")).cast("decimal(20,8)")).withColumn("insurance_home", F.col("insurance_amount"))))


def test_first_golden_job(spark):
    duty = job(spark, [("10", "358.32"), ("16", "731.29")], "95.30", "590.75", None, "178.52", "7.5", None, "18")
    rows = [tuple(map(str, r)) for r in D.rounded_items(duty).orderBy("sl_no").select("assessable", "bcd", "sws", "igst", "total").collect()]
    assert rows == [("354719.64", "26603.97", "2660.40", "69117.12", "98381.49"), ("1158307.31", "86873.05", "8687.30", "225696.18", "321256.53")]
    total = D.by_invoice(duty).first()
    assert [str(total[c]) for c in ("assessable", "bcd", "sws", "igst", "igst_base", "payable")] == ["1513026.95", "113477.02", "11347.70", "294813.30", "1637852", "419638"]


def test_second_golden_job(spark):
    total = D.by_invoice(job(spark, [("25000", "1.2")], "95.30", "0", None, "0", "25", "100", "5")).first()
    assert [str(total[c]) for c in ("assessable", "bcd", "igst", "payable")] == ["2859000.00", "0.00", "142950.00", "142950"]


@pytest.mark.parametrize(("number", "valid"), [("CSQU3054383", True), ("MSKU6874101", True), ("TGHU7644424", True), ("HLXU8177720", True), ("CSQU 305438-3", True), ("MSKU6874100", False), ("TGHU7644428", False), ("CSQU3054338", False), ("CSQ3054383", False), ("CSQUU054383", False), ("1SQU3054383", False), ("", False)])
def test_container_check(spark, number, valid):
    assert one(spark, T.container_valid(F.lit(number))) == (valid,)


def test_names_and_identifiers(spark):
    assert one(spark, *[T.party_key(F.lit(x)) for x in ("M/S. ELITE POLYPLUS", "FUCHS LUBRICANTS (INDIA) PVT. LTD.", "Messrs Shree Cement Limited", "   ...   ")]) == ("ELITE POLYPLUS", "FUCHS LUBRICANTS INDIA", "SHREE CEMENT", "")
    assert one(spark, T.at_least(F.lit("mediu-1234 5678"), 6), T.at_least(F.lit("BL-12"), 6), T.airway_bill(F.lit("057-79606800")), T.airway_bill(F.lit("057-7960680")), T.at_least(F.lit("INV-1"), 5), T.at_least(F.lit("INV-2026-0044"), 5)) == ("MEDIU12345678", None, "05779606800", None, None, "INV20260044")
    for gstin in ("27AABCB0983D1ZY", "07AAFCF4316C1Z3", "05AABCO6103C1Z5"):
        assert one(spark, T.gstin_problems(F.lit(gstin), F.lit(None).cast("string"), F.lit(None).cast("string"))) == ([],)


def test_agricultural_cess_is_part_of_the_base(spark):
    total = D.by_invoice(job(spark, [("100", "10")], "80", "0", None, "0", "10", None, "18", "5")).first()
    assert [str(total[c]) for c in ("bcd", "aidc", "sws", "igst", "igst_base", "payable")] == ["8000.00", "4000.00", "800.00", "16704.00", "92800", "29504"]


def test_words_of_negative_amounts_raise(spark):
    assert one(spark, T.rupees_in_words(F.lit(419638))) == ("Rs. Four Lakh Nineteen Thousand Six Hundred Thirty Eight Only",)
    with pytest.raises(Exception, match="words"):
        one(spark, T.indian_words(F.lit(-5)))


def test_words(spark):
    cases = {0: "Zero", 7: "Seven", 19: "Nineteen", 42: "Forty Two", 100: "One Hundred", 950: "Nine Hundred Fifty", 1000: "One Thousand", 142950: "One Lakh Forty Two Thousand Nine Hundred Fifty", 419638: "Four Lakh Nineteen Thousand Six Hundred Thirty Eight", 10**7: "One Crore", 123456789: "Twelve Crore Thirty Four Lakh Fifty Six Thousand Seven Hundred Eighty Nine", 10**9: "One Hundred Crore"}
    rows = spark.createDataFrame([(n,) for n in cases], "n long").select("n", T.indian_words(F.col("n")).alias("w")).collect()
    assert {r.n: r.w for r in rows} == cases


def test_sizes_and_descriptions(spark):
    assert one(spark, *C.container_size_type(F.lit("40SD96")), *C.container_size_type(F.lit("40 High Cube"))) == ("40", "HC", "40", "HC")
    assert one(spark, *[T.trade_description(F.lit(x)) for x in ("Random Polypropylene RP2248N", "FLUOROCARBON GEL 880FG UV8LB", "MEK 2000", "RP2248N")]) == ("Random Polypropylene", "FLUOROCARBON GEL", "MEK 2000", "RP2248N")


def test_prefix_join_against_brute_force(spark):
    codes = [f"{(k * 7919) % 10**8:08d}" for k in range(60)]
    entries = [(p, [codes[p][: 2 + 2 * (p % 4)], codes[(p * 3) % 60][:4]], [codes[p][:8]] if p % 5 == 0 else [], p % 17 == 3) for p in range(40)]
    frame = spark.createDataFrame(entries, "pos int, include array<string>, exclude array<string>, any_chapter boolean")
    got = {tuple(r) for r in J.prefix_join(spark.createDataFrame([(c,) for c in codes], "hs string"), "hs", frame).select("hs", "pos", "len").collect()}
    want = set()
    for c in codes:
        for pos, include, exclude, everywhere in entries:
            hits = [len(p) for p in include if c.startswith(p)] + [0] * everywhere
            if hits and not any(c.startswith(p) for p in exclude):
                want.add((c, pos, max(hits)))
    assert got == want


def test_asof_falls_back_to_the_first_table(spark):
    facts = spark.createDataFrame([("2026-08-05", "a"), ("2026-07-01", "a"), ("2020-01-01", "a"), (None, "a"), ("2026-07-01", "z")], "day string, k string").withColumn("day", F.col("day").cast("date"))
    history = spark.createDataFrame([("a", "2026-06-01", 95.3), ("a", "2026-08-01", 96.1)], "k string, since string, fx double").withColumn("since", F.col("since").cast("date"))
    assert [r.fx for r in J.asof(facts, "day", history, "since", ["k"], ["fx"]).orderBy(F.desc_nulls_last("day"), "k").collect()][:3] == [96.1, 95.3, None]


def test_chunks_cover_texts(spark):
    text = " ".join(f"word{k}" for k in range(3000))
    rows = chunked(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id long, t string"), "id", "t").orderBy("chunk").collect()
    assert rows[0].text == text[:3500] and text.endswith(rows[-1].text) and all(a.text[-200:] == b.text[:200] for a, b in zip(rows, rows[1:], strict=False))


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('hs,title\n3902,"two\nlines, ""quoted"""\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"), "hs string, title string").collect()] == [("3902", 'two\nlines, "quoted"')]
    assert read_json_or_empty(spark, str(tmp_path / "none.json"), "a int").collect() == []
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": 2}]')
    assert sorted(r.a for r in read_json_or_empty(spark, str(tmp_path / "b.json"), "a int").collect()) == [1, 2]
