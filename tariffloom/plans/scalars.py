"""Scalar functions over values made from the fixture's keys and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as T
from .fixture import AS_OF, HS_SQL, hs, table
from .words_sql import words_sql


def _pick(values: list[str], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], key: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[({key} % {len(values)} + 1)::INT]"


OWNERS = ["CSQU", "MSKU", "TGHU", "HLXU", "1SQU"]


def container_check(spark, sf_dir: str) -> DataFrame:
    """Container numbers from order keys, each with all ten check digits; one is valid."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("d"))
    number = F.concat(_pick(OWNERS, "o_orderkey"), F.lit(" "), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit("-"), F.col("d").cast("string"))
    return o.select(number.alias("number")).select("number", T.container_valid(F.col("number")).alias("valid")).groupBy("valid").agg(F.count("*").alias("n"), F.min("number").alias("least"))


RAW_IDS = ["mediu-1234 5678", "BL-12", "057-79606800", "057-7960680", "INV-1", "INV-2026-0044", "CSQU3054383", "  thread one ", ""]
KINDS = ["bl", "awb", "invoice", "po", "container", "conversation"]


def identifiers(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", _pick(KINDS, "p_partkey").alias("kind"), F.concat(_pick(RAW_IDS, "p_partkey"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey").cast("string")).otherwise("")).alias("raw"))
    return p.select("p_partkey", "kind", T.identifier(F.col("kind"), F.col("raw")).alias("value"))


NAMES = ["M/S. {} POLYPLUS", "{} Lubricants (India) Pvt. Ltd.", "Messrs {} Cement Limited", "   ...   ", "{} & Sons Co.", "{} GmbH", "The {} Trading FZE"]


def party_keys(spark, sf_dir: str) -> DataFrame:
    """The three name keys side by side."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.replace(_pick(NAMES, "c_custkey"), F.lit("{}"), F.col("c_name")).alias("name"))
    return c.select("c_custkey", T.party_key(F.col("name")).alias("party"), T.importer_key(F.col("name")).alias("importer"), T.match_key(F.col("name")).alias("master"))


CELLS = ["", " NULL ", "n/a", "'quoted'", "two   words", "0", "--", "Nil", "x"]


def cells(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", _pick(CELLS, "c_custkey").alias("raw"))
    return c.select("c_custkey", T.cell_value(F.col("raw")).alias("cell"), T.party_cell(F.col("raw")).alias("party"), T.placeholder_branch(F.col("raw")).alias("no_branch"))


DESCRIPTIONS = ["Random Polypropylene RP2248N", "FLUOROCARBON GEL 880FG UV8LB", "MEK 2000", "RP2248N", "Steel  coil 12345 (A1)", "Plain words only here"]


def trade_descriptions(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", _pick(DESCRIPTIONS, "p_partkey").alias("raw"))
    return p.select("p_partkey", T.trade_description(F.col("raw")).alias("description"))


def gstin_check(spark, sf_dir: str) -> DataFrame:
    """GSTINs from customer keys with a right or a wrong check character."""
    base = F.concat(F.lpad((F.col("c_custkey") % 37 + 1).cast("string"), 2, "0"), F.lit("AABCB"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("D1Z"))
    c = table(spark, sf_dir, "customer").select("c_custkey", base.alias("base"))
    gstin = F.concat("base", F.when(F.col("c_custkey") % 3 == 0, F.lit("7")).otherwise(T.gstin_check(F.col("base"))))
    pan = F.when(F.col("c_custkey") % 5 == 0, F.lit("AABCB0000D")).otherwise(F.substring("base", 3, 10))
    problems = T.gstin_problems(gstin, pan, F.substring("base", 1, 2))
    return c.select("c_custkey", gstin.alias("gstin"), F.concat_ws(",", problems).alias("problems"))


COUNTRIES = {"TR": "Turkey", "CW": "Curacao", "KR": "Republic of Korea", "TH": "Thailand", "BR": "Brazil", "CN": "People s Republic of China", "AE": "United Arab Emirates", "SD": "Sudan"}
ALPHA3 = {"TUR": "TR", "THA": "TH", "BRA": "BR", "CHN": "CN", "ARE": "AE"}
STATED = ["Türkiye", "Turkey", "Curaçao", "Republic of China", "Republic of Korea", "The People's Republic of China", "XX", "br", "ARE", "Kingdom of Thailand", "Federative Republic of Brazil", "Republic of the Sudan", "Nowhere", ""]


def country_codes(spark, sf_dir: str) -> DataFrame:
    """Two-letter codes: as stated, by three letters, by name or alias, without article, without the form of state."""
    s = table(spark, sf_dir, "customer").select("c_custkey", _pick(STATED, "c_custkey").alias("raw"))
    names = {name.upper(): code for code, name in COUNTRIES.items()} | {"TURKIYE": "TR", "CURACAO": "CW"}
    raw = F.trim("raw")
    key = T.plain_key(raw)
    bare = F.regexp_replace(key, "^THE ", "")
    code = F.coalesce(
        F.when(raw.rlike("^[A-Za-z]{2}$"), F.when(F.upper(raw).isin(*COUNTRIES), F.upper(raw)).otherwise("")),
        F.when(raw.rlike("^[A-Za-z]{3}$"), C.looked_up(ALPHA3, F.upper(raw))),
        C.looked_up(names, key),
        C.looked_up(names, bare),
        C.looked_up(names, C.state_stem(bare)),
    )
    return s.select("c_custkey", "raw", F.nullif(code, F.lit("")).alias("iso2"))


BOXES = ["40SD96", "40 High Cube", "45G1", "22G1", "20' REEFER", "40 open top", "L5R1", "flat rack 20", "HQ 40", "tank", "?"]


def container_sizes(spark, sf_dir: str) -> DataFrame:
    size, kind = C.container_size_type(F.col("raw"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", _pick(BOXES, "s_suppkey").alias("raw")).select("s_suppkey", "raw", size.alias("size"), kind.alias("type"))
    return s.withColumn("iso", C.iso_container_code(F.col("size"), F.col("type")))


UNITS = ["pails", "KG", "MTS", "ton", "each", "m2", "bags", "Gms", "dozens", "Litre"]
PACKS = ["6,258 BAG(S)", "Jumbo bags", "CTNS", "pallet 2", "wrap", ""]
METHODS = ["Transaction value", "RULE 4", "rule  7 fallback", "IDENTICAL", "RULE 9 (RESIDUAL METHOD)", "unknown"]


def unit_codes(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", _pick(UNITS, "p_partkey").alias("u"), _pick(PACKS, "p_partkey").alias("k"), _pick(METHODS, "p_partkey").alias("m"))
    return p.select("p_partkey", C.uqc(F.col("u")).alias("uqc"), C.package_unit(F.regexp_replace("k", "^[0-9, ]+", "")).alias("package"), C.valuation_method(F.col("m")).alias("method"))


def hs_functions(spark, sf_dir: str) -> DataFrame:
    raw = F.substring(hs("p_partkey"), F.lit(1), (F.col("p_partkey") % 9).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return p.select("p_partkey", T.pad8(F.col("raw")).alias("pad8"), T.hs_code(F.col("raw")).alias("code"), F.when(F.length("raw") >= 2, F.array_join(T.hs_prefixes(F.col("raw")), ">")).alias("prefixes"))


VESSELS = ["WADI DUKA/02621/N", "MAERSK KOWLOON", "EVER GIVEN 023W", "ONE  STORK V.17E", "SOLO", " / "]


def voyages(spark, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", _pick(VESSELS, "s_suppkey").alias("raw"))
    return s.select("s_suppkey", "raw", T.voyage(F.col("raw")).alias("voyage"))


FILES = ["Invoice #12 (final).pdf", "..", "été & hiver.PDF", "a/b\\c", "-x-"]


def names_and_columns(spark, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select("o_orderkey", _pick(FILES, "o_orderkey").alias("raw"))
    return s.select("o_orderkey", T.safe_name(F.col("raw")).alias("file"), T.slug(F.col("raw")).alias("slug"), T.escape_xml(F.col("raw")).alias("xml"), T.column_letter(F.col("o_orderkey") % 18278 + 1).alias("letter"))


def day_functions(spark, sf_dir: str) -> DataFrame:
    """Day arithmetic against a stated day."""
    day, as_of = F.to_date("o_orderdate"), F.lit(AS_OF).cast("date")
    left = D.days_left(day, as_of)
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", left.cast("int").alias("days_left"), D.level(left, 3).alias("level"), D.day_text(F.when(F.col("o_orderkey") % 10 > 0, day)).alias("shown"),
        D.export_day(F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderdate").cast("string")).otherwise("not a day")).alias("exported"), D.shelf_life_left(F.add_months(day, -12), F.add_months(day, 24), as_of).alias("shelf_life"),
        D.last_free_day(F.when(F.col("o_orderkey") % 2 == 0, F.lit(5)), F.when(F.col("o_orderkey") % 3 == 0, day), F.lit(14), F.lit(None).cast("date"), F.date_add(day, 2)).alias("last_free_day"),
    )


SUNSETS = ["shall have effect after the 31st March, 2028", "shall have effect after the 1st of May 2028", "Shall have effect after the 30th SEPTEMBER 2026.", "no end"]


def sunsets(spark, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", _pick(SUNSETS, "s_suppkey").alias("raw"))
    return s.select("s_suppkey", D.sunset(F.col("raw")).alias("until"))


RATES = ["Nil", "5%", "-", "15% 35%", "7.5% 7.5%", "12", "", "abc%"]


def number_functions(spark, sf_dir: str) -> DataFrame:
    """Rates of cells, rounding, tolerance, tons, grouping and backoff."""
    p = table(spark, sf_dir, "part").withColumn("price", F.col("p_retailprice").cast("decimal(12,2)")).withColumn("unit", _pick(UNITS, "p_partkey")).withColumn("cell", _pick(RATES, "p_partkey"))
    quantity, price = N.to_kilograms(F.col("p_size").cast("decimal(12,3)"), F.col("price").cast("decimal(16,5)"), F.col("unit"))
    return p.select(
        "p_partkey", N.rate_of_cell(F.col("cell")).cast("decimal(8,3)").alias("rate"), N.half_up_to_plus_infinity(F.col("price") - 1500).alias("whole"), N.nearly_equal(F.col("price"), F.col("price") + F.col("p_size")).alias("near"),
        N.line_off(F.col("p_size").cast("decimal(12,2)"), F.col("price"), (F.col("price") * F.col("p_size") + F.col("p_size") * 3).cast("decimal(18,2)")).alias("off"), quantity.cast("decimal(18,3)").alias("quantity"), price.cast("decimal(18,8)").alias("kilo_price"),
        N.rupees((F.col("price") * F.col("p_partkey") * 1000 - 5000).cast("decimal(20,2)")).alias("rupees"), N.backoff(F.lit(60).cast("long"), (F.col("p_partkey") % 12).cast("int")).alias("wait"),
    )


def words_of_amounts(spark, sf_dir: str) -> DataFrame:
    """Amounts in words, some of them above ten crore."""
    amount = F.floor("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, 1000).otherwise(1) - F.when(F.col("o_orderkey") % 100 == 0, F.floor("o_totalprice")).otherwise(0)
    return table(spark, sf_dir, "orders").select("o_orderkey", amount.cast("long").alias("amount")).select("o_orderkey", "amount", T.indian_words(F.col("amount")).alias("words"))


_ALNUM = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"
_DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')"
_SQ = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_PARTY = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(upper({0}), '^\s*(?:M/S|MESSRS)\b[.\s]*', ''), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g'), '\b(?:PRIVATE|LIMITED|CORPORATION|COMPANY|INCORPORATED|PVT|LTD|LLP|LLC|INC|CORP|CO|GMBH|SPA|SRL|PTE|SDN|BHD|FZE|FZCO|FZC|DMCC|BV|NV|SA|AG|KG|OY|AB|AS)\b', ' ', 'g'), '\s+', ' ', 'g'))"
_IMPORTER = r"trim(regexp_replace(regexp_replace(regexp_replace(upper({0}), '[^A-Z0-9 ]', ' ', 'g'), '\b(?:MS|PVT|PRIVATE|LTD|LIMITED|LLP|CO|COMPANY|INC)\b', '', 'g'), '\s+', ' ', 'g'))"
_MASTER = r"regexp_replace(regexp_replace(upper({0}), '\b(?:PVT|PRIVATE|LTD|LIMITED|LLP|INC|CO|COMPANY|FZE|FZCO|GMBH)\b', '', 'g'), '[^A-Z0-9]', '', 'g')"
_CONTAINER = "regexp_matches({0}, '^[A-Z]{{4}}[0-9]{{7}}$') AND list_sum(list_transform(range(10), lambda i: ([0,1,2,3,4,5,6,7,8,9,10,12,13,14,15,16,17,18,19,20,21,23,24,25,26,27,28,29,30,31,32,34,35,36,37,38])[instr('" + T.BASE36 + "', substring({0}, i + 1, 1))] * (1 << i))) % 11 % 10 = try_cast(substring({0}, 11, 1) AS INT)"
_NULLISH = "('', 'NULL', '.', '..', '-', '--', 'NA', 'N/A', 'NIL')"
_SQ0 = _SQ.replace('{}', '{0}')
_CELL = f"CASE WHEN upper({_SQ0}) NOT IN {_NULLISH} THEN {_SQ0} END"
_CHECK36 = f"substring('{T.BASE36}', ((36 - list_sum(list_transform(range(1, 15), lambda i: (instr('{T.BASE36}', substring(base, i, 1)) - 1) * (2 - i % 2) // 36 + (instr('{T.BASE36}', substring(base, i, 1)) - 1) * (2 - i % 2) % 36)) % 36) % 36 + 1)::INT, 1)"
_AMOUNT = "floor(o_totalprice)::BIGINT * CASE WHEN o_orderkey % 3 = 0 THEN 1000 ELSE 1 END - CASE WHEN o_orderkey % 100 = 0 THEN floor(o_totalprice)::BIGINT ELSE 0 END"
QUERIES = {f.__name__: f for f in (container_check, identifiers, party_keys, cells, trade_descriptions, gstin_check, country_codes, container_sizes, unit_codes, hs_functions, voyages, names_and_columns, day_functions, sunsets, number_functions, words_of_amounts)}
SQL = {
    "words_of_amounts": f"WITH o AS (SELECT o_orderkey, {_AMOUNT} AS amount FROM orders) SELECT o_orderkey, amount, {words_sql('amount')} AS words FROM o",
    "container_check": f"""WITH n AS (SELECT {_pick_sql(OWNERS, 'o_orderkey')} || ' ' || lpad(o_orderkey::VARCHAR, 6, '0') || '-' || d AS number FROM orders, range(10) t(d)), v AS (SELECT number, coalesce({_CONTAINER.format(_ALNUM.format('number'))}, false) AS valid FROM n)
SELECT valid, count(*) AS n, min(number) AS least FROM v GROUP BY valid""",
    "identifiers": f"""WITH p AS (SELECT p_partkey, {_pick_sql(KINDS, 'p_partkey')} AS kind, {_pick_sql(RAW_IDS, 'p_partkey')} || CASE WHEN p_partkey % 4 = 0 THEN p_partkey::VARCHAR ELSE '' END AS raw FROM part)
SELECT p_partkey, kind, CASE kind WHEN 'container' THEN CASE WHEN {_CONTAINER.format(_ALNUM.format('raw'))} THEN {_ALNUM.format('raw')} END WHEN 'bl' THEN CASE WHEN length({_ALNUM.format('raw')}) >= 6 THEN {_ALNUM.format('raw')} END
 WHEN 'awb' THEN CASE WHEN length({_DIGITS.format('raw')}) = 11 THEN {_DIGITS.format('raw')} END WHEN 'conversation' THEN nullif(trim(raw), '') ELSE CASE WHEN length({_ALNUM.format('raw')}) >= 5 THEN {_ALNUM.format('raw')} END END AS value FROM p""",
    "party_keys": f"WITH c AS (SELECT c_custkey, replace({_pick_sql(NAMES, 'c_custkey')}, '{{}}', c_name) AS name FROM customer) SELECT c_custkey, {_PARTY.format('name')} AS party, {_IMPORTER.format('name')} AS importer, {_MASTER.format('name')} AS master FROM c",
    "cells": f"""WITH c AS (SELECT c_custkey, {_pick_sql(CELLS, 'c_custkey')} AS raw FROM customer), d AS (SELECT c_custkey, {_CELL.format('raw')} AS cell FROM c), e AS (SELECT *, regexp_replace(cell, '^[''"]+|[''"]+$', '', 'g') AS bare FROM d)
SELECT c_custkey, cell, {_CELL.format('bare')} AS party, cell IS NULL OR cell = '0' AS no_branch FROM e""",
    "trade_descriptions": rf"""WITH w AS (SELECT p_partkey, string_split({_SQ.format(_pick_sql(DESCRIPTIONS, 'p_partkey'))}, ' ') AS w FROM part),
k AS (SELECT p_partkey, w, coalesce(list_max(list_filter(range(1, len(w) + 1), lambda i: NOT (regexp_matches(regexp_replace(w[i], '[()\[\],.]', '', 'g'), '^[0-9]{{4,}}$') OR (regexp_matches(w[i], '[A-Za-z]') AND regexp_matches(w[i], '[0-9]'))))), 0) AS plain FROM w)
SELECT p_partkey, array_to_string(w[1:greatest(plain, least(len(w), 2))], ' ') AS description FROM k""",
    "gstin_check": f"""WITH c AS (SELECT c_custkey, lpad((c_custkey % 37 + 1)::VARCHAR, 2, '0') || 'AABCB' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || 'D1Z' AS base FROM customer), g AS (SELECT *, {_CHECK36} AS chk FROM c), f AS (SELECT *, base || CASE WHEN c_custkey % 3 = 0 THEN '7' ELSE chk END AS gstin FROM g)
SELECT c_custkey, gstin, array_to_string(list_filter([CASE WHEN gstin[-1] <> chk THEN 'check' END, CASE WHEN c_custkey % 5 = 0 AND base[3:12] <> 'AABCB0000D' THEN 'pan' END], lambda x: x IS NOT NULL), ',') AS problems FROM f""",
    "country_codes": f"""WITH s AS (SELECT c_custkey, {_pick_sql(STATED, 'c_custkey')} AS raw FROM customer)
SELECT c_custkey, raw, CASE raw WHEN 'Türkiye' THEN 'TR' WHEN 'Turkey' THEN 'TR' WHEN 'Curaçao' THEN 'CW' WHEN 'Republic of Korea' THEN 'KR' WHEN 'The People''s Republic of China' THEN 'CN' WHEN 'br' THEN 'BR' WHEN 'ARE' THEN 'AE' WHEN 'Kingdom of Thailand' THEN 'TH' WHEN 'Federative Republic of Brazil' THEN 'BR' WHEN 'Republic of the Sudan' THEN 'SD' END AS iso2 FROM s""",
    "container_sizes": f"""WITH s AS (SELECT s_suppkey, {_pick_sql(BOXES, 's_suppkey')} AS raw FROM supplier)
SELECT s_suppkey, s.raw, size, type, iso FROM s LEFT JOIN (VALUES ('40SD96', '40', 'HC', '45G1'), ('40 High Cube', '40', 'HC', '45G1'), ('45G1', '40', 'HC', '45G1'), ('22G1', '20', 'GP', '22G1'), ('20'' REEFER', '20', 'RF', '22R1'), ('40 open top', '40', 'OT', '42U1'), ('L5R1', '45', 'RF', 'L5R1'), ('flat rack 20', '20', 'FR', '22P1'), ('HQ 40', '40', 'HC', '45G1'), ('tank', NULL, 'TK', NULL), ('?', NULL, NULL, NULL)) v(raw, size, type, iso) USING (raw)""",
    "unit_codes": f"""SELECT p_partkey, (['NOS', 'KGS', 'MTS', 'TON', 'NOS', 'SQM', 'BGS', 'GMS', 'NOS', 'LTR'])[(p_partkey % 10 + 1)::INT] AS uqc, (['BAG', 'JBG', 'CTN', 'PLT', NULL, NULL])[(p_partkey % 6 + 1)::INT] AS package,
 (['RULE 4 (TRANSACTION VALUE)', 'RULE 4 (TRANSACTION VALUE)', 'RULE 7 (DEDUCTIVE VALUE)', 'RULE 5 (TRANSACTION VALUE OF IDENTICAL GOODS)', 'RULE 9 (RESIDUAL METHOD)', NULL])[(p_partkey % 6 + 1)::INT] AS method FROM part""",
    "hs_functions": f"""WITH p AS (SELECT p_partkey, left({HS_SQL.format('p_partkey')}, (p_partkey % 9)::INT) AS raw FROM part)
SELECT p_partkey, CASE WHEN length(raw) BETWEEN 1 AND 8 THEN rpad(raw, 8, '0') END AS pad8, CASE WHEN length(raw) >= 4 THEN raw END AS code, CASE WHEN length(raw) >= 2 THEN array_to_string(list_transform(range(length(raw), 1, -1), lambda n: left(raw, n)), '>') END AS prefixes FROM p""",
    "voyages": f"SELECT s_suppkey, {_pick_sql(VESSELS, 's_suppkey')} AS raw, (['02621/N', NULL, '023W', '17E', NULL, NULL])[(s_suppkey % 6 + 1)::INT] AS voyage FROM supplier",
    "names_and_columns": f"""WITH o AS (SELECT o_orderkey, {_pick_sql(FILES, 'o_orderkey')} AS raw, o_orderkey % 18278 + 1 AS n FROM orders)
SELECT o_orderkey, left(coalesce(nullif(regexp_replace(regexp_replace(raw, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'document'), 120) AS file,
 regexp_replace(regexp_replace(lower(strip_accents(raw)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, replace(replace(replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml,
 CASE WHEN n > 702 THEN chr((65 + (n - 703) // 676)::INT) ELSE '' END || CASE WHEN n > 26 THEN chr((65 + ((n - 1) // 26 - 1) % 26)::INT) ELSE '' END || chr((65 + (n - 1) % 26)::INT) AS letter FROM o""",
    "day_functions": f"""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders), d AS (SELECT *, (day - '{AS_OF}'::DATE)::INT AS n, (day - INTERVAL 12 MONTH)::DATE AS made, (day + INTERVAL 24 MONTH)::DATE AS expires FROM o)
SELECT o_orderkey, n AS days_left, CASE WHEN n < 0 THEN 'overdue' WHEN n <= 3 THEN 'due' ELSE 'soon' END AS level, CASE WHEN o_orderkey % 10 > 0 THEN strftime(day, '%d/%m/%Y') ELSE '—' END AS shown, CASE WHEN o_orderkey % 9 > 0 THEN strftime(day, '%d-%b-%Y') END AS exported,
 CASE WHEN expires > made AND expires > '{AS_OF}'::DATE THEN round(((expires - '{AS_OF}'::DATE) * 100 / (expires - made))::DECIMAL(20,10), 2)::DECIMAL(8,2) END AS shelf_life,
 (CASE WHEN o_orderkey % 3 = 0 THEN day ELSE day + 2 END + CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 14 END)::DATE AS last_free_day FROM d""",
    "sunsets": "SELECT s_suppkey, ([DATE '2028-03-31', NULL, DATE '2026-09-30', NULL])[(s_suppkey % 4 + 1)::INT] AS until FROM supplier",
    "number_functions": f"""WITH p AS (SELECT p_partkey, p_size, p_retailprice::DECIMAL(12,2) AS price, {_pick_sql(UNITS, 'p_partkey')} AS unit FROM part), q AS (SELECT *, (price * p_partkey * 1000 - 5000)::DECIMAL(20,2) AS big FROM p), r AS (SELECT *, abs(trunc(big))::BIGINT::VARCHAR AS d FROM q)
SELECT p_partkey, (([0, 5, NULL, NULL, 7.5, NULL, NULL, NULL])[(p_partkey % 8 + 1)::INT])::DECIMAL(8,3) AS rate, floor(price - 1500 + 0.5)::BIGINT AS whole, p_size <= 0.02::DECIMAL(4,2) * (price + p_size) AS near, p_size > 0 AND p_size * 3 > 0.005::DECIMAL(4,3) * (price * p_size + p_size * 3) AS off,
 (p_size * CASE WHEN upper(unit) IN ('MTS', 'TON') THEN 1000 ELSE 1 END)::DECIMAL(18,3) AS quantity, CASE WHEN upper(unit) IN ('MTS', 'TON') THEN (price * 0.001::DECIMAL(4,3))::DECIMAL(18,8) ELSE price::DECIMAL(18,8) END AS kilo_price,
 CASE WHEN big < 0 THEN '-' ELSE '' END || '₹' || CASE WHEN length(d) <= 3 THEN d ELSE regexp_replace(reverse(regexp_replace(reverse(d[1:-4]), '([0-9]{{2}})', '\\1,', 'g')), '^,', '') || ',' || d[-3:] END AS rupees,
 CASE WHEN p_partkey % 12 < 10 THEN (60 * least(1 << (p_partkey % 12)::INT, 32))::BIGINT END AS wait FROM r""",
}
