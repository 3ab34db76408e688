"""Countries, ports, parties, products and codes looked up in masters, over the fixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as T
from ..operators import masters as M
from .fixture import HS_SQL, hs, table


def _pick(key: str, *values: Column | str) -> Column:
    made = [F.lit(v) if isinstance(v, str) else v for v in values]
    return F.element_at(F.array(*made), (F.col(key) % len(made) + 1).cast("int"))


def _nation_code(key: str) -> Column:
    return F.concat(F.lit("N"), F.chr(F.col(key) + 65))


def _countries(spark, sf_dir: str) -> DataFrame:
    """Nations as countries: codes N and a letter, an alias each."""
    code = _nation_code("n_nationkey")
    return table(spark, sf_dir, "nation").select(code.alias("iso2"), F.concat(code, F.lit("X")).alias("iso3"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("Land of "), F.col("n_nationkey").cast("string"))).alias("aliases"))


def _stated_country(key: str, nation: str) -> Column:
    n = F.col(nation).cast("string")
    return _pick(
        key, _nation_code(nation), F.lower(F.concat(_nation_code(nation), F.lit("x"))), F.concat(F.lit("Nation-"), n), F.concat(F.lit("Kingdom of the Nätion "), n), F.concat(F.lit("NATION_"), n, F.lit(", Federal Republic of")), F.concat(F.lit("the  land of "), n), "zz", "Republic of China",
    )


def country_of_text(spark, sf_dir: str) -> DataFrame:
    stated = table(spark, sf_dir, "customer").select("c_custkey", _stated_country("c_custkey", "c_nationkey").alias("stated"))
    return M.country_codes(stated, "stated", _countries(spark, sf_dir)).select("c_custkey", "iso2")


def country_of_addresses(spark, sf_dir: str) -> DataFrame:
    """The last part of an address that names a country."""
    c = table(spark, sf_dir, "customer")
    address = F.concat(F.lit("12 Main Road, Nation 1,"), _stated_country("c_custkey", "c_nationkey"), F.lit("\nPIN 400001, "), F.when(F.col("c_custkey") % 9 == 0, "Land of 2").otherwise("Dock 7"))
    return M.country_of_address(c.select("c_custkey", address.alias("address")), "c_custkey", "address", _countries(spark, sf_dir)).select("c_custkey", "iso2")


def port_codes(spark, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", _pick("s_suppkey", "Yokohama(JPYOK)", "inmun", "YOKOHAMA, JAPAN", " Nhava Sheva (innsa) ", "").alias("stated"))
    loose = F.when(F.upper("stated").contains("YOKOHAMA"), "JPYOK")
    code = T.unlocode(F.col("stated"), loose)
    return s.select("s_suppkey", code.alias("code"), F.when(code.isNotNull(), T.foreign_port(F.lit("Port"), code)).alias("shown"))


def enumerations(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        C.code_of(_pick("p_partkey", "FOB", "CFR", "CI", "EXW", "C&F"), C.TERMS_CODES).alias("terms"),
        C.code_of(_pick("p_partkey", "Sea", "Air", "Road"), C.TRANSPORT_CODES).alias("transport"),
        C.code_of(_pick("p_partkey", "Normal", "Prior", "Advance", "Late"), C.FILING_CODES).alias("filing"),
        C.code_of(_pick("p_partkey", "Item Category", " chr ", "Storage Condition", "Product Name"), C.INFO_TYPE_CODES, passing=True).alias("info"),
        C.code_of(_pick("p_partkey", "Standard UQC", "cas", "Name as per the IUPAC Nomenclature"), C.QUALIFIER_CODES, passing=True).alias("qualifier"),
    )


def text_forms(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", _pick("c_custkey", " 0 ", "Main", ".", "n/a", "Unit 2 ").alias("branch"), _pick("c_custkey", "-- ccr/07 b -- long suffix text", "!!", "import licence.").alias("code"))
    clause = _pick("c_custkey", "Pay the duty. Then ship.", "A licence is needed; see note", "The importer shall furnish an undertaking to the proper officer that the goods are for the stated use")
    return c.select(
        "c_custkey", T.branch_for_export(F.col("branch")).alias("branch"), T.tidy_code(F.col("code")).alias("code"), T.first_clause(clause).alias("clause"), T.safe_part(F.concat("c_name", F.lit(" / x"))).alias("part"),
        T.storage_path(F.lit("co"), F.col("c_custkey").cast("string"), F.sha2("c_name", 256), F.concat("c_name", F.lit(".pdf"))).alias("path"),
        T.job_title(F.when(F.col("c_custkey") % 3 == 0, "MEDU1"), F.when(F.col("c_custkey") % 2 == 0, "INV 9"), F.when(F.col("c_custkey") % 5 > 0, F.repeat("c_name", 8))).alias("title"),
    )


def prose_and_cells(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.prose(_pick("p_partkey", "“a”  – b", "it’s so", "plain")).alias("prose"), T.clean(_pick("p_partkey", "eﬃcient  ﬁlm", "Côte d’or"[:4], "x")).alias("clean"), T.column_number(F.concat(T.column_letter(F.col("p_partkey") % 18278 + 1), F.lit("7"))).alias("number"))


def hs_keys(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", hs("p_partkey").alias("h"))
    keys = T.hs_lookup_keys(F.array(F.substring("h", 1, 4), F.substring("h", 1, 6), F.lit("12")))
    return p.select("p_partkey", F.array_join(keys, ">").alias("keys"), T.hs_matches_prefix(F.col("h"), F.concat(F.lit("10."), F.substring("h", 3, 2))).alias("fits"))


def stamps(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.when(F.col("event_id") % 6 > 0, F.col("ts"))
    assessed = F.when(F.col("event_id") % 4 > 0, (F.col("value") + F.col("event_id") % 3).cast("decimal(18,2)"))
    held = F.col("value").cast("decimal(18,2)")
    return e.select("event_id", D.stamp(ts, True).alias("minute"), D.stamp(ts).alias("day"), D.in_order(F.to_date("ts"), F.to_date(F.lit("2024-01-05"))).alias("in_order"), N.variance(held, assessed).alias("variance"), N.varies(held, assessed).alias("varies"))


def _parties(spark, sf_dir: str) -> DataFrame:
    """Customers as parties of two roles."""
    name = F.concat(_pick("c_custkey", "Alpha", "Beta", "Gamma", "Delta", "Alfa"), F.lit(" Traders "), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), T.party_key(name).alias("name_key"), F.lit("").alias("branch"), (F.col("c_custkey") % 7 > 0).alias("is_active"), (F.col("c_custkey") % 2 == 0).alias("is_consignee"), (F.col("c_custkey") % 3 == 0).alias("is_supplier"))


def party_search_rows(spark, sf_dir: str) -> DataFrame:
    """Four searches: by name and role, by a part of the name, blank, and with a limit beyond the largest."""
    p = _parties(spark, sf_dir)
    asked = [("alpha traders 10", "consignee", None), ("ers 12", None, 5), ("  ", "supplier", 3), ("gamma", None, 5000)]
    parts = [M.party_search(p, q, r, n).select(F.lit(k).alias("search"), "c_custkey", "name", "sim") for k, (q, r, n) in enumerate(asked)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _party_cells(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 11 == 0, "N/A").otherwise(F.concat(F.lit('"Firm '), F.floor(F.col("c_custkey") / 3).cast("string"), F.lit(" Pvt. Ltd.")))
    return c.select(F.col("c_custkey").alias("row"), name.alias("name"), _pick("c_custkey", "0", ".", "").alias("branch"), F.when(F.floor(F.col("c_custkey") / 3) % 4 > 0, F.concat(F.lit("Land of "), F.col("c_nationkey").cast("string"))).otherwise("Nowhere").alias("country"), F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("G"), F.col("c_custkey").cast("string"))).otherwise("NIL").alias("gstin"))


def party_master(spark, sf_dir: str) -> DataFrame:
    rows, _ = M.party_rows(_party_cells(spark, sf_dir), "row", _countries(spark, sf_dir))
    return rows.select("name", "country", "iso2", "gstin", "n_rows")


def party_master_metrics(spark, sf_dir: str) -> DataFrame:
    """What an import reports: rows, merged and rejected ones, countries without a code."""
    cells = _party_cells(spark, sf_dir)
    rows, rejects = M.party_rows(cells, "row", _countries(spark, sf_dir))
    kept = rows.agg(F.count("*").alias("rows"), F.sum(F.col("n_rows") - 1).alias("merged"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("iso2").isNull(), F.col("country")))), ",").alias("unmapped"))
    return kept.join(rejects.agg(F.count("*").alias("blank")), how="cross")


def certificate_match(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    items = li.select(F.col("l_orderkey").alias("job"), F.col("l_partkey").alias("part"), F.concat("p_name", F.lit(" grade "), F.col("p_partkey").cast("string")).alias("description"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey").cast("string")).alias("batch")).distinct()
    products = li.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("job"), F.col("l_partkey").alias("pos"), F.when(F.col("l_partkey") % 2 == 0, F.substring("p_name", 1, 6)).alias("product_code"), F.concat("p_name", F.lit(" grade "), F.col("p_partkey").cast("string"), F.lit(" drum")).alias("product_description"), F.col("l_partkey").cast("string").alias("product_batch")).distinct()
    return M.certificate_products(items, products, ["part"], "pos").select("job", "part", "pos")


def igcr_needs(spark, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_partkey") % 25, F.col("p_partkey") % 9).alias("cited"))
    conditions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("no"), F.when(F.col("n_nationkey") % 6 == 0, F.array(F.lit("bond"), F.lit("igcr"))).otherwise(F.array(F.lit("other"))).alias("kinds"))
    return M.with_needs(entries, conditions, "p_partkey")


def container_sizes_known(spark, sf_dir: str) -> DataFrame:
    """Identifiers with the size of the draft's container of the same normalised number."""
    ids = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("msku "), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit("-1")).alias("raw"))
    drafts = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("MSKU"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit("1")).alias("number"), F.when(F.col("c_custkey") % 4 == 0, "40").otherwise("20").alias("size"))
    return ids.join(drafts, T.alnum(F.col("raw")) == T.alnum(F.col("number")), "left").select("s_suppkey", "size")


def _case(key: str, *values: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


_G = "list_distinct(list_transform(range(1, length('  ' || {0} || ' ') - 1), lambda i: substring('  ' || {0} || ' ', i, 3)))"
_SIM = "floor(len(list_intersect({g}, {h})) * 10000 / (len({g}) + len({h}) - len(list_intersect({g}, {h}))))::BIGINT"
_PARTIES = f"""p AS (SELECT c_custkey, {_case('c_custkey', "'Alpha'", "'Beta'", "'Gamma'", "'Delta'", "'Alfa'")} || ' Traders ' || c_custkey AS name, c_custkey % 7 > 0 AS is_active, c_custkey % 2 = 0 AS is_consignee, c_custkey % 3 = 0 AS is_supplier FROM customer)"""


def _search_sql(k: int, query: str, role: str, limit: int) -> str:
    sim = _SIM.format(g=_G.format("lower(name)"), h=_G.format(f"'{query}'")) if query else "0::BIGINT"
    fits = f"(sim >= 3000 OR contains(lower(name), '{query}') OR contains(upper(name), upper('{query}')))" if query else "true"
    return f"(SELECT {k} AS search, c_custkey, name, sim FROM (SELECT *, {sim} AS sim FROM p WHERE is_active{role}) WHERE {fits} ORDER BY sim DESC, name LIMIT {limit})"


_CELLS = f"""cells AS (SELECT c_custkey AS row, CASE WHEN c_custkey % 11 <> 0 THEN 'Firm ' || (c_custkey // 3) || ' Pvt. Ltd.' END AS name, CASE WHEN c_custkey // 3 % 4 > 0 THEN 'Land of ' || c_nationkey ELSE 'Nowhere' END AS country,
  CASE WHEN c_custkey // 3 % 4 > 0 THEN 'N' || chr(65 + c_nationkey) END AS iso2, CASE WHEN c_custkey % 3 = 1 THEN 'G' || c_custkey END AS gstin FROM customer),
firms AS (SELECT arg_min(name, row) AS name, arg_min(country, row) AS country, arg_min(iso2, row) FILTER (iso2 IS NOT NULL) AS iso2, arg_min(gstin, row) FILTER (gstin IS NOT NULL) AS gstin, count(*) AS n_rows FROM cells WHERE name IS NOT NULL GROUP BY cells.name)"""
_NATION = "'N' || chr(65 + c_nationkey)"
_FN = (country_of_text, country_of_addresses, port_codes, enumerations, text_forms, prose_and_cells, hs_keys, stamps, party_search_rows, party_master, party_master_metrics, certificate_match, igcr_needs, container_sizes_known)
QUERIES = {f.__name__: f for f in _FN}
SQL = {
    "country_of_text": f"SELECT c_custkey, CASE WHEN c_custkey % 8 < 6 THEN {_NATION} END AS iso2 FROM customer",
    "country_of_addresses": f"SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'NC' WHEN c_custkey % 8 = 4 THEN {_NATION} WHEN c_custkey % 8 < 6 THEN {_NATION} ELSE 'NB' END AS iso2 FROM customer",
    "port_codes": f"WITH c AS (SELECT s_suppkey, {_case('s_suppkey', chr(39) + 'JPYOK' + chr(39), chr(39) + 'INMUN' + chr(39), chr(39) + 'JPYOK' + chr(39), chr(39) + 'INNSA' + chr(39), 'NULL')} AS code FROM supplier) SELECT s_suppkey, code, 'Port(' || code || ')' AS shown FROM c",
    "enumerations": f"""SELECT p_partkey, {_case('p_partkey', "'FOB'", "'C&F'", "'C&I'", 'NULL', "'C&F'")} AS terms, {_case('p_partkey', "'S'", "'A'", 'NULL')} AS transport, {_case('p_partkey', "'N'", "'P'", "'A'", 'NULL')} AS filing,
 {_case('p_partkey', "'CTG'", "'CHR'", 'NULL', "'PNM'")} AS info, {_case('p_partkey', "'SQC'", "'CAS'", "'IUP'")} AS qualifier FROM part""",
    "text_forms": f"""SELECT c_custkey, {_case('c_custkey', 'NULL', "'Main'", 'NULL', 'NULL', "'Unit 2'")} AS branch, {_case('c_custkey', "'CCR-07-B-LONG-SU'", "'CCR'", "'IMPORT-LICENCE'")} AS code,
 {_case('c_custkey', "'Pay the duty'", "'A licence is needed'", "'The importer shall furnish an undertaking to the proper officer that'")} AS clause, regexp_replace(c_name || ' / x', '[^A-Za-z0-9._-]+', '_', 'g') AS part,
 'co/' || c_custkey || '/' || left(sha256(c_name), 12) || '-' || replace(c_name, '#', '-') || '.pdf' AS path,
 CASE WHEN c_custkey % 3 = 0 THEN 'B/L MEDU1' WHEN c_custkey % 2 = 0 THEN 'Invoice INV 9' WHEN c_custkey % 5 > 0 THEN left(repeat(c_name, 8), 120) ELSE 'Untitled job' END AS title FROM customer""",
    "prose_and_cells": f"""SELECT p_partkey, {_case('p_partkey', "'\"a\" - b'", "'it''s so'", "'plain'")} AS prose, {_case('p_partkey', "'efficient film'", "'Côte'", "'x'")} AS clean, (p_partkey % 18278 + 1)::INT AS number FROM part""",
    "hs_keys": f"""WITH p AS (SELECT p_partkey, {HS_SQL.format('p_partkey')} AS h FROM part), k AS (SELECT p_partkey, h, [left(h, 4), left(h, 3), left(h, 2), left(h, 6), left(h, 5)] AS l FROM p)
SELECT p_partkey, array_to_string(l, '>') AS keys, left(h, 2) = '10' AS fits FROM k""",
    "stamps": """WITH e AS (SELECT event_id, ts, (ts + INTERVAL 330 MINUTE) AS l, value::DECIMAL(18,2) AS held, CASE WHEN event_id % 4 > 0 THEN (value + event_id % 3)::DECIMAL(18,2) END AS assessed FROM events)
SELECT event_id, CASE WHEN event_id % 6 > 0 THEN strftime(l, '%d/%m/%Y %H:%M') ELSE '—' END AS minute, CASE WHEN event_id % 6 > 0 THEN strftime(l, '%d/%m/%Y') ELSE '—' END AS day, ts::DATE <= DATE '2024-01-05' AS in_order, (assessed - held)::DECIMAL(18,2) AS variance, abs(assessed - held) > 1 AS varies FROM e""",
    "party_search_rows": f"WITH {_PARTIES} " + " UNION ALL ".join(_search_sql(k, q, r, n) for k, (q, r, n) in enumerate([("alpha traders 10", " AND is_consignee", 20), ("ers 12", "", 5), ("", " AND is_supplier", 3), ("gamma", "", 200)])),
    "party_master": f"WITH {_CELLS} SELECT * FROM firms",
    "party_master_metrics": f"WITH {_CELLS} SELECT count(*) AS rows, sum(n_rows - 1)::BIGINT AS merged, array_to_string(list_sort(list(DISTINCT country) FILTER (iso2 IS NULL)), ',') AS unmapped, (SELECT count(*) FROM cells WHERE name IS NULL) AS blank FROM firms",
    "certificate_match": """WITH l AS (SELECT DISTINCT l_orderkey AS job, l_partkey AS part, p_name, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey),
i AS (SELECT DISTINCT job, part, upper(p_name || ' grade ' || part) AS d, CASE WHEN part % 3 = 0 THEN part END AS batch FROM l),
c AS (SELECT job, part AS pos, upper(CASE WHEN part % 2 = 0 THEN left(p_name, 6) ELSE p_name || ' grade ' || part || ' drum' END) AS code, upper(p_name || ' grade ' || part || ' drum') AS t FROM l WHERE l_returnflag = 'A')
SELECT job, part, min(pos) AS pos FROM i JOIN c USING (job) WHERE coalesce(batch = pos, false) OR contains(d, code) OR contains(t, left(d, 25)) GROUP BY job, part""",
    "igcr_needs": "SELECT p_partkey, (p_partkey % 25) % 6 = 0 OR (p_partkey % 9) % 6 = 0 AS needs FROM part",
    "container_sizes_known": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '40' WHEN s_suppkey % 2 = 0 THEN '20' END AS size FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer) OR s_suppkey % 2 = 1",
}
