"""Parsing, chunking and amendments over the fixture's texts and over made specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import sniffed
from ..operators import parsing as P
from .fixture import table

SPECS = ["3902 10 00", "0910 or 0911", "5004 to 5006", "8525 81 to 8525 83, 8528", "Any Chapter", "17 (other than 1702 11, 1703)", "2711 12 00 2711 13 00", "84 [except 8471] and 85", "9 and nonsense", "Chapters 28, 29 (all goods)"]
CONDITION_TEXTS = ["If the importer follows the Import of Goods at Concessional Rate of Duty rules", "execution of a bond with bank guarantee within six months", "nothing in particular", "produces a certificate; shall not exceed 5 kg within 30 days", "see 3, 19 and 3"]


def _pick(values: list[str], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))



def tariff_specs(spark, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select("p_partkey", _pick(SPECS, "p_partkey").alias("spec"))
    out = P.tariff_spec(s, "spec")
    return out.select("p_partkey", *[F.array_join(c, "+").alias(c) for c in ("include", "exclude", "unread")], "any_chapter")


def conditions(spark, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", _pick(CONDITION_TEXTS, "s_suppkey").alias("t"))
    return s.select("s_suppkey", F.array_join(P.condition_kinds(F.col("t")), "+").alias("kinds"), F.array_join(P.cited(F.col("t")), "+").alias("cited"))


def chunk_documents(spark, sf_dir: str) -> DataFrame:
    chunks = P.chunked(table(spark, sf_dir, "documents"), "doc_id", "text")
    return chunks.select("doc_id", "chunk", F.length("text").alias("n"), F.md5("text").alias("md5"))


def line_triples(spark, sf_dir: str) -> DataFrame:
    """Three lines in a row of which the second has two words."""
    rows = P.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return P.triples(rows, "doc_id", r"^\S+ \S+$").select("doc_id", "pos", F.md5("name").alias("name"), "code", F.md5("place").alias("place"))


def folded_entries(spark, sf_dir: str) -> DataFrame:
    """Turns of the user with what answers them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), "role", F.col("text").alias("line"))
    return P.folded(c, "conv_id", F.col("role") == "user").select("conv_id", "entry", "pos", "n", F.md5("text").alias("md5"))


def turns_under_headings(spark, sf_dir: str) -> DataFrame:
    """Each answer with the last turn of the user above it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), "role", F.col("text").alias("line"))
    return P.under_headings(c, "conv_id", F.col("role") == "user").select("conv_id", "pos", F.md5("heading").alias("heading"))


def serial_gaps(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("serial"))
    return P.serial_gaps(li, "l_orderkey", "serial")


def amended_entries(spark, sf_dir: str) -> DataFrame:
    """Parts as entries, line items as their amendments in the order of ship date."""
    entries = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 30).alias("rate"))
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_quantity") > 49, "omit").when(F.col("l_quantity") > 30, "rate").when(F.col("l_quantity") > 15, "sunset").when(F.col("l_quantity") < 3, "other")
    value = F.when(F.col("l_quantity") > 30, F.col("l_quantity").cast("int").cast("string")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    seq = F.concat_ws("/", F.date_format("l_shipdate", "yyyy-MM-dd"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), F.lpad((F.col("l_extendedprice") * 100).cast("long").cast("string"), 12, "0"))
    changes = li.select(F.col("l_partkey").alias("p_partkey"), seq.alias("seq"), kind.alias("action"), value.alias("value")).where("action IS NOT NULL")
    return P.amended(entries, changes, "p_partkey")


def media_types(spark, sf_dir: str) -> DataFrame:
    """What first bytes and extension tell; made bytes before each page's own, since the fixture has no files."""
    heads = F.element_at(F.array(*[F.lit(h) for h in ("255044462D", "25504446", "89504E470D0A1A0A", "89504E470D0A", "FFD8FFE0", "504B030414", "504B0506", "504B0102", "D0CF11E0A1B11AE1", "")]), (F.col("page_id") % 10 + 1).cast("int"))
    name = F.concat("url", F.element_at(F.array(*map(F.lit, (".docx", ".XLSX", ".doc", ".xls", ".zip", "", ".xls.pdf"))), (F.col("page_id") % 7 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", sniffed(F.concat(F.unhex(heads), F.encode("html", "UTF-8")), name).alias("type"))


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
QUERIES = {f.__name__: f for f in (tariff_specs, conditions, chunk_documents, line_triples, folded_entries, turns_under_headings, serial_gaps, amended_entries, media_types)}
SQL = {
    "tariff_specs": """SELECT p_partkey, include, exclude, unread, any_chapter FROM part JOIN (VALUES (0, '39021000', '', '', false), (1, '0910+0911', '', '', false), (2, '5004+5005+5006', '', '', false), (3, '852581+852582+852583+8528', '', '', false), (4, '', '', '', true),
 (5, '17', '170211+1703', '', false), (6, '27111200+27111300', '', '', false), (7, '84+85', '8471', '', false), (8, '', '', '9+nonsense', false), (9, '28+29', '', '', false)) v(k, include, exclude, unread, any_chapter) ON p_partkey % 10 = k""",
    "conditions": """SELECT s_suppkey, kinds, cited FROM supplier JOIN (VALUES (0, 'igcr', ''), (1, 'bond+bank-guarantee+time-limit', ''), (2, 'other', ''), (3, 'certificate+quantity-value-cap+time-limit', '5+30'), (4, 'other', '3+19')) v(k, kinds, cited) ON s_suppkey % 5 = k""",
    "chunk_documents": f"""WITH d AS (SELECT doc_id, {_FLAT} AS t FROM documents), e AS (SELECT doc_id, t, unnest(range(greatest(1, ceil((length(t) - 200) / 3300)::INT))) AS k FROM d WHERE length(t) >= 40)
SELECT doc_id, k::INT AS chunk, length(substring(t, k * 3300 + 1, 3500))::INT AS n, md5(substring(t, k * 3300 + 1, 3500)) AS md5 FROM e""",
    "line_triples": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), w AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS code, lead(line, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM l),
h AS (SELECT doc_id, list_reduce(list([pos] ORDER BY pos), lambda a, b: CASE WHEN b[1] >= a[-1] + 3 THEN list_concat(a, b) ELSE a END) AS kept FROM w WHERE regexp_matches(code, '^\S+ \S+$') AND place IS NOT NULL GROUP BY doc_id)
SELECT w.doc_id, w.pos::INT AS pos, md5(line) AS name, code, md5(place) AS place FROM w JOIN h ON h.doc_id = w.doc_id AND list_contains(h.kept, w.pos)""",
    "folded_entries": """WITH g AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS entry FROM conversations)
SELECT conv_id, entry::INT AS entry, min(turn) AS pos, count(*) AS n, md5(string_agg(text, ' ' ORDER BY turn)) AS md5 FROM g WHERE entry > 0 GROUP BY conv_id, entry""",
    "turns_under_headings": "SELECT conv_id, turn AS pos, md5(h) AS heading FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations) WHERE role <> 'user'",
    "serial_gaps": """WITH c AS (SELECT l_orderkey, l_linenumber::BIGINT AS serial, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT l_orderkey, unnest(range(1, max(serial) + 1)) AS serial FROM c GROUP BY l_orderkey)
SELECT l_orderkey, serial, 'missing' AS problem FROM w ANTI JOIN c USING (l_orderkey, serial) UNION ALL SELECT l_orderkey, serial, 'repeated' FROM c WHERE n > 1""",
    "amended_entries": """WITH c AS (SELECT l_partkey AS p_partkey, CASE WHEN l_quantity > 49 THEN 'omit' WHEN l_quantity > 30 THEN 'rate' WHEN l_quantity > 15 THEN 'sunset' WHEN l_quantity < 3 THEN 'other' END AS action,
   CASE WHEN l_quantity > 30 THEN l_quantity::INT::VARCHAR ELSE strftime(l_shipdate, '%Y-%m-%d') END AS value, concat_ws('/', strftime(l_shipdate, '%Y-%m-%d'), lpad(l_orderkey::VARCHAR, 9, '0'), lpad(l_linenumber::VARCHAR, 3, '0'), lpad(l_suppkey::VARCHAR, 6, '0'), lpad(trunc(l_extendedprice * 100)::BIGINT::VARCHAR, 12, '0')) AS seq FROM lineitem),
a AS (SELECT p_partkey, arg_max(value, seq) FILTER (action = 'rate') AS rate, arg_max(value, seq) FILTER (action = 'sunset') AS until, bool_or(action = 'omit') AS omitted, bool_or(action = 'other') AS stale FROM c WHERE action IS NOT NULL GROUP BY p_partkey)
SELECT p_partkey, coalesce(rate, (p_size % 30)::VARCHAR) AS rate, until, coalesce(stale, false) AS stale FROM part LEFT JOIN a USING (p_partkey) WHERE NOT coalesce(omitted, false)""",
    "media_types": """SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'application/pdf' WHEN 2 THEN 'image/png' WHEN 4 THEN 'image/jpeg' WHEN 1 THEN NULL WHEN 3 THEN NULL WHEN 7 THEN NULL WHEN 9 THEN NULL
 ELSE CASE page_id % 7 WHEN 0 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 1 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 2 THEN 'application/msword' WHEN 3 THEN 'application/vnd.ms-excel' END END AS type FROM pages""",
}
