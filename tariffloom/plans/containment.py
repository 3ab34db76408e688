"""Ports, custom houses and airlines named in texts, by all stages of their lookups; masters grow with the customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import containment as C
from .fixture import table

#: Columns of masters and texts, in words that both engines read.
_LETTERS = "translate(lpad(CAST(c_custkey % 100000 AS STRING), 5, '0'), '0123456789', 'ABCDEFGHIJ')"
PORTS = f"c_custkey AS answer, c_custkey AS pos, {_LETTERS} AS code, 'Haven ' || CAST(c_custkey AS STRING) AS name, CASE WHEN c_custkey % 3 = 0 THEN 'Pier ' || CAST(c_custkey % 40 AS STRING) || ' Süd' END AS alias"
HOUSES = "c_custkey AS answer, c_custkey AS pos, 'IN' || lpad(CAST(c_custkey AS STRING), 6, '0') AS code, CASE WHEN c_custkey % 2 = 0 THEN 'E' || CAST(c_custkey AS STRING) END AS edi, 'Station ' || CAST(c_custkey * 37 % 100003 AS STRING) || CASE c_custkey % 3 WHEN 0 THEN ' Air' WHEN 1 THEN ' Sea' ELSE ' ICD' END AS name"
CARRIERS = "c_custkey AS answer, c_custkey AS pos, lpad(CAST(c_custkey % 900 AS STRING), 3, '0') AS prefix, 'A' || CAST(c_custkey % 10 AS STRING) AS iata, right(translate(lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '0123456789', 'ABCDEFGHIJ'), 3) AS icao, 'Air ' || CAST(c_custkey AS STRING) || ' Lines' AS name"
_N = "CAST(o_custkey AS STRING)"
PORT_TEXT = f"""CASE o_orderkey % 7 WHEN 0 THEN 'HAVEN ' || {_N} || ', SOMEWHERE' WHEN 1 THEN 'haven ' || {_N} WHEN 2 THEN lower(translate(lpad({_N}, 5, '0'), '0123456789', 'ABCDEFGHIJ'))
  WHEN 3 THEN 'via xhaven ' || {_N} || '9' WHEN 4 THEN 'at pier ' || CAST(o_custkey % 45 AS STRING) || ' sud / x' WHEN 5 THEN 'Haven ' || {_N} || ' and Haven 7' ELSE 'nowhere' END"""
HOUSE_TEXT = f"""CASE o_orderkey % 6 WHEN 0 THEN 'in' || lpad({_N}, 6, '0') WHEN 1 THEN ' e' || {_N} WHEN 2 THEN 'station ' || CAST(o_custkey * 37 % 100003 AS STRING) || ' air' WHEN 3 THEN 'ion ' || CAST(o_custkey * 37 % 100003 AS STRING)
  WHEN 4 THEN CAST(o_custkey % 1000 AS STRING) || ' sea' ELSE '' END"""
CARRIER_TEXT = f"""CASE o_orderkey % 7 WHEN 0 THEN lpad(CAST(o_custkey % 950 AS STRING), 3, '0') || '-1234 5675' WHEN 1 THEN 'a' || CAST(o_custkey % 12 AS STRING) WHEN 2 THEN translate(lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'), '0123456789', 'ABCDEFGHIJ')
  WHEN 3 THEN 'air ' || {_N} || ' lines' WHEN 4 THEN 'r ' || {_N} || ' l' WHEN 5 THEN 'the air ' || {_N} || ' lines office' ELSE '12x' END"""


def _sides(spark, sf_dir: str, master: str, text: str) -> tuple[DataFrame, DataFrame]:
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{text} AS raw")
    return asked, table(spark, sf_dir, "customer").selectExpr(*_split(master))


def _split(columns: str) -> list[str]:
    """The expressions of a select list whose commas inside brackets stay."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def foreign_port_stages(spark, sf_dir: str) -> DataFrame:
    asked, ports = _sides(spark, sf_dir, PORTS, PORT_TEXT)
    return C.foreign_ports(asked, "o_orderkey", "raw", ports.withColumn("aliases", F.array_compact(F.array("alias"))))


def custom_house_stages(spark, sf_dir: str) -> DataFrame:
    return C.custom_houses(*_keyed(*_sides(spark, sf_dir, HOUSES, HOUSE_TEXT)))


def airline_stages(spark, sf_dir: str) -> DataFrame:
    return C.airlines(*_keyed(*_sides(spark, sf_dir, CARRIERS, CARRIER_TEXT)))


def _keyed(asked: DataFrame, master: DataFrame) -> tuple:
    return asked, "o_orderkey", "raw", master


_KEY = "trim(regexp_replace(upper(replace(replace({0}, 'ü', 'u'), 'Ü', 'U')), '[^A-Z0-9]+', ' ', 'g'))"
_BEST = "SELECT a.o_orderkey, a.raw, s.stage, s.answer FROM a LEFT JOIN (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY stage) = 1) s ON s.o_orderkey = a.o_orderkey"
_FIRST = "SELECT o_orderkey, {stage} AS stage, answer FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY {order}) = 1"
_ONLY = "SELECT o_orderkey, {stage} AS stage, min(answer) AS answer FROM ({rows}) GROUP BY o_orderkey HAVING count(DISTINCT answer) = 1"


def _sql(master: str, text: str, own: str, *stages: str, more: str = "") -> str:
    return f"WITH m AS (SELECT {master} FROM customer), a AS (SELECT o_orderkey, {text} AS raw FROM orders), q AS (SELECT DISTINCT raw, {own} FROM a){more}, s AS ({' UNION ALL '.join(stages)}) {_BEST}"


def _stage(stage: int, rows: str, order: str = "pos") -> str:
    return _FIRST.format(stage=stage, rows=f"SELECT a.o_orderkey, x.* FROM a JOIN ({rows}) x ON x.raw = a.raw", order=order)


def _single(stage: int, rows: str) -> str:
    return _ONLY.format(stage=stage, rows=f"SELECT a.o_orderkey, x.answer FROM a JOIN ({rows}) x ON x.raw = a.raw")


_NAMED = f", n AS (SELECT answer, pos, name AS t FROM m UNION ALL SELECT answer, pos, alias FROM m WHERE alias IS NOT NULL), k AS (SELECT *, {_KEY.format('t')} AS key, max(length({_KEY.format('t')})) OVER (PARTITION BY answer) AS long FROM n)"
QUERIES = {f.__name__: f for f in (foreign_port_stages, custom_house_stages, airline_stages)}
SQL = {
    "foreign_port_stages": _sql(
        PORTS,
        PORT_TEXT,
        f"{_KEY.format('raw')} AS key, lower(trim(raw)) AS low",
        _stage(1, "SELECT q.raw, k.* FROM q JOIN k ON q.key = k.key"),
        _stage(2, "SELECT q.raw, k.* FROM q JOIN k ON contains(' ' || q.key || ' ', ' ' || k.key || ' ')", "long DESC, pos"),
        _stage(3, "SELECT q.raw, n.answer, n.pos FROM q JOIN n ON contains(q.low, lower(n.t)) UNION ALL SELECT q.raw, m.answer, m.pos FROM q JOIN m ON q.low = lower(m.code)"),
        more=_NAMED,
    ),
    "custom_house_stages": _sql(
        HOUSES,
        HOUSE_TEXT,
        "upper(trim(raw)) AS up",
        _stage(1, "SELECT q.raw, m.answer, m.pos FROM q JOIN m ON q.up IN (m.code, m.edi) WHERE q.up <> ''"),
        _stage(2, "SELECT q.raw, m.answer, m.pos FROM q JOIN m ON q.up = upper(m.name)"),
        _single(3, "SELECT q.raw, m.answer FROM q JOIN m ON contains(upper(m.name), q.up) WHERE q.up <> ''"),
    ),
    "airline_stages": _sql(
        CARRIERS,
        CARRIER_TEXT,
        "upper(trim(raw)) AS up",
        _stage(1, "SELECT q.raw, m.answer, m.pos FROM q JOIN m ON regexp_extract(up, '^([0-9]{3})([^0-9A-Z_]|$)', 1) = m.prefix"),
        _stage(2, "SELECT q.raw, m.answer, m.pos FROM q JOIN m ON length(up) = 2 AND up = m.iata"),
        _stage(3, "SELECT q.raw, m.answer, m.pos FROM q JOIN m ON regexp_matches(up, '^[A-Z]{3}$') AND up = m.icao"),
        _stage(4, "SELECT q.raw, m.answer, m.pos FROM q JOIN m ON up = upper(m.name)"),
        _single(5, "SELECT q.raw, m.answer FROM q JOIN m ON contains(upper(m.name), up) OR contains(up, upper(m.name))"),
    ),
}
