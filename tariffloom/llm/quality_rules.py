"""Quality rules on single texts and on lines that many documents of a host share, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, table, written
from .textkeys import text_keys

BLANKS = "\\x20\\x09-\\x0D"
WINDOW = 8
BROADCAST_ROWS = 100_000


def _repeated_places(one: DataFrame) -> DataFrame:
    """Adds ``places``: where WINDOW-word windows start that the text has twice or more, in order.

    Windows are compared by 64-bit hash. Sorting (hash, place) brings equal ones
    together. Each array is a column before a lambda looks into it; written
    inline it would be made anew for each element.
    """
    one = one.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(1), F.size("hashed") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashed", i, WINDOW)))
    one = one.withColumn("windows", F.when(F.size("hashed") >= WINDOW, windows))
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    one = one.withColumn("placed", F.when(repeats, placed))
    same = lambda x, k: F.coalesce(F.get("placed", k)["h"] == x["h"], F.lit(False))
    return one.withColumn("places", F.sort_array(F.transform(F.filter("placed", lambda x, k: same(x, k + 1) | same(x, k - 1)), lambda x: x["i"])))


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space as single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(line), "123456789", "000000000"), f"[{BLANKS}]+", " "))


def text_measures(docs: DataFrame) -> DataFrame:
    """docs' doc_id, source (null as empty), the counts of a single text, two hashes of the whole text and ``lines``; a null text has no words.

    ``lines`` holds for each line with a word the hash of the normalised line and its number of words.
    """
    text = F.coalesce("text", F.lit(""))
    one = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), text.alias("t"))
    one = one.withColumn("words", F.array_remove(F.split("t", f"[{BLANKS}]+", -1), ""))
    one = one.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]")))
    one = _repeated_places(one.withColumn("normal", F.transform("lines", normal_line)))
    gaps = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))))
    return one.select(
        "doc_id",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(F.aggregate(gaps, F.lit(0), lambda a, g: a + g)).cast("long").alias("n_repeat_words"),
        *text_keys(F.col("t")),
        F.transform("normal", lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words"))).alias("lines"),
    )


def frequent_lines(measures: DataFrame, least: int = 20, share: float = 0.02) -> DataFrame:
    """(source, line) of lines in more than ``least`` different texts of a host and in more than ``share`` of its texts, from ``text_measures``.

    Whole copies of a text count once, so a document isn't taken for boilerplate
    because it was copied. A null source is a host of its own. Counting is by
    partial distinct aggregates; a line that every document has costs one row
    per task.
    """
    rows = measures.select("source", "k1", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    counts = rows.groupBy("source", "line").agg(F.count_distinct("k1").alias("texts")).where(F.col("texts") > least)
    hosts = measures.groupBy("source").agg(F.count_distinct("k1").alias("all_texts"))
    return counts.join(hosts, "source").where(F.col("texts") > share * F.col("all_texts")).select("source", "line")


def _hits(measures: DataFrame, columns: list[str], limits: dict) -> DataFrame:
    """``columns`` of ``measures`` with ``line`` and ``words`` of each line above the limits.

    The list of such lines is broadcast if it has at most BROADCAST_ROWS (two
    short columns each, so some megabytes), else joined by shuffle, where Spark
    splits the skewed keys.
    """
    frequent = cut(frequent_lines(measures, **limits))
    frequent = F.broadcast(frequent) if frequent.count() <= BROADCAST_ROWS else frequent
    lines = measures.select(*columns, "source", F.explode("lines").alias("l")).select(*columns, "source", "l.line", "l.words")
    return lines.join(frequent, ["source", "line"])


def rule_verdicts(docs: DataFrame, least: int = 20, share: float = 0.02, remains: float = 0.3) -> DataFrame:
    """The measures of each document with base_failed, n_frequent_words (words in lines above the limits) and kept.

    A document is depleted, and not kept, if less than ``remains`` of its words
    are left without the frequent lines. Each row is judged alone, also those
    that share a doc_id or have none; whole texts are read, in one scan, whose
    measures are written to the shared folder with a number for each row; an
    empty table gives no rows; only doc_id, text and source are read.
    """
    docs = docs.select("doc_id", "text", "source")
    measures = written(text_measures(docs).withColumn("row", F.monotonically_increasing_id()), "measures")
    hits = _hits(measures, ["row"], {"least": least, "share": share})
    lost = hits.groupBy("row").agg(F.sum("words").cast("long").alias("n_frequent_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_frequent_words")
    return (
        measures.drop("k1", "k2", "lines")
        .join(lost, "row", "left")
        .drop("row")
        .withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= remains * F.col("n_words")))
    )


def without_frequent_lines(docs: DataFrame, **limits) -> DataFrame:
    """docs without the lines above the limits; a document's list of such lines is bounded by its own length.

    Rows meet their lists by host and text, so they are judged each alone,
    whatever their ids; a null text stays null; other columns pass as they are.
    """
    measures = written(text_measures(docs.select("doc_id", "text", "source")).select("source", "k1", "k2", "lines"), "measures")
    lists = _hits(measures, ["k1", "k2"], limits).groupBy("source", "k1", "k2").agg(F.collect_set("line").alias("frequent"))
    framed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), F.coalesce(docs["source"], F.lit("")).alias("source"), *text_keys(F.coalesce(docs["text"], F.lit(""))))
    joined = framed.join(lists, ["source", "k1", "k2"], "left")
    text = F.col("doc")["text"]
    keep = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains("frequent", F.xxhash64(normal_line(x))))
    clean = F.when(F.col("frequent").isNull(), text).otherwise(F.array_join(keep, "\n"))
    return joined.select(*[clean.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    verdicts = rule_verdicts(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words")


#: The same with DuckDB; windows and lines are compared themselves, not by hash.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
rep AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM rep GROUP BY doc_id),
ln AS (
  SELECT doc_id, source, t, trim(regexp_replace(translate(lower(l), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, source, t, unnest(lines) AS l FROM d)),
freq AS (
  SELECT source, line FROM (SELECT source, line, count(DISTINCT t) AS texts FROM ln GROUP BY ALL)
  JOIN (SELECT source, count(DISTINCT t) AS all_texts FROM d GROUP BY source) USING (source)
  WHERE texts > 20 AND texts > 0.02 * all_texts),
lost AS (
  SELECT doc_id, sum(len(string_split(line, ' ')))::BIGINT AS n FROM ln JOIN freq USING (source, line) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(translate(t, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_frequent_words
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN lost ON lost.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_frequent_words >= 0.3 * n_words) AS kept,
       n_frequent_words
FROM m
"""
