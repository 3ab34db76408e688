"""Streams and readers over the fixture; each stream runs over all that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources, streaming
from ..operators.matching import WEIGHTS
from ..sources.feed import Subscription, expire, publish
from ..storage import fresh_path
from ..streaming.expiry import attached
from ..streaming.retries import retried
from .fixture import HS_SQL, hs, table


def _events(spark, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # as a pattern, since a stream's plain path must be a folder and the table may be one file
    return streaming.source(spark, f"{sf_dir}/event[s].parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_unique(spark, sf_dir: str) -> DataFrame:
    """Messages by their key, replays dropped."""
    keyed = _events(spark, sf_dir).select("ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return streaming.drained(streaming.unique(keyed, ["user_id", "event_type", "k"], "ts", "60 days"), "unique").select("user_id", "event_type", "k")


def stream_tumbling(spark, sf_dir: str) -> DataFrame:
    """Hourly counts by type; an addition to what the poller does."""
    windows = streaming.tumbling(_events(spark, sf_dir), "ts", "10 minutes", "1 hour", "event_type")
    return streaming.drained(windows, "tumbling").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def _identified(spark, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("user_id", "event_id", "ts", F.get_json_object("props", "$.k").alias("identifier"))


def stream_attached(spark, sf_dir: str) -> DataFrame:
    """Messages attached by what earlier ones of the user have brought."""
    with streaming.with_timers(spark):
        return streaming.drained(attached(_identified(spark, sf_dir)), "attached")


def stream_expiring(spark, sf_dir: str) -> DataFrame:
    """The same where an identifier expires after six silent days."""
    with streaming.with_timers(spark):
        return streaming.drained(attached(_identified(spark, sf_dir), 6 * 86_400_000), "expiring")


def stream_enriched(spark, sf_dir: str) -> DataFrame:
    """Stream joined with a static master, counted in complete mode."""
    master = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = _events(spark, sf_dir).join(master, F.col("user_id") == F.col("c_custkey"))
    return streaming.drained(joined.groupBy("c_mktsegment", "event_type").agg(F.count("*").alias("n")), "enriched", "complete")


def message_stream(stream: DataFrame) -> DataFrame:
    """Events as messages with identifiers of kinds that vary; the user is the company."""
    k = F.get_json_object("props", "$.k").cast("long")
    of = lambda shift, most: F.concat(F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("event_id") + shift) % len(WEIGHTS) + 1).cast("int")), F.lit(":V"), (k % most).cast("string"))
    return stream.select(F.col("user_id").alias("company"), F.col("event_id").alias("message"), "ts", F.array(of(0, 5), of(1, 3), of(3, 4)).alias("identifiers"), (F.col("event_id") % 3).alias("recognised"))


def stream_matched(spark, sf_dir: str) -> DataFrame:
    """Messages scored against what earlier messages of the company gave to jobs; a stateful fold, held to brute force in the tests."""
    return streaming.matched(message_stream(_events(spark, sf_dir)), "matched")


CHANGES = "seq long, user_id long, event_type string, value double"


def _published(spark, sf_dir: str) -> tuple[DataFrame, int, str]:
    """Events as numbered changes, how many, and an empty feed for them."""
    changes = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), "user_id", "event_type", "value", (F.col("event_type") == "error").alias("deleted"), (F.col("user_id") % 9 == 0).alias("draft"))
    return changes, changes.count(), fresh_path(spark, "feed")


def feed_read(spark, sf_dir: str) -> DataFrame:
    """A feed primed after its first quarter, then polled page by page until it has no more; tombstones and drafts are left out."""
    changes, n, folder = _published(spark, sf_dir)
    publish(changes.where(F.col("seq") <= n // 4), "seq", folder, chunk=max(1000, n // 64))
    reader = Subscription(spark, folder, CHANGES, page=25, pages=max(50, n // 50))
    reader.prime()
    publish(changes.where(F.col("seq") > n // 4), "seq", folder, chunk=max(1000, n // 64))
    reader.drain()
    return reader.messages()


def feed_expired(spark, sf_dir: str) -> DataFrame:
    """A feed read from its start to a quarter; by the next poll changes up to a half have expired, so it goes on at the latest one then, three quarters."""
    changes, n, folder = _published(spark, sf_dir)
    part = lambda a, b: changes.where((F.col("seq") > n * a // 4) & (F.col("seq") <= n * b // 4))
    size = max(1000, n // 64)
    publish(part(0, 1), "seq", folder, chunk=size)
    reader = Subscription(spark, folder, CHANGES, start=0, pages=max(50, n // 25))
    reader.drain()
    publish(part(1, 3), "seq", folder, chunk=size)
    expire(folder, n // 2)
    reader.poll()
    publish(part(3, 4), "seq", folder, chunk=size)
    reader.drain()
    return reader.messages()


def retry_messages(events: DataFrame) -> DataFrame:
    """Events of a user as one message's fate: sign-ups bring it in, errors and views fail it, purchases finish it."""
    kind = F.create_map(*[F.lit(x) for x in ("signup", "received", "error", "failed", "view", "failed", "purchase", "done")])[F.col("event_type")]
    return events.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"))


def stream_retried(spark, sf_dir: str) -> DataFrame:
    """Attempts at each user's message with back-off from two hours on, given up after five or after five days without an outcome."""
    with streaming.with_timers(spark):
        return streaming.drained(retried(retry_messages(_events(spark, sf_dir)), 2 * 3_600_000, 5 * 86_400_000), "retried")


def stream_facts(spark, sf_dir: str) -> DataFrame:
    """Codes and stage of each user's job as documents come in, in update mode."""
    e = _events(spark, sf_dir)
    code = F.substring(hs("event_id"), 1, 2)
    docs = e.select(F.col("user_id").alias("job"), F.when(F.col("event_id") % 4 > 0, F.array(code, F.lit("39"))).alias("codes"), (F.col("event_id") % 7).cast("int").alias("stage_rank"))
    found = streaming.merged_updates(streaming.job_facts(docs), "facts", ["job"])
    return found.select("job", F.array_join("codes", ",").alias("codes"), "stage_rank")


def _lines(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    code = F.when(F.col("p_partkey") % 7 == 0, "x12").otherwise(F.substring(hs("p_partkey"), F.lit(1), (F.col("p_partkey") % 10).cast("int")))
    title = F.concat(F.lit('"'), F.regexp_replace("p_name", " ", ', ""q"" '), F.lit('"'))
    return p.select("p_partkey", F.concat_ws(",", code, F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("C"), F.col("p_partkey").cast("string"))).otherwise(""), title).alias("line"))


def _parsed(spark, sf_dir: str):
    rules = [("code digits", F.col("hs").rlike("^[0-9]{2,8}$")), ("no code", F.trim("code") != "")]
    return sources.csv_rows(_lines(spark, sf_dir), "line", "hs string, code string, title string", *rules)


def csv_accepted(spark, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)[0].select("p_partkey", "hs", "code", "title")


def csv_rejects(spark, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)[1].select("p_partkey", "reason")


def _files(spark, sf_dir: str) -> DataFrame:
    """Documents as files of requirements: some with a heading, blank records, one good record with the whole text in quotes, three bad ones, a last good one; all three kinds of line end."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    end = F.element_at(F.array(F.lit("\n"), F.lit("\r\n"), F.lit("\r")), (k % 3 + 1).cast("int"))
    quoted = F.concat(F.lit('" say ""x"", '), F.coalesce(F.replace("text", F.lit('"'), F.lit('""')), F.lit("")), F.lit(' "'))
    code = F.concat(F.lit("C"), k.cast("string"))
    first = F.concat(F.substring(hs("doc_id"), 1, 4), F.lit("."), F.substring(hs("doc_id"), 5, 2), F.lit(", "), code, F.lit(","), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit('"a ""title"", of "'), "source")), F.lit(","), quoted)
    lines = F.array(F.when(k % 4 > 0, "HS Code,Requirement Code,Title,Text"), F.lit(""), F.lit(' ,"", '), first, F.concat(F.lit("123456789,"), code, F.lit(",t,x")), F.lit("0101,,t,x"), F.concat(F.lit("0101,"), code, F.lit(",t")), F.concat(F.lit('"01""02",'), code, F.lit(',"un"qu"oted","open, ""'), "source"))
    return d.select("doc_id", F.array_join(lines, "\u0001").alias("t"), end.alias("e")).select("doc_id", F.replace("t", F.lit("\u0001"), F.col("e")).alias("text"))


def csv_imported(spark, sf_dir: str) -> DataFrame:
    rows = sources.requirement_rows(_files(spark, sf_dir), "doc_id", "text")[0]
    return rows.select("doc_id", "line", "hs", "code", "title", F.md5("requirement").alias("requirement"))


def csv_import_rejects(spark, sf_dir: str) -> DataFrame:
    return sources.requirement_rows(_files(spark, sf_dir), "doc_id", "text")[1]


_CSV = f"WITH c AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 THEN 'x12' ELSE left({HS_SQL.format('p_partkey')}, (p_partkey % 10)::INT) END AS hs FROM part), d AS (SELECT *, CASE WHEN NOT regexp_matches(hs, '^[0-9]{{2,8}}$') THEN 'code digits' WHEN p_partkey % 5 = 0 THEN 'no code' END AS reason FROM c)"
QUERIES = {f.__name__: f for f in (stream_unique, stream_tumbling, stream_attached, stream_expiring, stream_enriched, stream_matched, stream_facts, stream_retried, feed_read, feed_expired, csv_accepted, csv_rejects, csv_imported, csv_import_rejects)}
SQL = {
    "stream_unique": "SELECT DISTINCT user_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events",
    "stream_tumbling": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL",
    "stream_attached": "SELECT user_id, event_id, first_value(event_id) OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts, event_id) AS job FROM events",
    "stream_expiring": """WITH m AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us, coalesce(json_extract_string(props, '$.k'), '') AS i FROM events),
g AS (SELECT *, coalesce(us - lag(us) OVER w > 6 * 86400000000, true)::INT AS opens FROM m WINDOW w AS (PARTITION BY user_id, i ORDER BY us, event_id)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, i ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, event_id, first_value(event_id) OVER (PARTITION BY user_id, i, k ORDER BY us, event_id) AS job FROM n""",
    "stream_enriched": "SELECT c_mktsegment, event_type, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY ALL",
    "feed_read": "SELECT event_id + 1 AS seq, user_id, event_type, value FROM events WHERE event_type <> 'error' AND user_id % 9 <> 0 AND event_id + 1 > (SELECT count(*) // 4 FROM events)",
    "feed_expired": "WITH n AS (SELECT count(*) AS n FROM events) SELECT event_id + 1 AS seq, user_id, event_type, value FROM events, n WHERE event_type <> 'error' AND user_id % 9 <> 0 AND (event_id + 1 <= n // 4 OR event_id + 1 > n * 3 // 4)",
    "stream_facts": f"""WITH d AS (SELECT user_id AS job, event_id % 7 AS r, CASE WHEN event_id % 4 > 0 THEN [left({HS_SQL.format('event_id')}, 2), '39'] ELSE [NULL] END AS codes FROM events), u AS (SELECT job, r, unnest(codes) AS code FROM d)
SELECT job, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes, max(r)::INT AS stage_rank FROM u GROUP BY job""",
    "csv_accepted": f"""{_CSV} SELECT p_partkey, hs, 'C' || p_partkey AS code, replace(p_name, ' ', ', "q" ') AS title FROM d WHERE reason IS NULL""",
    "csv_rejects": f"{_CSV} SELECT p_partkey, reason FROM d WHERE reason IS NOT NULL",
    "csv_imported": f"""WITH d AS (SELECT *, (doc_id % 4 > 0)::INT AS h, {HS_SQL.format('doc_id')} AS c FROM documents)
SELECT doc_id, h + 1 AS line, left(c, 6) AS hs, 'C' || doc_id AS code, CASE WHEN doc_id % 2 = 0 THEN 'C' || doc_id ELSE 'a "title", of ' || source END AS title, md5(regexp_replace('say "x", ' || coalesce(text, ''), '\\s+$', '')) AS requirement FROM d
UNION ALL SELECT doc_id, h + 5, '0102', 'C' || doc_id, 'unquoted', md5('open, "' || source) FROM d""",
    "csv_import_rejects": "SELECT doc_id, k + (doc_id % 4 > 0)::INT AS line, raw, reason FROM documents, (VALUES (2, '123456789', 'not an HS code'), (3, '0101', 'no requirement code'), (4, '0101', 'no requirement text')) v(k, raw, reason)",
}
