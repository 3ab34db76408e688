"""Events as what happens to jobs, folded through their coupled machines, at once and in batches of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import streaming
from ..operators import machines as M
from ..storage import fresh_path
from .fixture import table

KINDS = [*dict.fromkeys([*M.FLAGS, *M.COUNTS, *(event for rules in (M.JOB, M.DELIVERY_ORDER, M.CLEARANCE) for event, _, _ in rules)])]
#: Jobs go mostly by this order of events; every fourth event is one from anywhere.
ORDER = [
    "documents_attached", "exported", "checklist_uploaded", "request_sent", "notice_sent", "bill_surrendered", "noted", "mode_known", "duty_differs", "free_days_known", "variance_resolved", "document_asked", "notice_sent",
    "document_done", "duty_paid", "proforma_checked", "deposit_made", "goods_registered", "payment_proof", "goods_examined", "do_number", "out_of_charge", "plan_approved", "goods_collected", "delivered", "deposit_settled", "final_invoice_paid", "do_closed",
]


def as_events(rows: DataFrame) -> DataFrame:
    """Events of a user as those of a job: the place in ``ORDER`` follows the day, so jobs get about as far as the month."""
    k = F.col("event_id")
    place = (F.dayofmonth("ts") + F.pmod(k, F.lit(3)) - 1) % len(ORDER) + 1
    usual = F.element_at(F.array(*map(F.lit, ORDER)), place.cast("int"))
    other = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(k * 7 + F.col("user_id"), F.lit(len(KINDS))) + 1).cast("int"))
    kind = F.when(k % 50 == 7, F.lit(None)).when(k % 4 == 0, other).otherwise(usual)
    return rows.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), k.alias("seq"), kind.alias("kind"), F.when(k % 5 == 0, "no").otherwise("agreed with the officer").alias("note"))


def coupled_machines(spark, sf_dir: str) -> DataFrame:
    """Where each job's machines stand after all events."""
    return M.folded(as_events(table(spark, sf_dir, "events"))).select(F.col("key").alias("job_key"), "state.*")


def coupled_machines_stream(spark, sf_dir: str) -> DataFrame:
    """The same by batches of a stream; each batch goes on from the states that the one before it wrote."""
    source = table(spark, sf_dir, "events")
    split = fresh_path(spark, "event-days")
    source.withColumn("week", F.floor(F.dayofmonth("ts") / 8)).repartition("week").sortWithinPartitions("week").write.partitionBy("week").parquet(split)
    target, checkpoint = fresh_path(spark, "machines"), fresh_path(spark, "machines-checkpoint")

    def step(batch: DataFrame, n: int) -> None:
        before = spark.read.parquet(f"{target}/batch={n - 1}") if n else None
        M.folded(as_events(batch), before).write.mode("overwrite").parquet(f"{target}/batch={n}")

    last = -1
    for week in range(4):  # a week's files come in after the last week's batch
        stream = streaming.source(spark, f"{split}/week={week}", source.schema)
        query = stream.writeStream.foreachBatch(lambda batch, _, n=week: step(batch, n)).option("checkpointLocation", f"{checkpoint}/{week}").trigger(availableNow=True).start()
        query.awaitTermination()
        last = week
    return spark.read.parquet(f"{target}/batch={last}").select(F.col("key").alias("job_key"), "state.*")


QUERIES = {f.__name__: f for f in (coupled_machines, coupled_machines_stream)}
SQL: dict[str, str] = {}
