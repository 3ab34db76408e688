"""Structured calls of a model: replies are checked, asked for again, handed to a larger model, and rejected in the end."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_path

#: What JSON values may stand for a field of each type.
JSON_TYPES = {"string": "^STRING$", "boolean": "^BOOLEAN$", "bigint": "^BIGINT$", "double": "^(BIGINT|DOUBLE|DECIMAL.*)$"}
#: Models of the attempts, in order: one retry, then the larger model.
ATTEMPTS = ("standard", "standard", "larger")


class ModelClient(Protocol):
    """Sent to the tasks, so it must pickle; opens its connections there."""

    def reply(self, model: str, prompts: list[str], attempt: int) -> list[str | None]:
        """One reply a prompt, in order; None where the model gave none."""
        ...


def _asked(prompts: DataFrame, client: ModelClient, model: str, attempt: int, size: int) -> DataFrame:
    """(id, prompt, reply), written once: what comes later must not call again."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                replies = client.reply(model, part.column("prompt").to_pylist(), attempt)
                if len(replies) != part.num_rows:
                    raise ValueError(f"{len(replies)} replies to {part.num_rows} prompts")
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("prompt"), pa.array(replies, pa.string())], ["id", "prompt", "reply"])

    path = fresh_path(prompts.sparkSession, "replies")
    prompts.mapInArrow(ask, "id string, prompt string, reply string").write.parquet(path)
    return prompts.sparkSession.read.parquet(path)


def fault(reply: Column, fields: dict[str, tuple[str, bool]]) -> Column:
    """What is wrong with a reply, null if nothing: none, no JSON, no object, or the first field that is missing, of another type, or null where it must not be."""
    whole = F.try_parse_json(reply)

    def bad(name: str, kind: str, nullable: bool) -> Column:
        found = F.schema_of_variant(F.try_variant_get(whole, f"$.{name}", "variant"))
        fits = found.rlike(JSON_TYPES[kind]) | (F.lit(nullable) & (found == "VOID"))
        return F.when(~F.coalesce(fits, F.lit(False)), f"field {name}")

    shape = F.when(reply.isNull(), "no reply").when(whole.isNull(), "no JSON").when(~F.schema_of_variant(whole).startswith("OBJECT"), "no object")
    return F.coalesce(shape, *[bad(name, *spec) for name, spec in fields.items()])


def answered(requests: DataFrame, key: str, prompt: str, client: ModelClient, fields: dict[str, tuple[str, bool]], *rules: tuple[str, Column], attempts: tuple[str, ...] = ATTEMPTS, size: int = 128) -> tuple[DataFrame, DataFrame]:
    """(answers, rejects): requests with ``answer`` (a struct of fields), ``model`` and ``attempt``; and those that failed each attempt, with the last ``reason`` and ``reply``.

    fields: name to (bigint, double, string or boolean; whether null is
    allowed). rules: what must hold of ``answer`` and ``prompt``, with the
    reason given if it doesn't. Equal prompts are asked once, whoever asks
    them; an empty prompt is asked like others, a null one is a reject.
    Replies are stored before they are checked, so no later action repeats a
    call; a task that is lost asks its own batch again.
    """
    shape = ", ".join(f"{name} {kind}" for name, (kind, _) in fields.items())
    marked = requests.withColumn("__id", F.sha2(F.col(prompt), 256))
    pending = marked.where("__id IS NOT NULL").groupBy(F.col("__id").alias("id")).agg(F.first(prompt).alias("prompt"))
    good, replies = None, None
    for number, model in enumerate(attempts, 1):
        replies = _asked(pending, client, model, number, size).withColumn("answer", F.from_json("reply", shape)).withColumn("reason", fault(F.col("reply"), fields))
        broken = [F.when(~F.coalesce(holds, F.lit(False)), reason) for reason, holds in rules]
        replies = replies.withColumn("reason", F.coalesce("reason", *broken))
        kept = replies.where("reason IS NULL").select("id", "answer", F.lit(model).alias("model"), F.lit(number).alias("attempt"))
        good = kept if good is None else good.unionByName(kept)
        pending = replies.where("reason IS NOT NULL").select("id", "prompt")
    answers = marked.join(good, F.col("__id") == F.col("id")).drop("__id", "id")
    failed = replies.where("reason IS NOT NULL").select(F.col("id").alias("__id"), "reason", "reply")
    lost = marked.join(failed, "__id").unionByName(marked.where("__id IS NULL").withColumn("reason", F.lit("no prompt")).withColumn("reply", F.lit(None).cast("string")))
    return answers, lost.select(key, "reason", "reply")


class WordChoice:
    """A client without a model: of numbered lines ``[n] rate: words`` the one that shares most words with the line ``Goods ...``, the first of equal ones, null if none shares any."""

    def reply(self, model: str, prompts: list[str], attempt: int) -> list[str | None]:
        return [self.choice(p) for p in prompts]

    def choice(self, prompt: str) -> str:
        lines = prompt.split("\n")
        goods = {w for line in lines if line.startswith("Goods ") for w in line.split()[1:]}
        listed = [line.partition(": ")[2].split() for line in lines if line.startswith("[")]
        shared = [len(goods & set(words)) for words in listed]
        best = shared.index(max(shared)) if any(shared) else None
        index = "null" if best is None else str(best)
        return f'{{"index": {index}, "reason": "{0 if best is None else shared[best]} words shared"}}'
