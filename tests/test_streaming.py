"""Streams with state against folds in plain Python."""

import json
import os

import pandas as pd

from tariffloom import streaming
from tariffloom.operators.matching import NEEDED, STRONG, WEIGHTS
from tariffloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def fold(messages):
    """messages: (company, message, ids, recognised) in order."""
    owner, out = {}, {}
    for company, message, ids, recognised in messages:
        own = {i: owner[company, i] for i in ids if (company, i) in owner}
        score = {}
        for i, job in own.items():
            score[job] = score.get(job, 0) + WEIGHTS[i.split(":")[0]]
        top = max(score.values(), default=0)
        best = [j for j in score if score[j] == top]
        threads = {job for i, job in own.items() if i.startswith("conversation:")}
        strong = any(i.split(":")[0] in STRONG for i in ids)
        job = None
        if top >= NEEDED:
            if len(best) > 1:
                out[message] = ("ambiguous", None, top)
                continue
            job = best[0]
        elif len(threads) == 1 and not strong:
            job = min(threads)
        if job is None and recognised == 0:
            out[message] = ("skipped", None, top)
            continue
        out[message] = ("attached", job, top) if job is not None else ("created", message, top)
        for i in ids:
            owner.setdefault((company, i), out[message][1])
    return out


def rows_of(frame):
    return {r.message: (r.outcome, r.job, r.score) for r in frame.collect()}


def test_matched_over_the_fixture(spark):
    kinds = list(WEIGHTS)
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "ts", "props").toPandas().sort_values(["ts", "event_id"])
    messages = []
    for u, e, p in zip(events.user_id, events.event_id, events.props, strict=True):
        k = json.loads(p)["k"]
        messages.append((u, e, sorted({f"{kinds[(e + s) % 6]}:V{k % m}" for s, m in ((0, 5), (1, 3), (3, 4))}), e % 3))
    found = rows_of(QUERIES["stream_matched"](spark, SF))
    assert found == fold(messages)
    assert {v[0] for v in found.values()} == {"created", "attached", "ambiguous", "skipped"}


def files(folder, frames):
    folder.mkdir()
    for n, frame in enumerate(frames):
        frame.astype({"recognised": "Int64"} if "recognised" in frame else {}).to_parquet(folder / f"{n}.parquet")
        os.utime(folder / f"{n}.parquet", (1_700_000_000 + n * 60,) * 2)
    return str(folder)


def test_matched_keeps_its_state_between_batches(spark, tmp_path):
    of = lambda m, c, ids, n=1: {"company": c, "message": m, "ts": m, "identifiers": ids, "recognised": n}
    frames = [pd.DataFrame([of(1, 7, ["bl:A", "po:1"]), of(2, 7, ["bl:B"])]), pd.DataFrame([of(3, 7, ["bl:A", "conversation:t"]), of(4, 8, ["bl:A"])]), pd.DataFrame([of(5, 7, ["bl:A", "bl:B"]), of(6, 7, ["conversation:t"], 0), of(7, 7, None, None)])]
    path = files(tmp_path / "in", frames)
    stream = streaming.source(spark, path, "company long, message long, ts long, identifiers array<string>, recognised long", 1)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    found = rows_of(streaming.matched(stream, "batches"))
    assert spark.conf.get(store, None) == before
    assert found == {1: ("created", 1, 0), 2: ("created", 2, 0), 3: ("attached", 1, 5), 4: ("created", 4, 0), 5: ("ambiguous", None, 5), 6: ("attached", 1, 3), 7: ("skipped", None, 0)}


def test_updates_of_all_batches_count(spark, tmp_path):
    frames = [pd.DataFrame({"job": [1, 2], "codes": [["39"], ["84"]], "stage_rank": [3, 0]}), pd.DataFrame({"job": [1, 3], "codes": [["29", "39"], []], "stage_rank": [1, 1]})]
    path = files(tmp_path / "in", frames)
    stream = streaming.source(spark, path, "job long, codes array<string>, stage_rank long", 1)
    found = streaming.merged_updates(streaming.job_facts(stream), "facts", ["job"])
    assert {r.job: (r.codes, r.stage_rank) for r in found.collect()} == {1: (["29", "39"], 3), 2: (["84"], 0), 3: ([], 1)}


def test_a_batch_asks_for_each_identifier_once():
    calls = []

    class Store:
        def __init__(self):
            self.rows = {(7, "bl:A"): (1,)}

        def exists(self):
            return True

        def getValue(self, one):  # noqa: N802
            calls.append(one)
            return self.rows.get(one)

        def updateValue(self, one, value):  # noqa: N802
            calls.append(one)
            self.rows[one] = value

    matcher = streaming._Matcher()
    matcher.owners = Store()
    batch = pd.DataFrame({"company": 7, "message": range(2, 102), "ts": range(100), "identifiers": [["bl:A", "po:1"]] * 100, "recognised": 1})
    out = pd.concat(matcher.handleInputRows((3,), iter([batch]), None))
    assert set(out.job) == {1} and len(out) == 100
    assert sorted(calls) == [(7, "bl:A"), (7, "po:1"), (7, "po:1")]  # 401 calls before
