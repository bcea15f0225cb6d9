"""The facade and the streams, end to end on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemospark.session import OBSERVATION, Memory
from mnemospark.sources.store import SnapshotStore
from mnemospark.streaming.ingest import ingest_stream, sessions_stream

T0 = dt.datetime(2026, 8, 7, 10, 0, 0)
FACT = '[{"predicate":"preferred_database","object_value":"postgresql","cardinality":"one"}]'


def rows(n=4):
    return [("t", "s", "chat", f"m{i}", "1", "message", f"PostgreSQL incident number {i} resolved", T0 + dt.timedelta(hours=i), False, None, None, FACT, False, False) for i in range(n)]


def test_process_recall_and_feedback(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}")
    df = spark.createDataFrame(rows() + [("t", "s", "chat", "short", "1", "message", "x", T0, False, None, None, None, False, False)], OBSERVATION)
    assert {k: v for k, v in m.ingest(df, "t").items() if v} == {"discovered": 4, "created": 4, "rejected": 1}
    assert m.ingest(df, "t")["unchanged"] == 4
    m.process()
    assert m.store.read("episodes").count() == 4
    assert [r["object_value"] for r in m.store.read("revisions").collect()] == ["postgresql"]
    now = T0 + dt.timedelta(days=1)
    cues = spark.createDataFrame([(1, "t", "postgresql incident"), (2, "other", "postgresql")], "cue_id int, tenant_id string, text string")
    got = m.recall(cues, now).collect()
    assert {r["cue_id"] for r in got} == {1} and len(got) == 2 and got[0]["score"] > 0 and "eligibility=" in got[0]["reason"]
    asked = spark.createDataFrame([(1, "t", "Preferred_Database", "postgresql")], "cue_id int, tenant_id string, predicate string, object_value string")
    found = {r["kind"]: r for r in m.recall(asked, now).collect()}
    assert found["semantic"]["rank"] == 1 and found["semantic"]["slot_fit"] == found["episode"]["slot_fit"] == 1.0
    assert {r["eligibility"] for r in found.values()} == {"semantic_slot_admission"} and len(found["episode"]["provenance"]) == 1
    other = spark.createDataFrame([(1, "t", "Preferred_Database", "mysql", "nobody")], "cue_id int, tenant_id string, predicate string, object_value string, subject_id string")
    assert m.recall(other, now).count() == 0
    text, assessment = m.prepare_context(cues, now)
    assert text.first()["text"].startswith("Relevant memory:\n\n- ") and "flags" in assessment.columns
    m.record_access(m.recall(cues, now, 1), now, "r1")
    assert m.record_access(m.recall(cues, now, 1), now, "r1").count() == 1
    key = got[0]
    fb = spark.createDataFrame([("f", "t", key["kind"], key["key"], "helpful")], "feedback_id string, tenant_id string, kind string, key string, outcome string")
    assert m.learn(fb).first()["utility"] > 0.5 and m.learn(fb).first()["helpful"] == 1
    assert m.apply_forgetting(now + dt.timedelta(days=1)).count() == 5
    with pytest.raises(ValueError, match="unknown memory"):
        m.learn(spark.createDataFrame([("g", "t", "episode", "none", "helpful")], "feedback_id string, tenant_id string, kind string, key string, outcome string"))
    assert m.list_episodes("t", limit=2).count() == 2 and m.list_semantic_memories("t", statuses=["active"]).count() == 1 and m.list_semantic_revisions("t").count() == 1
    assert m.list_learning_state("t").first()["helpful"] == 1 and m.list_observations("t", "s").count() == 4
    assert m.sleep(now + dt.timedelta(days=2))["active"] == 5
    m.clear("t")
    assert all(m.store.read(x).count() == 0 for x in ("observations", "episodes", "revisions", "derivations", "traces", "dynamics", "feedback"))


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([(1, "a", 1, T0), (1, "b", 2, T0 + dt.timedelta(hours=2)), (2, "a", 1, T0)], "k int, fp string, o int, at timestamp")
    df.write.parquet(src)
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema(df.schema).parquet(src)
    ingest_stream(stream, store, "t", ["k"], "fp", f"{tmp_path}/cp", "o").trigger(availableNow=True).start().awaitTermination()
    assert {r["k"]: r["fp"] for r in store.read("t").collect()} == {1: "b", 2: "a"}
    q = sessions_stream(stream, "k", "at", late="0 seconds").writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sessions").agg(F.count(F.lit(1))).first()[0] == 3
