"""Exact vectors of single operators on small tables."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from mnemospark.config import ActivationConfig, MetamemoryConfig
from mnemospark.functions import maths as M
from mnemospark.functions import text as X
from mnemospark.operators import activation as A
from mnemospark.operators import episodes as E
from mnemospark.operators import facts as K
from mnemospark.operators import forgetting as G
from mnemospark.operators import ingest as N
from mnemospark.operators import learning as L
from mnemospark.operators import metamemory as Q
from mnemospark.operators import ranking as R
from mnemospark.operators import reconcile as C
from mnemospark.operators import spreading as S
from mnemospark.sources import incremental as I
from mnemospark.sources import store as T

T0 = dt.datetime(2026, 8, 7, 10, 0, 0)
UNIT = ActivationConfig(unit_seconds=1.0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("ages,want", [([1], 0.0), ([16], math.log(16**-0.5)), ([4, 4, 4, 4], math.log(2))])
@pytest.mark.parametrize("f", [A.base_level, A.base_level_sum])
def test_base_level(spark, ages, want, f):
    df = spark.createDataFrame([("m", at(100 - a)) for a in ages], "k string, at timestamp")
    assert f(df, ["k"], "at", F.lit(at(100)), cfg=UNIT).first()["base_level"] == pytest.approx(want)


def test_base_level_of_the_future_is_an_error(spark):
    df = spark.createDataFrame([("m", at(200))], "k string, at timestamp")
    with pytest.raises(Exception, match="later than the evaluation"):
        A.base_level_sum(df, ["k"], "at", F.lit(at(100))).collect()


def test_gap_of_exactly_half_an_hour_stays(spark):
    df = spark.createDataFrame([(1, "s", at(0), False, False), (2, "s", at(1800), False, False), (3, "s", at(3601), False, True), (4, "s", at(3602), False, False), (5, "s", at(3603), True, False)], "id long, s string, at timestamp, b boolean, t boolean")
    rows = {r["id"]: (r["session"], r["sequence_number"]) for r in E.sessionise(df, ["s"], "at", "id", 1800.0, "b", "t").collect()}
    assert rows == {1: (0, 0), 2: (0, 1), 3: (1, 0), 4: (2, 0), 5: (3, 0)}


def test_statement_and_salience(spark):
    df = spark.createDataFrame([("s", 0, 1, at(0), "a", 0.5, False, "x"), ("s", 0, 2, at(1), "a", 0.5, True, "x"), ("s", 0, 3, at(2), "b", 0.5, False, "x")], "k string, session int, id long, at timestamp, content string, att double, t boolean, kind string").withColumn("sequence_number", F.col("id").cast("int") - 1)
    r = E.rollup(df, ["k"], "id", "at", "content", "att", "t", "kind").first()
    assert r["statement"] == "a\nb" and r["importance"] == pytest.approx(0.45) and r["confidence"] == 1.0 and len(r["evidence"]) == 3
    empty = E.rollup(df.withColumn("content", F.lit(None).cast("string")).where("id = 1"), ["k"], "id", "at", "content", "att", "t", "kind").first()
    assert empty["statement"] == "Episode containing 1 x observation from direct."


def test_interval_relation(spark):
    df = spark.createDataFrame([(None, at(1), at(1), None), (None, None, None, None), (None, None, at(1), None), (at(0), at(2), at(1), at(3)), (at(2), None, at(0), at(2))], "a timestamp, b timestamp, c timestamp, d timestamp")
    assert [r[0] for r in df.select(M.interval_relation(*(F.col(x) for x in "abcd"))).collect()] == ["before", "unknown", "overlaps", "overlaps", "after"]


def candidate(obj, start, end, n=2):
    return ("slot", f"m-{obj}", obj, "one", start, end, n, float(n), 0.5, 1)


SCHEMA = "slot_key string, memory_key string, object_value string, cardinality string, valid_from timestamp, valid_until timestamp, support_count long, support_mass double, importance double, namespaces long"


def test_reconcile_supersedes_and_returns(spark):
    df = spark.createDataFrame([candidate("A", at(0), at(1)), candidate("B", at(1), at(2)), candidate("A", at(2), None)], SCHEMA)
    rows = C.reconcile(df).orderBy("valid_from").collect()
    assert [(r["object_value"], r["status"], r["revision_number"]) for r in rows] == [("A", "superseded", 1), ("B", "superseded", 1), ("A", "active", 2)]
    now = C.current_projection(C.reconcile(df), ["memory_key"])
    assert {r["memory_key"]: r["status"] for r in now.collect()} == {"m-A": "active", "m-B": "superseded"}


def test_reconcile_conflict(spark):
    rows = C.reconcile(spark.createDataFrame([candidate("A", None, None), candidate("B", None, None)], SCHEMA)).collect()
    assert {r["status"] for r in rows} == {"contested"} and all(r["contradiction_count"] == 1 for r in rows)


def test_consolidation_needs_two_episodes(spark):
    cols = "episode_id string, namespace string, slot_key string, claim_key string, fact_confidence double, episode_confidence double, importance double, observed_at timestamp, valid_from timestamp, valid_until timestamp"
    one = ("e1", "n", "s", "c", 0.9, 0.9, 0.7, T0, None, None)
    assert K.consolidate(spark.createDataFrame([one], cols)).count() == 0
    r = K.consolidate(spark.createDataFrame([one, ("e2", *one[1:])], cols)).first()
    assert r["support_mass"] == pytest.approx(1.377) and r["confidence"] == pytest.approx(0.540615, abs=1e-5)


def test_facts_are_parsed_and_bad_ones_counted(spark):
    texts = ['[{"predicate":"p","object_value":"o"}]', '{"predicate":"p","object_value":"o","polarity":"deny","valid_from":"2026-01-01T00:00:00Z"}', '[{"predicate":"","object_value":"o"},{"predicate":"p","object_value":"o","cardinality":"few"},{"predicate":"p","object_value":"o","valid_from":"2026-01-01T00:00:00"}]', "not json", None]
    rows = K.extract(spark.createDataFrame([(t, "s") for t in texts], "facts string, subject string"), "facts", "subject").collect()
    assert sorted(r["failed"] for r in rows)[:2] == [False, False] and sum(r["failed"] for r in rows) >= 3


def test_spreading(spark):
    edges = spark.createDataFrame([("a", "alice"), ("a", "kura"), ("b", "kura"), ("b", "pg")], "memory string, entity string")
    got = {r["memory"]: (r["spreading"], r["hop"]) for r in S.spread(edges, spark.createDataFrame([(1, "alice")], "cue_id int, entity string")).collect()}
    assert got["a"] == (1.0, 1) and got["b"] == (0.25, 2)
    fan = spark.createDataFrame([("r", "rare")] + [(f"c{i}", "common") for i in range(10)], "memory string, entity string")
    cues = spark.createDataFrame([(1, "rare"), (2, "common")], "cue_id int, entity string")
    top = {r["cue_id"]: r["spreading"] for r in S.spread(fan, cues).collect()}
    assert top == {1: 1.0, 2: pytest.approx(0.1)}


def test_greedy_collapse(spark):
    rows = [(1, 1, 10, "x", ["a", "b", "c", "d"]), (1, 2, 11, "y", ["a", "b", "c", "d", "7"]), (1, 3, 12, "x", ["z"]), (1, 4, 13, "w", ["q"])]
    df = spark.createDataFrame(rows, "cue_id int, rank int, key long, fingerprint string, tokens array<string>")
    assert [r["key"] for r in R.collapse(df, "cue_id", "rank", 2).orderBy("place").collect()] == [10, 13]


def test_working_memory_budget_and_inhibition(spark):
    rows = [(1, "episode", "a", 0.9, 1.0, 40, ["x", "y"]), (1, "episode", "b", 0.85, 1.0, 40, ["x", "y"]), (1, "episode", "c", 0.7, 1.0, 40, ["p"]), (1, "episode", "d", 0.6, 1.0, 5000, ["r"])]
    df = spark.createDataFrame(rows, "cue_id int, kind string, key string, adjusted double, activation double, n_tokens long, tokens array<string>")
    assert [r["key"] for r in R.select_working_memory(df, "cue_id").orderBy("place").collect()] == ["a", "c", "b"]


def test_compaction_keeps_the_level(spark):
    log = spark.createDataFrame([("m", at(3600 * h), 1) for h in (1, 5, 9, 14, 20)], "k string, at timestamp, w long")
    now = F.lit(at(48 * 3600))
    before = A.base_level_sum(log, ["k"], "at", now, "w").first()["base_level"]
    small = G.compact(log, ["k"], "at", "w", now, now)
    after = A.base_level_sum(small, ["k"], "at", now, "w").first()["base_level"]
    assert small.agg(F.sum("w")).first()[0] == 5 and small.count() == 2 and after == pytest.approx(before, rel=0.05)
    same = spark.createDataFrame([("m", at(0), 1)] * 5, "k string, at timestamp, w long")
    assert A.base_level_sum(G.compact(same, ["k"], "at", "w", now, now), ["k"], "at", now, "w", UNIT).first()["base_level"] == pytest.approx(A.base_level_sum(same, ["k"], "at", now, "w", UNIT).first()["base_level"], abs=1e-6)


def test_forgetting_states(spark):
    rows = [("a", 0.3, "fading", None, None), ("b", 0.1, None, None, None), ("c", 0.01, "fading", at(0), None), ("d", 0.01, None, None, None)]
    df = spark.createDataFrame(rows, "k string, s double, prev_state string, prev_since timestamp, prev_forgotten_at timestamp")
    got = {r["k"]: (r["state"], r["reactivated"]) for r in G.transitions(df, "s", F.lit(at(700_000)), F.lit(False)).collect()}
    assert got == {"a": ("active", True), "b": ("fading", False), "c": ("forgotten", False), "d": ("fading", False)}


def test_learning(spark):
    df = spark.createDataFrame([(0, 0, 0), (3, 1, 1)], "h int, u int, i int")
    assert [r[0] for r in df.select(L.utility(F.col("h"), F.col("u"), F.col("i"))).collect()] == [0.5, pytest.approx(4 / 7)]
    n = spark.createDataFrame([(1,), (2,)], "n int").select(L.association_strength(F.col("n"))).collect()
    assert n[0][0] == 0 and n[1][0] == pytest.approx(0.486583, abs=1e-6)
    stored = spark.createDataFrame([("f1", "p")], "feedback_id string, fingerprint string")
    assert L.new_events(spark.createDataFrame([("f1", "p"), ("f2", "q")], stored.schema), stored).count() == 1
    with pytest.raises(Exception, match="other feedback"):
        L.new_events(spark.createDataFrame([("f1", "z")], stored.schema), stored).collect()


def test_metamemory(spark):
    df = spark.createDataFrame([(1,), (2,), (4,)], "n int")
    assert [round(r[0], 6) for r in df.select(Q.diversity(F.col("n"))).collect()] == [0.0, 0.283469, 0.632121]
    fresh = spark.range(1).select(Q.freshness(F.lit(60.0), MetamemoryConfig(half_life_seconds=60.0))).first()[0]
    assert fresh == pytest.approx(0.5)


def test_text(spark):
    df = spark.createDataFrame([("Straße  Été ", 1), ("  Plain   TEXT ", 2), (None, 3)], "s string, i int")
    assert [r[0] for r in df.orderBy("i").select(X.canonical_text(F.col("s"))).collect()] == ["strasse été", "plain text", None]
    assert [r[0] for r in df.orderBy("i").select(X.token_estimate(F.col("s"))).collect()] == [4, 4, 0]
    empty = F.array().cast("array<string>")
    assert spark.range(1).select(X.jaccard(empty, empty), X.jaccard(empty, F.array(F.lit("a")))).first()[:] == (1.0, 0.0)


def test_policy_and_retention(spark):
    df = spark.createDataFrame([("  a ", False), ("abc ", False), (None, True)], "content string, is_deleted boolean")
    rows = N.policy(df).collect()
    assert [(r["accepted"], r["policy_reason"]) for r in rows] == [(False, "content_too_short"), (True, None), (True, "deletion_event")]
    assert N.retain(df, "hash_only").where("content is not null").count() == 0
    with pytest.raises(ValueError):
        N.retain(df, "redacted")


def test_store(spark, tmp_path):
    schema = "k int, fp string, v string"
    old, new = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], schema), spark.createDataFrame([(1, "a", "y"), (2, "c", "y"), (3, "d", "y")], schema)
    got = {r["k"]: (r["status"], r["v"]) for r in T.keyed_upsert(old, new, ["k"], "fp").collect()}
    assert got == {1: ("unchanged", "x"), 2: ("updated", "y"), 3: ("created", "y")}
    store = T.SnapshotStore(spark, f"file://{tmp_path}")
    assert store.read("t") is None
    store.write("t", old)
    store.write("t", T.keyed_upsert(store.read("t"), new, ["k"], "fp").drop("status"))
    assert store.read("t").count() == 3


def test_revision_sequence(spark):
    rows = [(1, "v1", "a", False), (2, "v1", "a", False), (3, "v2", "b", False), (4, "v2", "b", True), (5, "v3", "b", False)]
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, o int, v string, c string, d boolean")
    got = [(r["change_type"], r["revision_number"]) for r in T.revision_history(df, ["k"], ["o"], "v", "c", "d").orderBy("o").collect()]
    assert got == [("created", 1), ("updated", 2), ("deleted", 3), ("restored", 4)]


def test_incremental_scan(spark):
    df = spark.createDataFrame([(1, at(0)), (2, at(0)), (3, at(1))], "id int, ts timestamp")
    assert [r["id"] for r in I.incremental_scan(df, ("ts", "id"), (F.lit(at(0)), 1)).orderBy("id").collect()] == [2, 3]
    assert I.checkpoint_of(df, ("ts", "id")).first()["id"] == 3
    with pytest.raises(ValueError):
        I.guard_identifier("a; drop")
