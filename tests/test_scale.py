"""Steps whose work must not outgrow their input: the same results as brute force, and no shuffle of what they make."""

from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemospark.config import ActivationConfig
from mnemospark.operators import activation as A
from mnemospark.operators import learning as L
from mnemospark.operators import reconcile as C
from mnemospark.operators import spreading as S
from mnemospark.operators import textfit as X


def above(df, node):
    """The part of the plan above ``node``, which must be there."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert node in plan
    return plan.split(node)[0]


def texts(n_docs, n_cues, seed=1):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.5)) % 400}" for _ in range(5000)]
    docs = [(i, i % 3, sorted(set(r.sample(words, r.randint(0, 40))))) for i in range(n_docs)]
    cues = [(f"c{i}", i % 3, [1.0, 1.5][i % 2], sorted({*r.sample(words, r.randint(1, 12)), "never"})) for i in range(n_cues)]
    return docs, cues


def fit_of(docs, cues):
    """Coverage, f1 and token_f1 of all pairs of one tenant that share a token."""
    out = {}
    for tenant in {d[1] for d in docs}:
        mine = [set(t) for _, x, t in docs if x == tenant]
        idf = lambda t: math.log((len(mine) + 1) / (sum(t in m for m in mine) + 1)) + 1  # noqa: B023, E731
        known = {t: idf(t) for m in mine for t in m}
        for c, x, scale, cue in cues:
            for d, y, doc in docs:
                both = set(cue) & set(doc)
                if x == y == tenant and both:
                    cover, share = sum(known[t] for t in both) * scale / (sum(known.get(t, 1.0) for t in cue) * scale), sum(known[t] for t in both) / sum(known[t] for t in doc)
                    precision = share
                    out[c, d] = (cover, 2 * cover * precision / (cover + precision), 2 * len(both) / (len(cue) + len(doc)))
    return out


def tables(spark, docs, cues):
    d = spark.createDataFrame(docs, "doc long, tenant int, tokens array<string>")
    return d, spark.createDataFrame(cues, "cue_id string, tenant int, scale double, tokens array<string>"), A.idf_by(d, "tokens", ["tenant"])


def test_text_pairs_equal_brute_force_in_small_turns(spark, monkeypatch):
    docs, cues = texts(150, 40)
    want = fit_of(docs, cues)
    for name, value in (("CUE_ROWS", 100), ("CELLS", 200), ("TRIPLES", 500), ("FREQUENT", 20)):
        monkeypatch.setattr(X, name, value)
    d, c, w = tables(spark, docs, cues)
    got = {(r["cue_id"], r["doc"]): (r["coverage"], r["f1"], r["token_f1"]) for r in X.text_pairs(d, "doc", "tokens", c, w, ["tenant"]).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_first_leaves_the_best_of_each_cue(spark, monkeypatch):
    docs, cues = texts(200, 10, seed=2)
    docs, cues = [(i, 0, t) for i, _, t in docs], [(c, 0, 1.0, t) for c, _, _, t in cues]
    monkeypatch.setattr(X, "CELLS", 300)
    d, c, w = tables(spark, docs, cues)
    d = d.withColumn("lift", -(F.col("doc") % 7) / 10.0)
    made = X.text_pairs(d, "doc", "tokens", c, w, ["tenant"], ["lift"], X.First(4, "lift", -0.3)).collect()
    every = fit_of(docs, cues)
    for cue in {c for c, _ in every}:
        rank = lambda rows: sorted(rows, key=lambda x: (-x[0], x[1]))[:4]
        want = rank([(round(f - (d % 7) / 10, 9), d) for (c, d), (cover, f, _) in every.items() if c == cue and cover - (d % 7) / 10 >= -0.3])
        assert want == rank([(round(r["f1"] + r["lift"], 9), r["doc"]) for r in made if r["cue_id"] == cue and r["coverage"] + r["lift"] >= -0.3])
    assert len(made) < len(every)


def test_pairs_of_text_are_not_shuffled(spark):
    d, c, w = tables(spark, *texts(30, 5))
    assert "Exchange" not in above(A.weighted_text_fit(d, "doc", "tokens", c, w, ["tenant"]), "MapInArrow")


def test_cue_relevance_reads_no_text_again(spark):
    from mnemospark.plans import catalog

    top = above(catalog.queries()["cue_relevance"](spark, "/root/testdata/sf0.001"), "MapInArrow")
    assert "Exchange" not in top and "Join" not in top


def graph(seed, memories=60, entities=25):
    r = random.Random(seed)
    rows = [(m, e) for m in range(memories) for e in r.choices(range(entities), k=r.randint(1, 6))]
    return rows, [(c, e) for c in range(5) for e in r.sample(range(entities), 3)]


def links_of(rows, tau):
    """(memory, other): strength, by the number of pairs of rows with one item."""
    n = {}
    for m, e in rows:
        for k, f in rows:
            if e == f and m != k:
                n[m, k] = n.get((m, k), 0) + 1
    return {p: 1 - math.exp(-x / tau) for p, x in n.items()}


def spread_of(rows, sources, cfg, links):
    edges, out = set(rows), {}
    for cue in {c for c, _ in sources}:
        mine = {e for c, e in sources if c == cue}
        frontier, seen, total, hops = {e: 1 / len(mine) for e in mine}, set(), {}, {}
        for hop in range(1, cfg.hops + 1):
            got = {}
            for e, a in frontier.items():
                held = [m for m, x in edges if x == e]
                if held and a >= cfg.least_activation and a / len(held) >= cfg.least_activation:
                    for m in held:
                        got[m] = got.get(m, 0) + a / len(held)
            part = list(got.items())
            for (m, k), s in links.items():
                if m in got and (e := got[m] * cfg.spread_decay * cfg.learned_scale * s) >= cfg.least_activation:
                    part.append((k, e))
            for m, g in part:
                total[m] = total.get(m, 0) + g
                hops.setdefault(m, hop)
            passed = {}
            for m in set(got) - seen:
                own = [x for k, x in edges if k == m]
                p = got[m] * cfg.spread_decay / max(1, len(own) - 1)
                for e in own:
                    if e not in frontier and p >= cfg.least_activation:
                        passed[e] = passed.get(e, 0) + p
            seen |= set(got)
            frontier = passed
        out |= {(cue, m): (min(1.0, g), hops[m]) for m, g in total.items()}
    return out


@pytest.mark.parametrize("least,linked,hops", [(0.001, False, 2), (0.01, False, 2), (0.002, True, 1), (0.02, True, 1), (0.004, True, 2), (0.004, False, 3)])
@pytest.mark.parametrize("few", [1, 64])
def test_spreading_equals_brute_force(spark, monkeypatch, least, linked, hops, few):
    monkeypatch.setattr(S, "MANY_CUES", few)
    rows, sources = graph(hops)
    cfg = ActivationConfig(hops=hops, least_activation=least)
    links = L.Linked(spark.createDataFrame(rows, "memory long, item long"), 3.0) if linked else None
    got = S.spread(spark.createDataFrame(rows, "memory long, entity long").distinct(), spark.createDataFrame(sources, "cue_id int, entity long"), cfg, links, 3)
    got = {(r["cue_id"], r["memory"]): (r["spreading"], r["hop"]) for r in got.collect()}
    want = spread_of(rows, sources, cfg, links_of(rows, 3.0) if linked else {})
    assert got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(want[k][0]), want[k][1]) for k in want)


@pytest.mark.parametrize("limits", [(4096, 32_000_000, 2_000_000), (3, 200, 50), (1, 1, 1)])
def test_packed_lists_count_each_pair(monkeypatch, limits):
    for name, value in zip(("MEMBERS", "BYTES", "VALUES"), limits):
        monkeypatch.setattr(L, name, value)
    rows = [(m * 10**9 * (m % 3) + m, e) for m, e in graph(7)[0]]
    members = [sorted((m, m % 3) for m, f in rows if f == e) for e in range(25)]
    lists = pa.RecordBatch.from_pydict({"memories": pa.array([[m for m, _ in x] for x in members], pa.list_(pa.int64())), "needs": pa.array([[n for _, n in x] for x in members], pa.list_(pa.int64()))})
    packed = pa.Table.from_batches(L._pack(iter([lists.slice(0, 9), lists.slice(9)]))).sort_by("memory").combine_chunks()
    counted = [r for b in L._count(iter(packed.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    got = {(r["memory"], k): r["n"] for r in counted for k in r["to"]}
    want = {p: round(-3 * math.log(1 - s)) for p, s in links_of(rows, 3.0).items()}
    assert got == {(m, k): n for (m, k), n in want.items() if n >= m % 3 > 0}
    assert sum(len(r["to"]) for r in counted) == len(got)


def test_links_are_never_a_table_of_pairs(spark):
    from mnemospark.plans import catalog

    plan = catalog.queries()["learned_spread"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" in plan and not [x for x in plan.splitlines() if "Join" in x and "<" in x]


def test_what_memories_pass_on_travels_as_lists(spark):
    from mnemospark.plans import catalog

    plan = catalog.queries()["spread_2hop"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "inline(held" in plan


def test_coactivation_moves_pairs_before_they_are_grouped(spark):
    df = spark.createDataFrame([(e, k) for e in range(20) for k in range(e % 12)] * 2, "e long, k long")
    pairs = L.coactivation_pairs(df, "e", "k", parts=3)
    lines = pairs._jdf.queryExecution().executedPlan().toString().splitlines()
    grouped = [i for i, x in enumerate(lines) if "partial_count" in x]
    assert grouped and max(grouped) < min(i for i, x in enumerate(lines) if "Exchange" in x)
    want = {}
    for e in range(20):
        for a in range(min(8, e % 12)):
            for b in range(a + 1, min(8, e % 12)):
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r["left"], r["right"]): r["n"] for r in pairs.collect()} == want


@pytest.mark.parametrize("rows_in_batch", [1, 7, 1000])
def test_slots_are_folded_many_at_once(rows_in_batch):
    r = random.Random(3)
    stamp = pa.timestamp("us", "UTC")
    times = [None, 0, 10**6, 2 * 10**6, 3 * 10**6]
    rows = [{"slot_key": f"s{s:02}", "memory_key": f"m{s}-{r.randint(0, 2)}", "revision_key": f"r{s}-{i % 5}", "object_value": "o", "cardinality": r.choice(["one", "many"]), "valid_from": r.choice(times), "valid_until": r.choice(times), "support_count": r.randint(1, 3), "support_mass": 1.0, "importance": 0.5, "namespaces": 1} for s in range(40) for i in range(r.randint(1, 9))]
    names = [x.split()[0] for x in C.REVISION.split(", ")]
    columns = {n: pa.array([x[n] for x in rows], pa.int64()).cast(stamp) if n.startswith("valid") else pa.array([x[n] for x in rows]) for n in rows[0]}
    out = list(C._fold_slots(names)(iter(pa.Table.from_pydict(columns).to_batches(max_chunksize=rows_in_batch))))
    got = [x for b in out for x in b.set_column(names.index("valid_from"), "valid_from", b["valid_from"].cast(pa.int64())).set_column(names.index("valid_until"), "valid_until", b["valid_until"].cast(pa.int64())).to_pylist()]
    want = [{n: x[n] for n in names} for s in range(40) for x in C.fold([y for y in rows if y["slot_key"] == f"s{s:02}"])]
    assert got == want and len(out) <= len(rows) // rows_in_batch + 2


def test_a_revision_at_the_epoch_ends_the_one_before():
    base = {"slot_key": "s", "cardinality": "one", "support_count": 1, "support_mass": 1.0, "importance": 0.5}
    rows = [base | {"memory_key": "a", "revision_key": "a", "valid_from": -5, "valid_until": -1}, base | {"memory_key": "b", "revision_key": "b", "valid_from": 0, "valid_until": 9}]
    first, second = C.fold(rows)
    assert first["status"] == "superseded" and first["valid_until"] == 0 and second["status"] == "active"


def test_slots_are_not_a_group_each(spark):
    from mnemospark.plans import catalog

    plan = catalog.queries()["reconcile_fold"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
