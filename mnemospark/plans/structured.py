"""Queries of structured cues and of the stores' and loops' smaller operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import WorkingMemoryConfig
from ..functions import maths as M
from ..functions import text as X
from ..operators import activation as A
from ..operators import episodes as E
from ..operators import facts as K
from ..operators import forgetting as G
from ..operators import learning as L
from ..operators import reconcile as C
from ..operators import slots as Z
from ..operators import working_memory as W
from ..sources import scans as I
from .catalog import BASE, SESS, _r, _sessions, _states, query
from .inputs import as_of, table

STATUS = "CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'superseded' ELSE 'contested' END"


def _status():
    return F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "superseded").otherwise("contested")


def _pairs(spark, sf) -> DataFrame:
    """A cue for each customer, in four kinds, with the orders of two customers as facts."""
    kind = F.col("c_custkey") % 4
    text = lambda x: F.lit(x).cast("string")
    own, none = F.array(F.concat(F.lit("C:"), F.col("c_custkey").cast("string"))), F.array().cast("array<string>")
    cue = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cue_id"), F.explode(F.array("c_custkey", F.col("c_custkey") + 1)).alias("of"),
        F.when(kind < 2, "Order_Priority").alias("cue_predicate"), F.when(kind == 0, " 1-urgent").alias("cue_object"), F.when(kind == 0, own).otherwise(none).alias("cue_entities"),
        F.when(kind.isin(1, 2), own).otherwise(none).alias("seeds"), F.element_at(F.array(text("current"), text("neutral"), text("current"), text("historical")), (kind + 1).cast("int")).alias("mode"),
        (kind >= 2).alias("lexical"), X.tokens(F.when(kind >= 2, "currently urgent")).alias("cue_tokens"),
    ).withColumn("effective", Z.effective_entities(F.col("cue_entities"), F.col("seeds"), none))
    fact = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("f_of"), F.lit("semantic").alias("kind"), F.col("o_orderkey").alias("key"), _status().alias("status"), F.lit("order_priority").alias("predicate"), F.col("o_orderpriority").alias("object_value"),
        F.array(F.concat(F.lit("C:"), F.col("o_custkey").cast("string"))).alias("entities"), X.tokens(F.lit("order priority")).alias("tokens"), X.tokens(F.col("o_orderpriority")).alias("object_tokens"),
    )
    return cue.join(fact, F.col("of") == F.col("f_of"))


PAIRS = f"""p0 AS (SELECT c_custkey AS cue_id, unnest([c_custkey, c_custkey + 1]) AS f, c_custkey % 4 AS t FROM customer),
p AS (SELECT cue_id, o_orderkey AS key, t, o_custkey = cue_id AS own, o_orderpriority = '1-URGENT' AS urgent, {STATUS} AS status FROM p0 JOIN orders ON o_custkey = f),
s AS (SELECT *, CASE t WHEN 0 THEN own AND urgent WHEN 3 THEN urgent ELSE own END AS matched, CASE t WHEN 0 THEN CAST(own AND urgent AND status = 'active' AS DOUBLE) WHEN 1 THEN CAST(own AS DOUBLE) WHEN 2 THEN CAST(own AND status = 'active' AS DOUBLE) END AS slot_fit FROM p)"""


@query(f"WITH {PAIRS} SELECT cue_id, key, matched, slot_fit, coalesce(slot_fit - .5, 0) AS adjustment, CASE WHEN t = 3 THEN 'historical_slot_admission' ELSE 'entity_slot_admission' END AS label FROM s")
def slot_matching(spark, sf):
    fit = Z.fit_of_fact()
    return _pairs(spark, sf).select("cue_id", "key", Z.matches().alias("matched"), fit.alias("slot_fit"), Z.adjustment(fit).alias("adjustment"), Z.admission_label().alias("label"))


def _supports(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("memory_key"), F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("revision_key"), F.col("l_suppkey").alias("episode_id"), F.col("l_discount").alias("contribution"))


@query(f"WITH {PAIRS}, a AS (SELECT cue_id, key FROM s WHERE matched AND status = 'active') SELECT cue_id, 'semantic' AS kind, key FROM a UNION SELECT cue_id, 'episode', l_suppkey FROM a JOIN lineitem ON l_orderkey = key")
def slot_admission(spark, sf):
    return Z.admitted(_pairs(spark, sf), _supports(spark, sf), True)


@query(f"""WITH {PAIRS}, x AS (SELECT cue_id, l_suppkey AS episode_id, max(struct_pack(f := slot_fit, c := l_discount, r := 'r' || l_orderkey)) AS b FROM s JOIN lineitem ON l_orderkey = key WHERE slot_fit IS NOT NULL GROUP BY 1, 2)
SELECT cue_id, episode_id, b.f AS slot_fit, b.r AS revision_key FROM x""")
def slot_fit_of_episodes(spark, sf):
    fits = _pairs(spark, sf).select("cue_id", F.col("key").alias("memory_key"), Z.fit_of_fact().alias("slot_fit"))
    return Z.inherited_fits(fits, _supports(spark, sf))


@query("""WITH t AS (SELECT DISTINCT replace(lower(trim(p_brand)), ' ', '-') AS token FROM part UNION SELECT DISTINCT lower(p_size::VARCHAR) FROM part), q AS (SELECT p_partkey AS cue_id, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_size), '[a-z0-9_]+'))) AS token FROM part)
SELECT cue_id, string_agg(token, ',' ORDER BY token) AS tags FROM q JOIN t USING (token) GROUP BY 1""")
def tag_seeding(spark, sf):
    p = table(spark, sf, "part")
    cues = p.select(F.col("p_partkey").alias("cue_id"), X.tokens(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("cue_tokens"))
    s = Z.seed_tags(p.select(F.array("p_brand", F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("tags")), "tags", cues)
    return s.select("cue_id", F.array_join("tags", ",").alias("tags"))


@query("""WITH d AS (SELECT l_suppkey AS episode_id, 'slot ' || o_custkey AS slot_key, l_orderkey * 10 + l_linenumber AS place, o_orderstatus = 'F' AS old FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT episode_id, arg_max(slot_key, (CASE WHEN old THEN 1 ELSE 0 END, place)) AS slot_key FROM d GROUP BY 1""")
def episode_slots(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = j.select(F.col("l_suppkey").alias("episode_id"), F.concat(F.lit("slot "), F.col("o_custkey").cast("string")).alias("slot_key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), "o_orderstatus")
    part = lambda c: rows.where(c).drop("o_orderstatus")
    return Z.episode_slots(part("o_orderstatus <> 'F'"), part("o_orderstatus = 'F'"))


@query("""WITH d AS (SELECT c_custkey, c_nationkey, unnest(list_distinct(regexp_extract_all(lower(c_name || ' ' || c_mktsegment), '[a-z0-9_]+'))) AS token FROM customer), n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)
SELECT c_nationkey, token, count(*) AS df, round(ln((any_value(n) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM d JOIN n USING (c_nationkey) GROUP BY 1, 2""")
def idf_by_tenant(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", X.tokens(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("t"))
    return A.idf_by(c, "t", ["c_nationkey"]).select("c_nationkey", "token", "df", _r("idf", 6).alias("idf"))


@query("""WITH c AS (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), p AS (SELECT o_custkey AS l, o_custkey + 3 AS r, count(*) AS n FROM orders GROUP BY ALL)
SELECT l AS "left", r AS "right", n FROM p WHERE l IN (SELECT o_custkey FROM c) AND r IN (SELECT o_custkey FROM c)""")
def association_scan(spark, sf):
    o = table(spark, sf, "orders")
    pairs = o.groupBy(F.col("o_custkey").alias("left"), (F.col("o_custkey") + 3).alias("right")).agg(F.count(F.lit(1)).alias("n"))
    return L.associations_within(pairs, o.where("o_orderstatus <> 'F'").select("o_custkey"), "o_custkey")


@query("""SELECT l_orderkey AS key, l_linenumber AS line, CASE WHEN o_orderkey IS NULL THEN 'unknown memory' WHEN o_orderstatus = 'F' THEN 'memory is not visible' WHEN l_linestatus = 'F' AND o_orderstatus = 'P' THEN 'other subject' WHEN l_linenumber % 3 = 1 AND l_linenumber > 3 THEN 'revision of another memory' END AS problem
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey + l_linenumber // 7 * 100000000 WHERE problem IS NOT NULL""")
def learning_targets(spark, sf):
    li = table(spark, sf, "lineitem")
    key = F.col("l_orderkey") + F.floor(F.col("l_linenumber") / 7) * 100_000_000
    fb = li.select("l_orderkey", F.col("l_linenumber").alias("line"), F.lit("semantic").alias("kind"), key.alias("key"), F.when(F.col("l_linestatus") == "F", "P").alias("subject_id"), F.when(F.col("l_linenumber") % 3 == 1, F.col("l_linenumber")).cast("int").alias("revision_key"))
    o = table(spark, sf, "orders")
    memories = o.select(F.lit("semantic").alias("kind"), F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "P", "Q").alias("subject_id"), (F.col("o_orderstatus") != "F").alias("visible"))
    revisions = o.select(F.col("o_orderkey").alias("memory_key"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("revision_key"))
    return L.invalid_targets(fb, memories, revisions).select(F.col("l_orderkey").alias("key"), "line", "problem")


@query("SELECT o_custkey AS cue_id, count(*) FILTER (WHERE o_totalprice < 50000) AS dropped, count(*) FILTER (WHERE o_totalprice >= 50000) AS kept FROM orders GROUP BY 1")
def goal_floor(spark, sf):
    pool = table(spark, sf, "orders").select(F.col("o_custkey").alias("cue_id"), (F.col("o_totalprice") / 100000).alias("relevance"))
    kept, dropped = W.above_floor(pool, "relevance", WorkingMemoryConfig(least_relevance=0.5))
    return dropped.join(kept.groupBy("cue_id").agg(F.count(F.lit(1)).alias("kept")), "cue_id", "left").select("cue_id", "dropped", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"))


@query("""SELECT user_id, event_id, round(CASE WHEN event_id % 3 = 0 THEN least(1, greatest(0, .8 * power(2, -(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6 / 86400))) ELSE 0 END, 6) AS carried FROM events""")
def wm_carryover(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("cue_id"), F.lit("t").alias("tenant_id"), F.lit(None).cast("string").alias("subject_id"), F.lit("episode").alias("kind"), F.col("event_id").alias("key"), "ts")
    before = e.where("key % 3 = 0").select("cue_id", "tenant_id", "subject_id", "kind", "key", F.lit(0.8).alias("strength"), F.col("ts").alias("selected_at"))
    out = W.with_carryover(e.drop("ts"), before, as_of(), WorkingMemoryConfig(half_life_seconds=86400.0))
    return out.select(F.col("cue_id").alias("user_id"), F.col("key").alias("event_id"), _r("carried", 6).alias("carried"))


@query(SESS + """SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS observation_count, epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 AS duration_seconds, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS event_types FROM s GROUP BY 1, 2""")
def episode_metadata(spark, sf):
    m = E.metadata(_sessions(spark, sf), ["user_id"], "ts", {"event_types": "event_type"})
    return m.select("user_id", F.col("session").cast("long").alias("session"), "observation_count", "duration_seconds", F.array_join("event_types", ",").alias("event_types"))


@query(f"""WITH {BASE}, r AS (SELECT user_id, event_type, last, round(1 / (1 + exp(-(base + 3))) * (.15 + .85 * importance), 9) AS s FROM b),
x AS (SELECT *, user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F') AS held FROM r),
y AS (SELECT CASE WHEN s >= .5 THEN 'active' WHEN s > .2 THEN 'fading' WHEN (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last)) / 1e6 >= 604800 AND NOT held THEN 'forgotten' ELSE 'fading' END AS state, s >= .5 AND user_id % 2 = 0 AS back FROM x)
SELECT count(*) FILTER (WHERE state = 'active') AS active, count(*) FILTER (WHERE state = 'fading') AS fading, count(*) FILTER (WHERE state = 'forgotten') AS forgotten, count(*) FILTER (WHERE back) AS reactivated FROM y""")
def forgetting_counters(spark, sf):
    from ..config import ForgettingConfig

    s = _states(spark, sf).withColumn("s", F.round("retention", 9)).withColumn("prev_state", F.when(F.col("user_id") % 2 == 0, "fading")).withColumn("prev_since", F.col("last")).withColumn("prev_forgotten_at", F.lit(None).cast("timestamp_ntz"))
    s = s.withColumn("kind", F.lit("episode")).withColumn("key", F.col("user_id"))
    held = G.protected_by_support(s, table(spark, sf, "orders").select(F.col("o_custkey").alias("episode_id"), _status().alias("status")))
    return G.counters(G.transitions(held, "s", as_of(), F.col("protected"), ForgettingConfig(fading=0.5, forgotten=0.2)))


@query("""SELECT event_id, sha256('m' || chr(31) || CASE WHEN event_id % 3 = 2 THEN 'unspecified' ELSE CASE WHEN event_id % 3 = 1 THEN 'end:' ELSE '' END || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 > 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' END) AS revision_key FROM events""")
def revision_keys(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    return e.select("event_id", C.revision_key(F.lit("m"), F.when(F.col("event_id") % 3 == 0, F.col("t")), F.when(F.col("event_id") % 3 == 1, F.col("t"))).alias("revision_key"))


@query("""WITH g AS (SELECT l_orderkey, string_agg(l_suppkey || chr(31) || printf('%.6f', l_quantity / 64), chr(30) ORDER BY l_suppkey::VARCHAR, l_quantity) AS s FROM lineitem GROUP BY 1)
SELECT o_orderkey, sha256('c' || o_orderkey || chr(31) || o_orderstatus || chr(31) || '0.500000' || chr(31) || printf('%.6f', (o_orderkey % 8) / 8.0) || chr(31) || s || chr(31) || chr(31) || '7' || chr(31) || '1' || chr(31) || '0.250000' || chr(31) || '1' || chr(31) || '1') AS fingerprint FROM orders JOIN g ON l_orderkey = o_orderkey""")
def semantic_fingerprint(spark, sf):
    supports = F.collect_list(F.struct(F.col("l_suppkey").cast("string").alias("episode_id"), (F.col("l_quantity") / 64).alias("weight"))).alias("s")
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(supports)
    none = F.array().cast("array<struct<episode_id:string,weight:double>>")
    seen = F.array(F.struct(F.lit("7").alias("observation_id"), F.lit(1).alias("observation_revision"), F.lit(0.25).alias("contribution_score")))
    o = table(spark, sf, "orders").join(g, F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", C.semantic_fingerprint(key, F.col("o_orderstatus"), F.lit(0.5), (F.col("o_orderkey") % 8) / 8.0, F.col("s"), none, seen).alias("fingerprint"))


@query("SELECT c_custkey, c_custkey || ' has account balance (nation=' || c_nationkey || ', segment=' || lower(c_mktsegment) || ')' AS statement, CASE WHEN c_nationkey = 7 THEN 1.0 ELSE 1 / 3.0 END AS similarity FROM customer")
def claim_qualifiers(spark, sf):
    q = F.create_map(F.lit("Nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.concat(F.lit(" "), F.col("c_mktsegment")))
    other = F.create_map(F.lit("nation"), F.lit("7"), F.lit("Segment"), F.upper("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", K.claim_statement(F.col("c_custkey").cast("string"), F.lit("has_account"), F.lit("balance"), F.lit("affirm"), q).alias("statement"), X.qualifier_similarity(q, other).alias("similarity"))


@query(f"""WITH r AS (SELECT o_custkey, 'k' || o_orderkey AS k, {STATUS} AS st, o_orderkey % 2 = 0 AS there FROM orders)
SELECT (SELECT count(DISTINCT o_custkey || '/' || o_orderpriority) FROM orders) AS canonical_claims, count(DISTINCT o_custkey) AS promoted, count(*) FILTER (WHERE NOT there) AS created, count(*) FILTER (WHERE there) AS kept, count(*) FILTER (WHERE st = 'active') AS active, count(*) FILTER (WHERE st = 'contested') AS contested, count(*) FILTER (WHERE st = 'superseded') AS superseded FROM r""")
def consolidation_counters(spark, sf):
    o = table(spark, sf, "orders")
    claims = o.select(F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("claim_key"))
    r = o.select(F.col("o_custkey").alias("memory_key"), F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("revision_key"), _status().alias("status"), "o_orderkey")
    return C.consolidation_counters(claims, r.drop("o_orderkey"), r.where("o_orderkey % 2 = 0"))


@query(f"""SELECT o_custkey AS memory_key, o_orderkey AS revision_number, c_name AS subject FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate <= TIMESTAMP '1996-01-01' ORDER BY 1, 2 LIMIT 100""")
def revision_scan(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("memory_key"), F.col("o_orderkey").alias("revision_number"), F.col("o_orderdate").alias("valid_from"))
    m = table(spark, sf, "customer").select(F.col("c_custkey").alias("memory_key"), F.col("c_name").alias("subject"), "c_mktsegment")
    valid = M.valid_at(F.col("valid_from"), F.lit(None).cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz"))
    return I.revisions_of(o, m, valid, 100, c_mktsegment="BUILDING").select("memory_key", "revision_number", "subject")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def point_lookup(spark, sf):
    keys = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return I.lookup(table(spark, sf, "customer"), keys, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT c_custkey AS memory_key, 'legacy:' || c_custkey AS revision_key, 1 AS revision_number, c_mktsegment AS status FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def legacy_backfill(spark, sf):
    m = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("memory_key"), F.col("c_mktsegment").alias("status"))
    return I.legacy_backfill(m, table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("memory_key")))
