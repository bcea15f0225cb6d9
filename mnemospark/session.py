"""The memory of one or many tenants over snapshot tables: ingest, process, recall, learn, forget."""

from __future__ import annotations

import datetime as dt
import functools
import operator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import ActivationConfig, ConsolidationConfig, ForgettingConfig, LearningConfig, WorkingMemoryConfig
from .functions import text as X
from .operators import activation as A
from .operators import episodes as E
from .operators import facts as K
from .operators import forgetting as G
from .operators import ingest as N
from .operators import learning as L
from .operators import metamemory as Q
from .operators import ranking as R
from .operators import reconcile as C
from .operators import slots as Z
from .operators import spreading as S
from .operators import working_memory as W
from .sources import scans as I
from .sources import store as T

OBSERVATION = "tenant_id string, subject_id string, source_namespace string, source_record_id string, source_version string, event_type string, content string, observed_at timestamp, is_deleted boolean, conversation_id string, entity_ids array<string>, facts string, terminal boolean, boundary boolean"


class Memory:
    def __init__(self, spark: SparkSession, folder: str, activation: ActivationConfig = ActivationConfig(), consolidation: ConsolidationConfig = ConsolidationConfig()) -> None:
        self.spark, self.store, self.activation, self.consolidation = spark, T.SnapshotStore(spark, folder), activation, consolidation

    # -- writing ----------------------------------------------------------

    def ingest(self, observations: DataFrame, tenant_id: str) -> dict[str, int]:
        """Accept, retain and upsert observations; counts by status."""
        accepted, rejected = N.ingest(observations, tenant_id)
        key = ["tenant_id", "source_namespace", "source_record_id"]
        batch = accepted.withColumn("state", X.hash_parts(F.col("source_version"), F.col("content_hash"), F.col("is_deleted").cast("string")))
        rest = [c for c in batch.columns if c not in key]
        batch = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("observed_at", "state")).alias("r")).select(*key, "r.*")
        current = self.store.read("observations")
        if current is None:
            status = batch.withColumn("status", F.lit("created"))
            new = batch
        else:
            status = T.classify(current, batch, key, "source_version", "content_hash", "is_deleted")
            new = T.keyed_upsert(current, batch, key, "state").drop("status")
        counts = T.ingest_counts(status).first().asDict() | {"rejected": rejected.count()}
        self.store.write("observations", new)
        return counts

    def encode_episodes(self) -> DataFrame:
        obs = self.store.read("observations").where("not is_deleted")
        obs = obs.withColumn("obs_id", F.sha2(F.concat_ws("\x1f", "tenant_id", "source_namespace", "source_record_id"), 256))
        keys = ["tenant_id", "subject_id", "source_namespace", "conversation_id"]
        grouped = E.sessionise(obs.where("conversation_id is not null"), keys, "observed_at", "obs_id", None, "boundary", "terminal")
        loose = E.sessionise(obs.where("conversation_id is null"), keys, "observed_at", "obs_id", self.consolidation.gap_seconds, "boundary", "terminal")
        sessions = grouped.unionByName(loose)
        rows = E.rollup(sessions, keys, "obs_id", "observed_at", "content", "attention_score", "terminal", "event_type", cfg=self.consolidation)
        by = [*keys, "session"]
        same = lambda a, b: functools.reduce(operator.and_, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by))
        named = E.entities(sessions, by, F.col("subject_id"), named=F.col("entity_ids")).select(*by, F.array_distinct(F.transform("entities", lambda x: x["entity_id"])).alias("entities"))
        about = E.metadata(sessions, keys, "observed_at", {"event_types": "event_type"}).select(*by, F.struct("observation_count", "duration_seconds", "event_types").alias("metadata"))
        rows = rows.alias("r").join(about.alias("m"), same("r", "m"), "left").select("r.*", "m.metadata").alias("r").join(named.alias("n"), same("r", "n"), "left")
        rows = rows.select("r.*", F.coalesce("n.entities", F.array().cast("array<string>")).alias("entities"), F.lit(True).alias("is_active"))
        current = self.store.read("episodes")
        if current is not None:
            kept = T.keyed_upsert(current, rows, ["tenant_id", "memory_key"], "fingerprint").drop("status")
            rows = T.deactivate_missing(kept, rows, ["tenant_id", "memory_key"])
        return self.store.write("episodes", rows)

    def consolidate(self) -> DataFrame:
        """Facts of the observations, consolidated over episodes and reconciled into revisions."""
        obs = self.store.read("observations").withColumn("observation_id", F.sha2(F.concat_ws("\x1f", "tenant_id", "source_namespace", "source_record_id"), 256))
        ep = self.store.read("episodes").where("is_active").select(F.col("memory_key").alias("episode_id"), F.col("confidence").alias("episode_confidence"), "importance", F.explode("evidence.observation_id").alias("observation_id"))
        facts = K.extract(obs.where("facts is not null").select("tenant_id", "subject_id", "source_namespace", "observation_id", "observed_at", "facts"), "facts", "subject_id").where("not failed")
        slot, claim = K.slot_and_claim(F.col("tenant_id"), F.col("subject_entity_id"), F.col("predicate"), F.col("qualifiers"), F.col("object_value"), F.col("polarity"))
        c = facts.join(ep, "observation_id").withColumn("slot_key", slot).withColumn("claim_key", claim).withColumnRenamed("source_namespace", "namespace")
        best = K.best_per_episode(c, "observation_id")
        named = best.groupBy("claim_key").agg(F.min_by(F.struct("tenant_id", "subject_entity_id", "predicate", "object_value", "polarity", "cardinality"), "episode_id").alias("c")).select("claim_key", "c.*")
        claims = K.consolidate(best, self.consolidation).join(named, "claim_key").withColumnRenamed("claim_key", "memory_key")
        revisions = C.reconcile(claims, self.consolidation)
        weight = F.col("fact_confidence") * F.col("episode_confidence") * (0.5 + 0.5 * F.col("importance"))
        derivations = best.select("tenant_id", F.col("claim_key").alias("memory_key"), C.revision_key(F.col("claim_key"), F.col("valid_from"), F.col("valid_until")).alias("revision_key"), "episode_id", F.lit("supports").alias("relation"), weight.alias("contribution"))
        self.store.write("derivations", derivations.join(claims.select("memory_key").distinct(), "memory_key", "left_semi"))
        about = named.select(F.col("claim_key").alias("memory_key"), "tenant_id", F.col("subject_entity_id").alias("subject_id"), "predicate", "polarity", K.claim_statement(F.col("subject_entity_id"), F.col("predicate"), F.col("object_value"), F.col("polarity")).alias("statement"))
        return self.store.write("revisions", revisions.join(about, "memory_key"))

    def process(self) -> None:
        self.encode_episodes()
        self.consolidate()

    # -- reading ----------------------------------------------------------

    def candidates(self, as_of: dt.datetime, valid_at: dt.datetime | None = None) -> DataFrame:
        """Episodes and facts in one relation; facts as of ``valid_at``, or the current ones."""
        ep = self.store.read("episodes").where("is_active").where(F.col("started_at") <= F.lit(valid_at or as_of))
        none = F.lit(None).cast("string")
        ep = ep.select("tenant_id", "subject_id", F.lit("episode").alias("kind"), F.col("memory_key").alias("key"), "statement", F.col("ended_at").alias("created_at"), "importance", F.lit("active").alias("status"), none.alias("predicate"), none.alias("object_value"), "entities")
        revisions = self.store.read("revisions")
        if revisions is None:
            return ep
        at = revisions.where("status <> 'superseded'") if valid_at is None else revisions.where(C.valid_at(F.col("valid_from"), F.col("valid_until"), F.lit(valid_at)))
        now = C.current_projection(at, ["tenant_id", "memory_key"])
        own = F.filter(F.array("subject_id"), lambda x: x.isNotNull())
        return ep.unionByName(now.select("tenant_id", "subject_id", F.lit("semantic").alias("kind"), F.col("memory_key").alias("key"), "statement", F.coalesce("valid_from", F.lit(as_of)).alias("created_at"), "importance", "status", "predicate", "object_value", own.alias("entities")))

    def _derivations(self) -> DataFrame:
        """(memory_key, revision_key, episode_id, contribution, status) of all facts, superseded ones too."""
        d, r = self.store.read("derivations"), self.store.read("revisions")
        if d is None or r is None:
            return self.spark.createDataFrame([], "memory_key string, revision_key string, episode_id string, contribution double, status string")
        return d.where("relation = 'supports'").join(r.select("memory_key", "revision_key", "status"), ["memory_key", "revision_key"]).select("memory_key", "revision_key", "episode_id", "contribution", "status")

    def _usage(self, c: DataFrame, as_of: dt.datetime) -> DataFrame:
        """(tenant_id, kind, key, at, weight): a trace for the making of each candidate, and those of its uses and helpful feedback."""
        key, one = ["tenant_id", "kind", "key"], F.lit(1).cast("long").alias("weight")
        log = c.select(*key, F.col("created_at").alias("at"), one)
        traces, feedback = self.store.read("traces"), self.store.read("feedback")
        if traces is not None:
            log = log.unionByName(traces.select(*key, "at", "weight").join(c.select(*key), key, "left_semi"))
        if feedback is not None and "occurred_at" in feedback.columns:
            log = log.unionByName(feedback.where("outcome = 'helpful' and occurred_at is not null").select(*key, F.col("occurred_at").alias("at"), one).join(c.select(*key), key, "left_semi"))
        return log.where(F.col("at") <= F.lit(as_of))

    def recall(self, cues: DataFrame, as_of: dt.datetime, limit: int = 5, valid_at: dt.datetime | None = None, include_forgotten: bool = False, subject_id: str | None = None) -> DataFrame:
        """The ``limit`` best memories of each cue.

        A cue has cue_id and tenant_id, and some of text, subject_id,
        entity_ids, predicate and object_value. Its candidates are those of
        its tenant and, if it has one, its subject. Pairs are made where a
        candidate shares a token, spreading activation, a field or an entity
        with the cue, or supports one that does; of the others, which differ
        only by base level, the first of each tenant, subject and kind.
        """
        cfg, key, none = self.activation, ["tenant_id", "kind", "key"], F.array().cast("array<string>")
        c = self.candidates(as_of, valid_at).where(F.col("created_at") <= F.lit(as_of))
        dynamics = self.store.read("dynamics")
        if dynamics is not None and not include_forgotten:
            c = G.drop_forgotten(c, dynamics, key)
        c = A.guard_candidates(c, cfg)
        base = A.base_level(self._usage(c, as_of), key, "at", F.lit(as_of), "weight", cfg)
        docs = c.join(base, key).withColumns({"doc": F.concat_ws("/", "tenant_id", "kind", "key"), "tokens": X.tokens(F.col("statement")), "object_tokens": X.tokens(F.col("object_value"))})
        docs = self.store.write("recall_candidates", docs)
        supports = self._derivations()
        cue = Z.normalise_cues(cues, subject_id).withColumn("tenant_id", F.col("cue_tenant"))
        seeds = A.seed_entities(docs, "entities", cue.select("cue_id", "tenant_id", F.col("cue_tokens").alias("tokens")), ["tenant_id"])
        words = F.array(*(F.lit(t) for t in cfg.current_tokens))
        cue = cue.join(seeds, "cue_id", "left").withColumn("seeds", F.when((F.size("cue_entities") == 0) & F.col("seeds").isNotNull(), F.col("seeds")).otherwise(none))
        cue = cue.withColumns({"effective": Z.effective_entities(F.col("cue_entities"), F.col("seeds"), none), "mode": A.temporal_mode(F.lit(valid_at), F.col("cue_tokens"), F.col("cue_predicate"), F.col("cue_object"), cfg), "lexical": F.arrays_overlap("cue_tokens", words) & F.lit(valid_at is None)})
        cue = self.store.write("recall_cues", cue)
        fit = A.weighted_text_fit(docs, "doc", "tokens", cue.select("cue_id", "tenant_id", F.col("cue_tokens").alias("tokens"), A.incident_scale(F.col("cue_tokens"), cfg).alias("scale")), A.idf_by(docs, "tokens", ["tenant_id"]), ["tenant_id"])
        scoped = lambda e: F.concat_ws("\x1f", "tenant_id", e)
        links = docs.select("doc", "tenant_id", "subject_id", F.explode("entities").alias("e"))
        edges = links.where(~F.col("e").eqNullSafe(F.col("subject_id"))).select(F.col("doc").alias("memory"), scoped("e").alias("entity")).distinct()
        spread = S.spread(edges, cue.select("cue_id", "tenant_id", F.explode("effective").alias("e")).select("cue_id", scoped("e").alias("entity")), cfg)
        # candidates that meet a cue by something
        by_entity = cue.select("cue_id", "tenant_id", F.explode("effective").alias("e")).join(links.select("doc", "tenant_id", "e"), ["tenant_id", "e"]).select("cue_id", "doc")
        facts = docs.where("kind = 'semantic'").select("doc", "tenant_id", "key", X.canonical_text(F.col("predicate")).alias("p"), X.canonical_text(F.col("object_value")).alias("o"))
        asked = lambda name, field: cue.where(F.col(name).isNotNull()).select("cue_id", "tenant_id", X.canonical_text(F.col(name)).alias(field)).join(facts, ["tenant_id", field]).select("cue_id", "doc")
        met = fit.select("cue_id", "doc").unionByName(spread.select("cue_id", F.col("memory").alias("doc"))).unionByName(by_entity).unionByName(asked("cue_predicate", "p")).unionByName(asked("cue_object", "o"))
        episodes = docs.where("kind = 'episode'").select(F.col("doc").alias("e_doc"), F.col("key").alias("episode_id"))
        held = met.join(facts.select("doc", F.col("key").alias("memory_key")), "doc").join(supports.select("memory_key", "episode_id").distinct(), "memory_key").join(episodes, "episode_id").select("cue_id", F.col("e_doc").alias("doc"))
        head = docs.select("doc", "tenant_id", "subject_id", "kind", F.row_number().over(Window.partitionBy("tenant_id", "subject_id", "kind").orderBy(F.desc("base_level"), "key")).alias("n")).where(F.col("n") <= max(limit, 50))
        first = cue.select("cue_id", "tenant_id", "cue_subject").join(head, "tenant_id").where(F.col("cue_subject").isNull() | (F.col("cue_subject") == F.col("subject_id"))).select("cue_id", "doc")
        pairs = met.unionByName(held).unionByName(first).distinct().join(cue.drop("tenant_id"), "cue_id").join(docs, "doc").where(F.col("cue_subject").isNull() | (F.col("cue_subject") == F.col("subject_id")))
        pairs = pairs.join(fit, ["cue_id", "doc"], "left").join(spread.select("cue_id", F.col("memory").alias("doc"), F.col("spreading").alias("spread"), "hop"), ["cue_id", "doc"], "left")
        pairs = self.store.write("recall_pairs", pairs.withColumns({"coverage": F.coalesce("coverage", F.lit(0.0)), "f1": F.coalesce("f1", F.lit(0.0)), "spread": F.coalesce("spread", F.lit(0.0)), "fact_fit": Z.fit_of_fact(), "matched": Z.matches(cfg)}))
        fits = Z.inherited_fits(pairs.where("kind = 'semantic'").select("cue_id", F.col("key").alias("memory_key"), F.col("fact_fit").alias("slot_fit")), supports).select("cue_id", F.lit("episode").alias("kind"), F.col("episode_id").alias("key"), F.col("slot_fit").alias("held_fit"), F.col("revision_key").alias("supports_revision"))
        let_in = Z.admitted(pairs, supports, valid_at is None, cfg).withColumn("admitted", F.lit(True))
        statuses = A.support_statuses(supports.join(facts.select(F.col("key").alias("memory_key")), "memory_key", "left").select("episode_id", "memory_key", "revision_key", F.col("memory_key").alias("slot_key"), "status"))
        rows = pairs.join(fits, ["cue_id", "kind", "key"], "left").join(let_in, ["cue_id", "kind", "key"], "left").join(statuses.select(F.lit("episode").alias("kind"), F.col("episode_id").alias("key"), "statuses", "provenance"), ["kind", "key"], "left")
        if valid_at is None:
            rows = rows.where(~((F.col("mode") == "current") & A.superseded_only(F.col("statuses"))))
        rows = rows.withColumns({"slot_fit": F.coalesce("fact_fit", "held_fit"), "statuses": F.coalesce("statuses", none)})
        supported = F.col("kind") == "semantic"
        in_slot = F.when(F.col("kind") == "semantic", F.col("matched")).otherwise(F.coalesce(F.col("held_fit") > 0, F.lit(False)))
        now = F.when(F.col("mode") == "current", A.current_state(F.col("kind"), F.col("status"), F.col("statuses"), in_slot, F.col("lexical"), supported, cfg)).otherwise(F.lit(0.0))
        rows = rows.withColumns({"current_state": now, "conjunction": A.conjunction(F.col("effective"), F.col("entities"), cfg)})
        scored = A.scored(rows, "base_level", "spread", "coverage", "f1", F.col("current_state"), F.col("conjunction"), Z.adjustment(F.col("slot_fit"), cfg), cfg)
        scored = scored.withColumn("eligibility", F.when(F.col("admitted"), Z.admission_label(cfg)).otherwise("threshold"))
        order = [F.desc("rank_activation"), F.desc("activation"), F.asc("kind"), F.asc("key")]
        top = A.top_k(A.eligible(scored, F.col("admitted"), cfg), max(limit, 50), ["cue_id"], order).withColumn("reason", Z.reason())
        top = self.store.write("recall_ranked", top.select("cue_id", "rank", "tenant_id", "subject_id", "kind", "key", "statement", "status", "importance", "predicate", "object_value", "entities", "base_level", "traces", "coverage", "f1", "spread", "hop", "slot_fit", "supports_revision", "provenance", "activation", "rank_activation", "score", "latency_seconds", "eligibility", "reason", "tokens"))
        kept = R.collapse(top.select("cue_id", "rank", F.col("rank").cast("long").alias("key"), X.content_hash(F.col("statement")).alias("fingerprint"), "tokens"), "cue_id", "rank", limit, cfg)
        return top.withColumnRenamed("rank", "pool_rank").join(kept.select("cue_id", F.col("rank").alias("pool_rank"), F.col("place").cast("int").alias("rank")), ["cue_id", "pool_rank"]).drop("pool_rank")

    def select_working_memory(self, recalled: DataFrame, cfg: WorkingMemoryConfig = WorkingMemoryConfig()) -> DataFrame:
        base = W.priority(F.col("score"), F.col("f1"), F.col("importance"), F.lit(0.0), cfg)
        pool = recalled.withColumn("adjusted", W.adjusted(base, F.lit(None).cast("double"), cfg=cfg)).withColumn("n_tokens", X.token_estimate(F.col("statement")))
        return R.select_working_memory(pool, "cue_id", cfg).join(recalled.select("cue_id", "kind", "key", "statement"), ["cue_id", "kind", "key"])

    def assess(self, recalled: DataFrame, cues: DataFrame) -> DataFrame:
        q = cues.select(F.col("cue_id").alias("q"), X.tokens(F.col("text")).alias("cue"))
        cover = Q.cue_coverage(recalled.join(q, F.col("cue_id") == F.col("q")), "cue_id", "cue", "tokens")
        one = recalled.groupBy("cue_id").agg(F.max("score").alias("strength"), F.lit(1.0).alias("evidence"), F.max(Q.conflict(F.col("status"), F.lit(0), F.lit(0)) * F.col("score")).alias("conflict"), Q.diversity(F.countDistinct("key")).alias("diversity"), F.max(Q.pressure(F.col("base_level")) * F.col("score")).alias("pressure"), F.lit(0.5).alias("utility"))
        return Q.flags(one.join(cover, "cue_id"))

    def prepare_context(self, cues: DataFrame, as_of: dt.datetime, cfg: WorkingMemoryConfig = WorkingMemoryConfig()) -> tuple[DataFrame, DataFrame]:
        """(rendered working memory, assessment), from one ranking."""
        pool = self.store.write("pool", self.recall(cues, as_of, cfg.pool))
        return R.render(self.select_working_memory(pool, cfg), "cue_id", "place", "statement"), self.assess(pool, cues)

    # -- feedback ---------------------------------------------------------

    def record_access(self, results: DataFrame, at: dt.datetime, request_id: str | None = None, min_score: float | None = None, burst: tuple[int, float] | None = None) -> DataFrame:
        """Append a trace for each result, once per request; forgotten ones come back.

        ``burst``: a memory with so many traces in so many seconds gets none.
        """
        key = ["tenant_id", "kind", "key"]
        rows = results if min_score is None else results.where(F.col("score") >= min_score)
        rows = rows.select(*key, F.lit(at).alias("at"), F.lit(1).cast("long").alias("weight"), F.lit(request_id).cast("string").alias("request_id"))
        current, dynamics = self.store.read("traces"), self.store.read("dynamics")
        log = rows.limit(0) if current is None else current
        if burst is not None:
            rows = G.burst_limited(rows, log, key, "at", F.lit(at), *burst)
        if dynamics is not None:
            used = rows.select(*key).distinct().withColumn("used", F.lit(True))
            back = dynamics.join(used, key, "left").withColumns({"reactivated": F.col("reactivated") | (F.col("used").isNotNull() & (F.col("state") != "active")), "state": F.when(F.col("used"), "active").otherwise(F.col("state"))})
            self.store.write("dynamics", back.withColumns({c: F.when(F.col("used").isNull(), F.col(c)) for c in ("below_threshold_since", "forgotten_at")}).drop("used"))
        return self.store.write("traces", T.append_references(log, rows, key))

    def learn(self, feedback: DataFrame, cfg: LearningConfig = LearningConfig()) -> DataFrame:
        """Store feedback once per feedback_id; counts, utility and strength of each memory and context.

        Feedback has feedback_id, tenant_id, kind, key and outcome, and may
        have context_key (default ``global``), subject_id, revision_key and
        occurred_at. What names no visible memory is an error.
        """
        have = dict(feedback.dtypes)
        text = lambda name, default=None: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default).cast("string")
        rows = feedback.select("feedback_id", "tenant_id", "kind", "key", "outcome", text("context_key", "global").alias("context_key"), text("subject_id").alias("subject_id"), text("revision_key").alias("revision_key"), (F.col("occurred_at") if "occurred_at" in have else F.lit(None)).cast("timestamp").alias("occurred_at"))
        ep, r = self.store.read("episodes"), self.store.read("revisions")
        memories = ep.select(F.lit("episode").alias("kind"), F.col("memory_key").alias("key"), "subject_id", F.col("is_active").alias("visible"))
        if r is not None:
            memories = memories.unionByName(r.groupBy("memory_key", "subject_id").agg(F.bool_or(F.col("status") != "superseded").alias("visible")).select(F.lit("semantic").alias("kind"), F.col("memory_key").alias("key"), "subject_id", "visible"))
        wrong = L.invalid_targets(rows, memories, self.spark.createDataFrame([], "memory_key string, revision_key string") if r is None else r).first()
        if wrong is not None:
            raise ValueError(f"feedback {wrong['feedback_id']}: {wrong['problem']}")
        prints = rows.groupBy("feedback_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("tenant_id", "kind", "key", "outcome", "context_key")))), 256).alias("fingerprint"))
        stored = self.store.read("feedback")
        new = prints if stored is None else L.new_events(prints, stored.select("feedback_id", "fingerprint").distinct())
        rows = rows.join(new, "feedback_id")
        log = self.store.write("feedback", rows if stored is None else stored.unionByName(rows.select(stored.columns)))
        counted = L.counts(log, ["tenant_id", "context_key", "kind", "key"])
        return counted.withColumn("utility", L.utility(F.col("helpful"), F.col("unhelpful"), F.col("incorrect"), cfg))

    def associations(self, tenant_id: str, among: DataFrame | None = None, cfg: LearningConfig = LearningConfig()) -> DataFrame:
        """(left, right, n, strength): memories that were helpful together, both ends among ``among`` (kind, key) if given."""
        log = self.store.read("feedback").where((F.col("tenant_id") == tenant_id) & (F.col("outcome") == "helpful")).withColumn("memory", F.concat_ws("/", "kind", "key"))
        pairs = L.coactivation_pairs(log, "feedback_id", "memory", cfg)
        pairs = pairs if among is None else L.associations_within(pairs, among.select(F.concat_ws("/", "kind", "key").alias("memory")), "memory")
        return pairs.withColumn("strength", L.association_strength(F.col("n"), cfg)).orderBy("left", "right")

    def list_learning_state(self, tenant_id: str, context_key: str | None = None, cfg: LearningConfig = LearningConfig()) -> DataFrame:
        """Counts and utility of each memory, of all feedback without a context and of the given one's."""
        log = self.store.read("feedback").where(F.col("tenant_id") == tenant_id)
        states = L.combined_counts(L.counts(log, ["kind", "key", "context_key"]), ["kind", "key"], context_key or "global")
        return states.withColumn("utility", L.utility(F.col("helpful"), F.col("unhelpful"), F.col("incorrect"), cfg)).orderBy("kind", "key")

    def apply_forgetting(self, as_of: dt.datetime, cfg: ForgettingConfig = ForgettingConfig()) -> DataFrame:
        """Retention and state of every memory; episodes that a live fact rests on aren't forgotten, old traces are merged."""
        key = ["tenant_id", "kind", "key"]
        traces = self.store.read("traces")
        if traces is not None:
            before = F.lit(as_of - dt.timedelta(seconds=cfg.compact_after_seconds))
            merged = G.compact(traces.where(F.col("at") <= F.lit(as_of)), key, "at", "weight", before, F.lit(as_of), cfg, self.activation.decay).where(F.col("at") < before)
            kept = traces.where((F.col("at") >= before) | (F.col("at") > F.lit(as_of)))
            self.store.write("traces", kept.unionByName(merged.withColumn("request_id", F.lit(None).cast("string")).select(kept.columns)))
        c = self.candidates(as_of).where(F.col("created_at") <= F.lit(as_of))
        base = A.base_level(self._usage(c, as_of), key, "at", F.lit(as_of), "weight", self.activation)
        rows = c.join(base, key).withColumn("retention", G.retention_score(F.col("base_level"), F.col("importance"), cfg))
        before = self.store.read("dynamics")
        if before is None:
            rows = rows.withColumns({"prev_state": F.lit(None).cast("string"), "prev_since": F.lit(None).cast("timestamp"), "prev_forgotten_at": F.lit(None).cast("timestamp")})
        else:
            rows = rows.join(before.select(*key, F.col("state").alias("prev_state"), F.col("below_threshold_since").alias("prev_since"), F.col("forgotten_at").alias("prev_forgotten_at")), key, "left")
        rows = G.protected_by_support(rows, self._derivations())
        out = G.transitions(rows, "retention", F.lit(as_of), F.col("protected"), cfg)
        return self.store.write("dynamics", out.select(*key, "state", "retention", "base_level", "below_threshold_since", "forgotten_at", "reactivated"))

    def sleep(self, as_of: dt.datetime, cfg: ForgettingConfig = ForgettingConfig()) -> dict[str, int]:
        """Process what was ingested, then forget; the numbers of memories in each state."""
        self.process()
        return G.counters(self.apply_forgetting(as_of, cfg)).first().asDict()

    # -- lists ------------------------------------------------------------

    def list_observations(self, tenant_id: str, subject_id: str | None = None, limit: int | None = None) -> DataFrame:
        return I.scan(self.store.read("observations"), {"tenant_id": tenant_id, "subject_id": subject_id}, order=["observed_at", "source_namespace", "source_record_id"], limit=limit)

    def list_episodes(self, tenant_id: str, subject_id: str | None = None, include_inactive: bool = False, limit: int | None = None) -> DataFrame:
        active = None if include_inactive else F.col("is_active")
        return I.scan(self.store.read("episodes"), {"tenant_id": tenant_id, "subject_id": subject_id}, where=active, order=["started_at", "memory_key"], limit=limit)

    def list_semantic_memories(self, tenant_id: str, subject_id: str | None = None, statuses: list[str] | None = None, limit: int | None = None) -> DataFrame:
        now = C.current_projection(self.store.read("revisions"), ["tenant_id", "memory_key"])
        return I.scan(now, {"tenant_id": tenant_id, "subject_id": subject_id}, {"status": statuses}, order=["memory_key"], limit=limit)

    def list_semantic_revisions(self, tenant_id: str, memory_key: str | None = None, subject_id: str | None = None, valid_at: dt.datetime | None = None, limit: int | None = None) -> DataFrame:
        valid = None if valid_at is None else C.valid_at(F.col("valid_from"), F.col("valid_until"), F.lit(valid_at))
        return I.scan(self.store.read("revisions"), {"tenant_id": tenant_id, "memory_key": memory_key, "subject_id": subject_id}, where=valid, order=["memory_key", "revision_number"], limit=limit)

    def clear(self, tenant_id: str) -> None:
        """Delete all that is stored of a tenant."""
        for name in ("observations", "episodes", "revisions", "derivations", "traces", "dynamics", "feedback", "checkpoints"):
            table = self.store.read(name)
            if table is not None:
                self.store.write(name, T.clear_tenant(table, tenant_id))
