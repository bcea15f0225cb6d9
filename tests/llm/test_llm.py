"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows and extra columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mnemospark.llm import chat, mixing, packing, quality_classifier, quality_rules, simhash, textmodel, topk, toxicity, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, words string"
LABEL = "doc_id long, quality int, toxic int"


def texts(n=60, seed=1):
    r = random.Random(seed)
    vocab = ["the", "of", "Straße", "ÉTÉ", "data", "|", "a#b", "tion", "ing", "re", "x", "<>"]
    out = [" ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 5, 60, 200]))) for _ in range(n)]
    return out + [None, "", " \n\t ", "one", out[3], out[3], out[4] + " end", "line one\nline one\n\nline one\n x", "a b c a b c a b", "wor\u0000d   x", "z " * 20000, "y" * 50000]


def docs(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    data = [(i, t, [None, "en", "fr"][k % 3], [None, "s1", "s2", "s3"][k % 4], len(t or ""), "clash") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data + [(None, "no id here", "en", "s1", 1, "clash"), data[3]] if data else [], DOC)


# -- 4


def fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 2]) for i in range(len(w) - 1)] if len(w) > 1 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, most=6):
    fps = [fingerprint(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and (fps[i] ^ fps[j]).bit_count() <= most] for i in range(len(rows))]
    out, seen = {}, set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = set(), [i]
        while todo:
            k = todo.pop()
            if k not in group:
                group.add(k)
                todo += near[k]
        seen |= group
        least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
        out |= {k: least for k in group}
    return Counter((rows[i][0], f"{fps[i]:016x}", len(near[i]), out[i]) for i in range(len(rows)))


def test_simhash_equals_brute_force(spark):
    df = docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = Counter(tuple(r) for r in simhash.near_duplicates(df).collect())
    assert got == brute_components(rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    want = {c for (_, _, _, c) in brute_components(rows)}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(want)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_pairs_of_every_distance(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for d in range(1, 9):
            fps.add(b ^ sum(1 << k for k in r.sample(range(64), d)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = {frozenset((x, y)) for x in fps for y in fps if x != y and (x ^ y).bit_count() <= 6}
    # with few fingerprints allowed, keys are made longer by a second segment
    for heavy in (4096, 12, 0):
        got = Counter(frozenset((a & (1 << 64) - 1, b & (1 << 64) - 1)) for a, b in simhash.linked_pairs(df, heavy=heavy).collect())
        assert set(got) == want and set(got.values()) == {1}


# -- 5


def stats(text):
    text = text or ""
    w = WORD.findall(text)
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_one_row_of_each_component_stays_where_ids_repeat(spark):
    one, two, three, four = (" ".join(f"{w}{k}" for k in range(40)) for w in ("alpha", "beta", "gamma", "delta"))
    # 7 leads two components; 8 leads one and is a copy of 2 in another; 9 stands twice with one text
    rows = [(7, one), (7, two), (20, two), (8, three), (2, four), (8, four), (9, "x y z"), (9, "x y z"), (11, one)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(7, one), (7, two), (8, three), (2, four), (9, "x y z")])


def test_quality_statistics(spark):
    df = docs(spark)
    got = quality_rules.judge(df, spark.createDataFrame([], LABEL)).collect()
    want = Counter((r["doc_id"], *stats(r["text"])) for r in df.collect())
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    assert quality_rules.judge(docs(spark, []), spark.createDataFrame([], LABEL)).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(10, 0), (600, 0), (600, 2), (5000, 40), (100_000, 900), (100_000_000, 997_000)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), F.lit(0.01)).alias("p"))
    for r in df.collect():
        n, k = r["n"], r["k"]
        # every term, also of those that the operator leaves out as too small
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.01) + (n - i) * math.log(0.99)) for i in range(k + 1))
        assert r["p"] == pytest.approx(want, rel=1e-7 if n < 1e6 else 1e-5)


def test_certified_cutoffs_catch_the_bad_and_keep_the_good(spark):
    words = lambda k: " ".join(f"word{(k * 7919 + i) % 9973}" for i in range(60))
    rows = [(i, words(i) + (" # % |" * 10 if i % 10 == 0 else ""), "en", "s", 1, "c") for i in range(1500)]
    df, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame([(i, int(i % 10 != 0), None) for i in range(1500)] + [(3, None, None), (4, 0, None)], LABEL)
    kept = {r["doc_id"] for r in quality_rules.judge(df, labels).where("kept").collect()}
    assert kept == {i for i in range(1500) if i % 10}
    out = quality_rules.keep_good(df, labels)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == kept


# -- 10


def test_mixing(spark):
    df = docs(spark)
    rows = mixing.mix(df).collect()
    sizes = Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in df.collect())
    assert Counter((r["doc_id"], r["size"]) for r in rows) == sizes
    again = Counter(tuple(r) for r in mixing.mix(df.repartition(7)).collect())
    assert again == Counter(tuple(r) for r in rows)
    source = {(r["doc_id"], len(WORD.findall(r["text"] or ""))): r["source"] for r in df.collect()}
    per = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        p = per[source[r["doc_id"], r["size"]]]
        p[0], p[1], p[2], p[3] = p[0] + r["taken"], r["source_size"], r["target"], max(p[3], r["size"])
    assert sum(p[2] for p in per.values()) == pytest.approx(sum(p[1] for p in per.values()))
    # the dual by bisection: a document's copies are its rate, rounded; two of a source's may be mended by one
    for name in {v for v in source.values()}:
        mine = [r for r in rows if source[r["doc_id"], r["size"]] == name and r["size"]]
        if not mine:
            continue
        mean, target = sum(r["size"] for r in mine) / len([k for k in rows if source[k["doc_id"], k["size"]] == name]), mine[0]["target"]
        rate = lambda lam, r, mean=mean: min(3.0, math.exp(min(lam * r["size"] / mean, 9.0)))
        lo, hi = -1e4, 1e4
        for _ in range(300):
            lam = (lo + hi) / 2
            lo, hi = (lam, hi) if sum(rate(lam, r) * r["size"] for r in mine) < target else (lo, lam)
        off = [abs(r["taken"] / r["size"] - rate(lo, r)) for r in mine]
        assert sum(x >= 1 + 1e-6 for x in off) <= 3 and max(off) < 2 + 1e-6
    # copies are whole: a source whose words are mostly one document's can miss its target by half of that
    for taken, _, target, largest in per.values():
        assert taken == pytest.approx(target, rel=0.02, abs=0.5 * largest)
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.repeat(df).columns == df.columns


def test_mixing_steps_are_small_plans(spark, monkeypatch):
    seen = []

    def spy(df, label):
        if label in ("dual", "gaps"):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            seen.append((label, len(re.findall(r"\bJoin ", plan)), plan.count("Aggregate [")))
        return write(df, label)

    write = mixing.write
    monkeypatch.setattr(mixing, "write", spy)
    mixing.mix(docs(spark)).count()
    assert {label for label, _, _ in seen} == {"dual", "gaps"}
    # the driver holds each plan: a step has a join and an aggregation, whatever the number of steps
    assert max(joins for _, joins, _ in seen) == 1 and max(aggregates for _, _, aggregates in seen) == 1


def test_targets_by_hand(spark):
    df = spark.createDataFrame([("a", 10, 1, 1), ("b", 100, 1, 1), ("c", 90, 1, 1), (None, 0, 1, None)], "source string, source_size long, n long, least long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    # a is capped at 30, the empty source at 0; b and c share 170 by 2 to 1
    assert got == {"a": 30.0, None: 0.0, "b": pytest.approx(170 * 2 / 3), "c": pytest.approx(170 / 3)}


# -- 1, 9


def labelled(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice(["an", "er", "th", "on", "re"]) for _ in range(3))
    rows, labels = [], []
    for i in range(400):
        w = [word() for _ in range(80)]
        toxic, bad = i % 5 == 1, i % 7 == 1
        w = [x.upper() + "!!" for x in w] if bad else w
        w[10] = "awfulscum" if toxic else w[10]
        rows.append((i, " ".join(w), "en", "s", 1, "c"))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows + [(900, None, None, None, None, None), (None, "", "en", "s", 1, "c"), rows[0]], DOC), spark.createDataFrame(labels, LABEL), {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize("module,place,mod,rest,threshold", [(quality_classifier, 0, 4, 2, 0.7), (toxicity, 1, 5, 0, 0.5)])
def test_classifiers_on_held_out_rows(spark, module, place, mod, rest, threshold):
    df, labels, truth = labelled(spark)
    rows = module.score(df, labels).collect()
    assert len(rows) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]][place] for r in held) >= 0.95 * len(held)
    none = module.score(df, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}
    assert module.score(docs(spark, []), labels).count() == 0


def test_toxic_rows_go(spark):
    df, labels, truth = labelled(spark)
    out = toxicity.keep_clean(df, labels)
    kept = [r["doc_id"] for r in out.collect()]
    assert out.columns == df.columns and sum(truth.get(i, (0, 0))[1] for i in kept) <= 4 and len(kept) >= 315


def test_ngrams_of_many_words_are_those_of_each():
    words = ["a", "été", "", "longer-word", "\U0001f600x"]
    owner, ids = textmodel.hashed_ngrams(words, 3, 5, 18, whole=True)
    for k, w in enumerate(words):
        assert sorted(ids[owner == k]) == sorted(textmodel.hashed_ngrams([w], 3, 5, 18, whole=True)[1])


def plain_features(words, cfg):
    """A text's buckets, one for each occurrence, made word by word."""
    out = []
    for w in words:
        out += textmodel.hashed_ngrams([w], cfg.least_n, cfg.most_n, cfg.bits, whole=True)[1].tolist()
    for a, b in itertools.pairwise(words):
        out += textmodel.bigram_buckets(textmodel.word_hashes([a, b]), cfg.bits).tolist()
    return out + [1 << cfg.bits] * cfg.end_counts if words else []


def test_quality_training_and_scores_equal_a_plain_model():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    rows = [(" ".join(word() for _ in range(r.randint(1, 30))) + (" bad bad" if k % 4 == 0 else ""), int(k % 4 != 0)) for k in range(40)] + [("", 1)]
    cfg = quality_classifier.QualityConfig(bits=10, width=4, cache_words=20)
    rng = np.random.default_rng(cfg.seed)
    table = ((rng.random(((1 << cfg.bits) + 1, cfg.width), dtype=np.float32)) - 0.5) / cfg.width
    out, bias, step, steps = np.zeros((2, cfg.width)), np.zeros(2), 0, cfg.epochs * len(rows)
    table = table.astype(float)
    share = 10 / 41
    rare = max(1.0, cfg.rare_share / share * (1 - share) / (1 - cfg.rare_share))
    for _ in range(cfg.epochs):
        for k in rng.permutation(len(rows)):
            text, y = rows[k]
            ids = plain_features(text.split(), cfg)
            rate = cfg.rate * (1 - step / steps) * (rare if y == 0 else 1.0)
            step += 1
            mean = sum((table[i] for i in ids), np.zeros(cfg.width)) / max(len(ids), 1)
            z = out @ mean + bias
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            error = np.eye(2)[y] - p
            back = error @ out
            weights = Counter(ids)
            reach = sum((n / len(ids)) ** 2 for n in weights.values()) * max(1.0, float((out * out).sum()))
            out += rate / max(1.0, float(mean @ mean)) * np.outer(error, mean)
            bias += rate * error
            for i, n in weights.items():
                table[i] += rate * min(cfg.table_rate, 1 / reach) * n / len(ids) * back

    def plain(text):
        ids = plain_features(text.split(), cfg)
        z = (out @ (sum(table[i] for i in ids) / len(ids)) if ids else np.zeros(2)) + bias
        return float(1 / (1 + np.exp(z[0] - z[1])))

    asked = [t for t, _ in rows] + ["new words bad", "  ", "é " * 3000]
    score = quality_classifier.train(rows, cfg).scorer()
    # twice, and in two calls: the cache is emptied in between
    assert np.allclose(score(asked) + score(asked[::-1])[::-1], [plain(t) for t in asked] * 2, atol=1e-4)


def test_toxicity_scores_equal_a_plain_model():
    r = random.Random(13)
    rows = [(" ".join(r.choice(["Alpha", "beta", "gamma!", "delta", "foul", "ÉTÉ"][: 4 + 2 * (k % 3 == 0)]) for _ in range(20)), int(k % 3 == 0)) for k in range(60)]
    cfg = toxicity.ToxicityConfig(cache_words=3)
    model = toxicity.train(rows, cfg)

    def plain(text):
        there = {int(i) for w in set(text.lower().split()) for i in textmodel.hashed_ngrams([w], cfg.least_n, cfg.most_n, cfg.bits)[1]}
        return 1 / (1 + math.exp(-model.bias - sum(float(model.weight[i]) for i in there)))

    asked = [t for t, _ in rows] + ["", "unseen words", "foul " * 4000]
    score = model.scorer()
    assert np.allclose(score(asked) + score(asked[::-1])[::-1], [plain(t) for t in asked] * 2, atol=1e-6)
    assert all((s > 0.5) == y for s, (_, y) in zip(score(asked), rows))
    # weights stand on the ratios of texts with and without an n-gram
    ids = [set(textmodel.hashed_ngrams(list(set(t.lower().split())), cfg.least_n, cfg.most_n, cfg.bits)[1].tolist()) for t, _ in rows]
    for i in np.flatnonzero(model.weight)[:50]:
        toxic, other = sum(i in x for x, (_, y) in zip(ids, rows) if y), sum(i in x for x, (_, y) in zip(ids, rows) if not y)
        ratio = math.log((toxic + 0.5) / (20 + 1)) - math.log((other + 0.5) / (40 + 1))
        assert toxic + other >= cfg.least_texts and abs(ratio) >= cfg.least_ratio


# -- 6


def test_packing_round_trip(spark):
    df = docs(spark)
    rows = packing.pack(df).collect()
    cfg = packing.PackConfig()
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in df.collect():
        ids.setdefault(r["doc_id"], []).append(slow.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for r in rows:
        part = lambda x, r=r: struct.pack(f"<{r['length']}I", *x[r["start"] : r["start"] + r["length"]])
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(part(x)) == r["ids_crc32"] for x in ids[r["doc_id"]] if len(x) >= r["start"] + r["length"])
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert cfg.window - cfg.slack <= at <= cfg.window or at & (at - 1) == 0 and at < cfg.window
    assert packing.pack(docs(spark, [])).count() == 0


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, mine = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder(packing.PackConfig())
    r = random.Random(8)
    bits = ["a", "Zü", " ", "  ", "\n", "\t ", "don't", "<|endoftext|>", " <|endoftext|>", "<|endof", "\U0001f600", "ɐ", "1234", "...", "\u00a0", "\x85", "ß"]
    for text in ["a <|endoftext|> b", "<|endoftext|>", *("".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(3000))]:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_most_windows_are_filled_by_bin_slack():
    r = random.Random(9)
    counts = Counter(min(1023, int(r.expovariate(1 / 300)) + 1) for _ in range(5000))
    found = packing.patterns(counts, 1024)
    total = sum(n for _, n in found)
    filled = sum(n for used, n in found if sum(k * m for k, m in used.items()) >= 1008)
    assert filled >= 0.97 * total and Counter({k: sum(u.get(k, 0) * n for u, n in found) for k in counts}) == counts


def test_fill_is_the_best_subset_sum():
    r = random.Random(2)
    for _ in range(200):
        counts, cap = {r.randint(1, 30): r.randint(1, 3) for _ in range(5)}, r.randint(1, 80)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        used = packing.fill(counts, cap)
        assert sum(k * m for k, m in used.items()) == max(s for s in sums if s <= cap) and all(m <= counts[k] for k, m in used.items())


# -- 2


def test_topk_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-0.5, -0.1, 0.0, 0.3, 0.7]) for _ in range(3)], "c") for i in range(260)]
    rows += [(100, [0.7, 0.7, -0.5], "again"), (100, [0.7, 0.7, -0.5], "again"), (600, [], "c"), (300, None, "c"), (350, [float("nan"), 1.0, 1.0], "c"), (None, [1.0, 1.0, 1.0], "c"), (400, [0.5, None, 0.1], "c"), (450, [], "c"), (500, [1.0, 2.0], "c"), (550, [2.0, 1.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, words string")
    fine = [(k, i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for k, (i, v, _) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for q, i, v in fine:
        if i % 50 == 0:
            best = sorted((-int(v @ w), c) for p, c, w in fine if p != q and len(w) == len(v))[:5]
            want.update((i, n + 1, c, -s) for n, (s, c) in enumerate(best))
    for cfg in (topk.SearchConfig(), topk.SearchConfig(shard_rows=40, block_rows=2, leaf_rows=4, near=1)):
        assert Counter(tuple(x) for x in topk.search(df, cfg).collect()) == want
    assert topk.search(df.limit(0)).count() == 0


def test_topk_of_large_components_is_exact(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(-(10**7), 10**7, 8) + r.random(8)]) for i in range(101)] + [(200, [1e300] * 8), (201, [-3e18] * 8)]
    whole = {i: [max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * x))) for x in v] for i, v in rows}
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    want = set()
    for q in (0, 50, 100, 200):
        best = sorted((-clip(sum(a * b for a, b in zip(whole[q], w))), c) for c, w in whole.items() if c != q)[:5]
        want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    got = {tuple(x) for x in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), topk.SearchConfig(shard_rows=30, leaf_rows=4)).collect()}
    assert got == want and any(abs(x[3]) > 1 << 53 and x[3] % 2 for x in want)


def test_branch_and_bound_prunes_clustered_vectors(spark):
    r = np.random.default_rng(6)
    middles = r.normal(0, 4, (40, 16))
    x = np.floor(256 * (middles[r.integers(0, 40, 8000)] + r.normal(0, 0.2, (8000, 16)))).astype(np.int64)
    rows = np.arange(8000)
    tree = topk.BallTree(x, rows, rows, 64)
    q, found, scores = tree.search(x[::50], rows[::50], 5, np.full(160, -np.inf))
    every = x[::50] @ x.T
    for n in range(160):
        order = sorted((-int(s), int(i)) for i, s in enumerate(every[n]) if i != rows[::50][n])[:5]
        assert sorted((-int(s), int(i)) for s, i in zip(scores[q == n], found[q == n])) == order
    # two thirds and more of the products aren't made
    assert tree.seen < every.size / 3
    df = spark.createDataFrame([(int(i), [float(y) for y in v]) for i, v in zip(rows, x / 256)], "vec_id long, embedding array<double>")
    cfg = topk.SearchConfig(shard_rows=200)
    index = topk.Index(df, cfg)
    floor = {int(i): float(np.sort(np.delete(every[n], i))[-5]) for n, i in enumerate(rows[::50])}
    asked = index.rows.where("vec_id % 50 = 0").select("dim", "row", "vec_id", "v", F.create_map(*(F.lit(y) for kv in floor.items() for y in kv))[F.col("vec_id")].alias("floor"))
    shards = int(index.cells[16].shards.sum())
    assert shards >= 40 and index.send(asked, 1).count() + index.send(asked, 2).count() < 160 * shards / 4


# -- 3


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "same text " * 30
    rows = [(5, "http://a/1", long), (2, "http://a/2", long), (9, "u\r\nv", long), (1, "http://b", "short"), (3, "http://b", "short"), (4, None, None), (None, "http://c", long), (6, "http://é", "é" * 200000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, size string")
    got = Counter(tuple(r) for r in warc.round_trip(spark, df).collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter()
    for i, _, t in rows:
        again = t == long and i != 2
        want[i, len((t or "").encode()), sha(t), "revisit" if again else "response", 2 if again else None] += 1
    assert got == want
    files = warc.archive(df, f"file://{tmp_path}/w").collect()
    raw = open(files[0]["path"].removeprefix("file://"), "rb").read(8)
    assert struct.unpack("<I", raw[:4])[0] == warc.MAGIC and sum(f["records"] for f in files) == len(rows)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


# -- 7


def test_url_rules_and_parts(spark):
    rows = [("HTTP://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.net/de/", "example.net", "/de/", "net/", "block"), ("https://x.example.com/de/", "x.example.com", "/de/", "example.com/de/", "block"),
            ("http://w.org/fr/a", "w.org", "/fr/a", "org/fr/", "allow"), ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://net", "net", "", None, "allow"), ("http://É.org?q=/fr/", "É.org", "", None, "allow")]
    df = spark.createDataFrame([(k, r[0], None, "c") for k, r in enumerate(rows)], "page_id long, url string, html string, trust string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got == {k: r[1:] for k, r in enumerate(rows)}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_ties_repeats_and_long_pages(spark):
    # two rules of one length fit; the later one counts. A page that stands twice, and one with very many links
    cfg = url_filter.UrlConfig(rules=(("a.net", "/x/", "block"), ("net", "/x/y/", "allow")))
    far = "".join(f'<a href="http://t{k % 50}.test/{k}">' for k in range(30000))
    rows = [(1, "http://a.net/x/y/", None), (1, "http://a.net/x/y/", None), (2, "http://b.test/", far), (3, "http://q.net/x/y/z", "")]
    got = Counter((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), cfg).collect())
    assert got == {(1, "net/x/y/", "allow"): 2, (2, None, "allow"): 1, (3, "net/x/y/", "allow"): 1}


def test_distrust_flows_against_links(spark):
    link = '<a href="http://spam.example.net/de/">x</a>'
    rows = [(1, "http://farm.test/a", link * 3), (2, "http://spam.example.net/de/", ""), (3, "http://clean.test/", '<a href="//good.org/fr/">'), (4, "http://good.org/fr/", '<a href="http://clean.test/x">')]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def ranks_by_dense_solve(links, seeds, damping=0.85):
    """{host: rank} of personalised PageRank, by the linear system; hosts without links pass on to the seeds."""
    hosts = sorted({h for link in links for h in link[:2]} | set(seeds))
    at = {h: k for k, h in enumerate(hosts)}
    flow = np.zeros((len(hosts), len(hosts)))
    for a, b, weight in links:
        flow[at[b], at[a]] += weight / sum(x[2] for x in links if x[0] == a)
    share = np.array([seeds.get(h, 0.0) for h in hosts])
    for h in set(hosts) - {a for a, _, _ in links}:
        flow[:, at[h]] = share
    base = (1 - damping) * share
    return dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - damping * flow, base)))


def test_propagation_equals_dense_solve(spark):
    r = random.Random(3)
    cycle = [(f"c{k}", f"c{(k + 1) % 5}", 1.0) for k in range(5)]
    chain = [(f"d{k}", f"d{k + 1}", 1.0) for k in range(40)] + [("c2", "d0", 2.0), ("t2", "end", 1.0)]
    tangle = [(f"t{a}", f"t{b}", float(r.randint(1, 4))) for a in range(12) for b in r.sample(range(12), 3) if a != b]
    links = cycle + chain + [("c0", "t1", 1.0)] + tangle
    seeds = {"c0": 0.75, "t3": 0.25}
    known = 59
    got = url_filter.propagate(spark.createDataFrame(links, "src string, dst string, weight double"), spark.createDataFrame(list(seeds.items()), "host string, share double"), known, url_filter.UrlConfig())
    got = {x["host"]: x["rank"] for x in got.collect()}
    want = {h: x for h, x in ranks_by_dense_solve(links, seeds).items() if x}
    assert got.keys() == want.keys() and sum(abs(got[h] - want[h]) for h in want) * known < 1e-6


def test_distrust_reaches_hosts_far_from_a_seed(spark):
    n = 17
    page = lambda k: (k, f"http://h{k}.test/", f'<a href="http://h{k - 1}.test/">' if k > 1 else '<a href="http://spam.net/">')
    rows = [(0, "http://spam.net/", None)] + [page(k) for k in range(1, n)] + [(k, f"http://alone{k}.test/", None) for k in range(n, 60)]
    got = {r["page_id"]: (r["verdict"], r["distrust"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = sum(0.15 * 0.85**k for k in range(n))
    want = {k: 0.15 * 0.85**k / whole * 60 if k < n else 0.0 for k in range(60)}
    assert all(abs(got[k][1] - want[k]) < 1e-6 for k in want)
    assert {k for k in got if got[k][0] == "block"} == {k for k in want if want[k] > 0.4} and want[16] > 0.4


# -- 8


def test_chat_links_and_threads(spark):
    rows = [(1, 0, "user", "Hello there.\n\nSecond  paragraph"), (1, 1, "assistant", "> hello there.\nHi"), (1, 2, "user", ">> Hello there.\n> Hi\nFine\n> unknown text"), (1, 3, None, "alone"), (1, 4, "user", None), (2, 0, "user", "> Hi\nother talk"), (1, 5, "user", "> second paragraph\nlate"), (None, 1, "user", "> Hi"), (3, None, "user", "x")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, own string")
    got = {(r["conv_id"], r["turn"]): (r["text"], r["n_quotes"], r["n_linked"], r["reply_to"], r["thread"], r["depth"]) for r in chat.link(df).collect()}
    assert got[1, 1] == ("Hi", 1, 1, 0, 0, 1)
    assert got[1, 2] == ("Fine", 3, 2, 1, 0, 2)
    assert got[1, 3] == ("alone", 0, 0, None, 3, 0) and got[1, 4][0] == ""
    assert got[2, 0] == ("other talk", 1, 0, None, 0, 0) and got[1, 5] == ("late", 1, 1, 0, 0, 1)
    assert len(got) == 9 and chat.link(df.limit(0)).count() == 0


def linked_by_brute_force(rows):
    """{(conv, turn): (n_quotes, n_linked, reply_to)}: every run of own lines is compared with every passage."""
    own, asked = defaultdict(list), {}
    for c, t, text in rows:
        marks = [re.match(r"((?:[ \t]*>)*) ?(.*)", x, re.S) if re.match(r"[ \t]*>", x) else None for x in text.split("\n")]
        lines = [(m[1].count(">"), m[2]) if m else (0, x) for m, x in zip(marks, text.split("\n"))]
        words = [x.lower().split() for level, x in lines if level == 0]
        own[c].append((t, {tuple(sum(words[i:j], [])) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}))
        runs = [(level, tuple(" ".join(x for _, x in g).lower().split())) for level, g in itertools.groupby(lines, key=lambda x: x[0])]
        asked[c, t] = [(level, w) for level, w in runs if level and w]
    out = {}
    for (c, t), runs in asked.items():
        origins = [(level, max((u for u, said in own[c] if u < t and w in said), default=None)) for level, w in runs]
        known = [x for x in origins if x[1] is not None]
        out[c, t] = len(origins), len(known), max((u for level, u in known if level == min(known)[0]), default=None)
    return out


def linked(spark, rows):
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    return {(r["conv_id"], r["turn"]): (r["n_quotes"], r["n_linked"], r["reply_to"]) for r in chat.link(df).collect()}


def test_chat_links_runs_of_lines(spark):
    rows = [(1, 0, "hello"), (1, 1, "A1\nA2\n> hello\nB1\nB2"), (1, 2, "> A1\n> A2\n>> hello\n> B1\n> B2"), (2, 0, "p1 a\np1 b\n\np2\n\np3 a\np3 b\np3 c"), (2, 1, "> p1 a\n> P1  b\n>\n> p2"), (2, 2, "> p3 b\n> p3 c"), (2, 3, "> p2\n> p3 a p3 b\nok"), (2, 4, "> p1 a\n> p2"), (2, 5, "> b\n> p2"), (3, 0, "A1\n> x\nB1"), (3, 1, "> A1\n> B1")]
    got = linked(spark, rows)
    assert got == linked_by_brute_force(rows)
    assert got[1, 2] == (3, 3, 1) and got[2, 1] == (1, 1, 0) and got[2, 2] == (1, 1, 0) and got[2, 3] == (1, 1, 0) and got[3, 1] == (1, 1, 0)
    assert got[2, 4] == got[2, 5] == (1, 0, None)


def test_chat_equals_brute_force(spark):
    r, rows = random.Random(5), []
    for c in range(12):
        said = []
        for t in range(25):
            lines = []
            for _ in range(r.randint(1, 4)):
                if said and r.random() < 0.6:
                    old = r.choice(said)
                    i = r.randrange(len(old))
                    lines += ["> " * (not x.startswith(">")) + ">" * x.startswith(">") + (x.upper() if r.random() < 0.3 else x) for x in old[i : i + r.randint(1, 9)]]
                else:
                    lines += [" ".join(r.choice("abc") for _ in range(r.randint(0, 3))) for _ in range(r.randint(1, 6))]
            said.append(lines)
            rows.append((c, t, "\n".join(lines)))
    want = linked_by_brute_force(rows)
    assert sum(x[1] for x in want.values()) > 200 and sum(x[0] - x[1] for x in want.values()) > 20
    assert linked(spark, rows) == want


def test_chat_positions_follow_replies(spark):
    rows = [(1, 0, "a b c"), (1, 1, "other"), (1, 2, "> a b c\nd e"), (1, 9000, "> d e\nf"), (1, 5000, "> other\nyes"), (1, 9000, "twice"), (1, None, "no turn"), (None, 3, "no talk")]
    got = chat.link(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    assert {(r["turn"], r["thread"], r["position"]) for r in got if r["conv_id"] == 1 and r["turn"] is not None} == {(0, 0, 1), (2, 0, 2), (9000, 0, 3), (1, 1, 1), (5000, 1, 2)}


# -- all


def clashing(spark, df):
    """``df`` with columns that are called as the stages' own might be."""
    for name in ("row", "k1", "k2", "copy", "copies", "stratum", "s", "cutoffs", "__key", "__id", "__toxicity", "id", "fp", "h"):
        df = df.withColumn(name, F.lit(name))
    return df


def test_stages_with_clashing_names_nulls_and_no_rows(spark):
    df, labels, _ = labelled(spark)
    df = clashing(spark, df.where("doc_id < 60 or doc_id > 390 or doc_id is null"))
    nothing = df.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    df = df.unionByName(nothing).unionByName(nothing)
    labels = labels.unionByName(spark.createDataFrame([(5, None, None), (None, 1, 1)], LABEL))
    for stage in (lambda d, x: quality_rules.keep_good(d, x), lambda d, x: toxicity.keep_clean(d, x), lambda d, _: simhash.keep_one(d), lambda d, _: mixing.repeat(d)):
        out = stage(df, labels)
        assert out.columns == df.columns and out.count() > 0
        assert stage(df.limit(0), labels).count() == 0
    named = df.withColumn("doc_id", F.concat(F.lit("id "), F.col("doc_id").cast("string")))
    assert {r["doc_id"][:3] for r in simhash.keep_one(named).collect() if r["doc_id"]} == {"id "}


def test_copies_meet_targets_where_ids_repeat(spark):
    long = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    # one id stands in rows of unlike sizes and sources, and some rows are equal in everything
    rows = [(7, long(k, 10 + k), f"s{k % 3}") for k in range(60)] + [(8, long(99, 20), "s1")] * 12
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = lambda rs: {s: sum(len(t.split()) for _, t, x in rs if x == s) for s in ("s0", "s1", "s2")}
    copies = [tuple(r) for r in mixing.repeat(df).collect()]
    got = words(copies)
    targets = {r["source_size"]: r["target"] for r in mixing.mix(df).select("source_size", "target").distinct().collect()}
    for s, n in words(rows).items():
        assert got[s] == pytest.approx(targets[n], abs=20)
    assert all(n <= 3 * Counter(rows)[r] for r, n in Counter(copies).items())


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "toxicity", "simhash", "mixing", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())

    def run(name, df):
        out = stages[name](spark, df, sf)
        assert name == "packing" or out.columns == docs.columns
        return spark.createDataFrame(out.collect(), out.schema)

    good = run("quality_rules", docs)
    fine = {r["doc_id"]: (x := stats(r["text"]))[0] >= 50 and 100 * x[4] <= 50 * x[0] for r in docs.collect()}
    # so few labels certify no cutoff, which leaves the base rules
    assert ids(good) == Counter(i for i, ok in fine.items() if ok)
    clean = run("toxicity", good)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert ids(clean) == Counter(r["doc_id"] for r in toxicity.score(good, labels).where("predicted = 0").collect())
    one = run("simhash", clean)
    assert ids(one) == Counter({c for (_, _, _, c) in brute_components([(r["doc_id"], r["text"]) for r in clean.collect()])})
    mixed = run("mixing", one)
    taken = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(one).collect()})
    assert ids(mixed) == +taken and max(taken.values()) <= 3
    packed = run("packing", mixed).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    assert sum(r["length"] for r in packed) == sum(len(encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert max(r["offset"] + r["length"] for r in packed) <= 1024


def test_pipeline_runs(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns[:2] == ["doc_id", "start"]
