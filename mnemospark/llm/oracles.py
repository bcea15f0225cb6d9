"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others (trained models, XXH64 fingerprints, tokenizers, Newton and
PageRank iterations, reply threads) are held against brute force in tests.
"""

from __future__ import annotations

from .quality_rules import RULES, RiskConfig

TOPK = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(CASE WHEN len(q.v) = 0 THEN 0 ELSE list_dot_product(q.v, c.v) END AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""

WARC = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, n >= 100 AND page_id <> min(page_id) OVER (PARTITION BY d) AS again, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM f"""

_SPACE = "[\\x20\\x09-\\x0D]"


def _quality(cfg: RiskConfig = RiskConfig()) -> str:
    rules = list(RULES)
    metrics = {
        "symbols": "CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END",
        "dup_lines": "CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END",
        "repeats": "CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END",
        "long_words": "CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END",
        "short_words": "CASE WHEN n_words > 0 THEN -(word_chars * 100 // n_words) ELSE 0 END",
    }
    p, d = cfg.alpha / len(rules), cfg.delta / len(rules)
    out = f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS x FROM documents),
w AS (SELECT rid, doc_id, lang, x, list_filter(regexp_split_to_array(x, '{_SPACE}+'), lambda a: a <> '') AS w, list_filter(string_split(x, chr(10)), lambda a: regexp_matches(a, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 3)),
h AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM h, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
b AS (SELECT w.rid, doc_id, coalesce('=' || lang, 'null') AS st, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r ON r.rid = w.rid),
m AS (SELECT *, n_words < {cfg.least_words} OR 100 * n_repeat_words > {cfg.repeat_percent} * n_words AS base_failed, {", ".join(f"{sql} AS m_{r}" for r, sql in metrics.items())} FROM b),
q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1),
u0 AS (SELECT m.*, quality = 1 AS good, false AS caught FROM m JOIN q USING (doc_id) WHERE NOT base_failed),
ns AS (SELECT count(DISTINCT st) AS strata FROM u0)"""
    for i, r in enumerate(rules):
        out += f""",
c{i} AS (SELECT st, m_{r} AS m, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE NOT good) AS bad, count(*) FILTER (WHERE good AND NOT caught) AS ng, count(*) FILTER (WHERE NOT good AND NOT caught) AS nb FROM u{i} GROUP BY 1, 2),
a{i} AS (SELECT st, m, sum(good) OVER f AS k, sum(ng) OVER f AS lost, sum(nb) OVER f AS hit, sum(good) OVER (PARTITION BY st) AS n, sum(bad) OVER (PARTITION BY st) AS n_bad FROM c{i} WINDOW f AS (PARTITION BY st ORDER BY m DESC)),
x{i} AS (SELECT st, m, hit / n_bad - lost / n AS gain FROM a{i}, ns WHERE n > 0 AND n_bad > 0 AND hit / n_bad - lost / n > 0 AND k <= n * {p}
 AND list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p})))) <= {d} / strata),
k{i} AS (SELECT st, arg_max(m, (gain, m)) AS cut FROM x{i} GROUP BY 1),
u{i + 1} AS (SELECT u{i}.* REPLACE (caught OR coalesce(m_{r} >= cut, false) AS caught) FROM u{i} LEFT JOIN k{i} USING (st))"""
    joins = " ".join(f"LEFT JOIN k{i} ON k{i}.st = m.st" for i in range(len(rules)))
    reject = " OR ".join(f"coalesce(m_{r} >= k{i}.cut, false)" for i, r in enumerate(rules))
    return out + f" SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT ({reject}) AS kept FROM m {joins}"


ORACLES: dict[str, str] = {"op2_topk": TOPK, "op3_warc": WARC, "op5_quality_rules": _quality()}
