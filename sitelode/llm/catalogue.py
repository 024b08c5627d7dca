"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from .decontaminate import op6_decontaminate
from .extract import op12_html_extraction
from .jaccard import op2_jaccard_join
from .langid import op10_language_id
from .merkle import op13_merkle_manifest
from .negatives import op11_hard_negatives
from .pieces import op8_sentencepiece
from .records import op7_token_records
from .sharding import op1_sharding
from .toxicity import op9_toxicity
from .substrings import op5_substring_dedup
from .suffixes import op3_suffix_dedup
from .topk import op4_top_k

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_top_k": op4_top_k,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_records": op7_token_records,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_html_extraction": op12_html_extraction,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def _crc_table() -> list[int]:
    """The table of the reflected polynomial 0xEDB88320, by its rule."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32_sql(blob: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a BLOB expression."""
    pairs = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda p: CAST('0x' || p AS BIGINT))"
    step = f"lambda c, b: xor(c >> 8, (CAST({_crc_table()} AS BIGINT[]))[1 + (xor(c, b) & 255)])"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {pairs}), {step}), CAST(4294967295 AS BIGINT))"


_OP1 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k,
    strlen(coalesce(text, '')) + 16 AS size, {crc32_sql("encode(coalesce(text, ''))")} AS text_crc32
  FROM documents
), draws AS (
  SELECT r, s, CAST('0x' || substr(md5(k || ':' || CAST(s AS VARCHAR)), 1, 13) AS BIGINT) AS u FROM d, range(0, 41) AS t(s)
), won AS (
  SELECT r, arg_max(s, u * 64 + (63 - s)) FILTER (s < 40) AS shard, arg_max(s, u * 64 + (63 - s)) AS grown FROM draws GROUP BY r
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(k || ':' || text_crc32 || ':' || size), 1, 13) AS BIGINT), doc_id, text_crc32, size) - 1 AS slot,
  CAST(grown AS INTEGER) AS grown_shard
FROM d JOIN won USING (r)
"""

_OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

_OP11 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.r, v.vec_id, v.label = a.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, e) = 1) AS a JOIN v ON a.vec_id <> v.vec_id AND len(a.e) = len(v.e)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank FROM s WHERE same QUALIFY positive_rank <= 5
)
SELECT anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_rank ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, CAST(positive_rank AS INTEGER) AS positive_rank
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""

_OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, i + j AS p FROM win JOIN least USING (k), range(0, 13) AS t(j) WHERE first < doc_id),
g AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""

_OP2 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9]|[^\x00-\x7F])+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
link AS (SELECT x, y FROM c JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 5 * shared >= 4 * (p.n + q.n - shared)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT d.doc_id, coalesce(least(d.doc_id, (SELECT min(e.doc_id) FROM reach JOIN d e ON e.r = reach.y WHERE reach.x = d.r)), d.doc_id) AS class_id,
  (SELECT count(*) FROM link WHERE link.x = d.r) AS n_links
FROM d
"""

_OP3 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM (SELECT r, doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
least AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
cov AS (SELECT r, i FROM win JOIN least USING (k) WHERE first < doc_id),
gap AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM cov),
isle AS (SELECT r, min(i) AS lo, max(i) + 50 AS hi FROM (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM gap) GROUP BY r, g),
part AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since FROM isle),
kept AS (SELECT r, CAST(sum(hi - lo) AS BIGINT) AS removed, count(*) AS spans, max(hi) AS done, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS front FROM part JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE front || substr(h, 2 * done + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""



def _op13(levels: int = 6, over: int = 3) -> str:
    """The manifest for languages of up to 8**levels rows, and 8**over languages."""
    framed = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(framed, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    third = f"doc_id IS NOT NULL AND {crc32_sql('encode(CAST(doc_id AS VARCHAR))')} % 3 = 0"
    out = [
        f"d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {third} THEN {leaf(lower)} END AS altered FROM documents)",
        "w0 AS (SELECT *, coalesce(altered, leaf) AS cur, '' AS proof, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d)",
        "m0 AS (SELECT lang, p, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM w0)",
    ]

    def climb(k: int, m: str, group: str, same: str) -> None:
        run = f"{group}p // 8 ORDER BY p ROWS BETWEEN"
        out.append(f"s{k} AS (SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (PARTITION BY {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {m})")
        out.append(f"w{k + 1} AS (SELECT w.* EXCLUDE (cur, proof, p), CASE WHEN n > 1 THEN sha256(l || cur || r) ELSE cur END AS cur, proof || l || r AS proof, w.p // 8 AS p FROM w{k} AS w JOIN s{k} AS s ON w.p = s.p {same})")
        out.append(f"m{k + 1} AS (SELECT {group}p // 8 AS p, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE min(h) END AS h, (any_value(n) + 7) // 8 AS n FROM {m} GROUP BY {group}p // 8)")

    for k in range(levels):
        climb(k, f"m{k}", "lang, ", "AND w.lang IS NOT DISTINCT FROM s.lang")
    out.append(f"u AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM m{levels})")
    k = levels + 1
    out.append(f"w{k} AS (SELECT w.* EXCLUDE (p), u.p, u.h AS subroot FROM w{levels} AS w JOIN u ON w.lang IS NOT DISTINCT FROM u.lang)")
    for i in range(over):
        climb(k + i, "u" if not i else f"m{k + i}", "", "")
    end = k + over
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM w{end}, m{end}"


ORACLE_SQL: dict[str, str] = {"op1_sharding": _OP1, "op2_jaccard_join": _OP2, "op3_suffix_dedup": _OP3, "op4_top_k": _OP4, "op5_substring_dedup": _OP5, "op11_hard_negatives": _OP11, "op13_merkle_manifest": _op13()}
