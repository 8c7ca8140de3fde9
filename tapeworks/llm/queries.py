"""The queries of this subpackage for the driver: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, conversations, decontamination, embeddings, language_id, minhash, negatives, packing, pieces, pii, secrets, sharding, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeats(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("key")


def op6_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some labels are moved on first, so that rows alike are of other labels too."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_substring_dedup, op3_sharding, op4_pii, op5_minhash_near_dedup, op6_embedding_near_dup, op7_secret_scans, op8_token_counts, op9_best_fit_packing, op10_language_id, op11_sentencepiece, op12_hard_negatives, op13_conversation_repair)}


#: Weighted Jaccard similarity of all pairs of documents that share a shingle, and what links of 0.8 reach.
NEAR = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
shingles AS (SELECT doc_id, array_to_string(w[k : k + least(5, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM words WHERE len(w) > 0)),
counted AS (SELECT doc_id, s, count(*) AS n FROM shingles GROUP BY ALL),
sizes AS (SELECT doc_id, sum(n) AS n FROM counted GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS n FROM counted x JOIN counted y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE shared.n >= 0.8 * (p.n + q.n - shared.n)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
tops AS (SELECT a AS doc_id, min(b) AS cluster_id FROM reach GROUP BY a)
SELECT doc_id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size, doc_id = cluster_id AS kept FROM tops"""

#: Cosines of all pairs of a label.
COSINES = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE list_dot_product(x, x) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
tops AS (SELECT a, min(b) AS top FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT t.a AS vec_id, coalesce(c.n, 0) AS n_links, t.top AS component_id, t.a = t.top AS kept FROM tops t LEFT JOIN counts c ON c.a = t.a"""


#: Integer scores of each anchor with all rows; an anchor's positives, and the negatives in the window of each.
NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS own, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.own AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 3"""


def _repair_sql() -> str:
    """From a conversation's end to its beginning: for each state the least (cost, audit, repaired text) of the rest."""
    into = {0: 2, 1: 2, 2: 3, 3: 2}
    role = {2: "user", 3: "assistant"}

    def best(options: list[str]) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def put(cost: str, letter: str, shown: str, rest: str) -> str:
        return f"{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 't': {shown} || chr(10) || {rest}.t}}"

    def inserted(names: list[str]) -> list[str]:
        return [best([names[q], put("5", "I", f"'{role[into[q]]}:'", names[into[q]])]) for q in range(4)]

    def taken(q: int) -> str:
        options = [f"{{'c': b{q}.c + 2, 'a': 'D' || b{q}.a, 't': b{q}.t}}"]
        far = "{'c': 1000000000, 'a': '~', 't': ''}"
        options.append(f"CASE WHEN NOT must THEN {put('1 + cut', 'R', f"'{role[into[q]]}:' || text", f'b{into[q]}')} ELSE {far} END")
        for initial, after in {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[q].items():
            options.append(f"CASE WHEN NOT must AND initial = '{initial}' THEN {put('cut', 'K', "role || ':' || text", f'b{after}')} ELSE {far} END")
        return best(options)

    nested = "took"
    for _ in range(3):
        nested = f"(SELECT conv, k, {', '.join(f'{x} AS b{q}' for q, x in enumerate(inserted(['b0', 'b1', 'b2', 'b3'])))} FROM {nested})"
    rows = f"(SELECT r.conv, r.k, {', '.join(f'{taken(q)} AS b{q}' for q in range(4))} FROM rest x JOIN numbered r ON r.conv = x.conv AND r.k = x.k - 1)"
    none = "{'c': 0, 'a': '', 't': ''}"
    start = nested.replace("took", f"(SELECT conv, n + 1 AS k, {none} AS b0, {{'c': 1000000000, 'a': '~', 't': ''}} AS b1, {{'c': 1000000000, 'a': '~', 't': ''}} AS b2, {none} AS b3 FROM sizes)")
    return rf"""
WITH RECURSIVE bits AS (SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
shown AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
hashed AS (SELECT conv, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM shown, bits),
damaged AS (SELECT conv, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS k FROM damaged),
faulty AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY k) AS before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
             WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
numbered AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS cut FROM faulty),
sizes AS (SELECT conv, count(*) AS n FROM numbered GROUP BY conv),
rest AS ({start} UNION ALL {nested.replace('took', rows)}),
counted AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM numbered GROUP BY conv)
SELECT c.conv_id, CAST(coalesce(n.gaps, 0) AS BIGINT) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
  CAST(coalesce(r.b0.c, 0) AS BIGINT) AS cost, coalesce(r.b0.a, '') AS audit, sha256(coalesce(left(r.b0.t, length(r.b0.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted n ON n.conv IS NOT DISTINCT FROM c.conv_id LEFT JOIN rest r ON r.conv IS NOT DISTINCT FROM c.conv_id AND r.k = 1"""


def _secrets_sql() -> str:
    """All matches of each rule; what stands between them gives their places."""
    quote = lambda p: p.replace("'", "''")
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
    value = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
    patterns = [assign if r.kind == "assign" else r.pattern for r in secrets.RULES]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS r, '{rule.kind}' AS kind, regexp_extract_all(t, '(?s)(.*?)({quote(p)})', 1) AS g, regexp_extract_all(t, '(?s)(.*?)({quote(p)})', 2) AS m FROM d" for k, (rule, p) in enumerate(zip(secrets.RULES, patterns, strict=True))
    )
    joined = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, r){}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS ({found}),
s AS (SELECT doc_id, r, kind, unnest(range(1, len(m) + 1)) AS j, g, m FROM k),
p AS (SELECT doc_id, r, kind, m[j] AS x, list_sum(list_transform(g[1 : j], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1 : j - 1], lambda y: length(y))), 0) AS a FROM s),
q AS (SELECT doc_id, r, kind, CAST(a AS BIGINT) AS a, CAST(a + length(x) AS BIGINT) AS b FROM p
      WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(x, '{quote(value)}', 1)) >= 6 WHEN 'access' THEN length(x) >= 20 ELSE true END)
SELECT d.doc_id, {counts}, sha256({joined.format(f" FILTER (r < {len(secrets.BASE)})")}) AS base_sha256, {joined.format("")} AS spans FROM d LEFT JOIN q ON q.doc_id = d.doc_id GROUP BY d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL of those that it can express; the others are held against brute force in the tests."""
    return {"op5_minhash_near_dedup": NEAR, "op6_embedding_near_dup": COSINES, "op7_secret_scans": _secrets_sql(), "op12_hard_negatives": NEGATIVES, "op13_conversation_repair": _repair_sql()}
