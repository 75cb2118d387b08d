"""The operators' queries over whole tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import brown_lm, embed_dedup, fill_middle, mixing, order_minhash, piece_codec, prefix_trie, quality, repeat_spans, secret_scan, token_counts, top_k, url_filter
from wayloom.llm.common import materialize, read, shared_dir

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_codec.encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_pieces", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex[:12]}"  # an empty cache: each run is measured in full
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), cache)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(read(spark, sf_dir, "pages"), URL_RULES)


def op4_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_spans.remove_repeats(read(spark, sf_dir, "documents"), with_text=False)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.ledger(read(spark, sf_dir, "documents"))).drop("n_lines")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_classes(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), written=lambda df: materialize(df, "sizes")).drop("packets")


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.lm_scores(read(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(read(spark, sf_dir, "conversations"))))
    return prefix_trie.with_ends(nodes, ends)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    whole = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS l
  FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
keyed AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM win),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM keyed) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)),
f AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 32 ELSE 0 END) AS BIGINT) AS failures
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures, 'v1' AS policy, failures & 3 <> 0 AS base_failed, failures = 0 AS kept FROM f
"""


_MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, CAST(source_size AS DOUBLE) AS source_size, CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT)) AS DOUBLE) AS weight FROM s),
c AS (SELECT *, 2 * source_size AS cap, 1.5 * sum(source_size) OVER () AS total, sum(weight) OVER () AS weight_all FROM w),
b AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before FROM c
  WINDOW o AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (total - cap_before) / (weight_all - weight_before) AS level, cap <= (total - cap_before) / (weight_all - weight_before) * weight AS is_full FROM b),
g AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE max(CASE WHEN NOT is_full THEN level END) OVER () * weight END AS target FROM f),
q AS (
  SELECT doc_id, d.source, size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source),
r AS (SELECT *, row_number() OVER () AS i, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS name FROM q),
k AS (SELECT i, name, size AS words, (before + n * source_size + size) / nullif(target, 0) AS finish, before + n * source_size AS b FROM r, (VALUES (0), (1)) v(n) WHERE size > 0),
o AS (SELECT i, words, coalesce(sum(words) OVER (ORDER BY finish, name, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM k WHERE finish IS NOT NULL),
m AS (SELECT CAST(round(1.5 * sum(size)) AS BIGINT) AS most FROM r),
e AS (SELECT i, sum(greatest(0, least(words, most - spent))) AS taken FROM o, m GROUP BY i)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, source FROM r LEFT JOIN e USING (i)
"""


def _url_sql(rules: list[tuple[str, str]], depth: int = 4, least: int = 5, z: float = 2.58, smoothing: float = 4.0, purity: float = 0.5) -> str:
    cases = []
    for verdict, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        cases.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')", text, verdict))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in cases) + " END"
    label = "CASE rule " + " ".join(f"WHEN '{t}' THEN '{v}'" for _, t, v in cases) + " END"
    m = f"CAST({smoothing} AS DOUBLE)"
    sql = f"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {rule} AS rule FROM u),
q AS (SELECT *, {label} AS label, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM r),
h0 AS (SELECT host, count(label) AS k, count(*) FILTER (label = 'block') AS b, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS domain FROM q GROUP BY host),
c0 AS (SELECT coalesce(sum(b) / nullif(sum(k), 0), 0) AS share FROM h0),
g0 AS (SELECT domain, CASE WHEN sum(k) > 0 THEN (sum(b) + {m} * any_value(share)) / (sum(k) + {m}) ELSE 0 END AS above FROM h0, c0 GROUP BY domain),
p0 AS (SELECT q.*, '' AS template, k AS labelled, b AS blocked, (b + {m} * above) / (k + {m}) AS score FROM q JOIN h0 USING (host) JOIN g0 USING (domain))"""
    for d in range(depth):
        seg = f"segs[{d + 1}]" if d < depth - 1 else f"nullif(array_to_string(segs[{depth}:], '/'), '')"
        sql += f""",
s{d} AS (SELECT *, {seg} AS seg FROM p{d}),
n{d} AS (SELECT host, template, seg, count(label) AS k, count(*) FILTER (label = 'block') AS b FROM s{d} WHERE seg IS NOT NULL GROUP BY ALL),
t{d} AS (SELECT *, CAST(floor(32 * b / k) AS INTEGER) AS bin FROM n{d} WHERE k >= {least}),
b{d} AS (SELECT host, template, bin, sum(k) AS k, sum(b) AS b, count(*) AS many FROM t{d} GROUP BY ALL),
l{d} AS (SELECT *, lag(k) OVER w AS k0, lag(b) OVER w AS b0 FROM b{d} WINDOW w AS (PARTITION BY host, template ORDER BY bin)),
a{d} AS (SELECT *, CASE WHEN b / k - b0 / k0 > {z} * sqrt((b + b0) / (k + k0) * (1 - (b + b0) / (k + k0)) * (1 / k + 1 / k0)) THEN 1 ELSE 0 END AS apart FROM l{d}),
c{d + 1} AS (SELECT *, CAST(sum(apart) OVER (PARTITION BY host, template ORDER BY bin) AS BIGINT) AS cluster FROM a{d}),
e{d} AS (SELECT *, max(cluster) OVER (PARTITION BY host, template) AS clusters, sum(many) OVER (PARTITION BY host, template, cluster) AS together FROM c{d + 1}),
k{d} AS (SELECT t.host, t.template, t.seg, CASE WHEN together = 1 THEN seg ELSE '*' || cluster END AS step FROM t{d} t JOIN e{d} e ON e.host = t.host AND e.template = t.template AND e.bin = t.bin WHERE clusters > 0),
f{d} AS (SELECT host, template, seg, k, b, coalesce(step, '*') AS step FROM n{d} LEFT JOIN k{d} USING (host, template, seg)),
o{d} AS (SELECT host, template, step, CAST(sum(k) AS BIGINT) AS sk, CAST(sum(b) AS BIGINT) AS sb FROM f{d} GROUP BY ALL),
p{d + 1} AS (
  SELECT page_id, s.host, path, rule, label, segs, CASE WHEN s.seg IS NULL THEN s.template ELSE s.template || '/' || o.step END AS template, CASE WHEN s.seg IS NULL THEN labelled ELSE sk END AS labelled,
    CASE WHEN s.seg IS NULL THEN blocked ELSE sb END AS blocked, CASE WHEN s.seg IS NULL THEN score ELSE (sb + {m} * score) / (sk + {m}) END AS score
  FROM s{d} s LEFT JOIN f{d} f ON f.host = s.host AND f.template = s.template AND f.seg = s.seg LEFT JOIN o{d} o ON o.host = f.host AND o.template = f.template AND o.step = f.step)"""
    return sql + f"""
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN score >= {purity} THEN 'block' ELSE 'allow' END) AS verdict, template, CAST(labelled AS BIGINT) AS template_labelled,
  CAST(blocked AS BIGINT) AS template_blocked, CAST(score AS DOUBLE) AS template_score FROM p{depth}"""


#: crc32 bit by bit: each byte goes in, then eight shifts.
_TRIE_SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), CAST(4294967295 AS BIGINT)) % 4 AS h FROM ids),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
k AS (SELECT h.c, h, base, least(h, coalesce(b.n, 0)) AS k FROM h LEFT JOIN n b ON b.c = base),
r AS (SELECT k.c, t.pos AS d, role, text FROM k JOIN t ON t.c = base AND t.pos <= h UNION ALL SELECT k.c, k + pos - h, role, text FROM k JOIN t ON t.c = k.c AND pos > h),
p AS (
  SELECT c, CAST(d AS BIGINT) AS d, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS key,
    len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM r
  UNION ALL SELECT c, 0, '', 0 FROM ids),
m AS (SELECT d, key, min(c) AS owner, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY d, key),
e AS (SELECT p.c, p.key, p.d FROM p JOIN (SELECT c, max(d) AS d FROM p GROUP BY c) z USING (c, d)),
ends AS (SELECT d, key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM e GROUP BY d, key),
up AS (SELECT d, key, owner, n_convs, words, substr(key, 1, 32 * (d - 1)) AS above FROM m),
kids AS (SELECT d - 1 AS d, above AS key, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT a.d, a.key, sum((b.n_convs - 1) * b.words) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
  FROM m b LEFT JOIN kids ON kids.d = b.d AND kids.key = b.key JOIN p a ON a.c = b.owner AND a.d <= b.d GROUP BY a.d, a.key)
SELECT m.owner AS conv_id, m.d AS depth, parent.owner AS parent_conv_id, m.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM m JOIN up ON up.d = m.d AND up.key = m.key LEFT JOIN m parent ON parent.d = m.d - 1 AND parent.key = up.above LEFT JOIN kids ON kids.d = m.d AND kids.key = m.key
JOIN below ON below.d = m.d AND below.key = m.key LEFT JOIN ends ON ends.d = m.d AND ends.key = m.key
"""


_FILL_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1, h2) AS a, greatest(h1, h2) AS z, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, z - a) AS m, substring(t, z + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""


_TOP_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) x WHERE rank <= 20
"""


def queries() -> dict:
    found = [op1_pieces, op2_token_counts, op3_url_filter, op4_repeat_spans, op5_secret_scan, op6_quality_rules, op7_order_minhash, op8_mixing, op9_brown_lm, op10_embedding_dedup, op11_prefix_trie, op12_fill_middle, op13_top_k, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": _url_sql(URL_RULES), "op6_quality_rules": _QUALITY_SQL, "op8_mixing": _MIXING_SQL, "op11_prefix_trie": _TRIE_SQL, "op12_fill_middle": _FILL_SQL, "op13_top_k": _TOP_SQL}
