"""The registered queries of the subpackage, each over its whole table, and their SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetsift.llm import divergence, exact, graph, langid, mixing, packing, pii, quality, secrets, simhash, substring, tokens, trie
from fleetsift.llm.common import documents
from fleetsift.plans.registry import query

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(u, v) AS (SELECT u, v FROM link UNION SELECT reach.u, link.v FROM reach JOIN link ON link.u = reach.v)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, e.vec_id <= coalesce(m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT u, count(*) AS n FROM link GROUP BY u) l ON l.u = e.vec_id LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) c ON c.u = e.vec_id
"""


@query("op1_embedding_near_dedup", OP1_SQL)
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS j FROM late),
words AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS j, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, count(gone.j) AS n, string_agg(word, ' ' ORDER BY j) FILTER (gone.j IS NULL) AS body FROM words LEFT JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op2_substring_dedup", OP2_SQL)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


OP4_SQL = """
WITH RECURSIVE
d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS k FROM documents),
-- A weight is a double of 1 at least: times two to the 52nd it is a whole number.
n AS (SELECT k, n, (n + 63) // 64 AS need, row_number() OVER (ORDER BY k) AS j, (pow(n::DOUBLE, 0.8) * 4503599627370496)::HUGEINT AS w FROM (SELECT k, count(*) AS n FROM d GROUP BY k)),
al AS (SELECT list(w ORDER BY j) AS ws, list(need ORDER BY j) AS needs, sum(w)::HUGEINT AS total FROM n HAVING count(*) > 0),
-- One slot a step: the released block with the earliest deadline, ties by name; a code holds deadline and source.
s(t, done, j) AS (
  SELECT -1::BIGINT, list_transform(ws, lambda v: 0::HUGEINT), 0::HUGEINT FROM al
  UNION ALL
  SELECT t + 1, list_transform(done, lambda v, i: CASE WHEN i = c % 1000000 THEN v + 1 ELSE v END), c % 1000000
  FROM (SELECT t, done, list_min(list_transform(list_filter(range(1, len(ws) + 1), lambda j: (done[j] * total) // ws[j] <= t + 1),
        lambda j: (((done[j] + 1) * total + ws[j] - 1) // ws[j]) * 1000000 + j)) AS c
        FROM s, al WHERE len(list_filter(range(1, len(ws) + 1), lambda j: done[j] < needs[j])) > 0)
),
p AS (SELECT j, t AS slot, row_number() OVER (PARTITION BY j ORDER BY t) - 1 AS i FROM s WHERE t >= 0),
g AS (SELECT k, j, n, 64 * count(*) AS total FROM n JOIN p USING (j) GROUP BY k, j, n),
r AS (SELECT doc_id, source, k, row_number() OVER (PARTITION BY k ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS rk FROM d),
e AS (SELECT doc_id, source, j, n, rk, unnest(range(0, (total - 1 - rk) // n + 1)) AS epoch FROM r JOIN g USING (k)),
q AS (SELECT *, rk + epoch * n AS nth FROM e)
SELECT doc_id, source, epoch::INTEGER AS epoch, slot, slot * 64 + nth % 64 AS position FROM q JOIN p ON p.j = q.j AND p.i = nth // 64
"""


@query("op4_pfair_mixing", OP4_SQL)
def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "source"))


@query("op5_exact_dedup", OP5_SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op7_personal_data")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir)).withColumn("base", F.filter("found", lambda s: s["strict"]))
    return found.select(
        "doc_id",
        *[_count_kind(i).alias(f"n_{pii.KINDS[i]}") for i in range(4)],
        F.sha2(F.array_join(F.transform("base", _kind_and_place), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", _kind_and_place), ",").alias("spans"),
    )


def _kind_and_place(span: F.Column) -> F.Column:
    return F.concat_ws(":", F.array(*[F.lit(k) for k in pii.KINDS])[span["kind"]], span["start"], span["end"])


def _count_kind(kind: int) -> F.Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def _rule_sql(kind: int, rule: secrets.Rule) -> str:
    """A rule's matches and the text between them; runs of digits begin where the one before ends, so that no look-behind is needed."""
    pattern = "'" + rule.pattern.replace("(?<![0-9a-f])", "").replace("'", "''") + "'"
    return (
        f"SELECT doc_id, {kind} AS kind, '{rule.name}' AS name, {rule.least} AS least, string_split_regex(t, {pattern}) AS gaps, "
        f"regexp_extract_all(t, {pattern}) AS hits, regexp_extract_all(t, {pattern}, {rule.group}) AS groups FROM d"
    )


OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(secrets.BASE + secrets.MORE))}),
u AS (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM m),
v AS (SELECT doc_id, kind, name, list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0) AS s, length(hits[i]) AS n FROM u WHERE length(groups[i]) >= least),
w AS (SELECT doc_id, kind, s, name || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS span FROM v)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, kind), '') AS spans
FROM d LEFT JOIN w ON w.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query("op8_secret_scan", OP8_SQL)
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[F.size(f"found.{r.name}").cast("long").alias(f"n_{r.name}") for r in secrets.BASE],
        F.sha2(secrets.joined("found", secrets.BASE), 256).alias("base_sha256"),
        secrets.joined("found", secrets.BASE + secrets.MORE).alias("spans"),
    )


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op11_quality_classifier")
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY lang, source, term),
kept AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
g AS (SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(l.total, 0) AS whole, coalesce((SELECT sum(c.n) FROM c JOIN kept k USING (lang, term) WHERE c.lang = g.lang AND c.source = g.source), 0)::BIGINT AS total
      FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs l ON l.lang = g.lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p, 1 + (1000000000 * (k.n + 5)) // (g.whole + 5 * g.v) AS q
      FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary"))::INTEGER AS rank FROM u
QUALIFY part = 'pair' OR rank <= 50
"""


@query("op12_source_divergence", OP12_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir))


#: CRC-32 of a number's digits: a bit at a time, over the bytes.
_CRC32 = """(xor(list_reduce(list_transform(string_split({x}::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384)), 4294967295), 4294967295))"""

OP13_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS ts, {_CRC32.format(x="conv_id")} % 4 AS h FROM t GROUP BY conv_id),
seq AS (SELECT o.conv_id, list_concat(coalesce(b.ts[1:o.h], []), o.ts[o.h + 1:]) AS s FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
pre AS (SELECT conv_id, d, s[1:d] AS k, len(s) = d AS ended FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seq)),
node AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended) AS ends FROM pre GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(node.k[d].x, '[^\x20\x09-\x0D]+')) END AS saved FROM node LEFT JOIN kids ON kids.k = node.k),
up AS (SELECT k[1:e] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM full_node) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, up.n_leaves, up.saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_node n JOIN up ON up.k = n.k LEFT JOIN node p ON n.d > 0 AND p.k = n.k[1:n.d - 1] AND p.d = n.d - 1
"""


@query("op13_conversation_trie", OP13_SQL)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
