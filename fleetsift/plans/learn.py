"""Queries of clustering, suggestion, training, hygiene and metrics (T, H and V rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetsift.functions import secrets, shape
from fleetsift.functions import text as tx
from fleetsift.operators import detect, hygiene, learn, metrics, packstore, reads, tree
from fleetsift.plans.comply import FINDINGS_CTE, findings
from fleetsift.plans.detect import CFG, HITS_CTE, PACK_CTE, RANKED_CTE, SCORES_CTE, _pack_versions, configs, quote
from fleetsift.plans.parse import REASONED_CTE, FACTS_CTE, FIELDS_CTE, RESOLVED_CTE, resolved_fields
from fleetsift.plans.registry import query
from fleetsift.sources import derived as d
from fleetsift.sources.rules import VERDICTS

_SHAPE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, {quote(p)}) THEN '{n}'" for n, p in shape.SHAPES) + " ELSE t END"
SIG_CTE = f"""{d.SECRET_LINES_CTE}, toks AS (SELECT doc_id, line_number, text, CASE WHEN trim(text) = '' THEN [] ELSE string_split_regex(trim(text), '\\s+') END AS ts FROM sec_line),
  sig AS (SELECT doc_id, line_number, text, ts, array_to_string([{_SHAPE_SQL} FOR t IN ts[1:24]], ' ') || CASE WHEN len(ts) > 24 THEN ' ...' ELSE '' END AS signature FROM toks)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return d.doc_lines_secret(spark, sf)


@query("t01_token_shape", f"WITH {SIG_CTE}, u AS (SELECT unnest(ts) AS t FROM sig) SELECT t AS token, {_SHAPE_SQL} AS shape, count(*) AS n FROM u GROUP BY ALL")
def t01_token_shape(spark: SparkSession, sf: str) -> DataFrame:
    toks = lines(spark, sf).select(F.explode_outer(tx.tokens(F.col("text"))).alias("token")).where(F.col("token").isNotNull())
    return toks.groupBy("token").agg(F.count("*").alias("n")).withColumn("shape", shape.token_shape(F.col("token")))


@query("t02_line_signature", f"WITH {SIG_CTE} SELECT doc_id, line_number, signature FROM sig")
def t02_line_signature(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("doc_id", "line_number", shape.signature(F.col("text")).alias("signature"))


@query("t03_generic", f"WITH {SIG_CTE} SELECT doc_id, line_number, len([1 FOR t IN string_split(signature, ' ') IF NOT (t = '' OR t = '...' OR regexp_matches(t, '^<.*>$'))]) = 0 AS generic FROM sig")
def t03_generic(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("doc_id", "line_number", shape.is_generic(shape.signature(F.col("text"))).alias("generic"))


_CLUSTERS = f"""{SIG_CTE}, cl AS (SELECT left(sha256(signature), 16) AS cluster_id, signature, count(*) AS size, count(DISTINCT doc_id) AS file_count, min(doc_id) AS exemplar_file,
   arg_min(line_number, doc_id * 1000000 + line_number) AS exemplar_line, arg_min(text, doc_id * 1000000 + line_number) AS exemplar,
   len([1 FOR t IN string_split(signature, ' ') IF NOT (t = '' OR t = '...' OR regexp_matches(t, '^<.*>$'))]) > 0 AS is_confirmable FROM sig WHERE signature <> '' GROUP BY signature)"""


@query("t04_cluster_id", f"WITH {_CLUSTERS} SELECT signature, cluster_id FROM cl")
def t04_cluster_id(spark: SparkSession, sf: str) -> DataFrame:
    return learn.clusters(lines(spark, sf)).select("signature", "cluster_id")


@query("t05_cluster", f"WITH {_CLUSTERS} SELECT * FROM cl")
def t05_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return learn.clusters(lines(spark, sf))


@query("t06_cluster_rank", f"WITH {_CLUSTERS} SELECT cluster_id, size, file_count FROM cl")
def t06_cluster_rank(spark: SparkSession, sf: str) -> DataFrame:
    return reads.listing(learn.clusters(lines(spark, sf)), learn.cluster_order()).select("cluster_id", "size", "file_count")


@query("t07_confirmable", f"WITH {_CLUSTERS} SELECT cluster_id, size FROM cl WHERE is_confirmable")
def t07_confirmable(spark: SparkSession, sf: str) -> DataFrame:
    return learn.clusters(lines(spark, sf)).where("is_confirmable").select("cluster_id", "size")


_SPLIT = "CASE lang WHEN 'en' THEN 'dev' WHEN 'fr' THEN 'eval' ELSE 'holdout' END"
INDEX_CTE = f"""{d.DOC_LINES_CTE}, bl AS (SELECT item_id, unnest(string_split(text, chr(10))) AS text FROM benchmark),
  idx AS (SELECT trim(text) AS text, 'f' || (item_id % 5) AS field, 'b' || item_id AS origin, 'seed' AS source FROM bl WHERE trim(text) <> ''
    UNION ALL SELECT trim(text), CASE WHEN conv_id % 3 <> 0 THEN 'f' || (conv_id % 5) END, 'c' || conv_id || '-' || turn, 'admin' FROM conversations WHERE role = 'user' AND trim(text) <> '' AND conv_id % 3 <> 0),
  dl AS (SELECT trim(l.text) AS text, {_SPLIT} AS split FROM cfg_line l JOIN documents USING (doc_id) WHERE trim(l.text) <> '')"""


def _index(spark: SparkSession, sf: str) -> DataFrame:
    bench = d.table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("text"))
    seeds = bench.select("text", F.concat(F.lit("f"), F.col("item_id") % 5).alias("field"), F.concat(F.lit("b"), "item_id").alias("origin"))
    conv = d.table(spark, sf, "conversations").where(F.col("role") == "user")
    field = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("f"), F.col("conv_id") % 5))
    confirmed = conv.select("text", field.alias("field"), F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("origin"))
    return learn.example_index(seeds, confirmed)


def _split_lines(spark: SparkSession, sf: str) -> DataFrame:
    split = F.when(F.col("lang") == "en", "dev").when(F.col("lang") == "fr", "eval").otherwise("holdout")
    return d.doc_lines(spark, sf, keep=("lang",)).select(F.trim("text").alias("text"), split.alias("split")).where(F.col("text") != "")


@query("t08_example_index", f"WITH {INDEX_CTE} SELECT text, field, origin, source FROM idx")
def t08_example_index(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).select("text", "field", "origin", "source")


@query("t09_index_provenance", f"WITH {INDEX_CTE} SELECT text, origin FROM idx WHERE source = 'seed' AND text NOT IN (SELECT text FROM dl WHERE split = 'dev')")
def t09_index_provenance(spark: SparkSession, sf: str) -> DataFrame:
    dev = _split_lines(spark, sf).where(F.col("split") == "dev")
    return learn.unproven_seeds(_index(spark, sf), dev).select("text", "origin")


@query(
    "t10_cosine",
    "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) b USING (label)",
)
def t10_cosine(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "embeddings")
    ref = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    return e.join(ref, "label").select("vec_id", F.round(learn.cosine(F.col("embedding"), F.col("ref")), 6).alias("score"))


TOP_CTE = """sc AS (SELECT a.vec_id AS query_id, 'f' || b.label AS field, b.vec_id AS text, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score, a.label AS ql, b.label AS bl FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, field, text) AS rank FROM sc) WHERE rank <= 3),
  sug AS (SELECT query_id, field, score AS raw_score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, field ORDER BY rank) AS fr FROM top) WHERE fr = 1)"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "embeddings")
    index = e.select(F.concat(F.lit("f"), "label").alias("field"), F.col("vec_id").alias("text"), F.col("embedding").alias("vector"))
    # Each vector asks about all others: its own entry is left out by name.
    return learn.top_candidates(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("skip")), index)


@query("t11_top_k", f"WITH {TOP_CTE} SELECT query_id, rank, field, text, round(score, 6) AS score FROM top")
def t11_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).withColumn("score", F.round("score", 6))


@query("t12_field_dedupe", f"WITH {TOP_CTE} SELECT query_id, rank, field, round(raw_score, 6) AS raw_score FROM sug")
def t12_field_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return learn.suggestions(candidates(spark, sf)).withColumn("raw_score", F.round("raw_score", 6))


@query(
    "t13_never_confidence",
    "SELECT event_id FROM events WHERE event_type = 'error' OR value > 80",
)
def t13_never_confidence(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "calibrated_similarity").otherwise("uncalibrated_similarity").alias("confidence_method"),
        F.when(F.col("value") > 80, F.col("value") / 100).alias("calibrated_confidence"),
    )
    return learn.confidence_violations(e).select("event_id")


@query(
    "t14_queue_state",
    f"WITH {_CLUSTERS} SELECT cluster_id, CASE WHEN NOT is_confirmable THEN 'not_confirmable' WHEN file_count % 3 = 0 THEN 'model_unavailable' WHEN exemplar_line % 5 = 0 THEN 'index_empty' ELSE 'ranked' END AS state FROM cl",
)
def t14_queue_state(spark: SparkSession, sf: str) -> DataFrame:
    c = learn.clusters(lines(spark, sf))
    state = learn.queue_state(F.col("is_confirmable"), F.col("file_count") % 3 != 0, F.when(F.col("exemplar_line") % 5 == 0, 0).otherwise(9), F.lit(1))
    return c.select("cluster_id", state.alias("state"))


@query(
    "t15_queue_view",
    f"WITH {SIG_CTE} SELECT s.doc_id, s.line_number, s.signature FROM sig s JOIN documents USING (doc_id) WHERE source = 'src7'",
)
def t15_queue_view(spark: SparkSession, sf: str) -> DataFrame:
    mine = d.doc_lines_secret(spark, sf, F.col("source") == "src7")
    return reads.listing(mine, ("doc_id", "line_number")).select("doc_id", "line_number", shape.signature(F.col("text")).alias("signature"))


DEC_CTE = f"""{TOP_CTE}, shown AS (SELECT query_id, list({{'r': CASE WHEN query_id % 11 = 0 THEN 1 ELSE rank END, 'f': field}} ORDER BY rank) AS shown FROM sug GROUP BY 1),
  dec AS (SELECT query_id AS example_id, shown, CASE query_id % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'accepted' ELSE 'corrected' END AS outcome, CASE WHEN query_id % 4 = 1 THEN 1 + query_id % 3 END AS accepted_rank,
    CASE WHEN query_id % 4 = 0 THEN CASE WHEN query_id % 3 = 0 THEN 'f1' END WHEN query_id % 9 <> 0 THEN 'f' || (query_id % 10) END AS field FROM shown)"""


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    s = learn.suggestions(candidates(spark, sf))
    q = F.col("query_id")
    shown = s.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "field"))).alias("shown"))
    fixed = F.transform("shown", lambda x: F.struct(F.when(q % 11 == 0, F.lit(1)).otherwise(x["rank"]).alias("rank"), x["field"].alias("field")))
    field = F.when(q % 4 == 0, F.when(q % 3 == 0, "f1")).when(q % 9 != 0, F.concat(F.lit("f"), q % 10))
    return shown.select(
        q.alias("example_id"), fixed.alias("shown"), F.when(q % 4 == 0, "rejected").when(q % 4 == 1, "accepted").otherwise("corrected").alias("outcome"),
        F.when(q % 4 == 1, 1 + q % 3).alias("accepted_rank"), field.alias("field"),
    )


@query(
    "t16_decision_validity",
    f"WITH {DEC_CTE}, m AS (SELECT *, [x FOR x IN shown IF x.r = accepted_rank][1] AS hit, [x.r FOR x IN shown] AS rs FROM dec) SELECT example_id, problem FROM ("
    "SELECT example_id, 'duplicate_rank' AS problem FROM m WHERE len(list_distinct(rs)) < len(rs) UNION ALL SELECT example_id, 'rank_not_shown' FROM m WHERE accepted_rank IS NOT NULL AND hit IS NULL "
    "UNION ALL SELECT example_id, 'accepted_other_field' FROM m WHERE hit IS NOT NULL AND hit.f <> field UNION ALL SELECT example_id, 'rejected_with_field' FROM m WHERE outcome = 'rejected' AND field IS NOT NULL "
    "UNION ALL SELECT example_id, 'no_field' FROM m WHERE outcome <> 'rejected' AND field IS NULL)",
)
def t16_decision_validity(spark: SparkSession, sf: str) -> DataFrame:
    return learn.decision_problems(_decisions(spark, sf))


@query("t17_top3_hit", f"WITH {DEC_CTE} SELECT example_id, field IS NOT NULL AND len([1 FOR x IN shown IF x.f = field]) > 0 AS hit FROM dec")
def t17_top3_hit(spark: SparkSession, sf: str) -> DataFrame:
    return _decisions(spark, sf).select("example_id", learn.top3_hit().alias("hit"))


_ESC = "regexp_replace(t, '([()\\[\\]{}?*+\\-|^$\\\\.&~#])', '\\\\\\1', 'g')"


@query(
    "t18_pattern_generalise",
    f"WITH {SIG_CTE} SELECT doc_id, line_number, CASE WHEN len(ts) BETWEEN 2 AND 24 THEN '^' || array_to_string(list_concat([{_ESC} FOR t IN ts[1:len(ts) - 1]], ['(\\S+)']), '\\s+') || '$' END AS pattern FROM sig",
)
def t18_pattern_generalise(spark: SparkSession, sf: str) -> DataFrame:
    pattern = shape.build_regex(F.col("text"), F.size(tx.tokens(F.col("text"))) - 1)
    return lines(spark, sf).select("doc_id", "line_number", pattern.alias("pattern"))


@query(
    "t19_scope_generalise",
    f"WITH {CFG}, {REASONED_CTE}, b AS (SELECT k, line_number, last_value(CASE WHEN NOT starts_with(raw_line, ' ') THEN raw_line END IGNORE NULLS) OVER (PARTITION BY k ORDER BY line_number) AS t, raw_line FROM reasoned "
    f"WHERE reason IS NULL AND pr IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) SELECT k, line_number, '^' || regexp_replace({_ESC}, '\\d+', '\\\\d+', 'g') || '$' AS scope FROM b WHERE starts_with(raw_line, ' ')",
)
def t19_scope_generalise(spark: SparkSession, sf: str) -> DataFrame:
    files = configs(spark, sf).where(F.col("syntax_mode") == "indent")
    placed = tree.build_tree(files, ["k"]).where(F.col("placed") & (F.size("block_path") > 0))
    return placed.select("k", "line_number", F.array_join(shape.build_scope(F.col("block_path"), True), " ").alias("scope"))


@query("t20_pattern_safety", f"WITH {SIG_CTE} SELECT doc_id, line_number, CASE doc_id % 4 WHEN 0 THEN 'not_anchored' WHEN 1 THEN 'unsafe_construct' WHEN 2 THEN 'does_not_match_own_line' END AS refusal FROM sig WHERE len(ts) BETWEEN 2 AND 24")
def t20_pattern_safety(spark: SparkSession, sf: str) -> DataFrame:
    """Generalised patterns, spoiled in three ways by document, against their own line."""
    base = shape.build_regex(F.col("text"), F.size(tx.tokens(F.col("text"))) - 1)
    rows = lines(spark, sf).withColumn("base", base).where(F.col("base").isNotNull())
    r = F.col("doc_id") % 4
    spoiled = (
        F.when(r == 0, F.regexp_replace("base", r"^\^", "")).when(r == 1, F.concat("base", F.lit(".*"))).when(r == 2, F.concat(F.lit("^zz-"), F.expr("substring(base, 2)"))).otherwise(F.col("base"))
    )
    return rows.select("doc_id", "line_number", shape.pattern_refusal(spoiled, tx.py_strip(F.col("text"))).alias("refusal"))


@query(
    "t21_example_regression",
    "WITH e AS (SELECT event_id, event_type || ' ' || user_id AS text, event_id % 3 <> 0 AS expected FROM events) SELECT 'p-' || event_id AS pattern_id, text, CASE WHEN expected THEN 'positive_does_not_match' ELSE 'negative_matches' END AS failure FROM e WHERE regexp_matches(text, '^click \\d+$') <> expected",
)
def t21_example_regression(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events").select(
        F.concat(F.lit("p-"), "event_id").alias("pattern_id"), F.lit(r"^click \d+$").alias("pattern"), F.concat_ws(" ", "event_type", "user_id").alias("text"), (F.col("event_id") % 3 != 0).alias("expected")
    )
    return packstore.example_regression(e)


@query(
    "t22_version_lineage",
    f"""WITH {PACK_CTE}, v AS (SELECT DISTINCT pack_id, version, [x::INT FOR x IN string_split(version, '.')] AS key FROM pv)
    SELECT pack_id, version, lag(version) OVER (PARTITION BY pack_id ORDER BY key) AS previous_version, max(key[3]) OVER (PARTITION BY pack_id, key[1], key[2]) AS highest_patch FROM v""",
)
def t22_version_lineage(spark: SparkSession, sf: str) -> DataFrame:
    versions, _ = _pack_versions(spark, sf)
    return packstore.lineage(versions.select("pack_id", "version").distinct())


_PP_CTE = f"""{PACK_CTE}, pp AS (SELECT p_brand || '/' || p_type AS pack_id, '1.' || p_size || '.' || (p_partkey % 12) AS version, 'p-' || x AS pattern_id, CASE WHEN x % 3 = 0 THEN 'admin_trained' ELSE 'builtin' END AS source
    FROM part, (VALUES (1), (2), (3)) t(x) WHERE (p_partkey + x) % 4 <> 0), ppd AS (SELECT DISTINCT * FROM pp)"""


def _pack_patterns(spark: SparkSession, sf: str) -> DataFrame:
    part = d.table(spark, sf, "part").select("*", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("x"))
    return part.where((F.col("p_partkey") + F.col("x")) % 4 != 0).select(
        F.concat_ws("/", "p_brand", "p_type").alias("pack_id"), F.concat(F.lit("1."), "p_size", F.lit("."), F.col("p_partkey") % 12).alias("version"),
        F.concat(F.lit("p-"), "x").alias("pattern_id"), F.when(F.col("x") % 3 == 0, "admin_trained").otherwise("builtin").alias("source"),
    ).distinct()


@query(
    "t22_pattern_diff",
    f"""WITH {_PP_CTE}, v AS (SELECT DISTINCT pack_id, version, [x::INT FOR x IN string_split(version, '.')] AS key FROM pv), ch AS (SELECT pack_id, version, lag(version) OVER (PARTITION BY pack_id ORDER BY key) AS parent FROM v),
    c AS (SELECT ch.pack_id, ch.version, ppd.pattern_id, source FROM ch JOIN ppd USING (pack_id, version) WHERE parent IS NOT NULL), p AS (SELECT ch.pack_id, ch.version, ppd.pattern_id, source FROM ch JOIN ppd ON ppd.pack_id = ch.pack_id AND ppd.version = ch.parent)
    SELECT pack_id, version, pattern_id, 'added' AS change, source FROM c ANTI JOIN p USING (pack_id, version, pattern_id) UNION ALL SELECT pack_id, version, pattern_id, 'withdrawn', source FROM p ANTI JOIN c USING (pack_id, version, pattern_id)""",
)
def t22_pattern_diff(spark: SparkSession, sf: str) -> DataFrame:
    versions, _ = _pack_versions(spark, sf)
    chain = packstore.lineage(versions.select("pack_id", "version").distinct()).select("pack_id", "version", F.col("previous_version").alias("parent_version"))
    return packstore.pattern_diff(_pack_patterns(spark, sf), chain.where(F.col("parent_version").isNotNull()))


@query(
    "t23_pack_inventory",
    f"""WITH {_PP_CTE}, live AS (SELECT pack_id, min(version) AS version FROM chosen GROUP BY 1 HAVING count(DISTINCT version) = 1) SELECT v.pack_id, v.version, coalesce(n, 0) AS patterns, coalesce(a, 0) AS admin_trained, live.version IS NOT NULL AS is_active
    FROM (SELECT DISTINCT pack_id, version FROM pv) v LEFT JOIN (SELECT pack_id, version, count(*) AS n, count(*) FILTER (source = 'admin_trained') AS a FROM ppd GROUP BY ALL) USING (pack_id, version) LEFT JOIN live ON live.pack_id = v.pack_id AND live.version = v.version""",
)
def t23_pack_inventory(spark: SparkSession, sf: str) -> DataFrame:
    versions, pins = _pack_versions(spark, sf)
    return packstore.inventory(_pack_patterns(spark, sf), versions, packstore.active_versions(versions, pins))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Score and correctness of every shown candidate."""
    labels = d.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("f"), "label").alias("truth"))
    return candidates(spark, sf).join(labels, "query_id").select(
        F.concat_ws("-", "query_id", "rank").alias("id"), F.round("score", 9).alias("score"), (F.col("field") == F.col("truth")).alias("was_correct")
    )


# Isotonic regression by its max-min form: over all runs of scores that hold a score, the greatest of the least means.
PAV_CTE = f"""{TOP_CTE}, ob AS (SELECT query_id || '-' || rank AS id, round(score, 9) AS score, ql = bl AS ok FROM top), g AS (SELECT score, count(*) AS w, count(*) FILTER (ok) AS t, row_number() OVER (ORDER BY score) AS i FROM ob GROUP BY 1),
  cum AS (SELECT i, score, w, sum(w) OVER (ORDER BY i) AS cw, sum(t) OVER (ORDER BY i) AS ct, t FROM g),
  runs AS (SELECT a.i AS a, b.i AS b, (b.ct - a.ct + a.t)::DOUBLE / (b.cw - a.cw + a.w)::DOUBLE AS mean FROM cum a JOIN cum b ON b.i >= a.i),
  low AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM runs), iso AS (SELECT i, max(m) AS probability FROM low GROUP BY 1),
  st AS (SELECT min(score) AS threshold, probability, sum(w)::DOUBLE AS weight FROM iso JOIN g USING (i) GROUP BY probability)"""


@query("t24_calibrator_fit", f"WITH {PAV_CTE} SELECT round(threshold, 6) AS threshold, probability, weight FROM st")
def t24_calibrator_fit(spark: SparkSession, sf: str) -> DataFrame:
    return learn.fit_steps(outcomes(spark, sf)).withColumn("threshold", F.round("threshold", 6))


@query("t25_calibrated_lookup", f"WITH {PAV_CTE} SELECT id, round(ob.score, 6) AS score, probability FROM ob JOIN g USING (score) JOIN iso USING (i)")
def t25_calibrated_lookup(spark: SparkSession, sf: str) -> DataFrame:
    obs = outcomes(spark, sf)
    return learn.calibrated(obs, learn.fit_steps(obs)).select("id", F.round("score", 6).alias("score"), "probability")


_BINS = "CASE " + " ".join(f"WHEN score >= {i * 0.1!r}::DOUBLE AND score {'<=' if i == 9 else '<'} {(i + 1) * 0.1!r}::DOUBLE THEN {i}" for i in range(10)) + " END"
_REL = f"{TOP_CTE}, rel AS (SELECT {_BINS} AS bin, count(*) AS count, avg(score) AS mean_score, avg((ql = bl)::INT) AS accuracy FROM top GROUP BY 1 HAVING bin IS NOT NULL)"


@query("t26_reliability", f"WITH {_REL} SELECT bin, count, round(mean_score, 6) AS mean_score, round(accuracy, 6) AS accuracy, round(abs(mean_score - accuracy), 6) AS gap FROM rel")
def t26_reliability(spark: SparkSession, sf: str) -> DataFrame:
    return learn.reliability(outcomes(spark, sf)).select("bin", "count", *[F.round(c, 6).alias(c) for c in ("mean_score", "accuracy", "gap")])


@query("t27_calibration_error", f"WITH {_REL} SELECT round(sum(count * abs(mean_score - accuracy)) / sum(count), 6) AS ece FROM rel")
def t27_calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return learn.expected_calibration_error(outcomes(spark, sf)).select(F.round("ece", 6).alias("ece"))


# ---- hygiene ---------------------------------------------------------------------------

_SCRUB = (
    "regexp_replace(regexp_replace(text, '(?i)\\b(password|passwd|secret|key|community|psk|pre-shared-key|passphrase)(\\s+\\d+)?\\s+\\S+', '\\1\\2 <redacted>', 'g'), '(?i)\\$\\d[a-z0-9]*\\$\\S+', '<redacted>', 'g')"
)


@query("h01_scrub_line", f"WITH {d.SECRET_LINES_CTE} SELECT doc_id, line_number, {_SCRUB} AS scrubbed FROM sec_line")
def h01_scrub_line(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("doc_id", "line_number", secrets.scrub_line(F.col("text")).alias("scrubbed"))


@query("h02_contains_secret", f"WITH {d.SECRET_LINES_CTE} SELECT doc_id, line_number, {_SCRUB} <> text AS secret FROM sec_line")
def h02_contains_secret(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("doc_id", "line_number", secrets.contains_secret(F.col("text")).alias("secret"))


@query("h03_scrub_for_inference", f"WITH {d.SECRET_LINES_CTE} SELECT doc_id, line_number, CASE WHEN trim({_SCRUB}) = '' THEN '<redacted>' ELSE trim({_SCRUB}) END AS scrubbed FROM sec_line")
def h03_scrub_for_inference(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("doc_id", "line_number", secrets.scrub_for_inference(F.col("text")).alias("scrubbed"))


_CRED = " OR ".join(f"regexp_matches(text, {quote(p)})" for p in secrets.CREDENTIALS[:4]) + " OR (regexp_matches(text, '\\$(?:1|5|6|8|9)\\$[^\\s\"'';]{4,}') AND NOT regexp_matches(text, '\\$SAMPLE\\$'))"


@query("h04_credential_scan", f"WITH {d.SECRET_LINES_CTE} SELECT doc_id, count(*) FILTER ({_CRED}) AS hits FROM sec_line GROUP BY 1")
def h04_credential_scan(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("doc_id").agg(F.count_if(secrets.has_credential(F.col("text"))).alias("hits"))


@query(
    "h05_community_gate",
    f"WITH {d.SECRET_LINES_CTE}, n AS (SELECT doc_id, line_number, text, regexp_extract(text, '\\bsnmp-server\\s+community\\s+\"?([^\\s\"]+)', 1) AS n1 FROM sec_line WHERE contains(lower(text), 'community')) "
    "SELECT doc_id, line_number, CASE WHEN n1 <> '' THEN 'non_default:' || n1 ELSE 'unread_mention' END AS problem FROM n WHERE (n1 <> '' AND lower(n1) NOT IN ('public', 'private')) OR (n1 = '' AND NOT regexp_matches(ltrim(text), '^(!|#|/\\*|\\*|//)'))",
)
def h05_community_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).select("doc_id", "line_number", F.explode_outer(secrets.community_problems(F.col("text"))).alias("problem"))
    return rows.where(F.col("problem").isNotNull())


@query(
    "h06_address_policy",
    f"WITH {d.SECRET_LINES_CTE}, a AS (SELECT doc_id, line_number, unnest(regexp_extract_all(text, '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b')) AS address FROM sec_line) SELECT doc_id, line_number, address FROM a "
    "WHERE NOT (starts_with(address, '0.') OR starts_with(address, '255.') OR ends_with(address, '.0') OR contains(address, '255.255')) AND NOT (" + " OR ".join(f"starts_with(address, '{p}')" for p in secrets.RESERVED_PREFIXES) + ")",
)
def h06_address_policy(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).select("doc_id", "line_number", F.explode_outer(secrets.foreign_addresses(F.col("text"))).alias("address"))
    return rows.where(F.col("address").isNotNull())


@query(
    "h07_domain_policy",
    f"WITH {d.SECRET_LINES_CTE}, a AS (SELECT doc_id, line_number, unnest(regexp_extract_all(text, 'domain[- ]name[> ]+([A-Za-z0-9.-]+)', 1)) AS domain FROM sec_line) SELECT doc_id, line_number, domain FROM a WHERE NOT ("
    + " OR ".join(f"ends_with(domain, '{p}')" for p in secrets.RESERVED_DOMAINS) + ")",
)
def h07_domain_policy(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).select("doc_id", "line_number", F.explode_outer(secrets.foreign_domains(F.col("text"))).alias("domain"))
    return rows.where(F.col("domain").isNotNull())


@query(
    "h08_contamination",
    f"WITH {INDEX_CTE}, all_idx AS (SELECT text, origin FROM idx UNION ALL SELECT trim(text), 'd' || doc_id || ':' || line_number FROM cfg_line WHERE trim(text) <> '') "
    "SELECT text, origin FROM all_idx WHERE text IN (SELECT text FROM dl WHERE split <> 'dev') AND text NOT IN (SELECT text FROM dl WHERE split = 'dev')",
)
def h08_contamination(spark: SparkSession, sf: str) -> DataFrame:
    """The index, and all lines of all documents of every split, as if somebody had taken them for examples."""
    taken = d.doc_lines(spark, sf).where(F.trim("text") != "")
    index = _index(spark, sf).select("text", "origin").unionByName(taken.select(F.trim("text").alias("text"), F.concat(F.lit("d"), "doc_id", F.lit(":"), "line_number").alias("origin")))
    return hygiene.contaminated(index, _split_lines(spark, sf)).select("text", "origin")


_MAN_CTE = f"""man AS (SELECT 'd' || (doc_id % 5) || '/' || doc_id AS path, {_SPLIT} AS split, source AS vendor, CASE WHEN doc_id % 13 = 0 THEN 'stale' ELSE sha256(text) END AS sha, CASE WHEN doc_id % 17 <> 0 THEN 'team' END AS authored_by FROM documents WHERE doc_id % 19 <> 0
    UNION ALL SELECT 'gone/' || item_id, 'dev', 'src1', sha256(text), 'team' FROM benchmark),
  fil AS (SELECT 'd' || (doc_id % 5) || '/' || doc_id AS path, sha256(text) AS sha FROM documents)"""


def _manifest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = d.table(spark, sf, "documents")
    path = F.concat(F.lit("d"), F.col("doc_id") % 5, F.lit("/"), "doc_id").alias("path")
    sha = tx.line_hash(F.col("text"))
    split = F.when(F.col("lang") == "en", "dev").when(F.col("lang") == "fr", "eval").otherwise("holdout").alias("split")
    listed = docs.where(F.col("doc_id") % 19 != 0).select(
        path, split, F.col("source").alias("vendor"), F.when(F.col("doc_id") % 13 == 0, "stale").otherwise(sha).alias("sha"), F.when(F.col("doc_id") % 17 != 0, "team").alias("authored_by")
    )
    gone = d.table(spark, sf, "benchmark").select(
        F.concat(F.lit("gone/"), "item_id").alias("path"), F.lit("dev").alias("split"), F.lit("src1").alias("vendor"), sha.alias("sha"), F.lit("team").alias("authored_by")
    )
    return listed.unionByName(gone), docs.select(path, sha.alias("sha"))


@query(
    "h09_manifest_reconcile",
    f"WITH {_MAN_CTE} SELECT coalesce(m.path, f.path) AS path, CASE WHEN m.path IS NULL THEN 'unlisted' WHEN f.path IS NULL THEN 'missing' WHEN m.sha <> f.sha THEN 'changed' ELSE 'no_provenance' END AS problem "
    "FROM man m FULL OUTER JOIN fil f ON f.path = m.path WHERE m.path IS NULL OR f.path IS NULL OR m.sha <> f.sha OR m.authored_by IS NULL",
)
def h09_manifest_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return hygiene.reconcile(*_manifest(spark, sf))


@query(
    "h10_held_out_isolation",
    f"WITH {_MAN_CTE} SELECT path, CASE WHEN vendor = 'src7' THEN 'held_out_vendor_outside_holdout' ELSE 'other_vendor_in_holdout' END AS problem FROM man WHERE (vendor = 'src7') <> (split = 'holdout')",
)
def h10_held_out_isolation(spark: SparkSession, sf: str) -> DataFrame:
    return hygiene.held_out_violations(_manifest(spark, sf)[0], "src7")


# ---- metrics ---------------------------------------------------------------------------

_VOBS = """vobs AS (SELECT l.doc_id, source AS vendor, lang AS field, l.doc_id % 7 <> 0 AS determinable, quality AS expected_value, l.doc_id % 5 <> 0 AS asserted, toxic AS system_value,
   CASE WHEN l.doc_id % 4 <> 0 THEN l.doc_id % 9 END AS labelled_line, CASE WHEN l.doc_id % 3 <> 0 THEN l.doc_id % 8 END AS cited_line FROM labels l JOIN documents USING (doc_id)),
  vo AS (SELECT *, CASE WHEN asserted AND determinable AND expected_value = system_value THEN 'correct' WHEN asserted THEN 'wrong_confident' WHEN determinable THEN 'miss' ELSE 'correct_abstention' END AS outcome,
   CASE WHEN NOT asserted OR labelled_line IS NULL THEN 'not_scored' WHEN cited_line IS NULL THEN 'missing' WHEN cited_line = labelled_line THEN 'correct' ELSE 'wrong_line' END AS evidence FROM vobs)"""


def observed(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    docs = d.table(spark, sf, "documents").select("doc_id", F.col("source").alias("vendor"), F.col("lang").alias("field"))
    rows = d.table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", "vendor", "field", (n % 7 != 0).alias("determinable"), F.col("quality").alias("expected_value"), (n % 5 != 0).alias("asserted"), F.col("toxic").alias("system_value"),
        F.when(n % 4 != 0, n % 9).alias("labelled_line"), F.when(n % 3 != 0, n % 8).alias("cited_line"),
    )
    return rows.withColumn("outcome", metrics.field_outcome()).withColumn("evidence", metrics.evidence_outcome())


@query("v01_field_outcome", f"WITH {_VOBS} SELECT doc_id, outcome FROM vo")
def v01_field_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return observed(spark, sf).select("doc_id", "outcome")


@query("v02_value_equality", "SELECT doc_id, quality = toxic AS same FROM labels")
def v02_value_equality(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "labels").select("doc_id", F.col("quality").eqNullSafe(F.col("toxic")).alias("same"))


@query("v03_evidence_outcome", f"WITH {_VOBS} SELECT doc_id, evidence FROM vo")
def v03_evidence_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return observed(spark, sf).select("doc_id", "evidence")


def _metric_sql(keys: str) -> str:
    by = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return (
        f"WITH {_VOBS}, c AS (SELECT {by}count(*) AS total, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'wrong_confident') AS wrong, count(*) FILTER (outcome = 'miss') AS miss, "
        f"count(*) FILTER (outcome = 'correct_abstention') AS abstained_right, count(*) FILTER (evidence = 'correct') AS ev_correct, count(*) FILTER (evidence <> 'not_scored') AS ev_scored FROM vo{group}) "
        "SELECT *, correct::DOUBLE / nullif(correct + wrong, 0) AS precision, correct::DOUBLE / nullif(correct + wrong + miss, 0) AS recall, miss::DOUBLE / nullif(correct + miss, 0) AS miss_rate, "
        "wrong::DOUBLE / nullif(correct + wrong, 0) AS wrong_confident_rate, abstained_right::DOUBLE / nullif(miss + abstained_right, 0) AS correct_abstention_rate, ev_correct::DOUBLE / nullif(ev_scored, 0) AS evidence_integrity FROM c"
    )


@query("v04_field_metrics", _metric_sql(""))
def v04_field_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.field_metrics(observed(spark, sf))


@query("v05_by_vendor", _metric_sql("vendor"))
def v05_by_vendor(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.field_metrics(observed(spark, sf), "vendor")


@query("v05_by_field", _metric_sql("field"))
def v05_by_field(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.field_metrics(observed(spark, sf), "field")


_V4 = "[" + ", ".join(quote(v) for v in VERDICTS) + "]"
_VERD = f"verd AS (SELECT {_V4}[(o_orderkey % 4 + 1)::INT] AS expected, {_V4}[((o_orderkey + o_custkey % 2) % 3 + 1)::INT] AS actual FROM orders), cm AS (SELECT e AS expected, a AS actual, (SELECT count(*) FROM verd v WHERE v.expected = e AND v.actual = a) AS n FROM (SELECT unnest({_V4}) AS e), (SELECT unnest({_V4}) AS a))"


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(v) for v in VERDICTS])
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return d.table(spark, sf, "orders").select(
        F.element_at(names, (k % 4 + 1).cast("int")).alias("expected"), F.element_at(names, ((k + c % 2) % 3 + 1).cast("int")).alias("actual")
    )


@query("v06_confusion", f"WITH {_VERD} SELECT * FROM cm")
def v06_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(_verdicts(spark, sf))


@query(
    "v07_verdict_metrics",
    f"WITH {_VERD} SELECT v AS verdict, (SELECT sum(n) FROM cm WHERE expected = v AND actual = v)::DOUBLE / nullif((SELECT sum(n) FROM cm WHERE actual = v), 0) AS precision, "
    f"(SELECT sum(n) FROM cm WHERE expected = v AND actual = v)::DOUBLE / nullif((SELECT sum(n) FROM cm WHERE expected = v), 0) AS recall, (SELECT sum(n) FROM cm WHERE expected = v) > 0 AS exercised FROM (SELECT unnest({_V4}) AS v)",
)
def v07_verdict_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.verdict_metrics(_verdicts(spark, sf))


_EXPECTED_VENDOR = "CASE b.pr " + " ".join(f"WHEN '{pr}' THEN '{spec[0]}'" for pr, spec in d.PLATFORMS.items()) + " END"


@query(
    "v08_detection_metrics",
    f"WITH {CFG}, {HITS_CTE}, {SCORES_CTE}, {RANKED_CTE}, ob AS (SELECT b.pr, {_EXPECTED_VENDOR} AS ev, CASE WHEN q.outcome = 'detected' THEN q.vendor END AS dv, q.outcome AS reason FROM base b JOIN decided q USING (k)) "
    "SELECT reason, count(*) AS total, count(*) FILTER (dv = ev) AS correct, count(*) FILTER (dv <> ev) AS wrong, count(*) FILTER (dv IS NULL) AS abstained, count(*) FILTER (dv = ev)::DOUBLE / count(*) AS accuracy FROM ob GROUP BY 1",
)
def v08_detection_metrics(spark: SparkSession, sf: str) -> DataFrame:
    got = detect.detect(configs(spark, sf)).select(F.col("vendor").alias("expected_vendor"), "detected_vendor", F.col("outcome").alias("reason"))
    return metrics.detection_metrics(got, "reason")


@query(
    "v09_similarity_metrics",
    f"WITH {TOP_CTE}, pr AS (SELECT query_id, list(field ORDER BY rank) AS proposed, CASE WHEN query_id % 6 <> 0 THEN 'f' || min(ql) END AS tf FROM (SELECT s.*, e.label AS ql FROM sug s JOIN embeddings e ON e.vec_id = s.query_id) GROUP BY 1) "
    "SELECT *, top1::DOUBLE / nullif(scoreable, 0) AS top1_accuracy, top3::DOUBLE / nullif(scoreable, 0) AS top3_accuracy, 'measured' AS status FROM (SELECT count(*) FILTER (tf IS NOT NULL) AS scoreable, count(*) FILTER (tf IS NULL) AS unscoreable, "
    "count(*) FILTER (proposed[1] = tf) AS top1, count(*) FILTER (list_contains(proposed, tf)) AS top3 FROM pr)",
)
def v09_similarity_metrics(spark: SparkSession, sf: str) -> DataFrame:
    s = learn.suggestions(candidates(spark, sf)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "field"))).alias("p"))
    labels = d.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("f"), "label").alias("label"))
    rows = s.join(labels, "query_id").select(F.transform("p", lambda x: x["field"]).alias("proposed"), F.when(F.col("query_id") % 6 != 0, F.col("label")).alias("true_field"))
    return metrics.similarity_metrics(rows)


@query("v10_absence_branches", f"WITH {CFG}, {FACTS_CTE}, {FIELDS_CTE}, {RESOLVED_CTE} SELECT state, count(*) AS fields FROM resolved WHERE state <> 'present' GROUP BY 1")
def v10_absence_branches(spark: SparkSession, sf: str) -> DataFrame:
    return resolved_fields(spark, sf).where(F.col("state") != "present").groupBy("state").agg(F.count("*").alias("fields"))


@query(
    "v11_verdict_observation",
    f"WITH {FINDINGS_CTE}, lab AS (SELECT device_id, unnest(['R-SSH', 'R-AAA']) AS rule_id FROM dev) SELECT l.device_id, l.rule_id, coalesce(f.status, 'not_applicable') AS actual FROM lab l LEFT JOIN finding f USING (device_id, rule_id)",
)
def v11_verdict_observation(spark: SparkSession, sf: str) -> DataFrame:
    from fleetsift.plans.comply import devices

    labels = devices(spark, sf).select("device_id", F.explode(F.array(F.lit("R-SSH"), F.lit("R-AAA"))).alias("rule_id"))
    return metrics.verdict_observations(labels, findings(spark, sf)).select("device_id", "rule_id", "actual")


@query("v12_label_independence", "SELECT count(*) AS labels, count(*) FILTER (quality = 1) AS reviewed, count(*) FILTER (quality = 1 AND toxic = 0) AS independent FROM labels")
def v12_label_independence(spark: SparkSession, sf: str) -> DataFrame:
    reviewed, conflict = F.col("quality") == 1, F.col("toxic") == 1
    return d.table(spark, sf, "labels").agg(F.count("*").alias("labels"), F.count_if(reviewed).alias("reviewed"), F.count_if(reviewed & ~conflict).alias("independent"))


@query("v13_split_guard", f"SELECT doc_id, {_SPLIT} AS split, CASE WHEN {_SPLIT} = 'eval' THEN 'scored' ELSE 'labelled_outside_eval' END AS outcome FROM labels JOIN documents USING (doc_id)")
def v13_split_guard(spark: SparkSession, sf: str) -> DataFrame:
    split = F.when(F.col("lang") == "en", "dev").when(F.col("lang") == "fr", "eval").otherwise("holdout")
    docs = d.table(spark, sf, "documents").select("doc_id", split.alias("split"))
    return hygiene.split_guard(d.table(spark, sf, "labels").select("doc_id"), docs)
