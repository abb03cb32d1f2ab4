"""More queries: places, references, cases and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import place as P
from ..functions import text as T
from ..operators import evaluate, planning, rank, retrieve, validate
from . import wordings as W
from .queries import _DISC, _NEAR, _TOP, _discovered, _near, _said, _t, query


@query("SELECT conv_id, CASE WHEN length(t) > 400 THEN substr(t, 1, 400) || '...' ELSE t END AS text FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY 1)")
def history_text(spark, d):
    return evaluate.ordered_text(_t(spark, d, "conversations"), "conv_id", "turn", "text", 400)


_ARTICLE = "CASE WHEN doc_id % 3 = 0 THEN 'Artikel ' || doc_id % 90 || CASE WHEN doc_id % 2 = 0 THEN ' - ' || substr(trim(text), 1, 20) ELSE '' END ELSE '' END"


@query(f"WITH k AS (SELECT doc_id, substr(sha256('v3:' || source || ':' || {_ARTICLE} || ':' || substr(text, 1, 500)), 1, 16) AS cache_key FROM documents), c AS (SELECT cache_key, min(doc_id) AS cached_by FROM k JOIN labels USING (doc_id) GROUP BY 1) SELECT k.doc_id, k.cache_key, cached_by FROM k LEFT JOIN c USING (cache_key)")
def enrichment_lookup(spark, d):
    title = F.when(F.col("doc_id") % 2 == 0, F.substring(F.trim("text"), 1, 20)).otherwise("")
    meta = F.create_map(F.lit("article"), F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 90).cast("string")), F.lit("article_title"), title)
    keyed = _t(spark, d, "documents").select("doc_id", P.enrichment_key(F.col("source"), P.article_title(meta), F.col("text")).alias("cache_key"))
    cached = keyed.join(_t(spark, d, "labels").select("doc_id"), "doc_id").groupBy("cache_key").agg(F.min("doc_id").alias("cached_by"))
    return keyed.join(cached, "cache_key", "left")


@query("""WITH p AS (SELECT *, CASE WHEN p_partkey % 4 < 3 THEN '[Kapitel ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ': ' || p_type ELSE '' END || ']' END AS chapter,
CASE p_size % 5 WHEN 0 THEN '[Artikel ' || p_size || ': ' || p_name || ']' WHEN 1 THEN '[Artikel ' || p_size || ']' WHEN 2 THEN '[Bilag ' || p_size || ': ' || p_type || ']' WHEN 3 THEN '[Betragtning ' || p_size || ']' END AS place,
CASE WHEN p_partkey % 7 = 0 THEN '[Søgetermer: ' || p_type || ' | ' || p_type || ']' END AS terms FROM part)
SELECT p_partkey AS k, CASE WHEN concat_ws(chr(10), chapter, place, terms) = '' THEN p_name ELSE concat_ws(chr(10), chapter, place, terms) || chr(10) || chr(10) || p_name END AS text FROM p""")
def context_prefixes(spark, d):
    """An article comes before the recital of the same passage."""
    n, key, size = F.col("p_size") % 5, F.col("p_partkey"), F.col("p_size").cast("string")
    meta = {"chapter": F.when(key % 4 < 3, F.col("p_brand")), "chapter_title": F.when(key % 2 == 0, F.col("p_type")), "article": F.when(n < 2, size), "article_title": F.when(n == 0, F.col("p_name")).otherwise(""), "annex": F.when(n == 2, size).otherwise(""), "annex_title": F.col("p_type"), "recital": F.when(n.isin(1, 3), size)}
    terms = F.when(key % 7 == 0, F.array("p_type", "p_type")).otherwise(F.array().cast("array<string>"))
    return _t(spark, d, "part").select(key.alias("k"), P.embedding_text(F.col("p_name"), F.create_map(*(x for k, v in meta.items() for x in (F.lit(k), v))), terms).alias("text"))


@query("SELECT 'text' AS field, count(*) FILTER (text IS NULL OR trim(text) = '') AS missing FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL OR trim(lang) = '') FROM documents UNION ALL SELECT 'source', count(*) FILTER (source IS NULL OR trim(source) = '') FROM documents")
def required_fields(spark, d):
    return evaluate.blank_report(_t(spark, d, "documents"), ["text", "lang", "source"])


_REFS = "list_distinct(list_transform(regexp_extract_all(lower(text), '(?:artikel|article)\\s*(\\d{1,3}[a-z]?)', 1), lambda x: upper(x)))"


@query("SELECT conv_id, turn, len(" + _REFS + ") AS n_refs FROM conversations")
def article_references(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.size(P.article_refs(F.col("text"))).cast("long").alias("n_refs"))


_ROLES = {"scope": W.SCOPE, "definitions": W.DEFINITIONS, "obligations": W.STRONG, "classification": W.CLASSIFICATION, "enforcement": W.ENFORCEMENT}


@query(f"SELECT doc_id, list_filter([{', '.join(f"CASE WHEN {W.holds(w, 'said')} THEN '{r}' END" for r, w in _ROLES.items())}], lambda x: x IS NOT NULL) AS roles FROM (SELECT doc_id, text || ' ' || {W.said('doc_id')} AS said FROM documents)")
def role_keyword_tags(spark, d):
    said = F.concat("text", F.lit(" "), _said(F.col("doc_id")))
    return _t(spark, d, "documents").select("doc_id", P.keyword_roles(said).alias("roles"))


_TITLES = ["Market surveillance authority", "Forbidden practices", "Omfang", "Artikel 4", "Shall mean", "Forstås ved dette", "High-risk systems", "Bilag", "Forbudte systemer", "Håndhævelse", "Supervision", "Begreb", "Applicability", "Kategori", "Markedsovervågning", "Noget andet", "Remedy", "High risk", "Definition", "Klassificering"]
_LABELLED = ["title", "display", "article_title", "chapter_title", "section_title", "annex_title", "toc_path", "location_id", "heading_path", "heading_path_display", "source", "body"]


@query(f"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % {len(_LABELLED)} = 11 THEN ' ' ELSE ' ' || lower([{", ".join(f"'{t}'" for t in _TITLES)}][(p_partkey % {len(_TITLES)} + 1)::INT]) || ' ' || lower(CASE WHEN p_size % 3 = 0 THEN p_name ELSE '' END) END AS t FROM part)
SELECT p_partkey AS k, CASE {" ".join(f"WHEN {W.holds(w, 't')} THEN '{n}'" for n, w in W.EVIDENCE)} ELSE 'UNKNOWN' END AS evidence FROM p""")
def evidence_type(spark, d):
    """A label of each kind in turn; words of a body are no label."""
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("p_partkey") % len(_TITLES) + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, _LABELLED)), (F.col("p_partkey") % len(_LABELLED) + 1).cast("int"))
    meta = F.map_concat(F.create_map(kind, title), F.create_map(F.lit("other"), F.lit("annex")))
    meta = F.when((F.col("p_size") % 3 == 0) & (kind != "body"), F.map_from_entries(F.array(F.struct(kind, F.concat_ws(" ", title, "p_name"))))).otherwise(meta)
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), P.evidence_type(meta).alias("evidence"))


_SUMMED = "sammenfat|opsummer|hvad handler|hvad står"


@query(f"""SELECT conv_id, turn, CASE WHEN {W.holds(W.STRUCTURE, 'said')} THEN 'STRUCTURE' WHEN regexp_matches(said, 'k\\s*a\\s*p\\s*i\\s*t\\s*e\\s*l\\s*(\\d+|[ivxlcdm]+)') AND {W.holds(_SUMMED, 'said')} THEN 'CHAPTER_SUMMARY'
WHEN regexp_matches(said, 'a\\s*r\\s*t\\s*i\\s*k\\s*e\\s*l\\s*\\d{{1,3}}[a-z]?') AND {W.holds('sammenfat|opsummer|hvad siger|hvad står', 'said')} THEN 'ARTICLE_SUMMARY' ELSE 'FREEFORM' END AS intent
FROM (SELECT *, lower(text || ' ' || {W.said('conv_id + turn')}) AS said FROM conversations)""")
def navigation_intent(spark, d):
    said = F.concat("text", F.lit(" "), _said(F.col("conv_id") + F.col("turn")))
    return _t(spark, d, "conversations").select("conv_id", "turn", planning.navigation(said).alias("intent"))


_MODES = [("COMPARISON", "|".join(f"(?:{p})" for p in W.COMPARISON)), ("ROUTING", W.ROUTING), ("AGGREGATION", W.AGGREGATION)]


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN {W.stands(p, 'said')} THEN '{n}'" for n, p in _MODES) + f" ELSE 'UNIFIED' END AS mode FROM (SELECT *, text || ' ' || {W.said('conv_id + turn')} AS said FROM conversations)")
def synthesis_mode(spark, d):
    said = F.concat("text", F.lit(" "), _said(F.col("conv_id") + F.col("turn")))
    return _t(spark, d, "conversations").select("conv_id", "turn", T.synthesis_mode(said).alias("mode"))


@query("SELECT page_id, url, regexp_extract(url, '/([a-z]{2})/', 1) AS lang FROM pages WHERE (contains(lower(url), 'news') OR contains(lower(url), 'example.org') OR contains(lower(url), '/en/'))")
def listing_filter(spark, d):
    words = ["news", "example.org", "/en/"]
    return _t(spark, d, "pages").where(T.contains_any(F.col("url"), words)).select("page_id", "url", F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"))


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE contains(lower(p_name), 'ring')) AS total FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_name, p_partkey LIMIT 20")
def anchor_search(spark, d):
    hit = _t(spark, d, "part").where(F.lower("p_name").contains("ring")).select("p_partkey", "p_name")
    return hit.orderBy("p_name", "p_partkey").limit(20).crossJoin(F.broadcast(hit.agg(F.count("*").alias("total"))))


@query("SELECT conv_id, turn, sha256(text) AS question_hash, length(CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END)::BIGINT AS n FROM conversations WHERE role = 'user'")
def intent_log(spark, d):
    users = _t(spark, d, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", F.sha2("text", 256).alias("question_hash"), F.length(P.truncated(F.col("text"), 80)).cast("long").alias("n"))


# --- references ----------------------------------------------------------------------------------

_CITES = "c AS (SELECT l_orderkey AS query_id, l_linenumber::BIGINT AS idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS pos FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'))"


@query(f"WITH {_CITES} SELECT DISTINCT query_id, pos::BIGINT AS pos, idx, l_partkey AS chunk_id FROM c JOIN lineitem ON query_id = l_orderkey AND idx = l_linenumber")
def used_references(spark, d):
    lines = _t(spark, d, "lineitem")
    said = lambda x: F.concat(F.when(x["l_returnflag"] == "R", "see [").otherwise("not ("), x["l_linenumber"].cast("string"), F.when(x["l_returnflag"] == "R", "]").otherwise(")"))
    answers = lines.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), said), " ").alias("answer"))
    refs = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("idx"), F.concat("l_partkey", F.lit("/"), "l_linenumber").alias("chunk_id"))
    return validate.used_references(answers, refs).select("query_id", F.col("pos").cast("long").alias("pos"), F.col("idx").cast("long").alias("idx"), F.substring_index("chunk_id", "/", 1).cast("long").alias("chunk_id"))


@query("WITH e AS (SELECT l_orderkey AS query_id, l_linenumber AS idx, l_suppkey AS corpus_id, l_returnflag AS kind, l_linestatus AS v, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber) AS r FROM lineitem WHERE l_discount > 0.02) SELECT query_id, idx::BIGINT AS idx, row_number() OVER (PARTITION BY query_id ORDER BY idx) AS number FROM e WHERE r = 1")
def reference_gating(spark, d):
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("idx"), F.lit("c").alias("corpus_id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("value"), (F.col("l_discount") > 0.02).alias("eligible"))
    cites = lines.select("query_id", "idx", F.col("idx").alias("pos"))
    return evaluate.gate_references(cites, lines).select("query_id", "idx", F.col("number").cast("long").alias("number"))


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'))")
def uncited_answers(spark, d):
    cited = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("cited"))
    return _t(spark, d, "orders").join(cited, "o_orderkey", "left").where("not coalesce(cited, false)").select(F.col("o_orderkey").alias("k"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') IS NOT NULL AS valid, len(list_filter(json_keys(props), lambda x: x <> 'k')) > 0 AS unknown_field FROM events")
def answer_json_check(spark, d):
    props = F.from_json("props", "map<string, string>")
    return _t(spark, d, "events").select("event_id", F.try_element_at(props, F.lit("k")).try_cast("bigint").alias("k"), F.try_element_at(props, F.lit("k")).isNotNull().alias("valid"), (F.size(F.array_except(F.map_keys(props), F.array(F.lit("k")))) > 0).alias("unknown_field"))


# --- cases and roll-ups --------------------------------------------------------------------------


@query("SELECT c_custkey AS case_id, k AS run_id, o.st AS status FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def case_latest_results(spark, d):
    last = _t(spark, d, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("l"))
    return _t(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("case_id"), F.col("l.o_orderkey").alias("run_id"), F.col("l.o_orderstatus").alias("status"))


@query("WITH g AS (SELECT p_type FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2), r AS (SELECT p_type, p_brand, p_partkey, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY CASE WHEN p_size > 9 THEN 0 ELSE 1 END, p_partkey) AS k FROM part JOIN g USING (p_type)) SELECT p_type, p_brand, p_partkey FROM r WHERE k = 1")
def shared_role_pairs(spark, d):
    part = _t(spark, d, "part")
    shared = part.groupBy("p_type").agg(F.countDistinct("p_brand").alias("n")).where("n >= 2").select("p_type")
    return rank.top_k(part.join(shared, "p_type", "left_semi"), ["p_type", "p_brand"], [F.when(F.col("p_size") > 9, 0).otherwise(1), F.col("p_partkey")], 1).select("p_type", "p_brand", "p_partkey")


@query("SELECT s_suppkey AS id, coalesce(n_name, 'nation ' || s_nationkey) AS display_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def display_names(spark, d):
    nation = _t(spark, d, "nation").select("n_nationkey", "n_name")
    return _t(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("id"), F.coalesce("n_name", F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))).alias("display_name"))


@query("SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS retrieval_ok, count(*) FILTER (quality = 1 AND toxic = 0) AS all_ok FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def stage_stats(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("retrieval_ok"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("all_ok"))


@query("SELECT event_type AS mode, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY 1")
def mode_distribution(spark, d):
    g = _t(spark, d, "events").groupBy(F.col("event_type").alias("mode")).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("t")))).select("mode", "n", (F.col("n") / F.col("t")).alias("share"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY 1")
def overview_matrix(spark, d):
    return _t(spark, d, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).count().fillna(0)


@query("SELECT o_orderpriority AS suite, count(*) AS runs, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_run, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY 1")
def suite_overview(spark, d):
    return _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("suite")).agg(F.count("*").alias("runs"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_run"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


@query("SELECT c_mktsegment AS grp, avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END) AS mean_positive, count(*) FILTER (c_acctbal <= 0) AS n_na FROM customer GROUP BY 1")
def coverage_nonzero(spark, d):
    return _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("grp")).agg(F.avg(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).alias("mean_positive"), F.count_if(F.col("c_acctbal") <= 0).alias("n_na"))


@query("SELECT l_orderkey AS k, count(*) AS citations, count(DISTINCT l_suppkey) AS corpora FROM lineitem GROUP BY 1")
def citation_counts(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("citations"), F.countDistinct("l_suppkey").alias("corpora"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (value > 90) AS escalated, sum(CASE WHEN value > 80 THEN 1 ELSE 0 END)::BIGINT AS retries FROM events GROUP BY 1")
def retry_stats(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 90).alias("escalated"), F.sum((F.col("value") > 80).cast("long")).alias("retries"))


@query("""WITH w AS (SELECT source, lang, count(*) / (SELECT count(*) FROM documents) AS weight FROM documents GROUP BY ALL), s AS (SELECT *, sum(weight) OVER (PARTITION BY source) AS total, max(lang) OVER (PARTITION BY source) AS last FROM w),
n AS (SELECT source, lang, lang = last AS is_last, CASE WHEN lang < last THEN round_even(weight / total * 96, 0)::BIGINT ELSE 0 END AS n FROM s)
SELECT source, lang, CASE WHEN is_last THEN 96 - sum(n) OVER (PARTITION BY source) ELSE n END::BIGINT AS n FROM n""")
def mode_allocation(spark, d):
    """96 cases for each source, dealt to languages by their documents; with the tables' numbers no share ends in a half."""
    docs = _t(spark, d, "documents")
    weights = docs.groupBy("source", "lang").agg(F.count("*").alias("docs")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("total")))).select("source", "lang", (F.col("docs") / F.col("total")).alias("weight"))
    return evaluate.allocate(weights.withColumn("at", F.col("lang")), "source", "at", "lang", "weight", 96)


@query("SELECT o_custkey, o_orderkey, ['retrieval', 'faithfulness', 'contract'][((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3 + 1)::INT] AS label FROM orders")
def cyclic_assignment(spark, d):
    return evaluate.cyclic(_t(spark, d, "orders"), "o_custkey", [F.col("o_orderkey")], ["retrieval", "faithfulness", "contract"]).select("o_custkey", "o_orderkey", "label")


@query("(SELECT s_nationkey AS k, 'both' AS side FROM supplier INTERSECT SELECT c_nationkey, 'both' FROM customer) UNION ALL (SELECT n_nationkey, 'none' FROM nation EXCEPT (SELECT s_nationkey, 'none' FROM supplier UNION SELECT c_nationkey, 'none' FROM customer))")
def set_operations(spark, d):
    s, c, n = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return s.intersect(c).withColumn("side", F.lit("both")).union(n.subtract(s.union(c)).withColumn("side", F.lit("none")))


@query("WITH s AS (SELECT doc_id, quality = 1 AS p FROM labels UNION ALL SELECT doc_id, toxic = 0 FROM labels) SELECT doc_id, bool_and(p) AS passed, count(*) AS scorers FROM s GROUP BY 1")
def case_passed(spark, d):
    lab = _t(spark, d, "labels")
    return evaluate.case_passed(lab.select("doc_id", (F.col("quality") == 1).alias("p")).union(lab.select("doc_id", F.col("toxic") == 0)), "doc_id", "p")


@query("WITH c AS (SELECT l_orderkey AS k, list(DISTINCT l_shipdate > DATE '1995-06-17') AS seen, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT k, CASE WHEN n > 4 THEN 'hard' WHEN n > 2 THEN 'medium' ELSE 'easy' END AS difficulty FROM c")
def case_difficulty(spark, d):
    c = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.countDistinct("l_suppkey").alias("n"))
    return c.select("k", evaluate.difficulty(F.lit(0), F.when(F.col("n") > 4, 3).when(F.col("n") > 2, 2).otherwise(1)).alias("difficulty"))


@query(f"SELECT doc_id, CASE WHEN {W.holds('cannot determine|depends on')} THEN 1.0 ELSE 0.7 END AS score FROM documents")
def abstention_scorer(spark, d):
    return _t(spark, d, "documents").select("doc_id", validate.abstention(F.col("text"), ["i er compliant"], ["cannot determine", "depends on"])["score"].alias("score"))


@query("WITH a AS (SELECT o_orderkey AS case_id, ['comparison', 'routing'][(o_orderkey % 2 + 1)::INT] AS mode, o_custkey AS c FROM orders) SELECT DISTINCT case_id, 'TOO_FEW_CORPORA' AS problem FROM a WHERE mode = 'comparison' UNION ALL SELECT DISTINCT case_id, 'UNKNOWN_CORPUS' FROM a WHERE c NOT IN (SELECT c_custkey FROM customer)")
def suite_validation(spark, d):
    cases = _t(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.element_at(F.array(F.lit("comparison"), F.lit("routing")), (F.col("o_orderkey") % 2 + 1).cast("int")).alias("mode"), F.array("o_custkey").alias("corpora"))
    return evaluate.validate_suite(cases, _t(spark, d, "customer").select(F.col("c_custkey").alias("corpus_id")))


@query("SELECT user_id, list_sort(list_distinct(list(event_type))) AS hints, arg_max(event_type, event_id) AS guard, bool_or(value > 95) AS strict FROM events GROUP BY 1")
def policy_merge(spark, d):
    rows = _t(spark, d, "events").select("user_id", "event_id", F.array("event_type").alias("hints"), F.col("event_type").alias("guard"), (F.col("value") > 95).alias("strict"))
    return evaluate.merge_policies(rows, "user_id", "event_id")


@query(f"WITH {_DISC}, s AS (SELECT query_id, corpus_id, confidence, 2 AS stage FROM disc UNION ALL SELECT query_id, corpus_id, 0.9, 0 FROM disc WHERE corpus_id = 1 UNION ALL SELECT query_id, corpus_id, round(confidence / 2 + 0.5, 6), 1 FROM disc WHERE corpus_id IN (1, 2, 3)) SELECT query_id, corpus_id, confidence, stage FROM (SELECT *, row_number() OVER (PARTITION BY query_id, corpus_id ORDER BY stage, confidence DESC) AS r FROM s) WHERE r = 1")
def match_merge(spark, d):
    probed = _discovered(spark, d)
    alias = probed.where("corpus_id = 1").withColumn("confidence", F.lit(0.9))
    judged = probed.where("corpus_id in (1, 2, 3)").withColumn("confidence", F.round(F.col("confidence") / 2 + 0.5, 6))
    return retrieve.merge_matches(alias, judged, probed)


@query(f"WITH {_NEAR}, {_TOP} SELECT query_id, chunk_id, rank <= 3 AND distance < 0.85 AS protected, row_number() OVER (PARTITION BY query_id ORDER BY -distance + CASE WHEN corpus_id = 2 THEN 0.1 ELSE 0 END DESC, CASE WHEN corpus_id = 2 THEN 0 ELSE 1 END, chunk_id) AS bumped FROM top WHERE rank <= 20")
def hint_bump(spark, d):
    hits = _near(spark, d, k=20)
    hinted = F.col("corpus_id") == 2
    order = Window.partitionBy("query_id").orderBy(F.desc(-F.col("distance") + F.when(hinted, 0.1).otherwise(0.0)), F.when(hinted, 0).otherwise(1), "chunk_id")
    return hits.select("query_id", "chunk_id", ((F.col("rank") <= 3) & (F.col("distance") < 0.85)).alias("protected"), F.row_number().over(order).alias("bumped"))


@query("WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[0-9A-Za-zÆØÅæøå]+'), lambda x: length(x) >= 4)) AS ws FROM benchmark), t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[0-9A-Za-zÆØÅæøå]+')) AS ts FROM documents) SELECT conv_id, turn, len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(c.text), '[0-9A-Za-zÆØÅæøå]+'), lambda x: length(x) >= 4)), list_distinct(regexp_extract_all(lower(d.text), '[0-9A-Za-zÆØÅæøå]+')))) AS overlap FROM conversations c JOIN documents d ON c.conv_id = d.doc_id")
def overlap_fallback(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    return _t(spark, d, "conversations").join(docs, F.col("conv_id") == F.col("doc_id")).select("conv_id", "turn", evaluate.overlap_fallback(F.col("text"), F.col("body")).cast("long").alias("overlap"))


@query("SELECT source AS corpus, count(*) AS chunks, count(*) FILTER (contains(text, chr(10))) AS with_article, max(length(text)) AS longest FROM documents GROUP BY 1")
def hierarchy_audit(spark, d):
    return _t(spark, d, "documents").groupBy(F.col("source").alias("corpus")).agg(F.count("*").alias("chunks"), F.count_if(F.col("text").contains("\n")).alias("with_article"), F.max(F.length("text")).cast("long").alias("longest"))



@query("WITH c AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1) SELECT k, len(list_intersect(['A', 'R'], f)) / 2 >= 0.8 AS passed, len(list_intersect(['A', 'R'], f)) / 2 AS score, list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(f, x)) AS missing FROM c")
def routing_and_completeness(spark, d):
    c = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("f"))
    flags = lambda *x: F.array(*map(F.lit, x))
    r = c.select("k", evaluate.routing_recall(flags("A", "R"), F.col("f")).alias("s"), evaluate.completeness(flags("A", "N", "R"), F.col("f")).alias("m"))
    return r.select("k", "s.passed", "s.score", "m.missing")


@query(f"WITH {_NEAR}, {_TOP}, h AS (SELECT query_id, chunk_id, distance, corpus_id, row_number() OVER (PARTITION BY query_id, corpus_id ORDER BY distance, chunk_id) <= 1 AS w FROM top WHERE rank <= 50), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, distance, chunk_id) AS r FROM h) SELECT query_id, chunk_id, distance, corpus_id AS scope, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS position FROM o WHERE r <= 15")
def scope_quota(spark, d):
    return evaluate.scope_quota(_near(spark, d).select("query_id", "chunk_id", "distance", F.col("corpus_id").alias("scope")), 1, 15)


@query("WITH e AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1) SELECT k, list_has_any(p, ['1-URGENT', '5-LOW']) AS confirmed FROM e")
def retrieval_calibration(spark, d):
    c = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("p"))
    return evaluate.calibrated(c.withColumn("e", F.array(F.lit("1-URGENT"), F.lit("5-LOW"))), "e", "p").select("k", "confirmed")
