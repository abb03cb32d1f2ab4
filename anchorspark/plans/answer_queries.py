"""Queries of structured answers, reranking, expansion and scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import place as P
from ..functions import text as T
from ..operators import answers, evaluate, graph, rank
from ..sources import html_tables
from .queries import _ADJ, _adjacent, _t, query

# --- structured answers: one per order, an item per line ------------------------------------------

_LINES = "a AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr, l_linenumber AS n, l_quantity >= 25 AS ob, l_returnflag AS rf, l_linestatus AS ls, l_discount > 0.02 AS cited FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _answers(spark, d):
    lines = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey"))
    numbers = F.when(F.col("l_discount") > 0.02, F.array(F.col("l_linenumber").cast("int"))).otherwise(F.array().cast("array<int>")).alias("citations")
    item = F.struct(F.col("l_linenumber").alias("n"), (F.col("l_quantity") >= 25).alias("ob"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), numbers)
    listed = lines.groupBy("o_orderkey", "o_orderstatus", "o_orderpriority").agg(F.array_sort(F.collect_list(item)).alias("x"))
    level = lambda x: F.when(x["rf"] == "R", "SKAL").when(x["rf"] == "A", "INFO").otherwise("X")
    status = F.when(F.col("o_orderstatus") == "O", "JA").when(F.col("o_orderstatus") == "F", "NEJ").otherwise("P")
    root = F.struct(
        F.struct(status.alias("status"), F.col("o_orderpriority").alias("text"), F.array(F.lit(1)).alias("citations")).alias("classification"),
        F.transform(F.filter("x", lambda x: x["ob"]), lambda x: F.struct(x["rf"].alias("title"), F.concat(F.lit("shall "), x["ls"]).alias("text"), x["citations"].alias("citations"))).alias("obligations"),
        F.transform(F.filter("x", lambda x: ~x["ob"]), lambda x: F.struct(level(x).alias("level"), F.lit("note").alias("text"), x["citations"].alias("citations"))).alias("system_requirements"),
        F.array().cast("array<struct<question: string, why: string, citations: array<int>>>").alias("open_questions"),
    )
    return listed.select(F.col("o_orderkey").alias("k"), F.to_json(root).alias("answer"))


_SOME = lambda test, code: f"CASE WHEN bool_or({test}) THEN '{code}' END"


@query(f"WITH {_LINES} SELECT k, list_filter([{_SOME("st NOT IN ('O', 'F')", 'status:$.classification')}, {_SOME('ob AND NOT cited', 'no_citation:$.obligations')}, {_SOME("NOT ob AND rf = 'N'", 'level:$.system_requirements')}, {_SOME("NOT ob AND rf = 'R' AND NOT cited", 'no_citation:$.system_requirements')}], lambda c: c IS NOT NULL) AS problems FROM a GROUP BY k")
def engineering_answer_check(spark, d):
    return _answers(spark, d).select("k", answers.engineering_problems(F.col("answer")).alias("problems"))


@query(f"WITH {_LINES} SELECT k, list_filter([{_SOME('NOT ob AND NOT cited', 'missing_citations:$.system_requirements')}, {_SOME('NOT ob AND cited AND n > 3', 'citations_not_allowed:$.system_requirements')}, CASE WHEN count(*) FILTER (NOT ob) < 2 THEN 'min_requirements_bullets_not_met' END], lambda c: c IS NOT NULL) AS problems FROM a GROUP BY k")
def answer_policy_check(spark, d):
    allowed = F.array(F.lit(1), F.lit(2), F.lit(3))
    return _answers(spark, d).select("k", answers.policy_problems(F.col("answer"), allowed, F.lit("REQUIREMENTS"), 2).alias("problems"))


@query(f"WITH {_LINES} SELECT k, list_sort(list_distinct(list_concat([1], coalesce(list(n) FILTER (cited), [])))) AS numbers FROM a GROUP BY k")
def answer_citations(spark, d):
    return _answers(spark, d).select("k", answers.cited_numbers(F.col("answer")).alias("numbers"))


_BUL = lambda test, body: f"coalesce(string_agg(CASE WHEN {test} THEN '- ' || {body} || CASE WHEN cited THEN ' [' || n || ']' ELSE '' END || chr(10) END, '' ORDER BY n, rf, ls, cited), '')"


@query(f"WITH {_LINES} SELECT k, md5(trim('{answers.HEADINGS[0]}' || chr(10) || '- ' || CASE any_value(st) WHEN 'O' THEN 'JA' WHEN 'F' THEN 'NEJ' ELSE 'P' END || ': ' || any_value(pr) || ' [1]' || chr(10) || chr(10) || '{answers.HEADINGS[1]}' || chr(10) || {_BUL('ob', "rf || ': shall ' || ls")} || chr(10) || '{answers.HEADINGS[2]}' || chr(10) || {_BUL('NOT ob', "CASE rf WHEN 'R' THEN 'SKAL' WHEN 'A' THEN 'INFO' ELSE 'X' END || ': note'")} || chr(10) || '{answers.HEADINGS[3]}') || chr(10)) AS digest FROM a GROUP BY k")
def answer_rendering(spark, d):
    return _answers(spark, d).select("k", F.md5(answers.render_engineering(F.col("answer"))).alias("digest"))


@query()
def legal_answers(spark, d):
    """Problems and text of legal answers made of talks: tested on fixed rows, JSON texts of every shape."""
    talks = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    points = F.transform("x", lambda x: F.struct(x["text"].alias("point"), F.array((x["turn"] + 1).cast("int")).alias("citations")))
    made = talks.select("conv_id", F.to_json(F.struct(F.col("x")[0]["text"].alias("summary"), points.alias("key_points"))).alias("answer"))
    return made.select("conv_id", answers.legal_problems(F.col("answer")).alias("problems"), answers.render_legal(F.col("answer")).alias("text"))


_MARKED = "m AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_linenumber) FILTER (l_returnflag = 'R')) AS r, list_sort(list(DISTINCT l_linenumber) FILTER (l_linestatus = 'O')) AS o FROM lineitem GROUP BY 1), t AS (SELECT k, coalesce(r, []) AS r, coalesce(o, []) AS o FROM m)"
_TEXT = "'1. A' || chr(10) || '2. B' || chr(10) || '- y' || array_to_string(list_transform(r, lambda x: ' [' || x || ']'), '')"


def _marked(spark, d):
    lines = _t(spark, d, "lineitem").withColumn("n", F.col("l_linenumber").cast("int"))
    of = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("n"))))
    listed = lines.groupBy(F.col("l_orderkey").alias("k")).agg(of(F.col("l_returnflag") == "R").alias("r"), of(F.col("l_linestatus") == "O").alias("o"))
    return listed.select("k", "o", F.concat(F.lit("1. A\n2. B\n- y"), answers.marks(F.col("r"))).alias("answer"))


@query(f"WITH {_MARKED} SELECT k, {_TEXT} || array_to_string(list_transform(list_sort(list_filter(o, lambda x: NOT list_contains(r, x))), lambda x: ' [' || x || ']'), '') AS answer FROM t")
def forced_citations(spark, d):
    return _marked(spark, d).select("k", answers.force_citations(F.col("answer"), F.col("o")).alias("answer"))


@query(f"WITH {_MARKED} SELECT k, CASE WHEN len(r) = 0 THEN 'no_citations' WHEN len(list_filter(r, lambda x: NOT list_contains(o, x))) > 0 THEN 'unknown_citation' END AS reason, list_sort(list_filter(r, lambda x: list_contains(o, x))) AS cited FROM t")
def citation_integrity(spark, d):
    return _marked(spark, d).select("k", answers.integrity(F.col("answer"), F.col("o")).alias("i")).select("k", "i.reason", "i.cited")


@query(f"WITH {_MARKED} SELECT k, CASE WHEN len(r) > 0 THEN {_TEXT} ELSE '1. A' || chr(10) || '2. B' || chr(10) || '- y' || chr(10) || chr(10) || '{answers.HEADINGS[1]}' || chr(10) || '- Relevant hjemmel: Artikel 6 [7]' END AS answer FROM t")
def relevant_basis(spark, d):
    label = F.array(F.struct(F.lit(7).alias("number"), F.lit("Artikel 6").alias("label")))
    return _marked(spark, d).select("k", answers.relevant_basis(F.col("answer"), label).alias("answer"))


@query("SELECT l_orderkey AS k, CASE WHEN count(*) FILTER (l_discount > 0.05) < 2 THEN 'insufficient_evidence' ELSE 'answer' END AS gate, count(*) FILTER (l_discount > 0.05) AS n_citable FROM lineitem GROUP BY 1")
def evidence_gate(spark, d):
    n = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count_if(F.col("l_discount") > 0.05).alias("n_citable"))
    return n.select("k", "n_citable", answers.evidence_gate(F.lit("x"), F.col("n_citable")).alias("gate"))


@query("SELECT p_partkey AS k, '- Ja, ' || p_name || ' SKAL' || chr(10) || 'Der SKAL implementeres ' || p_type || chr(10) || '1. Der SKAL sikres, at det KAN IKKE og BØR' AS text FROM part")
def danish_wording(spark, d):
    told = F.concat(F.lit("- Yes, "), "p_name", F.lit(" must\nImplement "), "p_type", F.lit("\n1. Ensure that det cannot og should"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), answers.danish_modals(told).alias("text"))


# --- ranks ---------------------------------------------------------------------------------------

_HITS = "h AS (SELECT l_orderkey AS q, l_partkey * 10 + l_linenumber AS c, l_discount * 10 AS dist, l_tax AS delta, l_linenumber AS pos, l_quantity AS qty, l_returnflag AS rf FROM lineitem)"


def _order_hits(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), (F.col("l_discount") * 10).alias("distance"), F.col("l_tax").alias("delta"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("bm25"), F.col("l_returnflag").alias("flag"))


@query(f"WITH {_HITS} SELECT q AS query_id, c AS chunk_id, row_number() OVER (PARTITION BY q ORDER BY delta - dist DESC, pos * 100000000 + c) AS place FROM h")
def role_rerank(spark, d):
    return rank.role_rerank(_order_hits(spark, d).withColumn("pos", F.col("pos") * 100_000_000 + F.col("chunk_id"))).select("query_id", "chunk_id", F.col("place").cast("long").alias("place"))


@query(f"WITH {_HITS} SELECT q AS query_id, c AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, c) AS r FROM h) WHERE r <= 3 AND dist < 0.85")
def protected_hits(spark, d):
    return rank.protected(_order_hits(spark, d)).select("query_id", "chunk_id")


@query(f"WITH {_HITS}, n AS (SELECT *, 1 / (1 + dist) AS near FROM h), w AS (SELECT *, min(near) OVER p AS a, max(near) OVER p AS b, min(qty) OVER p AS e, max(qty) OVER p AS f FROM n WINDOW p AS (PARTITION BY q)) SELECT q AS query_id, c AS chunk_id, round(0.25 * CASE WHEN b > a THEN (near - a) / (b - a) ELSE 0 END + 0.25 * CASE WHEN f > e THEN (qty - e) / (f - e) ELSE 0 END + 0.35 * (rf = 'R')::INT + 0.15 * least(1, greatest(0, (delta + 0.15) / 0.33)), 6) AS score FROM w")
def candidate_scores(spark, d):
    return rank.candidate_score(_order_hits(spark, d).withColumn("hinted", F.col("flag") == "R")).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_HITS} SELECT q AS query_id, c AS chunk_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rf = 'R' DESC, dist, c) AS r FROM h) WHERE r <= 3")
def precise_first(spark, d):
    return rank.precise_first(_order_hits(spark, d), "query_id", F.col("flag") == "R", [F.asc("distance"), F.asc("chunk_id")], 3).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_HITS}, f AS (SELECT * FROM h WHERE pos <= 3), n AS (SELECT q, count(*) FILTER (rf = 'R') >= 2 AS enough FROM f GROUP BY 1), b AS (SELECT h.* FROM h JOIN n USING (q) WHERE NOT enough AND rf = 'R') SELECT q AS query_id, c AS chunk_id FROM f WHERE q NOT IN (SELECT q FROM b) UNION ALL SELECT q, c FROM b")
def citable_second_pass(spark, d):
    hits = _order_hits(spark, d).withColumn("citable", F.col("flag") == "R")
    return rank.second_pass(hits.where("pos <= 3"), hits).select("query_id", "chunk_id")


@query("SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN 5 WHEN p_size % 2 = 0 THEN 4 ELSE 3 END AS score FROM part")
def anchor_precision(spark, d):
    meta = F.create_map(F.lit("article"), (F.col("p_size") % 5).cast("string"), F.lit("paragraph"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), rank.precision_score(meta, F.array(F.lit("article:0"))).alias("score"))


# --- graph ---------------------------------------------------------------------------------------

_NODES = "nd AS (SELECT p_partkey AS node, p_size AS mention_count, CASE WHEN p_size % 3 = 0 THEN 'scope' WHEN p_size % 3 = 1 THEN 'classification' ELSE 'definitions' END AS role FROM part)"


def _nodes(spark, d):
    kind = F.when(F.col("p_size") % 3 == 0, "scope").when(F.col("p_size") % 3 == 1, "classification").otherwise("definitions")
    return _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("node"), F.col("p_size").alias("mention_count"), F.array(kind).alias("roles"))


@query(f"WITH {_NODES} SELECT role, node::VARCHAR AS node, place FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY node, mention_count DESC) AS place FROM nd) WHERE place <= 5")
def foundational_articles(spark, d):
    return graph.foundational(_nodes(spark, d)).withColumn("place", F.col("place").cast("long"))


_SEEDS = "sd AS (SELECT DISTINCT l_orderkey AS q, l_partkey::VARCHAR AS seed, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2)"


def _seeds(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").cast("string").alias("seed")).agg(F.min("l_linenumber").alias("pos"))


@query(f"WITH {_ADJ}, {_SEEDS}, one AS (SELECT seed AS s, dst AS node, w AS score FROM (SELECT DISTINCT seed FROM sd) JOIN adj ON seed = src), two AS (SELECT s, dst AS node, score * w * 0.5 AS score FROM one JOIN adj ON node = src WHERE dst <> s), f AS (SELECT q, node, max(score) AS score FROM sd JOIN (SELECT * FROM one UNION ALL SELECT * FROM two) ON seed = s WHERE (q, node) NOT IN (SELECT q, seed FROM sd) GROUP BY 1, 2) SELECT q AS query_id, node, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, node) AS r FROM f) WHERE r <= 5")
def seed_expansion(spark, d):
    return graph.expand_seeds(_adjacent(spark, d), _seeds(spark, d)).select("query_id", "node", F.round("score", 6).alias("score"))


@query(f"WITH {_ADJ}, {_NODES}, {_SEEDS}, ask AS (SELECT DISTINCT q FROM sd JOIN nd ON node::VARCHAR = seed WHERE role = 'classification'), fr AS (SELECT role, node::VARCHAR AS node, row_number() OVER (PARTITION BY role ORDER BY node) AS place FROM nd WHERE role <> 'classification'), u AS (SELECT q, node, 0 AS part, CASE role WHEN 'scope' THEN 1 ELSE 2 END AS a, -place::DOUBLE AS w FROM ask, fr WHERE place <= 2 UNION ALL SELECT q, dst, 1, pos, w FROM sd JOIN adj ON seed = src WHERE w >= 0.3), x AS (SELECT *, row_number() OVER (PARTITION BY q, node ORDER BY part, a, w DESC) AS r FROM u WHERE (q, node) NOT IN (SELECT q, seed FROM sd)), y AS (SELECT q, node, row_number() OVER (PARTITION BY q ORDER BY part, a, w DESC, node) AS position FROM x WHERE r = 1) SELECT q AS query_id, node, position FROM y WHERE position <= 10")
def context_expansion(spark, d):
    return graph.expand_context(_adjacent(spark, d), _nodes(spark, d), _seeds(spark, d).withColumnRenamed("seed", "node")).withColumn("position", F.col("position").cast("long"))


@query("SELECT p_partkey AS k, [p_size::VARCHAR, 'ANNEX:IV'] AS nodes FROM part")
def question_nodes(spark, d):
    asked = F.concat(F.lit("Hvad siger artikel "), "p_size", F.lit(" og bilag iv, jf. Article "), "p_size", F.lit("?"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), graph.question_nodes(asked).alias("nodes"))


# --- scorers and cases ----------------------------------------------------------------------------


@query("SELECT user_id AS k, round(avg((value > 30)::INT), 6) AS score, avg((value > 30)::INT) >= 0.75 AS passed FROM events GROUP BY 1")
def faithfulness_scorer(spark, d):
    got = evaluate.faithfulness(_t(spark, d, "events").select(F.col("user_id").alias("k"), (F.col("value") > 30).alias("ok")), "k", "ok")
    return got.select("k", F.round("score", 6).alias("score"), "passed")


@query("SELECT event_id AS k, round(least(1, greatest(0, (value - 20) / 10)), 6) AS score, value - 20 >= 7.5 AS passed FROM events")
def relevancy_scorer(spark, d):
    return _t(spark, d, "events").select(F.col("event_id").alias("k"), evaluate.relevancy(F.col("value") - 20).alias("s")).select("k", F.round("s.score", 6).alias("score"), "s.passed")


@query("SELECT doc_id, CASE WHEN toxic IS NULL THEN 'not_run' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS state FROM documents LEFT JOIN labels USING (doc_id)")
def contract_states(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left").select("doc_id", evaluate.three_state(F.col("quality") == 1).alias("state"))


@query("SELECT p_partkey AS k, p_size % 4 >= 2 AS passed, CASE WHEN p_size % 4 >= 2 THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM part")
def enrichment_scorer(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), evaluate.enrichment_coverage(F.col("p_name"), F.col("p_size") % 4).alias("s")).select("k", "s.passed", "s.score")


@query("WITH r AS (SELECT l_orderkey AS q, l_returnflag AS a, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2), o AS (SELECT q, min(n) FILTER (a IN ('R', 'A')) AS any_n, max(n) FILTER (a = 'N') AS all_n FROM r GROUP BY 1) SELECT q AS query_id, list_sort(list_distinct(list_filter([any_n, all_n], lambda x: x IS NOT NULL))) AS numbers, list_sort(list_concat(CASE WHEN any_n IS NULL THEN ['a', 'r'] ELSE [] END, CASE WHEN all_n IS NULL THEN ['n'] ELSE [] END)) AS missing FROM o")
def required_anchor_numbers(spark, d):
    lines = _t(spark, d, "lineitem")
    refs = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("anchor"))
    wanted = F.array(*(F.struct(F.lit(g).alias("grp"), F.lit(a).alias("anchor"), F.lit(e).alias("every")) for g, a, e in (("any", "R", False), ("any", "A", False), ("all", "N", True))))
    return evaluate.required_numbers(refs, refs.select("query_id").distinct().select("query_id", F.inline(wanted)))


@query("WITH c AS (SELECT p_partkey AS id, p_size AS size, p_brand AS b FROM part), f AS (SELECT b, arg_min(id, (size, id)) AS located FROM c GROUP BY 1) SELECT o_orderkey AS case_id, coalesce(c.id, f.located) AS found FROM orders LEFT JOIN c ON c.id = o_custkey * 3 LEFT JOIN f ON f.b = 'Brand#1' || (o_orderkey % 7)")
def case_chunk_lookup(spark, d):
    chunks = _t(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_size").alias("chunk_index"), F.concat(F.lit("loc:v1/"), "p_brand").alias("location_id"))
    cases = _t(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") * 3).alias("chunk_id"), F.concat(F.lit("Brand#1"), F.col("o_orderkey") % 7).alias("anchor"))
    return evaluate.case_chunks(cases, chunks)


@query("WITH s AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT count(*) AS count, min(v) AS min, min(v) FILTER (i = floor(0.5 * (n - 1))) AS p50, min(v) FILTER (i = floor(0.8 * (n - 1))) AS p80, min(v) FILTER (i = floor(0.9 * (n - 1))) AS p90, max(v) AS max FROM s")
def distance_quantiles(spark, d):
    return evaluate.distance_quantiles(_t(spark, d, "events"), "value")


@query("SELECT count(*) AS n_a, round(avg(p_size % 10 / 10.0), 9) AS precision_a, round(avg(p_size % 7 / 7.0), 9) AS recall_a, count(*) AS n_b, round(avg(p_size % 9 / 9.0), 9) AS precision_b, round(avg(p_size % 5 / 5.0), 9) AS recall_b, round(avg(p_size % 9 / 9.0) - avg(p_size % 10 / 10.0), 9) AS precision_gain, round(avg(p_size % 5 / 5.0) - avg(p_size % 7 / 7.0), 9) AS recall_gain FROM part")
def role_run_comparison(spark, d):
    part = _t(spark, d, "part")
    made = lambda p, r: part.select(F.col("p_partkey").alias("k"), (F.col("p_size") % p / F.lit(float(p))).alias("precision"), (F.col("p_size") % r / F.lit(float(r))).alias("recall"))
    both = evaluate.compare_runs(made(10, 7), made(9, 5), "k")
    return both.select(*(F.round(c, 9).alias(c) if "n_" not in c[:2] else F.col(c) for c in both.columns))


@query("SELECT o_orderkey AS k, CASE WHEN r = 1 THEN stem ELSE stem || '-' || r END AS case_id FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY o_orderkey) AS r FROM (SELECT o_orderkey, lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g')) AS stem FROM orders))")
def case_ids(spark, d):
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), T.ascii_slug(F.col("o_orderpriority")).alias("stem"))
    return evaluate.numbered_ids(orders, "stem", [F.asc("k")]).select("k", "case_id")


@query("SELECT p_partkey AS k, p_size % 3 = 0 AS multi_part, true AS recital_quote, true AS substantive, false AS chapter_overview FROM part")
def question_kinds(spark, d):
    asked = F.concat(F.lit("1) Hvad siger betragtning "), "p_size", F.when(F.col("p_size") % 3 == 0, "\n2. og").otherwise(""), F.lit(" mere?"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), T.question_kind(asked).alias("q")).select("k", "q.*")


_NAMED = [("see Annex II", "Annex II"), ("Artikel 7 (2) siger", "Artikel 7"), ("jf. art. 12b", "art. 12b"), ("Artikel 9 ( 2 )siger", "Artikel 9 ( 2 )"), ("Betragtning 12", "Betragtning 12"), ("none at all", None), ("Artiklen 7", None), ("Recital 5, then Article 3", "Article 3")]


@query(f"""WITH p AS (SELECT *, [{", ".join("'" + t + "'" for t, _ in _NAMED)}][(p_partkey % 8 + 1)::INT] AS said, [{", ".join("NULL" if r is None else "'" + r + "'" for _, r in _NAMED)}][(p_partkey % 8 + 1)::INT] AS ref FROM part),
c AS (SELECT *, p_size % 9 IN (0, 1, 2, 3, 4, 6) AS placed FROM p)
SELECT p_partkey AS k, placed OR ref IS NOT NULL AS citable, CASE WHEN NOT placed THEN CASE WHEN p_size % 2 = 0 THEN p_brand WHEN p_size % 3 = 0 THEN p_type ELSE 'Unknown source' END || ', ' || ref END AS label FROM c""")
def citable_passages(spark, d):
    """Places in each kind of metadata, places that don't count, and references of each form in the text."""
    n, size = F.col("p_size") % 9, F.col("p_size")
    meta = {
        "article": F.when(n == 0, "6").otherwise(""), "chapter": F.when(n == 1, "iii"), "location_id": F.when(n == 2, "loc:v1/Chapter:iii").when(n == 5, "loc:v1/section:1"), "heading_path": F.when(n == 3, '["chapter:iv", "article:10"]').when(n == 7, '["section:1"]').when(n == 8, "article:10"),
        "recital": F.when(n == 4, "3"), "annex": F.when(n == 6, "ii"), "source": F.when(size % 2 == 0, F.col("p_brand")), "corpus_id": F.when(size % 3 == 0, F.col("p_type")),
    }
    said = F.element_at(F.array(*(F.lit(t) for t, _ in _NAMED)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), P.citability(F.create_map(*(x for k, v in meta.items() for x in (F.lit(k), v))), said).alias("c")).select("k", "c.*")


@query("SELECT p_partkey AS k, 'Genstand ' || p_size AS title FROM part")
def title_repair(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), T.repair_title(F.concat(F.lit("G e n s t a n d "), "p_size")).alias("title"))


@query("SELECT p_partkey AS page_id, r::INT AS row_index, 'definitional' AS kind, p_brand AS sector, CASE r WHEN 2 THEN p_type ELSE 'a) ' || p_type END AS subsector, CASE r WHEN 2 THEN p_size::VARCHAR ELSE p_name END AS entity FROM part, (VALUES (1), (2)) t(r)")
def html_table_rows(spark, d):
    page = F.concat(F.lit("<table><tr><th>Sektor</th><th>Delsektor</th><th>Type enhed</th></tr><tr><td rowspan='2'>"), "p_brand", F.lit("</td><td>a) "), "p_type", F.lit("</td><td>"), "p_name", F.lit("</td></tr><tr><td>"), "p_type", F.lit("</td><td>"), "p_size", F.lit("</td></tr><tr><td>x</td></tr></table>"))
    return html_tables.page_tables(_t(spark, d, "part").select(F.col("p_partkey").alias("page_id"), page.alias("html"))).drop("table_index", "cells")
