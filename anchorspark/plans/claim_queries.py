"""Queries of citation likeness, claim-stage notes and related content."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import place as P
from ..functions import text as T
from ..operators import citation_chain, claim_stages, claims, evaluate
from .queries import _t, query

_PAIRS = "p AS (SELECT a.vec_id AS k, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query(f"WITH {_PAIRS} SELECT k, CASE WHEN s >= 0.75 THEN [1, 2] ELSE [1] END AS verified, CASE WHEN s >= 0.75 THEN [9] ELSE [2, 9] END AS suspicious, CASE WHEN s < 0.75 THEN 1 END AS suggestion, round((1 + s) / 3, 3) AS overall FROM p")
def citation_likeness(spark, d):
    """Each vector as an answer that cites itself, its successor, and a number that no reference has."""
    vectors = _t(spark, d, "embeddings")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    cited = F.transform(claims.citation_contexts(F.lit("Se [1], [2] og [9]")), lambda c: F.struct(c["idx"], c["context"], F.col("embedding").alias("embedding")))
    sources = F.array(*(F.struct(F.lit(i).alias("idx"), F.lit("x").alias("chunk_text"), F.col(v).alias("embedding")) for i, v in ((1, "embedding"), (2, "next"))))
    checked = vectors.join(after, "vec_id").select(F.col("vec_id").alias("k"), claims.citation_similarity(cited, sources).alias("c"))
    return checked.select("k", "c.verified", F.col("c.suspicious.idx").alias("suspicious"), F.try_element_at(F.col("c.suspicious.suggestion"), F.lit(1)).alias("suggestion"), F.col("c.overall").alias("overall"))


_KINDS = "k AS (SELECT p_partkey AS k, p_size % 4 AS i, p_size % 3 AS e, p_name AS t FROM part)"
_NOTE = f"CASE WHEN i = 0 AND e <> 0 THEN '{claims.NOTES['scope']}' || chr(10) || chr(10) WHEN i = 1 AND e <> 1 THEN '{claims.NOTES['classification']}' || chr(10) || chr(10) WHEN i = 3 THEN '{claims.NOTES['high_risk']}' || chr(10) || chr(10) ELSE '' END"


@query(f"WITH {_KINDS} SELECT k, {_NOTE} || t || chr(10) || chr(10) || '{claims.CLOSING} [' || (e + 1) || '].' AS answer, NOT (i = 0 AND e <> 0) AS allow_fallback FROM k")
def legal_claim_notes(spark, d):
    parts = _t(spark, d, "part").withColumn("i", F.col("p_size") % 4).withColumn("e", F.col("p_size") % 3)
    named = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), F.col(c) + 1)
    gate = claims.legal_claim_gate(F.col("p_name"), named("i", "SCOPE", "CLASSIFICATION", "ENFORCEMENT", "GENERAL"), F.array(named("e", "DEFINITION", "CLASSIFICATION", "GENERAL")), F.col("e") + 1, assumes_high_risk=F.col("i") == 3)
    return parts.select(F.col("p_partkey").alias("k"), gate.alias("g")).select("k", "g.*")


_PLACES = """
r AS (SELECT l_orderkey AS k, l_returnflag AS rf, l_suppkey % 3 AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_suppkey % 3) AS pos FROM lineitem),
f AS (SELECT k, CASE rf WHEN 'R' THEN 'Artikel ' || s || CASE WHEN s > 0 THEN ' - Krav ' || s ELSE '' END WHEN 'A' THEN 'Bilag ' || s ELSE 'Betragtning ' || s END AS label, min(pos) AS pos FROM r GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS i FROM f),
q AS (SELECT k, pos, CASE WHEN s > 0 THEN 'Hvilke krav stiller Artikel ' || s || '?' ELSE 'Hvad siger Artikel 0?' END AS a FROM r WHERE pos <= 2 AND rf = 'R' UNION ALL SELECT DISTINCT k, 3, 'Hvilke rettigheder har registrerede personer?' FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS i FROM q),
l AS (SELECT k, string_agg(chr(10) || '  · ' || label, '' ORDER BY i) AS shown FROM t WHERE i <= 3 GROUP BY k),
m AS (SELECT k, string_agg(chr(10) || '  · "' || a || '"', '' ORDER BY i) AS asked FROM n WHERE i <= 2 GROUP BY k)
"""


@query(f"WITH {_PLACES} SELECT k, chr(10) || '{claims.RELATED_HEADING}' || shown || chr(10) || chr(10) || '{claims.ASK_HEADING}' || asked AS block FROM l JOIN m USING (k)")
def related_content(spark, d):
    lines = _t(spark, d, "lineitem").withColumn("s", F.col("l_suppkey") % 3)
    listed = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "s"))).alias("x"))
    given = lambda x, flag, name: F.when(x["l_returnflag"] == flag, x["s"].cast("string")).alias(name)
    title = lambda x: F.when(x["s"] > 0, F.concat(F.lit("Krav "), x["s"].cast("string")))
    references = F.transform("x", lambda x: F.struct(given(x, "R", "article"), title(x).alias("article_title"), given(x, "A", "annex"), F.lit(" ").alias("annex_title"), given(x, "N", "recital")))
    return listed.select("k", claims.related_content(references, F.lit("Hvad siger GDPR?")).alias("block"))


_CHAIN = """
WITH r AS (SELECT l_orderkey AS k, list((l_partkey % 9)::VARCHAR ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY 1),
d AS (SELECT k, k % 6 AS t, a, len(a) AS n, list_filter(generate_series(1, len(a)), lambda i: list_position(a, a[i]) = i) AS firsts, len(list_filter(a, lambda x: x = a[1])) AS alike FROM r),
e AS (SELECT *, CASE t WHEN 1 THEN CASE WHEN n >= 2 THEN 'MIN_CITATIONS_NOT_MET_DOWNSTREAM' END WHEN 2 THEN 'HALLUCINATED_IDX_DOWNSTREAM' WHEN 3 THEN CASE WHEN alike > 1 THEN 'CITATIONS_REQUIRED_DOWNSTREAM' END END AS fail_reason,
  CASE t WHEN 0 THEN firsts[1:3] WHEN 4 THEN firsts[1:2] WHEN 5 THEN CASE WHEN n < 2 THEN [1] WHEN a[1] = a[2] THEN [2] ELSE [2, 1] END ELSE [1] END AS numbers,
  CASE t WHEN 0 THEN firsts[1:3] WHEN 4 THEN firsts[1:2] WHEN 5 THEN CASE WHEN n < 2 THEN [1] ELSE [2, 1] END ELSE [1] END AS of_used FROM d)
SELECT k, fail_reason, CASE WHEN fail_reason IS NULL THEN array_to_string(list_transform(numbers, lambda i: '[' || i || '] art ' || a[i]), ';') ELSE '' END AS reference_lines,
  CASE WHEN fail_reason IS NULL THEN array_to_string(list_transform(of_used, lambda i: 'c' || i), ';') ELSE '' END AS used,
  CASE WHEN fail_reason IS NOT NULL THEN 'MISSING_REF' WHEN t = 0 THEN 'Intet sagt.' || chr(10) || chr(10) || array_to_string(list_transform(firsts[1:3], lambda i: 'Relevant hjemmel: Artikel ' || a[i] || ' [' || i || '].'), chr(10))
       WHEN t = 1 THEN 'Se [1].' WHEN t = 3 THEN 'Artikel ' || a[1] || ' [1]' WHEN t = 4 THEN 'Intet.' ELSE 'Se [2].' END AS answer
FROM e
"""


@query(_CHAIN)
def citation_chain_steps(spark, d):
    """Each order's lines are the references; answers that say nothing, cite too little, cite what isn't there, name an article, and two that fall back."""
    none = lambda kind: F.lit(None).cast(kind)

    def line(x, i):
        place, number = (x["l_partkey"] % 9).cast("string"), (i + 1).cast("string")
        return F.struct((i + 1).alias("idx"), F.concat(F.lit("c"), number).alias("chunk_id"), F.lit("x").alias("corpus_id"), place.alias("article"), *(none("string").alias(c) for c in ("paragraph", "recital", "annex")), F.concat(F.lit("art "), place).alias("label"), F.lit("").alias("words"))

    rows = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    rows = rows.select("k", F.transform("lines", line).alias("refs"))
    t = F.col("k") % 6
    of = {0: "Intet sagt.", 1: "Se [1].", 2: "Se [1][99].", 4: "Intet.", 5: "Se [2]."}
    text = F.coalesce(*(F.when(t == n, F.lit(s)) for n, s in of.items()), F.concat(F.lit("Artikel "), F.col("refs")[0]["article"]))
    rows = rows.withColumns({
        "answer": text, "question": F.lit(""), "profile": F.when(t >= 4, "LEGAL").otherwise("ENGINEERING"), "intent": F.when(t == 0, "SCOPE").otherwise("GENERAL"), "abstained": F.lit(False), "required": none("array<int>"),
        "least": F.when(t == 1, 2), "fallback": t >= 4, "structured": none("array<int>"), "rendered": none("string"),
    })
    return citation_chain.process(rows).select("k", "answer", "fail_reason", F.array_join("reference_lines", ";").alias("reference_lines"), F.array_join("used", ";").alias("used"))


_DUTY = r"(^|[^\p{L}\p{N}_])(must|shall|should|skal|kræver)($|[^\p{L}\p{N}_])"
_RISK = r"(^|[^\p{L}\p{N}_])(højrisiko|high[- ]risk)($|[^\p{L}\p{N}_])"
_LED = "Hvis systemet klassificeres som højrisiko (eller på anden måde omfattes af krav), så: "
_SPOKEN_LINES = ["Højrisiko betyder noget.", "- Systemet skal testes.", "  * It MUST hold", "Hvis det kræver mere, vent.", "Skaldyr er fine.", "If so, you should stop", "Hvisk: du skal", "high risk here"]


@query(f"""WITH s AS (SELECT conv_id, turn, text || chr(10) || [{", ".join(f"'{x}'" for x in _SPOKEN_LINES)}][((conv_id + turn) % 8 + 1)::INT] || chr(10) || [{", ".join(f"'{x}'" for x in _SPOKEN_LINES)}][((conv_id * 3 + turn * 5) % 8 + 1)::INT] AS said FROM conversations),
l AS (SELECT *, list_transform(string_split(said, chr(10)), lambda x: {{'x': x, 'd': regexp_matches(lower(x), '{_DUTY}'), 'p': regexp_extract(x, '^(\\s*(?:[-*]\\s*)?)', 1)}}) AS ls FROM s),
o AS (SELECT *, list_transform(ls, lambda e: CASE WHEN NOT e.d OR regexp_matches(substr(e.x, length(e.p) + 1), '(?i)^\\s*(Hvis|If)($|[^\\p{{L}}\\p{{N}}_])') THEN e.x ELSE e.p || '{_LED}' || substr(e.x, length(e.p) + 1) END) AS told, list_position(list_transform(ls, lambda e: e.d), true) AS f FROM l)
SELECT conv_id, turn, CASE WHEN f IS NOT NULL AND regexp_matches(lower(said), '{_RISK}') THEN array_to_string(told[:f - 1] || ['Bemærk: Jeg kan ikke konkludere klassifikation (fx højrisiko) ud fra de fundne kilder alene. Krav afhænger af klassifikationen.'] || told[f:], chr(10)) ELSE said END AS answer FROM o""")
def conditional_requirements(spark, d):
    pick = lambda n: F.element_at(F.array(*map(F.lit, _SPOKEN_LINES)), (n % 8 + 1).cast("int"))
    said = F.concat_ws("\n", "text", pick(F.col("conv_id") + F.col("turn")), pick(F.col("conv_id") * 3 + F.col("turn") * 5))
    return _t(spark, d, "conversations").select("conv_id", "turn", claim_stages.conditional(said).alias("answer"))


_ASKED = ["Er systemet højrisiko?", "Antag at det gælder", "Hvad nu?", "Is it high risk"]
_SAID = ["Det skal testes.", "Højrisiko systemer must stop.", "Intet.", "Det er højrisiko."]
_KINDS = [["SCOPE"], ["CLASSIFICATION"], [], ["ENFORCEMENT", "DEFINITION"]]
_INTENTS = ["SCOPE", "ENFORCEMENT", "CLASSIFICATION", "REQUIREMENTS", "GENERAL"]


@query(f"""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 THEN 'ENGINEERING' ELSE 'LEGAL' END AS p, [{", ".join(f"'{x}'" for x in _INTENTS)}][(o_orderkey % 5 + 1)::INT] AS i, o_custkey % 3 AS q, o_orderkey % 4 AS a, o_custkey % 4 AS e FROM orders),
f AS (SELECT *, q IN (0, 1) AS assumed, e = 1 AS classed, e IN (0, 3) AS scoped, q = 0 AS q_risk FROM o),
t AS (SELECT *, i = 'CLASSIFICATION' AND NOT classed AND NOT (p = 'LEGAL' AND assumed) AS no_class, p = 'ENGINEERING' AND i = 'SCOPE' AND NOT scoped AS no_scope, p = 'ENGINEERING' AND i = 'ENFORCEMENT' AS enforced FROM f),
g AS (SELECT *, CASE WHEN no_class THEN true WHEN no_scope OR enforced THEN false ELSE a IN (1, 3) END AS a_risk, CASE WHEN no_class OR no_scope OR enforced THEN false ELSE a IN (0, 1) END AS duty FROM t),
h AS (SELECT *, (q_risk OR a_risk) AND NOT classed AND NOT assumed AS open FROM g),
r AS (SELECT *, CASE WHEN open AND p = 'ENGINEERING' AND i = 'REQUIREMENTS' THEN 'engineering_requirements_needs_classification' WHEN open AND p = 'ENGINEERING' AND duty THEN 'engineering_normative_needs_classification' WHEN open AND p = 'LEGAL' AND duty THEN 'legal_conditionalize_requirements'
  WHEN no_class AND p = 'ENGINEERING' THEN 'engineering_classification_no_evidence' WHEN no_class THEN 'legal_classification_no_evidence' WHEN enforced THEN 'engineering_enforcement' WHEN no_scope THEN 'engineering_scope_no_evidence' END AS gate FROM h)
SELECT k, gate, coalesce(gate IN ('engineering_requirements_needs_classification', 'engineering_normative_needs_classification'), false) OR no_scope AS abstained,
  CASE gate WHEN 'engineering_requirements_needs_classification' THEN 'Krav kan ikke fastlægges, før klassifikation er afklaret.' WHEN 'engineering_normative_needs_classification' THEN 'Krav kan ikke fastlægges, før klassifikation er afklaret.'
    WHEN 'legal_conditionalize_requirements' THEN 'Bemærk: Jeg kan ikke konkludere klassifikation (fx højrisiko) ud fra de fundne kilder alene. Krav afhænger af klassifikationen.' WHEN 'legal_classification_no_evidence' THEN 'Kan ikke afgøres ud fra den foreliggende evidens, om systemet er ''højrisiko''. Klassifikation afhænger af systemets anvendelse og relevante kategorier.'
    ELSE CASE WHEN gate IS NULL THEN [{", ".join(f"'{x}'" for x in _SAID)}][(a + 1)::INT] ELSE '1. Klassifikation og betingelser' END END AS first_line FROM r""")
def claim_stage_gates(spark, d):
    pick = lambda words, n: F.element_at(F.array(*(F.array(*map(F.lit, w)).cast("array<string>") if isinstance(w, list) else F.lit(w) for w in words)), (n + 1).cast("int"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    gate = claim_stages.stage_gates(pick(_SAID, key % 4), pick(_ASKED, cust % 3), F.when(cust % 2 == 0, "ENGINEERING").otherwise("LEGAL"), pick(_INTENTS, key % 5), pick(_KINDS, cust % 4))
    rows = _t(spark, d, "orders").select(key.alias("k"), gate.alias("g"))
    return rows.select("k", "g.gate", "g.abstained", F.substring_index("g.answer", "\n", 1).alias("first_line"))


_QUESTIONS = ["Hvad siger artikel 3?", "Hvad siger betragtning 5?", "Artikel 3", "Forklar det", "Hvad betyder artikel 99"]
_MENTIONED = [[], ["ai_act"], ["nis2"], ["ai_act", "nis2"]]


@query(f"""WITH h AS (SELECT l_orderkey AS k, bool_or(l_suppkey % 7 = 3) AS a3, bool_or(l_partkey % 9 = 5) AS r5, round(min(l_quantity / 20), 9) AS best FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS q, o_custkey % 4 AS m, o_custkey % 3 = 0 AS single, o_custkey % 2 = 0 AS low, a3, r5, best FROM orders LEFT JOIN h ON k = o_orderkey)
SELECT k, CASE WHEN single AND m = 3 THEN 'several_corpora' WHEN single AND m = 2 THEN 'other_corpus' WHEN best IS NULL THEN 'no_evidence' WHEN q = 4 OR (q = 0 AND NOT a3) THEN 'article_not_found' WHEN q = 1 AND NOT r5 THEN 'recital_not_found'
  WHEN best > 1.3 THEN CASE WHEN q IN (0, 2) AND a3 THEN 'answer' ELSE 'too_far' END WHEN best > 0.5 AND NOT (q IN (0, 2) AND a3) AND q <> 1 AND NOT low THEN 'low_evidence' ELSE 'answer' END AS decision FROM o""")
def abstention_decisions(spark, d):
    """Orders ask, their lines are the hits; some name the corpus that is searched, some others."""
    hit = F.struct((F.col("l_suppkey") % 7).cast("string").alias("article"), (F.col("l_partkey") % 9).cast("string").alias("recital"), F.round(F.col("l_quantity") / 20, 9).cast("double").alias("distance"))
    hits = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(hit).alias("hits"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    at = lambda items, n: F.element_at(F.array(*items), (n + 1).cast("int"))
    named = at([F.array(*map(F.lit, m)).cast("array<string>") for m in _MENTIONED], cust % 4)
    decision = claim_stages.abstention(at(map(F.lit, _QUESTIONS), key % 5), F.col("hits"), named, F.lit("AI-Act"), F.when(cust % 3 == 0, "single").otherwise("all"), F.lit(0.5), 1.3, cust % 2 == 0)
    return _t(spark, d, "orders").join(hits, "o_orderkey", "left").select(key.alias("k"), decision.alias("decision"))


@query("""WITH p AS (SELECT *, p_partkey % 6 AS n, p_size::VARCHAR AS z FROM part)
SELECT p_partkey AS k, CASE n WHEN 0 THEN 'Artikel ' || z || CASE WHEN p_size % 2 = 0 THEN ', stk. 2' || CASE WHEN p_size % 4 = 0 THEN ', litra b' ELSE '' END ELSE '' END WHEN 1 THEN 'Bilag ' || z || ', punkt 3' || CASE WHEN p_size % 2 = 0 THEN ', 3.1' ELSE '' END WHEN 2 THEN 'Betragtning ' || z WHEN 3 THEN 'loc:v1/chapter:' || z WHEN 4 THEN p_name ELSE '(ukendt)' END AS label,
CASE n WHEN 0 THEN p_brand || ' | ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' | Søgetermer: a, b, c, d, e | Roller: scope, ' || p_type ELSE '' END WHEN 1 THEN substr(repeat(p_name || ' ', 40), 1, 260) WHEN 2 THEN p_name || ' / ' || p_type WHEN 3 THEN '<loc:v1/chapter:' || z || '>' WHEN 4 THEN '<' || p_name || '>' ELSE '<(ukendt)>' END AS excerpt,
p_brand || CASE n WHEN 0 THEN ', Artikel ' || z || ' (' || p_name || ')' || CASE WHEN p_size % 2 = 0 THEN ', stk. 2' || CASE WHEN p_size % 4 = 0 THEN ', litra b' ELSE '' END ELSE '' END WHEN 1 THEN ', Bilag ' || z || ', punkt 3' WHEN 2 THEN ', Betragtning ' || z WHEN 3 THEN ', Kapitel ' || z ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ', → Artikel 9' ELSE '' END AS display FROM p""")
def prompt_labels(spark, d):
    """Labels, excerpts and display names of passages with each kind of place, and of those without one."""
    n, size, z = F.col("p_partkey") % 6, F.col("p_size"), F.col("p_size").cast("string")
    meta = {
        "source": F.col("p_brand"), "article": F.when(n == 0, z), "article_title": F.col("p_name"), "paragraph": F.when((n == 0) & (size % 2 == 0), "2"), "litra": F.when((n == 0) & (size % 4 == 0), "b"), "annex": F.when(n == 1, z), "annex_point": F.when(n == 1, "3"),
        "annex_subpoint": F.when((n == 1) & (size % 2 == 0), "3.1"), "recital": F.when(n == 2, z), "location_id": F.when(n == 3, F.concat(F.lit("loc:v1/chapter:"), z)), "display": F.when(n == 4, F.col("p_name")), "heading_path_display": F.when(n == 0, F.col("p_brand")), "contextual_description": F.when(n == 0, F.col("p_type")),
    }
    meta = F.create_map(*(x for k, v in meta.items() for x in (F.lit(k), v)))
    told = (n == 0) & (size % 2 == 0)
    terms, roles = F.when(told, F.array(*map(F.lit, "abcdefg"))), F.when(told, F.array(F.lit("scope"), F.lit(""), F.col("p_type")))
    text = F.when(n == 1, F.repeat(F.concat("p_name", F.lit(" ")), F.lit(40))).when(n == 2, F.concat(F.lit("\n  "), "p_name", F.lit(" \n\n"), "p_type", F.lit("\nmore")))
    mentions = F.when(size % 5 == 0, F.lit("Artikel 9"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), P.prompt_label(meta).alias("label"), P.prompt_excerpt(meta, terms, roles, text).alias("excerpt"), P.display_name(meta, mentions).alias("display"))


@query("""WITH l AS (SELECT l_orderkey AS k, count(*) FILTER (l_discount <= 0.06) AS good, count(*) FILTER (l_discount > 0.06) AS odd FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey AS k, good, odd, CASE WHEN o_orderkey % 7 > 0 THEN good / (good + odd) END AS score FROM orders LEFT JOIN l ON k = o_orderkey)
SELECT k, coalesce(score, 1.0) AS score, coalesce(score, 1.0) >= 0.75 AS passed, CASE WHEN score IS NULL THEN 'citation verification not run' WHEN odd > 0 THEN good || ' verified, ' || odd || ' suspicious' ELSE 'all ' || good || ' citations verified' END AS message FROM c""")
def citation_verification(spark, d):
    """Each order's lines are checked citations; the mark in the message is left out, as engines round it differently."""
    good = F.array_compact(F.array_agg(F.when(F.col("l_discount") <= 0.06, F.col("l_linenumber"))))
    lines = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(good.alias("verified"), F.array_compact(F.array_agg(F.when(F.col("l_discount") > 0.06, F.col("l_linenumber")))).alias("suspicious"))
    checked = F.when((F.col("o_orderkey") % 7 > 0) & F.col("verified").isNotNull(), F.struct("verified", "suspicious", (F.size("verified") / (F.size("verified") + F.size("suspicious"))).alias("overall")))
    rows = _t(spark, d, "orders").join(lines, "o_orderkey", "left").select(F.col("o_orderkey").alias("k"), evaluate.citation_verification(checked).alias("s"))
    return rows.select("k", "s.score", "s.passed", F.regexp_replace("s.message", r" \(score: .*\)", "").alias("message"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 3) AND year(o_orderdate) BETWEEN 1993 AND 1996 THEN o_orderdate::DATE END AS day FROM orders""")
def iso_dates(spark, d):
    """Dates written in four ways, one that isn't a day, and one in another order."""
    day, n = F.col("o_orderdate").cast("date").cast("string"), F.col("o_orderkey") % 6
    text = F.when(n == 0, day).when(n == 1, F.concat(day, F.lit("T23:59:59Z"))).when(n == 2, F.concat(day, F.lit("T00:00:00.5+09:00"))).when(n == 3, F.concat(F.lit(" "), day, F.lit(" 12:00"))).when(n == 4, F.concat(F.substring(day, 1, 8), F.lit("32"))).otherwise(F.concat(F.substring(day, 9, 2), F.lit("-"), F.substring(day, 1, 7)))
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), T.iso_date(text, 1993, 1996).alias("day"))


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN '[Søgetermer: ' || p_type || ' | ' || p_brand || ']' || chr(10) || chr(10) ELSE '' END || CASE WHEN p_size % 2 = 0 THEN '[Kontekst: ' || p_type || ']' || chr(10) || chr(10) ELSE '' END ||
CASE p_partkey % 5 WHEN 0 THEN p_brand || ' (' || p_name || ')' || chr(10) || chr(10) WHEN 1 THEN p_name || chr(10) || chr(10) WHEN 2 THEN p_brand || chr(10) || chr(10) WHEN 3 THEN p_brand || chr(10) || chr(10) ELSE '' END || CASE WHEN p_partkey % 5 = 3 THEN 'a) ' ELSE '' END || p_name || chr(10) || p_type AS text FROM part""")
def index_texts(spark, d):
    """Points of annexes with and without a heading, one with a title, one that begins with a letter, and a passage without any of it."""
    n, size = F.col("p_partkey") % 5, F.col("p_size")
    meta = {"heading_path_display": F.when(n.isin(0, 2, 3), F.col("p_brand")), "annex_point": F.when(n < 4, "1"), "annex_point_title": F.when(n == 2, F.col("p_name")), "contextual_description": F.when(size % 2 == 0, F.col("p_type")), "enrichment_terms": F.when(size % 3 == 0, F.to_json(F.array("p_type", "p_brand"))).otherwise("no list")}
    text = F.concat(F.when(n == 3, "a) ").otherwise(""), "p_name", F.lit("\n"), "p_type")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), P.index_text(text, F.create_map(*(x for k, v in meta.items() for x in (F.lit(k), v)))).alias("text"))


@query("""WITH c AS (SELECT source, doc_id % 40 AS n, doc_id, 'T' || doc_id AS title, text FROM documents WHERE doc_id % 41 > 0),
a AS (SELECT source, n, min_by(title, doc_id) AS title, min_by(text, doc_id) FILTER (length(text) > 50) AS text, row_number() OVER (PARTITION BY source ORDER BY n) AS r, count(*) OVER (PARTITION BY source) AS total FROM c GROUP BY source, n),
b AS (SELECT *, trim(replace(CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END, chr(10), ' ')) AS body FROM a WHERE r <= 5)
SELECT source AS corpus_id, string_agg('### Artikel ' || n || ': ' || title || chr(10) || CASE WHEN coalesce(body, '') <> '' THEN 'Indhold: ' || body || chr(10) ELSE '' END, chr(10) ORDER BY n) || CASE WHEN any_value(total) > 5 THEN chr(10) || '... og ' || any_value(total) - 5 || ' yderligere artikler' ELSE '' END AS text FROM b GROUP BY source""")
def article_contents(spark, d):
    """Documents as the chunks of a source's articles; some have no article."""
    key = F.col("doc_id")
    chunks = _t(spark, d, "documents").select(F.col("source").alias("corpus_id"), key.alias("place"), F.when(key % 41 > 0, (key % 40).cast("string")).otherwise("II").alias("article"), F.concat(F.lit("T"), key.cast("string")).alias("article_title"), "text")
    return evaluate.article_contents(chunks, 60, 5)
