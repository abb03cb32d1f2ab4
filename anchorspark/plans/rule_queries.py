"""Queries of single rules over columns, with SQL that states the expected values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refs as R
from ..functions import text as T
from ..operators import answers, evaluate, graph, listing, retrieve, scorers, validate
from ..sources import passages
from ..sources import preflight as check
from .queries import _tokenizer, _ADJ, _adjacent, _t, query


def _pick(words, at):
    return F.element_at(F.array(*map(F.lit, words)), (at + 1).cast("int"))


@query("SELECT p_partkey AS k, (2000 + p_size)::INT AS year, ['R', 'L', 'D', 'Z'][p_size % 4 + 1] AS type_char, p_partkey::INT AS number, ['reg', 'dir', 'dec', 'z'][p_size % 4 + 1] AS type_code, ['Regulation', 'Directive', 'Decision', 'Unknown'][p_size % 4 + 1] AS kind, 'eu-act-' || CASE WHEN p_size % 3 = 0 THEN 'cir' ELSE ['reg', 'dir', 'dec', 'z'][p_size % 4 + 1] END || '-' || (2000 + p_size) || '-' || p_partkey AS corpus_id, p_size % 2 = 0 AS official, CASE WHEN p_size % 2 = 0 THEN '32024R1689' END AS in_url FROM part")
def celex_numbers(spark, d):
    number = F.concat(F.lit(" 3"), (F.col("p_size") + 2000).cast("string"), _pick(["r", "L", "d", "Z"], F.col("p_size") % 4), F.col("p_partkey").cast("string"))
    url = F.when(F.col("p_size") % 2 == 0, "https://eur-lex.europa.eu/legal-content/DA/TXT/?uri=celex%3A32024r1689").otherwise("http://eur-lex.europa.eu/x?uri=3")
    parts = R.celex_parts(number)
    named = R.corpus_id(F.lit("EU Act!"), number, F.when(F.col("p_size") % 3 == 0, "implementing"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), *(parts[c].alias(c) for c in ("year", "type_char", "number", "type_code", "kind")), named.alias("corpus_id"), R.is_official_url(url).alias("official"), R.celex_of_url(url).alias("in_url"))


@query("SELECT p_partkey AS k, [4, 9, 14, 40, 1994][p_size % 5 + 1]::INT AS value FROM part")
def roman_numbers(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), T.roman_value(_pick(["iv", "IX", "XIV", "xl", "MCMXCIV"], F.col("p_size") % 5)).alias("value"))


@query("SELECT p_partkey AS k, 'loc:v1/chapter:iii/article:' || p_size AS location, p_size::VARCHAR AS article, 'iii' AS chapter FROM part")
def location_parts(spark, d):
    loc = T.location_id(chapter=F.lit(" III "), article=F.col("p_size").cast("string"), annex=F.lit(""))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), loc.alias("location"), T.location_parts(loc)["article"].alias("article"), T.location_parts(loc)["chapter"].alias("chapter"))


@query("""SELECT p_partkey AS k, round(greatest(0.2, least(1.0, p_size / 40.0)) * CASE p_size % 6 WHEN 0 THEN 0.18 WHEN 1 THEN -0.12 - 0.20 WHEN 2 THEN 0.15 WHEN 3 THEN 0.18 WHEN 4 THEN -0.10 ELSE 0 END, 6) AS delta FROM part""")
def role_deltas(spark, d):
    n = F.col("p_size") % 6
    intent = _pick(["TRANSPARENCY", "TRANSPARENCY", "OBLIGATIONS", "ENFORCEMENT", "CONTEXT", "CONTEXT"], n)
    role = _pick(["transparency", "recital_context", "obligations_normative", "enforcement_supervision", "enforcement_supervision", "prohibitions"], n)
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.round(T.role_delta(role, F.col("p_size") / 40.0, intent, "ENGINEERING"), 6).alias("delta"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN ['retrieval', 'multi_hop'] WHEN 1 THEN ['retrieval', 'multi_hop', 'robustness'] WHEN 2 THEN ['retrieval', 'abstention'] WHEN 3 THEN ['retrieval', 'faithfulness'] WHEN 4 THEN ['retrieval', 'abstention', 'faithfulness', 'robustness'] ELSE ['retrieval'] END AS types FROM orders")
def test_type_inference(spark, d):
    n = F.col("o_orderkey") % 6
    all_of = F.when(n == 0, F.array(F.lit("article:6"))).otherwise(F.array().cast("array<string>"))
    types = evaluate.inferred_test_types(_pick(["a", "Multi-edge-1", "c", "d", "Negation", "f"], n), all_of, F.when(n.isin(2, 4), "abstain").otherwise("answer"), n.isin(3, 4))
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), types.alias("types"))


@query("WITH g AS (SELECT l_orderkey AS k, list_distinct(list('article:' || l_suppkey % 7)) AS f FROM lineitem GROUP BY 1) SELECT k, (list_contains(f, 'article:1') OR list_contains(f, 'article:2')) AND list_contains(f, 'article:3') AND NOT list_contains(f, 'article:6') AS passed, round((list_contains(f, 'article:1')::INT + list_contains(f, 'article:2')::INT + list_contains(f, 'article:3')::INT) / 3, 6) AS score FROM g")
def anchor_scorer(spark, d):
    found = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.concat(F.lit("article:"), (F.col("l_suppkey") % 7).cast("string"))).alias("f"))
    a = lambda *n: F.array(*(F.lit(f"article:{x}") for x in n)).cast("array<string>")
    got = found.select("k", validate.anchor_score(F.col("f"), a(1, 2), a(), a(3), a(6)).alias("s"))
    return got.select("k", "s.passed", F.round("s.score", 6).alias("score"))


_TIES = ["references to dora", "GDPR contains references", "in  accordance with NIS2", "pursuant to the ai-act", "as defined in CRA", "under the GDPR", "der henviser til AI act", "i overensstemmelse med dora", "the gdpr is a law", "undergoes gdpr", "preferences of dora", "pursuant to gdprs"]


@query(f"""WITH a AS (SELECT l_orderkey, l_linenumber, lower(l_discount || ' ' || [{", ".join(f"'{t}'" for t in _TIES)}][((l_orderkey + l_linenumber) % 12 + 1)::INT] || ' ' || l_returnflag) AS t, l_suppkey % 3 + 1 AS n FROM lineitem),
c AS (SELECT *, (l_orderkey + l_linenumber) % 12 < 8 AS claimed FROM a) SELECT l_orderkey, l_linenumber, claimed, NOT claimed OR n >= 2 AS passed, CASE WHEN NOT claimed OR n >= 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM c""")
def cross_reference_scorer(spark, d):
    """The first eight wordings tie one act to another, the other four don't."""
    said = F.concat_ws(" ", F.col("l_discount").cast("string"), _pick(_TIES, (F.col("l_orderkey") + F.col("l_linenumber")) % 12), "l_returnflag")
    cited = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (F.col("l_suppkey") % 3 + 1).cast("int"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", evaluate.cross_references(said, cited).alias("s")).select("l_orderkey", "l_linenumber", "s.claimed", "s.passed", "s.score")


@query("SELECT o_orderkey AS k, o_orderkey % 4 IN (1, 2) AS retry FROM orders")
def retry_predicate(spark, d):
    """Two valid citations are wanted of the allowed numbers 1 to 3."""
    n = F.col("o_orderkey") % 4
    cited = F.when(n == 0, F.array(F.lit(1), F.lit(2))).when(n == 1, F.array(F.lit(1), F.lit(9))).when(n == 2, F.array().cast("array<int>")).otherwise(F.array(F.lit(3), F.lit(2), F.lit(9)))
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), answers.wants_retry(cited, F.array(F.lit(1), F.lit(2), F.lit(3)), 2).alias("retry"))


@query(f"WITH {_ADJ}, u AS (SELECT src, dst, 'co_occurrence' AS edge_type, w AS weight FROM adj UNION ALL SELECT src, dst, 'same_chapter', 0.1 FROM adj WHERE w < 0.5 UNION ALL SELECT src, dst, 'cites', 1.0 FROM adj) SELECT src, dst, edge_type, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY CASE edge_type WHEN 'same_chapter' THEN 0 WHEN 'co_occurrence' THEN 1 ELSE 2 END, weight DESC) AS r FROM u) WHERE r = 1")
def adjacency_edges(spark, d):
    adj = _adjacent(spark, d)
    kind = lambda df, name, w: df.select("src", "dst", F.lit(name).alias("edge_type"), w.alias("weight"))
    edges = kind(adj, "co_occurrence", F.col("weight")).unionByName(kind(adj.where("weight < 0.5"), "same_chapter", F.lit(0.1))).unionByName(kind(adj, "cites", F.lit(1.0)))
    return graph.adjacency(edges).withColumn("weight", F.round("weight", 6))


@query("SELECT p_partkey::VARCHAR AS node FROM part WHERE p_size % 3 = 1 ORDER BY p_partkey LIMIT 5")
def classification_articles(spark, d):
    roles = F.when(F.col("p_size") % 3 == 1, F.array(F.lit("classification"))).otherwise(F.array(F.lit("scope")))
    nodes = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("node"), F.lit(1).alias("mention_count"), roles.alias("roles"))
    return graph.by_role(nodes).where("role = 'classification' and place <= 5").select("node")


@query("""WITH p AS (SELECT p_partkey AS page_id, p_size::VARCHAR AS n, p_brand AS b, p_type AS t, p_name AS m FROM part), r AS (SELECT page_id, 0 AS chunk_index, NULL AS litra, '1. Rule ' || b AS text, n, m FROM p UNION ALL SELECT page_id, 1, 'a', 'a) ' || t, n, m FROM p)
SELECT page_id, chunk_index::INT AS chunk_index, 'II' AS chapter, n AS article, '1' AS paragraph, litra, m AS article_title, text FROM r""")
def official_passages(spark, d):
    html = F.concat(F.lit('<div id="cpt_ii"><div id="art_'), "p_size", F.lit('"><p class="oj-ti-art">Artikel '), "p_size", F.lit('</p><p class="oj-sti-art">'), "p_name", F.lit("</p><p>1. Rule "), "p_brand", F.lit("</p><p>a)</p><p>"), "p_type", F.lit("</p></div></div>"))
    part = _t(spark, d, "part").repartition(4 * spark.sparkContext.defaultParallelism)  # a small file of many pages is one or two tasks
    pages = part.select(F.col("p_partkey").alias("page_id"), html.alias("html"))
    return passages.passages(pages, _tokenizer(), "official").select("page_id", "chunk_index", "chapter", "article", "paragraph", "litra", "article_title", "text")


@query("""WITH g AS (SELECT l_orderkey AS case_id, list_distinct(list('article:' || l_suppkey % 7)) AS f, list_distinct(list(l_returnflag)) AS c FROM lineitem GROUP BY 1)
SELECT case_id, 'anchor_presence' AS scorer, list_contains(f, 'article:1') AND NOT list_contains(f, 'article:6') AS passed, list_contains(f, 'article:1')::INT::DOUBLE AS score FROM g
UNION ALL SELECT case_id, 'corpus_coverage', len(list_intersect(c, ['A', 'N'])) = 2, len(list_intersect(c, ['A', 'N'])) / 2 FROM g""")
def scorer_registry(spark, d):
    a = lambda *n: F.array(*map(F.lit, n)).cast("array<string>")
    found = F.collect_set(F.concat(F.lit("article:"), (F.col("l_suppkey") % 7).cast("string")))
    cases = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(found.alias("found"), F.collect_set("l_returnflag").alias("cited_corpora"))
    cases = cases.withColumns({"any_of": a("article:1"), "any_of_2": a(), "all_of": a(), "none_of": a("article:6"), "required_corpora": a("A", "N")})
    return scorers.run(cases, ["anchor_presence", "corpus_coverage"])


@query("SELECT p_partkey AS query_id, list_sort(list_distinct([p_brand, p_type])) AS corpora FROM part")
def alias_detection(spark, d):
    """Every question names its part's brand and type; all brands and types are aliases."""
    part = _t(spark, d, "part")
    names = part.select(F.explode(F.array("p_brand", "p_type")).alias("corpus_id")).distinct()
    asked = part.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("Gælder "), F.upper("p_brand"), F.lit(" for ("), "p_type", F.lit(")?")).alias("question"))
    return retrieve.alias_matches(asked, names.withColumn("alias", F.concat(F.lit(" "), "corpus_id")))


_ODD = [
    "", "<ul><li><ul><li><ul><li><ul><li>x</ul></ul></ul></ul>", '<table><tr><th>h</th></tr><tr></tr><tr></tr></table><figure></figure><img alt="a"><img alt=" ">', "<dl><dt>a</dt><dd>b</dd></dl><dl></dl><pre><code>x</code></pre><math><mrow></mrow></math>",
    '<table class="oj-table"><tr><td>Sektor</td><td>Delsektor</td><td>Type</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>',
    '<table class="oj-table"><tr><td>a</td></tr><tr><td>b</td></tr><tr><td>c</td></tr></table><p class="oj-note">n</p><blockquote>q</blockquote><div id="ART_6"></div><div id="cpt_I"></div><div id="anx_I"></div>',
]
_COUNTED = ["paragraphs", "list_items", "blockquote", "footnotes", "articles", "chapters", "annexes", "definitional_table"]
_MISSED = ["deep_nested_list", "suspicious_table", "figure", "image_with_alt", "definition_list", "code_block", "math_formula", "unclassified_table"]


@query("""WITH p AS (SELECT page_id, page_id % 6 AS n, len(regexp_extract_all(html, '<p[ >]')) AS ps, len(regexp_extract_all(html, '<li[ >]')) AS lis FROM pages)
SELECT page_id, ps + (n = 5)::INT AS paragraphs, lis + 4 * (n = 1)::INT AS list_items, (n = 5)::BIGINT AS blockquote, (n = 5)::BIGINT AS footnotes, (n = 5)::BIGINT AS articles, (n = 5)::BIGINT AS chapters, (n = 5)::BIGINT AS annexes, (n = 4)::BIGINT AS definitional_table,
(n = 1)::BIGINT AS deep_nested_list, (n = 2)::BIGINT AS suspicious_table, (n = 2)::BIGINT AS figure, (n = 2)::BIGINT AS image_with_alt, 2 * (n = 3)::BIGINT AS definition_list, 2 * (n = 3)::BIGINT AS code_block, 2 * (n = 3)::BIGINT AS math_formula, (n = 5)::BIGINT AS unclassified_table,
CASE n WHEN 1 THEN 'deep_nested_list' WHEN 2 THEN 'figure,suspicious_table,image_with_alt' WHEN 3 THEN 'math_formula,code_block,definition_list' WHEN 5 THEN 'unclassified_table' ELSE '' END AS warnings FROM p""")
def preflight_map(spark, d):
    """The pages, each behind one of six pieces of odd markup."""
    odd = F.element_at(F.array(*map(F.lit, _ODD)), (F.col("page_id") % 6 + 1).cast("int"))
    found = check.preflight(_t(spark, d, "pages").select("page_id", F.concat(odd, "html").alias("html")))
    of = lambda m, names: [F.coalesce(F.try_element_at(m, F.lit(n)), F.lit(0)).cast("long").alias(n) for n in names]
    return found.select("page_id", *of(F.col("handled"), _COUNTED), *of(F.col("unhandled"), _MISSED), F.array_join(F.transform("warnings", lambda w: w["category"]), ",").alias("warnings"))


_ACT = "SELECT page_id, '3' || (2000 + page_id % 25) || CASE WHEN page_id % 3 = 0 THEN 'L' WHEN page_id % 7 = 0 THEN 'X' ELSE 'R' END || page_id AS celex, regexp_extract(html, '<title>([^<]*)', 1) AS t FROM pages"


@query(f"""WITH a AS (SELECT *, lower(CASE WHEN page_id % 5 = 1 THEN '' ELSE t END) AS da, lower(t) AS en, page_id % 4 AS f FROM ({_ACT}) WHERE NOT contains(celex, 'X')),
q AS (SELECT page_id AS query_id, CASE page_id % 400 WHEN 0 THEN substr(split_part(t, ' ', 2), 1, 4) WHEN 100 THEN substr(split_part(t, ' ', 1), 2, 9) || ' ' || split_part(t, ' ', 2) WHEN 200 THEN 'e' ELSE split_part(t, ' ', 1) || split_part(t, ' ', 2) END AS term,
  CASE page_id % 300 WHEN 0 THEN 'RL' WHEN 100 THEN 'R' ELSE 'L' END AS letters, page_id % 200 = 0 AS forced FROM ({_ACT}) WHERE page_id % 100 = 0),
m AS (SELECT query_id, celex, t AS title, page_id, f FROM q JOIN a ON (contains(da, lower(trim(term))) OR contains(en, lower(trim(term))) OR contains(replace(da, ' ', ''), replace(lower(trim(term)), ' ', '')) OR contains(replace(en, ' ', ''), replace(lower(trim(term)), ' ', '')) OR contains(lower(celex), lower(trim(term))))
  AND substr(celex, 2, 4)::INT BETWEEN 2003 AND 2020 AND contains(letters, substr(celex, 6, 1)) AND (NOT forced OR f <> 1))
SELECT query_id, celex, row_number() OVER (PARTITION BY query_id ORDER BY page_id % 90 DESC, celex) AS rank FROM m""")
def act_listing(spark, d):
    """Pages as acts, their titles in two languages; every hundredth asks for a part of its own title."""
    key, title = F.col("page_id"), F.regexp_extract("html", "<title>([^<]*)", 1)
    letter = F.when(key % 3 == 0, "L").when(key % 7 == 0, "X").otherwise("R")
    pages = _t(spark, d, "pages").select("page_id", title.alias("t"))
    acts = pages.select(F.concat(F.lit("3"), (key % 25 + 2000).cast("string"), letter, key.cast("string")).alias("celex"), F.when(key % 5 != 1, F.col("t")).alias("title_da"), F.col("t").alias("title_en"), F.lit(None).cast("string").alias("title_de"), F.lit(None).cast("string").alias("title_fr"),
                        F.date_add(F.lit("2024-01-01").cast("date"), (key % 90).cast("int")).alias("date"), F.when(key % 4 == 1, False).when(key % 4 == 2, True).alias("in_force"))
    word = lambda n: F.split_part(F.col("t"), F.lit(" "), F.lit(n))
    term = F.when(key % 400 == 0, F.substring(word(2), 1, 4)).when(key % 400 == 100, F.concat(F.substring(word(1), 2, 9), F.lit(" "), word(2))).when(key % 400 == 200, "e").otherwise(F.concat(word(1), word(2)))
    asked = pages.where(key % 100 == 0).select(key.alias("query_id"), term.alias("term"), F.lit(2003).alias("year_from"), F.lit(2020).alias("year_to"), F.when(key % 300 == 0, "all").when(key % 300 == 100, "regulation").otherwise("directive").alias("kind"), (key % 200 == 0).alias("in_force_only"))
    known = listing.listed(acts)
    return listing.search(known, listing.index(known), asked).select("query_id", "celex", "rank")
