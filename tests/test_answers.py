"""Structured answers, tables, titles and graph expansion on fixed rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from anchorspark.functions import text as T
from anchorspark.operators import answers, evaluate, graph, rank
from anchorspark.sources import html_tables

GOOD = {
    "classification": {"status": "JA", "text": "ok", "citations": [1]},
    "obligations": [{"title": "T", "text": "skal x", "citations": [2, 1]}],
    "system_requirements": [{"level": "INFO", "text": "a", "citations": []}],
    "open_questions": [{"question": "q", "why": "w", "citations": []}],
    "audit_evidence_bullets": [{"text": "e", "citations": [3]}],
}


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, a string")
    return [r["x"] for r in rows.select("i", column(F.col("a")).alias("x")).orderBy("i").collect()]


def test_engineering_problems(spark):
    bad = GOOD | {"x": 1, "obligations": [{"title": "T", "text": "shall", "citations": []}], "system_requirements": [{"level": "NO", "text": "a", "citations": [0]}]}
    typed = GOOD | {"classification": {"status": "JA", "text": 5, "citations": [1]}, "open_questions": 3}
    short = {k: v for k, v in GOOD.items() if k != "obligations"}
    got = values(spark, answers.engineering_problems, *map(json.dumps, (GOOD, bad, typed, short)), "nope", "[1]", "", None)
    assert got[:2] == [[], ["unknown_fields:$", "no_citation:$.obligations", "citations:$.system_requirements", "level:$.system_requirements"]]
    assert got[2:4] == [["shape:$.classification", "shape:$.open_questions"], ["missing_fields:$"]]
    assert got[4:] == [["not_json"]] * 4
    assert values(spark, lambda a: answers.engineering_problems(a, need_citations=False), json.dumps(bad))[0] == ["unknown_fields:$", "citations:$.system_requirements", "level:$.system_requirements"]


def test_rendering(spark):
    want = "1. Klassifikation og betingelser\n- JA: ok [1]\n\n2. Relevante juridiske forpligtelser\n- T: skal x [1] [2]\n\n3. Konkrete systemkrav\n- INFO: a\n\nMinimum ved tilsyn (evidens/artefakter)\n- e [3]\n\n4. Åbne spørgsmål / risici\n- q — w\n"
    assert values(spark, answers.render_engineering, json.dumps(GOOD)) == [want]
    assert values(spark, answers.cited_numbers, json.dumps(GOOD), '{"summary": "S [4]"}', None) == [[1, 2, 3], [4], []]


def test_legal(spark):
    full = {"summary": "S [2]", "key_points": [{"point": "p", "citations": [3, 1]}, {"point": "z"}], "legal_basis": ["b"], "caveats": ["c", " "]}
    texts = [json.dumps(full), '{"summary": "x"}', '{"summary": 4, "key_points": 3, "caveats": [1]}', "no"]
    assert values(spark, answers.legal_problems, *texts) == [[], [], ["shape:$.summary", "shape:$.key_points", "shape:$.caveats"], ["not_json"]]
    assert values(spark, answers.render_legal, *texts[:2]) == ["**Retsgrundlag**\n- b\n\n**Juridisk analyse**\nS [2]\n\n**Hovedpunkter**\n- p [1] [3]\n- z\n\n**Forbehold**\n- c\n", "x\n"]


def test_line_edits(spark):
    both = F.array(F.lit(1), F.lit(2))
    texts = ["1. A\n- x\n2. B\n- y [1]\n3. C\n- z\n\nReferencer:\n[2] foo", "- only", "none", None]
    assert values(spark, lambda a: answers.force_citations(a, both), *texts) == ["1. A\n- x\n2. B\n- y [1] [2]\n3. C\n- z\n\nReferencer:\n[2] foo", "- only [1] [2]", "none", None]
    label = F.array(F.struct(F.lit(7).alias("number"), F.lit("Artikel 6").alias("label")))
    got = values(spark, lambda a: answers.relevant_basis(a, label), "2. Relevante juridiske forpligtelser\n- q", "- only", "has [1]", " ")
    assert got == ["2. Relevante juridiske forpligtelser\n- Relevant hjemmel: Artikel 6 [7]\n- q", "- only\n\n2. Relevante juridiske forpligtelser\n- Relevant hjemmel: Artikel 6 [7]", "has [1]", " "]
    checked = values(spark, lambda a: answers.integrity(a, F.array(F.lit(1))), "a [1]", "a [1] [9]", "a", "a\nReferences:\n[1] b")
    assert [(r["answer"], r["reason"]) for r in checked] == [("a [1]", None), ("MISSING_REF", "unknown_citation"), ("MISSING_REF", "no_citations"), ("MISSING_REF", "no_citations")]


def test_wording(spark):
    assert values(spark, answers.danish_modals, "- Yes, you must\n- Ensure that it may\nImplement x [1]\nensure y", "mustang", None) == ["- Ja, you SKAL\n- Der SKAL sikres, at it KAN\nDer SKAL implementeres x [1]\nDer SKAL sikres y", "mustang", None]
    assert values(spark, answers.abstain_wording, "Det kan jeg desværre ikke svare på ", "jeg kan ikke", "svar", None) == ["Jeg kan ikke svare på", "Jeg kan ikke", "svar", None]


def test_titles(spark):
    assert values(spark, T.repair_title, "Genst and", "G e n s t a n d", "Anvendelse af loven", "  ", None, "registrer ede  data") == ["Genstand", "Genstand", "Anvendelseaf loven", None, None, "registrerede data"]
    assert values(spark, T.ascii_slug, "Hvad er Årlig frist?", "å" * 50, None, "abcdefghij klmnopqrst uvwxyz012 x") == ["hvad-er-arlig-frist", "a" * 30, "", "abcdefghij-klmnopqrst"]


def test_tables(spark):
    page = '<table><tr><th>Sektor</th><th>Delsektor</th><th>Type enhed</th></tr><tr><td rowspan="3">1. Energi</td><td rowspan="2">a) El</td><td>Net</td></tr><tr><td>Handel <table><tr><td>in</td></tr></table></td></tr><tr><td>b) Gas</td><td>Lager</td></tr><tr><td>2. Vand</td><td></td><td></td></tr></table>'
    rows = list(html_tables.table_rows(page))
    assert [(r["sector"], r["subsector"], r["entity"]) for r in rows] == [("1. Energi", "a) El", "Net"), ("1. Energi", "a) El", "Handel in"), ("1. Energi", "b) Gas", "Lager")]
    assert html_tables.table_kind(["Direktiv 2016/1148", "Nærværende direktiv"]) == "concordance"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<table><tr><td rowspan=x>"), (4, "")], "page_id long, html string")
    assert html_tables.page_tables(pages).count() == 3


def test_expand_seeds_lifts_points_of_known_annexes(spark):
    edges = spark.createDataFrame([("6", "ANNEX:III", 0.4), ("ANNEX:III", "ANNEX:III:5", 0.5), ("6", "7", 0.2)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([(1, "6", 1)], "query_id int, seed string, pos int")
    got = {r["node"]: round(r["score"], 6) for r in graph.expand_seeds(edges, seeds).collect()}
    assert got == {"ANNEX:III": 0.4, "ANNEX:III:5": 0.3, "7": 0.2}


def test_case_defaults_and_scorers(spark):
    cases = spark.createDataFrame([("a", "p", None, None), (None, " ", "guess", ["x"])], "id string, prompt string, behavior string, must_include_any_of array<string>")
    got = [(r["behavior"], r["must_include_any_of"], r["problems"]) for r in evaluate.with_defaults(cases).collect()]
    assert got == [("answer", [], []), ("guess", ["x"], ["NO_ID", "NO_PROMPT", "BEHAVIOR"])]
    assert spark.range(1).select(evaluate.relevancy(F.lit(None).cast("double")).alias("r")).first()["r"]["score"] == 0
    empty = spark.createDataFrame([], "value double")
    assert evaluate.distance_quantiles(empty, "value").first()["count"] == 0
    assert spark.range(1).select(rank.precision_score(F.create_map(F.lit("recital"), F.lit("3"))).alias("s")).first()["s"] == 2


@pytest.mark.parametrize("n,want", [(0, "insufficient_evidence"), (2, "answer")])
def test_evidence_gate(spark, n, want):
    assert values(spark, lambda a: answers.evidence_gate(a, F.lit(n)), "x", " MISSING_REF") == [want, "missing_ref"]
