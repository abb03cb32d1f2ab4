"""Rules over wordings: what each hits and misses, case by case."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from anchorspark.functions import place as P
from anchorspark.functions import text as T
from anchorspark.operators import evaluate, planning


def of(spark, texts, rule):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", rule(F.col("t")).alias("r"))
    return [r.r for r in sorted(rows.collect())]


def test_navigation(spark):
    asked = ["hvad siger kapitel 3", "hvad handler artikel 5 om", "sammenfat k a p i t e l 3", "hvad siger artikel 5", "giv en oversigt over alt", None]
    assert of(spark, asked, planning.navigation) == ["FREEFORM", "FREEFORM", "CHAPTER_SUMMARY", "ARTICLE_SUMMARY", "STRUCTURE", "FREEFORM"]


def test_normative(spark):
    said = ["de MAA IKKE", "loven kraever", "m å ikke", "måikke", "må\tikke", "Mustard", "pligten", "en pligt.", "may  not", None, "skål"]
    assert of(spark, said, T.is_normative) == [True, True, False, True, True, False, False, True, True, False, False]


def test_cues(spark):
    none, weak, exact, strong = of(spark, ["", "kontrol og frister", "forbud mod", "frister: hvordan"], T.intent_cues)
    assert not none.enforcement and not none.requirements and none.requirements_cues == []
    assert not weak.requirements and weak.requirements_cues == ["frister", "kontrol"]
    assert exact.enforcement_cues == ["forbud"]
    assert strong.requirements and strong.requirements_cues == ["frister", "hvordan"]
    assert not of(spark, ["forbudt her"], T.intent_cues)[0].enforcement


def test_synthesis(spark):
    asked = ["compareåand", "compare a\nand b", "compare a and b", "a vs. b", "how doe it compare", "how do they compare", "what law cover it", "forskelle mellem", "all eu laws"]
    assert of(spark, asked, T.synthesis_mode) == ["UNIFIED", "UNIFIED", "COMPARISON", "COMPARISON", "COMPARISON", "UNIFIED", "ROUTING", "COMPARISON", "AGGREGATION"]


def metas(spark, maps, rule):
    rows = spark.createDataFrame(list(enumerate(maps)), "i int, m map<string,string>").select("i", rule(F.col("m")).alias("r"))
    return [r.r for r in sorted(rows.collect())]


def test_evidence(spark):
    labels = [{"title": "Market surveillance authority"}, {"display": "Forbidden practices"}, {"section_title": "Omfang"}, {"body": "forbidden"}, {}, {"title": " ", "source": "Tilsyn"}, {"title": "definition", "annex_title": "scope"}]
    assert metas(spark, labels, P.evidence_type) == ["ENFORCEMENT", "FORBIDDEN", "SCOPE", "UNKNOWN", "UNKNOWN", "ENFORCEMENT", "DEFINITION"]


def test_citability(spark):
    places = [{"chapter": "iii"}, {"location_id": "loc:v1/chapter:iii"}, {"heading_path": '["Recital:4"]'}, {"heading_path": "article:4"}, {"heading_path": "[broken"}, {"section": "2", "source": " CRA "}, {"corpus_id": "c"}, None]
    got = metas(spark, places, lambda m: P.citability(m, F.lit("see Annex II, then Article 3")))
    assert [tuple(r) for r in got] == [(True, None)] * 3 + [(True, "Unknown source, Article 3")] * 2 + [(True, "CRA, Article 3"), (True, "c, Article 3"), (True, "Unknown source, Article 3")]
    assert of(spark, ["jf. Art.12b(3)", "Kapitel XI", "Bilagene", None, "Recital 12345"], P.precise_ref) == ["Art.12b", "Kapitel XI", None, None, None]


def test_embedding_text_and_its_key(spark):
    maps = [{"chapter": "III", "chapter_title": "Krav", "article": "6", "annex": "I", "recital": "2"}, {"annex": "IV", "annex_title": "Dokumenter"}, {"recital": "7", "recital_title": "x"}, {}]
    got = metas(spark, maps, lambda m: P.embedding_text(F.lit("t"), m, F.when(F.size(m) < 3, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))))
    assert got == ["[Kapitel III: Krav]\n[Artikel 6]\n\nt", "[Bilag IV: Dokumenter]\n[Søgetermer: a | b]\n\nt", "[Betragtning 7]\n[Søgetermer: a | b]\n\nt", "[Søgetermer: a | b]\n\nt"]
    title = metas(spark, [{"article": "6", "article_title": "Krav"}, {"article": "6"}, {"article_title": "Krav"}], P.article_title)
    assert title == ["Artikel 6 - Krav", "Artikel 6", ""]
    key = of(spark, ["x" * 600], lambda t: P.enrichment_key(F.lit("cra"), F.lit("Artikel 6"), t))[0]
    assert key == hashlib.sha256(("v3:cra:Artikel 6:" + "x" * 500).encode()).hexdigest()[:16]


def test_cross_references(spark):
    said = ["GDPR contains references to other acts", "a reference to the ai act", "under nis2", "undergoes nis2", "the dora", "refers\nto gdpr", None]
    claimed = of(spark, said, lambda t: evaluate.cross_references(t, F.array(F.lit("a"), F.lit("a"))))
    assert [r.claimed for r in claimed] == [True, True, True, False, False, False, False]
    assert [r.passed for r in claimed] == [not r.claimed for r in claimed]
    assert all(r.passed for r in of(spark, said, lambda t: evaluate.cross_references(t, F.array(F.lit("a"), F.lit("b")))))


def test_allocation(spark):
    rows = spark.createDataFrame([("low", 1, "a", 0.2), ("low", 2, "b", 0.2), ("even", 1, "a", 0.25), ("even", 2, "b", 0.75), ("one", 1, "a", 1.0)], "g string, i int, m string, w double")
    got = {(r.g, r.m): r.n for r in evaluate.allocate(rows, "g", "i", "m", "w", 10).collect()}
    assert got == {("low", "a"): 5, ("low", "b"): 5, ("even", "a"): 2, ("even", "b"): 8, ("one", "a"): 10}
    for weights in (0.6, 0.0):
        bad = spark.createDataFrame([("g", 1, "a", weights), ("g", 2, "b", weights)], "g string, i int, m string, w double")
        with pytest.raises(Exception, match="weights add up"):
            evaluate.allocate(bad, "g", "i", "m", "w", 10).collect()
