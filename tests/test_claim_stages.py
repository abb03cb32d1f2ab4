"""Claim stages by hand-made answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorspark.operators import claim_stages as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_conditional(spark):
    text = "Om højrisiko:\n  - Systemet skal testes [1]\nHvis nej, skal intet ske\nSkaldyr\n*  It SHOULD be logged\n"
    assert one(spark, S.conditional(F.lit(text))).split("\n") == ["Om højrisiko:", S.CAVEAT, f"  - {S.CONDITION}Systemet skal testes [1]", "Hvis nej, skal intet ske", "Skaldyr", f"*  {S.CONDITION}It SHOULD be logged"]
    for same in ("Systemet skal testes", "højrisiko uden mere", "højrisikoen skal", ""):
        assert one(spark, S.conditional(F.lit(same))) == same
    assert one(spark, S.conditional(F.lit(None).cast("string"))) == ""


def gate(spark, answer, question, profile, intent, used):
    kinds = F.array(*map(F.lit, used)).cast("array<string>") if used is not None else F.lit(None).cast("array<string>")
    return tuple(one(spark, S.stage_gates(F.lit(answer).cast("string"), F.lit(question).cast("string"), F.lit(profile), F.lit(intent), kinds)))


def test_gates(spark):
    assert gate(spark, "Ja.", "q", "ENGINEERING", "SCOPE", []) == (S.SCOPE_TEXT, True, True, "engineering_scope_no_evidence")
    assert gate(spark, "Ja.", "q", "ENGINEERING", "SCOPE", ["DEFINITION"]) == ("Ja.", False, False, None)
    assert gate(spark, "Ja.", None, "LEGAL", "SCOPE", None) == ("Ja.", False, False, None)
    assert gate(spark, "x", "q", "ENGINEERING", "ENFORCEMENT", [])[0::3] == (S.ENFORCEMENT_TEXT, "engineering_enforcement")
    assert gate(spark, "x", "q", "ENGINEERING", "CLASSIFICATION", ["SCOPE"])[0] == S.CLASSIFICATION_TEXT
    assert gate(spark, "x", "antag at det er sådan", "LEGAL", "CLASSIFICATION", [])[0] == "x"
    assert gate(spark, "x", "q", "LEGAL", "CLASSIFICATION", [])[0] == S.LEGAL_CLASSIFICATION_TEXT
    assert gate(spark, "Højrisiko.", "q", "ENGINEERING", "REQUIREMENTS", []) == (S.UNCLASSIFIED, True, True, "engineering_requirements_needs_classification")
    assert gate(spark, "Højrisiko skal.", "q", "ENGINEERING", "GENERAL", [])[3] == "engineering_normative_needs_classification"
    assert gate(spark, "Højrisiko skal.", "forudsat at", "ENGINEERING", "GENERAL", [])[0] == "Højrisiko skal."
    assert gate(spark, "Højrisiko skal.", "q", "LEGAL", "GENERAL", [])[0] == f"{S.CAVEAT}\n{S.CONDITION}Højrisiko skal."
    assert gate(spark, "Højrisiko skal.", "q", "LEGAL", "GENERAL", ["CLASSIFICATION"])[0] == "Højrisiko skal."
    assert gate(spark, None, None, "OTHER", "SCOPE", None) == ("", False, False, None)


def test_scope_without_requirements(spark):
    text = "1. A\n- SKAL blive\n3. Konkrete systemkrav\n- SKAL logge [1] og [22]\n- BØR intet\n  - must go\n- skalaer bliver\n4. Åbne\n- SKAL også blive"
    assert one(spark, S.without_requirements(F.lit(text))) == "1. A\n- SKAL blive\n3. Konkrete systemkrav\n- Relevant hjemmel: [1] [22]\n- skalaer bliver\n4. Åbne\n- SKAL også blive"
    assert one(spark, S.without_requirements(F.lit("3. konkrete systemkrav\n- BØR intet\n\n"))) == f"3. konkrete systemkrav\n{S.NO_REQUIREMENTS}"
    for same in ("3. Andet\n- SKAL x\n", "", "SKAL"):
        assert one(spark, S.without_requirements(F.lit(same))) == same


def shown(spark, answer, lines):
    r = one(spark, S.litra_consistent(F.lit(answer), F.array(*map(F.lit, lines)).cast("array<string>")))
    return r.answer, r.reference_lines


def test_litras(spark):
    same = ("Artikel 2, stk. 1, litra c [1]", ["[1] Article 2, stk 1, litra C", "[2] Artikel 9, stk. 1, litra b"])
    assert shown(spark, *same) == (same[0], same[1])
    assert shown(spark, "Se artikel 2, stk. 1, litra c  [1] .", ["[1] Artikel 2, stk. 1", "[2] Artikel 3, stk. 1, litra b"]) == ("Se artikel 2, stk. 1 [1].", ["[1] Artikel 2, stk. 1", "[2] Artikel 3, stk. 1, litra b"])
    assert shown(spark, "artikel 2, stk. 1, litra a; artikel 4a, stk. 2", ["Artikel 2, stk. 1, litra b", "Artikel 4A, stk. 2, litra d"]) == ("artikel 2, stk. 1; artikel 4a, stk. 2", ["Artikel 2, stk. 1", "Artikel 4A, stk. 2"])
    assert shown(spark, "", ["Artikel 2, stk. 1"]) == ("", ["Artikel 2, stk. 1"]) and shown(spark, " Intet ", []) == (" Intet ", [])


def test_sources_only(spark):
    kind = "array<struct<idx:int,article:string,recital:string,annex:string>>"
    refs = F.array(*(F.struct(F.lit(i), F.lit(a), F.lit(r), F.lit(x)) for i, a, r, x in [(1, "6", "2", None), (0, "7", "", ""), (3, " ", "12", "I"), (4, None, None, "iii"), (5, "", "", "")])).cast(kind)
    want = f"{S.SOURCES_ONLY}\n- Artikel 6 [1]\n- Betragtning 12 [3]\n- Bilag iii [4]"
    assert one(spark, S.sources_only(F.lit("Intet."), refs)) == want and one(spark, S.sources_only(F.lit("Intet."), refs, 1)) == want.split("\n- B")[0]
    for same in ("", "MISSING_REF", "se [1]", "Artikel 6", "bilag III", "recital 4"):
        assert one(spark, S.sources_only(F.lit(same), refs)) == same
    assert one(spark, S.sources_only(F.lit("x"), F.lit(None).cast(kind))) == "x"
