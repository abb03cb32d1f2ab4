"""Citation likeness, claim-stage notes and related content on fixed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorspark.operators import claims

PLACE = "array<struct<article: string, article_title: string, annex: string, annex_title: string, recital: string>>"


def test_contexts_are_around_the_first_mark(spark):
    long = "a" * 300 + "[2]" + "b" * 300 + "[2] [01]"
    got = [[tuple(c) for c in r["c"]] for r in spark.createDataFrame([(0, long), (1, "[7]"), (2, ""), (3, None)], "i int, t string").orderBy("i").select(claims.citation_contexts(F.col("t")).alias("c")).collect()]
    assert got == [[(1, ""), (2, "a" * 150 + "[2]" + "b" * 150)], [(7, "[7]")], [], []]


def test_similarity(spark):
    schema = "i int, c array<struct<idx: int, context: string, embedding: array<double>>>, r array<struct<idx: int, chunk_text: string, embedding: array<double>>>"
    a, b = [1.0, 0.0], [0.0, 1.0]
    sources = [(1, "x", a), (2, "y", b), (3, "z", a), (4, None, b), (5, "v", None), (6, "w", [1.0]), (2, "y", b)]
    rows = [(0, [(n, "t", a) for n in (1, 2, 4, 5, 6, 9)], sources), (1, [(2, " ", a), (2, "t", None)], sources), (2, [], sources), (3, None, None), (4, [(2, "t", a)], [(2, "y", b)])]
    got = [r["s"] for r in spark.createDataFrame(rows, schema).orderBy("i").select(claims.citation_similarity(F.col("c"), F.col("r")).alias("s")).collect()]
    assert [r["verified"] for r in got] == [[1, 4, 5], [2, 2], [], [], []]
    assert [tuple(s) for s in got[0]["suspicious"]] == [(2, 0.0, "low_similarity", 1), (6, 0.0, "low_similarity", 1), (9, 0.0, "citation_not_in_references", None)]
    assert [r["overall"] for r in got] == [0.5, 1.0, 1.0, 1.0, 0.0]
    assert [tuple(s) for s in got[4]["suspicious"]] == [(2, 0.0, "low_similarity", None)]


def test_claim_notes(spark):
    def gate(answer, intent, evidence, first=None, **how):
        kinds = F.array(*map(F.lit, evidence)).cast("array<string>") if evidence is not None else F.lit(None).cast("array<string>")
        return tuple(spark.range(1).select(claims.legal_claim_gate(F.lit(answer).cast("string"), F.lit(intent), kinds, F.lit(first).cast("int"), **how).alias("g")).first()["g"])

    closing = f"\n\n{claims.CLOSING}"
    assert gate("Svar", "SCOPE", None, 4) == (f"{claims.NOTES['scope']}\n\nSvar{closing} [4].", False)
    assert gate("Svar", "SCOPE", ["DEFINITION"]) == (f"Svar{closing}.", True)
    assert gate("Svar", "CLASSIFICATION", ["SCOPE"], bypass=True) == (f"Svar{closing}.", True)
    assert gate("Svar", "ENFORCEMENT", [], assumes_high_risk=True) == (f"Svar{closing}.", True)
    assert gate("Om high-risk\nbeslutningskontekst", None, [], assumes_high_risk=True) == ("Om high-risk\nbeslutningskontekst", True)
    assert gate("Jeg kan ikke svare", "GENERAL", []) == ("Jeg kan ikke svare", True)
    assert gate(None, "GENERAL", []) == ("", True)


def test_related_content(spark):
    same = ("6", "Krav til data", "III", None, None)
    rows = [(0, "Om AI", [same, same, same, (None, None, None, None, " 9 ")]), (1, "x", []), (2, None, None), (3, "persondata", [(" ", None, None, None, "4")]), (4, None, [(None, None, "I", "Liste", None)])]
    got = [r["b"] for r in spark.createDataFrame(rows, f"i int, q string, r {PLACE}").orderBy("i").select(claims.related_content(F.col("r"), F.col("q")).alias("b")).collect()]
    assert got[0] == '\n**Relateret indhold**\n  · Artikel 6 - Krav til data\n  · Bilag III\n  · Betragtning 9\n\n**Prøv at spørge**\n  · "Hvilke krav stiller Artikel 6?"\n  · "Hvilke krav stiller Artikel 6?"'
    assert got[1:3] == ["", ""]
    assert got[3] == '\n**Relateret indhold**\n  · Betragtning 4\n\n**Prøv at spørge**\n  · "Hvilke rettigheder har registrerede personer?"'
    assert got[4] == "\n**Relateret indhold**\n  · Bilag I - Liste"
