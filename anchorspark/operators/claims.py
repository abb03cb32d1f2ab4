"""What answers claim: likeness of citations to their sources, notes by claim stage, and content near a declined question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# Labels, notes and questions as the answers show them.
NOTES = {
    "scope": "Bemærk: Kilderne indeholder ikke direkte definitioner af anvendelsesområdet.",
    "classification": "Bemærk: Kilderne indeholder ikke specifikke klassifikationsregler (bilag/højrisiko).",
    "high_risk": "Bemærk: Du spurgte om højrisiko-systemer, men svaret er generelt.",
}
CLOSING = "- Afklar systemets formål, output og beslutningskontekst før endelig vurdering"
RELATED_HEADING, ASK_HEADING = "**Relateret indhold**", "**Prøv at spørge**"
TITLE_QUESTIONS = (("definition|begreb", "Hvad defineres i Artikel ", "?"), ("krav|forpligt", "Hvilke krav stiller Artikel ", "?"), ("forbud", "Hvad forbyder Artikel ", "?"), ("", "Hvad handler Artikel ", " om?"))
TOPIC_QUESTIONS = (("gdpr|persondata|databeskyttelse", "Hvilke rettigheder har registrerede personer?"), ("ai|kunstig intelligens", "Hvad er kravene til højrisiko AI-systemer?"))

_SPACE = " \t\r\n"


def _said(value: Column) -> Column:
    """The text without outer white space; null if nothing is left."""
    trimmed = F.btrim(value, F.lit(_SPACE))
    return F.when(trimmed != "", trimmed)


def citation_contexts(answer: Column, around: int = 150) -> Column:
    """For each distinct number cited, sorted, the text around its first [n]: array of (idx, context).

    A number only written otherwise ([01]) has an empty context. Null and empty answers cite nothing.
    """
    def cut(n):
        mark = F.concat(F.lit("["), n.cast("string"), F.lit("]"))
        at = F.instr(answer, mark)
        first = F.greatest(at - around, F.lit(1))
        return F.struct(n.alias("idx"), F.when(at > 0, F.substring(answer, first, at + F.length(mark) + around - first)).otherwise("").alias("context"))

    return F.transform(T.bracket_citations(answer), cut)


def citation_similarity(contexts: Column, references: Column, least: float = 0.75) -> Column:
    """(verified, suspicious, overall) of an answer's cited contexts (idx, context, embedding) against its references
    (idx, chunk_text, embedding); row by row, nothing is shuffled.

    A number without a reference scores 0; with a blank context, no chunk text, or an embedding that is null, it isn't
    checked and scores 1. Embeddings of other sizes, or of zeros, have similarity 0. Of references with one number the
    last counts. Suspicious citations have (idx, similarity, reason, suggestion), the suggestion being the number of the
    reference most like the context, the first of equal ones. Without citations the overall score is 1.
    """
    def best(context):
        scored = F.transform(references, lambda r, i: F.struct(F.when((F.coalesce(r["chunk_text"], F.lit("")) != "") & r["embedding"].isNotNull(), T.cosine(context["embedding"], r["embedding"])).alias("s"), (-i).alias("i"), r["idx"].cast("int").alias("idx")))
        return F.array_max(F.filter(scored, lambda x: x["s"] > 0))["idx"]

    def check(context):
        own = F.try_element_at(F.filter(references, lambda r: r["idx"] == context["idx"]), F.lit(-1))
        unchecked = _said(context["context"]).isNull() | (F.coalesce(own["chunk_text"], F.lit("")) == "") | context["embedding"].isNull() | own["embedding"].isNull()
        score = F.when(own.isNull(), 0.0).when(unchecked, 1.0).otherwise(T.cosine(context["embedding"], own["embedding"]))
        reason = F.when(own.isNull(), "citation_not_in_references").when(score < least, "low_similarity")
        return F.struct(context["idx"].cast("int").alias("idx"), score.alias("score"), reason.alias("reason"), F.when(reason == "low_similarity", best(context)).alias("suggestion"))

    checks = F.transform(F.coalesce(contexts, F.array().cast("array<struct<idx: int, context: string, embedding: array<float>>>")), check)
    suspicious = F.transform(F.filter(checks, lambda c: c["reason"].isNotNull()), lambda c: F.struct(c["idx"], F.round(c["score"], 3).alias("similarity"), c["reason"], c["suggestion"]))
    overall = F.when(F.size(checks) == 0, 1.0).otherwise(F.round(F.aggregate(checks, F.lit(0.0), lambda s, c: s + c["score"]) / F.size(checks), 3))
    return F.struct(F.transform(F.filter(checks, lambda c: c["reason"].isNull()), lambda c: c["idx"]).alias("verified"), suspicious.alias("suspicious"), overall.alias("overall"))


def legal_claim_gate(answer: Column, intent: Column, evidence: Column, first_reference: Column, bypass: Column | bool = False, assumes_high_risk: Column | bool = False) -> Column:
    """(answer, allow_fallback) of a legal answer: a note first if the kind of claim asked for has no evidence, a closing
    line last if none of the last three lines has it.

    Blank answers and those that decline get no closing line, and may fall back. A null answer counts as blank, null
    evidence as none.
    """
    bypass, assumes = (c if isinstance(c, Column) else F.lit(c) for c in (bypass, assumes_high_risk))
    text, kinds = F.coalesce(answer, F.lit("")), F.transform(F.coalesce(evidence, F.array().cast("array<string>")), F.lower)
    asked = lambda kind: (F.lower(intent) == kind) & ~bypass
    unscoped = asked("scope") & ~F.arrays_overlap(kinds, F.array(F.lit("scope"), F.lit("definition")))
    unclassed = asked("classification") & ~F.array_contains(kinds, "classification")
    unenforced = asked("enforcement") & ~F.array_contains(kinds, "enforcement")
    generic = assumes & ~bypass & ~F.lower(text).rlike("højrisiko|high-risk")
    note = F.when(unscoped, NOTES["scope"]).when(unclassed, NOTES["classification"]).when(unenforced, F.lit(None)).when(generic, NOTES["high_risk"])
    noted = F.when(note.isNull(), text).otherwise(F.concat(note, F.lit("\n\n"), text))
    declines = (_said(noted).isNull()) | F.substring(F.lower(noted), 1, 50).contains("jeg kan ikke")
    closed = F.array_join(F.slice(F.split(noted, "\n"), F.greatest(F.size(F.split(noted, "\n")) - 2, F.lit(1)), 3), "\n").contains("beslutningskontekst")
    closing = F.concat(F.lit(f"\n\n{CLOSING}"), F.coalesce(F.concat(F.lit(" ["), first_reference.cast("string"), F.lit("]")), F.lit("")), F.lit("."))
    full = F.btrim(F.when(closed, noted).otherwise(F.concat(noted, closing)), F.lit(_SPACE))
    return F.struct(F.when(declines, noted).otherwise(full).alias("answer"), (declines | ~F.coalesce(unscoped, F.lit(False))).alias("allow_fallback"))


def related_content(references: Column, question: Column, most: int = 3) -> Column:
    """What to show with an answer that declines: up to `most` places of references (article, article_title, annex,
    annex_title, recital), each place once, and up to two questions about them.

    A reference gives the first of its article, annex and recital not shown yet. References without a place, an empty or a
    null list give an empty text.
    """
    def places(r):
        def place(name, key, title=None):
            n = _said(r[key])
            label = F.concat(F.lit(f"{name} "), n, F.coalesce(F.concat(F.lit(" - "), _said(r[title])), F.lit("")) if title else F.lit(""))
            return F.when(n.isNotNull(), F.struct(F.concat(F.lit(f"{key}:"), n).alias("key"), label.alias("label")))

        return F.array_compact(F.array(place("Artikel", "article", "article_title"), place("Bilag", "annex", "annex_title"), place("Betragtning", "recital")))

    def ask(r):
        article, title = _said(r["article"]), F.lower(_said(r["article_title"]))
        out = F.when(title.isNull(), F.concat(F.lit("Hvad siger Artikel "), article, F.lit("?")))
        for words, before, after in TITLE_QUESTIONS:
            out = out.when(title.rlike(words), F.concat(F.lit(before), article, F.lit(after)))
        return out

    none = F.array().cast("array<struct<key: string, label: string>>")
    more = lambda shown, r: F.concat(shown, F.slice(F.filter(places(r), lambda p: ~F.exists(shown, lambda s: s["key"] == p["key"])), 1, 1))
    shown = F.aggregate(references, none, lambda shown, r: F.when(F.size(shown) >= most, shown).otherwise(more(shown, r)))
    topic = F.when(F.lower(question).rlike(TOPIC_QUESTIONS[0][0]), TOPIC_QUESTIONS[0][1]).when(F.lower(question).rlike(TOPIC_QUESTIONS[1][0]), TOPIC_QUESTIONS[1][1])
    questions = F.slice(F.array_compact(F.concat(F.transform(F.slice(references, 1, 2), ask), F.array(topic))), 1, 2)
    listed = lambda items, form: F.array_join(F.transform(items, form), "")
    asked = F.when(F.size(questions) > 0, F.concat(F.lit(f"\n\n{ASK_HEADING}"), listed(questions, lambda q: F.concat(F.lit('\n  · "'), q, F.lit('"'))))).otherwise("")
    block = F.concat(F.lit(f"\n{RELATED_HEADING}"), listed(shown, lambda s: F.concat(F.lit("\n  · "), s["label"])), asked)
    return F.when(F.size(shown) > 0, block).otherwise("")
