"""What becomes of an answer whose kind of claim lacks its evidence: conservative texts, conditional wording, and a display that claims no more than its references.

All of it is column expressions over one answer.  Defined results: a null answer
or question is empty, null evidence none; blank answers stay as they are unless
a stage replaces them; lines may end in any line break and are joined by \\n where
a text is changed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import refs as R
from ..functions import text as T
from .citation_chain import _LINES, _strip

# The patterns of classes and duties, the wording put before them, and the texts that take an answer's place.
HIGH_RISK = r"\b(højrisiko|high[- ]risk)\b"
DUTIES = r"\b(MUST|SHALL|SHOULD)\b|\bskal\b|\bkræver\b"
CAVEAT = "Bemærk: Jeg kan ikke konkludere klassifikation (fx højrisiko) ud fra de fundne kilder alene. Krav afhænger af klassifikationen."
CONDITION = "Hvis systemet klassificeres som højrisiko (eller på anden måde omfattes af krav), så: "
ASSUMES_CLASS, ASSUMES = ["højrisiko", "high-risk", "high risk"], ["antag at", "forudsat at"]
UNCLASSIFIED = "Krav kan ikke fastlægges, før klassifikation er afklaret."
NO_REQUIREMENTS = "Ingen konkrete systemkrav for et anvendelsesområde-spørgsmål."
SOURCES_ONLY = "Jeg har fundet følgende relevante kilder, men kan ikke give et specifikt svar ud fra dem:"
SCOPE_TEXT = """1. Klassifikation og betingelser
- Kan ikke afgøres ud fra den foreliggende evidens.

2. Relevante juridiske forpligtelser
- Jeg kan ikke udlede anvendelsesområdet uden kilder om definitioner/anvendelsesområde.

3. Konkrete systemkrav
- (Ingen konkrete krav kan udledes, før scope er afklaret.)

4. Åbne spørgsmål / risici
- Hvad er systemets formål og konkrete outputs (score, anbefaling, beslutning)?
- Bruges output til beslutninger med væsentlig påvirkning, og i hvilken kontekst?"""
ENFORCEMENT_TEXT = """1. Klassifikation og betingelser
- AFHÆNGER AF (hvilken rolle/jurisdiktion og hvilket regelsæt der spørges til).

2. Relevante juridiske forpligtelser
- Jeg kan beskrive håndhævelse (kompetente myndigheder, procedurer, klageveje og sanktionsrammer) ud fra kilderne.

3. Konkrete systemkrav
- (Ingen konkrete systemkrav i ENGINEERING-profilen for håndhævelsesspørgsmål.)

4. Åbne spørgsmål / risici
- Hvilken rolle har I (udbyder/ibrugtager/distributør), og i hvilken jurisdiktion?"""
CLASSIFICATION_TEXT = """1. Klassifikation og betingelser
- Kan ikke afgøres ud fra den foreliggende evidens, om systemet er 'højrisiko'.

2. Relevante juridiske forpligtelser
- Jeg kan ikke basere klassifikation på håndhævelse/tilsynsbestemmelser alene.

3. Konkrete systemkrav
- (Ingen krav kan udledes, før klassifikation er afklaret.)

4. Åbne spørgsmål / risici
- Hvad er systemets formål og brugssituation?
- Hvilke domæner/aktiviteter vedrører det, og hvem påvirkes?"""
LEGAL_CLASSIFICATION_TEXT = """Kan ikke afgøres ud fra den foreliggende evidens, om systemet er 'højrisiko'. Klassifikation afhænger af systemets anvendelse og relevante kategorier.

Afklar venligst kort:
- Hvad er formålet og beslutnings-/påvirkningskonteksten?
- Hvilken sektor/brugssituation og hvilke berørte personer/brugere?"""
MENTION = r"\b(?:artikel|article)\s+(\d{1,3}[a-z]?)\s*,\s*stk\.?\s*(\d{1,3})\b(?:\s*,\s*litra\s+([a-z])\b)?"


def _lines(text: Column) -> Column:
    lines = F.split(text, _LINES)
    return F.when((F.size(lines) > 1) & (F.element_at(lines, -1) == ""), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def conditional(answer: Column) -> Column:
    """Lines with a duty made conditional, and a caveat before the first, in an answer about a high-risk class."""
    answer = F.coalesce(answer, F.lit(""))

    def reworded(line: Column) -> Column:
        prefix = F.regexp_extract(line, r"(?U)^(\s*(?:[-*]\s*)?)", 1)
        rest = F.substr(line, F.length(prefix) + 1)
        return F.when(rest.rlike(r"(?iU)^\s*(Hvis|If)\b"), line).otherwise(F.concat(prefix, F.lit(CONDITION), rest))

    def of(lines: Column) -> Column:
        first = F.array_min(F.transform(lines, lambda line, i: F.when(T.search(line, DUTIES), i)))
        each = F.transform(lines, lambda line, i: F.when(~T.search(line, DUTIES), F.array(line)).when(i == first, F.array(F.lit(CAVEAT), reworded(line))).otherwise(F.array(reworded(line))))
        return F.array_join(F.flatten(each), "\n")

    return F.when(T.search(answer, HIGH_RISK) & T.search(answer, DUTIES), T.let(_lines(answer), of)).otherwise(answer)


def stage_gates(answer: Column, question: Column, profile: Column, intent: Column, used: Column) -> Column:
    """(answer, abstained, bypass, gate) by the kinds of evidence that an answer used (an array).

    Engineering answers about scope need evidence of scope or definitions, all
    answers about a class need evidence of one, and duties that hang on a class
    aren't told, or told conditionally, without it; a question that assumes its
    class is answered.  Engineering answers about enforcement name no duties.
    """
    answer, question = F.coalesce(answer, F.lit("")), F.coalesce(question, F.lit(""))
    kinds = F.coalesce(used, F.array().cast("array<string>"))
    engineering, legal = F.coalesce(profile == "ENGINEERING", F.lit(False)), F.coalesce(profile == "LEGAL", F.lit(False))
    asks = lambda kind: F.coalesce(intent == kind, F.lit(False))
    scoped, classed = F.arrays_overlap(kinds, F.array(F.lit("SCOPE"), F.lit("DEFINITION"))), F.array_contains(kinds, "CLASSIFICATION")
    assumed = T.contains_any(question, ASSUMES_CLASS + ASSUMES)
    no_scope, no_class = engineering & asks("SCOPE") & ~scoped, asks("CLASSIFICATION") & ~classed & ~(legal & assumed)
    text = F.when(no_class & engineering, CLASSIFICATION_TEXT).when(no_class & legal, LEGAL_CLASSIFICATION_TEXT).when(engineering & asks("ENFORCEMENT"), ENFORCEMENT_TEXT).when(no_scope, SCOPE_TEXT).otherwise(answer)

    def of(text: Column) -> Column:
        open_ = (T.search(question, HIGH_RISK) | T.search(text, HIGH_RISK)) & ~classed & ~assumed
        required = open_ & engineering & asks("REQUIREMENTS")
        duties = open_ & engineering & ~asks("REQUIREMENTS") & T.is_normative(text)
        softened = open_ & legal & T.is_normative(text)
        gate = (
            F.when(required, "engineering_requirements_needs_classification").when(duties, "engineering_normative_needs_classification").when(softened, "legal_conditionalize_requirements")
            .when(no_class & engineering, "engineering_classification_no_evidence").when(no_class & legal, "legal_classification_no_evidence").when(engineering & asks("ENFORCEMENT"), "engineering_enforcement").when(no_scope, "engineering_scope_no_evidence")
        )
        stopped = required | duties
        return F.struct(F.when(stopped, UNCLASSIFIED).when(softened, conditional(text)).otherwise(text).alias("answer"), (stopped | no_scope).alias("abstained"), (stopped | no_scope).alias("bypass"), gate.alias("gate"))

    return T.let(text, of)


def without_requirements(answer: Column) -> Column:
    """An answer about scope without the duties under its heading of system requirements; their citations stay as a neutral line."""
    answer = F.coalesce(answer, F.lit(""))

    def of(lines: Column) -> Column:
        start = F.array_min(F.transform(lines, lambda s, i: F.when(s.rlike(r"(?iU)^\s*3\.\s*Konkrete systemkrav\s*\z"), i)))
        end = F.coalesce(F.array_min(F.transform(lines, lambda s, i: F.when((i > start) & s.rlike(r"(?U)^\s*\d+\.\s+\S+"), i))), F.size(lines))
        cites = lambda s: F.regexp_extract_all(s, F.lit(r"\[\d{1,3}\]"), F.lit(0))
        neutral = lambda s: F.when(F.size(cites(s)) > 0, F.concat(F.lit("- Relevant hjemmel: "), F.array_join(cites(s), " ")))
        body = F.array_compact(F.transform(F.slice(lines, start + 2, end - start - 1), lambda s: F.when(s.rlike(r"(?iU)^\s*-\s*(SKAL|BØR|MUST|SHALL|SHOULD)\b"), neutral(s)).otherwise(s)))
        body = F.when(F.exists(body, lambda s: _strip(s) != ""), body).otherwise(F.array(F.lit(NO_REQUIREMENTS)))
        return F.when(start.isNull(), answer).otherwise(_strip(F.array_join(F.concat(F.slice(lines, F.lit(1), start + 1), body, F.slice(lines, end + 1, F.size(lines) - end)), "\n")))

    return T.let(_lines(answer), of)


def litra_consistent(answer: Column, reference_lines: Column) -> Column:
    """(answer, reference_lines): where both name an article's paragraph but not the same letters of it, neither shows letters."""
    answer, shown = F.coalesce(answer, F.lit("")), F.coalesce(reference_lines, F.array().cast("array<string>"))
    part = lambda m, g: F.regexp_extract(m, "(?iU)" + MENTION, g)
    row = lambda m: F.struct(F.upper(part(m, 1)).alias("article"), part(m, 2).alias("paragraph"), F.lower(part(m, 3)).alias("litra"))
    named = lambda text: F.transform(F.regexp_extract_all(text, F.lit("(?iU)" + MENTION), F.lit(0)), row)

    def removed(text: Column, pairs: Column) -> Column:
        def one(text: Column, p: Column) -> Column:
            base = F.concat(F.lit(r"(?iU)\b((?:artikel|article)\s+"), p["article"], F.lit(r"\s*,\s*stk\.?\s*"), p["paragraph"], F.lit(r")\b"))
            text = F.regexp_replace(F.regexp_replace(text, F.concat(base, F.lit(r"\s*,\s*litra\s+[a-z]\b")), F.lit("$1")), F.concat(base, F.lit(r"\s+litra\s+[a-z]\b")), F.lit("$1"))
            return F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"(?U)\s+([,.;:])", "$1")

        return _strip(F.aggregate(pairs, text, one))

    def of(mine: Column) -> Column:
        return T.let(F.flatten(F.transform(shown, named)), lambda theirs: T.let(differing(mine, theirs), result))

    def differing(mine: Column, theirs: Column) -> Column:
        pair = lambda x: F.struct(x["article"].alias("article"), x["paragraph"].alias("paragraph"))
        letters = lambda of, p: F.array_distinct(F.transform(F.filter(of, lambda x: (pair(x) == p) & (x["litra"] != "")), lambda x: x["litra"]))
        both = F.array_sort(F.array_intersect(F.transform(mine, pair), F.transform(theirs, pair)))
        return F.filter(both, lambda p: ((F.size(letters(mine, p)) > 0) != (F.size(letters(theirs, p)) > 0)) | ((F.size(letters(mine, p)) > 0) & ~F.arrays_overlap(letters(mine, p), letters(theirs, p))))

    def result(pairs: Column) -> Column:
        some = F.size(pairs) > 0
        return F.struct(F.when(some, removed(answer, pairs)).otherwise(answer).alias("answer"), F.when(some, F.transform(shown, lambda s: removed(s, pairs))).otherwise(shown).alias("reference_lines"))

    return T.let(named(answer), of)


def sources_only(answer: Column, refs: Column, most: int = 5) -> Column:
    """In place of an answer that neither cites nor names a place: the first references that have one, in order."""
    answer = F.coalesce(answer, F.lit(""))
    label = lambda r: F.coalesce(*(F.concat(F.lit(f"{name} "), F.nullif(F.trim(r[k]), F.lit(""))) for k, name in (("article", "Artikel"), ("recital", "Betragtning"), ("annex", "Bilag"))))
    found = F.filter(F.coalesce(refs, F.array().cast("array<struct<idx:int,article:string,recital:string,annex:string>>")), lambda r: (F.coalesce(r["idx"], F.lit(0)) != 0) & label(r).isNotNull())
    lines = F.transform(F.slice(found, 1, most), lambda r: F.concat(F.lit("- "), label(r), F.lit(" ["), r["idx"].cast("string"), F.lit("]")))
    spoken = (_strip(answer).isin("", "MISSING_REF")) | answer.rlike(r"\[\d{1,3}\]") | (F.size(R.anchor_mentions(answer)) > 0) | (F.size(lines) == 0)
    return F.when(spoken, answer).otherwise(F.concat(F.lit(SOURCES_ONLY + "\n"), F.array_join(lines, "\n")))


def abstention(question: Column, hits: Column, mentioned: Column, corpus_id: Column, scope: Column, max_distance: Column, hard: float = 1.3, allow_low: Column | bool = False) -> Column:
    """Why a question isn't answered: other_corpus, several_corpora, no_evidence, article_not_found, recital_not_found, too_far, low_evidence; else answer.

    hits: array of (article, recital, distance).  A question within one corpus
    may name no other; one that asks about an article or a recital needs a hit
    of it, and such a hit makes up for distance.
    """
    question, hits = F.coalesce(question, F.lit("")), F.coalesce(hits, F.array().cast("array<struct<article:string,recital:string,distance:double>>"))
    named = F.coalesce(mentioned, F.array().cast("array<string>"))
    allow = allow_low if isinstance(allow_low, Column) else F.lit(allow_low)
    article, recital = F.try_element_at(R.article_refs(question), F.lit(1)), R.recital_ref(question)
    has_article = F.coalesce(F.exists(hits, lambda h: F.upper(h["article"]) == article), F.lit(False))
    has_recital = F.coalesce(F.exists(hits, lambda h: F.trim(h["recital"]) == recital), F.lit(False))
    asked = T.question_kind(question)["substantive"]
    best = F.array_min(F.transform(hits, lambda h: h["distance"]))
    single = F.coalesce(scope == "single", F.lit(False)) & (F.size(named) > 0)
    return (
        F.when(single & (F.size(named) > 1), "several_corpora").when(single & ~F.coalesce(named[0] == T.normalize_corpus(corpus_id), F.lit(False)), "other_corpus").when(F.size(hits) == 0, "no_evidence")
        .when(article.isNotNull() & asked & ~has_article, "article_not_found").when(recital.isNotNull() & asked & ~has_recital, "recital_not_found")
        .when(best > hard, F.when(has_article, "answer").otherwise("too_far"))
        .when((best > max_distance) & ~has_article & ~has_recital & ~allow, "low_evidence").otherwise("answer")
    )
