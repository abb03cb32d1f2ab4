"""From an answer's text to the references that stand behind it, as one chain of columns.

backstop -> repair -> required numbers -> references used -> gating -> integrity

A row is an answer with all references that it could cite, in the order they
were retrieved: an array of struct (idx, chunk_id, corpus_id, article,
paragraph, recital, annex, label, words), words being the text that a question
is compared with.  Their ids and places are trimmed once, before all steps, and
blank ones are null.  Numbers in brackets mean idx.  The array is bounded by what
was retrieved for one question, so each step is an expression over it and the
whole chain is one projection, without a shuffle.

Defined results: a null answer or question is empty; null references are none;
values that repeat count once, the first; an empty table gives an empty table;
further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refs as R
from ..functions import text as T
from .answers import force_citations

REFERENCE = "struct<idx:int,chunk_id:string,corpus_id:string,article:string,paragraph:string,recital:string,annex:string,label:string,words:string>"
# Intents whose answers need a basis, its wording, endings that are cut from a question's words, and what a failed check is called.
BASED = ["SCOPE", "CLASSIFICATION", "REQUIREMENTS"]
BASIS = {"article": "Relevant hjemmel: Artikel ", "annex": "Relevant hjemmel: Bilag ", "recital": "Relevant hjemmel: Betragtning "}
REFERENCE_LIST = "\nReferencer:\n"
ENDINGS = ["erne", "erne", "ene", "erne", "er", "en", "et", "e", "s"]
TOO_FEW, NONE_CITED, UNKNOWN = "MIN_CITATIONS_NOT_MET_DOWNSTREAM", "CITATIONS_REQUIRED_DOWNSTREAM", "HALLUCINATED_IDX_DOWNSTREAM"
_NUMBER = r"\[\d{1,3}\]"
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def _body(answer: Column) -> Column:
    """An answer without the list of references that was put behind it."""
    return F.when(F.contains(answer, F.lit(REFERENCE_LIST)), _rstrip(F.substring_index(answer, REFERENCE_LIST, 1))).otherwise(answer)


def cleaned(refs: Column) -> Column:
    """References with their places and ids trimmed; blank ones are null."""
    tidy = lambda r, k: F.nullif(_strip(r[k]), F.lit("")).alias(k)
    fields = ("chunk_id", "corpus_id", "article", "paragraph", "recital", "annex")
    rows = F.coalesce(refs, F.array()).cast(f"array<{REFERENCE}>")
    return F.transform(rows, lambda r: F.struct(r["idx"].alias("idx"), *(tidy(r, k) for k in fields), r["label"].alias("label"), F.lower(F.coalesce(r["words"], F.lit(""))).alias("words"))).cast(f"array<{REFERENCE}>")


def _cited_in_order(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\[(\d{1,3})\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: n.cast("int")))


def _first(refs: Column, test) -> Column:
    return F.try_element_at(F.filter(refs, test), F.lit(1))


def _once(items: Column, key, kind: str) -> Column:
    """The items whose key no earlier one has."""
    start = F.array().cast(f"array<{kind}>")
    return F.aggregate(items, start, lambda kept, x: F.when(F.exists(kept, lambda y: key(y) == key(x)), kept).otherwise(F.concat(kept, F.array(x))))


def backstopped(answer: Column, refs: Column, least: int = 3) -> Column:
    """An answer that neither cites nor names a place gets lines with up to least places: articles, annexes, recitals, each once."""
    body = _body(answer)
    marker = (_strip(answer) == "") | (_strip(answer) == "MISSING_REF") | T.search(answer, r"\bUTILSTRÆKKELIG_EVIDENS\b")
    spoken_for = marker | body.rlike(_NUMBER) | (F.size(R.anchor_mentions(body)) > 0)
    row = "struct<value:string,idx:int>"

    def places(kind: str) -> Column:
        value = (lambda r: r["recital"]) if kind == "recital" else (lambda r: F.upper(r[kind]))
        found = F.transform(F.filter(refs, lambda r: value(r).isNotNull() & (r["idx"] > 0)), lambda r: F.struct(value(r).alias("value"), r["idx"].alias("idx")).cast(row))
        return F.transform(_once(found, lambda x: x["value"], row), lambda x: F.concat(F.lit(BASIS[kind]), x["value"], F.lit(" ["), x["idx"].cast("string"), F.lit("].")))

    lines = F.slice(F.concat(*(places(k) for k in BASIS)), 1, least)
    more = _strip(F.concat(_rstrip(answer), F.lit("\n\n"), F.array_join(lines, "\n")))
    return F.when(spoken_for | (F.size(lines) == 0), answer).otherwise(more)


def repaired(answer: Column, refs: Column, most: int = 8) -> Column:
    """An answer without numbers: a line that names places of exactly one reference gets its number, for at most so many references."""

    def number(kind: str, value: Column) -> Column:
        of = F.array_distinct(F.transform(F.filter(refs, lambda r: (F.upper(r[kind]) == value) & (r["idx"] > 0)), lambda r: r["idx"]))
        return F.when(F.size(of) == 1, of[0])

    def named(line: Column) -> Column:
        articles, annexes = R.article_refs(line), R.annex_refs(line)
        recitals = F.regexp_extract_all(line, F.lit(r"(?iU)\b(?:betragtning|recital)\s*\(?\s*(\d{1,4})\s*\)?\b"), F.lit(1))
        numbers = lambda kind, values: F.transform(values, lambda v: number(kind, v))
        found = F.concat(numbers("article", articles), numbers("annex", annexes), numbers("recital", recitals))
        return F.array_distinct(F.array_compact(found))

    lines = F.split(answer, _LINES)
    lines = F.when((F.size(lines) > 1) & (F.element_at(lines, -1) == ""), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    told = F.transform(lines, lambda line: F.struct(line.alias("line"), named(line).alias("named")))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.array().cast("array<int>").alias("cited"))

    def step(s: Column, x: Column) -> Column:
        hit = (F.size(x["named"]) == 1) & (F.size(s["cited"]) < most)
        marked = F.concat(_rstrip(x["line"]), F.lit(" ["), x["named"][0].cast("string"), F.lit("]"))
        return F.struct(F.concat(s["lines"], F.array(F.when(hit, marked).otherwise(x["line"]))).alias("lines"), F.when(hit, F.array_union(s["cited"], x["named"])).otherwise(s["cited"]).alias("cited"))

    untouched = (_strip(answer) == "MISSING_REF") | _body(answer).rlike(_NUMBER) | (F.size(refs) == 0)
    return F.when(untouched, answer).otherwise(F.array_join(F.aggregate(told, start, step)["lines"], "\n"))


def used_chunks(answer: Column, refs: Column) -> Column:
    """chunk_ids behind the numbers of an answer, in order, then behind the places it names."""
    body = _body(answer)
    of_number = F.transform(_cited_in_order(body), lambda n: _first(refs, lambda r: (r["idx"] == n) & (n > 0) & r["chunk_id"].isNotNull())["chunk_id"])

    def of_place(m: Column) -> Column:
        here = lambda kind: _first(refs, lambda r: (m["kind"] == kind) & (F.upper(r[kind]) == m["value"]))
        exact = _first(refs, lambda r: (m["kind"] == "article") & (F.upper(r["article"]) == m["value"]) & (r["paragraph"] == m["paragraph"]))
        article = F.when(m["paragraph"].isNotNull() & exact.isNotNull(), exact).otherwise(here("article"))
        return F.coalesce(article, here("recital"), here("annex"))["chunk_id"]

    return F.array_distinct(F.array_compact(F.concat(of_number, F.transform(R.anchor_mentions(body), of_place))))


def question_stems(question: Column) -> Column:
    """A question's words of four letters or more, with the beginnings of long ones and without one common ending."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit("[a-zA-ZæøåÆØÅ]{4,}"), F.lit(0)))
    starts = F.transform(F.filter(words, lambda w: F.length(w) >= 9), lambda w: F.array(F.substring(w, 1, 6), F.substring(w, 1, 8)))
    cut = lambda w: F.coalesce(*(F.when(w.endswith(e) & (F.length(w) - len(e) >= 4), F.left(w, F.length(w) - len(e))) for e in ENDINGS))
    return F.array_distinct(F.array_compact(F.concat(words, F.flatten(starts), F.transform(words, cut))))


def fallback_chunks(question: Column, refs: Column, most: int = 2) -> Column:
    """chunk_ids for an answer that may lack numbers: articles before recitals before annexes, each by the question's stems in their words."""

    def of(stems: Column) -> Column:
        given = lambda r, k: r[k]
        kind = lambda r: F.when(given(r, "article").isNotNull(), 0).when(given(r, "recital").isNotNull(), 1).when(given(r, "annex").isNotNull(), 2)
        place = lambda r: F.coalesce(given(r, "article"), given(r, "recital"), given(r, "annex"))
        overlap = lambda r: F.size(F.filter(stems, lambda t: F.contains(r["words"], t)))

        def candidate(r: Column, pos: Column) -> Column:
            number = F.coalesce(F.when((overlap(r) > 0) & (kind(r) < 2), place(r).try_cast("bigint")), F.lit(10**9).cast("bigint"))
            return F.struct(kind(r).alias("kind"), (-overlap(r)).alias("score"), number.alias("number"), pos.alias("pos"), place(r).alias("place"), r["chunk_id"].alias("chunk_id"))

        fit = F.filter(F.transform(refs, candidate), lambda x: x["kind"].isNotNull() & x["chunk_id"].isNotNull())
        kind_of = "struct<kind:int,score:int,number:bigint,pos:int,place:string,chunk_id:string>"
        once = _once(F.array_sort(fit).cast(f"array<{kind_of}>"), lambda x: F.concat(x["kind"].cast("string"), F.lit(":"), x["place"]), kind_of)
        return F.slice(F.transform(once, lambda x: x["chunk_id"]), 1, most)

    return T.let(question_stems(question), of)


def gated(answer: Column, refs: Column, used: Column) -> Column:
    """The references behind used chunks that have a place, the cited ones first, one for each place of a corpus."""
    cited = F.transform(_cited_in_order(_body(answer)), lambda n: _first(refs, lambda r: (r["idx"] == n) & (n > 0) & r["chunk_id"].isNotNull())["chunk_id"])
    order = F.array_distinct(F.concat(F.array_compact(cited), used))
    of = F.array_compact(F.transform(order, lambda c: F.try_element_at(F.filter(refs, lambda r: r["chunk_id"] == c), F.lit(-1))))
    given = lambda r, k: r[k]
    place = lambda r: F.coalesce(*(F.concat(F.lit(f"{k}:"), given(r, k)) for k in ("article", "recital", "annex")))
    key = lambda r: F.concat(F.coalesce(r["corpus_id"], F.lit("")), F.lit("\n"), place(r))
    return _once(F.filter(of, lambda r: place(r).isNotNull()), key, REFERENCE)


def checked(answer: Column, refs: Column, found: Column, used: Column, least: Column, structured: Column) -> Column:
    """(answer, references, used, fail_reason): numbers come from the text, else from the structured answer; each must have a reference."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    known = F.array_distinct(F.transform(refs, lambda r: r["idx"]))
    wanted = (F.coalesce(least, F.lit(0)) > 0) & (F.size(known) >= least)

    def of(cited: Column) -> Column:
        first = F.when(F.size(found) > 0, found).otherwise(F.filter(refs, lambda r: F.array_contains(cited, r["idx"])))
        return T.let(first, lambda first: T.let(completed(cited, first), lambda whole: T.let(F.array_distinct(F.transform(whole, lambda r: r["idx"])), lambda have: verdict(cited, whole, have))))

    def completed(cited: Column, first: Column) -> Column:
        lost = F.transform(F.array_except(cited, F.transform(first, lambda r: r["idx"])), lambda n: _first(refs, lambda r: (r["idx"] == n) & (n > 0)))
        return F.when(F.size(first) > 0, F.concat(first, F.array_compact(lost))).otherwise(first)

    def verdict(cited: Column, whole: Column, have: Column) -> Column:
        valid = lambda among: F.size(F.array_intersect(cited, among))
        both = (F.size(cited) > 0) & (F.size(have) > 0)
        reason = (
            F.when(wanted & (valid(known) < least), TOO_FEW).when((F.size(have) > 0) & (F.size(cited) == 0) & (_strip(answer) != "MISSING_REF"), NONE_CITED)
            .when(both & (F.size(F.array_except(cited, have)) > 0), UNKNOWN).when(both & wanted & (valid(have) < least), TOO_FEW)
        )
        kept = F.when(both, F.filter(whole, lambda r: F.array_contains(cited, r["idx"]))).otherwise(whole)
        return T.let(reason, lambda why: F.struct(F.when(why.isNull(), answer).otherwise("MISSING_REF").alias("answer"), F.when(why.isNull(), kept).otherwise(none(REFERENCE)).alias("references"), F.when(why.isNull(), used).otherwise(none("string")).alias("used"), why.alias("fail_reason")))

    from_text = F.array_sort(_cited_in_order(_body(answer)))
    return T.let(F.when(F.size(from_text) > 0, from_text).otherwise(F.array_sort(F.array_distinct(F.coalesce(structured, none("int"))))), of)


def process(answers: DataFrame) -> DataFrame:
    """answers with answer, references, reference_lines, used and fail_reason after the whole chain.

    answers: answer, question, refs (array of REFERENCE), profile, intent,
    abstained, required (numbers), least (citations asked for, or null),
    fallback (may a LEGAL answer take references of its own?), structured
    (numbers of a structured answer, or null) and rendered (its text, or null).
    """
    engineering, refs = F.col("profile") == "ENGINEERING", F.col("refs")
    rows = answers.withColumns({"answer": F.coalesce("answer", F.lit("")), "question": F.coalesce("question", F.lit("")), "refs": cleaned(refs)})
    asks = engineering & F.col("intent").isin(*BASED) & ~F.coalesce("abstained", F.lit(False))
    rows = rows.withColumn("answer", F.when(F.coalesce(asks, F.lit(False)), backstopped(F.col("answer"), refs)).otherwise(F.col("answer")))
    rows = rows.withColumn("answer", F.when(engineering, repaired(F.col("answer"), refs)).otherwise(F.col("answer")))
    required = F.array_sort(F.array_distinct(F.coalesce("required", F.array().cast("array<int>"))))
    rows = rows.withColumn("answer", F.when(engineering & (F.size(required) > 0), force_citations(F.col("answer"), F.array_except(required, _cited_in_order(_body(F.col("answer")))))).otherwise(F.col("answer")))
    rows = rows.withColumn("used", used_chunks(F.col("answer"), refs))
    own = fallback_chunks(F.col("question"), refs)
    filled = F.when(F.size("used") < 2, F.slice(F.array_distinct(F.concat("used", own)), 1, 2)).otherwise(F.col("used"))
    rows = rows.withColumn("used", F.when((F.col("profile") == "LEGAL") & F.coalesce("fallback", F.lit(False)), filled).otherwise(F.col("used")))
    rows = rows.withColumn("references", gated(F.col("answer"), refs, F.col("used")))
    given = F.when((_strip(F.col("answer")) != "MISSING_REF") & (_strip(F.coalesce("rendered", F.lit(""))) != ""), F.col("rendered")).otherwise(F.col("answer"))
    tested = checked(given, refs, F.col("references"), F.col("used"), F.col("least"), F.col("structured"))
    plain = F.struct(F.col("answer"), F.col("references"), F.col("used"), F.lit(None).cast("string").alias("fail_reason"))
    rows = rows.withColumn("chain", F.when(engineering, tested).otherwise(plain))
    line = lambda r: F.concat(F.lit("["), r["idx"].cast("string"), F.lit("] "), F.coalesce(r["label"], F.lit("")))
    kept = [c for c in answers.columns if c not in ("answer", "references", "reference_lines", "used", "fail_reason")]
    return rows.select(*kept, "chain.*", F.transform("chain.references", line).alias("reference_lines"))
