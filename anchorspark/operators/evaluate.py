"""Cases, suites and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import metrics, rank


def ordered_text(rows: DataFrame, by: str, order: str, text: str, most: int, sep: str = "\n") -> DataFrame:
    """The texts of each group in order, joined and cut to most characters with "..."; a group is one article or one talk."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), sep)
    return rows.groupBy(by).agg(joined.alias("t")).select(by, F.when(F.length("t") > most, F.concat(F.substring("t", 1, most), F.lit("..."))).otherwise(F.col("t")).alias("text"))


def blank_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, missing): rows without a value in each required column, in one pass."""
    counts = df.agg(*(F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in columns))
    return counts.select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c))))).alias("field", "missing"))


def case_passed(scores: DataFrame, by: str, passed: str) -> DataFrame:
    """A case passes if every scorer passes; a scorer that didn't run doesn't count."""
    return scores.where(F.col(passed).isNotNull()).groupBy(by).agg(F.bool_and(passed).alias("passed"), F.count("*").alias("scorers"))


def allocate(weights: DataFrame, by: str, order: str, name: str, weight: str, total: int) -> DataFrame:
    """(by, name, n): shares of a total by each group's weights in order, rounded half to even; the last takes the rest.

    Weights that add up to less than one are brought to one; a sum above one, or of nothing, is an error.
    """
    listed = weights.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, name, weight))).alias("w"))
    total_weight = F.aggregate("w", F.lit(0.0), lambda s, x: s + x[weight])
    checked = F.when(total_weight > 1 + 1e-9, F.raise_error(F.lit("weights add up to more than one")).cast("double")).when(total_weight < 1e-9, F.raise_error(F.lit("weights add up to nothing")).cast("double")).otherwise(total_weight)
    rows = listed.select(by, "w", checked.alias("sum"))
    counts = F.transform("w", lambda x, i: F.struct(x[name].alias("name"), F.when(i < F.size("w") - 1, F.bround(x[weight] / F.col("sum") * total).cast("long")).alias("n")))
    placed = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["n"], F.lit(0)))
    return rows.select(by, counts.alias("c"), placed.alias("placed")).select(by, F.explode("c").alias("c"), "placed").select(by, F.col("c.name").alias(name), F.coalesce(F.col("c.n"), total - F.col("placed")).alias("n"))


def cyclic(rows: DataFrame, by: str, order: list[Column], labels: list[str]) -> DataFrame:
    """Labels in turn within each group."""
    at = F.pmod(F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1, F.lit(len(labels)))
    return rows.withColumn("label", F.element_at(F.array(*map(F.lit, labels)), (at + 1).cast("int")))


def gate_references(citations: DataFrame, references: DataFrame) -> DataFrame:
    """Cited, eligible references in the order of citation, one for each (corpus, kind, value), numbered from 1."""
    hit = citations.join(references.where("eligible"), ["query_id", "idx"])
    first = hit.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "corpus_id", "kind", "value").orderBy("pos"))).where("r = 1")
    return first.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).drop("r")


def overlap_fallback(question: Column, body: Column) -> Column:
    """How many of a question's words of at least four letters stand in a text."""
    words = F.array_distinct(F.filter(T.lexical_tokens(question), lambda w: F.length(w) >= 4))
    return F.size(F.array_intersect(words, T.lexical_tokens(body)))


def merge_policies(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Policies (order, hints, guard, strict) of a key in order: hints united, the last guard wins, strict sticks."""
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "hints", "guard", "strict"))).alias("p"))
    guards = F.filter("p", lambda s: s["guard"].isNotNull())
    return listed.select(by, F.array_sort(F.array_distinct(F.flatten(F.transform("p", lambda s: s["hints"])))).alias("hints"), F.try_element_at(guards, F.lit(-1))["guard"].alias("guard"), F.exists("p", lambda s: s["strict"]).alias("strict"))


def validate_suite(cases: DataFrame, corpora: DataFrame) -> DataFrame:
    """(case_id, problem): duplicate ids, unknown corpora, comparisons of fewer than two corpora."""
    dup = cases.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("DUPLICATE_ID").alias("problem"))
    each = cases.select("case_id", F.explode("corpora").alias("corpus_id"))
    unknown = each.join(corpora, "corpus_id", "left_anti").select("case_id", F.lit("UNKNOWN_CORPUS").alias("problem"))
    few = cases.where((F.col("mode") == "comparison") & (F.size("corpora") < 2)).select("case_id", F.lit("TOO_FEW_CORPORA").alias("problem"))
    return dup.union(unknown).union(few).distinct()


def difficulty(n_words: Column, n_corpora: Column) -> Column:
    return F.when((n_words > 300) | (n_corpora > 2), "hard").when((n_words > 100) | (n_corpora > 1), "medium").otherwise("easy")


def test_types(any_of: Column, behavior: Column, contract: Column, n_corpora: Column) -> Column:
    return F.array_compact(F.array(F.when(F.size(any_of) > 0, "retrieval"), F.when(behavior == "abstain", "abstention"), F.when(contract, "contract"), F.when(n_corpora > 1, "multi_hop"), F.lit("faithfulness")))


#: Fixed value: words in the id of a case that tests robustness.
ROBUSTNESS = ["adversarial", "edge", "negation", "hypothetical", "ambiguous"]


def inferred_test_types(case_id: Column, all_of: Column, behavior: Column, contract: Column) -> Column:
    """What an old case without test types tests, by its shape and its id."""
    low = F.lower(F.coalesce(case_id, F.lit("")))
    several = (F.size(F.coalesce(all_of, F.array().cast("array<string>"))) > 0) | low.contains("multi")
    return F.array_compact(F.array(F.lit("retrieval"), F.when(several, "multi_hop"), F.when(behavior == "abstain", "abstention"), F.when(contract, "faithfulness"), F.when(T.contains_any(low, ROBUSTNESS), "robustness")))


# Fixed value: wordings that tie one act to another.
CROSS_REFERENCES = [
    r"\breferences?\b.*\b(gdpr|ai.?act|nis2|dora|cra)\b",
    r"\b(gdpr|ai.?act|nis2|dora|cra)\b.*\breferences?\b",
    r"\bin\s+accordance\s+with\b.*\b(gdpr|ai.?act|nis2|dora|cra)\b",
    r"\bpursuant\s+to\b.*\b(gdpr|ai.?act|nis2|dora|cra)\b",
    r"\bas\s+defined\s+in\b.*\b(gdpr|ai.?act|nis2|dora|cra)\b",
    r"\bunder\b.*\b(gdpr|ai.?act|nis2|dora|cra)\b",
    r"\bhenviser\s+til\b.*\b(gdpr|ai.?act|nis2|dora|cra)\b",
    r"\bi\s+overensstemmelse\s+med\b.*\b(gdpr|ai.?act|nis2|dora|cra)\b",
]


def cross_references(answer: Column, cited: Column) -> Column:
    """(passed, score, claimed): an answer that ties one act to another must cite two corpora or more."""
    claimed = F.coalesce(T.search(answer, *CROSS_REFERENCES), F.lit(False))
    passed = ~claimed | (F.size(F.array_distinct(cited)) >= 2)
    return F.struct(passed.alias("passed"), F.when(passed, 1.0).otherwise(0.0).alias("score"), claimed.alias("claimed"))


def routing_recall(expected: Column, routed: Column, least: float = 0.8) -> Column:
    """(passed, score): the share of expected corpora among those routed to."""
    score = F.when(F.size(expected) > 0, F.size(F.array_intersect(expected, routed)) / F.size(expected)).otherwise(F.lit(1.0))
    return F.struct((score >= least).alias("passed"), score.alias("score"))


def completeness(targets: Column, cited: Column) -> Column:
    """(passed, missing): the targets of a comparison that an answer leaves out."""
    missing = F.array_sort(F.array_except(targets, cited))
    return F.struct((F.size(missing) == 0).alias("passed"), missing.alias("missing"))


def scope_quota(hits: DataFrame, quota: int, k: int) -> DataFrame:
    """At most quota hits of each scope first, then the nearest of the rest, k in all; a chunk once, at its least distance."""
    best = hits.groupBy("query_id", "chunk_id").agg(F.min(F.struct("distance", "scope")).alias("b")).select("query_id", "chunk_id", "b.distance", "b.scope")
    within = F.row_number().over(Window.partitionBy("query_id", "scope").orderBy("distance", "chunk_id")) <= quota
    placed = best.withColumn("within", within)
    order = Window.partitionBy("query_id").orderBy(F.desc("within"), "distance", "chunk_id")
    kept = placed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))).drop("r", "within")


def calibrated(cases: DataFrame, expected: str, retrieved: str) -> DataFrame:
    """Whether retrieval found any expected anchor of each case."""
    return cases.withColumn("confirmed", F.arrays_overlap(expected, retrieved))


def faithfulness(verdicts: DataFrame, by: str, supported: str, least: float = 0.75) -> DataFrame:
    """(passed, score): the share of claims that a judge's verdicts support; claims without a verdict count as unsupported."""
    share = F.avg(F.coalesce(F.col(supported), F.lit(False)).cast("int"))
    return verdicts.groupBy(by).agg(share.alias("score")).withColumn("passed", F.col("score") >= least)


def relevancy(raw: Column, least: float = 0.75) -> Column:
    """(passed, score) of a judge's mark from 0 to 10; no mark scores zero."""
    score = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw / 10)), F.lit(0.0))
    return F.struct((score >= least).alias("passed"), score.alias("score"))


def three_state(ok: Column) -> Column:
    """pass, fail, or not_run where a check left no result."""
    return F.when(ok.isNull(), "not_run").when(ok, "pass").otherwise("fail")


def enrichment_coverage(described: Column, n_terms: Column, least: int = 2) -> Column:
    """(passed, score): half for a description, half for enough search terms."""
    parts = [F.coalesce(F.length(F.trim(described)) > 0, F.lit(False)), F.coalesce(n_terms >= least, F.lit(False))]
    return F.struct((parts[0] & parts[1]).alias("passed"), sum((F.when(p, 0.5).otherwise(0.0) for p in parts), F.lit(0.0)).alias("score"))


def required_numbers(references: DataFrame, required: DataFrame) -> DataFrame:
    """(query_id, numbers, missing) for required (query_id, grp, anchor, every): of a group of alternatives the least
    number of any; of a group where every anchor counts the least of each.  missing: anchors that no reference holds, but
    for alternatives only where none is held.  references: (query_id, number, anchor)."""
    least = references.groupBy("query_id", F.lower("anchor").alias("anchor")).agg(F.min("number").alias("number"))
    held = required.withColumn("anchor", F.lower("anchor")).distinct().join(least, ["query_id", "anchor"], "left")
    lost = F.array_sort(F.collect_list(F.when(F.col("number").isNull(), F.col("anchor"))))
    groups = held.groupBy("query_id", "grp", "every").agg(F.array_compact(F.collect_list("number")).alias("n"), F.min("number").alias("low"), lost.alias("lost"))
    numbers = F.when(F.col("every"), F.col("n")).when(F.col("low").isNotNull(), F.array("low")).otherwise(F.array().cast(groups.schema["n"].dataType))
    missing = F.when(F.col("every") | F.col("low").isNull(), F.col("lost")).otherwise(F.array().cast("array<string>"))
    merged = groups.groupBy("query_id").agg(F.flatten(F.collect_list(numbers)).alias("n"), F.flatten(F.collect_list(missing)).alias("m"))
    return merged.select("query_id", F.array_sort(F.array_distinct("n")).alias("numbers"), F.array_sort(F.array_distinct("m")).alias("missing"))


def case_chunks(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, found): the chunk a case names, else the first chunk with its anchor as a whole part of the location."""
    by_id = cases.select("case_id", "chunk_id", "anchor").join(chunks.select(F.col("chunk_id"), F.col("chunk_id").alias("named")), "chunk_id", "left")
    parts = chunks.select(F.col("chunk_id").alias("located"), "chunk_index", F.explode(F.array_distinct(F.split("location_id", "/"))).alias("anchor"))
    first = parts.groupBy("anchor").agg(F.min_by("located", F.struct("chunk_index", "located")).alias("located"))
    return by_id.join(first, "anchor", "left").select("case_id", F.coalesce("named", "located").alias("found"))


def distance_quantiles(best: DataFrame, value: str) -> DataFrame:
    """count, min, p50, p80, p90, max of a column, by floor rank; one row, its values null for an empty table."""
    one = F.lit(0).alias("one")
    at = metrics.quantiles(best.select(one, value), ["one"], value, (0.5, 0.8, 0.9), interpolated=False).select("one", F.col("p0").alias("p50"), F.col("p1").alias("p80"), F.col("p2").alias("p90"))
    whole = best.agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max")).select(one, "*")
    return whole.join(at, "one", "left").select("count", "min", "p50", "p80", "p90", "max")


def compare_runs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Precision and recall of two runs (key, precision, recall) side by side, means over the cases of each, and the gains."""
    mean = lambda df, tag: df.agg(F.count(key).alias(f"n_{tag}"), F.avg("precision").alias(f"precision_{tag}"), F.avg("recall").alias(f"recall_{tag}"))
    both = mean(a, "a").crossJoin(F.broadcast(mean(b, "b")))  # one row each
    return both.withColumn("precision_gain", F.col("precision_b") - F.col("precision_a")).withColumn("recall_gain", F.col("recall_b") - F.col("recall_a"))


def with_defaults(cases: DataFrame) -> DataFrame:
    """Cases with every field of what is expected filled in, and their problems: no id, no prompt, unknown behaviour,
    or bounds of citations that contradict each other."""
    lists = ["must_include_any_of", "must_include_any_of_2", "must_include_all_of", "must_not_include_any_of", "test_types"]
    empty = F.array().cast("array<string>")
    full = cases.withColumns({c: F.coalesce(F.col(c), empty) if c in cases.columns else empty for c in lists})
    plain = {"behavior": F.lit("answer"), "contract_check": F.lit(False), "corpus_scope": F.lit("single"), "min_citations": F.lit(None).cast("int"), "max_citations": F.lit(None).cast("int")}
    full = full.withColumns({c: F.coalesce(F.col(c), v) if c in cases.columns else v for c, v in plain.items()})
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    tests = [("NO_ID", blank("id")), ("NO_PROMPT", blank("prompt")), ("BEHAVIOR", ~F.col("behavior").isin("answer", "abstain")), ("CITATION_BOUNDS", F.col("min_citations") > F.col("max_citations"))]
    return full.withColumn("problems", F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests))))


def numbered_ids(cases: DataFrame, stem: str, order: list[Column]) -> DataFrame:
    """case_id: the stem, and stem-2, stem-3 ... for later rows of the same stem."""
    n = F.row_number().over(Window.partitionBy(stem).orderBy(*order))
    return cases.withColumn("case_id", F.when(n == 1, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("-"), n.cast("string"))))


def citation_verification(checked: Column, least: float = 0.75) -> Column:
    """(passed, score, message) of an answer's checked citations, a struct (verified, suspicious, overall); passed if there was nothing to check."""
    score, n, odd = F.coalesce(checked["overall"], F.lit(1.0)), F.greatest(F.size(checked["verified"]), F.lit(0)), F.greatest(F.size(checked["suspicious"]), F.lit(0))
    told = F.when(odd > 0, F.format_string("%d verified, %d suspicious (score: %.2f)", n, odd, score)).otherwise(F.format_string("all %d citations verified (score: %.2f)", n, score))
    none = checked.isNull()
    return F.struct((none | (score >= least)).alias("passed"), F.when(none, 1.0).otherwise(score).alias("score"), F.when(none, "citation verification not run").otherwise(told).alias("message"))


def article_contents(chunks: DataFrame, most_chars: int = 400, most: int = 30, least_chars: int = 50) -> DataFrame:
    """(corpus_id, text): a prompt's section on each corpus's first articles: number, title, and the start of the first text of some length.

    chunks: corpus_id, place (their order in the corpus), article, article_title
    and text.  An article's title is that of its first chunk; articles beyond
    the first are counted.
    """
    number = F.when(F.col("article").rlike(r"^\d+$"), F.col("article").cast("bigint"))
    long = F.when(F.length("text") > least_chars, F.col("place"))
    rows = chunks.select("corpus_id", number.alias("number"), "place", F.coalesce("article_title", F.lit("")).alias("title"), F.col("text"), long.alias("long"))
    each = rows.where("number is not null").groupBy("corpus_id", "number").agg(F.min_by("title", "place").alias("title"), F.min_by(F.struct("text"), "long")["text"].alias("text"))
    first = F.concat(F.substring("text", 1, most_chars), F.when(F.length("text") > most_chars, "...").otherwise(""))
    body = F.nullif(F.trim(F.replace(first, F.lit("\n"), F.lit(" "))), F.lit(""))
    lines = F.concat(F.array(F.concat(F.lit("### Artikel "), F.col("number").cast("string"), F.lit(": "), F.col("title"))), F.when(body.isNotNull(), F.array(F.concat(F.lit("Indhold: "), body))).otherwise(F.array().cast("array<string>")), F.array(F.lit("")))
    placed = rank.top_k(each.select("corpus_id", "number", lines.alias("lines")), ["corpus_id"], [F.asc("number")], most, "r")
    shown = placed.groupBy("corpus_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("number", "lines"))), lambda s: s["lines"])).alias("lines"))  # at most so many articles
    total = rows.groupBy("corpus_id").agg(F.count_distinct("number").alias("n"))
    more = F.when(F.col("n") > most, F.array(F.concat(F.lit("... og "), (F.col("n") - most).cast("string"), F.lit(" yderligere artikler")))).otherwise(F.array().cast("array<string>"))
    text = F.when(F.col("n") == 0, "(Ingen artikler fundet)").otherwise(F.array_join(F.concat("lines", more), "\n"))
    return total.join(shown, "corpus_id", "left").select("corpus_id", text.alias("text"))
