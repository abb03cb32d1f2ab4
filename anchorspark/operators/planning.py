"""Plans of a retrieval: filters from the reader's focus, the question's own references, and intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refs as R
from ..functions import text as T

# How many passages each profile reads, and the least for a chapter's summary.
CONTEXT = {"LEGAL": 20, "ENGINEERING": 15}
CHAPTER_CONTEXT = {"LEGAL": 8, "ENGINEERING": 12}
GATED = ["CLASSIFICATION", "ENFORCEMENT", "REQUIREMENTS", "SCOPE"]
_FIELDS = ("corpus_id", "article", "chapter", "annex", "section", "recital")
Filter = dict[str, Column]


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def focus_filter(corpus_id: Column, focus: Column) -> Column:
    """A map of field to value from the reader's selection, a struct (type, article, chapter, annex, section); null for no filter."""
    kind, annex = focus["type"], F.upper(_text(focus["annex"]))
    is_section = (kind == "SECTION") & _text(focus["section"]).isNotNull()
    wanted = {
        "corpus_id": _text(corpus_id),
        "article": F.when(kind == "ARTICLE", _text(focus["article"])),
        "chapter": F.when((kind == "CHAPTER") | is_section, _text(focus["chapter"])),
        "annex": F.when((kind == "ANNEX") | is_section, annex),
        "section": F.when(is_section, _text(focus["section"])),
    }
    return _as_map(wanted)


def _as_map(wanted: Filter) -> Column:
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in wanted.items())), lambda p: p["value"].isNotNull())
    return F.when(F.size(pairs) > 0, F.map_from_entries(pairs))


def navigation(question: Column, focus_type: Column | None = None) -> Column:
    """The intent of a question, given what the reader has selected."""
    low, focus_type = F.lower(F.coalesce(question, F.lit(""))), F.lit(None).cast("string") if focus_type is None else focus_type
    summary = T.contains_any(low, ["sammenfat", "opsummer", "hvad handler", "hvad står"])
    on_chapter = (focus_type == "CHAPTER") & T.contains_any(low, ["kapitlet", "dette kapitel"]) & (summary | low.contains("kapitel"))
    article = low.rlike(R.SPACED_ARTICLE) & T.contains_any(low, ["sammenfat", "opsummer", "hvad siger", "hvad står"])
    return T.first_of([("STRUCTURE", T.contains_any(low, T.STRUCTURE_MARKERS)), ("CHAPTER_SUMMARY", F.coalesce(on_chapter, F.lit(False)) | (low.rlike(R.CHAPTER) & summary)), ("ARTICLE_SUMMARY", article)], "FREEFORM")


def plan(questions: DataFrame) -> DataFrame:
    """intent, top_k, where and allow_low for questions (question, corpus_id, profile, focus)."""
    intent = navigation(F.col("question"), F.col("focus.type"))
    by_profile = lambda of: F.when(F.col("profile") == "LEGAL", of["LEGAL"]).otherwise(of["ENGINEERING"])
    top_k = F.when(F.col("intent") == "CHAPTER_SUMMARY", F.greatest(by_profile(CONTEXT), by_profile(CHAPTER_CONTEXT))).otherwise(by_profile(CONTEXT))
    rows = questions.withColumn("intent", intent)
    return rows.withColumn("top_k", top_k).withColumn("where", focus_filter(F.col("corpus_id"), F.col("focus"))).withColumn("allow_low", (F.col("profile") == "ENGINEERING") | (F.col("intent") == "STRUCTURE"))


def refine(plans: DataFrame) -> DataFrame:
    """Plans whose where follows the question's references too: its chapter, the article if it names exactly one and has no numbered parts, its recital."""
    q, has = F.col("question"), lambda k: F.try_element_at(F.col("where"), F.lit(k))
    articles = R.article_refs(q)
    only = F.when(~R.is_multi_part(q) & (F.size(articles) == 1), articles[0])
    more = {"corpus_id": _text(F.col("corpus_id")), "chapter": R.chapter_ref(q), "article": only, "recital": R.recital_ref(q)}
    where = _as_map({k: F.coalesce(has(k), more[k]) if k in more else has(k) for k in _FIELDS})
    return plans.withColumn("multi_anchor", (F.size(articles) >= 2) | (F.size(R.annex_refs(q)) >= 1)).withColumn("where", where)


def matches(meta: Column, where: Column) -> Column:
    """Does a passage's metadata map hold every value of a filter map?"""
    return F.coalesce(F.forall(F.map_entries(where), lambda e: F.try_element_at(meta, e["key"]).eqNullSafe(e["value"])), F.lit(True))


def routed_intent(intent: Column, verdict: Column, in_context: Column) -> Column:
    """A keyword intent after a judge's verdict: a gated one about the law itself is GENERAL; GENERAL about the reader's system, seen in context, is CLASSIFICATION."""
    gated = intent.isin(*GATED)
    return F.when(gated & (verdict == "LAW_CONTENT"), "GENERAL").when((intent == "GENERAL") & in_context & (verdict == "USER_SYSTEM"), "CLASSIFICATION").otherwise(intent)


def hint_anchors(questions: DataFrame, concepts: DataFrame) -> DataFrame:
    """(query_id, hints): the anchors that the concepts (corpus_id, intent_key, bump_hints) of a question's intents (query_id, corpus_id, intents) point to, without white space, lower-case."""
    each = questions.select("query_id", "corpus_id", F.explode("intents").alias("intent_key")).join(concepts, ["corpus_id", "intent_key"])
    clean = F.transform("bump_hints", lambda a: F.regexp_replace(F.lower(F.trim(a)), r"\s+", ""))
    rows = each.select("query_id", F.explode(F.filter(clean, lambda a: F.length(a) > 0)).alias("hint"))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_set("hint")).alias("hints"))


def check_settings(weights: dict[str, float], chunk_size: int, overlap: int) -> list[str]:
    """Problems of settings: negative weights, a sum outside 0.95 to 1.05, an overlap not under the size."""
    found = [f"{k} is negative" for k, w in weights.items() if w < 0]
    if not 0.95 <= sum(weights.values()) <= 1.05:
        found.append("weights must add up to one")
    if not 0 <= overlap < chunk_size:
        found.append("overlap must be under the chunk size")
    return found
