"""Column functions over a passage's place: references, citability, evidence and prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Keywords of the article roles; labels of a passage and, in order of precedence, the evidence that their words stand for; forms of references in a text.
KEYWORD_ROLES = {"scope": T.SCOPE, "definitions": ["definitioner", "definitions", "for the purposes of this regulation", "i denne forordning forstås", "means", "begreber", "definition"], "obligations": T.REQUIREMENTS_STRONG, "classification": T.CLASSIFICATION, "enforcement": T.ENFORCEMENT}
LABELS = ["heading_path", "heading_path_display", "toc_path", "title", "location_id", "source", "display", "article_title", "chapter_title", "section_title", "annex_title"]
EVIDENCE = {
    "FORBIDDEN": ["forbud", "forbudte", "prohibited", "forbidden"],
    "ENFORCEMENT": ["håndhævelse", "sanktion", "sanktioner", "bøde", "bøder", "klage", "tilsyn", "markedsovervåg", "complaint", "enforcement", "market surveillance", "surveillance authority", "supervision", "penalt", "fine", "sanction", "remedy", "redress"],
    "DEFINITION": ["definition", "definitions", "definitioner", "begreb", "begreber", "forstås ved", "means", "shall mean"],
    "SCOPE": ["anvendelsesområde", "scope", "applicability", "definition", "definitions", "omfang"],
    "CLASSIFICATION": ["højrisiko", "high-risk", "high risk", "klassific", "classification", "annex", "bilag", "kategori"],
}
PRECISE = [
    r"\b(?:Article|Artikel)\s+\d{1,3}[a-z]?(?:\s*\(\s*\d{1,3}\s*\))?\b",
    r"\bArt\.?\s*\d{1,3}[a-z]?(?:\s*\(\s*\d{1,3}\s*\))?\b",
    r"\b(?:Chapter|Kapitel)\s+(?:[IVXLCDM]+|\d{1,3})\b",
    r"\b(?:Annex|Bilag)\s+(?:[IVXLCDM]+|\d{1,3})\b",
    r"\b(?:Recital|Betragtning)\s+\d{1,4}\b",
]
KINDS = ["article", "annex", "chapter", "recital"]
ARTICLE = r"(?:artikel|article)\s*(\d{1,3}[a-z]?)"


def article_refs(text: Column) -> Column:
    """Article numbers that a question names, upper-case, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ARTICLE), F.lit(1)), F.upper))


def hard_scope(text: Column) -> Column:
    """The article that a question is about, if it names exactly one."""
    refs = article_refs(text)
    return F.when(F.size(refs) == 1, refs[0])


def keyword_roles(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(T.contains_any(text, words), F.lit(role)) for role, words in KEYWORD_ROLES.items())))


def evidence_type(meta: Column) -> Column:
    """What a passage is evidence of, by the labels in its metadata map; UNKNOWN without any."""
    labels = F.array_compact(F.array(*(F.nullif(F.trim(F.try_element_at(meta, F.lit(k))), F.lit("")) for k in LABELS)))
    return T.let(F.lower(F.array_join(labels, " ")), lambda low: T.first_of([(name, F.coalesce(F.exists(F.array(*map(F.lit, words)), low.contains), F.lit(False))) for name, words in EVIDENCE.items()], "UNKNOWN"))


def precise_ref(text: Column) -> Column:
    """The first reference in a text of the first form that it has, as written; null without one."""
    found = [F.regexp_extract(text, "(?iUd)" + p, 0) for p in PRECISE]
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found))


def citability(meta: Column, text: Column) -> Column:
    """(citable, label): a place in the metadata map, its location or its heading path; else a reference in the text, whose label is the source and that reference."""
    has = lambda k: F.coalesce(F.length(F.try_element_at(meta, F.lit(k))) > 0, F.lit(False))
    starts = lambda parts: F.coalesce(F.exists(parts, lambda p: F.lower(F.trim(p)).rlike(f"^({'|'.join(KINDS)}):")), F.lit(False))
    path = F.trim(F.try_element_at(meta, F.lit("heading_path")))
    located = starts(F.split(F.try_element_at(meta, F.lit("location_id")), "/")) | starts(F.when(path.startswith("["), F.from_json(path, "array<string>")))
    placed = has("article") | has("annex") | has("chapter") | has("recital") | located
    named = F.when(~placed, precise_ref(text))
    given = lambda k: F.nullif(F.trim(F.try_element_at(meta, F.lit(k))), F.lit(""))
    label = F.concat(F.coalesce(given("source"), given("corpus_id"), F.lit("Unknown source")), F.lit(", "), named)
    return F.struct((placed | named.isNotNull()).alias("citable"), label.alias("label"))


def embedding_text(text: Column, meta: Column, terms: Column | None = None) -> Column:
    """A passage with its chapter, its article, annex or recital, and its search terms on lines of their own before it."""
    get = lambda k: F.nullif(F.try_element_at(meta, F.lit(k)), F.lit(""))
    titled = lambda name, k: F.when(get(k).isNotNull(), F.concat(F.lit(f"[{name} "), get(k), F.coalesce(F.concat(F.lit(": "), get(f"{k}_title")), F.lit("")), F.lit("]")))
    place = F.coalesce(titled("Artikel", "article"), titled("Bilag", "annex"), F.concat(F.lit("[Betragtning "), get("recital"), F.lit("]")))
    words = None if terms is None else F.when(F.size(terms) > 0, F.concat(F.lit("[Søgetermer: "), F.array_join(terms, " | "), F.lit("]")))
    head = F.array_compact(F.array(titled("Kapitel", "chapter"), place, *([] if words is None else [words])))
    return F.when(F.size(head) > 0, F.concat(F.array_join(head, "\n"), F.lit("\n\n"), text)).otherwise(text)


def enrichment_key(corpus: Column, article_title: Column, text: Column) -> Column:
    """The key under which a passage's search terms and roles are stored; it changes with the title and with the first 500 characters."""
    content = F.concat(F.lit("v3:"), F.coalesce(corpus, F.lit("")), F.lit(":"), F.coalesce(article_title, F.lit("")), F.lit(":"), F.substring(F.coalesce(text, F.lit("")), 1, 500))
    return F.substring(F.sha2(content, 256), 1, 16)


def article_title(meta: Column) -> Column:
    """`Artikel 6 - Title` of a passage's article; empty without one."""
    get = lambda k: F.nullif(F.try_element_at(meta, F.lit(k)), F.lit(""))
    return F.coalesce(F.concat(F.lit("Artikel "), get("article"), F.coalesce(F.concat(F.lit(" - "), get("article_title")), F.lit(""))), F.lit(""))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def _get(meta: Column, key: str) -> Column:
    return F.nullif(F.trim(F.try_element_at(meta, F.lit(key))), F.lit(""))


def _joined(*parts: Column) -> Column:
    """The parts put together, those that are null left out."""
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))


def prompt_label(meta: Column) -> Column:
    """How a prompt names a passage: its article, annex or recital with the parts of it, else its reference, location, path or display."""
    return T.let(meta, _prompt_label)  # the map is built once a row, however many of its values are read


def _prompt_label(meta: Column) -> Column:
    g = lambda k: _get(meta, k)
    base = F.coalesce(*(F.concat(F.lit(f"{name} "), g(k)) for k, name in (("article", "Artikel"), ("annex", "Bilag"), ("recital", "Betragtning"))))
    point = F.concat(F.lit(", punkt "), g("annex_point"), _joined(F.concat(F.lit(", "), g("annex_subpoint"))))
    paragraph = F.concat(F.lit(", stk. "), g("paragraph"), _joined(F.concat(F.lit(", litra "), g("litra"))))
    return F.coalesce(F.concat(base, _joined(point, paragraph)), *(g(k) for k in ("precise_ref", "location_id", "heading_path", "display")), F.lit("(ukendt)"))


def prompt_excerpt(meta: Column, terms: Column, roles: Column, text: Column) -> Column:
    """What a prompt tells of a passage, at most 400 characters: path, description, up to five terms, roles; else its first two lines; else its label."""
    return T.let(meta, lambda m: _prompt_excerpt(m, terms, roles, text))


def _prompt_excerpt(meta: Column, terms: Column, roles: Column, text: Column) -> Column:
    g = lambda k: _get(meta, k)
    some = lambda words, name: F.when(F.size(words) > 0, F.concat(F.lit(f"{name}: "), F.nullif(F.array_join(F.filter(words, lambda w: F.length(w) > 0), ", "), F.lit(""))))
    told = F.array_compact(F.array(g("heading_path_display"), g("contextual_description"), some(F.slice(terms, 1, 5), "Søgetermer"), some(roles, "Roller")))
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    raw = F.nullif(F.substring(F.array_join(F.slice(lines, 1, 2), " / "), 1, 260), F.lit(""))
    return F.when(F.size(told) > 0, F.substring(F.array_join(told, " | "), 1, 400)).otherwise(F.coalesce(raw, F.concat(F.lit("<"), _prompt_label(meta), F.lit(">"))))


def display_name(meta: Column, mentions: Column | None = None) -> Column:
    """A passage's source and place in words, with titles; the place comes from its location where no field tells it."""
    return T.let(meta, lambda m: T.let(_location_places(m), lambda parts: _display_name(m, parts, mentions)))


_KINDS = ("chapter", "section", "article", "annex", "recital", "citation", "preamble")


def _location_places(meta: Column) -> Column:
    """The parts of a passage's location, null if a field tells its place."""
    return F.when(F.coalesce(*(_get(meta, k) for k in _KINDS)).isNull(), T.location_parts(F.coalesce(_get(meta, "location_id"), F.lit(""))))


def _display_name(meta: Column, parts: Column, mentions: Column | None) -> Column:
    upper = ("chapter", "section", "article", "annex", "annex_section")
    found = lambda k: F.try_element_at(parts, F.lit(k))
    g = lambda k: F.coalesce(_get(meta, k), (F.upper(found(k)) if k in upper else found(k)) if k in (*_KINDS, "annex_point") else F.lit(None).cast("string"))
    one = lambda name, k, titled=False: F.concat(F.lit(name), g(k), _joined(F.concat(F.lit(" ("), _get(meta, f"{k}_title"), F.lit(")"))) if titled else F.lit(""))
    words = [_get(meta, "source"), one("Kapitel ", "chapter", True), one("Afsnit ", "section", True), one("Artikel ", "article", True), one("stk. ", "paragraph"), one("litra ", "litra"), one("Bilag ", "annex", True), one("punkt ", "annex_point"), one("Betragtning ", "recital"), one("Citation ", "citation"), one("Præambel ", "preamble"), one("side ", "page")]
    if mentions is not None:
        words.append(F.concat(F.lit("→ "), F.nullif(mentions, F.lit(""))))
    return F.when(F.coalesce(F.size(meta), F.lit(0)) > 0, F.array_join(F.array_compact(F.array(*words)), ", ")).otherwise(F.lit("Ukendt kilde"))


def index_text(text: Column, meta: Column) -> Column:
    """What is embedded of a passage: its search terms (a JSON list in the metadata), its context and its heading before the text.

    A point of an annex without a title takes its first line as one, if that is short.
    """
    heading, text = _get(meta, "heading_path_display"), F.coalesce(text, F.lit(""))
    first = F.nullif(F.trim(F.substring_index(text, "\n", 1)), F.lit(""))
    untitled = _get(meta, "annex_point").isNotNull() & _get(meta, "annex_point_title").isNull() & (F.length(first) < 100) & ~first.startswith("a)")
    named = F.when(untitled, F.coalesce(F.concat(heading, F.lit(" ("), first, F.lit(")")), first)).otherwise(heading)
    terms = F.from_json(_get(meta, "enrichment_terms"), "array<string>")
    words = F.when(F.size(terms) > 0, F.concat(F.lit("[Søgetermer: "), F.array_join(terms, " | "), F.lit("]")))
    context = F.concat(F.lit("[Kontekst: "), _get(meta, "contextual_description"), F.lit("]"))
    return F.array_join(F.array_compact(F.array(words, context, named, text)), "\n\n")
