"""Column functions over references that a text names, and over metadata maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Reference patterns (letters may be spaced), and the metadata fields kept in one case.
CHAPTER = r"k\s*a\s*p\s*i\s*t\s*e\s*l\s*([0-9]+|[ivxlcdm]+)"
SECTION = r"(?:a\s*f\s*s\s*n\s*i\s*t|a\s*f\s*d\s*e\s*l\s*i\s*n\s*g)\s*([0-9]+|[ivxlcdm]+)"
SPACED_ARTICLE = r"a\s*r\s*t\s*i\s*k\s*e\s*l\s*(\d{1,3}[a-z]?)"
ANNEX = r"(?:bilag|annex)\s+([ivxlcdm]+|\d{1,3})"
RECITAL = r"(?:betragtning|recital)\s*\(?\s*(\d{1,4})"
RECITAL_MENTION = r"(?:betragtning(?:er)?|recital)\s+(\d{1,4})"
ARTICLE_MENTION = r"(?:artikel|article|art\.?)\s+(\d{1,3}[a-z]?)(?![\p{L}\p{N}_])(?:\s*(?:\(|,)?\s*(?:stk\.?|stykke|paragraph)?\s*(\d{1,3})\s*\)?)?"
UPPER_FIELDS = ["article", "annex", "recital", "chapter", "section", "paragraph", "annex_point", "annex_section"]
LOWER_FIELDS = ["corpus_id", "law_id"]
CELEX = r"^(\d)(\d{4})([A-Z])(\d+)$"
CELEX_IN_URL = r"(?i)CELEX(?::|%3A)(\d{5}[A-Z]\d{4})"
CELEX_TYPES = {"R": ("reg", "Regulation"), "L": ("dir", "Directive"), "D": ("dec", "Decision"), "Q": ("q", "Recommendation"), "H": ("h", "Resolution")}
OFFICIAL_HOSTS = ["eur-lex.europa.eu", "publications.europa.eu"]
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _each(text: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(_low(text), F.lit(pattern), F.lit(group)), F.upper)


def _first(text: Column, pattern: str) -> Column:
    found = F.upper(F.regexp_extract(_low(text), pattern, 1))
    return F.when(found != "", found)


def article_refs(text: Column) -> Column:
    """Articles that a question names, each once, in order; the word's letters may be spaced."""
    return F.array_distinct(_each(text, SPACED_ARTICLE))


def annex_refs(text: Column) -> Column:
    return F.array_distinct(_each(text, _BEFORE + ANNEX + _AFTER))


def recital_ref(text: Column) -> Column:
    return _first(text, _BEFORE + RECITAL + r"\s*\)?" + _AFTER)


def chapter_ref(text: Column) -> Column:
    return _first(text, CHAPTER)


def section_ref(text: Column) -> Column:
    return _first(text, SECTION)


def is_multi_part(text: Column) -> Column:
    """Two numbered lines or more: 1) or 1. at their start."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.size(F.filter(lines, lambda x: x.rlike(r"^\s*\d+\s*[).]\s+"))) >= 2


def anchor_mentions(answer: Column) -> Column:
    """What an answer names, in order: array of (kind, value, paragraph or null); articles, then recitals, then annexes."""
    articles = F.regexp_extract_all(_low(answer), F.lit(_BEFORE + ARTICLE_MENTION), F.lit(0))
    one = lambda x, g: F.regexp_extract(x, ARTICLE_MENTION, g)
    none = F.lit(None).cast("string")
    row = lambda kind, value, par: F.struct(F.lit(kind).alias("kind"), F.upper(value).alias("value"), par.alias("paragraph"))
    return F.concat(
        F.transform(articles, lambda x: row("article", one(x, 1), F.when(one(x, 2) != "", one(x, 2)))),
        F.transform(_each(answer, _BEFORE + RECITAL_MENTION + _AFTER), lambda x: row("recital", x, none)),
        F.transform(_each(answer, _BEFORE + ANNEX + _AFTER), lambda x: row("annex", x, none)),
    )


def normalise_metadata(meta: Column) -> Column:
    """Structural fields trimmed and upper-case, corpus ids lower-case; other fields as they are."""
    fields = lambda k, names: k.isin(*names)
    return F.transform_values(meta, lambda k, v: F.when(fields(k, UPPER_FIELDS), F.upper(F.trim(v))).when(fields(k, LOWER_FIELDS), F.lower(F.trim(v))).otherwise(v))


def meta_value(meta: Column, key: str, default: str = "") -> Column:
    """A field in its one case, trimmed; the default where it's missing or blank."""
    raw = F.trim(F.try_element_at(meta, F.lit(key)))
    cased = F.upper(raw) if key in UPPER_FIELDS else F.lower(raw) if key in LOWER_FIELDS else raw
    return F.when(F.length(raw) > 0, cased).otherwise(F.lit(default))


def anchor_key(meta: Column) -> Column:
    """article:6, else annex:iii or annex:iii:5, else recital:7; lower-case, null without a place."""
    v = lambda k: F.trim(F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit("")))
    annex = F.concat(F.lit("annex:"), v("annex"), F.when(v("annex_point") != "", F.concat(F.lit(":"), v("annex_point"))).otherwise(F.lit("")))
    return F.lower(F.when(v("article") != "", F.concat(F.lit("article:"), v("article"))).when(v("annex") != "", annex).when(v("recital") != "", F.concat(F.lit("recital:"), v("recital"))))


def reference_corpus(corpus_id: Column, source: Column) -> Column:
    return F.coalesce(F.nullif(corpus_id, F.lit("")), F.nullif(source, F.lit("")), F.lit("unknown"))


def history_prompt(turns: Column, most: int = 4000) -> Column:
    """Talk so far as a prompt's section, from an array of (role, text); empty without turns."""
    label = lambda r: F.when(r == "user", "Bruger:").otherwise("Assistent:")
    short = lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)
    lines = F.transform(turns, lambda x: F.concat(label(x["role"]), F.lit(" "), short(x["text"])))
    return F.when(F.size(turns) > 0, F.concat(F.lit("TIDLIGERE SAMTALE:\n"), F.array_join(lines, "\n"), F.lit("\n---\n"))).otherwise(F.lit(""))


def needs_context(original: Column, rewritten: Column, short: int = 40) -> Column:
    """Does a follow-up question need the talk before it: it came back unchanged, or is short?"""
    return original.isNotNull() & ((original == rewritten) | (F.length(rewritten) < short))




def celex_parts(number: Column) -> Column:
    """sector, year, type_char, number, type_code and kind of an act's number; null if it isn't one."""
    clean = F.upper(F.trim(number))
    part = lambda g: F.regexp_extract(clean, CELEX, g)
    known = F.create_map(*(F.lit(x) for k, (code, _) in CELEX_TYPES.items() for x in (k, code)))
    kinds = F.create_map(*(F.lit(x) for k, (_, kind) in CELEX_TYPES.items() for x in (k, kind)))
    parts = F.struct(part(1).cast("int").alias("sector"), part(2).cast("int").alias("year"), part(3).alias("type_char"), part(4).cast("int").alias("number"), F.coalesce(F.try_element_at(known, part(3)), F.lower(part(3))).alias("type_code"), F.coalesce(F.try_element_at(kinds, part(3)), F.lit("Unknown")).alias("kind"))
    return F.when(clean.rlike(CELEX), parts)


def corpus_id(name: Column, celex: Column, special: Column | None = None) -> Column:
    """nis2-dir-2022-2555 from a known name and an act's number; special: implementing or delegated, or null."""
    parts = celex_parts(celex)
    code = parts["type_code"] if special is None else F.when(special == "implementing", "cir").when(special == "delegated", "dr").otherwise(parts["type_code"])
    plain = F.regexp_replace(F.replace(F.lower(name), F.lit(" "), F.lit("-")), "[^a-z0-9-]", "")
    return F.concat(plain, F.lit("-"), code, F.lit("-"), parts["year"].cast("string"), F.lit("-"), parts["number"].cast("string"))


def celex_of_url(url: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(url, CELEX_IN_URL, 1), F.lit("")))


def is_official_url(url: Column) -> Column:
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isin(*OFFICIAL_HOSTS), F.lit(False))


def official_url(celex: Column, language: str = "DA") -> Column:
    clean = F.upper(F.trim(celex))
    return F.when(clean.rlike(CELEX), F.concat(F.lit(f"https://eur-lex.europa.eu/legal-content/{language}/TXT/HTML/?uri=CELEX:"), clean))
