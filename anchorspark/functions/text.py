"""Column functions over question and passage text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keyword lists of intents, the patterns of query intents, synthesis modes, normative wording,
# mentions and roles, the roles in their order, and what a role adds to a rank (ROLE_DELTA).
ENFORCEMENT = ["klage", "klager", "bøde", "bøder", "sanktion", "sanktioner", "håndhævelse", "håndhæv", "enforcement", "complaint", "penalt", "fine", "sanction", "remedy", "redress", "tilsyn", "myndighed", "myndigheder", "kompetent myndighed", "påbud", "anke", "appel", "klagevej", "erstatning", "kompensation"]
ENFORCEMENT_WORD = r"\bforbud\b"
REQUIREMENTS_STRONG = ["krav", "kræves", "kræver", "forventes", "dokumentation", "teknisk dokumentation", "requirements", "hvad skal vi", "skal vi", "hvordan", "must", "should", "controls", "forpligt", "forpligtelser", "ret til", "retten til", "indsigtsret", "hvordan overholder", "hvordan efterlever", "overholde", "efterleve", "implementer", "implementere", "indføre", "etablere"]
REQUIREMENTS_WEAK = ["foranstaltninger", "tekniske og organisatoriske", "procedure", "politik", "kontrol", "governance", "frister", "dokumentere", "logning", "rapportering"]
REQUIREMENTS_VERBS = ["krav", "kræver", "kræves", "skal", "must", "should", "hvordan", "overhold", "efterlev", "implement"]
CLASSIFICATION = ["klassific", "classification", "kategori", "annex", "bilag", "risikoklasse", "klassificeres", "forbudt", "prohibited", "højrisiko", "high-risk", "high risk"]
SCOPE = ["omfattet", "omfattes", "omfatter", "anvendelsesområde", "finder anvendelse", "falder ind under", "falder under", "falder det under", "ind under", "gælder for", "gælder forordningen", "scope", "applicability", "applies", "shall apply", "covered by", "subject to", "within the scope"]
QUERY_INTENT = [
    ("ENFORCEMENT", r"\b(penalt(y|ies)|fine(s)?|sanction(s)?|authority|myndighed|bøde(r)?)\b"),
    ("TRANSPARENCY", r"\b(inform|tell\s+user|ui|disclosure|transparency|gennemsigtighed|oplysn|information)\b"),
    ("OBLIGATIONS", r"\b(what\s+must|must\b|shall\b|required|requirements|krav|skal\b)\b"),
]
STRUCTURE_MARKERS = ["indholdsfortegnelse", "toc", "table of contents", "oversigt", "struktur", "hvilke kapitler", "hvilke artikler", "liste over", "oversigt over"]
SYNTHESIS = {
    "COMPARISON": [r"\bcompare\b.*\band\b", r"\bcomparing\b.*\band\b", r"\bvs\.?\b", r"\bversus\b", r"\bdifference(?:s)?\s+between\b", r"\bhow\s+does?\b.*\bcompare\b", r"\bforskellen?\s+mellem\b", r"\bsammenlign\b", r"\bsammenlignet\s+med\b"],
    "ROUTING": [r"\bwhich\s+law\b", r"\bwhat\s+law\s+(?:covers?|governs?|applies|regulates?)\b", r"\bwhich\s+(?:eu\s+)?regulation\b", r"\bwhat\s+legislation\b", r"\bidentify\s+(?:the\s+)?law\b", r"\bhvilken\s+lov\b", r"\bhvad\s+lov\b", r"\bhvilken\s+forordning\b"],
    "AGGREGATION": [r"\ball\s+(?:eu\s+)?laws?\b", r"\bevery\s+law\b", r"\bacross\s+(?:eu\s+)?laws?\b", r"\beach\s+law\b", r"\ball\s+(?:eu\s+)?regulations?\b", r"\bwhat\s+do\s+(?:eu\s+)?laws?\s+say\b", r"\balle\s+love\b", r"\bhver\s+lov\b", r"\bpå\s+tværs\s+af\s+love\b"],
}
NORMATIVE = r"(?i)\b(SKAL|B[ØO]R|M[ÅA]\s*IKKE|MAA\s+IKKE|KR[ÆA]VER|KRAEVER|FORPLIGTET|P[ÅA]KR[ÆA]VET|PLIGT|MUST|SHALL|SHOULD|REQUIRED|MAY\s*NOT)\b"
MENTIONS = {"chapter": r"(?:kapitel|chapter)\s+([ivxlcdm]+|\d+)", "section": r"(?:afsnit|afdeling|section)\s+([ivxlcdm]+|\d+)", "article": r"(?:artikel|article)\s*(\d{1,3}[a-z]?)", "paragraph": r"(?:stk\.|stykke|paragraph)\s*(\d{1,3})", "annex": r"(?:bilag|annex)\s+([ivxlcdm]+|\d+)"}
ROLE_RULES = [  # (role, weight, in heading?, pattern)
    ("definition_scope", 2, True, r"\b(definition|definitions|scope|subject\s+matter)\b"),
    ("prohibitions", 2, True, r"\b(prohibited|prohibition|forbidden)\b"),
    ("transparency", 2, True, r"\b(transparency|inform|information|disclosure)\b"),
    ("enforcement_supervision", 2, True, r"\b(authority|penalt(y|ies)|sanction(s)?|supervision|enforcement)\b"),
    ("exceptions_sandbox", 2, True, r"\b(sandbox)\b"),
    ("governance_process", 2, True, r"\b(risk\s+management|quality\s+management|conformity|monitoring|post-?market)\b"),
    ("obligations_normative", 1, False, r"\b(must|shall|required)\b"),
    ("obligations_normative", 1, False, r"\bskal\b"),
    ("transparency", 1, False, r"\b(inform|information|disclose|tell\s+user|notify)\b"),
    ("transparency", 1, False, r"\b(transparency|gennemsigtighed)\b"),
]
ROLES = ["definition_scope", "prohibitions", "obligations_normative", "transparency", "governance_process", "enforcement_supervision", "exceptions_sandbox", "recital_context"]
ROLE_DELTA = {("TRANSPARENCY", "transparency"): 0.18, ("TRANSPARENCY", "obligations_normative"): 0.10, ("TRANSPARENCY", "enforcement_supervision"): -0.08, ("TRANSPARENCY", "recital_context"): -0.12, ("OBLIGATIONS", "obligations_normative"): 0.15, ("OBLIGATIONS", "governance_process"): 0.10, ("ENFORCEMENT", "enforcement_supervision"): 0.18}
LEXICAL_TOKEN = "[0-9A-Za-zÆØÅæøå]+"


def whole_word(text: Column, pattern: str) -> Column:
    """Does the lower-cased text hold the pattern between non-word characters?"""
    return F.lower(text).rlike(rf"(^|[^\p{{L}}\p{{N}}_])({pattern})($|[^\p{{L}}\p{{N}}_])")


def search(text: Column, *patterns: str) -> Column:
    """Does the lower-cased text hold one of the patterns, with word bounds, white space and letters of any script?"""
    return F.lower(text).rlike("(?iUd)" + "|".join(f"(?:{p.removeprefix('(?i)')})" for p in patterns))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once."""
    return F.transform(F.array(value), use)[0]


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(text).contains(w) for w in words))


def matched(text: Column, words: list[str]) -> Column:
    """The words that the lower-cased text contains, sorted and distinct."""
    low = F.lower(text)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(low.contains(w), F.lit(w)) for w in words)))))


def first_of(cases: list[tuple[str, Column]], default: str) -> Column:
    out = F.lit(default)
    for name, test in reversed(cases):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def lexical_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LEXICAL_TOKEN), F.lit(0))


def term_counts(tokens: Column) -> Column:
    """(term, f) of each distinct token, counted within the row: the runs of the sorted tokens."""

    def runs(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))), lambda i: (i == F.size(s)) | (F.get(s, i - 1) != F.get(s, i)))
        return let(ends, lambda e: F.transform(e, lambda i, n: F.struct(F.get(s, i - 1).alias("term"), (i - F.when(n == 0, 0).otherwise(F.get(e, n - 1))).alias("f"))))

    return let(F.sort_array(tokens), runs)


def query_intent(text: Column) -> Column:
    return first_of([(n, search(text, p)) for n, p in QUERY_INTENT], "CONTEXT")


def claim_intent(text: Column, names_law: Column | None = None) -> Column:
    """names_law: does the question name a known law?  Then "gælder" asks for its scope."""
    named = F.lit(False) if names_law is None else F.coalesce(names_law, F.lit(False))

    def of(low: Column) -> Column:
        has = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
        requirements = has(REQUIREMENTS_STRONG) | (has(REQUIREMENTS_WEAK) & has(REQUIREMENTS_VERBS))
        return first_of([("ENFORCEMENT", has(ENFORCEMENT) | search(low, ENFORCEMENT_WORD)), ("REQUIREMENTS", requirements), ("CLASSIFICATION", has(CLASSIFICATION)), ("SCOPE", has(SCOPE) | (low.contains("gælder") & named))], "GENERAL")

    return let(F.lower(text), of)


def intent_cues(text: Column) -> Column:
    """(enforcement, enforcement_cues, requirements, requirements_cues): the words that speak for these intents, sorted and distinct."""
    enforcement = F.array_sort(F.array_union(matched(text, ENFORCEMENT), F.array_compact(F.array(F.when(search(text, ENFORCEMENT_WORD), F.lit("forbud"))))))
    strong, weak, verbs = (matched(text, words) for words in (REQUIREMENTS_STRONG, REQUIREMENTS_WEAK, REQUIREMENTS_VERBS))
    asked = (F.size(strong) > 0) | ((F.size(weak) > 0) & (F.size(verbs) > 0))
    return F.struct((F.size(enforcement) > 0).alias("enforcement"), enforcement.alias("enforcement_cues"), asked.alias("requirements"), F.array_sort(F.array_union(F.array_union(strong, weak), verbs)).alias("requirements_cues"))


def synthesis_mode(text: Column) -> Column:
    return first_of([(n, search(text, *patterns)) for n, patterns in SYNTHESIS.items()], "UNIFIED")


def is_normative(text: Column) -> Column:
    return F.coalesce(search(text, NORMATIVE), F.lit(False))


def mentions(text: Column, own: dict[str, Column] | None = None, most: int = 25) -> Column:
    """A map of kind to the references that a text mentions, in order, without those of its own place."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    pairs = []
    for kind, pattern in MENTIONS.items():
        found = F.array_distinct(F.transform(F.regexp_extract_all(flat, F.lit(rf"(?i)\b{pattern}\b"), F.lit(1)), F.upper))
        if own and kind in own:
            found = F.when(own[kind].isNull(), found).otherwise(F.array_remove(found, F.upper(own[kind])))
        pairs.append(F.struct(F.lit(kind).alias("key"), F.slice(found, 1, most).alias("value")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: F.size(p["value"]) > 0))


def role_scores(heading: Column, body: Column) -> Column:
    """An array of (role, score) in declaration order."""
    out = []
    for role in ROLES:
        score = sum((F.when(F.coalesce(search(heading if in_head else body, p), F.lit(False)), F.lit(float(w))).otherwise(F.lit(0.0)) for r, w, in_head, p in ROLE_RULES if r == role), F.lit(0.0))
        out.append(F.struct(score.alias("score"), F.lit(-ROLES.index(role)).alias("order"), F.lit(role).alias("role")))
    return F.array(*out)


def classify_role(heading: Column, body: Column, recital: Column | None = None) -> Column:
    """(role, confidence): the highest score, the first declared on ties; structural recitals come first."""
    scores = role_scores(heading, body)
    best = F.array_max(scores)
    ties = F.size(F.filter(scores, lambda s: s["score"] == best["score"]))
    sure = F.when(best["score"] <= 0, 0.20).when(best["score"] >= 2, F.when(ties == 1, 0.75).otherwise(0.65)).otherwise(F.when(ties == 1, 0.55).otherwise(0.45))
    role = F.when(best["score"] <= 0, F.lit("obligations_normative")).otherwise(best["role"])
    if recital is not None:
        role, sure = F.when(recital, F.lit("recital_context")).otherwise(role), F.when(recital, 0.95).otherwise(sure)
    return F.struct(role.alias("role"), sure.cast("double").alias("confidence"))


def role_delta(role: Column, confidence: Column, intent: Column, profile: str = "") -> Column:
    delta = F.lit(0.0)
    for (i, r), d in ROLE_DELTA.items():
        delta = delta + F.when((intent == i) & (role == r), d).otherwise(0.0)
    if profile.upper() == "ENGINEERING":
        delta = delta - F.when(role == "recital_context", 0.20).otherwise(0.0) - F.when((role == "enforcement_supervision") & (intent != "ENFORCEMENT"), 0.10).otherwise(0.0)
    elif profile.upper() == "LEGAL":
        delta = delta - F.when(role == "recital_context", 0.05).otherwise(0.0)
    return delta * F.greatest(F.lit(0.20), F.least(F.lit(1.0), confidence))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+", " "))


def text_hash(text: Column) -> Column:
    return F.sha2(collapsed(text), 256)


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"[^a-z0-9 _-]", ""), r"[ _-]+", "-")


def chunk_id(doc: Column, location: Column, index: Column, digest: Column) -> Column:
    return F.concat(F.lit("chunk:v1/"), F.concat_ws("/", slug(doc), slug(location), index.cast("string"), F.substring(digest, 1, 12)))


def location_id(**parts: Column) -> Column:
    """loc:v1/chapter:iii/article:6 from the parts that are set, in the fixed order of kinds."""
    order = ["preamble", "citation", "recital", "annex", "chapter", "section", "article", "paragraph", "litra"]
    return F.concat_ws("/", F.lit("loc:v1"), *(F.when(F.length(F.trim(parts[k])) > 0, F.concat(F.lit(f"{k}:"), F.lower(F.trim(parts[k])))) for k in order if k in parts))


def location_parts(location: Column) -> Column:
    """A map of kind to value of a location id."""
    parts = F.filter(F.split(location, "/"), lambda x: x.contains(":") & ~x.startswith("loc:"))
    return F.map_from_entries(F.transform(parts, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.substring_index(x, ":", -1).alias("v"))))


def normalize_corpus(name: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(F.trim(name)), r"\s+", " "), F.lit("-"), F.lit("_"))


def roman_value(text: Column) -> Column:
    """The number that a roman numeral stands for."""
    value = F.transform(F.split(F.upper(text), ""), lambda c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv)), c), F.lit(0)))
    return F.aggregate(F.reverse(value), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top")), lambda a, v: F.struct((a["sum"] + F.when(v < a["top"], -v).otherwise(v)).alias("sum"), F.greatest(a["top"], v).alias("top")), lambda a: a["sum"])


def redact(text: Column) -> Column:
    """E-mail addresses and runs of at least eight digits, which may hold blanks, brackets or dashes."""
    mail = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    return F.regexp_replace(mail, r"\+?\d(?:[ ()-]*\d){7,}", "[PHONE]")


def bracket_citations(text: Column) -> Column:
    """The distinct numbers of [n] marks, sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(\d{1,3})\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def celex(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d{5}[A-Z]\d{1,5})", 1)


def anchors(meta: Column, with_point: bool = True) -> Column:
    """article:6, recital:3, annex:iii, annex:iii:5 from a map of a passage's place."""
    low = lambda k: F.lower(F.trim(F.try_element_at(meta, F.lit(k))))
    parts = [F.concat(F.lit(f"{k}:"), low(k)) for k in ("article", "recital", "annex")]
    if with_point:
        parts += [F.concat(F.lit("annex:"), low("annex"), F.lit(":"), low("annex_point")), F.concat(F.lit("annex:"), low("annex"), F.lit(":section:"), low("annex_section"))]
    return F.array_distinct(F.array_compact(F.array(*parts)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; zero where sizes differ or a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def gaussian(distance: Column) -> Column:
    d = F.greatest(distance, F.lit(0.0))
    return F.exp(-d * d / 2)


# Fixed value: short words that stand alone in titles.
TITLE_WORDS = {"den", "det", "de", "en", "et", "til", "og", "eller", "med", "ved", "fra", "for", "af", "på", "som", "der", "ikke", "hvis", "men", "kan", "skal", "må", "har", "have"}


def _glued(title: str | None) -> str | None:
    """A title with four or more spaced letters closed up, and words that extraction broke in two put together."""
    words: list[str] = []
    broken = False  # whether the last word may still take its other half
    for single, run in groupby((title or "").split(), key=lambda w: len(w) == 1 and w.isalpha()):
        apart = list(run)
        if single and len(apart) >= 4:
            words.append("".join(apart))
            broken = False
            continue
        for word in apart:
            alone = len(word) >= 3 and word.lower() in TITLE_WORDS
            if broken and word.isalpha() and word[0].islower() and not alone:
                words[-1] += word
                broken = False
            else:
                words.append(word)
                broken = word.isalpha() and len(word) <= 10 and not alone
    return " ".join(words) or None


def _ascii_slug(text: str | None, most: int = 30) -> str:
    """Lower-case ASCII words joined by dashes, as many as fit; a first word that is too long is cut."""
    plain = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
    out = ""
    for word in re.findall(r"[a-z0-9]+", plain):
        if len(out) + len(word) + bool(out) > most:
            break
        out += ("-" if out else "") + word
    return out or re.sub(r"[^a-z0-9]+", "", plain)[:most]


def repair_title(title: Column) -> Column:
    """_glued for a column, in Arrow batches: each join depends on the one before."""
    return F.pandas_udf(lambda s: s.map(_glued, na_action="ignore"), "string")(title)


def ascii_slug(text: Column) -> Column:
    """_ascii_slug for a column, in Arrow batches: there is no built-in decomposition of letters."""
    return F.pandas_udf(lambda s: s.map(_ascii_slug), "string")(text)


def question_kind(text: Column) -> Column:
    """(multi_part, recital_quote, substantive, chapter_overview) of a question."""
    low = F.lower(F.coalesce(text, F.lit("")))
    parts = F.regexp_count(low, F.lit(r"(?m)^[ \t]*\d+[ \t]*[).][ \t]+")) >= 2
    quote = contains_any(low, ["betragtning", "recital"]) & contains_any(low, ["hvad siger", "hvad står der", "ordlyd", "citer"])
    meant = contains_any(low, ["hvad", "forklar", "beskriv", "handler", "betyder", "krav", "forbud", "formål", "definition", "hvordan", "hvem"])
    chapter = low.rlike(r"k\s*a\s*p\s*i\s*t\s*e\s*l\s*([0-9]+|[ivxlcdm]+)") & contains_any(low, ["handler", "omhandler", "opsummer", "sammenfat", "overblik"])
    return F.struct(parts.alias("multi_part"), quote.alias("recital_quote"), meant.alias("substantive"), chapter.alias("chapter_overview"))


def iso_date(text: Column, first_year: int = 1900, last_year: int = 2100) -> Column:
    """The day, as written, of an ISO date or of a time with or without a zone; null for anything else and outside the years."""
    clean = F.trim(text)
    day = F.to_date(F.try_to_timestamp(F.regexp_extract(clean, r"^\d{4}-\d{2}-\d{2}", 0), F.lit("yyyy-MM-dd")))
    return F.when(F.year(day).between(first_year, last_year), day)
