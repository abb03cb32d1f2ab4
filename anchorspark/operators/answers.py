"""Structured answers: checks, policy, rendering, and edits of answer lines; all of it column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# The sections of an engineering answer and the fields of their items, in the order they are shown.
SECTIONS = {"obligations": ("title", "text"), "system_requirements": ("level", "text"), "open_questions": ("question", "why"), "audit_evidence_bullets": ("text",), "requirements_bullets": ("text",)}
REQUIRED = ("obligations", "system_requirements", "open_questions")
STATUSES, LEVELS = ("JA", "NEJ", "AFHÆNGER_AF"), ("SKAL", "BØR", "INFO")
HEADINGS = ("1. Klassifikation og betingelser", "2. Relevante juridiske forpligtelser", "3. Konkrete systemkrav", "4. Åbne spørgsmål / risici")
AUDIT_HEADING = "Minimum ved tilsyn (evidens/artefakter)"
MODALS = (("must|shall", "SKAL"), ("should", "BØR"), ("may", "KAN"), ("cannot|can't", "KAN IKKE"), ("can", "KAN"))
TOKENS = (("YES", "JA"), ("NO", "NEJ"), ("Yes", "Ja"), ("No", "Nej"))
IMPERATIVES = {"implement": "implementeres", "provide": "stilles til rådighed", "allow": "gives mulighed for", "maintain": "opretholdes", "use": "anvendes", "include": "inkluderes", "establish": "etableres", "document": "dokumenteres", "record": "registreres", "report": "rapporteres", "verify": "verificeres"}
REFERENCE_HEADING = r"(?ims)^\s*(?:referencer|references|kilder)\s*:?\s*$.*"


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _items(answer: Column, section: str) -> Column:
    return F.coalesce(_get(answer, f"$.{section}", "array<variant>"), F.array().cast("array<variant>"))


def _numbers(item: Column) -> Column:
    return F.coalesce(_get(item, "$.citations", "array<int>"), F.array().cast("array<int>"))


def _shape(item: Column, *kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(item).isin(*kinds), F.lit(False))


def _object(fields: tuple[str, ...]) -> list[str]:
    """How the type of an item with exactly these texts and a list of numbers, full or empty, reads."""
    return ["OBJECT<" + ", ".join(f"{f}: {'ARRAY<' + n + '>' if f == 'citations' else 'STRING'}" for f in sorted((*fields, "citations"))) + ">" for n in ("BIGINT", "VOID")]


def _codes(pairs: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in pairs)))


def _bare(section: str):
    """Whether an item of a section is normative and cites nothing."""

    def test(x):
        normative = T.is_normative(F.concat_ws(" ", *(_get(x, f"$.{f}", "string") for f in SECTIONS[section])))
        if section == "system_requirements":
            normative = normative | _get(x, "$.level", "string").isin("SKAL", "BØR")
        return F.coalesce(normative, F.lit(False)) & (F.size(_numbers(x)) == 0)

    return test


def engineering_problems(answer: Column, need_citations: bool = True) -> Column:
    """What a JSON text breaks of the answer schema, as codes with paths: unknown, absent or mistyped fields, unknown
    status or level, numbers below one, and normative items without a citation (left out for the pass that only mends them).
    Text that isn't a JSON object gives not_json alone."""
    v = F.try_parse_json(answer)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    keys = F.coalesce(F.json_object_keys(answer), F.array().cast("array<string>"))
    known = F.array(*(F.lit(k) for k in ("classification", *SECTIONS)))
    c = _get(v, "$.classification", "variant")
    pairs = [("unknown_fields:$", F.size(F.array_except(keys, known)) > 0), ("missing_fields:$", F.size(F.array_except(F.array(*(F.lit(k) for k in ("classification", *REQUIRED))), keys)) > 0)]
    pairs += [("shape:$.classification", F.array_contains(keys, "classification") & ~_shape(c, *_object(("status", "text")))), ("status:$.classification", ~_get(c, "$.status", "string").isin(*STATUSES)), ("citations:$.classification", F.exists(_numbers(c), lambda n: n <= 0))]
    if need_citations:
        pairs.append(("no_citation:$.classification", F.size(_numbers(c)) == 0))
    for name, fields in SECTIONS.items():
        items, kinds = _items(v, name), _object(fields)
        pairs += [(f"shape:$.{name}", F.array_contains(keys, name) & (_get(v, f"$.{name}", "array<variant>").isNull() | F.exists(items, lambda x: ~_shape(x, *kinds)))), (f"citations:$.{name}", F.exists(items, lambda x: F.exists(_numbers(x), lambda n: n <= 0)))]
        if name == "system_requirements":
            pairs.append((f"level:$.{name}", F.exists(items, lambda x: ~F.coalesce(_get(x, "$.level", "string").isin(*LEVELS), F.lit(False)))))
        if need_citations and name in REQUIRED:
            pairs.append((f"no_citation:$.{name}", F.exists(items, _bare(name))))
    return F.when(is_object, _codes(pairs)).otherwise(F.array(F.lit("not_json")))


def legal_problems(answer: Column) -> Column:
    """What a JSON text breaks of the legal answer's schema: a summary, and lists of points, bases and caveats if present."""
    v = F.try_parse_json(answer)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    keys = F.coalesce(F.json_object_keys(answer), F.array().cast("array<string>"))
    has = lambda k: F.array_contains(keys, k)
    kind = lambda k: F.schema_of_variant(_get(v, f"$.{k}", "variant"))
    pairs = [("unknown_fields:$", F.size(F.array_except(keys, F.array(*map(F.lit, ("summary", "key_points", "legal_basis", "caveats"))))) > 0), ("shape:$.summary", ~F.coalesce(kind("summary") == "STRING", F.lit(False)))]
    points = _items(v, "key_points")
    pairs += [("shape:$.key_points", has("key_points") & (_get(v, "$.key_points", "array<variant>").isNull() | F.exists(points, lambda x: ~_shape(x, "OBJECT<point: STRING>", *_object(("point",)))))), ("citations:$.key_points", F.exists(points, lambda x: F.exists(_numbers(x), lambda n: n <= 0)))]
    pairs += [(f"shape:$.{k}", has(k) & ~F.coalesce(kind(k).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))) for k in ("legal_basis", "caveats")]
    return F.when(is_object, _codes(pairs)).otherwise(F.array(F.lit("not_json")))


def cited_numbers(answer: Column) -> Column:
    """Every number that a structured answer cites, and those in brackets in a summary; distinct and sorted."""
    v = F.try_parse_json(answer)
    lists = [_numbers(_get(v, "$.classification", "variant"))] + [F.flatten(F.transform(_items(v, s), _numbers)) for s in (*SECTIONS, "key_points")]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*lists, T.bracket_citations(_get(v, "$.summary", "string"))), lambda n: n.isNotNull())))


def policy_problems(answer: Column, allowed: Column, intent: Column, least: int | None = None, audit: bool = False) -> Column:
    """What an engineering answer breaks of its policy: every requirement and audit item cites, and only allowed numbers;
    enough requirements where the intent is REQUIREMENTS, three audit items where they are asked for."""
    v = F.try_parse_json(answer)
    own = _get(v, "$.system_requirements", "array<variant>")
    parts = {"system_requirements": F.coalesce(own, _items(v, "requirements_bullets")), "audit_evidence_bullets": _items(v, "audit_evidence_bullets")}
    pairs = []
    for name, items in parts.items():
        pairs += [(f"missing_citations:$.{name}", F.exists(items, lambda x: F.size(_numbers(x)) == 0)), (f"citations_not_allowed:$.{name}", F.exists(items, lambda x: F.size(F.array_except(_numbers(x), allowed)) > 0))]
    if least is not None:
        pairs.append(("min_requirements_bullets_not_met", (F.upper(intent) == "REQUIREMENTS") & (F.size(parts["system_requirements"]) < least)))
    if audit:
        pairs.append(("min_audit_evidence_bullets_not_met", F.size(parts["audit_evidence_bullets"]) < 3))
    return _codes(pairs)


def marks(numbers: Column) -> Column:
    """" [1] [4]" for numbers, each once and sorted; nothing for none."""
    return F.concat_ws("", F.transform(F.array_sort(F.array_distinct(numbers)), lambda n: F.concat(F.lit(" ["), n.cast("string"), F.lit("]"))))


def _bullets(items: Column, line) -> Column:
    return F.transform(items, lambda x: F.rtrim(F.concat(F.lit("- "), line(x), marks(_numbers(x)))))


def _text(x: Column, field: str) -> Column:
    return F.trim(F.coalesce(_get(x, f"$.{field}", "string"), F.lit("")))


def _joined(*parts: Column) -> Column:
    return F.concat(F.trim(F.array_join(F.concat(*parts), "\n")), F.lit("\n"))


def render_engineering(answer: Column) -> Column:
    """The text of an engineering answer: four headed sections of bullets, with the audit items under the third."""
    v = F.try_parse_json(answer)
    lines = lambda *s: F.array(*map(F.lit, s))
    none = F.array().cast("array<string>")
    c, own, audit = _get(v, "$.classification", "variant"), _items(v, "system_requirements"), _items(v, "audit_evidence_bullets")
    wanted = F.when(F.size(own) > 0, own).otherwise(_items(v, "requirements_bullets"))
    level = lambda x: F.when(_get(x, "$.level", "string").isNotNull(), F.concat(_text(x, "level"), F.lit(": "))).otherwise("")
    why = lambda x: F.when(_text(x, "why") != "", F.concat(F.lit(" — "), _text(x, "why"))).otherwise("")
    return _joined(
        lines(HEADINGS[0]), F.array(F.rtrim(F.concat(F.lit("- "), _text(c, "status"), F.lit(": "), _text(c, "text"), marks(_numbers(c))))),
        lines("", HEADINGS[1]), _bullets(_items(v, "obligations"), lambda x: F.concat(_text(x, "title"), F.lit(": "), _text(x, "text"))),
        lines("", HEADINGS[2]), _bullets(wanted, lambda x: F.concat(level(x), _text(x, "text"))),
        F.when(F.size(audit) > 0, F.concat(lines("", AUDIT_HEADING), _bullets(audit, lambda x: _text(x, "text")))).otherwise(none),
        lines("", HEADINGS[3]), _bullets(_items(v, "open_questions"), lambda x: F.concat(_text(x, "question"), why(x))),
    )


def render_legal(answer: Column) -> Column:
    """The text of a legal answer: basis, analysis, points and caveats; a bare summary stays bare."""
    v = F.try_parse_json(answer)
    none, strings = F.array().cast("array<string>"), lambda k: F.coalesce(_get(v, f"$.{k}", "array<string>"), F.array().cast("array<string>"))
    basis, caveats, points = strings("legal_basis"), strings("caveats"), _items(v, "key_points")
    plain = lambda a: F.transform(F.filter(a, lambda s: F.trim(s) != ""), lambda s: F.concat(F.lit("- "), F.trim(s)))
    part = lambda test, *rows: F.when(test, F.concat(*rows)).otherwise(none)
    line = lambda *s: F.array(*map(F.lit, s))
    return _joined(
        part(F.size(basis) > 0, line("**Retsgrundlag**"), plain(basis), line("")),
        part((F.size(basis) > 0) | (F.size(points) > 0) | (F.size(caveats) > 0), line("**Juridisk analyse**")),
        F.array(_text(v, "summary")),
        part(F.size(points) > 0, line("", "**Hovedpunkter**"), _bullets(F.filter(points, lambda x: _text(x, "point") != ""), lambda x: _text(x, "point"))),
        part(F.size(caveats) > 0, line("", "**Forbehold**"), plain(caveats)),
    )


def without_references(answer: Column) -> Column:
    """An answer without the list of references that ends it."""
    return F.rtrim(F.regexp_replace(F.coalesce(answer, F.lit("")), REFERENCE_HEADING, ""))


def danish_modals(answer: Column) -> Column:
    """Modal verbs, yes and no at the start of a line, and imperative first words in Danish; marks like [1] stay."""
    out = answer
    for pattern, word in MODALS:
        out = F.regexp_replace(out, rf"(?iU)\b(?:{pattern})\b", word)
    for token, word in TOKENS:
        out = F.regexp_replace(out, rf"(?m)^(\s*(?:[-*]\s*)?){token}\b", f"$1{word}")
    head = r"(?im)^(\s*(?:[-*]\s+|\d+\.\s+)?)"
    for verb, passive in IMPERATIVES.items():
        out = F.regexp_replace(out, rf"{head}{verb}\b[ \t]*", f"$1Der SKAL {passive} ")
    out = F.regexp_replace(out, rf"{head}ensure\s+(?:that|at)\b[ \t]*", "$1Der SKAL sikres, at ")
    return F.regexp_replace(out, rf"{head}ensure\b[ \t]*", "$1Der SKAL sikres ")


def abstain_wording(answer: Column) -> Column:
    """One opening for answers that decline; others stay as they are."""
    opening = r"(?isU)^\s*(?:jeg\s+kan(?:\s+\w+){0,3}\s+ikke|det\s+kan\s+jeg(?:\s+\w+){0,3}\s+ikke)(.*?)\s*$"
    return F.when(answer.contains("Jeg kan ikke") | ~answer.rlike(opening), answer).otherwise(F.regexp_replace(answer, opening, "Jeg kan ikke$1"))


def _at(lines: Column, test) -> Column:
    """The number, from 0, of the first line that passes; null if none does."""
    return F.array_min(F.transform(lines, lambda line, i: F.when(test(line, i), i)))


def force_citations(answer: Column, required: Column) -> Column:
    """Required numbers that an answer leaves out, put at the end of its first bullet: of section 2, else of any."""
    missing = F.array_except(required, T.bracket_citations(without_references(answer)))
    lines = F.split(answer, "\n")
    second = _at(lines, lambda s, i: F.trim(s).startswith("2."))
    third = F.coalesce(_at(lines, lambda s, i: F.trim(s).startswith("3.") & (i > second)), F.size(lines))
    bullet = lambda s: F.ltrim(s).startswith("-")
    target = F.coalesce(_at(lines, lambda s, i: bullet(s) & (i > second) & (i < third)), _at(lines, lambda s, i: bullet(s)))
    edited = F.array_join(F.transform(lines, lambda s, i: F.when(i == target, F.concat(F.rtrim(s), marks(missing))).otherwise(s)), "\n")
    return F.when((F.size(missing) > 0) & target.isNotNull(), edited).otherwise(answer)


def relevant_basis(answer: Column, labels: Column) -> Column:
    """For an answer without a citation, neutral bullets of up to two (number, label) references under section 2."""
    bullets = F.transform(F.slice(labels, 1, 2), lambda r: F.concat(F.lit("- Relevant hjemmel: "), r["label"], F.lit(" ["), r["number"].cast("string"), F.lit("]")))
    lines = F.split(answer, "\n")
    start = _at(lines, lambda s, i: F.lower(F.trim(s)) == HEADINGS[1].lower())
    inside = F.array_join(F.concat(F.slice(lines, 1, start + 1), bullets, F.slice(lines, start + 2, F.greatest(F.size(lines) - start - 1, F.lit(0)))), "\n")
    after = F.concat(F.rtrim(answer), F.lit(f"\n\n{HEADINGS[1]}\n"), F.array_join(bullets, "\n"))
    return F.when((F.trim(answer) == "") | answer.rlike(r"\[\d{1,3}\]") | (F.size(labels) == 0), answer).otherwise(F.when(start.isNull(), after).otherwise(inside))


def integrity(answer: Column, known: Column, structured: Column | None = None, least: int = 1) -> Column:
    """(answer, cited, unknown, reason): numbers cited in the text, else by the structured answer; MISSING_REF in place of
    an answer that cites nothing, cites numbers that no reference has, or cites too few."""
    from_text = T.bracket_citations(without_references(answer))
    cited = from_text if structured is None else F.when(F.size(from_text) > 0, from_text).otherwise(F.coalesce(structured, F.array().cast("array<int>")))
    unknown, valid = F.array_sort(F.array_except(cited, known)), F.array_intersect(cited, known)
    reason = F.when(F.size(cited) == 0, "no_citations").when(F.size(unknown) > 0, "unknown_citation").when(F.size(valid) < least, "too_few_citations")
    return F.struct(F.when(reason.isNull(), answer).otherwise("MISSING_REF").alias("answer"), F.array_sort(valid).alias("cited"), unknown.alias("unknown"), reason.alias("reason"))


def evidence_gate(answer: Column, n_citable: Column, least: int = 2) -> Column:
    """MISSING_REF stays; too little citable evidence is told apart; other answers pass."""
    return F.when(F.ltrim(answer).startswith("MISSING_REF"), "missing_ref").when(n_citable < least, "insufficient_evidence").otherwise("answer")


def wants_retry(cited: Column, allowed: Column, least: int) -> Column:
    """Too few valid citations, where enough references are there to cite."""
    return (F.size(F.array_intersect(cited, allowed)) < least) & (F.size(allowed) >= least)
