"""The citation chain against a plain version, over answers put together at random."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from anchorspark.operators import citation_chain as C

NUMBER, LIST = re.compile(r"\[(\d{1,3})\]"), "\nReferencer:\n"
FIELDS = ("idx", "chunk_id", "corpus_id", "article", "paragraph", "recital", "annex", "label", "words")


def body(t):
    return t.split(LIST, 1)[0].rstrip() if LIST in t else t


def cited(t):
    return list(dict.fromkeys(int(n) for n in NUMBER.findall(body(t))))


def has(r, k):
    return (r[k] or "").strip()


def tidy(r, k):
    return r[k] if k in ("idx", "label") else (r[k] or "").lower() if k == "words" else has(r, k) or None


def mentions(t):
    out = [("article", m[1].upper(), m[2]) for m in re.finditer(r"(?i)\b(?:artikel|article|art\.?)\s+(\d{1,3}[a-z]?)\b(?:\s*(?:\(|,)?\s*(?:stk\.?|stykke|paragraph)?\s*(\d{1,3})\s*\)?)?", t)]
    out += [("recital", m[1], None) for m in re.finditer(r"(?i)\b(?:betragtning(?:er)?|recital)\s+(\d{1,4})\b", t)]
    return out + [("annex", m[1].upper(), None) for m in re.finditer(r"(?i)\b(?:bilag|annex)\s+([ivxlcdm]+|\d{1,3})\b", t)]


def distinct(items, key):
    out = {}
    for x in items:
        out.setdefault(key(x), x)
    return list(out.values())


def plain(a):
    text, refs, engineering = a["answer"] or "", a["refs"] or [], a["profile"] == "ENGINEERING"
    if engineering and a["intent"] in C.BASED and not a["abstained"]:
        silent = text.strip() and text.strip() != "MISSING_REF" and not re.search(r"(?i)\bUTILSTRÆKKELIG_EVIDENS\b", text) and not NUMBER.search(body(text)) and not mentions(body(text))
        if silent:
            lines = []
            for kind, name in (("article", "Artikel"), ("annex", "Bilag"), ("recital", "Betragtning")):
                of = [(has(r, kind).upper(), r["idx"]) for r in refs if has(r, kind) and r["idx"] > 0]
                lines += [f"Relevant hjemmel: {name} {v} [{i}]." for v, i in distinct(of, lambda x: x[0])]
            text = (text.rstrip() + "\n\n" + "\n".join(lines[:3])).strip() if lines else text
    if engineering and refs and text.strip() != "MISSING_REF" and not NUMBER.search(body(text)):
        done, out = set(), []
        for line in text.splitlines():
            named = [("article", m.upper()) for m in re.findall(r"(?i)a\s*r\s*t\s*i\s*k\s*e\s*l\s*(\d{1,3}[a-z]?)", line)] + [("annex", m.upper()) for m in re.findall(r"(?i)\b(?:bilag|annex)\s+([ivxlcdm]+|\d{1,3})\b", line)] + [("recital", m) for m in re.findall(r"(?i)\b(?:betragtning|recital)\s*\(?\s*(\d{1,4})\s*\)?\b", line)]
            hits = set()
            for k, v in named:
                of = {r["idx"] for r in refs if has(r, k).upper() == v and r["idx"] > 0}
                hits |= of if len(of) == 1 else set()
            if len(hits) == 1 and len(done) < 8:
                done |= hits
                line = f"{line.rstrip()} [{min(hits)}]"
            out.append(line)
        text = "\n".join(out)
    missing = sorted(set(a["required"] or []) - set(cited(text)))
    if engineering and missing:
        lines = text.split("\n")
        two = next((i for i, s in enumerate(lines) if s.strip().startswith("2.")), None)
        end = next((i for i, s in enumerate(lines) if two is not None and i > two and s.strip().startswith("3.")), len(lines))
        bullets = [i for i, s in enumerate(lines) if s.lstrip().startswith("-")]
        at = next((i for i in bullets if two is not None and two < i < end), bullets[0] if bullets else None)
        if at is not None:
            lines[at] = lines[at].rstrip() + "".join(f" [{n}]" for n in missing)
            text = "\n".join(lines)
    by_number = {r["idx"]: has(r, "chunk_id") for r in reversed(refs) if r["idx"] > 0 and has(r, "chunk_id")}
    used = [by_number[n] for n in cited(text) if n in by_number]
    for kind, value, par in mentions(body(text)):
        of = [r for r in refs if has(r, kind).upper() == value]
        exact = [r for r in of if par and has(r, "paragraph") == par]
        used += [r["chunk_id"] for r in (exact or of)[:1] if r["chunk_id"]]
    used = distinct(used, str)
    if a["profile"] == "LEGAL" and a["fallback"] and len(used) < 2:
        used = distinct(used + own(a["question"] or "", refs), str)[:2]
    order = distinct([by_number[n] for n in cited(text) if n in by_number] + used, str)
    by_id = {r["chunk_id"] or "": r for r in refs}
    place = lambda r: next(((k, r[k]) for k in ("article", "recital", "annex") if r[k]), None)
    found = distinct([by_id[c] for c in order if c in by_id and place(by_id[c])], lambda r: (has(r, "corpus_id"), place(r)))
    if not engineering:
        return text, found, used, None
    if text.strip() != "MISSING_REF" and (a["rendered"] or "").strip():
        text = a["rendered"]
    numbers, known, least = set(cited(text)) or set(a["structured"] or []), {r["idx"] for r in refs}, a["least"] or 0
    fail = lambda why: ("MISSING_REF", [], [], why)
    asked = least > 0 and len(known) >= least
    if asked and len(numbers & known) < least:
        return fail(C.TOO_FEW)
    found = found or [r for r in refs if r["idx"] in numbers]
    if found:
        lost = sorted(numbers - {r["idx"] for r in found})
        found = found + [next(r for r in refs if r["idx"] == n) for n in lost if n > 0 and n in known]
        if not numbers and text.strip() != "MISSING_REF":
            return fail(C.NONE_CITED)
        have = {r["idx"] for r in found}
        if numbers:
            if numbers - have:
                return fail(C.UNKNOWN)
            if asked and len(numbers & have) < least:
                return fail(C.TOO_FEW)
            found = [r for r in found if r["idx"] in numbers]
    return text, found, used, None


def own(question, refs):
    words = list(dict.fromkeys(re.findall("[a-zæøå]{4,}", question.lower())))
    stems = set(words) | {w[:n] for w in words if len(w) >= 9 for n in (6, 8)}
    for w in words:
        stems |= {w[: -len(e)] for e in [next((e for e in C.ENDINGS if w.endswith(e) and len(w) - len(e) >= 4), None)] if e}
    rows = []
    for pos, r in enumerate(refs):
        kind = next((n for n, k in enumerate(("article", "recital", "annex")) if r[k]), None)
        if kind is not None and has(r, "chunk_id"):
            value = r[("article", "recital", "annex")[kind]]
            score = sum(s in (r["words"] or "").lower() for s in stems)
            number = int(value) if score and kind < 2 and value.strip().isdigit() else 10**9
            rows.append((kind, -score, number, pos, value, has(r, "chunk_id")))
    return [x[-1] for x in distinct(sorted(rows), lambda x: (x[0], x[4]))][:2]


@pytest.fixture(scope="module")
def answers():
    rnd = random.Random(8)
    parts = ["Kort svar.", "Artikel 6", "se art. 6, stk. 2", "a r t i k e l 7 gælder", "Bilag III", "annex iii og bilag 4", "Betragtning 12", "recital (12)", "[1]", "[2][1]", "[4].", "[99]", "[0]", "- punkt", "2. Krav", "3. Systemer", "UTILSTRÆKKELIG_EVIDENS", "  ", "betragtninger 9"]
    asked = ["Hvilke forpligtelser gælder for udbyderne?", "kravene til dokumentation", "", None, "Who must register systemerne"]
    pick = lambda *xs: rnd.choice(xs)
    out = []
    for n in range(900):
        refs = None if n % 50 == 0 else [
            {"idx": pick(i, i, i, i, 0, 2), "chunk_id": pick(f"c{i}", f"c{i}", "c1", "", None), "corpus_id": pick("cra", "cra", " nis2", None), "article": pick("6", "7", "6", "13", "", None), "paragraph": pick("2", "", None), "recital": pick("12", "", None), "annex": pick("iii", "4", "", None), "label": f"ref {i}", "words": pick("Forpligtelser for udbydere", "register", "krav dokument", "", None)}
            for i in range(1, rnd.randint(0, 6) + 1)
        ]
        text = pick("MISSING_REF", None, "", "Intet sagt.") if rnd.random() < 0.2 else "".join(rnd.choice(parts) + pick("\n", " ", "\n\n") for _ in range(rnd.randint(1, 6))) + pick("", "", LIST + "[3] noget")
        out.append({"query_id": n, "answer": text, "question": rnd.choice(asked), "refs": refs, "profile": pick("ENGINEERING", "ENGINEERING", "LEGAL", "OTHER"), "intent": pick("SCOPE", "GENERAL", "REQUIREMENTS"), "abstained": pick(True, False, False, None), "required": pick(None, [], [2], [5, 1, 5]), "least": pick(None, 0, 1, 2), "fallback": pick(True, False, None), "structured": pick(None, [], [1], [1, 2], [77]), "rendered": pick(None, None, " ", "Vist [1] tekst")})
    return out


def test_chain(spark, answers):
    kinds = f"query_id int, answer string, question string, refs array<{C.REFERENCE}>, profile string, intent string, abstained boolean, required array<int>, least int, fallback boolean, structured array<int>, rendered string"
    rows = [tuple([tuple(r[f] for f in FIELDS) for r in a["refs"]] if k == "refs" and a["refs"] is not None else a[k] for k in (x.split()[0] for x in kinds.replace("array<int>", "a").replace(f"array<{C.REFERENCE}>", "a").split(", "))) for a in answers]
    got = {r.query_id: r for r in C.process(spark.createDataFrame(rows, kinds)).collect()}
    assert len(got) == len(answers)
    reasons = set()
    for a in answers:
        text, found, used, why = plain(a)
        r = got[a["query_id"]]
        assert (r.answer, [tuple(x) for x in r.references], r.used, r.fail_reason) == (text, [tuple(tidy(x, f) for f in FIELDS) for x in found], used, why), a
        assert r.reference_lines == [f"[{x['idx']}] {x['label']}" for x in found]
        reasons.add(why)
    assert reasons == {None, C.TOO_FEW, C.NONE_CITED, C.UNKNOWN}


def test_repair_stops_at_its_limit(spark):
    text = "\n".join(f"Artikel {n}" for n in range(1, 12))
    refs = F.array(*(F.struct(*(F.lit(v).alias(f) for f, v in zip(FIELDS, (n, f"c{n}", "x", str(n), None, None, None, "", ""), strict=True))) for n in range(1, 12))).cast(f"array<{C.REFERENCE}>")
    got = spark.range(1).select(C.repaired(F.lit(text), C.cleaned(refs)).alias("t")).first().t.split("\n")
    assert got[7] == "Artikel 8 [8]" and got[8:] == ["Artikel 9", "Artikel 10", "Artikel 11"]
