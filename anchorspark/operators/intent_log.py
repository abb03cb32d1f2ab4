"""Events of classified questions for a log: redacted, cut, hashed before redaction, with the intents that the wording speaks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# What is redacted, and the marks left in its place.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?<!\w)(?:\+?\d[\d\s().-]{6,}\d)(?!\w)"
EMAIL_MARK, PHONE_MARK = "[REDACTED_EMAIL]", "[REDACTED_PHONE]"


def redacted(question: Column) -> Column:
    """Without e-mail addresses, and without runs of digits and separators that hold eight digits or more."""
    text = F.regexp_replace(F.coalesce(question, F.lit("")), EMAIL, EMAIL_MARK)
    phone = "(?U)" + PHONE
    short = lambda run: F.length(F.regexp_replace(run, r"(?U)\D", "")) < 8

    def rebuilt(runs: Column) -> Column:
        between = F.split(text, phone)
        return F.array_join(F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.when(short(F.get(runs, i)), F.get(runs, i)).when(F.get(runs, i).isNotNull(), F.lit(PHONE_MARK)), F.lit("")))), "")

    return T.let(F.regexp_extract_all(text, F.lit(phone), F.lit(0)), rebuilt)


def signals(question: Column) -> Column:
    """(enforcement, requirements, classification, scope): the kinds of intent that a question's words speak for."""
    cues = T.intent_cues(F.coalesce(question, F.lit("")))
    has = lambda words: T.contains_any(F.coalesce(question, F.lit("")), words)
    return F.struct(cues["enforcement"].alias("enforcement"), cues["requirements"].alias("requirements"), has(T.CLASSIFICATION).alias("classification"), has(T.SCOPE).alias("scope"))


def events(questions: DataFrame, most: int = 500, only_general: bool = False) -> DataFrame:
    """Log rows of questions (question, intent, profile, corpus_id); further columns stay.

    The hash is of the question as asked, lower-cased with single blanks, so
    that equal questions are found however they are redacted.  most is held
    between 0, for no limit, and 5,000.
    """
    most = max(0, min(most, 5000))
    asked = F.coalesce("question", F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(F.lower(asked), r"(?U)\A\s+|\s+\z", ""), r"(?U)\s+", " ")
    shown = redacted(asked)
    rows = questions if not only_general else questions.where(F.col("intent") == "GENERAL")
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return rows.withColumns({
        "question": F.substring(shown, 1, most) if most else shown, "question_sha256": F.sha2(plain, 256), "signals": signals(asked),
        "profile": F.coalesce(F.upper(blank("profile")), F.lit("UNKNOWN")), "corpus_id": blank("corpus_id"),
    })
