"""Queries of logs: classified questions, runs as they went on, and mergeable sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intent_log as log
from ..operators import sketches
from ..streaming import logs
from . import wordings as W
from .queries import _said, _t, query

_TOLD = [" mail A.b+c@d-e.dk", " ring +45 12 34 56 78.", " nr. 1234567", " (12) 34.56-78 90", ""]
_TOLD_SQL = "[" + ", ".join(f"'{t}'" for t in _TOLD) + "]"


@query(f"""WITH q AS (SELECT conv_id, turn, role, {W.said('conv_id + turn')} || {_TOLD_SQL}[(conv_id % 5 + 1)::INT] || ' ' || text AS said, CASE conv_id % 3 WHEN 0 THEN 'GENERAL' WHEN 1 THEN 'SCOPE' ELSE 'GENERAL' END AS intent FROM conversations),
m AS (SELECT *, regexp_replace(said, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}\\b', '[REDACTED_EMAIL]', 'g') AS t FROM q WHERE intent = 'GENERAL')
SELECT conv_id, turn, upper(role) AS profile, substr(CASE conv_id % 5 WHEN 1 THEN replace(t, '+45 12 34 56 78', '[REDACTED_PHONE]') WHEN 3 THEN replace(t, '12) 34.56-78 90', '[REDACTED_PHONE]') ELSE t END, 1, 500) AS question,
sha256(trim(regexp_replace(lower(said), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS question_sha256,
({W.holds(W.ENFORCEMENT, 'said')} OR {W.stands('forbud', 'said')}) AS enforcement, ({W.holds(W.STRONG, 'said')} OR ({W.holds(W.WEAK, 'said')} AND {W.holds(W.VERBS, 'said')})) AS requirements, {W.holds(W.CLASSIFICATION, 'said')} AS classification, {W.holds(W.SCOPE, 'said')} AS scope FROM m""")
def intent_events(spark, d):
    """General questions with an address or a number in some, as they are logged."""
    told = F.element_at(F.array(*map(F.lit, _TOLD)), (F.col("conv_id") % 5 + 1).cast("int"))
    said = F.concat(_said(F.col("conv_id") + F.col("turn")), told, F.lit(" "), "text")
    asked = _t(spark, d, "conversations").select("conv_id", "turn", said.alias("question"), F.when(F.col("conv_id") % 3 == 1, "SCOPE").otherwise("GENERAL").alias("intent"), F.col("role").alias("profile"), F.lit(None).cast("string").alias("corpus_id"))
    return log.events(asked, only_general=True).select("conv_id", "turn", "profile", "question", "question_sha256", "signals.*")


@query("""WITH r AS (SELECT user_id::VARCHAR AS law, list({'i': event_id, 'v': value} ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1)
SELECT law, r[-1].i AS latest_run, r[-1].v AS latest_rate, len(r)::INT AS runs, list_max(list_transform(r, lambda x: x.v)) AS best_rate, list_transform(r, lambda x: x.v) AS progression FROM r""")
def run_progressions(spark, d):
    """Each user's events as the runs of a law; a stream of them ends in the same rows."""
    runs = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("law"), "ts", F.col("event_id").alias("run_id"), F.col("value").alias("rate"))
    return logs.progression_of(runs)


@query("SELECT event_type, count(*) AS n, true AS users_near, true AS quantiles_near FROM events GROUP BY 1")
def merged_sketches(spark, d):
    """Whether daily sketches, merged, come within 3 % of the distinct users and within 2 % of the ranks asked for."""
    events = _t(spark, d, "events")
    wanted = (0.5, 0.9, 0.99)
    got = sketches.merged(sketches.daily(events, F.to_date("ts"), ["event_type"], "user_id", "value"), ["event_type"], wanted)
    true = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("all_users"))
    near = F.lit(True)
    for q in wanted:  # the share of values up to the estimate
        below = events.join(F.broadcast(got.select("event_type", F.col(f"q{100 * q:g}").alias("q"))), "event_type").groupBy("event_type").agg(F.avg((F.col("value") <= F.col("q")).cast("double")).alias(f"r{100 * q:g}"))
        true, near = true.join(below, "event_type"), near & (F.abs(F.col(f"r{100 * q:g}") - q) <= 0.02)
    return got.join(true, "event_type").select("event_type", "n", (F.abs(F.col("users") - F.col("all_users")) <= 0.03 * F.col("all_users")).alias("users_near"), near.alias("quantiles_near"))
