"""The intent log, streams of runs against one batch, and sketches."""

from __future__ import annotations

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from anchorspark.operators import intent_log, sketches
from anchorspark.streaming import logs

DAY = datetime.datetime(2024, 1, 1)


def logged(spark, questions, **kw):
    rows = spark.createDataFrame([(n, q, "GENERAL" if n % 2 == 0 else "SCOPE", " legal " if n % 3 else None, "") for n, q in enumerate(questions)], "n int, question string, intent string, profile string, corpus_id string")
    return sorted(intent_log.events(rows, **kw).collect())


def test_events(spark):
    asked = ["Skriv til a.b+c@d-e.dk, tak", "ring +45 12 34 56 78 nu", "nr. 1234567 og 12-34", "  Hvad\n er  FORBUD? ", None, "x12345678", "(12) 3456-7890 og 11 22 33 44", "a" * 900]
    got = logged(spark, asked)
    assert [r.question for r in got[:7]] == ["Skriv til [REDACTED_EMAIL], tak", "ring [REDACTED_PHONE] nu", "nr. 1234567 og 12-34", "  Hvad\n er  FORBUD? ", "", "x12345678", "([REDACTED_PHONE] og [REDACTED_PHONE]"]
    assert len(got[7].question) == 500 and len(logged(spark, asked, most=0)[7].question) == 900 and len(logged(spark, asked, most=9)[7].question) == 9
    assert got[3].question_sha256 == hashlib.sha256(b"hvad er forbud?").hexdigest() and got[3].signals.enforcement
    assert [r.profile for r in got[:3]] == ["UNKNOWN", "LEGAL", "LEGAL"] and got[0].corpus_id is None
    assert [r.n for r in logged(spark, asked, only_general=True)] == [0, 2, 4, 6]


def test_streams_after_a_restart_equal_one_batch(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(rnd.choice(["cra", "nis2", None, "dora"]), DAY + datetime.timedelta(minutes=rnd.randint(0, 50)), n, rnd.random()) for n in range(120)]
    rows += rows[5:15] + [("cra", None, 500, 0.5)]  # sent twice, and without a time
    rnd.shuffle(rows)
    kind = "law string, ts timestamp, run_id long, rate double"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
    seen: dict = {}

    def keep(batch, n):
        for r in batch.collect():
            seen[r.law] = r

    def run():
        one = logs.progression(stream()).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
        two = logs.append(stream(), out, str(tmp_path / "c2"))
        one.awaitTermination()
        two.awaitTermination()

    for part in (rows[:40], rows[40:70], rows[70:]):  # each time the stream starts again
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        run()
    whole = spark.createDataFrame(rows, kind)
    want = {r.law: r for r in logs.progression_of(whole).collect()}
    assert seen == want and set(want) == {"cra", "nis2", "dora"}
    assert sorted(logs.read(spark, out, kind).collect(), key=str) == sorted(whole.collect(), key=str)
    again = logs.append(stream(), out, str(tmp_path / "other checkpoint"))  # the same batches once more, as after a lost commit
    again.awaitTermination()
    assert logs.read(spark, out, kind).count() == len(rows)


def test_sketches_merge(spark):
    rnd = random.Random(2)
    rows = [(DAY + datetime.timedelta(hours=rnd.randint(0, 240)), "a" if n % 3 else "b", rnd.randint(0, 4000), rnd.gauss(0, 1)) for n in range(20000)] + [(None, "a", None, None), (None, "c", None, None)]
    table = spark.createDataFrame(rows, "ts timestamp, g string, user long, value double")
    days = sketches.daily(table, F.to_date("ts"), ["g"], "user", "value")
    assert days.where("day is null").count() == 2
    got = {r.g: r for r in sketches.merged(days.where("g <> 'c'"), ["g"], (0.5, 0.9)).collect()}
    for g in "ab":
        mine = [r for r in rows if r[1] == g and r[3] is not None]
        users, values = len({r[2] for r in mine}), [r[3] for r in mine]
        assert got[g].n == sum(r[1] == g for r in rows) and got[g].users == pytest.approx(users, rel=0.03)
        for q in (0.5, 0.9):
            assert sum(v <= got[g][f"q{100 * q:g}"] for v in values) / len(values) == pytest.approx(q, abs=0.02)
    spread = sketches.merged(days.where("g <> 'c'").repartition(5).orderBy("day"), ["g"])
    assert {r.g: r.users for r in spread.collect()} == {g: pytest.approx(r.users, rel=0.03) for g, r in got.items()}
    assert days.where("g = 'b'").limit(1).select(sketches.rank_of("spread", F.lit(100.0))).first()[0] == 1.0
