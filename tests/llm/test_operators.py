"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from anchorspark.llm import arrow, components, decontaminate, packing, qda, quality_rules, recurrent_lm, sharding, simhash, substring_dedup, token_counts, warc
from anchorspark.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, h long, n long, pos string, words string, rank string, block string, row string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "p", "w", "r", "b", "x") for i, t in rows], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(60)] + ["The", "émile", "x.", "a,", "#1", "**"]
    passage = " ".join(rnd.choice(vocab) for _ in range(70))
    out = []
    for i in range(60):
        body = " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 160)))
        if i % 4 == 0:
            body = f"{body} {passage} tail{i}"
        if i % 9 == 0:
            body = body.replace(" ", "\n", 3)
        out.append((i, body))
    out += [(60, None), (61, ""), (62, " \t\n"), (63, out[8][1]), (64, out[8][1]), (64, out[8][1]), (None, out[8][1]), (65, "word " * 3000), (66, "a b c"), (67, "\n".join(["same line here"] * 30)), (68, "LOUD WORDS " * 40)]
    return out


def base_stats(text):
    words = (text or "").encode().split()
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {g for g, c in Counter(grams).items() if c > 1}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(8)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, texts):
    got = Counter(tuple(r) for r in quality_rules.judge(make(spark, texts)).collect())
    want = Counter()
    for i, t in texts:
        n, chars, symbols, dup, rep = base_stats(t)
        failed = n < 20 or 100 * rep > 30 * n
        lines = sum(bool(x.encode().split()) for x in (t or "").split("\n"))
        upper, lower = (sum(a <= c <= b for c in t or "") for a, b in ("AZ", "az"))
        kept = not (failed or 10 * symbols > chars or 2 * dup > lines or chars < 2 * n or chars > 20 * n or upper > lower)
        want[i, n, chars, symbols, dup, rep, failed, kept] += 1
    assert got == want
    assert quality_rules.judge(make(spark, [])).count() == 0
    kept = quality_rules.judge(make(spark, texts), keep_rows=True)
    assert Counter(r[0] for r in kept.collect()) == Counter(k[0] for k, c in want.items() for _ in range(c) if k[-1])


def test_rules_are_ordered_by_what_each_adds():
    rule = lambda name, *needs: quality_rules.Rule(name, lambda s: False, needs)
    rules = [rule("words", "n_words"), rule("repeats", "n_repeat_words"), rule("symbols", "n_symbols"), rule("chars", "word_chars")]
    seconds = {"words": 5.0, "n_words": 0.0, "n_repeat_words": 1.0, "n_symbols": 1.0, "word_chars": 1.0}
    # 40 texts only by symbols; 30 by symbols and chars; 20 by repeats; 10 by words
    order = quality_rules.order_rules(rules, quality_rules.Measured(seconds, {0b0100: 40, 0b1100: 30, 0b0010: 20, 0b0001: 10, 0: 900}))
    # chars alone rejects 30 a second, but none that symbols leaves; once repeats has split words, counting them is free
    assert [r.name for r in order] == ["symbols", "repeats", "words", "chars"]
    none = quality_rules.order_rules(rules, quality_rules.Measured({}, {}))
    assert sorted(r.name for r in none) == sorted(r.name for r in rules)


def test_repeated_windows_with_clashing_keys(monkeypatch):
    rnd = random.Random(9)
    for _ in range(200):
        words = [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(0, 60))]
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        twice = {g for g, c in Counter(grams).items() if c > 1}
        want = len({i + k for i, g in enumerate(grams) if g in twice for k in range(8)})
        assert quality_rules.repeated_window_words(words, 8) == want
        with monkeypatch.context() as m:
            m.setattr(quality_rules, "_MIX", np.zeros(2, np.uint64))  # all keys are equal
            assert quality_rules.repeated_window_words(words, 8) == want


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 200 + "</p>"
    pages = [(5, "http://a b/", big), (3, None, big), (3, "u", big), (None, "n", big), (9, "t", "small"), (10, "t", "small"), (11, "e", None), (12, "e", ""), (13, "w", "WARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame([(*p, "c", "d") for p in pages], "page_id long, url string, html string, digest string, refers_to string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) if r["page_id"] is not None else (-1, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.archive_round_trip(df).collect())
    d = lambda s: (len((s or "").encode()), hashlib.sha256((s or "").encode()).hexdigest())
    want = sorted([(5, "revisit", 3, *d(big)), (3, "response", None, *d(big)), (3, "response", None, *d(big)), (-1, "revisit", 3, *d(big)), *((i, "response", None, *d(s)) for i, s in [(9, "small"), (10, "small"), (11, None), (12, ""), (13, pages[-1][2])])])
    assert got == want
    assert warc.archive_round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize(("kind", "ids"), [("string", ["a", "b", "null", "", "x y<é>%", "7"]), ("int", [4, 2, -3, 9, 11, 12]), ("decimal(9,2)", [Decimal("1.50"), Decimal("1.25"), Decimal("-7.00"), Decimal("3.00"), Decimal("4.00"), Decimal("5.00")]), ("date", [datetime.date(2020, 1, n) for n in range(1, 7)])])
def test_warc_ids_of_any_type(spark, kind, ids):
    same = "<p>" + "y" * 150 + "</p>"
    pages = [(i, "u", same if n % 2 else f"<p>{n}</p>") for n, i in enumerate(ids)] + [(None, "u", same)]
    got = warc.archive_round_trip(spark.createDataFrame(pages, f"page_id {kind}, url string, html string"))
    assert got.schema["page_id"].dataType.simpleString() == got.schema["refers_to"].dataType.simpleString() == kind
    first = min(i for i, _, h in pages if h == same and i is not None)
    want = Counter((i, "response" if h != same or i == first else "revisit", None if h != same or i == first else first) for i, _, h in pages)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got.collect()) == want


def test_warc_refuses_ids_without_a_text_form(spark):
    with pytest.raises(TypeError, match="page_id"):
        warc.archive_round_trip(spark.createDataFrame([(bytearray(b"x"), "u", "h")], "page_id binary, url string, html string"))


def _salvage(data):
    return list(warc.salvage(lambda at, n: data[at : at + n], len(data)))


def _record(i, body=None):
    body = f"payload number {i} ".encode() * 20 if body is None else body
    return warc.record(i, "u", body, hashlib.sha256(body).hexdigest(), None)


def _gzip(data, level=1):
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _ids(found):
    return [x.head["warc-record-id"] for x in found if x.kind == "record"]


@pytest.mark.parametrize("compress", [True, False])
def test_warc_salvage(compress):
    parts = [_gzip(_record(i)) if compress else _record(i) for i in range(6)]
    whole = b"".join(parts)
    assert [x.kind for x in _salvage(whole)] == ["record"] * 6
    assert _salvage(b"") == []
    at = len(parts[0]) + len(parts[1]) // 2
    broken = bytearray(whole)
    broken[at] ^= 0xFF
    cut = len(b"".join(parts[:4])) + 10
    broken = bytes(broken[:cut]) + b"\x00garbage" + bytes(broken[cut + 30 :])
    found = _salvage(broken)
    assert _ids(found) == [f"<urn:page:{i}>" for i in (0, 2, 3, 5)]
    assert sum(x.kind == "gap" for x in found) == 2
    spans = [(x.start, x.end) for x in found]
    assert spans[0][0] == 0 and spans[-1][1] == len(broken) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_warc_salvages_inside_a_member():
    plain = [_record(i) for i in range(5)]
    plain[2] = plain[2].replace(b"number 2", b"number 9")  # its digest differs
    found = _salvage(_gzip(b"".join(plain)))
    assert _ids(found) == [f"<urn:page:{i}>" for i in (0, 1, 3, 4)]
    before = len(plain[0]) + len(plain[1])
    assert [x.inner for x in found if x.kind == "gap"] == [(before, before + len(plain[2]))]
    rnd = random.Random(5)
    noise = [_record(i, rnd.randbytes(9000)) for i in range(8)]
    for level in (0, 6):  # a member that is cut off, its bytes stored or not, and whole ones after it
        whole = _gzip(b"".join(noise[:6]), level)
        found = _salvage(whole[: len(whole) * 3 // 4] + _gzip(noise[6]) + _gzip(noise[7]))
        got = _ids(found)
        assert got[:4] == [f"<urn:page:{i}>" for i in range(4)] and got[-2:] == ["<urn:page:6>", "<urn:page:7>"] and len(got) == len(set(got))
        assert sum(x.kind == "gap" for x in found) == 1


def test_warc_reader_is_linear():
    import time

    def seconds(n):
        data = b"".join(_gzip(_record(i)) for i in range(n))
        began = time.process_time()
        assert len(_salvage(data)) == n
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 8 * seconds(4_000)


@pytest.mark.parametrize("compress", [True, False])
def test_warc_archives_with_damage(spark, tmp_path, compress):
    rows = [(i, "u", f"<p>{i}</p>" * 50, "", None) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload string, digest string, refers_to long").withColumn("digest", F.sha2("payload", 256))
    path = f"file://{tmp_path}/a"
    assert warc.write_archives(pages.coalesce(2), path, compress, 3000) == 40
    files = sorted((tmp_path / "a").glob("*.warc*"))
    assert len(files) > 2
    data = bytearray(files[0].read_bytes())
    data[len(data) // 2] ^= 0xFF
    files[0].write_bytes(bytes(data))
    files[-1].write_bytes(b"junk" * 30 + files[-1].read_bytes()[:-5])
    got = warc.read_archives(spark, path).collect()
    ok = [r for r in got if r["kind"] == "record"]
    assert 36 <= len(ok) < 40 and all(bytes(r["payload"]).decode() == rows[int(r["page_id"])][2] for r in ok)
    gaps = {(r["file"].rsplit("/")[-1], r["reason"]) for r in got if r["kind"] == "gap"}
    assert {g[0] for g in gaps} == {files[0].name, files[-1].name} and sum(r["length"] or r["inner_length"] for r in got if r["kind"] == "gap") > 120


def test_packing(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(path).encode
    window = 64
    got = packing.pack(make(spark, texts), path, window).collect()
    tokens = Counter()
    for i, t in texts:
        ids = [*encode(t or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), window):
            piece = ids[at : at + window]
            tokens[i, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == tokens
    spots = {}
    for r in got:
        spots.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spots.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= window
    assert packing.pack(make(spark, []), path, window).count() == 0


def test_best_fit_equals_one_by_one():
    rnd = random.Random(4)
    for _ in range(60):
        window = rnd.choice([7, 16, 33])
        counts = {s: rnd.randint(1, 9) for s in rnd.sample(range(1, window + 1), rnd.randint(1, 6))}
        plan = packing.best_fit_decreasing(counts, window)
        rooms: list[int] = []
        for size in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
            fits = [r for r in rooms if r >= size]
            room = min(fits, default=window)
            if fits:
                rooms.remove(room)
            rooms.append(room - size)
        used = Counter()
        for s, n in counts.items():
            w, off = plan.place(np.full(n, s), np.arange(n))
            for a, b in zip(w.tolist(), off.tolist(), strict=True):
                used[a] += s
                assert b + s <= window
        assert plan.windows == len(rooms) == len(used)
        assert sorted(window - v for v in used.values()) == sorted(rooms)


def test_sharding(spark, texts):
    tree = sharding.Tree(((((1.0, 2.0), (1.0,))), ((1.0, 1.0, 1.0),)))
    got = sharding.shard(make(spark, texts), tree).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    for s in range(tree.n_shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    many = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    grown = tree.grow(3.0)
    pairs = many.select(sharding.shard_of(F.col("k"), tree).alias("a"), sharding.shard_of(F.col("k"), grown).alias("b"), sharding.shard_of(F.col("k"), grown.grow()).alias("c")).toPandas()
    assert set(pairs.b[pairs.a != pairs.b]) == {6} and set(pairs.c[pairs.b != pairs.c]) == {7}
    share = pairs.a.value_counts(normalize=True)
    for s, w in enumerate([1, 2, 1, 1, 1, 1]):
        assert abs(share[s] - w / 7) < 0.02
    assert abs((pairs.b == 6).mean() - 0.3) < 0.02
    assert sharding.shard(make(spark, []), tree).count() == 0


LM = {"words": 32, "classes": 6, "hidden": 6, "head_words": 50, "run_tokens": 700}


def _spark_hash(*texts):
    """xxhash64 of strings: each one's hash is the next one's seed, 42 the first."""
    h = 42
    for t in texts:
        h = xxhash.xxh64_intdigest(t.encode(), h)
    return h


def _plain_shard(key, tree):
    draw = lambda node, weight: -math.log(((_spark_hash(key, node) >> 11) + 0.5) / (1 << 53)) / weight
    number, first = 0, {}
    for r, racks in enumerate(tree.racks):
        for k, weights in enumerate(racks):
            first[r, k] = number
            number += len(weights)
    tops = [(draw(f"{r}", sum(map(sum, racks))), r) for r, racks in enumerate(tree.racks)]
    tops += [(draw(f"added {n}", w), -1 - s) for n, (s, w) in enumerate(tree.added)]
    top = min(tops)[1]
    if top < 0:
        return -1 - top
    k = min((draw(f"{top}/{k}", sum(weights)), k) for k, weights in enumerate(tree.racks[top]))[1]
    return first[top, k] + min((draw(f"{top}/{k}/{s}", w), s) for s, w in enumerate(tree.racks[top][k]))[1]


def test_sharding_equals_a_plain_descent(spark, texts):
    tree = sharding.Tree(((((1.0, 2.0), (1.0,))), ((1.0, 1.0, 1.0),)), ((6, 2.0),))
    for r in sharding.shard(make(spark, texts), tree).collect():
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (_plain_shard(key, tree), _plain_shard(key, tree.grow()))
    production = sharding.Tree.even(4, 2, 5)
    ids = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    got = ids.select("k", sharding.shard_of(F.col("k"), production).alias("s")).collect()
    assert all(r["s"] == _plain_shard(r["k"], production) for r in got) and {r["s"] for r in got} == set(range(40))


def _held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def _lm_words(t):
    return (t or "").encode().lower().split()


def test_language_model(spark, texts):
    got = recurrent_lm.score_documents(make(spark, texts), **LM).collect()
    counts = Counter()
    for i, t in texts:
        if not _held(i):
            counts.update(_lm_words(t))
            counts["END"] += 1
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in texts:
        toks = [*_lm_words(t), "END"]
        want[i, _held(i), len(toks), sum(counts[w] > 0 for w in toks), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in toks), 5)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert recurrent_lm.score_documents(make(spark, []), **LM).count() == 0


def test_lm_scores_equal_a_plain_network(spark, texts, monkeypatch):
    """Untrained weights, so that they are known here; one document, word and step at a time, the rarer words by their counts."""
    monkeypatch.setattr(recurrent_lm, "_train_round", lambda coded, params, *_: params)
    got = Counter((r["doc_id"], round(r["score"], 2)) for r in recurrent_lm.score_documents(make(spark, texts), **LM).collect())
    counts, ends = Counter(), 0
    for i, t in texts:
        if not _held(i):
            counts.update(_lm_words(t))
            ends += 1
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    net, rare = ranked[: LM["words"] - 2], ranked[LM["words"] - 2 :]
    rare_tokens = sum(counts[w] for w in rare)
    in_order = np.array([ends, rare_tokens, *(counts[w] for w in net)], float)
    shape = recurrent_lm.Shape.of(in_order, LM["classes"], LM["hidden"])
    p = {k: a.astype(np.float64) for k, a in recurrent_lm.initial(in_order, shape).items()}
    ids, h = {w: k + 2 for k, w in enumerate(net)}, LM["hidden"]
    classes = list(zip(shape.starts, shape.starts[1:]))

    def log_probs(state):
        by = state @ p["wc"] + p["bc"]
        out = np.empty(shape.words)
        for k, (a, b) in enumerate(classes):
            inner = state @ p["wo"][:, a:b] + p["bo"][a:b]
            out[a:b] = by[k] - np.log(np.exp(by).sum()) + inner - np.log(np.exp(inner).sum())
        assert abs(np.exp(out).sum() - 1) < 1e-9
        return out

    want = Counter()
    for i, t in texts:
        state, last, total = np.zeros(h), recurrent_lm.END, 0.0
        for w in [*_lm_words(t), None]:
            x, b = p["x"][last], state @ p["wh"]
            z, r = (1 / (1 + np.exp(-(x[k * h : (k + 1) * h] + b[k * h : (k + 1) * h]))) for k in (0, 1))
            state = (1 - z) * state + z * np.tanh(x[2 * h :] + r * b[2 * h :])
            last = recurrent_lm.END if w is None else ids.get(w, recurrent_lm.RARE)
            total += log_probs(state)[last] / np.log(10)
            if last == recurrent_lm.RARE:
                total += math.log10((counts[w] + 1) / (rare_tokens + len(rare) + 1))
        want[i, round(total, 2)] += 1
    near = Counter({k: c for k, c in want.items() if k not in got})
    assert sum(near.values()) <= 2 and all(any(i == j and abs(x - y) < 0.02 for j, y in got) for i, x in near)
    assert abs(sum((counts[w] + 1) / (rare_tokens + len(rare) + 1) for w in rare) + 1 / (rare_tokens + len(rare) + 1) - 1) < 1e-9


def test_lm_learns_from_all_training_documents_and_no_other(spark, texts, monkeypatch):
    scores = lambda rows, parts: sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in recurrent_lm.score_documents(make(spark, rows).repartition(parts), **LM).collect() if not _held(r["doc_id"]))
    one, changed = scores(texts, 1), scores([(i, "other words w1 w2 w3 w3 " * 9 if _held(i) else t) for i, t in texts], 5)
    assert [x[:2] for x in one] == [x[:2] for x in changed]
    assert np.allclose([x[2] for x in one], [x[2] for x in changed], atol=1e-4)
    seen = []
    monkeypatch.setattr(recurrent_lm, "_train_round", lambda coded, params, *_: seen.extend(r["doc_id"] for r in coded.collect()) or params)
    recurrent_lm.score_documents(make(spark, texts), **LM)
    assert Counter(seen) == Counter(i for i, _ in texts if not _held(i))


def test_language_model_is_a_distribution_and_learns():
    rng = np.random.default_rng(0)
    pattern = np.array([2, 3, 4, 5, 6, 0])
    ids = np.concatenate([[0], np.tile(pattern, 400)])
    counts = np.bincount(ids, minlength=12).astype(float)
    shape = recurrent_lm.Shape.of(counts, 5, 8)
    p = recurrent_lm.initial(counts, shape)
    h = rng.uniform(-1, 1, size=(1, 8)).astype(np.float32)
    for scale in (1, 300):  # logits that exp takes, and some that it doesn't
        q = {k: a * scale for k, a in p.items()}
        total = sum(np.exp(recurrent_lm.log_likelihood(q, h, np.array([w]), shape))[0] for w in range(shape.words))
        assert abs(total - 1) < 1e-3
    q = recurrent_lm.train(p, ids, shape, streams=4, rate=0.02, last_rate=0.01)
    docs = [pattern.copy()]
    assert recurrent_lm.score_batch(q, docs, shape)[0] > recurrent_lm.score_batch(p, docs, shape)[0] + 3
    two = recurrent_lm.score_batch(q, [pattern, np.array([2, 0]), np.array([0])], shape)
    assert np.allclose(two, [recurrent_lm.score_batch(q, [d], shape)[0] for d in (pattern, np.array([2, 0]), np.array([0]))], atol=1e-4)


def test_every_id_of_a_run_is_a_target_once(monkeypatch):
    seen = []
    keep = recurrent_lm._gradients
    monkeypatch.setattr(recurrent_lm, "_gradients", lambda p, h, source, target, shape, real: seen.extend(target[real].tolist()) or keep(p, h, source, target, shape, real))
    rng = np.random.default_rng(1)
    for n in (2, 3, 64, 65, 1000, 1031):
        ids = rng.integers(0, 12, n)
        shape = recurrent_lm.Shape.of(np.ones(12), 4, 4)
        seen.clear()
        recurrent_lm.train(recurrent_lm.initial(np.ones(12), shape), ids, shape, streams=7, steps=4)
        assert Counter(seen) == Counter(ids[1:].tolist())


def test_language_model_gradients():
    shape = recurrent_lm.Shape((0, 1, 3, 6), 4)
    p = {k: a.astype(np.float64) for k, a in recurrent_lm.initial(np.ones(6), shape).items()}
    rng = np.random.default_rng(2)
    source, target = rng.integers(0, 6, (5, 3)), rng.integers(0, 6, (5, 3))
    h0, real = rng.uniform(-1, 1, size=(3, 4)), rng.random((5, 3)) < 0.8

    def loss(q):
        h, total = h0, 0.0
        for t in range(5):
            h = recurrent_lm._step(q, np.where((source[t] == recurrent_lm.END)[:, None], 0, h), q["x"][source[t]])[0]
            total -= recurrent_lm.log_likelihood(q, h, target[t], shape)[real[t]].sum()
        return total / real.sum()

    g, _ = recurrent_lm._gradients(p, h0, source, target, shape, real)
    for k, a in p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in a.shape)
            up, down = ({n: b.copy() for n, b in p.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - g[k][at]) < 1e-6, k


def test_token_counts(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    odd = [(70, "a<|endoftext|>b  <|endoftext|>"), (71, "it's  we'LL\t\n x  y 　z  "), (72, "漢字 🙂 Ⅷ½ \x1c\x85"), (73, "ab" * 400 + "  <|endoftext|"), (74, " \n\n"), (75, "'ve'd '"), (75, "'ve'd '")]
    counts = token_counts.count_tokens(make(spark, [*texts, *odd]), path, 9).collect()
    want = Counter((i, len((t or "").encode()), n(t or ""), n(t or "") > 9) for i, t in [*texts, *odd])
    assert Counter(tuple(r)[:4] for r in counts) == want
    fits = {r["doc_id"]: r["fits_chars"] for r in counts}
    counter = token_counts.PrefixCounter(path)
    for i, t in odd:
        every = [n(t[:k]) for k in range(len(t) + 1)]
        assert counter.prefix_counts(t).tolist() == every
        assert counter.truncate(t, 3) == t[: max(k for k, x in enumerate(every) if x <= 3)]
        assert fits[i] == max(k for k, x in enumerate(every) if x <= 9)
    assert token_counts.count_tokens(make(spark, []), path).count() == 0


def test_sorted_pieces_share_rows():
    counter = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    some = sorted(x.encode() for x in (" the", " there", " thereof", "", " xylophone", "there", "é", "ée"))
    assert [list(x) for x in counter.tables(some)] == [list(next(counter.tables([x]))) for x in some]
    assert all(t[-1] == len(counter._merge(x)) for t, x in zip(counter.tables(some), some, strict=True) if x)


def test_difference_covers():
    for period, cover in substring_dedup.COVERS.items():
        for d in range(period):
            assert any((a + d) % period in cover for a in cover)


def brute_removal(texts, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in texts]
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                first[tuple(w[k : k + window])] = min(i, first.get(tuple(w[k : k + window]), i))
    for i, w in split:
        gone = {k + j for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for j in range(window)}
        yield i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()


@pytest.mark.parametrize("window", [50, 25])
def test_substring_dedup(spark, texts, window):
    got = substring_dedup.removal_report(make(spark, texts), window)
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_removal(texts, window))
    cut = substring_dedup.remove_repeats(make(spark, texts), window)
    assert cut.columns == make(spark, []).columns
    digests = Counter((r["doc_id"], hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest()) for r in cut.collect())
    assert digests == Counter((i, d) for i, _, _, d in brute_removal(texts, window))
    assert substring_dedup.removal_report(make(spark, []), window).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, texts):
    rnd = random.Random(2)
    docs = list(texts)
    for k in range(40):
        words = docs[8][1].split()
        words[rnd.randrange(len(words))] = f"edit{k}"
        docs.append((100 + k, " ".join(words)))
    fps = [brute_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = Counter((i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(docs))
    got = simhash.near_duplicates(make(spark, docs)).select("doc_id", simhash.hex_fingerprint(F.col("fp")), "component_id")
    assert Counter(tuple(r) for r in got.collect()) == want
    assert simhash.near_duplicates(make(spark, [])).count() == 0


@pytest.mark.parametrize("most", [4096, 8])
def test_trie_join_finds_every_component(spark, most):
    rnd = random.Random(7)
    seeds = [rnd.getrandbits(64) for _ in range(150)]
    fps = set(seeds)
    for s in seeds:
        x = s
        for _ in range(rnd.randint(0, 6)):
            for _ in range(rnd.randint(1, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps |= {(seeds[0] & ~0xFFF) | v for v in range(0, 4096, 17)}  # crowded block values
    fps = sorted(fps)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    want = {frozenset(f for k, f in enumerate(fps) if find(k) == r) for r in {find(k) for k in range(len(fps))}}
    df = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    links = simhash.deal(df, 4, most).repartition(4, "key").sortWithinPartitions("key").mapInArrow(simhash._chains(4, at_once=200), "u long, v long")
    groups = {}
    for r in components.components(links, Scratch(spark, "test")).collect():
        groups.setdefault(r["root"], set()).add(r["node"] % (1 << 64))
    linked = {x for g in groups.values() for x in g}
    assert {frozenset(g) for g in groups.values()} | {frozenset([f]) for f in fps if f not in linked} == want


def test_classifier(spark):
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        n = rnd.randint(30, 120)
        docs.append((i, " ".join(("%%% " if not good and rnd.random() < 0.4 else "") + rnd.choice(["one", "two", "three", "four"]) + str(rnd.randint(0, 99)) for _ in range(n))))
        labels.append((i, int(good), 0))
    docs += [(400, None), (401, ""), (None, "some text")]
    lab = spark.createDataFrame([*labels, (402, None, 0)], "doc_id long, quality int, toxic int")
    got = qda.classify(make(spark, docs), lab).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == labels[r["doc_id"]][1] for r in held) / len(held) > 0.97
    assert qda.classify(make(spark, docs), lab.limit(0)).first()["score"] == 0.5
    assert qda.classify(make(spark, []), lab).count() == 0


def test_classifier_equals_plain_densities(spark):
    """Scores against densities by inverse and determinant; repeated labels, constant features and ties among the texts."""
    rnd = random.Random(8)
    docs = [(i, " ".join(rnd.choice(["ab", "cd!", "x9", "Efg"]) for _ in range(rnd.randint(3, 40))) + (" %%%" if i % 4 == 0 else "")) for i in range(90)]
    docs += [(90, docs[1][1]), (91, docs[1][1]), (92, None), (93, ""), (94, "long " * 5000)]
    labels = [(i, int(i % 3 > 0)) for i in range(90)] + [(5, 1), (5, 0), (90, None), (91, 7)]
    got = {r["doc_id"]: r["score"] for r in qda.classify(make(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = {i: np.array(qda.features((t or "").encode() if t is not None else None), float) for i, t in docs}
    rows = [(x[i], y) for i, y in labels if y in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1]
    every = np.array([v for v, _ in rows])
    mean, scale = every.mean(axis=0), np.sqrt(np.maximum(every.var(axis=0), 1e-8))
    assert (every.var(axis=0) < 1e-12).any()  # some features are constant
    of = {k: (np.array([v for v, y in rows if y == k]) - mean) / scale for k in (0, 1)}
    cov = {k: np.cov(z.T, bias=True) for k, z in of.items()}
    pooled = sum(len(of[k]) * cov[k] for k in of) / len(rows)

    def density(v, k):
        c = 0.8 * cov[k] + 0.2 * pooled
        c = 0.98 * c + 0.02 * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c))
        z = (v - mean) / scale - of[k].mean(axis=0)
        return -0.5 * z @ np.linalg.solve(c, z) - 0.5 * np.linalg.slogdet(c)[1] + np.log(len(of[k]))

    for i, v in x.items():
        margin = np.clip(density(v, 1) - density(v, 0), -500, 500)
        assert abs(got[i] - 1 / (1 + np.exp(-margin))) < 1e-4, i
    assert got[1] == got[90] == got[91]


def brute_hits(texts, items, width=13):
    import re

    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    for i, t in texts:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination(spark, texts):
    items = [(1, texts[0][1][:200]), (2, texts[0][1][:200]), (10, "W3 w4"), (3, None), (4, "..."), (5, "émile"), (6, " ".join(texts[4][1].split()[-40:-5])), (7, "not in any document at all zzz")]
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, word string")
    got = decontaminate.report(make(spark, texts), bench).drop("text_hash")
    want = Counter(brute_hits(texts, items))
    assert Counter(tuple(r) for r in got.collect()) == want
    kept = Counter(r["doc_id"] for r in decontaminate.remove_contaminated(make(spark, texts), bench).collect())
    assert kept == Counter(k[0] for k, c in want.items() for _ in range(c) if not k[-1])
    assert decontaminate.report(make(spark, []), bench).count() == 0
    assert decontaminate.report(make(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0
    plan = decontaminate.report(make(spark, texts), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontamination_by_shuffles(spark, texts, monkeypatch):
    """A benchmark too large for broadcasts: equal results, and no text in the exchange of words."""
    items = [(1, texts[0][1][:200]), (2, texts[0][1][:200]), (10, "W3 w4"), (5, "émile"), (6, " ".join(texts[4][1].split()[-40:-5]))]
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, word string")
    plans, placed = [], decontaminate._placed
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(decontaminate, "_placed", lambda *a: plans.append(placed(*a)) or plans[-1])
    got = decontaminate.report(make(spark, texts), bench).drop("text_hash")
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_hits(texts, items))
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    sent = re.search(r"Exchange hashpartitioning\(shingle#.*?Project \[([^\n]*)\]", plan, re.DOTALL)[1]
    assert "words#" not in re.sub(r"size\(words#\d+(, \w+)?\)", "", sent), sent


def test_a_benchmark_of_common_words_makes_few_candidates(spark):
    rnd = random.Random(6)
    vocab = [f"c{i}" for i in range(30)]
    texts = [(i, " ".join(rnd.choice(vocab) for _ in range(100))) for i in range(200)]
    items = [(i, " ".join(texts[i][1].split()[20:40])) for i in range(5)] + [(9, "c1 c2"), (10, "c3")]
    bench, candidates = spark.createDataFrame(items, "item_id long, text string"), {}
    for shingle in (1, 3):
        scratch = Scratch(spark, "t")
        got = decontaminate.report(make(spark, texts), bench, shingle=shingle, scratch=scratch).drop("text_hash")
        assert Counter(tuple(r) for r in got.collect()) == Counter(brute_hits(texts, items))
        candidates[shingle] = spark.read.parquet(f"{scratch.path}/prefixes").where("len = 13").agg(F.sum("seen")).first()[0]
    assert candidates[3] < 200 < candidates[1] / 50


def test_pieces_bound_batches():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 100})
    cut = list(arrow.pieces([batch], 10_000))
    assert sum(b.num_rows for b in cut) == 100 and max(b.num_rows for b in cut) <= 10
