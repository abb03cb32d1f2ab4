"""Mixing, centroid clustering and the divergence audit against brute force on small tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from anchorspark.llm import divergence, elkan, mixing

DOCS = "doc_id long, text string, lang string, source string, at long, unit string, size string, part long, base string"


def docs_of(spark, rows):
    """rows of (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, 1, "u", "s", 2, "b") for r in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["The", "ÉMILE", "don't", "x9y", "ß"]
    out = []
    for i in range(900):
        source = rnd.choice(["a", "a", "a", "a", "b", "ç", "d", None])
        lang = rnd.choice(["en", "en", "de", None])
        text = " ".join(rnd.choice(vocab[: 40 + 20 * len(source or "abc")]) for _ in range(rnd.choice([1, 5, 30, 60])))
        out.append((i, text, lang, source))
    out += [(900, None, "en", "a"), (901, "", "en", "only empty"), (902, " \t\n", None, None), (None, out[0][1], "en", "a"), (None, out[0][1], "en", "a"), (7, out[7][1], out[7][2], out[7][3]), (903, "word Wörd " * 9000, "en", "b"), (904, None, "no terms", "x"), (905, "rare", "no terms", "y")]
    return out


def plain_targets(sizes, share, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and left * weight[s] / free > most * sizes[s]}
        if not over:
            return {s: Fraction(most * sizes[s]) if s in full else left * weight[s] / free for s in sizes}
        full |= over


def test_mixing(spark, rows):
    size_of = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
    sizes, largest = Counter(), Counter()
    for _, t, _, s in rows:
        sizes[s] += size_of(t)
        largest[s] = max(largest[s], size_of(t))
    for fan_in in (3, 256):
        got = mixing.mix(docs_of(spark, rows), fan_in=fan_in).collect()
        assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size_of(t)) for i, t, _, s in rows)
        want, taken = plain_targets(sizes, Fraction(3, 2), (3, 1, 2), 2), Counter()
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12)
            assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
            taken[r.source] += r.taken
        for s in sizes:
            assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, s


def test_mixing_agrees_over_partitions_and_rounds_fairly(spark):
    rnd = random.Random(5)
    rows = [(i, "w " * rnd.randint(1, 40), "en", "a" if i % 4 else "b") for i in range(400)]
    docs = docs_of(spark, rows)
    once = sorted(mixing.mix(docs.repartition(1), fan_in=16).collect())
    assert once == sorted(mixing.mix(docs.repartition(7), fan_in=16).collect())
    more = defaultdict(list)
    for seed in range(12):
        for r in mixing.mix(docs, seed=seed, fan_in=16).where("source = 'a'").collect():
            more[r.doc_id % 2].append(r.taken / r.size - r.target / r.source_size)
    assert all(abs(np.mean(v)) < 0.05 for v in more.values())  # no document is favoured


def test_mixing_ties_and_empty_tables(spark):
    same = docs_of(spark, [(None, "a b c", "en", "a")] * 700 + [(1, "x", "en", "b")])
    taken = Counter()
    for r in mixing.mix(same, fan_in=8).collect():
        taken[r.source] += r.taken
    assert abs(taken["a"] - (1.5 * 2101 - 2)) <= 1.5 and taken["b"] == 2
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert [tuple(r)[2:] for r in mixing.mix(docs_of(spark, [(1, None, "en", None), (2, "", "en", None)])).collect()] == [(0, 0, 0.0, 0, 0)] * 2


def plain_clusters(vectors, k, rounds):
    kept = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in vectors if v is not None and len(v) == 4 and all(c is not None and np.isfinite(c) for c in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in seeds[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, x in kept:
            of[nearest(x)[1]].append(x)
        centroids = [[sum(col) // len(of[n]) for col in zip(*of[n], strict=True)] if of[n] else c for n, c in enumerate(centroids)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = Counter()
    for _, n, d in found:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, n, d in found)


def vectors_of(spark, vectors):
    return spark.createDataFrame([(i, v, "c", "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, cluster string, x string, lower long")


def test_clusters(spark):
    rnd = random.Random(2)
    grid = [(i, [rnd.choice([-0.25, 0.0, 0.125, 0.5]) for _ in range(4)]) for i in range(300)]  # many ties and equal vectors
    wide = [(1000 + i, [rnd.gauss(c, 0.2) for _ in range(4)]) for i in range(300) for c in [rnd.choice([-3, 0, 2])]]
    odd = [(2000, None), (2001, []), (2002, [0.1, None, 0.2, 0.3]), (2003, [float("nan")] * 4), (2004, [float("inf")] * 4), (2005, [0.1] * 3), (None, [0.1] * 4), (None, [0.2] * 4), (5, [0.2] * 4)]
    for vectors, k in ((grid + odd, 7), (grid + wide, 12), (grid[:3], 16), (odd, 5)):
        as_floats = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in vectors]
        got = Counter(tuple(r) for r in elkan.cluster(vectors_of(spark, vectors), k=k, rounds=3, width=4).collect())
        assert got == plain_clusters(as_floats, k, 3)
    assert elkan.cluster(vectors_of(spark, odd[:5]), k=3, width=4).count() == 0


def test_bounds_skip_distances_and_keep_ties():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-40, 40, (2000, 8)) + c for c in (-900, 0, 900)]).astype(np.int64)
    centroids = x[[5, 10, 2100, 2200, 4100, 4200, 4200]].copy()  # two are equal
    near, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros((len(x), 7))
    counts = []
    for _ in range(5):
        counts.append(elkan.assign(x, near, upper, lower, centroids))
        all_d = ((x[:, None] - centroids[None]) ** 2).sum(2)
        assert (near == all_d.argmin(1)).all()
        d = np.sqrt(all_d.astype(float))
        assert (lower <= d).all() and (upper >= d[np.arange(len(x)), near]).all()
        after = np.array([x[near == c].sum(0) // max(1, (near == c).sum()) if (near == c).any() else centroids[c] for c in range(7)])
        upper, lower = elkan.moved(upper, lower, near, centroids, after)
        upper, lower = np.nextafter(upper.astype(np.float32), np.float32(np.inf)).astype(float), np.maximum(np.nextafter(lower.astype(np.float32), np.float32(-np.inf)), 0).astype(float)
        centroids = after
    assert counts[0] < 0.75 * x.shape[0] * 7 and counts[-1] < 0.5 * x.shape[0] * 7


def test_too_wide_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        elkan.cluster(vectors_of(spark, [(1, [1e12] * 4)]), k=1, width=4).collect()


def plain_audit(rows, least_docs, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in t or ""))
    docs, counts, groups = Counter(), defaultdict(Counter), set()
    for _, t, lang, source in rows:
        lang, source, found = lang or "", source or "", terms(t)
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs.update((lang, w) for w in set(found))
    out = []
    for lang, source in groups:
        kept = [w for (g, w), n in docs.items() if g == lang and n >= least_docs]
        of_lang = Counter()
        for g, c in counts.items():
            if g[0] == lang:
                of_lang.update({w: c[w] for w in kept})

        def share(c, kept=kept):
            total = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p, q = share(counts[lang, source]), share(of_lang)
        others = [(-sum(abs(p[w] - share(counts[lang, s])[w]) for w in kept), s.encode(), s) for g, s in groups if g == lang and s != source]
        likelier = [(q[w] - p[w], w.encode(), w) for w in kept if counts[lang, source][w] and p[w] > q[w]]
        out += [(lang, source, "pair", s, -v, n) for n, (v, _, s) in enumerate(sorted(others), 1)]
        out += [(lang, source, "term", w, -v, n) for n, (v, _, w) in enumerate(sorted(likelier)[:top], 1)]
    return Counter(out)


@pytest.mark.parametrize(("least", "top", "block", "chunk"), [(30, 50, 256, 512), (5, 3, 2, 7), (1, 4, 1, 1000)])
def test_audit(spark, rows, least, top, block, chunk):
    got = divergence.audit(docs_of(spark, rows), least_docs=least, top=top, sources_a_block=block, terms_a_chunk=chunk)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == plain_audit(rows, least, top)


def test_audit_of_nothing_and_of_long_texts(spark, monkeypatch):
    assert divergence.audit(docs_of(spark, [])).count() == 0
    monkeypatch.setattr(divergence, "_PIECE", 10)
    text = "Ab cd éf9gh " * 500
    assert [w.decode() for part in divergence._terms(text.encode()) for w in part] == ["ab", "cd", "éf", "gh"] * 500
