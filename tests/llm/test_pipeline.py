"""The pipeline's stages, each on its own input, against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import corpus_pipeline
from anchorspark.llm import simhash, substring_dedup
from tests.llm.test_operators import base_stats, brute_fingerprint, brute_hits, brute_removal

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        after = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "quality_rules":
            assert all(base_stats(t)[0] >= 20 for _, t in after) and 0 < len(after) < len(before)
        if name == "simhash_near_dedup":
            fps = [brute_fingerprint(t) for _, t in after]
            assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])
        if name == "substring_dedup":
            want = Counter((i, d) for i, _, _, d in brute_removal(before, 50))
            assert Counter((i, hashlib.sha256(b" ".join(t.encode().split())).hexdigest()) for i, t in after) == want
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if name == "benchmark_decontamination":
            assert {i for i, _ in after} == {h[0] for h in brute_hits(before, items) if not h[-1]}
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in before}
    assert sorted(map(tuple, packed)) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def _prose(seed, n=60):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(500)}" for _ in range(n))


def _brute_kept(rows):
    """(doc_id, text) of the row that stays of each group of linked rows: the smallest doc_id, null the largest."""
    fps, root = [brute_fingerprint(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(rows):
        key = (i is None, i or 0, fps[k] - (fps[k] >> 63 << 64))
        if find(k) not in best or key < best[find(k)][0]:
            best[find(k)] = (key, rows[k])
    return Counter(r for _, r in best.values())


ROWS = [
    (1, _prose(1)), (5, _prose(1)), (5, _prose(2)), (7, _prose(2)), (1, _prose(1)), (None, _prose(1)), (None, _prose(3)), (None, _prose(3)), (None, _prose(4)), (9, _prose(5)), (9, _prose(6)),
    (10, None), (11, ""), (12, " \n"), (13, "a"), (13, "a"), (14, _prose(7, 9000)), (15, _prose(7, 9000) + " end"), (16, "long " * 4000), *((20 + k, _prose(8)) for k in range(30)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string, ROOT int, found string, found_id int, bad_id int, bad_hash string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "f", "r", 1, "x", 2, 3, "h") for i, t in rows], SCHEMA)


def test_one_per_group_keeps_one_row_of_each_group(spark):
    out = simhash.one_per_group(_docs(spark, ROWS).repartition(3))
    assert out.columns == _docs(spark, []).columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == _brute_kept(ROWS)
    five = simhash.one_per_group(_docs(spark, [(1, _prose(1)), (5, _prose(1)), (5, _prose(2)), (7, _prose(2)), (1, _prose(1))]))
    assert sorted((r["doc_id"], r["text"]) for r in five.collect()) == sorted([(1, _prose(1)), (5, _prose(2))])


def test_string_ids(spark):
    rows = [(None if i is None else f"d{i:02d}", t) for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert Counter(tuple(r) for r in substring_dedup.removal_report(docs).collect()) == Counter(brute_removal(rows, 50))
    packed = corpus_pipeline.packed(spark, docs, SF)
    assert Counter(r["doc_id"] for r in packed.where("start = 0").collect()) == Counter(i for i, _ in rows)


def test_stages_take_nulls_repeats_clashes_and_empty_tables(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [*ROWS, (90, f"{_prose(9, 30)} {items[0][1]}"), (91, f"{_prose(11, 120)}\n{_prose(8)}")]
    docs = _docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    passed = [(i, t) for i, t in rows if (s := base_stats(t))[0] >= 20 and 100 * s[4] <= 30 * s[0]]
    one = list(_brute_kept(passed).elements())
    cut = {(i, d) for i, _, _, d in brute_removal(one, 50)}
    bad = {(h[0], h[1]) for h in brute_hits(one, items) if h[-1]}
    want = Counter((i, d) for i, d in cut if not any(i == b for b, _ in bad))
    assert Counter((i, hashlib.sha256(b" ".join(t.encode().split())).hexdigest()) for i, t in left) == want and 90 not in {i for i, _ in left}
    assert corpus_pipeline.packed(spark, docs, SF).where("start = 0").count() == len(left)
    none = _docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
