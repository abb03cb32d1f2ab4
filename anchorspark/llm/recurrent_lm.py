"""Language-model scores of whole documents by a gated recurrent network.

Words are counted over all training documents, and nothing else of the corpus
chooses the model: held-out texts are only scored.  The frequent words, in
classes by rank, are the network's vocabulary; its output is a softmax over
classes times one within the class, both started from the counts.
A rarer word has the probability of the "rare" symbol times its smoothed share
of the rare words.  Scoring carries the state across windows to the end of each
document.

Training takes every token of every training document once, by truncated
backpropagation.  A hash of its id and text deals each document to a round and,
within it, to a run of about as many tokens as the others; each run trains a
model from the last round's weights, and their mean, by tokens, is the next
round's start.  The order within a run is that of the hashes, so the schedule
doesn't depend on files, partitions or executors.

Defined results: a null or empty text is its end alone; a null doc_id counts as
the text ""; repeated rows are trained on and scored each; a text of any length
is taken whole; words of equal counts rank in byte order; an empty table gives
an empty table; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import coded_words, pieces
from .scratch import Scratch

END, RARE = 0, 1  # ids of the two symbols; the words follow
_ROW = 4096  # parameters a row, when models are added up


@dataclass(frozen=True)
class Shape:
    """The network's sizes; class k holds the ids from starts[k] to starts[k + 1]."""

    starts: tuple[int, ...]
    hidden: int

    @staticmethod
    def of(counts: np.ndarray, classes: int, hidden: int) -> Shape:
        """END and RARE are classes of their own; the words, by rank, are cut where the sum of their counts' roots is, which makes frequent classes small."""
        root = np.cumsum(np.sqrt(np.asarray(counts[2:], np.float64) + 1))
        cuts = np.searchsorted(root, root[-1] * np.arange(1, classes - 2) / (classes - 2)) + 3 if len(root) else []
        return Shape(tuple(sorted({0, 1, 2, len(counts), *(int(x) for x in cuts if x < len(counts))})), hidden)

    @property
    def words(self) -> int:
        return self.starts[-1]

    @cached_property
    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def sizes(self) -> dict[str, tuple[int, ...]]:
        v, h, k = self.words, self.hidden, len(self.starts) - 1
        return {"x": (v, 3 * h), "wh": (h, 3 * h), "wc": (h, k), "bc": (k,), "wo": (h, v), "bo": (v,)}


def pack_params(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in p.values()])


def unpack_params(flat: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shape.sizes().items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def initial(counts: np.ndarray, shape: Shape, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights; output biases from the counts, so that training starts at the unigram model."""
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 0.08, s).astype(np.float32) for k, s in shape.sizes().items()}
    counts = np.asarray(counts, np.float64) + 1e-3
    by_class = np.add.reduceat(counts, shape.starts[:-1])
    p["bo"] = np.log(counts / by_class[shape.class_of]).astype(np.float32)
    p["bc"] = np.log(by_class / by_class.sum()).astype(np.float32)
    p["wc"] *= 0.1
    p["wo"] *= 0.1
    return p


def _step(p: dict, h: np.ndarray, x: np.ndarray):
    """One gated step from the states and their inputs' rows: the new states, the gates, the candidates and what the reset gate weighs."""
    n = h.shape[1]
    b = h @ p["wh"]
    gates = x[:, : 2 * n] + b[:, : 2 * n]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    c = gates[:, n:] * b[:, 2 * n :]
    c += x[:, 2 * n :]
    np.tanh(c, out=c)
    new = c - h
    new *= gates[:, :n]
    new += h
    return new, gates, c, b[:, 2 * n :]


def _logits(h: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """States are between -1 and 1, so only large weights can make logits that exp does not take; then the rows' largest is taken off."""
    out = h @ w
    out += b
    if np.abs(w).sum(axis=0).max() + np.abs(b).max() > 60:
        out -= out.max(axis=1, keepdims=True)
    return out


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


def _by_class(target: np.ndarray, shape: Shape):
    """The order of rows by class, and (ids, first row, end row, place in the class) of classes of two and more."""
    k = shape.class_of[target]
    order = np.argsort(k, kind="stable")
    cut, sorted_targets, found = np.searchsorted(k[order], np.arange(len(shape.starts))), target[order], []
    for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        first, end = shape.starts[i : i + 2]
        if a < b and end - first > 1:
            found.append((slice(first, end), a, b, sorted_targets[a:b] - first))
    return k, order, found


def log_likelihood(p: dict, h: np.ndarray, target: np.ndarray, shape: Shape) -> np.ndarray:
    """ln P(target | state) for each row."""
    k, order, found = _by_class(target, shape)

    def log_share(x: np.ndarray, place: np.ndarray) -> np.ndarray:
        picked = x[np.arange(len(place)), place]
        return picked - np.log(_row_sums(np.exp(x, out=x)))

    out, by_class = log_share(_logits(h, p["wc"], p["bc"]), k).astype(np.float64), h[order]
    for ids, a, b, place in found:
        out[order[a:b]] += log_share(_logits(by_class[a:b], p["wo"][:, ids], p["bo"][ids]), place)
    return out


def _add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """total[at] += rows, with repeats in at."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    total[at[first]] += np.add.reduceat(rows[order], first, axis=0)


def _gradients(p: dict, h0: np.ndarray, source: np.ndarray, target: np.ndarray, shape: Shape, real: np.ndarray | None = None):
    """Gradients of the mean loss over a window (steps, streams), the last state; nothing flows back beyond the window.

    real marks the targets that count; the others fill up the streams' ends.
    """
    steps, streams = source.shape
    n = shape.hidden
    x, live = p["x"][source], (source != END)[:, :, None].astype(h0.dtype)  # each document starts afresh
    before, states, cand, inner = (np.empty((steps, streams, n), h0.dtype) for _ in range(4))
    gates, hidden = np.empty((steps, streams, 2 * n), h0.dtype), h0
    for t in range(steps):
        before[t] = hidden * live[t]
        hidden, gates[t], cand[t], inner[t] = _step(p, before[t], x[t])
        states[t] = hidden
    flat, goal = states.reshape(-1, n), target.ravel()
    share = np.full(len(goal), 1 / len(goal), flat.dtype) if real is None else (real.ravel() / max(1, real.sum())).astype(flat.dtype)
    k, order, found = _by_class(goal, shape)

    def loss_by_logit(e: np.ndarray, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
        np.exp(e, out=e)
        e *= (weight / _row_sums(e))[:, None]
        e[np.arange(len(place)), place] -= weight
        return e

    d = loss_by_logit(_logits(flat, p["wc"], p["bc"]), k, share)
    g = {"wc": flat.T @ d, "bc": d.sum(axis=0), "wo": np.zeros_like(p["wo"]), "bo": np.zeros_like(p["bo"])}
    back, by_class, back_by_class, weight = d @ p["wc"].T, flat[order], np.zeros_like(flat), share[order]
    for ids, a, b, place in found:
        e = loss_by_logit(_logits(by_class[a:b], p["wo"][:, ids], p["bo"][ids]), place, weight[a:b])
        g["wo"][:, ids], g["bo"][ids] = by_class[a:b].T @ e, e.sum(axis=0)
        back_by_class[a:b] = e @ p["wo"][:, ids].T
    back[order] += back_by_class
    back, z, r = back.reshape(steps, streams, n), gates[:, :, :n], gates[:, :, n:]
    by_cand, by_update, by_reset, rest = z * (1 - cand * cand), (cand - before) * z * (1 - z), inner * r * (1 - r), 1 - z
    dx, dh, out = np.empty((steps, streams, 3 * n), flat.dtype), np.zeros((streams, n), flat.dtype), p["wh"].T.copy()
    db = np.empty_like(dx)
    for t in reversed(range(steps)):
        dh += back[t]
        dx[t, :, :n] = dh * by_update[t]
        dc = dh * by_cand[t]
        dx[t, :, 2 * n :] = dc
        dx[t, :, n : 2 * n] = dc * by_reset[t]
        db[t] = dx[t]
        db[t, :, 2 * n :] *= r[t]
        dh *= rest[t]
        dh += db[t] @ out
        dh *= live[t]
    g["wh"], g["x"] = before.reshape(-1, n).T @ db.reshape(-1, 3 * n), np.zeros_like(p["x"])
    _add_rows(g["x"], source.ravel(), dx.reshape(-1, 3 * n))
    return g, hidden


def train(p: dict, ids: np.ndarray, shape: Shape, streams: int = 512, steps: int = 16, rate: float = 0.01, last_rate: float = 0.002) -> dict:
    """One pass of Adam over a run, END and then documents each ended by END: every id but the first is a target once."""
    p = {k: a.copy() for k, a in p.items()}
    targets = len(ids) - 1
    if targets < 1:
        return p
    streams = max(1, min(streams, targets // (4 * steps)))
    n = -(-targets // streams)
    real = np.arange(streams * n) < targets
    source, target = (np.concatenate((x, np.full(streams * n - targets, END, x.dtype))).reshape(streams, n).T for x in (ids[:-1], ids[1:]))
    real = real.reshape(streams, n).T
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    hidden = np.zeros((streams, shape.hidden), np.float32)
    for i, at in enumerate(range(0, n, steps), 1):
        here = slice(at, at + steps)
        g, hidden = _gradients(p, hidden, source[here], target[here], shape, real[here])
        now = rate + (last_rate - rate) * at / n
        step, grown = now / (1 - 0.9**i), (1 - 0.99**i) ** -0.5
        for k, a in p.items():
            m[k] *= 0.9
            m[k] += 0.1 * g[k]
            v[k] *= 0.99
            v[k] += 0.01 * (g[k] * g[k])
            a -= step * m[k] / (grown * np.sqrt(v[k]) + 1e-6)
    return p


def score_batch(p: dict, docs: list[np.ndarray], shape: Shape, most_rows: int = 16_384) -> np.ndarray:
    """ln P of each document (ids ended by END), all of a batch side by side, the longest first."""
    size = np.array([len(d) for d in docs])
    order = np.argsort(-size, kind="stable")
    size, flat = size[order], np.concatenate([docs[i] for i in order])
    start = np.cumsum(size) - size
    total, hidden = np.zeros(len(docs)), np.zeros((len(docs), shape.hidden), np.float32)
    states, targets, owners, held = [], [], [], 0
    active = len(docs)
    for t in range(int(size[0])):
        while size[active - 1] <= t:
            active -= 1
        here = start[:active] + t
        before = flat[here - 1] if t else np.full(active, END)
        hidden[:active] = _step(p, hidden[:active], p["x"][before])[0]
        states.append(hidden[:active].copy())
        targets.append(flat[here])
        owners.append(np.arange(active))
        held += active
        if held >= most_rows or t + 1 == size[0]:
            got = log_likelihood(p, np.concatenate(states), np.concatenate(targets), shape)
            total += np.bincount(np.concatenate(owners), weights=got, minlength=len(docs))
            states, targets, owners, held = [], [], [], 0
    out = np.empty(len(docs))
    out[order] = total
    return out


def count_words(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(word, train): each task adds up its batches' counts and gives them out whenever they are many."""

    def run(batches):
        parts: list[pa.Table] = []

        def merged() -> pa.Table:
            got = pa.concat_tables(parts).group_by("word").aggregate([("train", "sum")]).select(["word", "train_sum"]).rename_columns(["word", "train"])
            parts[:] = [got]
            return got

        for batch in pieces(batches, 8 << 20):
            coded, _ = coded_words(batch.column(0))
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            some = pa.table({"word": pc.ascii_lower(coded.dictionary).cast(pa.string()), "train": pa.array(n, pa.int64())})
            parts.append(some.filter(pc.not_equal(some["word"], "")))
            if sum(map(len, parts)) > 3 * most and len(merged()) > most:
                yield from parts[0].to_batches(max_chunksize=50_000)
                parts.clear()
        if parts:
            yield from merged().to_batches(max_chunksize=50_000)

    rows = docs.select("text").mapInArrow(run, "word string, train long")
    return rows.groupBy("word").agg(F.sum("train").alias("train"))


class Encoder:
    """Words to ids; head words beyond the network's vocabulary are rare but their counts are at hand."""

    def __init__(self, head: list[tuple[str, int]], ends: int, most: int):
        words = [w.encode() for w, _ in head]
        self.place = {w: i for i, w in enumerate(words)}
        self.net = min(len(words), most - 2)
        self.log_count = np.log10(np.array([*(c for _, c in head), 0, ends], np.float64) + 1)  # then: not in the head, end
        self.known = np.array([*(c > 0 for _, c in head), False, ends > 0])
        self.id_of = np.concatenate((np.arange(2, self.net + 2), np.full(len(words) - self.net + 1, RARE), [END])).astype(np.int16)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Head places of all texts' words, each text followed by its end's place; where each text stops; the words not in the head (null elsewhere)."""
        n = len(self.place)
        coded, edge = coded_words(texts)
        raw = coded.dictionary.cast(pa.large_binary())
        lowered = b"\n".join(raw.to_numpy(zero_copy_only=False).tolist()).lower().split(b"\n") if len(raw) else []
        get = self.place.get
        at = np.fromiter((-1 if not w else get(w, n) for w in lowered), np.int64, len(lowered))
        which = coded.indices.to_numpy()
        places = at[which]
        real = places >= 0  # white space at either end of a text leaves an empty word
        stop = np.concatenate(([0], np.cumsum(real)))[edge]
        tail = pa.array(lowered, pa.binary()).take(pa.array(np.where(places == n, which, 0)[real], mask=(places != n)[real]))
        places = np.insert(places[real], stop[1:], n + 1)
        return places, stop[1:] + np.arange(1, len(stop)), tail


def _head(words: DataFrame, most: int) -> list[tuple[str, int]]:
    """At most so many words, the most frequent in training documents, with their counts.

    Frequency goes in steps of a twelfth of an octave: the words of the highest
    steps that fit are taken, so the driver gets no more than most rows.
    """
    step = F.floor(F.log2("train") * 12).cast("int")
    sizes, cut, n = sorted(((r["step"], r["count"]) for r in words.groupBy(step.alias("step")).count().collect()), reverse=True), None, 0
    for at, size in sizes:
        if n + size > most:
            break
        cut, n = at, n + size
    if cut is None:
        return []
    rows = words.where(step >= cut).collect()
    return [(r["word"], r["train"]) for r in sorted(rows, key=lambda r: (-r["train"], r["word"].encode()))]


def encode(docs: DataFrame, encoder: Encoder) -> DataFrame:
    """doc_id, held_out, key, ids (int16, little-endian) and what the scores need of the words beyond the network's."""

    def run(batches):
        for batch in pieces(batches, 8 << 20):
            places, stop, tail = encoder.batch(batch.column(3))
            begin = np.concatenate(([0], stop[:-1]))
            ids, logs, rare = encoder.id_of[places], encoder.log_count[places], (places >= encoder.net) & (places <= len(encoder.place))
            total = lambda x: np.add.reduceat(x, begin)  # noqa: E731,B023  every text has its end, so none is empty
            data, words_at = ids.tobytes(), stop - np.arange(1, len(stop) + 1)
            tails = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], words_at)), pa.int32()), tail.cast(pa.string()))
            columns = [pa.array([data[2 * a : 2 * b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], pa.binary()), pa.array(stop - begin), pa.array(total(encoder.known[places].astype(np.int64))), pa.array(total(logs)), pa.array(total(np.where(rare, logs, 0.0))), pa.array(total(rare.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns, _without_nulls(tails)], ["doc_id", "held_out", "key", "ids", "n_tokens", "n_known", "logs", "rare_logs", "n_rare", "tail"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, key long, ids binary, n_tokens long, n_known long, logs double, rare_logs double, n_rare long, tail array<string>")


def _without_nulls(lists: pa.ListArray) -> pa.ListArray:
    real = lists.values.is_valid()
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return pa.ListArray.from_arrays(pa.array(before[np.asarray(lists.offsets)], pa.int32()), lists.values.drop_null())


def _train_round(coded: DataFrame, params: dict, shape: Shape, runs: int, run_tokens: int) -> dict:
    """The mean, by tokens, of the models that the runs of one round train."""

    def run(batches):
        name, held, size, made = None, [np.array([END], np.int16)], 0, 0

        def finish():
            nonlocal held, size, made
            flat = pack_params(train(params, np.concatenate(held).astype(np.int64), shape))
            rows = [flat[i : i + _ROW].astype(np.float64) * size for i in range(0, len(flat), _ROW)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array([name] * len(rows), pa.int64()), pa.array([made] * len(rows), pa.int64()), pa.array([float(size)] * len(rows)), pa.array(rows, pa.list_(pa.float64()))], ["row", "run", "part", "weight", "sums"])
            held, size, made = [np.array([END], np.int16)], 0, made + 1

        for batch in batches:
            for which, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if size and (which != name or size >= 2 * run_tokens):  # a crowded run trains several models
                    yield from finish()
                if which != name:
                    name, made = which, 0
                held.append(np.frombuffer(ids.as_buffer(), np.int16))
                size += len(held[-1])
        if size:
            yield from finish()

    def add(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for row, weight, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                sums = sums.values.to_numpy()
                if row in total:
                    total[row][0] += weight
                    total[row][1] += sums
                else:
                    total[row] = [weight, sums.copy()]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([w for w, _ in total.values()]), pa.array([p for _, p in total.values()], pa.list_(pa.float64()))], ["row", "weight", "sums"])

    n_rows = -(-len(pack_params(params)) // _ROW)
    dealt = coded.select(F.pmod(F.shiftright("key", 8), F.lit(runs)).cast("int").alias("run"), "ids", "key", "doc_id").repartitionById(runs, "run").sortWithinPartitions("run", "key", "doc_id", "ids")
    models = dealt.select("run", "ids").mapInArrow(run, "row long, run long, part long, weight double, sums array<double>")
    models = models.repartitionById(n_rows, F.col("row").cast("int")).sortWithinPartitions("row", "run", "part").select("row", "weight", "sums")
    parts = models.mapInArrow(add, "row long, weight double, sums array<double>").collect()
    if not parts:
        return params
    return unpack_params(np.concatenate([np.array(r["sums"]) / r["weight"] for r in sorted(parts, key=lambda r: r["row"])]), shape)


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def score_documents(docs: DataFrame, words: int = 2048, classes: int = 40, hidden: int = 16, head_words: int = 65_536, rounds: int = 4, run_tokens: int = 1_500_000, folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    The network has so many ids, in so many classes.  head_words bounds what the
    driver collects and each task holds; run_tokens is about what one model of a round trains on, so that runs grow in number,
    not in size, with the corpus.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id"), folds, fold).alias("held_out"))
    counts = scratch.table(count_words(docs.where("not held_out")), "words")
    ends = docs.where("not held_out").count()
    total = counts.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count("*")).first()
    n_train, n_distinct = total[0] + ends, total[1] + (ends > 0)
    head = _head(counts, head_words)
    encoder = Encoder(head, ends, words)
    in_net = sum(c for _, c in head[: encoder.net])
    rare_tokens, rare_words = n_train - ends - in_net, n_distinct - (ends > 0) - encoder.net
    in_order = np.array([ends, rare_tokens, *(c for _, c in head[: encoder.net])], np.float64)
    shape = Shape.of(in_order, classes, hidden)
    params = initial(in_order, shape)
    coded = scratch.table(encode(docs, encoder), "coded")
    runs = max(1, round(n_train / (rounds * run_tokens)))
    for k in range(rounds):
        params = _train_round(coded.where(~F.col("held_out") & (F.pmod("key", F.lit(rounds)) == k)), params, shape, runs, run_tokens)

    def run(batches):
        for batch in pieces(batches, 8 << 20):
            ln = score_batch(params, [np.frombuffer(x.as_buffer(), np.int16) for x in batch.column(0)], shape)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ln / np.log(10))], [*batch.schema.names[1:], "net"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = coded.drop("key").select("ids", *(c for c in coded.columns if c not in ("ids", "key")))
    scored = scored.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, rare_logs double, n_rare long, tail array<string>, net double")
    scored = scratch.table(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    scratch.drop("coded")
    tails = scored.select("row", F.explode("tail").alias("word")).join(counts, "word")
    tails = tails.groupBy("row").agg(F.sum(F.log10(F.col("train") + 1)).alias("more"), F.count("*").alias("found"))
    more, found = F.coalesce("more", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return scored.join(tails, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + found).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * float(np.log10(n_train + n_distinct + 1))).alias("base_score"),
        (F.col("net") + F.col("rare_logs") + more - F.col("n_rare") * float(np.log10(rare_tokens + rare_words + 1))).alias("score"),
    )
