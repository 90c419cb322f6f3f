"""A hidden Markov language model: Baum-Welch counts summed over partitions, scaled forward recursion for exact likelihood.

Tokens are lower-cased words and one end for each text. The model emits the CLASSES most frequent tokens one by one and all others as
one class, in which a token has the share (c + 1) / (tokens + types + 1) of the class's counts; so it gives every text a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import common as C
from pairloom.llm import text as T

#: Latent states; tokens with emissions of their own (with end and other, at most 2**16); rounds of Baum-Welch.
STATES, CLASSES, ROUNDS = 8, 1 << 14, 3
#: Token types whose counts every worker holds (12 MB); counts of rarer ones are joined.
TYPES = 1 << 19
#: Tokens of a stretch that is one training sequence; tokens that are worked on together.
STRETCH, TOGETHER = 1024, 1 << 18
#: Added to expected counts.
SMOOTHING = 0.01


def tokens_of(texts: list[bytes]) -> T.Words:
    return T.Words([t.lower() for t in texts])


def count_types(docs: DataFrame) -> DataFrame:
    """(h, c): each word type by its 64-bit hash, and its count in the texts. Stored."""

    def run(batches):
        held, size = [], 0

        def merged():
            h, c = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            o = np.argsort(h)
            h, c = h[o], c[o]
            new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            return h[new], np.add.reduceat(c, new)

        for batch in batches:
            texts = C.pylist(batch, "text")
            for a, b in T.chunks(texts):
                h, c = np.unique(tokens_of(texts[a:b]).hash, return_counts=True)
                held.append((h, c))
                size += len(h)
                if size > 1 << 20:
                    held = [merged()]
                    size = 0
                    if len(held[0][0]) > 1 << 20:
                        yield pa.RecordBatch.from_pydict({"h": held[0][0].view(np.int64), "c": held[0][1]})
                        held = []
        if held:
            h, c = merged()
            yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "c": c})

    return C.stored(docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "types")


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent types, descending, at most `most`: all above a count at which a histogram of
    logarithms (a few thousand rows) says that so many are left. Only these come to the driver, as Arrow."""
    step = F.floor(F.log2("c") * 64).cast("int")
    left, low = most, None
    for r in sorted(counts.groupBy(step.alias("b")).count().collect(), key=lambda r: -r["b"]):
        if r["count"] > left:
            break
        left, low = left - r["count"], r["b"]
    if low is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    top = counts.where(step >= low).select("h", "c").toArrow()
    h, c = top["h"].to_numpy().astype(np.int64), top["c"].to_numpy().astype(np.int64)
    o = np.lexsort((h, -c))
    return h[o].view(np.uint64), c[o]


def encode(rows: DataFrame, top_h: np.ndarray, top_c: np.ndarray, classes: int, ends: int) -> DataFrame:
    """Per row: rid, n (tokens), ids (classes of its tokens, 16 bits each), known, base_log, other_log over the tokens whose counts are at hand, and the hashes of the rest."""
    o = np.argsort(top_h)
    rank = np.argsort(-top_c, kind="stable")
    own = np.full(len(top_h), classes - 1, dtype=np.uint16)
    own[rank[: classes - 2]] = np.arange(min(classes - 2, len(rank)), dtype=np.uint16)
    shared = rows.sparkSession.sparkContext.broadcast((top_h[o], np.log10(top_c[o] + 1.0), own[o]))

    def run(batches):
        hashes, logs, ids = shared.value
        end = np.array([classes - 2], dtype=np.uint16).tobytes()
        for batch in batches:
            texts = C.pylist(batch, "text")
            for a, b in T.chunks(texts):
                w = tokens_of(texts[a:b])
                at = np.minimum(np.searchsorted(hashes, w.hash), max(0, len(hashes) - 1))
                hit = hashes[at] == w.hash if len(hashes) else np.zeros(len(w), dtype=bool)
                code = np.where(hit, ids[at], np.uint16(classes - 1)).astype(np.uint16) if len(hashes) else np.full(len(w), classes - 1, dtype=np.uint16)
                log = np.where(hit, logs[at], 0.0) if len(hashes) else np.zeros(len(w))
                total = lambda x: np.bincount(w.doc, weights=x, minlength=b - a)
                out = {
                    "doc_id": batch.column("doc_id").slice(a, b - a),
                    "held_out": batch.column("held_out").slice(a, b - a),
                    "n": np.diff(w.first) + 1,
                    "known": total(hit).astype(np.int64) + (ends > 0),
                    "base_log": total(log) + np.log10(ends + 1.0),
                    "other_log": total(log * (code == classes - 1)),
                    "ids": [code[i:j].tobytes() + end for i, j in zip(w.first[:-1], w.first[1:])],
                    "rest": [w.hash[i:j][~hit[i:j]].view(np.int64).tolist() for i, j in zip(w.first[:-1], w.first[1:])],
                }
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("base_log", pa.float64()), ("other_log", pa.float64()), ("ids", pa.binary()), ("rest", pa.list_(pa.int64()))]))

    out = rows.mapInArrow(run, "doc_id long, held_out boolean, n long, known long, base_log double, other_log double, ids binary, rest array<long>")
    return C.stored(out.withColumn("rid", F.monotonically_increasing_id()), "encoded")


class Batch:
    """Sequences of classes by descending length, laid out step by step: step t has the tokens of the alive[t] longest."""

    def __init__(self, seqs: list[np.ndarray], starts: np.ndarray):
        self.order = np.argsort([-len(s) for s in seqs], kind="stable")
        self.size = np.array([len(s) for s in seqs])[self.order]
        self.starts = starts[self.order]
        flat = np.concatenate([seqs[i] for i in self.order])
        first = np.concatenate(([0], np.cumsum(self.size)))
        step = np.arange(len(flat)) - np.repeat(first[:-1], self.size)
        o = np.argsort(step, kind="stable")
        self.token = flat[o].astype(np.int64)
        self.alive = np.bincount(step)
        self.at = np.concatenate(([0], np.cumsum(self.alive)))

    def forward(self, pi: np.ndarray, a: np.ndarray, b: np.ndarray, keep: bool = False):
        """Log likelihood (natural) of each sequence in the given order, and scaled alphas, emissions and scales. pi: a row for each kind of start."""
        e = b[self.token]
        scale = np.empty(len(e))
        alphas = np.empty_like(e) if keep else None
        x = None
        for t, m in enumerate(self.alive.tolist()):
            k = self.at[t]
            x = (pi[self.starts] if t == 0 else x[:m] @ a) * e[k : k + m]
            s = x.sum(1)
            x /= s[:, None]
            scale[k : k + m] = s
            if keep:
                alphas[k : k + m] = x
        row = np.arange(len(scale)) - np.repeat(self.at[:-1], self.alive)
        logs = np.empty(len(self.size))
        logs[self.order] = np.bincount(row, weights=np.log(scale), minlength=len(self.size))
        return logs, alphas, e, scale

    def counts(self, pi: np.ndarray, a: np.ndarray, b: np.ndarray):
        """Expected counts: of starts by kind, transitions, emissions (classes by states), and the log likelihood."""
        logs, alpha, e, scale = self.forward(pi, a, b, keep=True)
        e /= scale[:, None]
        pairs, beta, m = np.zeros_like(a), np.ones((0, a.shape[0])), 0
        gamma = alpha
        for t in range(len(self.alive) - 1, -1, -1):
            k, n = self.at[t], self.alive[t]
            now = np.ones((n, a.shape[0]))
            if m:
                y = e[k + n : k + n + m] * beta
                pairs += alpha[k : k + m].T @ y
                now[:m] = y @ a.T
            gamma[k : k + n] *= now  # alpha of this step is not needed any more
            beta, m = now, n
        begin = np.zeros_like(pi)
        np.add.at(begin, self.starts, gamma[: self.alive[0]] if len(self.alive) else gamma[:0])
        emit = np.stack([np.bincount(self.token, weights=gamma[:, s], minlength=b.shape[0]) for s in range(a.shape[0])], axis=1)
        return begin, pairs * a, emit, logs.sum()


def batches_of(seqs: list[np.ndarray], starts: np.ndarray):
    """Sequences of about the same length together."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    a = size = 0
    for k, i in enumerate(order):
        if size and size + len(seqs[i]) > TOGETHER:
            yield order[a:k], Batch([seqs[j] for j in order[a:k]], starts[order[a:k]])
            a, size = k, 0
        size += len(seqs[i])
    if order:
        yield order[a:], Batch([seqs[j] for j in order[a:]], starts[order[a:]])


def sequences(raw: list[bytes], stretch: int | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Token classes of each text, whole or in stretches; and whether a sequence begins its text (0) or continues it (1)."""
    seqs, starts = [], []
    for r in raw:
        ids = np.frombuffer(r, dtype=np.uint16)
        cut = [ids[i : i + stretch] for i in range(0, len(ids), stretch)] if stretch else [ids]
        seqs += cut
        starts += [0] + [1] * (len(cut) - 1)
    return seqs, np.array(starts, dtype=np.int64)


def train(encoded: DataFrame, class_counts: np.ndarray, states: int, rounds: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """pi (2 kinds of start), transitions, emissions (classes by states) and the log likelihood before each round.

    Each round is one pass over all training texts; tasks sum expected counts, Spark adds them up by class, and the driver gets a row for each
    class (a bounded number). The beginning is the distribution of all tokens, bent for each state by seeded noise, with sticky states.
    """
    classes = len(class_counts)
    rng = np.random.default_rng(seed)
    b = (class_counts[:, None] + SMOOTHING) * rng.gamma(1.0, size=(classes, states))
    b /= b.sum(0)
    a = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    a /= a.sum(1, keepdims=True)
    pi, history = np.full((2, states), 1 / states), []
    sums = [F.sum(F.col("v")[s]).alias(f"s{s}") for s in range(states)]
    for _ in range(rounds):
        model = encoded.sparkSession.sparkContext.broadcast((pi, a, b))

        def run(batches, model=model):
            pi, a, b = model.value
            total = [np.zeros_like(pi), np.zeros_like(a), np.zeros_like(b), 0.0]
            for batch in batches:
                for _, own in batches_of(*sequences(batch.column("ids").to_pylist(), STRETCH)):
                    for k, x in enumerate(own.counts(pi, a, b)):
                        total[k] = total[k] + x
            rows = np.concatenate((total[2], total[0], total[1], np.full((1, states), total[3])))
            keys = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(rows[keys].ravel()), states).cast(pa.list_(pa.float64()))], names=["k", "v"])

        got = encoded.where("NOT held_out").select("ids").mapInArrow(run, "k int, v array<double>").groupBy("k").agg(*sums).toPandas()
        rows = np.zeros((classes + 2 + states + 1, states))
        rows[got["k"]] = got[[f"s{s}" for s in range(states)]]
        b = rows[:classes] + SMOOTHING * (class_counts[:, None] + SMOOTHING) / (class_counts.sum() + SMOOTHING * classes)
        b /= b.sum(0)
        pi = rows[classes : classes + 2] + SMOOTHING
        pi /= pi.sum(1, keepdims=True)
        a = rows[classes + 2 : -1] + SMOOTHING
        a /= a.sum(1, keepdims=True)
        history.append(float(rows[-1, 0]))
    return pi, a, b, history


def score(docs: DataFrame, states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS, types: int = TYPES, divisor: int = 7, fold: int = 2) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams, add one) and score, log10 of the text's probability.

    Null and empty texts are one end. All counts cover all training texts; rows of one identifier are scored one by one. Without training
    texts nothing is known and the model is uniform over its classes. A null doc_id counts as an empty one.
    """
    spark = docs.sparkSession
    C.arrow_rows(spark)
    classes = min(classes, 1 << 16)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (C.crc_mod(F.col("doc_id"), divisor) == fold).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counts = count_types(rows.where("NOT held_out"))
    ends = rows.where("NOT held_out").count()
    all_ = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (all_["n"] or 0) + ends, all_["v"] + (ends > 0)
    top_h, top_c = frequent(counts, types)
    class_counts = np.zeros(classes)
    class_counts[: len(top_c[: classes - 2])] = top_c[: classes - 2]
    class_counts[classes - 2], class_counts[classes - 1] = ends, n - ends - class_counts.sum()
    other = class_counts[classes - 1] + (v - (ends > 0) - len(top_c[: classes - 2])) + 1
    encoded = encode(rows, top_h, top_c, classes, ends)
    pi, a, b, _ = train(encoded, class_counts, states, rounds)
    rest = encoded.select("rid", F.explode("rest").alias("h"))
    rest = rest.groupBy("rid", "h").agg(F.count("*").alias("k")).join(counts, "h").groupBy("rid").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("more_log"))
    model = spark.sparkContext.broadcast((pi, a, b))

    def run(batches):
        pi, a, b = model.value
        for batch in batches:
            logs = np.zeros(batch.num_rows)
            seqs, starts = sequences(batch.column("ids").to_pylist(), None)
            others = np.array([(s == len(b) - 1).sum() for s in seqs], dtype=np.int64)
            for which, own in batches_of(seqs, starts):
                logs[which] = own.forward(pi, a, b)[0]
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("rid", "doc_id", "held_out", "n", "known", "base_log", "other_log")} | {"others": others, "model_log": logs / np.log(10)})

    scored = encoded.drop("rest").mapInArrow(run, "rid long, doc_id long, held_out boolean, n long, known long, base_log double, other_log double, others long, model_log double")
    more, more_log = F.coalesce("more", F.lit(0)), F.coalesce("more_log", F.lit(0.0))
    return scored.join(rest, "rid", "left").select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + more).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_log") + more_log - F.col("n") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("model_log") + F.col("other_log") + more_log - F.col("others") * F.lit(float(np.log10(other)))).alias("score"),
    )


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.documents(spark, sf_dir))
