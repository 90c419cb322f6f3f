"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, calibrated weighted votes, evidence.

Every word of the examples is a term. Plain TF-IDF finds texts of the same topic, whatever their label, so a term's inverse document frequency is
multiplied by how much more often one label's examples have it, shrunk by how sure that is; no term is left out.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import common as C
from pairloom.llm import text as T
from pairloom.llm.leaks import normal

#: Training rows of each label that are examples (a hash-ordered sample of the labelled rows); one in CALIBRATE of them fits the calibration instead of being indexed.
EXAMPLES, CALIBRATE = 3_000, 4
#: Standard errors at which a term's log ratio counts half.
SURE = 5.0
NEIGHBOURS, BLOCK, STEP = 15, 64, 8
#: Calibration rows that the prior counts as.
PRIOR_ROWS = 1.0
EXAMPLE = pa.schema([("doc_id", pa.int64()), ("x", pa.int64()), ("toxic", pa.int32()), ("terms", pa.list_(pa.int64())), ("tf", pa.list_(pa.int64()))])


class Index:
    """Postings of unit vectors by term and block of examples, with the largest weight of each such cell.

    terms: the vocabulary (hashes), ascending; idf: the terms' weights.
    """

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray, idf: np.ndarray):
        self.labels, self.ids, self.idf, self.blocks = labels, ids, idf, -(-len(docs) // BLOCK)
        doc = np.repeat(np.arange(len(docs)), [len(t) for t, _ in docs]) if docs else np.zeros(0, dtype=np.int64)
        term = np.concatenate([t for t, _ in docs]) if docs else doc
        weight = np.concatenate([unit(t, n, idf) for t, n in docs]) if docs else np.zeros(0)
        o = np.lexsort((doc, term))
        term, self.doc, self.weight = term[o], doc[o].astype(np.int32), weight[o]
        cell = term * max(1, self.blocks) + self.doc // BLOCK
        self.start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))[: len(cell)].astype(np.int32)
        self.block = (self.doc[self.start] // BLOCK).astype(np.int32)
        self.high = np.maximum.reduceat(self.weight, self.start) if len(cell) else weight
        self.stop = np.concatenate((self.start[1:], [len(cell)])).astype(np.int32)
        self.first = np.searchsorted(term[self.start], np.arange(len(idf) + 1)).astype(np.int32)

    def nearest(self, terms: np.ndarray, tf: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest positive cosines (to 12 places; of equal ones those first in the index) and the cosines.

        Exact: blocks are taken in the order of their bounds, and left out only if no example in them can reach the k-th cosine.
        """
        q = unit(terms, tf, self.idf)
        cell, of = ranges(self.first[terms], self.first[terms + 1])
        block, x = self.block[cell], q[of]
        bound = np.bincount(block, x * self.high[cell], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        turn = np.empty(self.blocks, dtype=np.int64)
        turn[order] = np.arange(self.blocks)
        turn = turn[block]
        best, who = np.zeros(0), np.zeros(0, dtype=np.int64)
        for b in range(0, self.blocks, STEP):
            if bound[order[b]] <= 0 or len(best) == k and bound[order[b]] < best[-1] - 1e-9:
                break
            own = np.flatnonzero((turn >= b) & (turn < b + STEP))
            at, of = ranges(self.start[cell[own]], self.stop[cell[own]])
            s = np.bincount(self.doc[at], x[own][of] * self.weight[at], minlength=len(self.ids))
            new = np.flatnonzero(s > 0)
            best, who = np.concatenate((best, np.round(s[new], 12))), np.concatenate((who, new))
            o = np.lexsort((who, -best))[:k]
            best, who = best[o], who[o]
        return who, best


def ranges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges a[i]:b[i], and the i of each."""
    n = b.astype(np.int64) - a
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (a - np.cumsum(n) + n)[of], of


def unit(terms: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(tf)) * idf[terms]
    return w / max(1e-300, float(np.sqrt((w * w).sum())))


def vote(similar: np.ndarray, toxic: np.ndarray, prior: float, sampled: float) -> float:
    """The toxic share of votes that weigh as the cosine over the distance; each label's are set to its share of all training rows, not of the sample."""
    w = similar / (1.0 + 1e-3 - np.minimum(1.0, similar))
    yes = (w * toxic).sum() * prior / max(sampled, 1e-12)
    no = (w * (1 - toxic)).sum() * (1 - prior) / max(1 - sampled, 1e-12)
    return float(yes / max(yes + no, 1e-300))


def monotone(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots of an ascending curve from votes to probabilities: isotonic regression by pooling neighbours, each pool drawn to the prior by PRIOR_ROWS."""
    pools: list[list[float]] = []
    o = np.argsort(votes, kind="stable")
    for v, y, w in zip(votes[o].tolist(), toxic[o].tolist(), weight[o].tolist()):
        pools.append([w * y, w, w * v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    at = np.array([p[2] / p[1] for p in pools])
    share = np.maximum.accumulate(np.array([(p[0] + PRIOR_ROWS * prior) / (p[1] + PRIOR_ROWS) for p in pools]))
    return np.concatenate(([0.0], at, [1.0])), np.concatenate((share[:1], share, share[-1:]))


def calibrated(vote_: float, knots: tuple[np.ndarray, np.ndarray] | None) -> float:
    """The curve's value, and a thousandth of the vote that equal values keep the order of votes."""
    return vote_ if knots is None else 0.999 * float(np.interp(vote_, *knots)) + 0.001 * vote_


def term_counts(w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms (hashes, ascending) of each text, the texts, and how often they have them."""
    h, doc = w.hash, w.doc
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))[: len(h)]
    n = np.diff(np.concatenate((new, [len(h)])))
    return h[new], doc[new], n


def examples(docs: DataFrame, labels: DataFrame, most: int, divisor: int) -> tuple[DataFrame, int, int]:
    """The training sample (doc_id, x, toxic, terms, tf), stored, and the numbers of toxic and of other training rows."""
    spark = docs.sparkSession
    train = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(C.crc_mod(F.col("doc_id"), divisor) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    chosen = [train.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for t in (0, 1)]
    chosen = spark.createDataFrame(chosen[0].unionByName(chosen[1]).toPandas().astype({"doc_id": "int64", "toxic": "int32"}), "doc_id long, toxic int")

    def run(batches):
        for batch in batches:
            texts = C.pylist(batch, "text")
            for a, b in T.chunks(texts):
                h, doc, n = term_counts(T.Words([normal(t) for t in texts[a:b]]))
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, b - a), "x": batch.column("x").slice(a, b - a), "toxic": batch.column("toxic").slice(a, b - a), "terms": [h[i:j].view(np.int64).tolist() for i, j in zip(cut, cut[1:])], "tf": [n[i:j].tolist() for i, j in zip(cut, cut[1:])]}, schema=EXAMPLE)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    own = own.groupBy(F.xxhash64("text").alias("x"), "toxic").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))  # copies say nothing more
    own = own.select("doc_id", "x", "text", "toxic").mapInArrow(run, "doc_id long, x long, toxic int, terms array<long>, tf array<long>")
    return C.stored(own, "examples"), counts.get(1, 0), sum(v for k, v in counts.items() if k != 1)


def weights_of(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, toxic: np.ndarray, terms: int) -> np.ndarray:
    """A weight for each term: its smoothed inverse document frequency times the log ratio of the labels' shares of it, shrunk by z^2 / (z^2 + SURE^2)."""
    yes, n = toxic[doc], len(toxic)
    damped = 1 + np.log(tf)
    mass = [np.bincount(term[yes == t], damped[yes == t], minlength=terms) for t in (1, 0)]
    df = [np.bincount(term[yes == t], minlength=terms) for t in (1, 0)]
    ratio = np.log((mass[0] + 0.5) / (mass[0].sum() + 0.5)) - np.log((mass[1] + 0.5) / (mass[1].sum() + 0.5))
    z = ratio / np.sqrt(1 / (df[0] + 0.5) + 1 / (df[1] + 0.5))
    return (np.log((n + 1) / (df[0] + df[1] + 1)) + 1) * np.abs(ratio) * z * z / (z * z + SURE * SURE) + 1e-9


def fitted(sample: DataFrame, prior: float):
    """`fit` of the examples, in one task, as their number is bounded; the driver gets the compressed model only."""

    def run(batches):
        rows = pa.Table.from_batches(list(batches), schema=EXAMPLE)
        data = zlib.compress(pickle.dumps(fit(rows, prior), protocol=5), 1)
        for i in range(0, len(data), 4 << 20):
            yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int64()), "data": pa.array([data[i : i + (4 << 20)]], pa.binary())})

    ordered = sample.coalesce(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "x")
    parts = sorted(C.stored(ordered.mapInArrow(run, "part long, data binary"), "toxicity-model").collect())
    return pickle.loads(zlib.decompress(b"".join(d for _, d in parts))) if parts else None


def fit(rows: pa.Table, prior: float):
    """(vocabulary, Index, toxic share of its examples, calibration knots) of the examples, in their order, or None if one label has none."""
    toxic, ids = rows.column("toxic").to_numpy(), rows.column("doc_id").to_numpy()
    many = pc.list_value_length(rows.column("terms")).to_numpy().astype(np.int64)
    flat, tf = (np.concatenate([x.flatten().to_numpy() for x in rows.column(c).chunks] or [np.zeros(0, dtype=np.int64)]) for c in ("terms", "tf"))
    doc = np.repeat(np.arange(len(ids)), many)
    index_of = np.flatnonzero(np.arange(len(ids)) % CALIBRATE != 0)
    if len(set(toxic[index_of].tolist())) < 2:
        return None
    own = np.isin(doc, index_of)
    place = np.cumsum(np.isin(np.arange(len(ids)), index_of)) - 1
    doc, count = place[doc[own]], tf[own]
    vocabulary, term = np.unique(flat[own].view(np.uint64), return_inverse=True)
    idf = weights_of(term, doc, count, toxic[index_of], len(vocabulary))
    cut = np.searchsorted(doc, np.arange(len(index_of) + 1))
    # examples of one label whose heaviest terms are equal are near each other in the index, so that blocks have tight bounds
    heavy = [int(term[i:j][np.argmax(idf[term[i:j]])]) if i < j else -1 for i, j in zip(cut, cut[1:])]
    order = np.lexsort((index_of, np.array(heavy), toxic[index_of]))
    index = Index([(term[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]]) for i in order.tolist()], toxic[index_of][order].astype(float), ids[index_of][order], idf)
    sampled, first = float(toxic[index_of].mean()), np.concatenate(([0], np.cumsum(many)))
    held, votes = np.flatnonzero(np.arange(len(ids)) % CALIBRATE == 0), []
    for i in held.tolist():
        t, n = known(flat[first[i] : first[i + 1]].view(np.uint64), tf[first[i] : first[i + 1]], vocabulary)
        who, near = index.nearest(t, n) if len(t) else ([], [])
        votes.append(vote(near, index.labels[who], prior, sampled) if len(who) else prior)
    y = toxic[held].astype(float)
    share = max(1e-12, float(toxic.mean()))
    weight = np.where(y == 1, prior / share, (1 - prior) / max(1e-12, 1 - share))
    return vocabulary, index, sampled, monotone(np.array(votes), y, weight, prior) if len(held) > 1 else None


def known(h: np.ndarray, tf: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the vocabulary of those terms that are in it, and how often the text has them."""
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = vocabulary[at] == h
    return at[hit], tf[hit]


def score(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES, divisor: int = 5, k: int = NEIGHBOURS) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted and evidence (doc_ids of the three nearest examples).

    At most `most` training rows of each label are examples, copies once; all their words are terms; whole texts are scored. Texts without
    such words (null and empty ones too) have no neighbours and get the share of toxic training rows, 0 without any; so do all texts if
    a label has no examples. Several labels of one doc_id count as toxic if one is. Equal cosines go by place in the index, so
    reruns agree. Repeated rows get equal scores; other columns are ignored.
    """
    spark = docs.sparkSession
    C.arrow_rows(spark)
    sample, toxic, other = examples(docs, labels, most, divisor)
    prior = toxic / max(1, toxic + other)
    shared = spark.sparkContext.broadcast(fitted(sample, prior))

    def run(batches):
        model = shared.value
        for batch in batches:
            texts, scores, why = C.pylist(batch, "text"), np.full(batch.num_rows, prior), [[] for _ in range(batch.num_rows)]
            seen: dict[bytes, int] = {}
            for a, b in T.chunks(texts) if model else ():
                vocabulary, index, sampled, knots = model
                h, doc, n = term_counts(T.Words([normal(x) for x in texts[a:b]]))
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                for d in np.unique(doc).tolist():
                    i = seen.setdefault(texts[a + d], a + d)  # a copy in the batch has the same score
                    if i < a + d:
                        scores[a + d], why[a + d] = scores[i], why[i]
                        continue
                    t, tf = known(h[cut[d] : cut[d + 1]], n[cut[d] : cut[d + 1]], vocabulary)
                    who, near = index.nearest(t, tf, k) if len(t) else ([], [])
                    if len(who):
                        scores[a + d] = calibrated(vote(near, index.labels[who], prior, sampled), knots)
                        why[a + d] = index.ids[who[:3]].tolist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": scores, "predicted": (scores >= 0.5).astype(np.int32), "evidence": pa.array(why, pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (C.crc_mod(F.col("doc_id"), divisor) == 0).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
