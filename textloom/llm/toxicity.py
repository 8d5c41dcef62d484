"""Toxicity scores by a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and their first four and five bytes, hashed to ``buckets`` ids. The
machine adds a weight for each term and, for each pair of terms, the dot product of their factors, so that terms which are
harmless alone can weigh together. It is trained here, on a bounded sample of labelled rows: the ``sample`` rows that come
first in a seeded order of doc_id.

Terms have parameters if the sample shows that they carry evidence: those that tell the classes apart alone (chi-squared, at
most ``terms`` of them), and those that do so beside one of the ``seeds`` strongest of these though not alone (chi-squared
of the pair among the documents with the strong term, where at least five of each class are expected, at most ``terms`` more). All others have none, which keeps very
long documents from adding up noise. Counts of terms and pairs are summed on the executors; only the chosen terms of the
sampled rows come to the driver, at most ``sample * 2 * terms`` ids. Scoring covers every whole text and sends a table of
fixed size to the executors.

Defined results: null and empty texts have no terms and get the bias alone; unlabelled rows and null labels are not
learnt from, of several labels of a doc_id the largest counts, of several texts of a doc_id the first by hash is learnt
from; without any usable label every score is about 0; rows with equal doc_id are scored each on its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, seeded
from .vectext import Text, list_array, text_slices

BUCKETS = 1 << 18


def term_ids(text: Text, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, term id) pairs, by document."""
    s, e, d = text.words()
    ids = [text.hash_ranges(s, np.minimum(e, s + n) if n else e, lower=True) ^ np.uint64(n) for n in (0, 4, 5)]
    key = np.concatenate([d] * 3).astype(np.uint64) * np.uint64(buckets) + np.concatenate(ids) % np.uint64(buckets)
    key = np.unique(key)
    return (key // np.uint64(buckets)).astype(np.int64), (key % np.uint64(buckets)).astype(np.int64)


class FactorizationMachine:
    """Second-order logistic machine over binary terms."""

    def __init__(self, index: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.index, self.bias, self.weights, self.factors = index, bias, weights, factors  # index: bucket to row or -1

    def scores(self, n_docs: int, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        rows = self.index[terms]
        docs, rows = docs[rows >= 0], rows[rows >= 0]
        total = np.full(n_docs, self.bias) + np.bincount(docs, weights=self.weights[rows], minlength=n_docs)
        for f in range(self.factors.shape[1]):
            v = self.factors[rows, f]
            total += 0.5 * (np.bincount(docs, weights=v, minlength=n_docs) ** 2 - np.bincount(docs, weights=v * v, minlength=n_docs))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    @classmethod
    def train(cls, labels: np.ndarray, sets: list[np.ndarray], chosen: np.ndarray, buckets: int = BUCKETS, factors: int = 8, steps: int = 200, l2: float = 1e-4, seed: int = 3) -> FactorizationMachine:
        """``chosen``: the term ids that get parameters; ``sets``: those of each document."""
        n = len(labels)
        index = np.full(buckets, -1, np.int32)
        if not n:
            return cls(index, -30.0, np.zeros(1), np.zeros((1, factors)))
        index[chosen] = np.arange(len(chosen))
        owner, flat = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets).astype(np.int64)
        y = labels.astype(float)
        x = np.zeros((n, max(1, len(chosen))), np.float32)
        use = index[flat] >= 0
        x[owner[use], index[flat[use]]] = 1
        rng = np.random.default_rng(seed)
        w = np.zeros(x.shape[1], np.float32)
        v = rng.normal(0, 0.02, (x.shape[1], factors)).astype(np.float32)
        b = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v)] + [[0.0, 0.0]]
        for t in range(1, steps + 1):
            xv = x @ v
            z = b + x @ w + 0.5 * ((xv**2).sum(axis=1) - x @ (v**2).sum(axis=1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y).astype(np.float32) / n
            grads = [x.T @ g + l2 * w, x.T @ (g[:, None] * xv) - (x.T @ g)[:, None] * v + l2 * v, float(g.sum())]
            moved = []
            for p, d, s in zip((w, v, b), grads, state):
                s[0] = 0.9 * s[0] + 0.1 * d
                s[1] = 0.999 * s[1] + 0.001 * d * d
                moved.append(p - 0.05 * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.999**t)) + 1e-8))
            w, v, b = moved
        return cls(index, float(b), w.astype(float), v.astype(float))


def chi_squared(both: np.ndarray, hot: np.ndarray, rate: np.ndarray | float, n: np.ndarray | int) -> np.ndarray:
    """Of a term in ``both`` of n documents, ``hot`` of them labelled 1 where the share of label 1 is ``rate``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where(both >= 3, (hot - both * rate) ** 2 / (both * rate * (1 - rate) * np.maximum(1 - both / n, 1e-9)), 0)
    return np.nan_to_num(chi)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, buckets: int = BUCKETS, terms: int = 1024, seeds: int = 64, seed: int = 5) -> FactorizationMachine:
    """Trains on at most ``sample`` of the rows of ``labels`` (doc_id, toxic) that have a document."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(seeded("doc_id", seed=seed), "doc_id").limit(sample)  # at most ``sample`` rows, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic"))), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, text in text_slices(batch.column(1)):
                d, t = term_ids(text, buckets)
                cuts = np.searchsorted(d, np.arange(1, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), list_array(np.split(t.astype(np.int32), cuts), pa.int32())], ["doc_id", "toxic", "terms"])

    found = rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, terms array<int>")
    found = found.groupBy("doc_id", "toxic").agg(F.min_by("terms", F.xxhash64("terms")).alias("terms"))  # one row a doc_id
    found = Scratch(docs.sparkSession).save(found, "sample")
    n, hot_n = found.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return FactorizationMachine.train(np.zeros(0), [], np.zeros(0, np.int64), buckets)
    rate = hot_n / n

    def table(counted: DataFrame) -> dict[str, np.ndarray]:
        t = counted.toArrow()
        return {c: np.asarray(t.column(c)) for c in t.column_names}

    each = found.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("hot")).where("n >= 3")
    single = table(each)  # at most ``buckets`` rows
    chi = chi_squared(single["n"], single["hot"], rate, n)
    order = np.lexsort((single["term"], -chi))
    alone = single["term"][order[: terms][chi[order[:terms]] > 15]].astype(np.int64)
    strong = [int(x) for x in alone[:seeds]]
    beside = np.zeros(0, np.int64)
    if strong:
        held = F.array_intersect("terms", F.array(*[F.lit(x) for x in strong]))
        pairs = found.select("toxic", "terms", F.explode(held).alias("strong")).select("toxic", "strong", F.explode("terms").alias("term"))
        counted = pairs.groupBy("strong", "term").agg(F.count("*").alias("n"), F.sum("toxic").alias("hot")).where("n >= 3")
        own = counted.where("strong = term").select("strong", F.col("n").alias("all"), (F.col("hot") / F.col("n")).alias("rate"))
        value = (F.col("hot") - F.col("n") * F.col("rate")) ** 2 / (F.col("n") * F.col("rate") * (1 - F.col("rate")) * F.greatest(1 - F.col("n") / F.col("all"), F.lit(1e-9)))
        told = counted.join(F.broadcast(own), "strong").where("strong <> term and n * rate >= 5 and n * (1 - rate) >= 5 and n < all").groupBy("term").agg(F.max(value).alias("chi")).where("chi > 60")  # of very many pairs
        told = table(told.orderBy(F.desc("chi"), "term").limit(2 * terms))
        beside = told["term"][~np.isin(told["term"], alone)][:terms].astype(np.int64)
    chosen_terms = np.concatenate([alone, beside])
    kept = found.select("doc_id", F.col("toxic"), F.array_intersect("terms", F.array(*[F.lit(int(x)) for x in chosen_terms]).cast("array<int>")).alias("terms")).toArrow().sort_by("doc_id")
    flat = kept.column("terms").combine_chunks()
    sizes = np.asarray(flat.value_lengths())
    return FactorizationMachine.train(np.asarray(kept.column("toxic")), np.split(np.asarray(flat.flatten()), np.cumsum(sizes)[:-1]), chosen_terms, buckets)


def score(docs: DataFrame, machine: FactorizationMachine, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for i, j, text in text_slices(batch.column(1)):
                p = m.scores(j - i, *term_ids(text, len(m.index)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
