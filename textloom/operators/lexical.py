"""Lexical recall: BM25 over phrases of tokens, as a full-text index computes it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans.schemas import LEXICAL_LIMIT

K1, B, MIN_IDF = 1.2, 0.75, 1e-6


def query_phrases(spark: SparkSession, query: str) -> tuple[list[str], list[list[str]]]:
    """Normalized terms and the token phrase of each (empty ones match nothing)."""
    q = F.lit(query)
    row = spark.range(1).select(T.terms(q).alias("t"), F.transform(T.terms(q), T.tokens).alias("p")).first()
    return row["t"], [p for p in row["p"] if p]


def bm25_parts(n_phrases: int, docs: str = "docs", total: str = "total") -> tuple[Column, Column]:
    """Score and hit flag of rows with frequencies f0.., document frequencies n0.., length dl and the corpus totals."""
    hit, score = F.lit(False), F.lit(0.0)
    for i in range(n_phrases):
        f, n = F.col(f"f{i}"), F.col(f"n{i}")
        idf = F.log((F.col(docs) - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(MIN_IDF)
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") * F.col(docs) / F.col(total)))
        hit = hit | (f > 0)
    return score, hit


def best_of(scored: DataFrame, limit: int) -> DataFrame:
    return scored.withColumn("order", F.round("bm25", 6)).orderBy(F.desc("order"), "rel_path", "chunk_index").limit(limit)


def covered(best: DataFrame, terms: list[str], columns: list[str]) -> DataFrame:
    cover = T.coverage(F.col("normalized_text"), F.array(*[F.lit(t) for t in terms]))
    return best.withColumn("lexical_score", cover + F.greatest("bm25", F.lit(0.0))).select(*columns, "bm25", "lexical_score")


def nothing(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.lit(False)).select("*", F.lit(0.0).alias("bm25"), F.lit(0.0).alias("lexical_score"))


def counts(chunks: DataFrame, query: str) -> DataFrame:
    """rel_path, chunk_index, dl (tokens), cover, f0.. (occurrences of each phrase) of chunks that hold one; a row of each task, with
    chunk_index -1, has the numbers of all chunks (docs) and tokens (total). The tokens are made once."""
    terms, phrases = query_phrases(chunks.sparkSession, query)
    known = pa.array(dict.fromkeys(t for p in phrases for t in p), pa.string())
    place = {t: i for i, t in enumerate(known.to_pylist())}
    coded = [[place[t] for t in p] for p in phrases]
    names = ["rel_path", "chunk_index", "dl", "cover", "docs", "total", *[f"f{i}" for i in range(len(phrases))]]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64(), *[pa.int64()] * (len(names) - 4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, total = 0, 0
        for batch in batches:
            lists = batch.column(2)
            lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            at = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1))
            row = np.repeat(np.arange(len(lengths)), lengths)
            found = [np.bincount(row[_starts(at, row, p)], minlength=len(lengths)) for p in coded]
            hit = np.flatnonzero(np.any(found, axis=0))
            docs, total = docs + len(lengths), total + int(lengths.sum())
            if len(hit):
                take = lambda c: c.take(pa.array(hit))
                none = np.zeros(len(hit), np.int64)
                columns = [take(batch.column(0)), take(batch.column(1)), lengths[hit], take(batch.column(3)), none, none, *[f[hit] for f in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], names)
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([None, -1, 0, 0.0, docs, total, *[0] * len(coded)], kinds)], names)

    cover = T.coverage(F.col("normalized_text"), F.array(*[F.lit(t) for t in terms])).cast("double")
    rows = chunks.select("rel_path", "chunk_index", T.tokens(F.col("normalized_text")).alias("tokens"), cover.alias("cover"))
    return rows.mapInArrow(run, "rel_path string, chunk_index int, dl long, cover double, docs long, total long" + "".join(f", {f} long" for f in names[6:]))


def _starts(at: np.ndarray, row: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the adjacent tokens of a phrase begin within a row."""
    n = max(len(at) - len(phrase) + 1, 0)
    ok = row[:n] == row[len(phrase) - 1 :][:n]
    for j, code in enumerate(phrase):
        ok = ok & (at[j : j + n] == code)
    return np.flatnonzero(ok)


def scores(counted: DataFrame, scope: str | None = None, kind: str = "dir", limit: int = LEXICAL_LIMIT) -> DataFrame:
    """rel_path, chunk_index, bm25, lexical_score of the best chunks, from ``counts``: statistics over all of them, scope applied before the
    limit. Statistics are one row, so joining them is no shuffle."""
    n = len([c for c in counted.columns if c.startswith("f")])
    stats = counted.agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(n)])
    score, _ = bm25_parts(n)
    rows = counted.where("chunk_index >= 0").where(T.in_scope(F.col("rel_path"), scope, kind)).drop("docs", "total")
    best = best_of(rows.join(F.broadcast(stats)).withColumn("bm25", score), limit)  # stats: one row
    return best.select("rel_path", "chunk_index", "bm25", (F.col("cover") + F.greatest("bm25", F.lit(0.0))).alias("lexical_score"))


def candidates(chunks: DataFrame, query: str, scope: str | None = None, kind: str = "dir", limit: int = LEXICAL_LIMIT) -> DataFrame:
    """The best chunks by BM25, with all their columns."""
    if not query_phrases(chunks.sparkSession, query)[1]:
        return nothing(chunks)
    best = scores(counts(chunks, query), scope, kind, limit)
    return chunks.join(F.broadcast(best), ["rel_path", "chunk_index"]).select(*chunks.columns, "bm25", "lexical_score")  # best: at most ``limit`` rows


def stored_candidates(index: DataFrame, stats: DataFrame, chunks: DataFrame, query: str, scope: str | None = None, kind: str = "dir", limit: int = LEXICAL_LIMIT) -> DataFrame:
    """The same from stored ``postings`` and ``stats``: only the postings of the query's tokens are read, and chunks of the best rows.

    A phrase of several tokens needs their order, which postings don't hold; such a query is answered by ``candidates``.
    """
    terms, phrases = query_phrases(chunks.sparkSession, query)
    if not phrases:
        return nothing(chunks)
    if any(len(p) > 1 for p in phrases):
        return candidates(chunks, query, scope, kind, limit)
    tokens = [p[0] for p in phrases]
    held = index.where(F.col("token").isin(*tokens))
    count = lambda t: F.count_if(F.col("token") == t)
    known = held.agg(*[count(t).alias(f"n{i}") for i, t in enumerate(tokens)]).join(stats.select(F.col("n_chunks").alias("docs"), F.col("total_tokens").alias("total")))
    tf = lambda t: F.coalesce(F.max(F.when(F.col("token") == t, F.col("tf"))), F.lit(0))
    rows = held.where(T.in_scope(F.col("rel_path"), scope, kind)).groupBy("rel_path", "chunk_index", "dl").agg(*[tf(t).alias(f"f{i}") for i, t in enumerate(tokens)])
    score, _ = bm25_parts(len(tokens))
    best = best_of(rows.join(F.broadcast(known)).withColumn("bm25", score), limit).select("rel_path", "chunk_index", "bm25")  # known: one row
    return covered(chunks.join(F.broadcast(best), ["rel_path", "chunk_index"]), terms, chunks.columns)  # best: at most ``limit`` rows


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """token, df (chunks that hold it), tf (occurrences). Counted in each batch of chunks, then by token; pairs of token and chunk are never grouped."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            coded = lists.flatten().dictionary_encode()
            size = len(coded.dictionary)
            if not size:
                continue
            token = np.asarray(coded.indices)
            row = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            df = np.bincount(np.unique(row * size + token) % size, minlength=size)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(df, pa.int64()), pa.array(np.bincount(token, minlength=size), pa.int64())], ["token", "df", "tf"])

    counted = chunks.select(T.tokens(F.col("normalized_text")).alias("tokens")).mapInArrow(count, "token string, df long, tf long")
    return counted.groupBy("token").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def postings(chunks: DataFrame) -> DataFrame:
    """token, rel_path, chunk_index, dl (tokens of the chunk), tf."""
    tokens = chunks.select("rel_path", "chunk_index", T.tokens(F.col("normalized_text")).alias("tokens"))
    rows = tokens.select("rel_path", "chunk_index", F.size("tokens").alias("dl"), F.explode("tokens").alias("token"))
    return rows.groupBy("token", "rel_path", "chunk_index", "dl").agg(F.count("*").alias("tf"))


def by_token(index: DataFrame) -> DataFrame:
    """Postings in the order in which they are stored: a filter on tokens skips files and row groups by their bounds."""
    return index.repartitionByRange("token", "rel_path").sortWithinPartitions("token", "rel_path")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    n = F.size(T.tokens(F.col("normalized_text")))
    return chunks.agg(F.count("*").alias("n_chunks"), F.sum(n).alias("total_tokens"))


# Up to so many rows (query, token) and queries a batch is scored where the chunks are; scores held at once.
BATCH_PAIRS, BATCH_QUERIES, SCORES_AT_ONCE = 1_000_000, 20_000, 2_000_000


def batch_candidates(chunks: DataFrame, queries: DataFrame, limit: int = LEXICAL_LIMIT, pairs: int = BATCH_PAIRS) -> DataFrame:
    """query_id, rel_path, chunk_index, bm25, rank for many queries at once.

    Tokens of a query count as often as it names them. The queries' tokens go to the chunks: one pass counts what holds them, a second
    one scores and keeps each task's best rows of every query, so no posting is shuffled. Beyond ``pairs`` it is a join on tokens.
    """
    wanted = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    asked = wanted.limit(pairs + 1).toArrow()
    many = len(asked) > pairs or len(pc.unique(asked["query_id"])) > BATCH_QUERIES
    scored = joined_scores(chunks, wanted) if many else best_scores(chunks, asked, wanted.schema["query_id"].dataType.simpleString(), limit)
    w = Window.partitionBy("query_id").orderBy(F.round("bm25", 6).desc(), "rel_path", "chunk_index")
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < limit)


def joined_scores(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, rel_path, chunk_index, bm25 of all matches, by a join of postings and queries."""
    index = postings(chunks).join(wanted.select("token").distinct(), "token", "left_semi")
    df = index.groupBy("token").agg(F.count("*").alias("n"))
    matched = index.join(wanted.join(df, "token"), "token").join(F.broadcast(corpus_stats(chunks)))
    idf = F.log((F.col("n_chunks") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    part = F.when(idf > 0, idf).otherwise(MIN_IDF) * F.col("times") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") * F.col("n_chunks") / F.col("total_tokens")))
    return matched.groupBy("query_id", "rel_path", "chunk_index").agg(F.sum(part).alias("bm25"))


def _occurrences(tokens: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of lists of tokens: their lengths, and row, token (its place in ``known``) and frequency of what is known."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0))
    at = np.asarray(pc.fill_null(pc.index_in(tokens.flatten(), value_set=known), -1))
    pair = np.repeat(np.arange(len(lengths)), lengths)[at >= 0] * len(known) + at[at >= 0]
    pair, tf = np.unique(pair, return_counts=True)
    return lengths, pair // max(len(known), 1), pair % max(len(known), 1), tf


def best_scores(chunks: DataFrame, asked: pa.Table, kind: str, limit: int) -> DataFrame:
    """query_id, rel_path, chunk_index, bm25: of each task at least the ``limit`` best rows of each query, in the order of ``batch_candidates``."""
    spark = chunks.sparkSession
    known, ids = pc.unique(asked["token"]), pc.unique(asked["query_id"])
    tokens = chunks.select("rel_path", "chunk_index", T.tokens(F.col("normalized_text")).alias("tokens"))
    held = spark.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows, total = np.zeros(len(held.value), np.int64), 0, 0
        for batch in batches:
            lengths, _, token, _ = _occurrences(batch.column(0), held.value)
            n += np.bincount(token, minlength=len(n))
            rows, total = rows + len(lengths), total + int(lengths.sum())
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *found], pa.int64()), pa.array([rows, total, *n[found]], pa.int64())], ["token", "n"])

    sums = dict(tokens.select("tokens").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect())
    docs, total = sums.get(-2, 0), sums.get(-1, 0)
    n = np.array([sums.get(i, 0) for i in range(len(known))], float)
    idf = np.log((docs - n + 0.5) / (n + 0.5))
    token = np.asarray(pc.index_in(asked["token"], value_set=known))
    order = np.argsort(token, kind="stable")
    weight = (np.where(idf > 0, idf, MIN_IDF)[token] * np.asarray(asked["times"]))[order]
    query = np.asarray(pc.index_in(asked["query_id"], value_set=ids))[order]
    plan = spark.sparkContext.broadcast((known, ids, np.searchsorted(token[order], np.arange(len(known) + 1)), query, weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, first, query, weight = plan.value
        at_once = max(1, SCORES_AT_ONCE // max(len(ids), 1))
        floor, best, fresh = np.full(len(ids), -np.inf), [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                lengths, row, token, tf = _occurrences(part.column(2), known)
                x = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] * docs / max(total, 1)))
                order = np.argsort(token, kind="stable")
                row, token, x = row[order], token[order], x[order]
                scores = np.zeros((part.num_rows, len(ids)))
                for a, b in _runs(token):
                    mine = slice(first[token[a]], first[token[a] + 1])
                    scores[np.ix_(row[a:b], query[mine])] += np.outer(x[a:b], weight[mine])
                rounded = np.round(scores, 6)
                if part.num_rows >= limit > 0:
                    floor = np.maximum(floor, np.partition(rounded, part.num_rows - limit, axis=0)[part.num_rows - limit])
                row, q = np.nonzero((scores > 0) & (rounded >= floor))
                paths, numbers = part.column(0).take(pa.array(row)).to_pylist(), part.column(1).take(pa.array(row)).to_pylist()
                best += zip(q.tolist(), (-rounded[row, q]).tolist(), [(p is not None, p or "") for p in paths], numbers, scores[row, q].tolist())
                fresh += len(row)
                if fresh > 4 * limit * len(ids) + 10_000:
                    best, fresh = _first(best, limit, floor), 0
        best = _first(best, limit, floor)
        columns = [ids.take(pa.array([r[0] for r in best], pa.int64())), pa.array([r[2][1] if r[2][0] else None for r in best], pa.string()), pa.array([r[3] for r in best], pa.int32()), pa.array([r[4] for r in best], pa.float64())]
        yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["query_id", "rel_path", "chunk_index", "bm25"])

    return tokens.mapInArrow(score, f"query_id {kind}, rel_path string, chunk_index int, bm25 double")


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    cut = np.flatnonzero(np.diff(values)) + 1
    return zip([0, *cut] if len(values) else [], [*cut, len(values)])


def _first(rows: list[tuple], limit: int, floor: np.ndarray) -> list[tuple]:
    """The first ``limit`` rows of each query in order; ``floor`` rises to the score of the last one."""
    out, query, n = [], None, 0
    for r in sorted(rows):
        query, n = (r[0], n + 1) if r[0] == query else (r[0], 1)
        if n <= limit:
            out.append(r)
        if n == limit:
            floor[query] = max(floor[query], -r[1])
    return out
