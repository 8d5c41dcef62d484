"""The search engine: an index over files, kept as DataFrames, and the searches over it."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import chunk, code, fuse, lexical, literal, materialize, scan, state, vector
from textloom.plans import schemas as S
from textloom.sources import corpus
from textloom.sources.store import Store


@dataclass(frozen=True)
class Query:
    text: str

    @property
    def normalized(self) -> str:
        return code.fold(self.text)

    @property
    def terms(self) -> list[str]:
        return self.normalized.split(" ") if self.normalized else []

    @property
    def is_empty(self) -> bool:
        return not self.normalized

    def matches(self, candidate: str) -> bool:
        text = code.fold(candidate)
        return all(t in text for t in self.terms)


def chunks_of(files: DataFrame) -> DataFrame:
    """All chunks of files (rel_path, body): symbols of code, text chunks of the rest."""
    ext = corpus.language(F.col("rel_path"))
    text = chunk.text_chunks(files.where(ext.isNull()))
    text = text.select("*", F.col("normalized_text").alias("shared_normalized_text"), F.sha2("normalized_text", 256).alias("shared_normalized_text_hash"), F.lit("text").alias("chunk_kind"), *[F.lit(None).cast("string").alias(c) for c in ("language", "symbol_kind", "container")])
    return text.unionByName(code.symbol_chunks(files))


class Index:
    """Searches over files and chunks; ``vectors`` (hash, vector) only at level fts+vector."""

    def __init__(self, files: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, dims: int = S.VECTOR_DIMS, embedder=vector.embed_text, postings: DataFrame | None = None, stats: DataFrame | None = None, scanner: scan.Scanner = scan):
        self.scanner = scanner
        self.postings, self.stats = postings, stats  # stored ones, if there are any
        self.files, self.chunks, self.vectors, self.dims, self.embedder = files, chunks, vectors, dims, embedder
        self.held, self.keeps = [], False

    def kept(self) -> Index:
        """The index whose searches hold what two of their branches need of the chunks (no texts) in memory or on the executors' disks, so that
        it isn't made anew; what is lost is computed again. ``close`` lets it go."""
        self.keeps = True
        return self

    def holding(self, rows: DataFrame) -> DataFrame:
        if not self.keeps:
            return rows
        self.held.append(rows.persist())
        return self.held[-1]

    def close(self) -> None:
        for held in self.held:
            held.unpersist()
        self.held.clear()

    @classmethod
    def build(cls, files: DataFrame, level: str = "fts", dims: int = S.VECTOR_DIMS, embedder=vector.embed_text) -> Index:
        chunks = chunks_of(files)
        vectors = None
        if level == "fts+vector":  # each distinct text is embedded once
            texts = chunks.groupBy("shared_normalized_text_hash", "shared_normalized_text").agg(F.count("*").alias("ref_count"))
            vectors = vector.embed(texts, "shared_normalized_text", "passage", dims, embedder)
        return cls(files, chunks, vectors, dims, embedder)

    def channels(self, query: str, scope: str | None = None, kind: str = "dir") -> DataFrame:
        from pyspark.sql import Window

        if Query(query).is_empty:
            raise ValueError("the query is empty")
        stored = self.postings is not None and self.stats is not None
        if stored:
            lex = lexical.stored_candidates(self.postings, self.stats, self.chunks, query, scope, kind)
        elif lexical.query_phrases(self.chunks.sparkSession, query)[1]:
            lex = lexical.scores(self.holding(lexical.counts(self.chunks, query)), scope, kind)
        else:
            lex = lexical.nothing(self.chunks)
        # at most 96 rows; ranked after the limit
        w = Window.orderBy(F.round("bm25", 6).desc(), "rel_path", "chunk_index")
        out = fuse.channel(lex.withColumn("rank", F.row_number().over(w) - 1), "lexical")
        out = out.unionByName(fuse.channel(literal.ranked(literal.first_lines(self.files, self.chunks, query, scope, kind, self.scanner)), "literal"))
        if self.vectors is not None:
            inside = self.chunks.where(T.in_scope(F.col("rel_path"), scope, kind))
            key = "shared_normalized_text_hash"
            known = self.vectors.join(inside.select(key).distinct(), key, "left_semi") if scope else self.vectors  # each vector has its chunk
            best = vector.nearest_arrow(known, key, self.embedder(Query(query).normalized, "query", self.dims))
            rows = vector.fan_out(best, inside)
            order = Window.orderBy(F.round("vector_score", 6).desc(), key, "rel_path", "chunk_index")
            out = out.unionByName(fuse.channel(rows.withColumn("rank", F.row_number().over(order) - 1), "vector"))
        return out

    def search(self, query: str, scope: str | None = None, kind: str = "dir", limit: int = S.RESULT_LIMIT, before: int = 0, after: int = 0, live: str | None = None) -> DataFrame:
        """Fused hits in order: literal before lexical before semantic; capped, then cut, then materialized.

        With ``live``, the root of the files, snippets come from the files of the hits as they are now; hits whose file or
        chunk is gone go, so they are materialized first. The hits are held until ``close``.
        """
        hits = fuse.fuse(self.channels(query, scope, kind))
        if live is not None:
            hits = hits.persist()
            self.held.append(hits)
            hits = materialize.snippets(hits, chunks_of(corpus.reread(hits, live)), before, after)
        if self.vectors is not None:
            hits = fuse.cap_semantic(hits)
        if live is None:  # every hit has its chunk
            hits = materialize.snippets(hits.orderBy(*fuse.priority()).limit(limit), self.chunks, before, after, few=True)
        label = T.channel_label(F.col("partial_text_match"), F.col("indexed_text_match"), F.col("vector_score"))
        return hits.orderBy(*fuse.priority()).limit(limit).withColumn("channel_label", label)

    def grep(self, pattern: str, scope: str | None = None, kind: str = "dir", before: int = 0, after: int = 0) -> DataFrame:
        rows = corpus.line_rows(self.files.where(T.in_scope(F.col("rel_path"), scope, kind)))
        hits = self.scanner.with_context(rows, pattern, before, after) if before or after else self.scanner.regex_scan(rows, pattern)
        return scan.ordered(hits)


UNREAD = " cannot be read"
SHARED = ("shared_normalized_text_hash", "shared_normalized_text")


def reconcile_covering(spark: SparkSession, path: str, needed: str | None = None) -> dict[str, dict[str, int]]:
    """Reconciles every index around the path: those of folders above within the path, those below as a whole.

    With ``needed`` only that root's failure is raised; the others are left marked dirty.
    """
    at, out = os.path.abspath(path), {}
    around = corpus.covering_roots(at)
    for root in around["ancestors"] + around["descendants"]:
        inside = root == at or root.startswith(at.rstrip("/") + "/")
        try:
            out[root] = Engine(spark, root).reconcile("" if inside else os.path.relpath(at, root))
        except Exception:
            if needed is None or root == needed:
                raise
    return out


class Engine:
    """An index of a directory tree, stored at ``store_root`` and refreshed by comparison with the tree."""

    def __init__(self, spark: SparkSession, root: str, store_root: str | None = None):
        self.spark, self.root = spark, root
        self.store = Store(spark, store_root or f"file://{root}/.textloom/index")

    def preflight(self, level: str) -> dict:
        files = corpus.load(corpus.read_tree(self.spark, self.root))
        n = chunks_of(files).count()
        limit = S.RECOMMENDED_CHUNKS[level] * S.FORCE_FACTOR
        return {"estimated_chunks": n, "recommended": S.RECOMMENDED_CHUNKS[level], "force_threshold": limit, "requires_force": n > limit}

    def rebuild(self, level: str | None = None, mode: str = "rebuild") -> dict:
        """Everything anew; without a level the stored one stays."""
        with self.store.locked():
            level = level or self.level()
            began = int(time.time() * 1000)
            tree, warnings, scanned = self._tree()
            return self._write(corpus.load(tree), level, mode, began, scanned, warnings)

    def _tree(self, scope: str = "") -> tuple[DataFrame, list[str], int]:
        """The readable candidates, a warning for each of the others, and the number of all."""
        names = corpus.walk(self.root, scope)
        bad = set(corpus.unreadable(self.root, names))
        return corpus.read_files(self.spark, self.root, [n for n in names if n not in bad]), [n + UNREAD for n in sorted(bad)], len(names)

    def _write(self, files: DataFrame, level: str, mode: str, began: int, scanned: int, warnings: list[str]) -> dict:
        """A snapshot of everything made from the files."""
        chunks = chunks_of(files.select("rel_path", "body"))
        kept = files.join(chunks.select("rel_path").distinct(), "rel_path", "left_semi")
        shared = chunks.groupBy(*SHARED).agg(F.count("*").alias("ref_count"))
        tables = {"files": kept.withColumn("indexed_at_unix_ms", F.lit(began)), "chunks": chunks, "shared": shared, "postings": lexical.by_token(lexical.postings(chunks)), "stats": lexical.corpus_stats(chunks)}
        if level == "fts+vector":
            tables["vectors"] = vector.embed(shared, SHARED[1]).select(SHARED[0], "vector")
        return self._commit(tables, level, mode, began, scanned, None, warnings)

    def _commit(self, tables: dict[str, DataFrame], level: str, mode: str, began: int, scanned: int, fresh: DataFrame | None, warnings: list[str]) -> dict:
        """Writes the tables, then the run with what was written, then swaps; without warnings the index is clean from there on."""
        past = self.store.read("runs") if self.store.exists() else None
        told = {}

        def finish(read) -> dict[str, DataFrame]:
            told.update(scanned_files=scanned, indexed_files=read("files").where(F.col("indexed_at_unix_ms") == began).count(), chunks_indexed=read("chunks").count() if fresh is None else fresh.count())
            run = self.spark.createDataFrame([(began, mode, began, int(time.time() * 1000), *told.values(), warnings[0] if warnings else None)], S.RUNS)
            return {"runs": run if past is None else past.unionByName(run)}

        self.store.commit(tables, {"index_level": level, "chunk_mode": chunk.CHUNK_MODE}, finish)
        self._settle(warnings)
        return told | ({"warnings": len(warnings), "first_warning": warnings[0]} if warnings else {})

    def _settle(self, warnings: list[str]) -> None:
        self.store.set_state(bool(warnings), warnings[0] if warnings else None, int(time.time() * 1000))

    def reconcile(self, scope: str = "") -> dict[str, int]:
        """Compares the tree with the index by size and time and writes only if something differs.

        Only new and changed files are read and chunked, only texts without a vector embedded; reference counts move by
        the difference and texts that nothing refers to go.
        """
        try:
            tree, warnings, scanned = self._tree(scope)
            old = self.store.read("files")
            left = [w.removesuffix(UNREAD) for w in warnings]  # what is stored of them stays
            changes = state.diff(old.where(T.in_scope(F.col("rel_path"), scope or None) & ~F.col("rel_path").isin(left)), tree).cache()
            counts = {r["status"]: r["count"] for r in changes.groupBy("status").count().collect()}
            if set(counts) - {"unchanged"}:
                with self.store.locked():
                    self._update(old, changes, tree, scanned, warnings)
            else:
                self._settle(warnings)
            changes.unpersist()
            return counts
        except Exception as e:
            if self.store.exists():
                self.store.set_state(True, f"reconcile failed: {type(e).__name__}")
            raise

    def _update(self, old: DataFrame, changes: DataFrame, tree: DataFrame, scanned: int, warnings: list[str]) -> None:
        began, key = int(time.time() * 1000), SHARED[0]
        level = self.store.settings()["index_level"]
        fresh = corpus.load(tree.join(changes.where("status in ('new', 'changed')"), "rel_path", "left_semi"))
        made = chunks_of(fresh.select("rel_path", "body")).persist()
        gone = changes.where("status in ('changed', 'deleted')").select("rel_path")
        stored = self.store.read("chunks")
        chunks = state.replaced(stored, changes, made)
        deltas = state.count_deltas(stored.join(gone, "rel_path", "left_semi"), made, key)
        shared = state.counted(self.store.read("shared"), deltas, made, *SHARED)
        new_files = fresh.join(made.select("rel_path").distinct(), "rel_path", "left_semi").withColumn("indexed_at_unix_ms", F.lit(began))
        tables = {"files": state.replaced(old, changes, new_files), "chunks": chunks, "shared": shared, "postings": lexical.by_token(state.replaced(self.store.read("postings"), changes, lexical.postings(made))), "stats": lexical.corpus_stats(chunks)}
        if level == "fts+vector":
            known = self.store.read("vectors")
            new = shared.join(known, key, "left_anti")
            tables["vectors"] = state.collected(known, shared, key).unionByName(vector.embed(new, SHARED[1]).select(key, "vector"))
        self._commit(tables, level, "reconcile", began, scanned, made, warnings)
        made.unpersist()

    def level(self) -> str:
        """The stored level; without an index the first one."""
        return self.store.pointer()["settings"].get("index_level", S.LEVELS[0]) if self.store.exists() else S.LEVELS[0]

    def search(self, query: str, scope: str | None = None, kind: str = "dir", limit: int = S.RESULT_LIMIT, before: int = 0, after: int = 0) -> list:
        """The hits, with snippets of the files as they are now."""
        index = self.index()
        try:
            return index.search(query, scope, kind, limit, before, after, self.root).collect()
        finally:
            index.close()

    def mark_dirty(self, reason: str) -> dict:
        return self.store.set_state(True, reason)

    def _checked(self) -> str:
        """The level of an index with all its tables; one that lacks some is marked dirty and refused."""
        level = self.store.settings()["index_level"]
        if missing := self.store.missing_tables():
            self.store.set_state(True, f"missing tables: {', '.join(missing)}")
            raise ValueError(f"the index lacks {', '.join(missing)}; rebuild it")
        return level

    def index(self) -> Index:
        level = self._checked()
        vectors = self.store.read("vectors") if level == "fts+vector" else None
        return Index(self.store.read("files").select("rel_path", "body"), self.store.read("chunks"), vectors, postings=self.store.read("postings"), stats=self.store.read("stats"))

    def status(self) -> dict:
        """Counts, readiness, state and the last run; an index with tables lost has no counts but a reason."""
        overlaps = [r for side in corpus.covering_roots(self.root).values() for r in side if r != os.path.abspath(self.root)]
        try:
            level = self._checked()
        except ValueError as e:
            return {"root": self.root} | self.store.state() | {"error": str(e), "overlapping_roots": overlaps}
        chunks, key = self.store.read("chunks"), ["rel_path", "chunk_index"]
        vectors = self.store.read("vectors") if level == "fts+vector" else None
        # A chunk without any token has no posting and needs none.
        silent = chunks.where(F.size(T.tokens(F.col("normalized_text"))) == 0).select(*key)
        row = state.status(self.store.read("files"), chunks, self.store.read("shared"), self.store.read("postings").select(*key).distinct().unionByName(silent), vectors).first()
        return {"root": self.root} | row.asDict() | self.store.state() | {"index_level": level, "latest_run": state.latest_run(self.store.read("runs")).first().asDict(), "overlapping_roots": overlaps}

    def file_counts(self, rel_path: str) -> dict:
        """Chunks and references to shared texts of one file."""
        row = self.store.read("chunks").where(F.col("rel_path") == rel_path).agg(F.count("*").alias("chunks"), F.count_distinct(SHARED[0]).alias("shared")).first()
        return row.asDict()

    def delete(self) -> bool:
        return self.store.delete()
