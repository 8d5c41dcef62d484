"""Reversible line deduplication: exact reference counts behind sharded cuckoo filters.

A line's key is the line without white space at both ends, A-Z lower-cased; only keys of at least ``min_chars`` code
points count. The index keeps one exact row for each key and document (``refs``), the reference count and the largest
doc_id of each key (``counts``), and one cuckoo filter a shard over the keys whose count reaches ``min_docs``. Inserting
documents adds rows, deleting them removes exactly theirs, and only the shards whose keys crossed the limit are
updated: cuckoo filters support deletion, so a delete undoes an insert. Lookups ask the filter first; what it lets
through is decided by the exact counts, so false positives cost a little work and no result. Filters are sent to the
executors ``FILTER_BYTES`` at a time, in as many passes as they need.

Keys are known by 95 bits of hash. An insert or delete counts anew the keys of its own documents only; the tables grow by
small parts, which ``compact`` joins.

A repeated key loses all its lines except in the largest doc_id that holds it.

Defined results: null or empty text is one empty line; rows with equal doc_id count as one document; a null doc_id
holds no keys, so it neither counts nor loses lines; other columns are passed through by ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chosen
from .vectext import _STEP, Text, list_array, mix, signed, text_slices

_U = np.uint64
FILTER_BYTES = 32 << 20
SHARD_KEYS = 1 << 20
KEY = ["key", "key2"]


def line_keys(text: Text, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document, key hash, 31 bits more of it and whether the key is long enough, of every line."""
    starts, ends, docs = text.lines()
    s, e = text.stripped(starts, ends)
    points = text.code_points_before()
    return starts, ends, docs, *text.strong_ranges(s, e, lower=True), points[e] - points[s] >= min_chars


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key has two buckets. Holds a multiset, so deletions are exact inverses."""

    SLOTS, KICKS = 4, 500

    def __init__(self, table: np.ndarray):
        self.table = table  # (power of two) x SLOTS

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = max(1, -(-5 * keys // (4 * cls.SLOTS)))  # at most 80 % full
        return cls(np.zeros((1 << (buckets - 1).bit_length(), cls.SLOTS), np.uint16))

    @classmethod
    def built(cls, keys: np.ndarray) -> CuckooFilter:
        size = len(keys)
        while True:
            f = cls.sized(size)
            if f.insert_all(keys):
                return f
            size = 2 * max(1, size)  # another try with twice the room

    def _print(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> _U(48)) % _U(65535) + _U(1)).astype(np.uint16)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = _U(len(self.table) - 1)
        prints = self._print(keys)
        first = mix(keys) & mask
        return prints, first.astype(np.int64), (first ^ (mix(prints.astype(_U)) & mask)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self._places(keys)
        return (self.table[a] == p[:, None]).any(axis=1) | (self.table[b] == p[:, None]).any(axis=1)

    def insert_all(self, keys: np.ndarray) -> bool:
        """Fills free slots of the first, then of the second buckets at once; the few keys without one are inserted singly."""
        for side in (1, 2):
            if not len(keys):
                break
            places = self._places(keys)
            at = places[side]
            order = np.argsort(at, kind="stable")
            keys, at, prints = keys[order], at[order], places[0][order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            full = self.table[at] != 0
            ok = np.flatnonzero(rank < (~full).sum(axis=1))
            slot = np.argsort(full[ok], axis=1, kind="stable")[np.arange(len(ok)), rank[ok]]
            self.table[at[ok], slot] = prints[ok]
            keys = np.delete(keys, ok)
        return all(self.insert(k) for k in keys)

    def insert(self, key: int) -> bool:
        p, a, b = (x[0] for x in self._places(np.array([key], _U)))
        mask = len(self.table) - 1
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = p
                return True
        at = int(a)
        for kick in range(self.KICKS):
            slot = kick % self.SLOTS
            p, self.table[at, slot] = self.table[at, slot], p
            at ^= int(mix(np.array([p], _U))[0]) & mask
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = p
                return True
        return False

    def delete(self, key: int) -> bool:
        p, a, b = (x[0] for x in self._places(np.array([key], _U)))
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == p)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False


def references(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key, key2, doc_id), once for each key that a row of docs holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for i, j, text in text_slices(batch.column(1)):
                _, _, d, h, h2, long = line_keys(text, min_chars)
                doc, key, key2 = ids[i:j][d[long]], signed(h[long]), signed(h2[long])
                order = np.lexsort((key2, key, doc))
                doc, key, key2 = doc[order], key[order], key2[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (key2[1:] != key2[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(key2[new]), pa.array(doc[new])], [*KEY, "doc_id"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key long, key2 long, doc_id long")


class LineIndex:
    """The state: ``refs`` (key, key2, doc_id), ``counts`` (key, key2, n_docs, keeper) and ``filters`` (shard, table)."""

    def __init__(self, refs: DataFrame, counts: DataFrame, filters: DataFrame, min_docs: int, min_chars: int, shards: int, scratch: Scratch):
        self.refs, self.counts, self.filters = refs, counts, filters
        self.min_docs, self.min_chars, self.shards, self.scratch = min_docs, min_chars, shards, scratch

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 5, min_chars: int = 40, shards: int | None = None) -> LineIndex:
        """``shards`` sets the work and memory of one filter task; by default a shard has at most about ``SHARD_KEYS`` repeated keys."""
        scratch = Scratch(docs.sparkSession)
        refs = scratch.save(references(docs, min_chars).distinct(), "refs")
        counts = scratch.save(cls._count(refs), "counts")
        repeated = counts.where(F.col("n_docs") >= min_docs)
        shards = shards or max(64, -(-repeated.count() // SHARD_KEYS))

        def make(key: tuple[int], t: pa.Table) -> pa.Table:
            keys = np.asarray(t.column("key").combine_chunks()).view(_U)
            return pa.table({"shard": pa.array([int(key[0].as_py())], pa.int32()), "table": [CuckooFilter.built(keys).table.tobytes()]})

        filters = scratch.save(repeated.select(cls._shard(shards), "key").groupBy("shard").applyInArrow(make, "shard int, table binary"), "filters")
        return cls(refs, counts, filters, min_docs, min_chars, shards, scratch)

    @staticmethod
    def _shard(shards: int) -> Column:
        return F.pmod("key", F.lit(shards)).cast("int").alias("shard")

    @staticmethod
    def _count(refs: DataFrame) -> DataFrame:
        return refs.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))

    def _moved(self, refs: DataFrame, changed: DataFrame) -> LineIndex:
        """The index over other refs, of which ``changed`` came or went; keys and shards that have no part in it stay."""
        scratch = self.scratch
        keys = scratch.save(changed.select(*KEY).distinct(), "changed")
        recounted = scratch.save(self._count(chosen(refs, keys, KEY)), "recounted")
        counts = chosen(self.counts, keys, KEY, "left_anti").unionByName(recounted)
        limit = F.col("n_docs") >= self.min_docs
        was = chosen(self.counts.where(limit), keys, KEY).select(*KEY, F.lit(-1).alias("change"))
        moves = was.unionByName(recounted.where(limit).select(*KEY, F.lit(1).alias("change"))).groupBy(*KEY).agg(F.sum("change").alias("change")).where("change <> 0")
        moves = scratch.save(moves.select(self._shard(self.shards), "key", F.col("change").cast("int"), F.lit(None).cast("binary").alias("table")), "moves")
        touched = F.broadcast(moves.select("shard").distinct())  # at most one row a shard
        now = counts.where(limit).select(self._shard(self.shards), "key", F.lit(0).alias("change"), F.lit(None).cast("binary").alias("table")).join(touched, "shard", "left_semi")
        held = self.filters.join(touched, "shard", "left_semi").select("shard", F.lit(None).cast("long").alias("key"), F.lit(0).alias("change"), "table")

        def update(key: tuple[int], t: pa.Table) -> pa.Table:
            d = t.to_pydict()
            tables = [x for x in d["table"] if x is not None]
            f = CuckooFilter(np.frombuffer(tables[0], np.uint16).reshape(-1, 4).copy()) if tables else None
            moved = sorted((c, k) for k, c in zip(d["key"], d["change"]) if c and k is not None)  # deletions first
            ok = f is not None
            for c, k in moved:
                ok = ok and (f.insert(k % (1 << 64)) if c > 0 else f.delete(k % (1 << 64)))
            if not ok:  # no room: built anew from the shard's exact keys
                f = CuckooFilter.built(np.array([k % (1 << 64) for k, c, x in zip(d["key"], d["change"], d["table"]) if c == 0 and x is None], _U))
            return pa.table({"shard": pa.array([int(key[0].as_py())], pa.int32()), "table": [f.table.tobytes()]})

        updated = scratch.save(moves.unionByName(now).unionByName(held).groupBy("shard").applyInArrow(update, "shard int, table binary"), "filters")
        filters = self.filters.join(touched, "shard", "left_anti").unionByName(updated)
        return LineIndex(refs, counts, filters, self.min_docs, self.min_chars, self.shards, scratch)

    def insert(self, docs: DataFrame) -> LineIndex:
        found = self.scratch.save(references(docs, self.min_chars).distinct(), "found")
        held = chosen(self.refs, found.select("doc_id").distinct(), ["doc_id"])
        added = self.scratch.save(found.join(held, [*KEY, "doc_id"], "left_anti"), "added")
        return self._moved(self.refs.unionByName(added), added)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        ids = self.scratch.save(doc_ids.select(F.col("doc_id").cast("long")).distinct(), "deleted")
        return self._moved(chosen(self.refs, ids, ["doc_id"], "left_anti").select(*KEY, "doc_id"), chosen(self.refs, ids, ["doc_id"]))

    def compact(self) -> LineIndex:
        """The same index with each of its tables written as one again."""
        kept = (self.scratch.save(t, name) for t, name in ((self.refs, "refs"), (self.counts, "counts"), (self.filters, "filters")))
        return LineIndex(*kept, self.min_docs, self.min_chars, self.shards, self.scratch)

    def _passes(self) -> list[tuple[int, int]]:
        """Ranges of shards (first, behind the last) whose filters take at most FILTER_BYTES together, or one shard each."""
        out: list[tuple[int, int]] = []
        total = 0
        for r in self.filters.select("shard", F.length("table").alias("size")).orderBy("shard").collect():  # one row a shard
            total += r["size"]
            if out and total <= FILTER_BYTES:
                out[-1] = (out[-1][0], r["shard"] + 1)
            else:
                out.append((r["shard"], r["shard"] + 1))
                total = r["size"]
        return out

    def _probed(self, first: int, behind: int) -> DataFrame:
        """The refs whose keys the filters of these shards let through."""
        tables = {r["shard"]: bytes(r["table"]) for r in self.filters.where(F.col("shard").between(first, behind - 1)).collect()}
        sent, shards = self.refs.sparkSession.sparkContext.broadcast(tables), self.shards

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {s: CuckooFilter(np.frombuffer(t, np.uint16).reshape(-1, 4)) for s, t in sent.value.items()}
            for batch in batches:
                keys = np.asarray(batch.column(0))
                shard = keys % shards
                order = np.argsort(shard, kind="stable")
                ends = np.searchsorted(shard[order], np.arange(first, behind), side="right")
                hit, at = np.zeros(len(keys), bool), int(np.searchsorted(shard[order], first))
                for s, end in zip(range(first, behind), ends.tolist()):
                    if end > at and s in filters:
                        hit[order[at:end]] = filters[s].contains(keys[order[at:end]].view(_U))
                    at = end
                yield batch.filter(pa.array(hit))

        return self.refs.mapInArrow(probe, "key long, key2 long, doc_id long")

    def losses(self) -> DataFrame:
        """(doc_id, keys, keys2): the keys whose lines each document loses."""
        maybe = None
        for first, behind in self._passes():
            part = self._probed(first, behind)
            maybe = part if maybe is None else maybe.unionByName(part)
        maybe = self.refs.where("false") if maybe is None else maybe  # no key is repeated
        repeated = self.counts.where(F.col("n_docs") >= self.min_docs).select(*KEY, "keeper")
        lost = maybe.join(repeated, KEY).where("doc_id <> keeper")
        lost = lost.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("k"))  # at most the keys of one document
        return lost.select("doc_id", F.col("k.key").alias("keys"), F.col("k.key2").alias("keys2"))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """docs with the repeated lines gone from ``text``, plus n_lines and n_dropped."""
        names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
        losses = self.losses().withColumnsRenamed({"doc_id": "__doc", "keys": "__keys", "keys2": "__keys2"})
        joined = docs.join(losses, F.col("doc_id") == F.col("__doc"), "left").select(*names, "text", "__keys", "__keys2")
        min_chars = self.min_chars
        schema = joined.drop("__keys", "__keys2").schema.add("n_lines", "long").add("n_dropped", "long")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column, keys, keys2 = (batch.column(len(names) + k) for k in range(3))
                for i, j, text in text_slices(column):
                    s, e, d, h, h2, long = line_keys(text, min_chars)
                    part, part2 = keys.slice(i, j - i), keys2.slice(i, j - i)
                    sizes = np.asarray(part.value_lengths().fill_null(0))
                    drop = np.zeros(len(d), bool)
                    n = j - i
                    if sizes.any():
                        lost = np.stack([np.repeat(np.arange(n), sizes).astype(_U), np.asarray(part.flatten()).view(_U), np.asarray(part2.flatten()).view(_U)])
                        at = np.flatnonzero(long & (sizes[d] > 0))
                        with np.errstate(over="ignore"):
                            drop[at] = np.isin(mix(h[at] + h2[at] * _STEP[6] + d[at].astype(_U) * _STEP[5]), mix(lost[1] + lost[2] * _STEP[6] + lost[0] * _STEP[5]))
                    out = []
                    raw = text.data.tobytes()
                    touched = np.bincount(d[drop], minlength=n)
                    first = np.searchsorted(d, np.arange(n + 1))
                    for k in range(n):
                        if touched[k]:
                            own = range(first[k], first[k + 1])
                            out.append(b"\n".join(raw[s[x] : e[x]] for x in own if not drop[x]).decode())
                        else:
                            out.append(raw[text.bounds[k] : text.bounds[k + 1]].decode())
                    rest = [batch.column(c).slice(i, j - i) for c in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.string()), pa.array(np.diff(first)), pa.array(touched)], [*names, "text", "n_lines", "n_dropped"])

        return joined.mapInArrow(run, schema)


def digest(text) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
