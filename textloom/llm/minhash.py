"""Near-duplicate classes by one-permutation MinHash with optimal densification and banded buckets.

Documents with equal shingle sets are one class from the start. Each class gets a one-permutation signature: the
hash range is cut into ``bands * rows`` bins, each bin keeps its smallest hash, and an empty bin borrows from the
first non-empty one in its own fixed random order of all bins. Rows of a band are hashed to a bucket.

Shingles that no other document in a shared bucket has bound what two documents can have in common: with u of its n
shingles its own, a document meets one of m shingles in at most n - u, so 100 * (n - u) < percent * (u + m) proves
the two unlinked. Documents proven unlinked to all members of a bucket leave it before any pair is made.

Candidates are stars: every bucket pairs one hub, the member with the smallest share of own shingles and so the likely
origin of the others, with its other members. Their number follows the rows of the buckets, never its square. Pairs are
confirmed on the full shingle sets and confirmed links contracted to components.

Buckets that still hold several components are settled exactly, without pairing their members. Their nodes are
described by what sets them apart from one reference, the hub with most links in the bucket's largest component: the
difference D of the two sets. |x - y| of two nodes is |Dx - Dy| (symmetric differences), and a node that isn't
linked to the reference has a large D, so whoever is linked to it must share a stated number of elements of D with it. Both
therefore hold one common element among the first few of their D, rarest first (prefix and position filters of
set similarity joins). A join on those rare elements gives the last candidates, which are confirmed in the same way. What
all copies share is in no D, so a large group of copies makes no large key. No pair that shares a bucket goes untested
unless it is proven unlinked or joined already.

Defined results: null or blank text has an empty set and is linked with nothing; rows that share a doc_id are one
document (a link of either text counts); a null doc_id is linked with nothing, gets a null component and is kept.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chosen
from .vectext import _STEP, list_array, mix, release, shingle_sets, signed, text_slices

_U = np.uint64
SET_VALUES = 1 << 19  # shingles taken apart at once
BLOCK = 128


class OnePermutation:
    """Signatures of sorted 64-bit hash sets and their band buckets."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        self.bands, self.rows, self.k = bands, rows, bands * rows
        rng = np.random.default_rng(seed)
        self.order = np.argsort(rng.random((self.k, self.k)), axis=1)
        self.salt = rng.integers(1, 1 << 62, bands, dtype=np.int64).astype(_U)

    def signature(self, values: np.ndarray) -> np.ndarray:
        """``values``: sorted and distinct, at least one."""
        bins = (((values >> _U(32)) * _U(self.k)) >> _U(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        sig, full = np.zeros(self.k, _U), np.zeros(self.k, bool)
        sig[bins[first]], full[bins[first]] = values[first], True
        empty = np.flatnonzero(~full)
        if len(empty):
            order = self.order[empty]
            sig[empty] = sig[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
        return sig

    def buckets(self, signatures: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            s = signatures.reshape(len(signatures), self.bands, self.rows)
            return mix((mix(s) * _STEP[: self.rows]).sum(axis=2, dtype=_U) + self.salt)


def signatures(docs: DataFrame, shingle: int, lower: bool, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, buckets): set size, 128-bit identity of the set, band buckets (none if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        oph = OnePermutation(bands, rows)
        for batch in batches:
            for i, j, text in text_slices(batch.column(1)):
                sets = shingle_sets(text, shingle, lower)
                n = np.array([len(s) for s in sets], np.int64)
                with np.errstate(over="ignore"):
                    s1 = np.array([s.sum(dtype=_U) for s in sets], _U)
                    s2 = np.array([mix(s ^ _STEP[9]).sum(dtype=_U) for s in sets], _U)
                full = np.flatnonzero(n)
                out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sets)
                if len(full):
                    for d, b in zip(full, signed(oph.buckets(np.stack([oph.signature(sets[d]) for d in full])))):
                        out[d] = b
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(signed(s1)), pa.array(signed(s2)), list_array(out, pa.int64())], ["doc_id", "n_shingles", "s1", "s2", "buckets"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, buckets array<long>")


def full_sets(docs: DataFrame, shingle: int, lower: bool) -> DataFrame:
    """(node, v, shingles): the sorted distinct shingle hashes of each text as bytes, and a hash of that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, text in text_slices(batch.column(1)):
                sets = shingle_sets(text, shingle, lower)
                v = np.array([s.sum(dtype=_U) for s in sets], _U)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(signed(v)), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "v", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, v long, shingles binary")


def own_shingles(sets: DataFrame) -> DataFrame:
    """(node, own): the number of shingles that only this one of the nodes has; nodes without any are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = np.asarray(pc.binary_length(column), np.int64) // 8
            ends = np.cumsum(sizes)
            at = 0
            while at < len(sizes):  # some MB at a time
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SET_VALUES, side="right")))
                flat = np.frombuffer(b"".join(column.slice(at, end - at).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.asarray(batch.column(0))[at:end], sizes[at:end]))], ["shingle", "node"])
                at = end

    rows = sets.select("node", "shingles").mapInArrow(run, "shingle long, node long")
    alone = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
    return alone.groupBy("node").agg(F.count("*").alias("own"))


def in_blocks(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, block, kind, id, v, shingles) of pairs (a, b): in each block of about ``BLOCK`` partners b (kind 1) of one a,
    the rows of a itself (kind 0) come first, so a set is sent once a block and however many partners one a has,
    they are spread over many tasks."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    dealt = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), "b")
    rows = lambda p, kind, on: p.join(sets.withColumnRenamed("node", on), on).select("a", "block", F.lit(kind).alias("kind"), F.col(on).alias("id"), "v", "shingles")
    both = rows(dealt.select("a", "block").distinct(), 0, "a").unionByName(rows(dealt, 1, "b"))
    return both.repartition("a", "block").sortWithinPartitions("a", "block", "kind", "v")


def runs_of_one_head(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], list[int], list[int], list[np.ndarray]]]:
    """(a, sets of a, partner ids, their v, their sets) of rows ordered as ``in_blocks`` leaves them, a batch and block at a time."""
    held, heads = None, []
    for batch in batches:
        a, block, kind, ids, v, sets = (c.to_pylist() for c in batch.columns)
        start = 0
        for k in range(len(a) + 1):
            new = k < len(a) and (a[k], block[k]) != held
            if (new or k == len(a)) and k > start:
                own = [x for x in range(start, k) if kind[x]]
                heads += [np.frombuffer(sets[x], _U) for x in range(start, k) if not kind[x]]
                if own:
                    yield held[0], heads, [ids[x] for x in own], [v[x] for x in own], [np.frombuffer(sets[x], _U) for x in own]
            if new:
                held, heads, start = (a[k], block[k]), [], k
        release(batch.nbytes)


def places(head: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position in the sorted head of each value, and whether it is there."""
    at = np.minimum(np.searchsorted(head, values), max(0, len(head) - 1))
    return at, head[at] == values if len(head) else np.zeros(len(values), bool)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: those of the pairs with 100 * common >= percent * union of the full sets; of several sets of one node any may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, heads, ids, _, own in runs_of_one_head(batches):
            sizes = np.array([len(s) for s in own], np.int64)
            owner, flat = np.repeat(np.arange(len(own)), sizes), np.concatenate(own)
            linked = np.zeros(len(own), bool)
            for head in heads:
                both = np.bincount(owner[places(head, flat)[1]], minlength=len(own))
                linked |= (both > 0) & (100 * both >= percent * (len(head) + sizes - both))
            found = np.unique(np.array(ids, np.int64)[linked])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), a)), pa.array(found)], ["a", "b"])

    return in_blocks(pairs, sets).mapInArrow(run, "a long, b long")


def differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(ref, node, v, n, n_ref, d, linked, apart) of (a: reference, b: node): the elements that only one of both sets has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, heads, ids, v, own in runs_of_one_head(batches):
            head = heads[0]  # any set will do as a reference, but the same one in all blocks
            apart, linked = [], []
            for s in own:
                at, hit = places(head, s)
                rest = np.ones(len(head), bool)
                rest[at[hit]] = False
                apart.append(signed(np.concatenate([s[~hit], head[rest]])))
                both = int(hit.sum())
                linked.append(both > 0 and 100 * both >= percent * (len(head) + len(s) - both))
            n = len(own)
            cols = [pa.array(np.full(n, a)), pa.array(ids, pa.int64()), pa.array(v, pa.int64()), pa.array([len(s) for s in own], pa.int64()), pa.array(np.full(n, len(head))), pa.array([len(x) for x in apart], pa.int64()), pa.array(linked, pa.bool_()), list_array(apart, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["ref", "node", "v", "n", "n_ref", "d", "linked", "apart"])

    return in_blocks(members, sets).mapInArrow(run, "ref long, node long, v long, n long, n_ref long, d long, linked boolean, apart array<long>")


def settling_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of nodes of different ``comp`` beside one reference that can be linked, of which one isn't linked to it.

    With D the difference from the reference and s = 100 + percent, two linked nodes x, y share an overlap o of
    2 * s * o >= s * (dx + dy) - (100 - percent) * (nx + ny). Elements of one node only are first in its order and need no rows.
    """
    s, r = 100 + percent, 100 - percent
    key = ["ref", "node", "v"]
    rows = apart.select(*key, F.explode("apart").alias("e"))
    common = rows.groupBy("ref", "e").agg(F.count("*").alias("c")).where("c > 1")
    listed = rows.join(common, ["ref", "e"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("c", "e"))).alias("items"))  # at most one document's shingles
    listed = apart.drop("apart").join(listed, key).withColumn("skipped", F.col("d") - F.size("items"))
    least_any = f"greatest(1, cast(floor(({s} * d + {r} * (n_ref - n)) / {2 * s}) as long) + 1)"  # shared with any node that isn't linked to the reference
    least_probe = f"greatest(1, cast(ceil(d - n * {r} / {percent}) as long))"  # shared by such a node with any other

    def prefix(rows: DataFrame, least: str, side: str) -> DataFrame:
        kept = rows.withColumn("few", F.expr(f"slice(items, 1, cast(greatest(0, d - {least} + 1 - skipped) as int))"))
        kept = kept.select("ref", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "comp", "n", "d", "skipped")], F.posexplode("few").alias("at", "item"))
        return kept.select("ref", F.col("item.e").alias("e"), F.col("item.c").alias(f"c_{side}"), *[f"{c}_{side}" for c in ("node", "comp", "n", "d")], (F.col(f"d_{side}") - F.col(f"skipped_{side}") - F.col("at")).alias(f"left_{side}"))

    probe, index = prefix(listed.where("not linked"), least_probe, "x"), prefix(listed, least_any, "y")
    can = f"comp_x <> comp_y and {2 * s} * least(left_x, left_y) >= {s} * (d_x + d_y) - {r} * (n_x + n_y)"
    met = probe.join(index, ["ref", "e"]).where(can)
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def contract(labels: DataFrame | None, edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Labels (node, comp) joined along the edges (a, b): every component gets its smallest label.

    A node without a row labels itself. Each pass sends every label to its smallest neighbour and follows that
    pointer to its end, so the number of passes is logarithmic in the length of the longest chain.
    """
    pairs = edges
    if labels is not None:
        for side in ("a", "b"):
            pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("comp").alias("to")), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    pairs = scratch.save(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    roots = None  # (node, comp): old label to new label
    while pairs.take(1):
        step = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
        step = scratch.save(step, "step")
        while True:
            over = step.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
            jumped = scratch.save(step.join(over, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp"), F.col("far").isNotNull().alias("moved")), "jump")
            more = jumped.where("moved").take(1)
            step = jumped.select("node", "comp")
            if not more:
                break
        to = lambda side: step.select(F.col("node").alias(side), F.col("comp").alias("to"))
        if roots is None:
            roots = step
        else:
            moved = roots.join(to("comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
            roots = scratch.save(moved.unionByName(step), "roots")
        for side in ("a", "b"):
            pairs = pairs.join(to(side), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        pairs = scratch.save(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    if roots is None:
        return labels
    if labels is None:
        return roots
    moved = labels.join(roots.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return scratch.save(moved.unionByName(roots.join(labels, "node", "left_anti")), "labels")


def named_by(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with the component of each node."""
    if labels is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, lower: bool = True, bands: int = 48, rows: int = 6) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id linked to it by any chain), kept.

    ``shingle`` words a shingle, a link needs ``percent`` of the union in common. ``bands`` x ``rows`` sets the recall:
    a pair at the threshold 0.8 meets in some bucket but for about 5e-7.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows_ = scratch.save(signatures(docs, shingle, lower, bands, rows), "signatures")
    classes = scratch.save(rows_.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = rows_.join(classes.select("s1", "s2", F.col("rep").alias("doc_id")), ["s1", "s2", "doc_id"], "left_semi")
    members = reps.select(F.col("doc_id").alias("node"), F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket")
    met = scratch.save(members.join(shared, "bucket").distinct(), "met")
    nodes = scratch.save(met.select(F.col("node").alias("doc_id")).distinct(), "nodes")
    sets = scratch.save(full_sets(chosen(docs, nodes, ["doc_id"]), shingle, lower).distinct(), "sets")
    sizes = sets.groupBy("node").agg(F.max(F.length("shingles") / 8).cast("long").alias("n"), F.min(F.length("shingles") / 8).cast("long").alias("n_low"), (F.count("*") == 1).alias("single"))
    # A doc_id with several texts gets no bound from its own shingles.
    sizes = scratch.save(sizes.join(own_shingles(sets), "node", "left").select("node", "n", F.when(F.col("single"), F.coalesce("own", F.lit(0))).otherwise(0).alias("own"), "n_low"), "sizes")
    active = met.join(sizes, "node")
    smallest = active.groupBy("bucket").agg(F.min("n_low").alias("least"))
    common = F.col("n") - F.col("own")
    open_ = 100 * common >= percent * (F.col("own") + F.greatest("least", common))
    active = active.join(smallest, "bucket").where(open_).drop("least", "n_low")
    several = active.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket")
    active = scratch.save(active.join(several, "bucket"), "active")

    # Rows of one document with several texts are joined from the start, by edges between its classes.
    several = rows_.where("n_shingles > 0 and doc_id is not null").join(classes, ["s1", "s2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = several.join(classes.select(F.col("rep").alias("a")).distinct(), "a", "left_semi").distinct()

    # Stars: one hub a bucket.
    hubs = active.groupBy("bucket").agg(F.min_by(F.struct("node", "n", "own"), F.struct(F.col("own") / F.col("n"), "node")).alias("h"))
    shares = "least(n - own, h.n - h.own)"
    stars = active.join(hubs, "bucket").where(f"node <> h.node and 100 * {shares} >= {percent} * (n + h.n - {shares})")
    links = scratch.save(confirm(stars.select(F.col("h.node").alias("a"), F.col("node").alias("b")).distinct(), sets, percent), "stars")
    labels = contract(None, edges.unionByName(links), scratch)

    # Buckets of several components: one reference each, then the pairs that the differences from it leave possible.
    left = scratch.save(named_by(active.select("bucket", "node"), labels), "left")
    mixed = left.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket")
    left = scratch.save(left.join(mixed, "bucket"), "mixed")
    if left.take(1):
        largest = left.groupBy("bucket", "comp").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max(F.struct("m", "comp")).alias("top")).select("bucket", F.col("top.comp").alias("comp"))
        degree = named_by(links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("m")), labels).groupBy("comp").agg(F.max(F.struct("m", "node")).alias("hub"))
        refs = left.groupBy("comp").agg(F.min("node").alias("node")).join(degree, "comp", "left").select("comp", F.coalesce("hub.node", "node").alias("ref"))
        of = largest.join(refs, "comp").select("bucket", "ref")
        beside = left.join(of, "bucket").where("node <> ref").select(F.col("ref").alias("a"), F.col("node").alias("b")).distinct()
        apart = scratch.save(differences(beside, sets, percent), "apart")
        pairs = settling_pairs(named_by(apart, labels), percent)
        more = scratch.save(confirm(pairs, sets, percent), "settled")
        labels = contract(labels, more.unionByName(apart.where("linked").select(F.col("ref").alias("a"), F.col("node").alias("b"))).distinct(), scratch)

    named = classes.withColumn("comp", F.col("rep"))
    if labels is not None:
        named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    out = rows_.select("doc_id", "n_shingles", "s1", "s2").join(named.select("s1", "s2", "comp"), ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.least(F.coalesce("comp", "doc_id"), "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs that stay: those of the smallest doc_id of each component, and those without a doc_id."""
    gone = near_duplicates(docs, **settings).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
