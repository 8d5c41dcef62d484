"""Language-model scoring with a probabilistic suffix tree, beside a smoothed word-frequency baseline.

The text is the stream of its lower-cased (A-Z) words, one space between, and an end symbol; symbols are bytes. A state of
the tree is a context of up to ``depth`` bytes. It is retained if it occurs ``min_count`` times and its next-symbol
distribution diverges from that of the context one symbol shorter: count * KL >= ``min_gain`` nats. Distributions are
smoothed recursively, P(x | s) = (n(s, x) + mu * P(x | next shorter state)) / (n(s) + mu), down to add-one bytes. A symbol
is scored by the longest retained suffix of what stands before it.

Every retained state is used. Sent to the executors are the most frequent ones, at most ``max_entries`` (state, next
symbol) entries of them, and a bit filter of fixed size of the others. A window whose context may be one of the others is
settled by a join of the distinct such windows with the table of those states. A context is never more frequent than
its suffix, so the states sent never back off to one that isn't, and the others are applied last, shortest first.

Counts cover every training text: packed (depth + 1)-byte windows and word hashes are counted a slice at a time,
summed by key, and the shorter contexts are sums over those. Word counts are unbounded, so only the ``common`` most frequent words are sent; the rest of each
document's words are joined with the count table.

Defined results: null or blank text is the end symbol alone; rows with equal doc_id are scored each on its own; a null
doc_id is a training row; without training rows c = 0 and the tree is uniform; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .vectext import _LOWER, Text, list_array, mix, signed, text_slices

_U = np.uint64
SPACE, STOP = 32, 10
END_WORD = -1  # key of the end token among word hashes
FILTER_BITS = 1 << 27


def symbols(text: Text, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of depth + 1 bytes (context and symbol, the symbol lowest) of each scored symbol, and its document."""
    s, e, d = text.words()
    n = len(text)
    counts = np.bincount(d, minlength=n)
    last = np.ones(len(s), bool)
    last[:-1] = d[1:] != d[:-1]
    # Each document: depth stops, then its words, each followed by a space or, at the end, a stop.
    size = np.bincount(d, weights=e - s + 1, minlength=n).astype(np.int64) + (counts == 0)
    begin = np.cumsum(size + depth) - size - depth
    stream = np.full(int((size + depth).sum()), STOP, np.uint8)
    lengths = e - s
    first = begin[d] + depth + (np.cumsum(lengths + 1) - lengths - 1) - (np.cumsum(size) - size - np.cumsum(counts == 0) + (counts == 0))[d]
    where = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    stream[np.repeat(first, lengths) + where] = _LOWER[text.data[np.repeat(s, lengths) + where]]
    stream[(first + lengths)[~last]] = SPACE
    owner = np.repeat(np.arange(n), size)
    at = np.arange(int(size.sum())) + np.repeat((np.arange(n) + 1) * depth, size)
    wide = np.zeros(len(stream), _U)
    for k in range(depth + 1):
        wide[k:] |= stream[: len(stream) - k].astype(_U) << _U(8 * k)
    return wide[at], owner


def word_keys(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word, lower-cased; hashes are never END_WORD."""
    s, e, d = text.words()
    h = signed(text.hash_ranges(s, e, lower=True)).copy()
    h[h == END_WORD] = 0
    return h, d


def held_out(doc_id, modulus: int, remainder: int):
    """Column: is crc32 of the doc_id as text that remainder?"""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def counts(docs: DataFrame, depth: int) -> DataFrame:
    """(word, key, n): counts of word hashes (true) and of packed windows (false) over the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ends = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(back, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        def out(word: bool, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), word)), pa.array(keys), pa.array(n)], ["word", "key", "n"])

        for batch in batches:
            for i, j, text in text_slices(batch.column(0)):
                words, _ = word_keys(text)
                yield out(True, *np.unique(words, return_counts=True))
                ends += j - i
                held.append(np.unique(signed(symbols(text, depth)[0]), return_counts=True))
                if sum(len(k) for k, _ in held) > 1_500_000:
                    held = [merged()]
                    if len(held[0][0]) > 750_000:
                        yield out(False, *held.pop())
        if held:
            yield out(False, *merged())
        if ends:
            yield out(True, np.array([END_WORD]), np.array([ends]))

    return docs.select("text").mapInArrow(run, "word boolean, key long, n long").groupBy("word", "key").agg(F.sum("n").alias("n"))


class Tree:
    """States and entries by order; keys are the packed context (and symbol) bytes, sorted."""

    def __init__(self, depth: int, mu: float):
        self.depth, self.mu = depth, mu
        self.base = np.full(256, 1 / 256)
        self.states: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # order: keys, back-off weight
        self.entries: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # order: keys, probability

    @classmethod
    def build(cls, depth: int, mu: float, base: np.ndarray, levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Tree:
        """``base``: counts of the 256 bytes. ``levels``: order to (context, symbol, n) of every entry of its retained states."""
        tree = cls(depth, mu)
        tree.base = (base + 1) / (base.sum() + 256)
        for order in sorted(levels):
            context, symbol, n = levels[order]
            if not len(n):
                continue
            states, back = np.unique(context, return_inverse=True)
            total = np.bincount(back, weights=n)
            key = context << _U(8) | symbol
            parent = tree.probability(key, order - 1)
            sort = np.argsort(key)
            tree.entries[order] = key[sort], ((n + mu * parent) / (total[back] + mu))[sort]
            tree.states[order] = states, mu / (total + mu)
        return tree

    def probability(self, windows: np.ndarray, depth: int | None = None) -> np.ndarray:
        """P(last byte | bytes before) by the longest retained suffix of at most ``depth`` bytes."""
        out = np.ones(len(windows))
        todo = np.arange(len(windows))
        for order in range(self.depth if depth is None else depth, 0, -1):
            if order not in self.states or not len(todo):
                continue
            w = windows[todo] & _U((1 << 8 * (order + 1)) - 1)
            keys, p = self.entries[order]
            at = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
            hit = keys[at] == w
            out[todo[hit]] *= p[at[hit]]
            todo, w = todo[~hit], w[~hit] >> _U(8)
            states, weight = self.states[order]
            at = np.minimum(np.searchsorted(states, w), len(states) - 1)
            known = states[at] == w
            out[todo[known]] *= weight[at[known]]
        out[todo] *= self.base[(windows[todo] & _U(255)).astype(np.int64)]
        return out


def filter_bits(order: int, contexts: np.ndarray) -> list[np.ndarray]:
    """The two bits of each state in the filter."""
    h = mix(contexts | _U(order << 56))
    return [h & _U(FILTER_BITS - 1), h >> _U(64 - FILTER_BITS.bit_length() + 1)]


def state_filter(states: DataFrame) -> np.ndarray:
    """The filter of (order, context) rows as 64-bit words; at most FILTER_BITS / 64 rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders, contexts = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(_U)
            bits = np.concatenate([b for k in np.unique(orders) for b in filter_bits(int(k), contexts[orders == k])] or [np.zeros(0, _U)])
            yield pa.RecordBatch.from_arrays([pa.array(signed(bits >> _U(6))), pa.array(signed(_U(1) << (bits & _U(63))))], ["word", "bit"])

    words = states.select("order", "context").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[np.asarray(words.column("word"))] = np.asarray(words.column("bit"))
    return out.view(_U)


def suspects(known: np.ndarray, windows: np.ndarray, order: int) -> np.ndarray:
    """May the context of that order of each window be a state in the filter?"""
    contexts = windows >> _U(8) & _U((1 << 8 * order) - 1)
    out = np.ones(len(windows), bool)
    for bits in filter_bits(order, contexts):
        out &= (known[(bits >> _U(6)).astype(np.int64)] >> (bits & _U(63)) & _U(1)).astype(bool)
    return out


def learn(windows: DataFrame, depth: int, min_count: int, min_gain: float, mu: float, max_entries: int, scratch: Scratch) -> Tree:
    """The tree of the most frequent states from (key, n) of packed windows."""
    return grow(windows, depth, min_count, min_gain, mu, max_entries, scratch)[0]


def grow(windows: DataFrame, depth: int, min_count: int, min_gain: float, mu: float, max_entries: int, scratch: Scratch) -> tuple[Tree, DataFrame | None]:
    """The tree of the most frequent states and (order, context, total, next) of all other retained ones, if there are any."""
    mask = lambda c, bytes_: c.bitwiseAND(F.lit((1 << 8 * bytes_) - 1)) if bytes_ < 8 else c
    of = lambda t: t.select(F.shiftrightunsigned("key", 8).alias("context"), F.col("key").bitwiseAND(F.lit(255)).alias("symbol"), "n")
    tables = {}
    level = windows
    for order in range(depth, -1, -1):
        level = level.groupBy(mask(F.col("key"), order + 1).alias("key")).agg(F.sum("n").alias("n"))
        level = tables[order] = scratch.save(level, f"order{order}")
    base = np.zeros(256)
    for r in tables[0].collect():  # at most 256 rows
        base[r["key"]] = r["n"]
    states = None
    for order in range(1, depth + 1):
        own = of(tables[order])
        totals = own.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("size")).where(F.col("total") >= min_count)
        up = tables[order - 1].select(F.col("key").alias("shorter"), F.col("n").alias("m"))
        up_total = of(tables[order - 1]).groupBy(F.col("context").alias("above")).agg(F.sum("n").alias("m_total"))
        e = own.join(totals, "context").withColumn("shorter", mask(F.shiftleft("context", 8).bitwiseOR(F.col("symbol")), order))
        e = e.withColumn("above", F.shiftrightunsigned("shorter", 8)).join(up, "shorter").join(up_total, "above")
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") * F.col("m_total") / F.col("m")))
        kept = e.groupBy("context").agg(gain.alias("gain"), F.first("total").alias("total"), F.count("*").alias("size")).where(F.col("gain") >= min_gain)
        kept = kept.select(F.lit(order).alias("order"), "context", "total", "size")
        states = kept if states is None else states.unionByName(kept)
    states = scratch.save(states, "states")
    least, whole = least_to_send(states, F.col("total"), F.sum("size"), max_entries)
    levels = {}
    for order in range(1, depth + 1):
        kept = states.where((F.col("order") == order) & (F.col("total") >= least)).select("context")
        found = of(tables[order]).join(kept, "context").toArrow()  # at most max_entries rows over all orders
        levels[order] = tuple(np.asarray(found.column(c)).astype(t) for c, t in (("context", _U), ("symbol", _U), ("n", float)))
    tree = Tree.build(depth, mu, base, levels)
    if whole:
        return tree, None
    others = None
    for order in range(1, depth + 1):
        kept = states.where((F.col("order") == order) & (F.col("total") < least)).select("order", "context", "total")
        found = of(tables[order]).join(kept, "context").groupBy("order", "context", "total").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("next"))
        others = found if others is None else others.unionByName(found)
    return tree, scratch.save(others, "others")


def least_to_send(rows: DataFrame, count: Column, size: Column, room: int) -> tuple[int, bool]:
    """The smallest count such that the rows from there up have ``room`` in sum, and whether these are all rows.

    Counts are grouped by their size to about one part in 64, so at most some 4,000 sums come to the driver.
    """
    power = F.floor(F.log2(count.cast("double"))).cast("int")
    step = F.pow(F.lit(2.0), F.greatest(power - 6, F.lit(0)))
    group = (F.floor(count / step) * step).cast("long")
    least = 1 << 62
    for count_, size_ in sorted(((r["g"], r["size"]) for r in rows.groupBy(group.alias("g")).agg(size.alias("size")).collect()), reverse=True):
        if size_ > room:
            return least, False
        least, room = count_, room - size_
    return 0, True


def settled(windows: DataFrame, sent, others: DataFrame) -> DataFrame:
    """(window, p): probability of each of the distinct windows by all states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, known, *_ = sent.value
        for batch in batches:
            w = np.asarray(batch.column(0)).astype(_U)
            p = tree.probability(w)
            for order in range(1, tree.depth + 1):
                hit = suspects(known, w, order)
                context = w[hit] >> _U(8) & _U((1 << 8 * order) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(signed(w[hit])), pa.array(p[hit]), pa.array(np.full(len(context), order, np.int32)), pa.array(signed(context))], ["window", "p", "order", "context"])

    asked = windows.select("window").distinct().mapInArrow(run, "window long, p double, order int, context long")
    n = F.coalesce(F.element_at("next", F.col("window").bitwiseAND(F.lit(255))), F.lit(0))
    met = asked.join(others, ["order", "context"], "left").select("window", "p", F.struct("order", F.coalesce("total", F.lit(0)).alias("total"), n.alias("n")).alias("state"))
    mu = F.lit(float(sent.value[0].mu))
    step = lambda p, s: (s["n"] + mu * p) / (s["total"] + mu)
    return met.groupBy("window").agg(F.first("p").alias("p"), F.array_sort(F.collect_list("state")).alias("states")).select("window", F.aggregate("states", F.col("p"), step).alias("p"))


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, depth: int = 5, min_count: int = 16, min_gain: float = 20.0, mu: float = 8.0, max_entries: int = 2_000_000, common: int = 1 << 19) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder))
    counted = scratch.save(counts(docs.where("not held_out"), depth), "counts")
    words = counted.where("word").select("key", "n")
    tree, others = grow(counted.where("not word").select("key", "n"), depth, min_count, min_gain, mu, max_entries, scratch)
    known_others = None if others is None else state_filter(others)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    limit, _ = least_to_send(words, F.col("n"), F.count("*"), common)
    known = words.where(F.col("n") >= limit).toArrow()  # at most ``common`` rows
    order = np.argsort(np.asarray(known.column("key")))
    sent = spark.sparkContext.broadcast((tree, known_others, np.asarray(known.column("key"))[order], np.asarray(known.column("n"))[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, known_others, keys, n = sent.value
        for batch in batches:
            for i, j, text in text_slices(batch.column(1)):
                size = j - i
                windows, owner = symbols(text, tree.depth)
                distinct_, back = np.unique(windows, return_inverse=True)
                late = np.zeros(len(distinct_), bool)
                for order in range(1, tree.depth + 1 if known_others is not None else 1):
                    late |= suspects(known_others, distinct_, order)
                p = np.bincount(owner, weights=np.where(late, 0, np.log10(tree.probability(distinct_)))[back], minlength=size)
                wait = late[back]
                pairs, times = np.unique(owner[wait] * len(distinct_) + back[wait], return_counts=True)
                late_cuts = np.searchsorted(pairs, np.arange(1, size) * len(distinct_))
                late_windows = signed(distinct_)[pairs % len(distinct_)]
                h, d = word_keys(text)
                h, d = np.concatenate([h, np.full(size, END_WORD)]), np.concatenate([d, np.arange(size)])
                tokens = np.bincount(d, minlength=size)
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                logs = np.bincount(d[hit], weights=np.log10(n[at[hit]] + 1.0), minlength=size) if hit.any() else np.zeros(size)
                seen = np.bincount(d[hit], minlength=size)
                rest_h, rest_d = h[~hit], d[~hit]
                o = np.argsort(rest_d, kind="stable")
                cuts = np.searchsorted(rest_d[o], np.arange(1, size))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, size) for c in (batch.column(0), batch.column(2))), pa.array(tokens), pa.array(seen), pa.array(logs), pa.array(p), list_array(np.split(rest_h[o], cuts), pa.int64()), list_array(np.split(late_windows, late_cuts), pa.int64()), list_array(np.split(times, late_cuts), pa.int64())], ["doc_id", "held_out", "n_tokens", "seen", "logs", "score", "rest", "late", "times"])

    scored = docs.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, seen long, logs double, score double, rest array<long>, late array<long>, times array<long>")
    scored = scratch.save(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = words.where(F.col("n") < limit)
    rest = scored.select("row", F.explode("rest").alias("key")).join(rare, "key").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"))
    joined = scored.drop("rest", "late", "times").join(rest, "row", "left")
    if others is not None:
        late = scored.select("row", F.explode(F.arrays_zip("late", "times")).alias("l")).select("row", F.col("l.late").alias("window"), F.col("l.times").alias("times"))
        late = late.join(settled(late, sent, others), "window").groupBy("row").agg(F.sum(F.col("times") * F.log10("p")).alias("late_logs"))
        joined = joined.join(late, "row", "left").withColumn("score", F.col("score") + F.coalesce("late_logs", F.lit(0.0))).drop("late_logs")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
