"""The operators against plain models, on the smallest tables and on awkward rows."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import binary, chat, linededup, minhash, mixing, packing, quality, queries, sketch, suffixtree, tokens, toxicity
from textloom.llm.common import table
from textloom.llm.vectext import text_slices

from . import brute

LINE = "This one line is certainly longer than forty characters."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key long, size long, part int, comp long, fingerprint string"
AWKWARD = (
    [(i, t, None, s) for i, (t, s) in enumerate([(None, None), ("", "a"), (" \t\n", "a"), ("word", "b"), ("two words", None), ("x" * 300_000, "a"), ("long words here " * 20_000, "b"), ("é中𝄞 \x1c \x85   q", "b")])]
    + [(10 + k, f"{LINE}\n  {LINE.upper()}\t\nown {k}\n", "en", "c") for k in range(7)]
    + [(20, LINE, "en", "c"), (20, LINE, "en", "c"), (20, "another text of the same id", "en", "c"), (None, LINE, "en", "c"), (None, None, None, None), (-5, "negative id", "de", "a")]
)


@pytest.fixture(scope="module")
def docs(spark, small):
    return table(spark, small, "documents").select("doc_id", "text", "source")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, 1, 7, 7, 7, 7, 7, "f") for r in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_tokenizer())


def check_packing(out, encoded, capacity=2048):
    bins, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    if encoded:
        for i, ids in encoded.items():
            at = 0
            for r in sorted(pieces[i], key=lambda r: r["piece"]):
                assert r["start"] == at and r["ids_crc32"] == brute.crc(ids[at : at + r["length"]])
                at += r["length"]
            assert at == len(ids)
    return len(bins)


def test_packing(docs, rows, tokenizer):
    out = packing.pack(docs, tokens.default_tokenizer()).collect()
    encoded = brute.token_rows(rows, tokenizer)
    assert check_packing(out, encoded) <= 1.03 * -(-sum(map(len, encoded.values())) // 2048)


def test_packing_awkward(spark, awkward, nothing):
    assert packing.pack(nothing, tokens.default_tokenizer()).collect() == []
    packed = packing.pack(awkward, tokens.default_tokenizer(), with_ids=True).cache()
    check_packing(packed.collect(), None)
    whole = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in whole) == packed.agg(F.sum("length")).first()[0]


@given(st.dictionaries(st.integers(1, 60), st.integers(0, 50), max_size=20), st.sampled_from(["norm", "dot"]), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_plan_holds_every_constraint(histogram, rule, max_docs):
    segments, bins = packing.plan(histogram, 64, max_docs, 64 * 64, (1, 0.001, 0.001), rule)
    held, ranks = collections.defaultdict(list), collections.defaultdict(list)
    for length, first, n, bin0, offset in segments.tolist():
        for k in range(n):
            held[bin0 + k].append((offset, length))
            ranks[length].append(first + k)
    assert all(sorted(ranks[n]) == list(range(c)) for n, c in histogram.items())
    assert len(held) == bins
    for pieces in held.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64 and len(pieces) <= max_docs and sum(n * n for _, n in pieces) <= 64 * 64


def test_long_plan_is_applied_in_parts(docs, monkeypatch):
    whole = sorted(packing.pack(docs, tokens.default_tokenizer()).collect())
    monkeypatch.setattr(packing, "SENT_SEGMENTS", 40)
    assert sorted(packing.pack(docs, tokens.default_tokenizer()).collect()) == whole


def test_tokens_equal_library(tokenizer):
    texts = ["a' b's. don't,it’s   x  y  z\n\n q <|endoftext|> z.<|endoftext|>.a", "é é  é à.b 中文 字 1.5 a1.b x\x1c y \x1cz", "", " a  b. c", "I'll. we'd, 's.x"]
    for _, _, text in text_slices(pa.array(texts)):
        ids, before = tokens.encoder(tokens.default_tokenizer()).encode(text)
        assert [ids[a:b].tolist() for a, b in zip(before, before[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


LIBRARY = Tokenizer.from_file(tokens.default_tokenizer())


@given(st.text(alphabet="aB.,!?;:' \n\t\u00a0éñ中1|<>\x1c\x85", max_size=60))
@settings(max_examples=200, deadline=None)
def test_tokens_equal_library_on_any_text(value):
    for _, _, x in text_slices(pa.array([value])):
        assert tokens.encoder(tokens.default_tokenizer()).encode(x)[0].tolist() == LIBRARY.encode(value, add_special_tokens=False).ids


def test_quality(docs, rows):
    out = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t in rows:
        want = brute.base_stats(t)
        assert tuple(out[i][c] for c in quality.STATS) == want
        assert out[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (out[i]["base_failed"] and out[i]["kept"])


def test_quality_rejects_depleted_and_keeps_copies(spark):
    boiler = [f"boilerplate sentence number {k} that every page of this host repeats again" for k in range(4)]
    page = [(i, "\n".join([*boiler, *[f"{i}-{k}" for k in range(15)]]), "h") for i in range(40)]
    copies = [(100 + i, "\n".join(f"clean line {k} " + " ".join(f"w{k}x{j}" for j in range(9)) for k in range(9)), "h") for i in range(60)]
    out = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(page + copies, "doc_id long, text string, source string"), max_docs=5, min_share=0.5).collect()}
    assert sum(not out[i]["kept"] for i in range(40)) >= 30 and out[0]["n_lost_words"] >= 30
    assert all(out[100 + i]["kept"] for i in range(60))


def test_quality_counts_pages_of_mostly_shared_lines(spark):
    shared = [f"shared line {k} " + " ".join(f"w{k}x{j}" for j in range(9)) for k in range(8)]
    pages = [(i, "\n".join([*shared, f"own line of page {i}"]), "h") for i in range(200)]
    copies = [(1000 + i, "\n".join(f"copied line {k} " + " ".join(f"c{k}x{j}" for j in range(9)) for k in range(8)), "h") for i in range(200)]
    out = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(pages + copies, "doc_id long, text string, source string")).collect()}
    assert all(out[i]["n_lost_words"] == 96 and not out[i]["kept"] for i in range(200))
    assert all(out[1000 + i]["n_lost_words"] == 0 and out[1000 + i]["kept"] for i in range(200))


def test_quality_takes_frequent_lines_away(spark):
    own = [f"page {i} says " + " ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    pages = [(i, f" Home | News \n\n{own[i]}\nCookie é notice\nhome | NEWS", "h", i) for i in range(30)]
    other = [(i, f"Home | News\n{own[i]}", "other", i) for i in range(3)]
    out = quality.accepted(spark.createDataFrame(pages + other, "doc_id long, text string, source string, extra long"))
    assert out.columns == ["doc_id", "text", "source", "extra"]
    assert sorted(map(tuple, out.collect())) == sorted([(i, f"\n{own[i]}", "h", i) for i in range(30)] + other)


def test_quality_awkward(awkward, nothing):
    out = quality.judge(awkward).collect()
    assert len(out) == len(AWKWARD) and quality.judge(nothing).collect() == []
    for r, a in zip(sorted(out, key=lambda r: (r["n_words"], r["word_chars"])), sorted((brute.base_stats(a[1]) for a in AWKWARD), key=lambda x: x[:2])):
        assert (r["n_words"], r["word_chars"]) == a[:2]
    kept = quality.accepted(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == sum(r["kept"] for r in out)


def check_mix(out, source_of):
    by = collections.defaultdict(list)
    for r in out:
        by[source_of[r["doc_id"]]].append(r)
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sum(r["size"] for r in by[s]) for s in names], [k % 3 + 1.0 for k in range(len(names))], 3)
    for s, target in zip(names, want):
        assert all(abs(r["target"] - target) < 1e-6 and r["source_size"] == sum(x["size"] for x in by[s]) for r in by[s])
        yield s, target, sum(r["taken"] for r in by[s])


def test_mixing(docs, rows):
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    out = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert {r["doc_id"]: r["size"] for r in out} == {i: len(brute.words(t)) for i, t in rows}
    for _, target, taken in check_mix(out, source):
        assert abs(target - taken) <= max(3, 0.02 * target)
    again = mixing.mix(docs).select("doc_id", "taken").collect()
    assert sorted(again) == sorted((r["doc_id"], r["taken"]) for r in out)


def test_mixing_awkward(awkward, nothing):
    out = mixing.mix(awkward)
    assert out.count() == len(AWKWARD) and out.where("taken > 3 * size").count() == 0
    assert mixing.mix(nothing).collect() == []
    assert mixing.mixed(awkward).columns == awkward.columns


def test_mixing_clashing_names_ties_and_repeats(spark):
    names = ["n", "rest", "extra", "edge", "whole", "s3", "z3", "m", "ahead", "s", "z", "target", "taken", "Size", "source_size"]
    rows = [(i % 40, f"w{i % 3} " * (i % 7 + 1), f"s{i % 2}" if i % 5 else None) for i in range(400)]
    docs = spark.createDataFrame([(*r, *[1] * len(names)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    out = mixing.mix(docs).select("doc_id", "source", "size", "taken").collect()
    assert len(out) == 400 and sorted(out, key=str) == sorted(mixing.mix(docs.repartition(5)).select("doc_id", "source", "size", "taken").collect(), key=str)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    got = collections.Counter()
    for r in mixed.collect():
        got[r["doc_id"], r["source"]] += len(brute.words(r["text"]))
    want = collections.Counter()
    for r in out:
        want[r["doc_id"], r["source"]] += r["taken"]
    assert got == collections.Counter({k: v for k, v in want.items() if v})


def test_targets_of_many_sources():
    got = mixing.targets([1] * 200_000, [float(i % 3 + 1) for i in range(200_000)], 3)
    assert abs(sum(got) - 200_000) < 1e-3


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), min_size=1, max_size=12), st.floats(0, 1))
@settings(max_examples=100, deadline=None)
def test_fit_reaches_the_best_sum(histogram, share):
    sizes, counts = np.array(sorted(histogram)), np.array([histogram[s] for s in sorted(histogram)])
    budget = int(share * (sizes * counts).sum())
    take = mixing.fit(sizes, counts, budget, 20_000)
    assert (take >= 0).all() and (take <= counts).all() and (sizes * take).sum() <= budget
    assert budget - (sizes * take).sum() < sizes.max() or budget == (sizes * counts).sum()


def test_targets_reshare_the_excess():
    got = mixing.targets([10, 1, 100], [1, 2, 3], 3)
    assert got[1] == 3 and abs(sum(got) - 111) < 1e-9 and got[0] <= 30


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(docs, rows, shingle):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, shingle=shingle).collect()}
    assert got == brute.components(rows, shingle, 80)


def test_near_duplicates_in_a_large_group(spark):
    rng = np.random.default_rng(0)
    base = [f"w{k}" for k in range(150)]
    made = []
    for i in range(250):
        t = list(base)
        for k in rng.choice(150, int(rng.integers(0, 14)), replace=False):
            t[k] = f"x{rng.integers(1 << 40)}"
        made.append((i, " ".join(t)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, shingle=2).collect()}
    assert got == brute.components(made, 2, 80)


def test_near_duplicates_of_outliers_and_several_texts(spark):
    """Pairs beside a large group that are linked to each other only; a doc_id whose second text links it elsewhere."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(150)]
    made = [(i, " ".join(x if rng.random() > 0.03 else f"y{rng.integers(1 << 40)}" for x in base)) for i in range(60)]
    for i in range(100, 120, 2):
        far = [x if rng.random() > 0.13 else f"y{rng.integers(1 << 40)}" for x in base]
        made += [(i, " ".join(far)), (i + 1, " ".join([*far[:-1], "end"]))]
    rows = [*made, (300, " ".join(base)), (300, "quite another text " * 3 + "of id 300"), (301, "quite another text " * 3 + "of id 300 too"), (302, "nothing of that kind")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    joined = {i: c for i, (_, c) in brute.components([*made, (300, rows[-4][1]), (1000, rows[-3][1]), (301, rows[-2][1]), (302, rows[-1][1])], 2, 80).items()}
    assert joined.pop(1000) == joined[301] == 301 and len({joined[i] for i in range(100, 120)}) > 5
    assert got == joined | {301: joined[300]}


def test_near_duplicates_awkward(awkward, nothing):
    out = minhash.near_duplicates(awkward, shingle=2).collect()
    assert len(out) == len(AWKWARD) and minhash.near_duplicates(nothing).collect() == []
    by = collections.defaultdict(set)
    for r in out:
        by[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert by[None] == {(None, True)} and by[0] == {(0, True)} and by[2] == {(2, True)} and by[20] == {(20, True)}
    assert len(minhash.representatives(awkward).columns) == len(awkward.columns)


def test_one_permutation_estimates_similarity():
    rng = np.random.default_rng(1)
    oph = minhash.OnePermutation(48, 6)
    for n, j in ((20, 0.8), (400, 0.5), (3000, 0.9)):
        same = int(n * 2 * j / (1 + j))
        errors = []
        for _ in range(12):
            u = rng.integers(0, 1 << 63, 2 * n - same, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            a, b = np.unique(u[:n]), np.unique(np.concatenate([u[:same], u[n:]]))
            errors.append((oph.signature(a) == oph.signature(b)).mean() - same / (2 * n - same))
        assert abs(np.mean(errors)) < 0.06


def test_line_dedup(docs, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op9_line_dedup"](docs.sparkSession, "/root/testdata/sf0.001").collect()}
    assert got == brute.line_dedup(rows)


def test_line_index_is_reversible(spark):
    base = spark.createDataFrame([(i, f"{LINE}\nown line number {i} which is also longer than forty") for i in range(4)], "doc_id long, text string")
    more = spark.createDataFrame([(9, LINE), (10, LINE + "\n" + LINE.upper())], "doc_id long, text string")
    index = linededup.LineIndex.build(base, shards=4)
    assert index.losses().count() == 0
    grown = index.insert(more)
    assert {r["doc_id"] for r in grown.losses().collect()} == {0, 1, 2, 3, 9}
    back = grown.delete(more.select("doc_id"))
    assert back.losses().count() == 0
    assert sorted(back.refs.collect()) == sorted(index.refs.collect())
    every = grown.dedup(base.unionByName(more)).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in every} == {0: 1, 1: 1, 2: 1, 3: 1, 9: 1, 10: 0}


def test_line_index_counts_changes_only(spark, monkeypatch):
    """Inserts and deletes give what a new index has; one shard of the filters a pass finds the same losses."""
    text = lambda i: "\n".join(f"this is line number {k} which is longer than forty characters" for k in range(i % 5, i % 5 + 6))
    rows = [(i, text(i)) for i in range(30)]
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    index = linededup.LineIndex.build(frame(rows[:12]), shards=7).insert(frame(rows[9:])).delete(frame(rows[3:20:4]))
    kept = [r for r in rows if r not in rows[3:20:4]]
    new = linededup.LineIndex.build(frame(kept), shards=7)
    told = lambda x: {r["doc_id"]: set(zip(r["keys"], r["keys2"])) for r in x.losses().collect()}
    assert sorted(index.counts.collect()) == sorted(new.counts.collect()) and told(index) == told(new) == told(index.compact())
    monkeypatch.setattr(linededup, "FILTER_BYTES", 1)
    assert len(new._passes()) > 1 and told(new) == told(index)


def thue_morse(n, a, b):
    while len(a) < n:
        a, b = a + b, b + a
    return a


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_structured_words_have_hashes_of_their_own(spark, n, tokenizer):
    """Words that collide in a polynomial modulo a power of two: ids, repeated lines and dropped lines stay right."""
    x, y = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    rows = [(1, f"{x} {y} {x}"), (2, f"{x}\n{y}\n{x}")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokens.default_tokenizer(), capacity=8192).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in out} == {i: brute.crc([*tokenizer.encode(t, add_special_tokens=False).ids, 0]) for i, t in rows}
    assert quality.base_stats(next(text_slices(pa.array([rows[1][1]])))[2])["n_dup_lines"].tolist() == [1]
    lines = spark.createDataFrame([(i, x if i < 3 else y) for i in range(6)], "doc_id long, text string")
    assert linededup.LineIndex.build(lines, min_docs=5).losses().count() == 0


def test_line_dedup_awkward(awkward, nothing):
    out = linededup.LineIndex.build(awkward).dedup(awkward)
    assert out.count() == len(AWKWARD) and set(awkward.columns) <= set(out.columns)
    assert linededup.LineIndex.build(nothing).dedup(nothing).collect() == []
    assert {r["n_dropped"] for r in out.where("doc_id between 10 and 16").collect()} == {2}
    assert {r["n_lines"] for r in out.where("text is null or text = ''").collect()} == {1}


@given(st.lists(st.integers(0, (1 << 64) - 1), unique=True, max_size=200))
@settings(max_examples=30, deadline=None)
def test_cuckoo_filter(keys):
    a = np.array(keys, np.uint64)
    f = linededup.CuckooFilter.built(a)
    assert f.contains(a).all()
    for k in keys:
        assert f.delete(np.uint64(k))
    assert not f.table.any()


def test_binary(docs, rows, tokenizer, tmp_path, spark):
    written = binary.write(docs, f"file://{tmp_path}/blocks", tokens.default_tokenizer(), block_ids=5_000)
    assert written.count() > 4
    out = {r["doc_id"]: r for r in binary.documents(written, with_ids=True).collect()}
    start = 0
    for i, ids in sorted(brute.token_rows(rows, tokenizer).items()):
        r = out[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (start, len(ids), brute.crc(ids), ids)
        start += len(ids)


def test_binary_awkward(awkward, nothing, tmp_path):
    out = binary.documents(binary.write(awkward, f"file://{tmp_path}/a", tokens.default_tokenizer())).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == sorted((a[0] for a in AWKWARD), key=lambda x: (x is not None, x or 0))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:]))
    assert binary.documents(binary.write(nothing, f"file://{tmp_path}/n", tokens.default_tokenizer())).collect() == []


@given(st.lists(st.integers(0, 1 << 45), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    v = np.array(sorted(values), np.int64)
    ef, _ = binary.EliasFano.from_bytes(memoryview(binary.EliasFano.encode(v).to_bytes()), 0)
    assert ef.select_all().tolist() == v.tolist()
    assert [ef.select(i) for i in range(0, len(v), 7)] == v[::7].tolist()


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(0).integers(1, 1000, 10_000))
    assert len(binary.EliasFano.encode(v).to_bytes()) * 8 < 12.5 * len(v)


def test_sketch(docs, rows):
    text = dict(rows)
    order = sorted(text, reverse=True)
    after = {a: order[(k + 1) % len(order)] for k, a in enumerate(order)}
    out = sketch.edited_comparison(docs).collect()
    assert len(out) == len(rows)

    def exact(t):
        w = brute.words(t)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    for r in out:
        t, n = text[r["doc_id"]] or "", text[after[r["doc_id"]]] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        mine = exact(t)
        if len(mine) > 200:
            for got, other in ((r["near_edited"], edited), (r["near_next"], n)):
                assert abs(got - len(mine & exact(other)) / len(mine)) < 0.25
    same = collections.defaultdict(set)
    for r in out:
        same[text[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in same.values())


def test_sketch_estimates_containment():
    a, b = [f"w{k}" for k in range(9000)], [f"w{k}" for k in range(6000)] + [f"y{k}" for k in range(60_000)]
    x, y = (sketch.decode(f)[1] for f in sketch.fingerprints(pa.array([" ".join(a), " ".join(b)])))
    assert abs(sketch.containment(x, y) - 2 / 3) < 0.06
    assert len(sketch.merge(x, y)) <= len(x) + len(y)


def test_sketch_of_short_texts(spark):
    words = [f"w{k}" for k in range(5000)]
    texts = ["some text", "other words", "a b c d e f", "g h i j k l", " ".join(words[:12]), " ".join(words[:400]), " ".join(words[10:22]), " ".join(words)]
    rows = list(enumerate(texts))[::-1]
    out = {r["doc_id"]: r for r in sketch.edited_comparison(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def exact(t):
        w = brute.words(t)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    for k, t in enumerate(texts):
        n, mine = texts[k - 1], exact(t)
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        if len(mine) <= 256:
            assert out[k]["near_edited"] == len(mine & exact(edited)) / len(mine)
            assert out[k]["near_next"] == len(mine & exact(n)) / len(mine)
    assert len({r["fingerprint"] for r in out.values()}) == len(texts)


def test_sketch_awkward(awkward, nothing):
    assert sketch.edited_comparison(awkward).count() == len(AWKWARD)
    assert sketch.edited_comparison(nothing).collect() == []
    assert sketch.with_fingerprint(awkward).count() == len(AWKWARD)


def test_language_model(docs, rows):
    out = {r["doc_id"]: r for r in suffixtree.score(docs, common=500).collect()}
    for i, want in brute.unigram(rows, 7, 2).items():
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert abs(r["base_score"] - want[3]) < 1e-6 * abs(want[3]) and r["score"] < 0


def test_language_model_scores_equal_a_plain_tree(docs, rows):
    want = brute.suffix_tree(rows, 7, 2, 4, 16, 20.0, 8.0)
    out = suffixtree.score(docs, depth=4).collect()
    assert len(out) == len(rows) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-8 * abs(want[r["doc_id"]]) for r in out)


def test_suffix_tree_distributions_sum_to_one(docs):
    from textloom.llm.common import Scratch

    counted = suffixtree.counts(docs, 3).where("not word").select("key", "n")
    tree = suffixtree.learn(counted, 3, 16, 5.0, 4.0, 100_000, Scratch(docs.sparkSession))
    assert sum(len(s) for s, _ in tree.states.values()) > 100
    for context in (b"the", b"\n\n\n", b"zzz", b"e o"):
        base = int.from_bytes(context, "big") << 8
        p = tree.probability(np.array([base | x for x in range(256)], np.uint64))
        assert abs(p.sum() - 1) < 1e-9
    small = suffixtree.learn(counted, 3, 16, 5.0, 4.0, 500, Scratch(docs.sparkSession))
    assert sum(len(e) for e, _ in small.entries.values()) <= 500


def test_language_model_uses_every_retained_state(docs):
    whole = {r["doc_id"]: r["score"] for r in suffixtree.score(docs, depth=3).collect()}
    for max_entries in (0, 500):
        out = {r["doc_id"]: r["score"] for r in suffixtree.score(docs, depth=3, max_entries=max_entries).collect()}
        assert out.keys() == whole.keys() and all(abs(out[i] - whole[i]) < 1e-9 * abs(whole[i]) for i in whole)


def test_counts_to_send_stay_within_the_room(spark):
    rng = np.random.default_rng(5)
    n = np.exp(rng.uniform(0, 20, 3000)).astype(int) + 1
    df = spark.createDataFrame([(int(x),) for x in n], "n long")
    for room in (0, 10, 1000, 2999, 3000):
        least, whole = suffixtree.least_to_send(df, F.col("n"), F.count("*"), room)
        held = int((n >= least).sum())
        assert held <= room and whole == (room >= 3000) and (whole or held >= 0.9 * room - 40)


def test_symbols_follow_the_words():
    for _, _, text in text_slices(pa.array(["Ab  c\n", "", " d"])):
        w, d = suffixtree.symbols(text, 2)
        assert bytes((w & np.uint64(255)).astype(np.uint8)) == b"ab c\n\nd\n" and d.tolist() == [0] * 5 + [1] + [2] * 2
        assert int(w[0]) == int.from_bytes(b"\n\na", "big") and int(w[2]) == int.from_bytes(b"ab ", "big")


def test_language_model_awkward(awkward, nothing):
    out = suffixtree.score(awkward).collect()
    assert len(out) == len(AWKWARD) and all(r["n_tokens"] >= 1 and r["score"] <= 0 for r in out)
    assert suffixtree.score(nothing).collect() == []


def test_toxicity(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op5_toxicity(spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in out)
    assert right >= 0.9 * len(out) and sum(r["predicted"] and not r["toxic"] for r in out) <= 3


def test_factorization_learns_a_pair():
    # Each term alone says little; both together are toxic.
    sets = [np.array(x, np.int64) for x in ([1], [2], [1, 2], [3])] * 100
    m = toxicity.FactorizationMachine.train(np.array([0, 0, 1, 0] * 100), sets, np.array([1, 2, 3]), 64, steps=600)
    scores = m.scores(4, np.array([0, 1, 2, 2, 3]), np.array([1, 2, 1, 2, 3]))
    assert scores[2] > 0.8 and scores[[0, 1, 3]].max() < 0.3
    assert (m.factors[m.index[1]] * m.factors[m.index[2]]).sum() > 0.5


def test_toxicity_finds_terms_that_weigh_beside_others_only(spark):
    """"ggg" is as common in both classes, but it decides what "aaa" and "bbb" mean."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1200):
        insult, group = ("aaa", "bbb", "ccc", "ddd")[rng.integers(4)], rng.random() < 0.5
        toxic = insult == "aaa" and group or insult == "bbb" and not group
        rows.append((i, " ".join([insult, *["ggg"] * group, *(f"w{rng.integers(40)}" for _ in range(8))]), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(df.select("doc_id", "text"), df.where("doc_id < 800").select("doc_id", "toxic"))
    got = toxicity.score(df, machine, 0.5).join(df, "doc_id").where("doc_id >= 800").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.95 * len(got)


def test_toxicity_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(awkward, toxicity.fit(awkward, labels)).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in out)
    empty = labels.where("false")
    assert toxicity.score(nothing, toxicity.fit(nothing, empty)).collect() == []


CONTROL = ["</s>[INST] ok [/INST]", "a\\", "[/INST", "\\l\\\\[<s>", "x</s>", "[/INST][INST a esc]q[/INST]", "plain [1] <b>", "[/", ""]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "we ird]", ""]), st.one_of(st.sampled_from(CONTROL), st.text(max_size=30))), max_size=6))
@settings(max_examples=200, deadline=None)
def test_chat_round_trip(turns):
    s, spans = chat.render(turns)
    assert chat.parse(s) == turns
    learned = "".join(chat.unescape(s[a:b]) if e else s[a:b] for a, b, e in spans)
    assert learned == "".join(t for r, t in turns if r == "assistant")


@pytest.mark.parametrize("mark", ["[INST user]", "[INST assistant esc]", "[INST ]"])
def test_chat_escapes_opening_marks(mark):
    turns = [("user", f"before {mark} after"), ("assistant", mark)]
    s, spans = chat.render(turns)
    assert chat.parse(s) == turns and len(chat._OPEN.findall(s)) == 2 and all(e for *_, e in spans)


def test_chat_query(spark, small):
    held = collections.defaultdict(list)
    for r in table(spark, small, "conversations").collect():
        held[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    held[-1] = [(0, "user", queries.PROBE), (1, "assistant", queries.PROBE)]
    out = queries.op10_chat_formatting(spark, small).collect()
    assert len(out) == len(held)
    for r in out:
        turns = sorted(held[r["conv_id"]])
        learned = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_awkward(spark):
    rows = [(1, 0, None, None, 5), (1, 0, "user", "x", 5), (1, 0, "user", "x", 5), (None, 2, "assistant", "</s>" * 50_000, 5), (2, None, "assistant", "", 5)]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int"))).collect()}
    assert out[1]["n_turns"] == 3 and out[None]["loss_chars"] == 200_000 and out[2]["loss_chars"] == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(empty)).collect() == []
