"""The pipeline's stages against plain models, each on what the stage before it kept."""

import collections

import corpus_pipeline
from textloom.llm import mixing, quality, tokens
from textloom.llm.common import Scratch
from tokenizers import Tokenizer

from . import brute
from .test_operators import check_mix, check_packing


def quality_model(rows, max_docs=20, min_words=20, min_share=0.2):
    """doc_ids that are kept; rows: (doc_id, source, text). Line families are found as the operator defines them."""
    import pyarrow as pa

    from textloom.llm.vectext import signed, text_slices

    lines, family = {}, {}
    for i, _, t in rows:
        counts = collections.Counter()
        for x in (t or "").split("\n"):
            if brute.words(x):
                counts[brute.lower(x.strip(brute.STRIP))] += len(brute.words(x))
        lines[i] = counts
        hashes = []
        for _, _, text in text_slices(pa.array(list(counts), pa.large_string())):
            hashes += signed(text.hash_ranges(text.bounds[:-1], text.bounds[1:])).tolist()
        family[i] = min(hashes, default=None)
    seen = collections.defaultdict(collections.Counter)
    for i, source, _ in rows:
        for key in lines[i]:
            seen[source, key][family[i]] += 1
    frequent = {k for k, c in seen.items() if len(c) > max_docs and 2 * len(c) >= sum(c.values())}
    kept = set()
    for i, source, t in rows:
        n, _, _, _, repeat = brute.base_stats(t)
        lost = sum(w for key, w in lines[i].items() if (source, key) in frequent)
        if not (n < 20 or 100 * repeat > 30 * n) and not (lost and n - lost < min_words and n - lost < min_share * n):
            kept.add(i)
    return kept


def test_stages(spark, small):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, small), name.replace(" ", "-"))
        kept.append(docs)
        if name != "best-fit packing":
            assert docs.columns == columns
    start = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    first = {r["doc_id"]: r for r in kept[0].collect()}
    assert set(first) == quality_model([(i, r["source"], r["text"]) for i, r in start.items()])
    assert all(first[i] == start[i] for i in first)
    second = {r["doc_id"]: r["text"] for r in kept[1].collect()}
    want = brute.line_dedup([(i, r["text"]) for i, r in first.items()])
    import hashlib

    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in second.items()} == {i: w[2] for i, w in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in kept[1].collect())
    parts = brute.components(list(second.items()), 5, 80)
    third = {r["doc_id"]: r for r in kept[2].collect()}
    assert set(third) == {i for i, (_, c) in parts.items() if c == i}
    mixed = mixing.mix(kept[2]).collect()
    for _, target, taken in check_mix(mixed, {i: r["source"] for i, r in third.items()}):
        assert abs(target - taken) <= max(3, 0.05 * target)
    fourth = collections.Counter(r["doc_id"] for r in kept[3].collect())
    assert fourth == collections.Counter({r["doc_id"]: r["taken"] // r["size"] for r in mixed if r["taken"]})
    packed = kept[4].collect()
    check_packing(packed, None)
    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    sizes = {i: len(ids) for i, ids in brute.token_rows([(i, third[i]["text"]) for i in fourth], tokenizer).items()}
    got = collections.Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == collections.Counter({i: sizes[i] * n for i, n in fourth.items()})


def test_frequent_lines_do_not_pass_the_first_stage(spark):
    own = [f"page {i} says " + " ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    pages = spark.createDataFrame([(i, f"Home | News\n{t}", "h", 0) for i, t in enumerate(own)], "doc_id long, text string, source string, n_chars long")
    out = corpus_pipeline.quality_rules(spark, pages, "").collect()
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in out} == {(i, t, len(t)) for i, t in enumerate(own)}


def test_run_and_empty_table(spark, small, tmp_path):
    assert corpus_pipeline.run(spark, small).count() > 0
    empty = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert quality.accepted(empty).columns == empty.columns
