"""The stages against plain Python, one after another."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docframe.llm import common, decontaminate, jaccard, mixing, quality, queries, sharding

from .test_operators import LOWER, brute_components, words

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{D}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, D).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        out.append(docs)
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_quality_keeps_what_passes(stages):
    def fails(text):
        w = words(text)
        n: dict = {}
        for g in zip(w, w[1:], w[2:], strict=False):
            n[g] = n.get(g, 0) + 1
        rep = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return len(w) < 50 or 100 * len(rep) > 50 * len(w)

    assert sorted(rows(stages[1])) == sorted((d, t) for d, t in rows(stages[0]) if not fails(t))


def test_one_of_each_group_stays(stages):
    assert sorted(d for d, _ in rows(stages[2])) == sorted(d for d, _, c in brute_components(rows(stages[1])) if d == c)


def test_contaminated_go(spark, stages):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    items = [norm(r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    held = {" ".join(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    hit = lambda t: any(f" {g} " in f" {' '.join(norm(t))} " for g in held)
    assert sorted(rows(stages[3])) == sorted((d, t) for d, t in rows(stages[2]) if not hit(t))


def test_mix_and_shards(stages):
    before, after = dict(rows(stages[3])), rows(stages[4])
    assert all(before[d] == t for d, t in after) and max(map([d for d, _ in after].count, before)) <= 3
    total = sum(len(words(t)) for t in before.values())
    assert abs(sum(len(words(t)) for _, t in after) - total) < 0.2 * total
    assert all(s.columns == stages[0].columns for s in stages[:5])
    assert sorted(rows(stages[5])) == sorted(after) and {r["shard"] for r in stages[5].collect()} <= set(range(8))


def test_run(spark):
    assert corpus_pipeline.run(spark, D).count() > 0


@pytest.mark.parametrize("run", [queries.op8_sharding, lambda spark, d: corpus_pipeline.slot_sharding(spark, spark.read.parquet(f"{d}/documents.parquet"), d)])
def test_shards_come_from_a_stored_map_that_was_edited(spark, run):
    """Version 1 deals all slots in turn; version 2 is that map with some slots moved, and is what the rows follow."""
    maps = lambda: set(Path(common.shared_dir(spark).removeprefix("file:")).glob("docframe/slots-*"))
    before = maps()
    rows = run(spark, D).select("vslot", "shard").distinct().collect()
    (new,) = maps() - before
    (v1, first), (v2, second) = sharding.load_map(spark, str(new), 1), sharding.load_map(spark, str(new))
    assert (v1, v2) == (1, 2) and first == {s: s % 8 for s in range(sharding.SLOTS)} and set(second) == set(first)
    assert all(second[r["vslot"]] == r["shard"] for r in rows)
    assert 0 < sum(first[s] != second[s] for s in first) < sharding.SLOTS // 2


def test_hot_rows_fill_no_slot(spark):
    """A row that makes up a third of the table is dealt to all slots; the others go by id and text."""
    rows = [(7, "x" * 100)] * 500 + [(i, "y" * 90) for i in range(1000, 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    placed = sharding.with_shards(df, slots=64)
    sizes = [r["n"] for r in placed.groupBy("shard").agg({"text": "count"}).withColumnRenamed("count(text)", "n").collect()]
    assert placed.count() == 1500 and placed.filter("doc_id = 7").select("vslot").distinct().count() > 40
    assert len(sizes) == 8 and max(sizes) < 1.25 * 1500 / 8
    assert placed.filter("doc_id > 7").groupBy("doc_id").count().filter("count > 1").isEmpty()


def _write(spark, at, docs, bench):
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")


def test_run_on_awkward_rows(spark, docs, rows, tmp_path):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with those used inside, through all stages."""
    shared = rows[30][1].split("\n")[1]
    _write(spark, tmp_path, docs, [(1, shared), (2, None), (None, "lo ta ve")])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*(c for c in docs.columns if c != "shard"), "shard", "vslot"]
    kept = quality.kept(docs)
    deduped = jaccard.deduplicated(kept)
    clean = decontaminate.clean(deduped, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    copies = {(r["doc_id"], r["text"]): 0 for r in clean.collect()}
    for r in out.collect():
        copies[r["doc_id"], r["text"]] += 1  # no row comes from elsewhere
    repeats = Counter((r["doc_id"], r["text"]) for r in clean.collect())
    assert all(n <= 3 * repeats[k] for k, n in copies.items()) and sum(copies.values()) > 0
    assert {r["label"] for r in out.collect()} == {1}


def test_run_on_an_empty_table(spark, empty, tmp_path):
    _write(spark, tmp_path, empty, [(1, "a b c")])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_keeps_the_last_stage_only(spark, docs, tmp_path):
    at = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(at.glob("docframe/pipeline-*"))
    _write(spark, tmp_path, docs, [(1, "a b c")])
    corpus_pipeline.run(spark, str(tmp_path))
    (new,) = set(at.glob("docframe/pipeline-*")) - before
    assert [p.name for p in new.iterdir()] == [str(len(corpus_pipeline.STAGES) - 1)]


@pytest.mark.parametrize("large", [4096, 8])
def test_mix_of_repeated_rows(spark, monkeypatch, large):
    """Rows that repeat, one of them a third of the table, share their group's copies; the total by source is the mix's."""
    monkeypatch.setattr(mixing, "LARGE_GROUPS", large)
    texts = [(1, "a b c d e", "s", 0)] * 100 + [(i, f"w{i} x y z", "s" if i % 2 else "t", i) for i in range(10, 150)] + [(2, "two", "t", i) for i in range(9)] + [(None, "q r", None, 1)] * 30 + [(1, "a b c d f", "s", 0)] * 20
    df = spark.createDataFrame(texts, "doc_id long, text string, source string, k int").repartition(4)
    mix = mixing.mix_documents(df)
    want = mixing.mixed(df, tell=F.xxhash64("text")).groupBy("doc_id", "source", "size", "tell").agg(F.sum("copies").alias("n"), F.count("*").alias("rows"))
    want = {(r["doc_id"], r["tell"]): (r["n"], r["rows"]) for r in want.collect()}
    got = Counter((r["doc_id"], r["tell"]) for r in mix.withColumn("tell", F.xxhash64("text")).collect())
    assert {k: n for k, (n, _) in want.items() if n} == dict(got) and mix.columns == df.columns
    each = Counter((r["doc_id"], r["k"]) for r in mix.filter("doc_id = 2").collect())  # rows told apart by another column
    n, rows = next(v for k, v in want.items() if k[0] == 2)
    assert all(n // rows <= each[2, i] <= -(-n // rows) for i in range(9))


def test_mix_means_by_class(spark):
    """Over many seeds the words taken of large and of small documents come near their shares."""
    rows = [(i, "w " * (40 if i % 10 == 0 else 4), "a" if i % 3 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken: Counter = Counter()
    share: Counter = Counter()
    for seed in range(3):
        for r in mixing.mixed(df, seed=seed * 1000).collect():
            cls = (r["source"], r["size"] > 10)
            taken[cls] += r["taken"]
            share[cls] += r["size"] * r["target"] / r["source_size"]
    assert all(abs(taken[c] - share[c]) < 0.15 * share[c] for c in share)
