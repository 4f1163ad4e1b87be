"""The pipeline's stages against plain versions, each on its own input."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from knowspark.llm import bpe, decontam

SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("mine"))
    columns = docs.columns
    before = docs
    for name, stage in P.STAGES:
        after = P.saved(stage(spark, before, SF), "test")
        a = by_id(before)
        if name == "bpe":
            t = bpe.tokenizer(bpe.VOCABULARY)
            assert {r["doc_id"]: r["n_tokens"] for r in after.collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in a.items()}
            break
        assert after.columns == columns
        b = by_id(after)
        assert set(b) <= set(a)
        if name == "line_dedup":
            left = {i: x[2] for i, x in brute.lines(list(a.items())).items()}
            assert b == {i: x for i, x in left.items() if x.strip(" \t\n\v\f\r") or x == a[i]} and len(b) < len(left)
            assert after.filter("n_chars <> length(text)").count() == before.filter("n_chars <> length(text)").count()
        elif name == "minhash":
            comps = brute.components(list(a.items()), 5)
            assert set(b) == {i for i, (_, c) in comps.items() if i == c}
        elif name == "decontamination":
            items = {r["item_id"]: " ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
            holds = {i for i, x in a.items() if any(y in " ".join(x.lower().split()) for y in items.values())}
            assert holds and not holds & set(b)
            gone = {r["doc_id"] for r in decontam.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert set(a) - set(b) == gone
        before = after


@pytest.mark.parametrize("stage", [s for s in P.STAGES if s[0] != "toxicity"], ids=lambda s: s[0])
def test_stage_on_odd_rows(spark, stage):
    rows = [(None, "some text of a row without id", "en", "s", 5), (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0),
            (3, "x" * 50_000, "en", "s", 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage[1](spark, df, SF)
    assert out.count() == 5
    assert stage[1](spark, df.limit(0), SF).count() == 0


def test_near_copies_leave_without_a_shuffle_of_texts(spark, tmp_path):
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*words[i % 40:], f"own{i}"])) for i in range(200)] + [(None, "a b c"), (7, " ".join([*words[7:], "own7"]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out = P.drop_near_copies(spark, docs, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    comps = brute.components([r for r in rows if r[0] is not None], 5)
    assert {r["doc_id"] for r in out.collect()} == {None} | {i for i, (_, c) in comps.items() if i == c}
