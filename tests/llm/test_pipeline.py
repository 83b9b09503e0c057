import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_near_dedup import brute as near
from tests.llm.test_packing import slow
from tests.llm.test_secret_scan import SCAN
from tidemark.llm import quality
from tidemark.llm.packing import piece_lengths

SF = "/root/testdata/sf0.001"


def brute(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = quality.score(docs, quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    rows = [(r.doc_id, r.text) for r in scored if r.score >= 0.7]
    kept = {i for i, _, _, k in near(rows, 80, 5) if k}
    rows = [r for r in rows if r[0] in kept]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {i for i, _, n, _, _ in contaminated(rows, bench) if n}
    out = []
    for i, text in rows:
        if i in dirty:
            continue
        mask = np.zeros(len(text) + 1, bool)
        for _, a, b in SCAN(text):
            mask[a:b] = True
        text = re.sub("\x00+", "[secret]", "".join("\x00" if m else c for c, m in zip(text, mask)))
        ids, at = slow(text) + [0], 0
        for n in piece_lengths(len(ids), 1024):
            out.append((i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
            at += n
    return sorted(out)


def test_run_matches_brute_force(spark):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert sorted(tuple(r) for r in got) == brute(spark)


def after(spark, docs, *names):
    stages = dict(corpus_pipeline.STAGES)
    for name in names:
        docs = stages[name](spark, docs, SF)
    return docs


ODD = [(None, None, None, None, None), (None, "no id, token = abcdef123", "en", "s", 1), (-1, "", "en", "s", 0), (-2, "word", None, "s", 4), (-2, "word", None, "s", 4)]


def test_odd_rows_of_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(ODD, docs.schema)
    both = docs.unionByName(odd)
    rows = lambda df: sorted(map(str, map(tuple, df.select(docs.columns).collect())))
    texts = lambda df: sorted(map(str, (tuple(r) for r in df.where("doc_id is null or doc_id < 0").select("doc_id", "text").collect())))
    kept = after(spark, both, "quality_classifier")
    model = quality.train(both, spark.read.parquet(f"{SF}/labels.parquet"))
    assert rows(kept) == rows(quality.score(both, model).where("score >= 0.7"))
    everything = sorted(str(r[:2]) for r in ODD)
    assert texts(after(spark, both, "near_dedup")) == everything
    assert texts(after(spark, both, "decontamination")) == everything
    hidden = sorted(str((i, t and t.replace("token = abcdef123", "[secret]"))) for i, t, *_ in ODD)
    assert texts(after(spark, both, "secret_scan")) == hidden
    packed = after(spark, odd, "packing").collect()
    want = sorted(str((i, len(slow(t or "")) + 1)) for i, t, *_ in ODD)
    assert sorted(str((r.doc_id, r.doc_tokens)) for r in packed if r.start == 0) == want


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.select("*", *(F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in ("score", "score_", "p", "spans", "n", "sketch", "id", "kept", "component_id", "key")))
    now = after(spark, more, "quality_classifier", "near_dedup", "decontamination", "secret_scan")
    assert now.dtypes == more.dtypes
    for r in now.collect():
        assert r.score == f"score-{r.doc_id}" and r.score_ == f"score_-{r.doc_id}" and r.key == f"key-{r.doc_id}" and r.id == f"id-{r.doc_id}"


def test_near_copies_go_and_a_very_long_text_stays(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    words = [f"w{k}" for k in range(100)]
    copy = [*words[:50], "other", *words[51:]]  # shares 91 of 101 shingles
    apart = [*words[:50], *(f"z{k}" for k in range(12)), *words[62:]]
    rows = [(3, " ".join(words)), (2, " ".join(copy)), (4, " ".join(apart)), (5, "a b " * 1_500_000), (6, " ".join(words))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    assert sorted(r.doc_id for r in after(spark, docs, "near_dedup").collect()) == [2, 4, 5]


@pytest.mark.parametrize("rows", [[]])
def test_no_documents(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
