"""Every stage of the pipeline against brute force, on the rows its predecessor kept."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from gaugeworks.llm.frames import kept_table
from test_llm_operators import TOKENIZER, expected_classes, kept_lines, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = [kept_table(spark.read.parquet(f"{SF}/documents.parquet"), "test")]
    for _, stage in pipeline.STAGES:
        docs.append(kept_table(stage(spark, docs[-1], SF), "test"))
    return docs


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stage_names_and_columns(kept):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    assert all(d.columns == kept[0].columns and d.dtypes == kept[0].dtypes for d in kept[:-1])


def test_quality_drops_only_what_it_rejects(spark, kept):
    before, after = dict(pairs(kept[0])), dict(pairs(kept[1]))
    assert after.items() <= before.items() and 0 < len(after) < len(before)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()} & set(before)
    assert len(good & set(after)) >= 0.9 * len(good)


def test_lines(kept):
    want = {i: text for i, _, _, text in kept_lines(pairs(kept[1]))}
    got = {r.doc_id: (r.text, r.n_chars) for r in kept[2].collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_one_document_of_each_class_stays(kept):
    want = {i for i, c, _, _ in expected_classes(pairs(kept[2])) if i == c}
    assert {i for i, _ in pairs(kept[3])} == want and kept[3].count() == len(want)


def test_contaminated_documents_go(spark, kept):
    windows = {tuple(v[k : k + 13]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (v := words(r.text)) for k in range(max(1, len(v) - 12))}
    sizes = {len(w) for w in windows}
    want = set()
    for i, t in pairs(kept[3]):
        w = words(t)
        hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            want.add(i)
    assert {i for i, _ in pairs(kept[4])} == want


def test_sequences_hold_all_that_is_left(spark, kept):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(TOKENIZER)
    model.encode_special_tokens = True
    whole = defaultdict(dict)
    for r in kept[5].collect():
        whole[r.doc_id][r.start] = r.tokens
    assert {i: [x for _, p in sorted(v.items()) for x in p] for i, v in whole.items()} == {i: model.encode(t, add_special_tokens=False).ids + [0] for i, t in pairs(kept[4])}
    assert pipeline.run(spark, SF).count() == kept[5].count()


def test_stages_take_empty_tables_and_odd_rows(spark, kept):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, None, None), (None, "some words here", "en", "s", 3)], kept[0].schema)
    for rows in (odd, odd.where("false")):
        docs = rows
        for _, stage in pipeline.STAGES:
            docs = kept_table(stage(spark, docs, SF), "test")
        assert (docs.count() > 0) == (rows.count() > 0)


def test_columns_with_the_operators_names_keep_their_values(spark, kept):
    names = ["_score", "_lines", "_scan", "_row", "_kept", "_drop", "_i", "_h", "_doc", "_id", "_text", "_hash"]
    docs = kept[0].where("doc_id % 4 = 0").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for stage in (pipeline.quality, pipeline.line_dedup, pipeline.decontaminated):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.count() > 0
        assert got.where(" or ".join(f"`{c}` <> concat('{c}', doc_id)" for c in names)).count() == 0
    plain = {r.doc_id: r.text for r in pipeline.line_dedup(spark, docs.drop(*names), SF).collect()}
    assert {r.doc_id: r.text for r in pipeline.line_dedup(spark, docs, SF).collect()} == plain
