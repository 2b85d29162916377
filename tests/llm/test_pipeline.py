"""The pipeline: every stage against a plain version on planted documents, odd rows and empty tables."""

import random

import corpus_pipeline as pipeline
import pytest

from biotables.llm import edit_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "a passage of quite some words that stands in more than one document and has well over fifty bytes"
ITEM = "the question asks which river crosses the old town and how many bridges lead over it in the north"


def sentence(rnd, words):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(words)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(4)
    texts = [sentence(rnd, rnd.randrange(30, 120)) for _ in range(120)]
    junk = [" ".join(f"{w}$$$" for w in sentence(rnd, 60).split()) for _ in range(60)]
    near = texts[5].split()
    near[3] = "changed"
    planted = {
        300: texts[7], 301: " ".join(near), 302: f"{sentence(rnd, 20)} {PASSAGE} {sentence(rnd, 20)}", 303: f"{sentence(rnd, 25)} {PASSAGE}!",
        304: f"{sentence(rnd, 10)} {ITEM} {sentence(rnd, 15)}", 305: None, 306: "", 307: "word", 308: "é" * 3,
    }
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(200 + i, t, "en", "s", len(t)) for i, t in enumerate(junk)]
    rows += [(i, t, None, None, None) for i, t in planted.items()] + [(None, sentence(rnd, 40), "en", "s", 1)]
    path = tmp_path_factory.mktemp("tables")
    frames = {
        "documents": spark.createDataFrame(rows, DOCS),
        "labels": spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(200 + i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string"),
    }
    for name, df in frames.items():
        df.write.parquet(f"{path}/{name}.parquet")
        df.limit(0).write.parquet(f"{path}/empty/{name}.parquet")
    return str(path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first, second, third, fourth, last = [stage for _, stage in pipeline.STAGES]
    kept = {r.doc_id for r in first(spark, docs, folder).collect()}
    assert not kept & set(range(200, 260)) and set(range(120)) <= kept and {302, 303, 304, None} <= kept
    unique = {r.doc_id for r in second(spark, docs, folder).collect()}
    assert unique == {r.doc_id for r in docs.collect()} - {300, 301}
    before = {r.doc_id: r.text for r in docs.collect()}
    cut = {r.doc_id: r for r in third(spark, docs, folder).collect()}
    assert cut[300].text == "" and cut[300].n_chars == 0 and cut[7].text == before[7]
    assert PASSAGE in cut[302].text and PASSAGE not in cut[303].text and cut[303].text == before[303].replace(f". {PASSAGE}", "")
    assert cut[305].text is None and cut[306].text == "" and cut[308].text == before[308]
    clean = {r.doc_id for r in fourth(spark, docs, folder).collect()}
    assert clean == set(before) - {304}
    tool = edit_counts.encoding(edit_counts.RANKS, edit_counts.PATTERN)
    counts = {r.doc_id: r.n_tokens for r in last(spark, docs, folder).collect()}
    assert counts == {i: len(tool.encode_ordinary(t or "")) for i, t in before.items()}


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 score", "'x' kept", "2 batch", "3 window")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == pipeline.COLUMNS and dict(out.dtypes) == {c: t for c, t in docs.dtypes if c in pipeline.COLUMNS}


def test_run_applies_all_stages(spark, folder):
    got = {r.doc_id for r in pipeline.run(spark, folder).collect()}
    assert set(range(120)) <= got and not got & {300, 301, 304, *range(200, 260)} and {302, 303, None} <= got


def test_empty_tables(spark, folder):
    assert pipeline.run(spark, f"{folder}/empty").count() == 0
