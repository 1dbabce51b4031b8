import zlib

import duckdb
import numpy as np
import pytest

from quire.llm import compress_quality as C

SF01 = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    model = C.train(docs, labels)
    return C.score(docs, model).withColumn("held_out", C.held_out(docs.doc_id)).toPandas(), model, docs, labels


def test_held_out_accuracy(scored):
    pdf, *_ = scored
    labels = duckdb.sql(f"select doc_id, min(quality) as quality from '{SF01}/labels.parquet' group by 1").df()
    both = pdf.merge(labels, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in both.doc_id]).all()
    test = both[both.held_out]
    assert (test.predicted == test.quality).mean() > 0.97
    assert ((pdf.score >= 0) & (pdf.score <= 1)).all() and (pdf.predicted == (pdf.score >= 0.7)).all()


def test_held_out_labels_and_other_columns_do_not_matter(spark, scored):
    pdf, model, docs, labels = scored
    changed = labels.withColumn("quality", C.F.when(C.held_out(C.F.col("doc_id")), 1 - C.F.col("quality")).otherwise(
        C.F.col("quality")))
    other = C.train(docs.drop("lang", "source"), changed)
    assert other.good == model.good and other.bad == model.bad and np.allclose(other.weights, model.weights)


def test_any_text_gets_a_score(spark, scored):
    model = scored[1]
    rows = [(1, None, 0.5), (2, "", 0.5), (None, "a", 0.5), (4, "x y " * 400_000, 0.5), (4, "x y " * 400_000, 0.5)]
    got = C.score(spark.createDataFrame(rows, "doc_id long, text string, score double"), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    by = {r.text: r.score for r in got}
    assert by[None] == by[""] and C.score(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_training_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    none = C.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert C.score(docs, none).first().score == 0.5
    ones = C.train(docs, spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int"))
    assert C.score(docs, ones).first().score > 0.99


def test_long_texts_are_judged_as_well_as_short_ones(spark, scored):
    _, model, docs, labels = scored
    kinds = labels.groupBy("doc_id").agg(C.F.min("quality").alias("quality"))
    rows = docs.join(kinds, "doc_id").where("quality in (0, 1) and text != ''").select("doc_id", "quality", "text").toPandas()
    rows["held"] = [zlib.crc32(str(d).encode()) % 4 == 2 for d in rows.doc_id]
    rng, texts, wanted = np.random.default_rng(5), [], []
    for value in (0, 1):
        some = rows[rows.held & (rows.quality == value)].text.tolist()
        for size in (40_000, 200_000, 1_000_000):
            for _ in range(8):
                text = ""
                while len(text) < size:
                    text += some[rng.integers(len(some))] + "\n\n"
                texts.append(text)
                wanted.append(value)
    got = model.score(C.features([t.encode() for t in texts], model.coders())) >= C.ACCEPT
    assert (got == np.array(wanted)).all()
    real = rows[rows.text.map(lambda t: len(t.encode())) > C.BLOCK]
    right = (model.score(C.features([t.encode() for t in real.text], model.coders())) >= C.ACCEPT) == real.quality
    assert right.mean() >= 0.95 and len(real) >= 20
    told = C.error_by_length(C.score(docs, model), labels).collect()
    assert sum(r.n for r in told) == rows.held.sum() and sum(r.wrong for r in told) <= 0.03 * rows.held.sum()
