from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import langid

from ..conftest import DATA

SCHEMA = "doc_id long, text string, lang string, held_out string, score int"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    reader = langid.LanguageReader(["a", "b", "c"], hidden=3)
    for part in (reader.left, reader.right):
        part.x, part.u = part.x.astype(np.float64), part.u.astype(np.float64)
    x = rng.integers(1, 256, (6, 4))
    y = np.array([0, 1, 2, 1])

    def loss() -> float:
        shares = reader.shares(reader.logits(x)[0].astype(np.float64))
        return float(-np.log(shares[:, y, np.arange(4)]).sum())

    keep: tuple[list, list] = ([], [])
    logits, _ = reader.logits(x, keep)
    d = reader.shares(logits)
    d[:, y, np.arange(4)] -= 1
    d_both = np.matmul(reader.v.T, d)
    for side, kept, got in ((reader.left, keep[0], (x, d_both[:, :3])), (reader.right, keep[1], (x[::-1], d_both[::-1, 3:]))):
        dx, du = side.backward(got[0], kept, got[1])
        for weights, grads, at in ((side.u, du, (4, 1)), (side.u, du, (7, 2)), (side.u, du, (1, 0)), (side.x, dx, (2, x[2, 1])), (side.x, dx, (8, x[0, 0])), (side.x, dx, (4, x[3, 2]))):
            eps, before = 1e-2, weights[at]
            weights[at] = before + eps
            up = loss()
            weights[at] = before - eps
            down = loss()
            weights[at] = before
            assert abs((up - down) / (2 * eps) - grads[at]) < 0.02 * max(1, abs(grads[at]))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def reader(docs):
    return langid.learn(docs)


def test_held_out_accuracy(docs, reader):
    rows = langid.predict(docs, reader).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_learns_nothing_from_held_out_or_unlabelled(docs, reader):
    other = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    again = langid.learn(other)
    assert again.langs == reader.langs and (again.v == reader.v).all() and (again.left.x == reader.left.x).all()


def test_prediction_ignores_the_other_columns(docs, reader):
    text = docs.select("text").first()["text"]
    spark = docs.sparkSession
    rows = [(1, text, "xx", "a", 1), (2, text, None, None, None), (None, text, "en", "b", 3), (2, text, None, None, None)]
    got = {(r.lang_pred, round(r.score, 6)) for r in langid.predict(spark.createDataFrame(rows, SCHEMA), reader).collect()}
    assert len(got) == 1


def test_undetermined_and_long_texts(spark, reader):
    rows = [(1, None, "en", "", 0), (2, "", "en", "", 0), (3, "123 !? 4", "en", "", 0), (4, "The end of the. " * 20000, "en", "", 0), (5, "é", "fr", "", 0)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, SCHEMA), reader).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[4].lang_pred == "en" and got[5].lang_pred in reader.langs


@pytest.mark.parametrize("text", ["½ ² ① Ⅷ", "٣٤ ೬ 〇 ㊿", "\u0301 _ 12", " \n\t", "№ % ∑ 🙂"])
def test_numbers_and_marks_are_no_letters(spark, reader, text):
    rows = spark.createDataFrame([(1, text.replace("№", ""), "en", "", 0), (2, text + " ʼa", "en", "", 0)], SCHEMA)
    got = {r.doc_id: r for r in langid.predict(rows, reader).collect()}
    assert (got[1].lang_pred, got[1].score) == ("und", 0) and got[2].lang_pred in reader.langs
    assert {r.doc_id for r in langid.accepted(rows, reader, 0.0).collect()} == {2}


def test_many_languages_and_long_texts_bound_the_sample(spark, monkeypatch):
    rows = [(i, f"some words {i} of no language", f"x{i}", "", 0) for i in range(10_000)] + [(20_000 + i, f"the {i} of and " * 3000, "en", "", 0) for i in range(40)] + [(30_000 + i, f"le {i} un des " * 3000, "fr", "", 0) for i in range(40)]
    monkeypatch.setattr(langid, "SAMPLE_LANGS", 8)
    found = langid.learn(spark.createDataFrame(rows, SCHEMA), steps=5)
    assert len(found.langs) == 8 and {"en", "fr"} <= set(found.langs)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.learn(empty) is None
    rows = spark.createDataFrame([(1, "some text", None, "", 0)], SCHEMA)
    assert langid.predict(rows, langid.learn(rows)).first()["lang_pred"] == "und"
    assert langid.predict(empty, None).count() == 0


def test_positions_cover_the_text(docs, reader):
    text = docs.select("text").first()["text"]
    runs = langid.label_positions(reader, text)
    assert runs[0][0] == 0 and runs[-1][1] == len(text.encode())
    assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(runs, runs[1:]))
