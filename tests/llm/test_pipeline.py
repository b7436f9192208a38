"""The stages of the pipeline, each against a plain version of it, on the smallest documents."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import sentencepiece

from quillmark.llm import langid, pieces
from quillmark.llm.common import documents

from ..conftest import DATA
from .test_dartminhash import brute as classes
from .test_linededup import brute as lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_plain_versions(spark, tmp_path):
    docs = documents(spark, DATA)
    extra = [(100_000, None, "en", "src1", 0), (100_001, "", "en", "src1", 0), (100_002, "12 34 !", None, "src2", 7), (100_003, "12 34 !", None, None, 7)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    want = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    reader = langid.learn(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == COLUMNS
        got = sorted((tuple(r) for r in docs.collect()), key=repr)
        if name == "language":
            score = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(want, docs.schema), reader).collect()}
            want = [r for r in want if score[r[0]][0] != "und" and score[r[0]][1] >= 0.4]
            assert {r[0] for r in extra}.isdisjoint(r[0] for r in want) and len(want) > 190
        elif name == "lines":
            plain = lines([(r[0], r[1], *r[2:]) for r in want])
            want = [(d, t, lang, source, len(t) if gone else n) for d, t, lang, source, n, _, gone in plain if not gone or t.strip()]
        elif name == "near duplicates":
            first: dict = {}
            root = dict(classes(want))
            for r in sorted(want):
                first.setdefault(root[r[0]], r)
            want = list(first.values())
        elif name == "pieces":
            library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
            ids = {r[0]: library.encode(r[1]) for r in want}
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want = [(d, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for d, x in ids.items()]
        assert got == sorted(want, key=repr), name
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect()), key=repr) == got


def test_runs_on_an_empty_table(spark, tmp_path):
    docs = documents(spark, DATA).limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0


def test_results_follow_the_mixing_schedule_over_several_files(spark, tmp_path):
    # Later files are larger, and a plain scan takes the largest first.
    for i in range(6):
        rows = [(100 * i + (7 * j) % 20, f"word {j} " * 40 * (1 + 50 * i), "en", "src1", 9) for j in range(20)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (part,) = (tmp_path / f"w{i}").glob("part-*")
        (tmp_path / "mixed").mkdir(exist_ok=True)
        part.rename(tmp_path / "mixed" / f"part-{i:05d}.snappy.parquet")
    docs = spark.read.parquet(str(tmp_path / "mixed"))
    want = [100 * i + (7 * j) % 20 for i in range(6) for j in range(20)]
    corpus_pipeline.encoded(spark, docs, DATA).write.parquet(str(tmp_path / "out"))
    got = [r.doc_id for f in sorted((tmp_path / "out").glob("part-*")) for r in spark.read.parquet(str(f)).collect()]
    assert got == want
    assert [r.doc_id for r in docs.select("doc_id").collect()] != want
