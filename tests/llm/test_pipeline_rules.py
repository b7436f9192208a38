"""The pipeline's stages against plain versions, with the whole rule of repeated lines and passages."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
import sentencepiece

from quillmark.llm import langid, pieces
from quillmark.llm.common import documents

from ..conftest import DATA
from .test_dartminhash import brute as classes
from .test_linededup import whole_brute


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_every_stage_equals_a_plain_version_of_its_input(spark, tmp_path):
    docs = documents(spark, DATA)
    extra = [(100_000, None, "en", "src1", 0), (100_001, "", "en", "src1", 0), (100_003, "12 34 !", None, None, 7)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    columns = docs.columns
    reader = langid.learn(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = [r.asDict() for r in docs.collect()]
        scores = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, reader).collect()} if name == "language" else {}
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        got = {r.doc_id: r.asDict() for r in docs.collect()}
        assert len(got) == docs.count()
        if name == "language":
            want = {r["doc_id"]: r for r in given if scores[r["doc_id"]][0] != "und" and scores[r["doc_id"]][1] >= 0.4}
            assert 190 < len(want) < len(given)
        elif name == "lines":
            text_of = {d: (t, gone) for d, t, gone in whole_brute([(r["doc_id"], r["text"]) for r in given])}
            want = {}
            for r in given:
                text, gone = text_of[r["doc_id"]]
                if not gone or text.strip():
                    want[r["doc_id"]] = r | ({"text": text, "n_chars": len(text)} if gone else {})
            assert any(gone for _, gone in text_of.values())
        elif name == "near duplicates":
            root = dict(classes([tuple(r[c] for c in ("doc_id", "text")) for r in given]))
            first = {root[d]: d for d in sorted(root, reverse=True)}
            want = {r["doc_id"]: r for r in given if first[root[r["doc_id"]]] == r["doc_id"]}
            assert len(want) < len(given)
        elif name == "mixing":
            want = {r["doc_id"]: r for r in given}
            # The first sixteenth of the stored order holds every source that the whole does.
            order = [r.source for f in sorted((tmp_path / str(k)).glob("part-*")) for r in spark.read.parquet(str(f)).collect()]
            sizes = Counter(order)
            assert set(order[: max(16 * len(sizes), len(order) // 4)]) == set(sizes)
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
            ids = {r["doc_id"]: library.encode(r["text"]) for r in given}
            want = {d: {"doc_id": d, "n_tokens": len(x), "ids_sha256": _sha(",".join(map(str, x))), "decoded_sha256": _sha(library.decode(x))} for d, x in ids.items()}
        if k < 4:
            assert docs.columns == columns
        assert got == want, name
    assert {r.doc_id: r.asDict() for r in corpus_pipeline.run(spark, DATA).collect()} == got
