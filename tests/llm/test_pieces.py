from __future__ import annotations

import hashlib
import random
import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import pieces

from ..conftest import DATA

SCHEMA = "doc_id long, text string, ids string, pieces int"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
MODEL = pieces.load(pieces.default_path())
TEXTS = ["", " ", "  ", "hi", " hi", "a  b ", "a\tb\nc\n\n d", "▁x a▁b", "😀é ünï", "\x00a", "x" * 300, "hello ▁ world", "<s> </s> <unk> <0x41>", "１２３ 12345", "\n", " \n ", "\r\n x\n", "     def f():\n        return 1", "日本語 テキスト", "word" * 50 + ", and." * 9]


def check(text: str) -> None:
    ids = LIBRARY.encode(text)
    assert MODEL.encode(text) == ids
    joined, data = MODEL.round_trip(text)
    assert joined == ",".join(map(str, ids))
    assert data.decode() == LIBRARY.decode(ids) == MODEL.decode(ids)
    spans = MODEL.encode_spans(text)
    assert [s[0] for s in spans] == ids
    raw = text.encode()
    assert all(0 <= a <= b <= len(raw) for _, a, b in spans)
    assert b"".join(raw[a:b] for _, a, b in spans) == raw


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\nabeinrst.,'é"), st.characters(exclude_categories=["Cs"])), max_size=120))
def test_random_texts_equal_the_library(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 258), max_size=30))
def test_any_ids_decode_as_in_the_library(ids):
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


def test_scans_and_heaps_merge_alike(monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("theandingor▁") for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    scanned = [MODEL.merge(w) for w in words]
    monkeypatch.setattr(pieces, "SCAN_LIMIT", 0)
    assert [MODEL.merge(w) for w in words] == scanned


def trie(mapping: dict[bytes, bytes]) -> bytes:
    """A compiled character map for a few single-path keys: nodes are placed one after another."""
    texts, starts = b"", {}
    for new in mapping.values():
        starts[new] = len(texts)
        texts += new + b"\0"
    units: dict[int, int] = {}
    used = {0}

    def place(node: int, prefix: bytes, label: int | None) -> None:
        nexts = sorted({k[len(prefix)] for k in mapping if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in mapping
        base = 256
        while any((node ^ base ^ c) in used for c in nexts) or (leaf and (node ^ base) in used):
            base += 256
        used.update(node ^ base ^ c for c in nexts)
        if leaf:
            used.add(node ^ base)
            units[node ^ base] = 0x80000000 | starts[mapping[prefix]]
        units[node] = base << 10 | (256 if leaf else 0) | (label or 0)
        for c in nexts:
            place(node ^ base ^ c, prefix + bytes([c]), c)

    place(0, b"", None)
    size = max(units) + 257
    packed = struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size)))
    return struct.pack("<I", len(packed)) + packed + texts


def test_longest_prefixes_of_the_character_map_keep_offsets():
    table = {"ﬁ".encode(): b"fi", b"ab": b"X", b"abc": "é".encode(), b"q": b""}
    model = pieces.load(pieces.default_path())
    model.charmap = pieces.CharMap(trie(table))
    shown, spans = model.normalise("abd ﬁqabc")
    assert shown == "▁Xd▁fié"
    assert spans == [(0, 0), (0, 2), (2, 3), (3, 4), (4, 7), (4, 7), (8, 11)]
    assert [i for i, _, _ in model.encode_spans("abd ﬁqabc")] == LIBRARY.encode("Xd fié")


def test_whole_table_equals_the_library(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = LIBRARY.encode(r.text)
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trips(docs).collect()} == want


def test_nulls_repeats_and_long_texts(spark):
    rows = [(1, None, "c", 1), (1, None, "c", 1), (None, "", None, None), (2, "long text " * 30000 + "y" * 30000, "", 0)]
    got = pieces.round_trips(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got)[:3] == [(0, 0), (1, 0), (1, 0)]
    assert [r.n_tokens for r in got if r.doc_id == 2] == [len(LIBRARY.encode(rows[3][1]))]
    assert pieces.encode_documents(spark.createDataFrame(rows, SCHEMA)).count() == 4
    assert pieces.round_trips(spark.createDataFrame([], SCHEMA)).count() == 0


def test_encoded_documents_decode_to_themselves(spark):
    rows = [(i, t, "", 0) for i, t in enumerate(TEXTS) if pieces.MARK not in t]
    encoded = pieces.encode_documents(spark.createDataFrame(rows, SCHEMA)).selectExpr("doc_id", "transform(pieces, p -> p.id) AS ids")
    assert {r.doc_id: r.text for r in pieces.decode_documents(encoded).collect()} == {i: t for i, t, *_ in rows}
    assert pieces.decode_documents(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text == ""


def same_spans(model, text):
    joined, data, spans = model.aligned(text)
    want = model.encode_spans(text)
    assert joined == ",".join(str(i) for i, _, _ in want)
    assert [tuple(x) for x in spans.tolist()] == [(a, b) for _, a, b in want]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\nabeinrst.,'é😀"), st.characters(exclude_categories=["Cs"])), max_size=120))
def test_chunks_give_the_spans_of_whole_texts(text):
    same_spans(MODEL, text)


def test_spans_with_a_character_map_and_without_a_prefix():
    model = pieces.load(pieces.default_path())
    model.dummy_prefix = False
    for text in TEXTS:
        same_spans(model, text)
    model.charmap = pieces.CharMap(trie({"ﬁ".encode(): b"fi", b"ab": b"X", b"q": b""}))
    for text in [*TEXTS, "abd ﬁqabc"]:
        same_spans(model, text)


def test_query_digests_the_spans_of_every_text(spark):
    rows = [(i, t, "", 0) for i, t in enumerate([*TEXTS, None])]
    want = {i: hashlib.sha256(b"".join(struct.pack("<qq", a, b) for _, a, b in MODEL.encode_spans(t or ""))).hexdigest() for i, t, *_ in rows}
    assert {r.doc_id: r.spans_sha256 for r in pieces.round_trips(spark.createDataFrame(rows, SCHEMA)).collect()} == want
