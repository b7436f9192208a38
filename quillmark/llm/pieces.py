"""SentencePiece BPE encoding with offsets, and decoding.

Encoding keeps offsets. The text is normalised by the longest prefixes that the model's compiled
character map knows (a double-array trie over UTF-8), every normalised character remembers the span
of source bytes that it came from, and the span of a piece is that of its characters. Pieces are
then merged as the model's scores say: the adjacent pair of highest score first, the leftmost on
ties; characters without a piece become byte pieces.

Merges and spans are computed once for each distinct chunk of the source, relative to its start. A boundary between two characters that no piece
holds side by side is never merged over, so text may be cut there without changing its pieces (nor
its normalisation, where the map is empty; other texts are normalised and encoded whole): at once before each run of word-boundary marks, around line ends and around Latin words, and for a chunk
not seen before at every such boundary. Results of chunks are kept in two tables of bounded size;
texts of any length are processed chunk by chunk.

Defined results: a null or empty text has no piece and decodes to the empty text. Rows are
independent of each other; other columns than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import blocks, documents, map_arrow, rows_of

MARK = "▁"
#: Distinct chunks whose pieces are kept, twice: the newer table, and the one before it.
KEPT_CHUNKS = 150_000
#: The score of a pair that is no piece.
NONE = float("-inf")
#: Longer segments are merged with a heap instead of repeated scans.
SCAN_LIMIT = 48
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharMap:
    """A compiled character map: longest-prefix replacement of UTF-8 strings."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.texts = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest known prefix of data[at:]."""
        if not self.units:
            return None
        found, units = None, self.units
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


@dataclass
class Pieces:
    """What encoding and decoding need of a model; small, and shipped with each task."""

    ids: dict[str, int]
    scores: dict[str, float]
    unused: set[str]
    texts: list[str]
    kinds: list[int]
    unknown: int
    unknown_text: str
    byte_ids: list[int] | None
    dummy_prefix: bool
    one_space: bool
    escape: bool
    charmap: CharMap
    pairs: set[str] = field(default_factory=set)
    known: dict[str, tuple[bytes, bytes, bytes, bytes]] = field(default_factory=dict)
    older: dict[str, tuple[bytes, bytes, bytes, bytes]] = field(default_factory=dict)

    def __post_init__(self):
        #: Whether chunks need no character map and no unknown piece.
        self.plain = not self.charmap.units and self.byte_ids is not None
        self.chunks = re.compile(chunk_pattern(self.pairs))
        self.sources = re.compile(chunk_pattern(self.pairs, " " + MARK))

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "older": {}}

    # --- normalisation ---------------------------------------------------------------------

    def replaced(self, text: str) -> tuple[list[str], list[tuple[int, int]]]:
        """The characters that longest prefixes are replaced by, and the source byte span of each."""
        data = text.encode()
        out: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0
        while at < len(data):
            hit = self.charmap.longest(data, at)
            if hit is None:
                width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                hit = (width, data[at : at + width])
            new = hit[1].decode()
            out.extend(new)
            spans.extend([(at, at + hit[0])] * len(new))
            at += hit[0]
        return out, spans

    def normalise(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        """The normalised text, and the source byte span of each of its characters."""
        out, spans = self.replaced(text)
        if self.one_space:
            keep = [i for i, c in enumerate(out) if c != " " or (i and out[i - 1] != " ")]
            while keep and out[keep[-1]] == " ":
                keep.pop()
            out, spans = [out[i] for i in keep], [spans[i] for i in keep]
        if out and self.dummy_prefix:
            out.insert(0, " ")
            spans.insert(0, (0, 0))
        shown = "".join(out)
        return (shown.replace(" ", MARK) if self.escape else shown), spans

    # --- merging ---------------------------------------------------------------------------

    def segments(self, chunk: str) -> list[str]:
        """chunk, cut at every boundary that no piece spans."""
        cuts = [0, *(i + 1 for i in range(len(chunk) - 1) if chunk[i : i + 2] not in self.pairs), len(chunk)]
        return [chunk[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def merge(self, segment: str) -> list[str]:
        """The segment's symbols after all merges."""
        if len(segment) > SCAN_LIMIT:
            symbols = self._merge_heap(segment)
        else:
            symbols, score = list(segment), self.scores.get
            ahead = [score(a + b, NONE) for a, b in zip(segment, segment[1:])]
            while ahead and (best := max(ahead)) != NONE:
                i = ahead.index(best)
                joined = symbols[i] + symbols.pop(i + 1)
                symbols[i] = joined
                del ahead[i]
                if i:
                    ahead[i - 1] = score(symbols[i - 1] + joined, NONE)
                if i < len(ahead):
                    ahead[i] = score(joined + symbols[i + 1], NONE)
        return symbols if not self.unused else [x for s in symbols for x in self._split_unused(s)]

    def _merge_heap(self, segment: str) -> list[str]:
        symbols: list[str | None] = list(segment)
        left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if i >= 0 and j < len(symbols):
                pair = symbols[i] + symbols[j]
                score = self.scores.get(pair)
                if score is not None:
                    heapq.heappush(heap, (-score, i, j, pair))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, j, pair = heapq.heappop(heap)
            if symbols[i] is None or right[i] != j or j >= len(symbols) or symbols[j] is None or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            right[i] = right[j]
            if right[j] < len(symbols):
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [s for s in symbols if s is not None]

    def _split_unused(self, symbol: str) -> list[str]:
        """Unused pieces fall apart into the pair that they were merged from."""
        if symbol not in self.unused or len(symbol) == 1:
            return [symbol]
        pairs = [(self.scores.get(symbol[:i], float("-inf")) + self.scores.get(symbol[i:], float("-inf")), i) for i in range(1, len(symbol))]
        at = max(pairs, key=lambda p: (p[0], -p[1]))[1]
        return self._split_unused(symbol[:at]) + self._split_unused(symbol[at:])

    def ids_of(self, symbol: str) -> list[int]:
        found = self.ids.get(symbol)
        if found is not None:
            return [found]
        return [self.byte_ids[b] for b in symbol.encode()] if self.byte_ids else [self.unknown]

    # --- encoding and decoding -------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        return [i for i, _, _ in self.encode_spans(text)]

    def encode_spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) of every piece, in bytes of the original text."""
        shown, spans = self.normalise(text)
        return self._projected((s for chunk in self.chunks.findall(shown) for s in self.segments(chunk)), spans)

    def _projected(self, segments: Iterable[str], spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) of the pieces of consecutive segments, whose characters have these spans."""
        out, at = [], 0
        for segment in segments:
            for symbol in self.merge(segment):
                ids = self.ids_of(symbol)
                start, end = spans[at][0], spans[at + len(symbol) - 1][1]
                if len(ids) == end - start > 1 and symbol not in self.ids:
                    out += [(x, start + i, start + i + 1) for i, x in enumerate(ids)]
                else:
                    out += [(x, start, end) for x in ids]
                at += len(symbol)
        return out

    def decode_bytes(self, ids: Iterable[int], first: bool = True) -> bytes:
        """UTF-8 of the ids' text; first: whether they begin a text, whose dummy prefix goes."""
        out: list[bytes] = []
        run = bytearray()
        start = first

        def flush() -> None:
            # A maximal run of byte pieces; each byte that is not part of valid UTF-8 is replaced.
            at = 0
            while at < len(run):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + width]).decode().encode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    width = 1
                    out.append("�".encode())
                at += width
            run.clear()

        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                run.append(int(self.texts[i][3:5], 16))
                start = False
                continue
            if run:
                flush()
            if kind == CONTROL:
                continue
            text = self.unknown_text if kind == UNKNOWN else self.texts[i]
            if kind != UNKNOWN:
                if start and text.startswith(MARK) and (self.dummy_prefix or self.one_space):
                    text = text.lstrip(MARK) if self.one_space else text[1:]
                text = text.replace(MARK, " ")
            start = False
            out.append(text.encode())
        if run:
            flush()
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode()

    def chunk(self, chunk: str) -> tuple[bytes, bytes, bytes, bytes]:
        """Of a chunk of the source: its ids, joined by commas, what they decode to inside a text, their
        spans from the chunk's start (pairs of 32 bits), and its bytes and number of pieces (32 bits each)."""
        found = self.known.get(chunk)
        if found is not None:
            return found
        found = self.older.get(chunk)
        if found is None:
            found = self._chunk(chunk)
        if len(chunk) <= 64:
            if len(self.known) >= KEPT_CHUNKS:
                self.known, self.older = {}, self.known
            self.known[chunk] = found
        return found

    def _chunk(self, chunk: str) -> tuple[bytes, bytes, bytes, bytes]:
        if self.plain and len(chunk) <= SCAN_LIMIT and MARK not in chunk:
            # Every character stands for itself: spans follow from the symbols' sizes in UTF-8.
            symbols = self.merge(chunk.replace(" ", MARK))
            data, known = chunk.encode(), self.ids.get
            ascii_only = len(data) == len(chunk)
            ids, spans, at = [], array("I"), 0
            for symbol in symbols:
                size = len(symbol) if ascii_only else len(symbol.replace(MARK, " ").encode())
                number = known(symbol)
                if number is not None:
                    ids.append(number)
                    spans.append(at)
                    spans.append(at + size)
                else:
                    for i in range(at, at + size):
                        ids.append(self.byte_ids[data[i]])
                        spans.append(i)
                        spans.append(i + 1)
                at += size
            return ",".join(map(str, ids)).encode(), data, spans.tobytes(), array("I", (at, len(ids))).tobytes()
        out, where = self.replaced(chunk)
        shown = "".join(out).replace(" ", MARK)
        # Short chunks need no further cuts: what no piece spans is not merged.
        got = self._projected(self.segments(shown) if len(shown) > SCAN_LIMIT else (shown,), where)
        ids = [i for i, _, _ in got]
        packed = array("I", [x for _, a, b in got for x in (a, b)])
        return ",".join(map(str, ids)).encode(), self.decode_bytes(ids, first=False), packed.tobytes(), array("I", (where[-1][1], len(ids))).tobytes()

    def aligned_bytes(self, text: str) -> tuple[bytes, bytes, np.ndarray]:
        """The text's ids, joined by commas, the UTF-8 that they decode to, and their byte spans (n x 2)."""
        if not text or self.charmap.units or self.one_space or not self.escape:
            got = self.encode_spans(text)
            ids = [i for i, _, _ in got]
            return ",".join(map(str, ids)).encode(), self.decode_bytes(ids), np.array([x[1:] for x in got], np.int64).reshape(-1, 2)
        # Without a map, what normalisation makes of a text is what it makes of its chunks.
        chunks = self.sources.findall(" " + text if self.dummy_prefix else text)
        rows = list(map(self.known.get, chunks))
        if None in rows:
            chunk = self.chunk
            rows = [r or chunk(c) for r, c in zip(rows, chunks, strict=True)]
        ids, decoded, packed, sizes = zip(*rows, strict=True)
        joined = b"".join(decoded)
        wide, counts = np.frombuffer(b"".join(sizes), np.uint32).reshape(-1, 2).T
        # The prefix stands before the first byte and takes none.
        start = np.cumsum(wide, dtype=np.int64) - wide - self.dummy_prefix
        spans = np.frombuffer(b"".join(packed), np.uint32).reshape(-1, 2) + np.repeat(start, counts)[:, None]
        if self.dummy_prefix:
            np.maximum(spans[:1], 0, out=spans[:1])
        return b",".join(ids), joined[1:] if self.dummy_prefix else joined, spans

    def aligned(self, text: str) -> tuple[str, bytes, np.ndarray]:
        joined, decoded, spans = self.aligned_bytes(text)
        return joined.decode(), decoded, spans

    def round_trip(self, text: str) -> tuple[str, bytes]:
        """The text's ids, joined by commas, and the UTF-8 that they decode to."""
        return self.aligned(text)[:2]


#: Latin letters, as a class of regular expressions.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


def chunk_pattern(pairs: set[str], mark: str = MARK) -> str:
    """Cuts texts before runs of marks, at line ends, and between Latin letters and anything else, if
    no piece joins these. mark: the characters that stand for a mark."""
    letter = re.compile(f"[{LETTERS}]")
    if any(p[0] != MARK and bool(letter.match(p[0])) != bool(letter.match(p[1])) for p in pairs):
        return f"[{mark}]*[^{mark}\n]+|\n|[{mark}]+"
    return f"[{mark}]*[{LETTERS}]+|[{mark}]*[^{mark}\n{LETTERS}]+|\n|[{mark}]+"


def load(path: str) -> Pieces:
    """The tables of a BPE model file."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    if model.trainer_spec.model_type != 2:
        raise ValueError("not a BPE model")
    if model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("marks after words are not supported")
    texts = [p.piece for p in model.pieces]
    kinds = [p.type for p in model.pieces]
    if USER_DEFINED in kinds:
        raise ValueError("user-defined pieces are not supported")
    merged = {t: i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k in (NORMAL, UNUSED)}
    pairs = {t[i : i + 2] for t in merged for i in range(len(t) - 1)}
    if any(p[1] == MARK != p[0] or "\n" in p for p in pairs):
        raise ValueError("pieces span the boundaries that texts are cut at")
    unused = {t for t, i in merged.items() if kinds[i] == UNUSED}
    byte_ids = [texts.index(f"<0x{b:02X}>") for b in range(256)] if model.trainer_spec.byte_fallback else None
    spec = model.normalizer_spec
    return Pieces(
        ids={t: i for t, i in merged.items() if t not in unused},
        scores={t: model.pieces[i].score for t, i in merged.items()},
        unused=unused,
        texts=texts,
        kinds=kinds,
        unknown=kinds.index(UNKNOWN),
        unknown_text=model.trainer_spec.unk_surface,
        byte_ids=byte_ids,
        dummy_prefix=spec.add_dummy_prefix,
        one_space=spec.remove_extra_whitespaces,
        escape=spec.escape_whitespaces,
        charmap=CharMap(spec.precompiled_charsmap),
        pairs=pairs,
    )


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the pieces of every text: ids and byte spans of the original."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path or default_path()))
    kind = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(rows_of(batches, "doc_id", "text"), lambda r: 16 * len(r[1] or "") + 16):
            found = [[{"id": i, "start": a, "end": b} for i, a, b in shared.value.encode_spans(t or "")] for _, t in block]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in block], pa.int64()), pa.array(found, kind)], names=["doc_id", "pieces"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, pieces array<struct<id:int,start:long,end:long>>")


def decode_documents(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of every row's ids (array of int; null: the empty text)."""
    shared = rows.sparkSession.sparkContext.broadcast(load(path or default_path()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(rows_of(batches, "doc_id", "ids"), lambda r: 8 * len(r[1] or ()) + 16):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in block], pa.int64()), pa.array([shared.value.decode(r[1] or ()) for r in block], pa.string())], names=["doc_id", "text"])

    return map_arrow(rows.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, number of pieces and digests of ids, decoded text and byte spans of every row.

    The spans' digest is of their starts and ends in turn, as little-endian 64-bit integers. Columns
    named by ``keep`` pass through unchanged, after the others.
    """
    # The model's tables are a few MB, whatever the documents.
    shared = docs.sparkSession.sparkContext.broadcast(load(path or default_path()))

    rest = docs.select(*keep)
    kinds = [to_arrow_type(f.dataType) for f in rest.schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for block in blocks(rows_of(batches, "doc_id", "text", *keep), lambda r: len(r[1] or "") + 16):
            counts, ids, decoded, places = [], [], [], []
            for _, text, *_ in block:
                joined, data, spans = pieces.aligned_bytes(text or "")
                counts.append(len(spans))
                ids.append(hashlib.sha256(joined).hexdigest())
                decoded.append(hashlib.sha256(data).hexdigest())
                places.append(hashlib.sha256(spans.astype("<i8").tobytes()).hexdigest())
            columns = [pa.array([r[0] for r in block], pa.int64()), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded), pa.array(places)]
            columns += [pa.array([r[2 + i] for r in block], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", *keep])

    schema = StructType.fromDDL("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
    return map_arrow(docs.select("doc_id", "text", *keep), run, StructType([*schema.fields, *rest.schema.fields]))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(documents(spark, sf_dir))


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLES: dict[str, str] = {}
