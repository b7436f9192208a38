"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in windows of WINDOW bytes, one gated recurrent unit from the left and
one from the right (each with update and reset gates, state HIDDEN). The two states at a byte give
that position's language probabilities; a document's are the mean over all its positions that belong
to letters. Whole texts are labelled, never prefixes: windows split a text completely, and are
processed some thousands at a time as the columns of numpy matrices, so that memory does not depend
on text length.

Gates and states use the rational sigmoid 1/2 + x / (2 + 2|x|) and x / (1 + |x|): both are bounded,
monotone and smooth enough for training, and cost three vector operations.

Training is backpropagation through time with Adam, in numpy on the driver, over a bounded sample: of
the SAMPLE_LANGS most frequent languages (ties by name) the SAMPLE_ROWS labelled documents each that a
hash of doc_id and text puts first, and of each text SAMPLE_WINDOWS windows, or all if it has no more,
drawn on the executors from the whole text: at most some megabytes a language reach the driver. It is
deterministic: the sample is ordered, not what partitions happen to return. Only text and non-null lang
of documents with a doc_id whose crc32(doc_id as text) mod 5 is not 0 are learned from.

Defined results: `und` with score 0 for a null text, a text without a letter (Unicode category L; numbers
such as one half or Roman numerals are none), or if there is nothing to learn from. Of equally likely
languages the first by name wins. Other columns are never read; repeated rows are labelled alike. One
text is held at once with some 10 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_arrow, rows_of

UNKNOWN = "und"
WINDOW = 64
HIDDEN = 8
SAMPLE_ROWS = 200
SAMPLE_LANGS = 256
SAMPLE_WINDOWS = 1024
STEPS, BATCH, RATE = 150, 96, 0.02
#: Windows labelled at once.
COLUMNS = 2048


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter of Unicode: numbers written as ½, ² or Ⅷ are none."""
    return any(map(str.isalpha, text or ""))


class GatedReader:
    """One direction: h' = h + z * (n - h), with gates z, r and proposal n = soft(x_n + r * (U_n h))."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.x = (rng.standard_normal((3 * hidden, 256)) * 0.3).astype(np.float32)
        self.x[:hidden] -= 1.0  # gates start nearly closed: states remember
        self.u = (rng.standard_normal((3 * hidden, hidden)) * 0.5 / np.sqrt(hidden)).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u]

    def run(self, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """windows: T x B bytes; states T x hidden x B. keep gathers what the backward pass needs."""
        steps, width = windows.shape
        h = np.zeros((self.u.shape[1], width), np.float32)
        n_hidden = len(h)
        states = np.empty((steps, n_hidden, width), np.float32)
        for t in range(steps):
            x = np.take(self.x, windows[t], axis=1)
            a = self.u @ h
            gate = x[: 2 * n_hidden] + a[: 2 * n_hidden]
            soft = np.abs(gate)
            soft += 1
            np.divide(gate, soft, out=gate)
            gate *= 0.5
            gate += 0.5
            z, r = gate[:n_hidden], gate[n_hidden:]
            inner = a[2 * n_hidden :]
            n = r * inner
            n += x[2 * n_hidden :]
            low = np.abs(n)
            low += 1
            n /= low
            if keep is not None:
                keep.append((h, z, r, inner, n, soft, low))
            h = np.add(h, z * (n - h), out=states[t])
        return states

    def backward(self, windows: np.ndarray, kept: list, d_states: np.ndarray) -> list[np.ndarray]:
        """Gradients of x and u from those of every state."""
        k = self.u.shape[1]
        dx, du = np.zeros_like(self.x), np.zeros_like(self.u)
        dh = np.zeros_like(d_states[0])
        for t in range(len(windows) - 1, -1, -1):
            h, z, r, inner, n, soft, low = kept[t]
            dh = dh + d_states[t]
            da = np.empty((3 * k, dh.shape[1]), np.float32)
            dn = dh * z / (low * low)
            da[:k] = dh * (n - h) * 0.5 / (soft[:k] * soft[:k])
            da[k : 2 * k] = dn * inner * 0.5 / (soft[k:] * soft[k:])
            da[2 * k :] = dn * r
            du += da @ h.T
            dh = dh * (1 - z) + self.u.T @ da
            da[2 * k :] = dn
            at = windows[t]
            for row in range(3 * k):
                dx[row] += np.bincount(at, weights=da[row], minlength=256)
        return [dx, du]


class LanguageReader:
    """Both directions and the output layer."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.left, self.right = GatedReader(rng, hidden), GatedReader(rng, hidden)
        self.v = (rng.standard_normal((len(langs), 2 * hidden)) * 0.1).astype(np.float32)
        self.c = np.zeros((len(langs), 1), np.float32)

    def logits(self, windows: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """T x languages x B scores of every position, and the joined states."""
        left = self.left.run(windows, keep and keep[0])
        right = self.right.run(windows[::-1], keep and keep[1])[::-1]
        both = np.concatenate([left, right], axis=1)
        return np.matmul(self.v, both) + self.c, both

    @staticmethod
    def shares(logits: np.ndarray) -> np.ndarray:
        """Softmax over languages."""
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 5) -> None:
        """windows: rows of WINDOW bytes; labels: language numbers. Cross-entropy at every position."""
        rng = np.random.default_rng(seed)
        by_lang = [np.flatnonzero(labels == i) for i in range(len(self.langs))]
        weights = [*self.left.parameters(), *self.right.parameters(), self.v, self.c]
        means = [np.zeros_like(w) for w in weights]
        squares = [np.zeros_like(w) for w in weights]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(own, max(1, batch // len(by_lang))) for own in by_lang])
            x, y = windows[pick].T, labels[pick]
            keep: tuple[list, list] = ([], [])
            logits, both = self.logits(x, keep)
            d = self.shares(logits)
            d[:, y, np.arange(len(y))] -= 1
            d *= (x > 0)[:, None, :] / np.float32(x.size)  # padding teaches nothing
            dv = np.einsum("tlb,thb->lh", d, both, optimize=True)
            dc = d.sum(axis=(0, 2))[:, None]
            d_both = np.matmul(self.v.T, d)
            half = self.left.u.shape[1]
            grads = [*self.left.backward(x, keep[0], d_both[:, :half]), *self.right.backward(x[::-1], keep[1], d_both[::-1, half:]), dv, dc]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            scale = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for w, g, m, s in zip(weights, grads, means, squares, strict=True):
                g = g * scale
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= (now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """T x languages x B probabilities of every position."""
        return self.shares(self.logits(windows)[0])


def _windows(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of WINDOW bytes that split the texts, zero-padded at each text's end, and their owners."""
    counts = np.array([-(-len(d) // WINDOW) for d in datas], np.int64)
    data = b"".join(d.ljust(n * WINDOW, b"\0") for d, n in zip(datas, counts.tolist(), strict=True))
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(datas)), counts)


#: Which bytes belong to letters: ASCII letters and all bytes of longer UTF-8 sequences.
_LETTER_BYTE = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])


def pooled(reader: LanguageReader, datas: list[bytes]) -> np.ndarray:
    """texts x languages: mean probabilities over the letter positions of each text."""
    windows, owner = _windows(datas)
    total = np.zeros((len(datas), len(reader.langs)))
    count = np.zeros(len(datas))
    for at in range(0, len(windows), COLUMNS):
        part = windows[at : at + COLUMNS].T
        letters = _LETTER_BYTE[part]
        own = owner[at : at + COLUMNS]
        sums = np.einsum("tlb,tb->bl", reader.positions(part), letters.astype(np.float32), optimize=True)
        np.add.at(total, own, sums)
        np.add.at(count, own, letters.sum(axis=0))
    return total / np.maximum(count, 1)[:, None]


def held_out() -> Column:
    """True for the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _drawn(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, place, windows): SAMPLE_WINDOWS windows from everywhere in each text, or all of it."""
    for frame in batches:
        cut = []
        for draw, text in zip(frame["draw"], frame["text"], strict=True):
            rows, _ = _windows([text.encode()])
            if len(rows) > SAMPLE_WINDOWS:
                rows = rows[np.sort(np.random.default_rng(int(draw)).choice(len(rows), SAMPLE_WINDOWS, replace=False))]
            cut.append(rows.tobytes())
        yield pd.DataFrame({"lang": frame["lang"], "place": frame["place"], "windows": cut})


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, steps: int = STEPS) -> LanguageReader | None:
    """A reader trained on ``rows`` labelled documents of each language; None if there are none."""
    usable = docs.filter(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_LANGS).collect()
    if not counts:
        return None
    langs = sorted(r["lang"] for r in counts)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30))
    # Twice as many as needed, so that the order decides which rows, and few are sorted.
    shares = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 2 * rows / r["n"]) * (1 << 30))) for r in counts], "lang string, share long")
    sample = usable.withColumn("draw", draw).join(F.broadcast(shares), "lang").filter(F.col("draw") < F.col("share")).select("lang", "draw", "text")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    # Rank limits keep at most ``rows`` rows of a language and task before anything is shuffled.
    ordered = sample.withColumn("place", place).filter(F.col("place") <= rows)
    got = sorted(ordered.mapInPandas(_drawn, "lang string, place int, windows binary").collect(), key=lambda r: (r["lang"], r["place"]))
    if not any(r["windows"] for r in got):
        return None
    windows = np.frombuffer(b"".join(bytes(r["windows"]) for r in got), np.uint8).reshape(-1, WINDOW)
    labels = np.repeat([langs.index(r["lang"]) for r in got], [len(r["windows"]) // WINDOW for r in got])
    present = sorted(set(labels.tolist()))
    reader = LanguageReader([langs[i] for i in present])
    reader.train(windows, np.searchsorted(present, labels), steps)
    return reader


PREDICTIONS = "doc_id long, held_out boolean, lang_pred string, score double"


def _batches(reader: LanguageReader | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(held: list[tuple]) -> pa.RecordBatch:
            lang, score = [UNKNOWN] * len(held), [0.0] * len(held)
            know = [i for i, r in enumerate(held) if reader and has_letter(r[2])]
            if know:
                found = pooled(reader, [held[i][2].encode() for i in know])
                best = found.argmax(axis=1)
                for i, b, p in zip(know, best.tolist(), found[np.arange(len(know)), best].tolist(), strict=True):
                    lang[i], score[i] = reader.langs[b], min(1.0, p)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.bool_()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

        held: list[tuple] = []
        size = 0
        for row in rows_of(batches, "doc_id", "held_out", "text"):
            held.append(row)
            size += len(row[2] or "")
            if size >= 1 << 20:
                yield answer(held)
                held, size = [], 0
        if held:
            yield answer(held)

    return run


def predict(docs: DataFrame, reader: LanguageReader | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    return map_arrow(docs.select("doc_id", held_out().alias("held_out"), "text"), _batches(reader), PREDICTIONS)


def accepted(docs: DataFrame, reader: LanguageReader | None, least: float = 0.4) -> DataFrame:
    """The rows of docs, unchanged, whose text has a language with at least this score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                know = [i for i, t in enumerate(texts) if reader and has_letter(t)]
                keep = np.zeros(len(texts), bool)
                if know:
                    keep[know] = pooled(reader, [texts[i].encode() for i in know]).max(axis=1) >= least
                yield part.filter(pa.array(keep))

    return map_arrow(docs, run, docs.schema)


def label_positions(reader: LanguageReader, text: str) -> list[tuple[int, int, str]]:
    """The text's bytes as runs (start, end, language) of equally labelled positions."""
    data = text.encode()
    if not data:
        return []
    windows, _ = _windows([data])
    labels = reader.positions(windows.T).argmax(axis=1).T.ravel()[: len(data)]
    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(data)]
    return [(a, b, reader.langs[labels[a]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, learn(docs))


QUERIES = {"op1_language": op1_language}
ORACLES: dict[str, str] = {}
