"""Toxicity by compression distance: windows of text compressed with a toxic and an ordinary zstandard dictionary.

A window is `WINDOW` consecutive lower-cased words. Each byte of a window is written as a fixed random 2-byte code, so
that a match shorter than two letters can't pay, and a block known to both dictionaries follows it, so that short
windows never fall below the size at which zstandard stores bytes as they are. A window's gain is its length under the
ordinary dictionary less its length under the toxic one. The ordinary dictionary holds common words of ordinary
documents; the toxic one holds these and, last, the words of toxic documents whose starts are over-represented there.
A document is scored from statistics of its windows' gains by a logistic model whose threshold is calibrated to 0.5.

This departs from the method in two ways, since with it the labels can hardly be told apart (figures in the README): the
dictionaries' contents are chosen by word statistics, not by zstandard's trainer, and a window is one word, not several.

Training reads a bounded sample of labelled rows (`SAMPLE` of each label, in order of the id's hash, as far as their whole
texts fit into SAMPLE_BYTES; never the held-out fifth): half of it makes the dictionaries, half calibrates. Scores use
whole texts and nothing else. A word of more than LONG bytes counts as pieces of that many.

Defined results: an empty table gives no rows; null and wordless texts have no window and get the score of all-zero statistics; without labels of
both kinds every score is the share of toxic labels (0.0 without labels); conflicting labels of one id count as toxic;
repeated rows get equal scores; extra columns play no part in a score.
"""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import DOC_ID, TEXT, text_column
from .words import ALNUM, chunks, gram_hashes, hashes

SAMPLE = {1: 1500, 0: 3000}
SAMPLE_BYTES = {1: 64 << 20, 0: 64 << 20}
LONG = 2000
WINDOW = 1
COMMON_WORDS = 3000
LEVEL, MIN_MATCH = 9, 4
#: Least log-likelihood ratio of a word start's document counts, and its least number of toxic documents.
LEAST_RATIO, LEAST_DOCS = 10.0, 4
CACHED_WINDOWS = 300_000
STATISTICS = 8

_rng = random.Random(4096)
_CODE = np.array([_rng.getrandbits(16) for _ in range(256)], np.uint16)
_KNOWN = bytes(_rng.getrandbits(8) for _ in range(96))


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the bias
    constant: float | None  # a score for all where nothing could be learnt


def _coded(window: bytes) -> bytes:
    return _CODE[np.frombuffer(window, np.uint8)].tobytes()


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    content = content + _KNOWN
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=108, dict_size=len(content), write_content_size=False, write_dict_id=False, min_match=MIN_MATCH)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


class Scorer:
    """Window statistics of texts under one pair of dictionaries; gains of windows met before are kept, up to a bound."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.pair = _compressor(ordinary), _compressor(toxic)
        self.gains: dict[int, int] = {}

    def _gain(self, window: bytes) -> int:
        x = _coded(window) + _KNOWN
        return len(self.pair[0].compress(x)) - len(self.pair[1].compress(x))

    def statistics(self, texts: pa.Array) -> np.ndarray:
        """One row of STATISTICS for each text."""
        out = np.zeros((len(texts), STATISTICS))
        for c in chunks(texts, ALNUM, 1 << 20):
            if not len(c.starts):
                continue
            # windows start at every WINDOW-th word of a row; the last may be shorter
            rows = np.repeat(np.arange(c.rows), np.diff(c.row_words))
            at = np.flatnonzero((np.arange(len(c.starts)) - c.row_words[rows]) % WINDOW == 0)
            last = np.minimum(at + WINDOW, c.row_words[rows[at] + 1]) - 1
            keys = hashes(c.data, c.starts[at], c.ends[last]) if WINDOW > 1 else gram_hashes(hashes(c.data, c.starts, c.ends), 1)
            kinds, first, of = np.unique(keys, return_index=True, return_inverse=True)
            if len(self.gains) > CACHED_WINDOWS:
                self.gains.clear()
            gains, known = np.empty(len(kinds)), self.gains
            for i, (k, j) in enumerate(zip(kinds.tolist(), first.tolist(), strict=True)):
                g = known.get(k)
                if g is None:
                    g = known[k] = self._gain(b" " + b" ".join(c.word(x) for x in range(at[j], last[j] + 1)) + b" ") if c.ends[last[j]] - c.starts[at[j]] <= LONG else self._long(c.data[c.starts[at[j]] : c.ends[last[j]]].tobytes())
                gains[i] = g
            gain, row = gains[of], rows[at]
            edges = np.searchsorted(row, np.arange(c.rows + 1))
            for r in np.flatnonzero(np.diff(edges)):
                out[c.first + r] = self._of(gain[edges[r] : edges[r + 1]])
        return out

    def _long(self, window: bytes) -> int:
        """The mean gain of a long window's pieces of LONG bytes."""
        parts = _pieces(window)
        return round(sum(self._gain(b" " + x + b" ") for x in parts) / len(parts))

    @staticmethod
    def _of(x: np.ndarray) -> list[float]:
        n, top = len(x), np.sort(x)[::-1][:3]
        return [x.mean(), top[0], top.mean(), *((x >= t).mean() for t in (2, 4, 6)), np.maximum(x - 3, 0).sum() / (n + 2), math.log1p((x >= 4).sum())]


def _pieces(word: bytes) -> list[bytes]:
    return [word[i : i + LONG] for i in range(0, len(word), LONG)]


def _words(texts: list[str]) -> Iterator[set[bytes]]:
    for t in texts:
        for c in chunks(pa.array([t], pa.large_string()), ALNUM):
            yield {x for i in range(len(c.starts)) for x in _pieces(c.word(i))}


def _starts(word: bytes) -> list[bytes]:
    w = b" " + word + b" "
    return [w[:n] for n in range(4, min(len(w), 12) + 1)]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Dictionary contents (ordinary, toxic), most telling words last."""
    starts, words = (Counter(), Counter()), (Counter(), Counter())
    for y, texts in ((1, toxic), (0, ordinary)):
        for own in _words(texts):
            words[y].update(own)
            starts[y].update({s for w in own for s in _starts(w)})
    n1, n0 = max(1, len(toxic)), max(1, len(ordinary))

    def loss(k: int, n: int, p: float) -> float:
        return k * math.log(max(p, 1e-9)) + (n - k) * math.log(max(1 - p, 1e-9))

    ratio = {}
    for s, a in starts[1].items():
        b = starts[0][s]
        if a >= LEAST_DOCS and a / n1 > 3 * (b + 0.5) / n0:
            r = loss(a, n1, a / n1) + loss(b, n0, b / n0) - loss(a, n1, (a + b) / (n1 + n0)) - loss(b, n0, (a + b) / (n1 + n0))
            if r >= LEAST_RATIO:
                ratio[s] = r
    best = {w: max((ratio.get(s, 0.0) for s in _starts(w)), default=0.0) for w in words[1]}
    telling = sorted((w for w in best if best[w] > 0), key=lambda w: (best[w], words[1][w], w))[-4000:]
    common = sorted(words[0], key=lambda w: (-words[0][w], w))[:COMMON_WORDS][::-1]
    base = b" " + b" ".join(common) + b" "
    return _coded(base), _coded(base + b" ".join(telling) + b" ")


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Weights and bias by Newton's method with a ridge penalty."""
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), ridge * np.r_[np.ones(x.shape[1] - 1), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: list[tuple[int, str | None, int]]) -> Model:
    """rows: (doc_id, text, label)."""
    rows = sorted({(r[0], r[1] or "", int(r[2])) for r in rows}, key=lambda r: (zlib.crc32(f"split {r[0]}".encode()), r))
    half = {y: [r for r in rows if r[2] == y] for y in (0, 1)}
    none = np.zeros(STATISTICS)
    if min(map(len, half.values())) < 2:
        return Model(b"", b"", none, none, np.zeros(STATISTICS + 1), len(half[1]) / len(rows) if rows else 0.0)
    first = {y: [r[1] for r in half[y][::2]] for y in half}
    ordinary, toxic = dictionaries(first[1], first[0])
    rest = half[0][1::2] + half[1][1::2]
    x = Scorer(ordinary, toxic).statistics(pa.array([r[1] for r in rest], pa.large_string()))
    y = np.array([r[2] for r in rest], float)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    w = _logistic((x - centre) / scale, y)
    z = np.c_[(x - centre) / scale, np.ones(len(x))] @ w
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(len(z)) + 1 + y.sum())
    ends = np.flatnonzero(np.r_[np.diff(z[order]) != 0, True])  # a threshold can't part equal scores
    best = ends[int(np.argmax(f1[ends]))]
    below = z[order][best + 1] if best + 1 < len(z) else z[order][best] - 1
    w[-1] -= (z[order][best] + below) / 2
    return Model(ordinary, toxic, centre, scale, w, None)


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(x), model.constant)
    z = ((x - model.centre) / model.scale) @ model.weights[:-1] + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(column: str = DOC_ID):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Model:
    """A model from a bounded sample of the labelled rows outside the held-out fifth."""
    own = labels.where(F.col("toxic").isNotNull() & F.col(DOC_ID).isNotNull() & ~held_out()).groupBy(F.col(DOC_ID).cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("__toxic"))
    parts = [own.where(F.col("__toxic") == y).orderBy(F.xxhash64("__id"), "__id").limit(n) for y, n in (sample or SAMPLE).items()]
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most the sum of `sample` rows
    rows = docs.select(F.col(DOC_ID).cast("long").alias("__id"), TEXT).join(chosen, "__id").dropDuplicates(["__id"])
    # at most the sum of `sample` rows: their bytes are added up in the order in which they were chosen
    order = W.partitionBy("__toxic").orderBy(F.xxhash64("__id"), "__id").rowsBetween(W.unboundedPreceding, 0)
    room = F.when(F.col("__toxic") == 1, SAMPLE_BYTES[1]).otherwise(SAMPLE_BYTES[0])
    rows = rows.withColumn("__bytes", F.sum(F.coalesce(F.octet_length(TEXT), F.lit(0)).cast("long")).over(order)).where(F.col("__bytes") <= room)
    return train([tuple(r) for r in rows.select("__id", TEXT, "__toxic").collect()])


def _scores(model) -> callable:
    state: dict[str, Scorer] = {}

    def score(texts: pa.Array) -> np.ndarray:
        m = model.value
        if m.constant is not None:
            return np.full(len(texts), m.constant)
        if "s" not in state:
            state["s"] = Scorer(m.ordinary, m.toxic)
        return predict(m, state["s"].statistics(texts))

    return score


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scores(model)
        for b in batches:
            s = of(text_column(b, TEXT))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(DOC_ID).cast("long").alias(DOC_ID), TEXT, held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, same columns, without the documents predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scores(model)
        for b in batches:
            yield b.filter(pa.array(of(text_column(b, TEXT)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
