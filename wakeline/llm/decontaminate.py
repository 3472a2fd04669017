"""Benchmark decontamination: a broadcast set of normalised benchmark n-grams scanned over training token windows.

Words are lower-cased (A-Z) maximal runs of bytes that are ASCII letters or digits, or not ASCII. A window is `size`
consecutive words of an item; a shorter item is one window. Every document window is looked up by a 64-bit hash, every
hit is verified word by word, and all words inside a verified window count as hit.

The broadcast set holds the benchmark's bytes once, where its words start and end, and per window a hash, an item and a
word number: about ten bytes for each byte of text, so at most some 80 MB. A benchmark of more than MOST_BROADCAST_BYTES is
never collected: windows of documents whose hash may be the benchmark's (a bitmap of fixed size tells) are joined to
it by hash and compared word by word. Both ways give the same rows and serve both kinds of removal.

Defined results: an empty table gives no rows, and an empty benchmark hits nothing; null or wordless texts have no
words, no hits, and are kept unchanged; a very long text is scanned whole; a benchmark row with a null id, or with no
words, has no windows; repeated rows of an item count once; rows of one doc_id, or of none, are decided one by one; extra
columns pass through untouched, whatever their names, but for names that begin with two underscores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import DOC_ID, TEXT, text_column, written
from .words import ALNUM, Chunk, chunks, gram_hashes, hashes

SIZE = 10
#: Benchmarks up to this many bytes of text are collected and broadcast; larger ones are joined by hash.
MOST_BROADCAST_BYTES = 8 << 20
#: Bits of the fixed-size filter of a large benchmark's window hashes.
FILTER_BITS = 1 << 27
REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Windows(NamedTuple):
    """A benchmark: its lower-cased bytes and words, and by window length the sorted hashes with their items and first words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    items: list[str]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def same(self, word: int, length: int, c: Chunk, at: int) -> bool:
        """Whether `length` words from `word` on are the chunk's from `at` on."""
        for j in range(length):
            x, y = self.starts[word + j], c.starts[at + j]
            n = self.ends[word + j] - x
            if n != c.ends[at + j] - y or not np.array_equal(self.data[x : x + n], c.data[y : y + n]):
                return False
        return True


def _item_windows(items: list[tuple[object, str | None]], size: int) -> Windows:
    own = sorted({(str(i), t) for i, t in items if i is not None and t})
    data, starts, ends, base, first_word = [], [], [], 0, 0
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    row = 0
    for c in chunks(pa.array([t for _, t in own], pa.large_string()), ALNUM):
        words = hashes(c.data, c.starts, c.ends)
        for r in range(c.rows):
            lo, hi = int(c.row_words[r]), int(c.row_words[r + 1])
            if hi > lo:
                n = min(size, hi - lo)
                grams, at = np.unique(gram_hashes(words[lo:hi], n), return_index=True)
                found.setdefault(n, []).append((grams, np.full(len(grams), row, np.int32), (first_word + lo + at).astype(np.int64)))
            row += 1
        data.append(c.data)
        starts.append(c.starts + base)
        ends.append(c.ends + base)
        base, first_word = base + len(c.data), first_word + len(c.starts)
    by_length = {}
    for n, parts in found.items():
        grams, of, word = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(grams, kind="stable")
        by_length[n] = grams[order], of[order], word[order]

    def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
        return np.concatenate(parts) if parts else np.zeros(0, kind)

    return Windows(joined(data, np.uint8), joined(starts, np.int64), joined(ends, np.int64), [i for i, _ in own], by_length)


class Hit(NamedTuple):
    start: int  # word of the document
    length: int
    item: str


def _row_of(c: Chunk) -> np.ndarray:
    return np.repeat(np.arange(c.rows), np.diff(c.row_words))


def _chunk_hits(c: Chunk, windows: Windows) -> Iterator[tuple[int, Hit]]:
    """(row of the chunk, hit) for each verified occurrence."""
    if not len(c.starts) or not windows.by_length:
        return
    words, row_of = hashes(c.data, c.starts, c.ends), _row_of(c)
    for length, (known, of, word) in windows.by_length.items():
        if len(words) < length:
            continue
        grams = gram_hashes(words, length)
        at = np.searchsorted(known, grams)
        at[at == len(known)] = 0
        for i in np.flatnonzero((known[at] == grams) & (row_of[: len(grams)] == row_of[length - 1 :])).tolist():
            row, k = int(row_of[i]), int(at[i])
            while k < len(known) and known[k] == grams[i]:
                if windows.same(int(word[k]), length, c, i):
                    yield row, Hit(i - int(c.row_words[row]), length, windows.items[of[k]])
                k += 1


def _scan(texts: pa.Array, windows: Windows) -> Iterator[tuple[Chunk, dict[int, list[Hit]]]]:
    for c in chunks(texts, ALNUM):
        hits: dict[int, list[Hit]] = {}
        for row, hit in _chunk_hits(c, windows):
            hits.setdefault(row, []).append(hit)
        yield c, hits


def covered(hits: list[Hit]) -> list[tuple[int, int]]:
    """Merged [start, end) word spans."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((h.start, h.start + h.length) for h in hits):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def items_digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _small(benchmark: DataFrame, most: int) -> bool:
    size = benchmark.agg(F.sum(F.octet_length(TEXT) + F.lit(16))).first()[0] or 0
    return size <= most


def _broadcast(docs: DataFrame, benchmark: DataFrame, size: int):
    items = [(r[0], r[1]) for r in benchmark.select("item_id", TEXT).toLocalIterator()]
    return docs.sparkSession.sparkContext.broadcast(_item_windows(items, size))


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, most: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """One row per document: words, hit words, items met, and whether any word is hit."""
    if not _small(benchmark, most):
        return _report_by_join(docs, benchmark, size)
    windows = _broadcast(docs, benchmark, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.get_field_index(DOC_ID))
            n_words, n_hit, n_items, digest = [], [], [], []
            none = items_digest(set())
            for c, hits in _scan(text_column(b, TEXT), windows.value):
                n_words += np.diff(c.row_words).tolist()
                for row in range(c.rows):
                    own = hits.get(row, [])
                    items = {h.item for h in own}
                    n_hit.append(sum(e - s for s, e in covered(own)))
                    n_items.append(len(items))
                    digest.append(items_digest(items) if items else none)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.select(F.col(DOC_ID).cast("long").alias(DOC_ID), TEXT).mapInArrow(run, REPORT)


def _window_rows(key: str, kind: pa.DataType, lengths: list[int] | None, size: int, bits=None):
    """Rows (key, length, start, hash, gram): windows of `lengths`, or of an item's own length; with a bitmap, only those
    whose hash is set, and a row of length 0 with the count of words for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(b.schema.get_field_index(key))
            for c in chunks(text_column(b, TEXT), ALNUM):
                words, row_of, counts = hashes(c.data, c.starts, c.ends), _row_of(c), np.diff(c.row_words)
                parts = [(np.arange(c.rows), 0, counts, np.zeros(c.rows, np.uint64), [b""] * c.rows)] if lengths is not None else []
                for n in lengths if lengths is not None else range(1, size + 1):
                    grams = gram_hashes(words, n)
                    inside = row_of[: len(grams)] == row_of[n - 1 :] if len(grams) else np.zeros(0, bool)
                    if lengths is None:
                        inside &= np.minimum(size, counts[row_of[: len(grams)]]) == n
                    else:
                        slot = grams % np.uint64(FILTER_BITS)
                        inside &= (bits.value[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
                    at = np.flatnonzero(inside)
                    parts.append((row_of[at], n, at - c.row_words[row_of[at]], grams[at], [b" ".join(c.word(i + j) for j in range(n)) for i in at.tolist()]))
                for rows, n, start, grams, text in parts:
                    for lo in range(0, len(rows), 1 << 16):
                        cut = slice(lo, lo + (1 << 16))
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[cut] + c.first)).cast(kind), pa.array(np.full(len(rows[cut]), n, np.int32)), pa.array(start[cut].astype(np.int64)), pa.array(grams[cut].view(np.int64)), pa.array(text[cut], pa.binary())], names=[key, "length", "start", "hash", "gram"])

    return run


def _bitmap(known: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the hashes' low bits, gathered as at most FILTER_BITS / 32 numbers."""
    slot = f"(hash & {FILTER_BITS - 1})"
    words = known.groupBy(F.expr(f"cast({slot} div 32 as int)").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} % 32 as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint64).astype(np.uint32)
    return out


def _joined(numbered: DataFrame, benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Hits (__row, start, length, item) and sizes (__row, n_words) of rows (__row, text), by a shuffled join."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), TEXT)
    known = items.mapInArrow(_window_rows("item", pa.string(), None, size), "item string, length int, start long, hash long, gram binary").select("item", "length", "hash", "gram").distinct()
    known = written(known, "benchmark-windows")
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # at most `size` values
    bits = numbered.sparkSession.sparkContext.broadcast(_bitmap(known))
    rows = numbered.select("__row", TEXT).mapInArrow(_window_rows("__row", pa.int64(), lengths, size, bits), "__row long, length int, start long, hash long, gram binary")
    rows = written(rows, "windows")
    return rows.where("length > 0").join(known, ["length", "hash", "gram"]).select("__row", "start", "length", "item"), rows.where("length = 0").select("__row", F.col("start").alias("n_words"))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a row number that stays the same however often it is read."""
    return written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def _report_by_join(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    numbered = _numbered(docs.select(F.col(DOC_ID).cast("long").alias(DOC_ID), TEXT))
    hits, sizes = _joined(numbered, benchmark, size)
    spans = hits.groupBy("__row", "start").agg(F.max("length").alias("length"))
    words = spans.select("__row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("word")).distinct().groupBy("__row").agg(F.count("*").alias("n_hit"))
    met = hits.select("__row", "item").distinct().groupBy("__row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = numbered.select("__row", DOC_ID).join(sizes, "__row").join(words, "__row", "left").join(met, "__row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col(DOC_ID).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def _without(b: pa.RecordBatch, texts: pa.Array, scanned: Iterator[tuple[Chunk, dict[int, list[Hit]]]], spans: bool) -> pa.RecordBatch:
    """The batch without the rows that have hits, or without the bytes of their spans."""
    keep, changed = [], {}
    for c, hits in scanned:
        for row in range(c.rows):
            if not hits.get(row):
                keep.append(c.first + row)
            elif spans:
                raw = texts[c.first + row].as_py().encode()
                at, base, parts, last = int(c.row_words[row]), int(c.row_bytes[row]), [], 0
                merged = covered(hits[row])
                for s, e in merged:
                    parts.append(raw[last : c.starts[at + s] - base])
                    last = int(c.ends[at + e - 1]) - base
                if sum(e - s for s, e in merged) < c.row_words[row + 1] - at:
                    keep.append(c.first + row)
                    changed[c.first + row] = b"".join([*parts, raw[last:]]).decode()
    if changed:
        k = b.schema.get_field_index(TEXT)
        new = [changed.get(i, t) for i, t in enumerate(b.column(k).to_pylist())]
        b = b.set_column(k, b.schema.field(k), pa.array(new, b.schema.field(k).type))
        if (k := b.schema.get_field_index("n_chars")) >= 0:
            sizes = [len(changed[i]) if i in changed else n for i, n in enumerate(b.column(k).to_pylist())]
            b = b.set_column(k, b.schema.field(k), pa.array(sizes, b.schema.field(k).type))
    return b.take(pa.array(keep, pa.int64()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = SIZE, most: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """docs, same columns, without what the benchmark contaminates.

    remove="documents" drops each document with a hit; remove="spans" cuts the bytes from the first to the last word of
    each merged span of hit words and keeps the rest, dropping a document of which no word is left. n_chars, where it
    exists, is set to the new length.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    by_spans = remove == "spans"
    if _small(benchmark, most):
        windows = _broadcast(docs, benchmark, size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = text_column(b, TEXT)
                yield _without(b, texts, _scan(texts, windows.value), by_spans)

        return docs.mapInArrow(run, docs.schema)
    numbered = _numbered(docs)
    found = _joined(numbered, benchmark, size)[0].groupBy("__row", "start").agg(F.max("length").alias("length"))
    found = found.groupBy("__row").agg(F.collect_list(F.struct("start", "length")).alias("__hits"))  # of one document
    own = numbered.join(found, "__row", "left").drop("__row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, hits = text_column(b, TEXT), b.column(b.num_columns - 1).to_pylist()
            scanned = ((c, {r: [Hit(h["start"], h["length"], "") for h in hits[c.first + r] or ()] for r in range(c.rows)}) for c in chunks(texts, ALNUM))
            yield _without(b.select(list(range(b.num_columns - 1))), texts, scanned, by_spans)

    return own.mapInArrow(cut, docs.schema)
