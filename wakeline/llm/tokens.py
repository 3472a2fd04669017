"""Token counts by offset-mapped attribution: whole documents are encoded once and token spans are given to sections.

A byte-level BPE's tokens tile a text's UTF-8 bytes, so token spans follow from token lengths. Sections are a document's
lines, each with its line end, or, for count_fields(), named columns that are joined by a separator and encoded as one text. Both lists are sorted, so the interval join of a document is a merge. A token that
crosses a border goes by `rule`: "start" (section of its first byte), "end" (of its last), "majority" (where most of
its bytes are, the earlier on a tie) or "split" (shared in proportion to bytes). Counts of all rules add up to the
document's tokens.

The vocabulary file is a parameter, read where tasks run. A very long text is encoded whole, in one task's memory.
Defined results: an empty table gives no rows; a null or empty text is one empty section
without tokens; an empty last line is a section without tokens; repeated rows are counted one by one; extra columns
play no part; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import DOC_ID, TEXT, text_column

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "majority", "split")
RESULT = "doc_id long, section int, start long, end long, n_tokens double, n_crossing int, doc_tokens long"


@functools.cache
def encoding(vocabulary: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and the bytes of each token."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def token_ends(text: str, vocabulary: str) -> np.ndarray:
    """The byte at which each token of the text ends."""
    enc, size = encoding(vocabulary)
    return np.cumsum(size[np.array(enc.encode_ordinary(text), np.int64)])


def section_starts(raw: np.ndarray) -> np.ndarray:
    return np.r_[0, np.flatnonzero(raw == 10) + 1]


def attribute(ends: np.ndarray, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (a share of them under "split") and border-crossing tokens that begin there, for each section."""
    n, section_ends = len(starts), np.r_[starts[1:], size]
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    # an empty last section holds no byte, so no token can begin or end in it
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    if rule in ("start", "end"):
        counts = np.bincount(first if rule == "start" else last, minlength=n).astype(float)
    else:
        inside = first == last
        counts = np.bincount(first[inside], minlength=n).astype(float)
        for i in crossing.tolist():
            at = np.arange(first[i], last[i] + 1)
            part = np.minimum(section_ends[at], ends[i]) - np.maximum(starts[at], begins[i])
            if rule == "majority":
                counts[at[int(np.argmax(part))]] += 1
            else:
                counts[at] += part / part.sum()
    return counts, np.bincount(first[crossing], minlength=n)


def count(docs: DataFrame, rule: str = "majority", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per section: its characters [start, end), tokens, border-crossing tokens, and the document's tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), text_column(b, TEXT)
            for lo in range(0, len(texts), 256):
                of, columns = [], []
                for i, t in enumerate(texts.slice(lo, 256)):
                    raw = np.frombuffer(t.as_buffer(), np.uint8)
                    starts, ends = section_starts(raw), token_ends(t.as_py(), vocabulary)
                    counts, crossing = attribute(ends, starts, len(raw), rule)
                    chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                    of.append(np.full(len(starts), lo + i))
                    columns.append((np.arange(len(starts)), chars[starts], chars[np.r_[starts[1:], len(raw)]], counts, crossing, np.full(len(starts), len(ends))))
                if of:
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64())
                    arrays = [pa.array(np.concatenate(c), k, safe=False) for c, k in zip(zip(*columns, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(of))), *arrays], names=[x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col(DOC_ID).cast("long").alias(DOC_ID), TEXT).mapInArrow(run, RESULT)


def count_fields(docs: DataFrame, names: list[str], rule: str = "majority", separator: str = "\n", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per field of `names`: its characters [start, end) in the joined text, tokens, border-crossing tokens, and
    the document's tokens. A separator belongs to the field before it; a null field is empty."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, *fields in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                parts = [(f or "") + (separator if i < len(fields) - 1 else "") for i, f in enumerate(fields)]
                sizes = [len(p.encode()) for p in parts]
                starts = np.r_[0, np.cumsum(sizes)][:-1].astype(np.int64)
                ends = token_ends("".join(parts), vocabulary)
                counts, crossing = attribute(ends, starts, sum(sizes), rule)
                at = 0
                for i, name in enumerate(names):
                    rows.append((doc, name, at, at + len(parts[i]), float(counts[i]), int(crossing[i]), len(ends)))
                    at += len(parts[i])
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64())
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "field", *(x.split()[0] for x in RESULT.split(", ")[2:])])

    chosen = docs.select(F.col(DOC_ID).cast("long").alias("__doc"), *(F.col(n).cast("string").alias(f"__{i}") for i, n in enumerate(names)))
    return chosen.mapInArrow(run, RESULT.replace("section int", "field string"))


def per_document(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(encoding(vocabulary)[0].encode_ordinary(t)) for t in text_column(b, TEXT).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(DOC_ID).cast("long").alias(DOC_ID), TEXT).mapInArrow(run, "doc_id long, n_tokens long")
