"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds the distinct k-word shingles of its lower-cased (A-Z), white-space separated words; a shorter,
not empty, text is one shingle. Sets are compared as sets of 64-bit shingle hashes.

1. One pass makes each document's set identity (`node`: equal sets are one node), size, MinHash signature and band keys.
2. Two nodes that share a band are candidates. Within a bucket only pairs with one centre, the node that meets most others
   in its buckets, are made at first, so a bucket of n nodes costs n - 1 pairs. Signatures are compared batch by batch; a pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold is below `miss`. Survivors are verified on full sets.
3. Links join nodes to components. Buckets that still hold several components are looked at again: small ones give
   their pairs across components; the nodes of larger ones meet by prefix filtering on their rarest shingles, where
   both shingles' places bound what a pair can share. These pairs pass the same pruning and exact verification. Pairs
   inside one component can't change the result and are not made, so a group of n copies costs about n pairs.

The bands find a pair of similarity s with probability 1 - (1 - s**rows)**bands: 1 - 4e-7 at 0.85, 1 - 5e-5 at 0.8.

Defined results: an empty table gives no rows; a null or wordless text has size 0 and is linked with nothing; repeated rows
have equal sets and are linked; a very long text is one set of all its shingles; where rows are removed, the one of smallest doc_id stays and,
on a tie, the first as read, a null doc_id coming last; extra columns play no part, whatever their names, but for
names that begin with two underscores. Links are neither capped nor sampled.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ._common import DOC_ID, TEXT, text_column, written
from .words import NONSPACE, chunks, gram_hashes, hashes, mix

BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
BATCH = 25
MISS = 1e-5
#: Bits of the fixed-size filter that tells which sets are needed again.
FILTER_BITS = 1 << 25
#: A bucket of up to so many nodes gives all its pairs across components.
SMALL_BUCKET = 16
#: So many shingles before a shared one are compared, so that a pair isn't made again for each that it shares.
EARLIER = 6
#: Counters that say which shingles are rare.
COUNTERS = 1 << 21

_rng = np.random.default_rng(77)
_MUL = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, sorted distinct shingles of all rows, rows + 1 offsets)."""
    for c in chunks(texts, NONSPACE):
        words = hashes(c.data, c.starts, c.ends)
        grams = gram_hashes(words, k)
        own, offsets = [], np.zeros(c.rows + 1, np.int64)
        for row in range(c.rows):
            lo, hi = int(c.row_words[row]), int(c.row_words[row + 1])
            if hi - lo >= k:
                own.append(np.unique(grams[lo : hi - k + 1]))
            elif hi > lo:
                own.append(gram_hashes(words[lo:hi], hi - lo))
            offsets[row + 1] = offsets[row] + (len(own[-1]) if hi > lo else 0)
        yield c.first, c.rows, np.concatenate(own) if own else np.zeros(0, np.uint64), offsets


def _nodes(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each row's set; 0 for an empty one."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        at = offsets[full]
        total = np.add.reduceat(mix(shingles + np.uint64(1)), at)
        either = np.bitwise_xor.reduceat(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
        out[full] = mix(total ^ mix(either + np.diff(offsets)[full].astype(np.uint64)))
    return out.view(np.int64)


def _signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows with a set x HASHES of uint32."""
    at = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(at), HASHES), np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(HASHES if len(at) else 0):
        out[:, i] = np.minimum.reduceat(short * _MUL[i] + _ADD[i], at)
    return out


def _bands(signatures: np.ndarray) -> np.ndarray:
    rows = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(signatures), 1), np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(31) + rows[:, :, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, row, n, node, bands, signature) of rows (doc_id, __row, text); bands and signature are empty for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at = b.column(0), b.column(1)
            for first, rows, shingles, offsets in _sets(text_column(b, TEXT), k):
                sizes = np.diff(offsets)
                sig = _signatures(shingles, offsets)
                raw, bands = iter(sig), iter(_bands(sig))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, rows), at.slice(first, rows), pa.array(sizes), pa.array(_nodes(shingles, offsets)), pa.array([next(bands) if n else [] for n in sizes], pa.list_(pa.int64())), pa.array([next(raw).tobytes() if n else b"" for n in sizes], pa.binary())],
                    names=["doc_id", "row", "n", "node", "bands", "signature"],
                )

    row = F.col("__row") if "__row" in docs.columns else F.lit(0)
    return docs.select(F.col(DOC_ID).cast("long").alias(DOC_ID), row.cast("long").alias("__row"), TEXT).mapInArrow(run, "doc_id long, row long, n long, node long, bands array<long>, signature binary")


def _bits(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the nodes' low bits, gathered as at most FILTER_BITS / 32 numbers."""
    slot = f"pmod(node, {FILTER_BITS})"
    words = nodes.groupBy(F.expr(f"cast({slot} div 32 as int)").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} % 32 as int)))").alias("bits"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    found = words.toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _full_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, shingles) for the nodes given; shingles are sorted uint64 bytes. No text is shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(_bits(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, done = bits.value, set()
        for b in batches:
            for _, rows, shingles, offsets in _sets(text_column(b, TEXT), k):
                own = _nodes(shingles, offsets)
                slot = own % FILTER_BITS
                keep = np.flatnonzero((wanted[slot // 32] >> (slot % 32).astype(np.uint32)) & np.uint32(1))
                keep = [i for i in keep.tolist() if offsets[i + 1] > offsets[i] and not (own[i] in done or done.add(own[i]))]
                yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array([shingles[offsets[i] : offsets[i + 1]].tobytes() for i in keep], pa.binary())], names=["node", "shingles"])

    return docs.select(TEXT).mapInArrow(run, "node long, shingles binary").join(nodes, "node", "left_semi").dropDuplicates(["node"])


@functools.cache
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """For 25, 50, ... compared hashes, the fewest equal ones at which P(similarity >= percent/100 | equal) >= miss,
    under a uniform prior: a Beta(m + 1, n - m + 1) posterior."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = 0
        while m < n:
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= percent / 100].sum() / p.sum() >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def _plausible(pairs: DataFrame, sigs: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) that sequential comparison of their signatures doesn't rule out."""
    least = least_matches(percent, miss)
    a = sigs.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
    b = sigs.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            alive = np.arange(batch.num_rows)
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
            equal = np.zeros(batch.num_rows, np.int64)
            for step, most in enumerate(least):
                at = slice(step * BATCH, (step + 1) * BATCH)
                equal[alive] += (x[alive, at] == y[alive, at]).sum(1)
                alive = alive[equal[alive] >= most]
            yield batch.select([0, 1]).take(pa.array(alive))

    return pairs.join(a, "a").join(b, "b").where(near).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def _across(rows: DataFrame, labels: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of two components that some bucket shows.

    A small bucket gives each pair across its components. The nodes of larger ones meet by prefix filtering instead,
    which is exact for them: their shingles are ordered, rarest first, and a pair must share one that is early enough in
    both for the rest to suffice.
    """
    named = rows.join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    mixed = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("band", "size")
    named = written(named.join(mixed, "band").join(sizes, "node"), "mixed")
    x, y = (named.where(F.col("size") <= SMALL_BUCKET).select("band", *(F.col(c).alias(c + s) for c in ("node", "component", "n"))) for s in "ab")
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    few = x.join(y, "band").where(F.col("componenta") < F.col("componentb")).where(fits).select(F.col("nodea").alias("a"), F.col("nodeb").alias("b"))
    crowd = named.where(F.col("size") > SMALL_BUCKET).select("node", "component", "n").distinct()
    return few.union(_by_prefix(crowd, sets, percent)).distinct()


def _counts(own: DataFrame) -> np.ndarray:
    """How often the shingles of each of COUNTERS classes stand in own's sets, gathered as at most COUNTERS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b"".join(b.column(0).to_pylist())
            slots, n = np.unique(np.frombuffer(raw, np.uint64) % np.uint64(COUNTERS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(n)], names=["slot", "n"])

    found = own.select("shingles").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.uint32)
    out[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), (1 << 32) - 1)
    return out


def _by_prefix(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of crowd's nodes in different components that prefix filtering can't rule out.

    Any one order of the shingles is exact; a fixed number of counters makes it one with the rarest first.
    """

    own = written(sets.join(crowd, "node").select("node", "component", "n", "shingles"), "crowd")
    counts = own.sparkSession.sparkContext.broadcast(_counts(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = counts.value
        for batch in batches:
            for node, component, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                shingles = np.frombuffer(raw.as_buffer(), np.uint64)
                often = sketch[shingles % np.uint64(COUNTERS)]
                order = np.lexsort((shingles, often))[: n - -(-n * percent // 100) + 1]
                # what only one node has can't be shared, but takes its place in the order
                rank = np.flatnonzero(often[order] > 1)
                early = shingles[order[rank]].view(np.int64)
                before = [early[max(0, i - EARLIER) : i] for i in range(len(early))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(early), v)) for v in (node, component, n)] + [pa.array(rank), pa.array(early), pa.array(before, pa.list_(pa.int64()))],
                    names=["node", "component", "n", "rank", "shingle", "before"],
                )

    placed = own.mapInArrow(run, "node long, component long, n long, rank long, shingle long, before array<long>")
    placed = written(placed, "early").withColumn("index", F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)))
    several = placed.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle")
    placed = written(placed.join(several, "shingle"), "prefixes")
    x = placed.select("shingle", *(F.col(c).alias(c + "a") for c in ("node", "component", "n", "rank", "before")))
    y = placed.where("rank <= index").select("shingle", *(F.col(c).alias(c + "b") for c in ("node", "component", "n", "rank", "before")))
    larger = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("nodea") > F.col("nodeb")))
    fits = F.col("nb") * 100 >= F.col("na") * percent
    enough = F.least(F.col("na") - F.col("ranka"), F.col("nb") - F.col("rankb")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    return x.join(y, "shingle").where(larger & fits & enough & (F.col("componenta") != F.col("componentb")) & ~F.arrays_overlap("beforea", "beforeb")).select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b"))


def _classes(docs: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """(doc_id, row, n, class): the component of each row of docs, null for an empty set."""
    rows = written(signatures(docs, k), "signatures")
    full = rows.where("n > 0")
    banded = full.select("node", F.explode("bands").alias("band"))
    several = banded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("band")
    buckets = written(banded.join(several, "band").distinct(), "buckets")
    # the node that meets most others is likely near what a bucket's nodes have in common
    met = buckets.join(buckets.groupBy("band").agg(F.count("*").alias("size")), "band").groupBy("node").agg(F.sum("size").alias("met"))
    centres = buckets.join(met, "node").groupBy("band").agg(F.max(F.struct("met", "node"))["node"].alias("centre"))
    held = written(buckets.join(centres, "band"), "held")
    active = written(held.select("node").distinct(), "active")
    # min() of a struct keeps one row a node; repeated rows of a node are equal
    sigs = written(full.select("node", "n", "signature").join(active, "node", "left_semi").dropDuplicates(["node"]), "candidates")
    sets = written(_full_sets(docs, active, k), "sets")

    def links(pairs: DataFrame) -> DataFrame:
        return written(_linked(_plausible(pairs, sigs, percent, miss), sets, percent), "links")

    first = links(held.where("node <> centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct())
    labels = connected_components(first, "a", "b")
    more = links(_across(held.select("band", "node"), labels, sigs.select("node", "n"), sets, percent))
    if more.head(1):
        labels = connected_components(first.union(more), "a", "b")
    return rows.join(labels, "node", "left").select("doc_id", "row", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("class"))


def _with_first(members: DataFrame) -> DataFrame:
    """members with the class's first (doc_id, row). Both sides of the join are shuffles of written tables, so that a class
    with many rows can be split among tasks when the plan is adapted."""
    members = written(members, "members")
    # doc_id and row as one number, which hash aggregation can take the least of
    place = F.coalesce("doc_id", F.lit((1 << 63) - 1)).cast("decimal(19,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + F.col("row").cast("decimal(19,0)")
    members = members.withColumn("place", place.cast("decimal(38,0)"))
    first = written(members.where("class is not null").groupBy("class").agg(F.min("place").alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("size")).where("size > 1").drop("size"), "firsts")
    return members.join(first, "class", "left")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; kept is true for the smallest id of a component."""
    out = _with_first(_classes(docs, k, percent, miss)).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs, same columns, with one row of each near-duplicate component: that of smallest id, the first as read on a tie."""
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    gone = _with_first(_classes(numbered, k, percent, MISS)).where("place <> first").select(F.col("row").alias("__gone"))
    return numbered.join(gone, F.col("__row") == F.col("__gone"), "left_anti").select(docs.columns)
