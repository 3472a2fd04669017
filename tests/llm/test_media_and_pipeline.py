import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import audio, decontaminate, mixing, neardup, queries, toxicity, warc

SF = "/root/testdata/sf0.001"


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 600)
    rnd = random.Random(1)
    html = ["<p>é</p>" * k for k in range(5)] + [None]
    rows = [(i, f"http://x/{i}\r\nEvil: y" if i % 9 == 0 else (None if i == 5 else f"http://x/{i}"), rnd.choice(html) if i % 2 else f"<b>{i}</b>") for i in range(120)]
    rows += [(None, "u", "<p>é</p>"), (None, "u", "only mine"), (119, rows[119][1], rows[119][2]), (7, "other", "second page of id 7")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("own"))
    for least in (0, 9):
        best = {}
        for p, _, h in rows:
            if p is not None:
                best[h or ""] = max(best.get(h or "", -1), p)
        want = []
        for p, _, h in rows:
            raw = (h or "").encode()
            to = best.get(h or "")
            revisit = len(raw) >= least and to is not None and (p is None or p < to)
            want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
        assert sorted(map(tuple, warc.round_trip(pages, least).collect()), key=str) == sorted(want, key=str)
    index, folder = warc.write(pages)
    chosen = index.where("page_id in (1, 2, 60)")
    got = {r.page_id: r for r in warc.read(chosen, folder).collect()}
    assert set(got) == {1, 2, 60} and got[2].payload.decode() == "<b>2</b>" and got[60].payload_bytes == len("<b>60</b>")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reads_in_parts_and_names_only_whole_attempts(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 14)
    monkeypatch.setattr(warc, "TASK_BYTES", 1 << 12)
    rnd = random.Random(2)
    pages = spark.createDataFrame([(i, "u", "".join(rnd.choice("abcdefgh") for _ in range(2000))) for i in range(60)], "page_id long, url string, html string")
    index, folder = warc.write(pages)
    back = warc.read(index, folder)
    assert back.rdd.getNumPartitions() > 4
    assert {r.page_id: r.payload.decode() for r in back.collect()} == {r.page_id: r.html for r in pages.collect()}
    names = {p.name for p in __import__("pathlib").Path(folder.removeprefix("file://")).iterdir() if not p.name.startswith(".")}
    assert names == {r.file for r in index.select("file").distinct().collect()}

    def broken(batches):
        run = warc._writer(folder, True)
        yield from run(batches)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        pages.limit(3).mapInArrow(broken, warc.INDEX).collect()


def test_warc_finds_damage():
    member = warc.record(1, "http://x", warc.digest32(b"abc"), 3, b"abc", None)
    fields, payload = warc.parse(member)
    assert payload == b"abc" and fields["WARC-Type"] == "response"
    with pytest.raises(ValueError):
        warc.parse(zlib.compress(b"nothing", wbits=31))


def test_audio_round_trip(spark):
    rows = [(1, None), (2, ""), (3, "x" * 192), (4, "é" * 100), (5, "é" * 100), (6, "ab " * 40_000), (7, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("feature", F.lit(1))
    got = {r.doc_id: r for r in audio.describe(docs).collect()}
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = audio.encode_wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[4].feature == got[5].feature and got[1].feature == got[2].feature != got[3].feature
    media, kept = audio.store(docs)
    assert {r.doc_id: bytes(r.media) for r in media.collect()} == {d: audio.encode_wav(audio.padded((t or "").encode())) for d, t in rows}
    for r in kept.collect():
        mel = audio.features(audio.encode_wav(audio.padded((dict(rows)[r.doc_id] or "").encode()))).mel
        joined = np.concatenate([audio.read_tensor(bytes(x.tensor))[: x.n_frames] for x in r.tensors])
        assert np.array_equal(joined, mel.astype(np.float16)) and r.tensors[0].start_s == 0 and all(a.end_s > b.start_s for a, b in zip(r.tensors, r.tensors[1:]))
    assert audio.describe(docs.limit(0)).count() == 0


def plain_features(payload):
    """Frames x bands and segments by the definition, sample by sample."""
    x = [(b - 128) / 128 for b in payload]
    n, up, down, taps = len(x), 3, 4, 8
    h = np.array([np.sinc((m - taps * up) / down) * (0.5 - 0.5 * np.cos(2 * np.pi * m / (2 * taps * up))) for m in range(2 * taps * up)])
    y = []
    for m in range(-(-n * up // down)):
        at, phase = m * down // up, m * down % up
        own = h[phase::up] / h[phase::up].sum()
        y.append(sum(own[k] * x[at + taps - k] for k in range(2 * taps) if 0 <= at + taps - k < n))
    frame, hop, bands, rate = 256, 128, 24, 6000
    count = 1 if len(y) <= frame else 1 + -(-(len(y) - frame) // hop)
    y = np.array(y + [0.0] * ((count - 1) * hop + frame - len(y)))
    mel = np.empty((count, bands))
    levels = []
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edge = [hz(top * i / (bands + 1)) for i in range(bands + 2)]
    for i in range(count):
        w = y[i * hop : i * hop + frame] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame))
        power = [abs(sum(w * np.exp(-2j * np.pi * k * np.arange(frame) / frame))) ** 2 for k in range(frame // 2 + 1)]
        for b in range(bands):
            lo, mid, hi = edge[b : b + 3]
            f = [k * rate / frame for k in range(frame // 2 + 1)]
            mel[i, b] = np.log(sum(p * max(0, min((v - lo) / (mid - lo), (hi - v) / (hi - mid))) for p, v in zip(power, f)) + 1e-6)
        levels.append(10 * np.log10((w**2).mean() + 1e-10))
    middle, on, spans = float(np.median(levels)), False, []
    for i, v in enumerate([*levels, -1e9]):
        if not on and v - middle >= 1.0:
            on = True
            spans.append([i * hop / rate, None])
        elif on and v - middle <= -0.5:
            on = False
            spans[-1][1] = i * hop / rate
    return mel, spans


def test_audio_features_match_the_definition(spark):
    rnd = random.Random(4)
    texts = ["x", "loud ZZZ " * 30 + "....." * 60 + "~~~~ éé" * 20, "".join(rnd.choice("abc \n~É") for _ in range(1500)), "y" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.feature for r in audio.describe(docs).collect()}
    for i, t in enumerate(texts):
        payload = audio.padded(t.encode())
        mel, spans = plain_features(payload)
        f = audio.features(audio.encode_wav(payload))
        assert np.allclose(f.mel, mel, atol=1e-6) and np.allclose(np.array(f.spans).reshape(-1), np.array(spans).reshape(-1))
        said = dict(x.split("=") for x in got[i].split(";"))
        assert int(said["frames"]) == len(mel) and int(said["segments"]) == len(spans)
        assert np.allclose([float(v) for v in said["mel"].split(",")], mel.mean(0), atol=0.01)
        changed = audio.features(audio.encode_wav(payload[:-24] + bytes(b ^ 3 for b in payload[-24:]))).mel
        assert changed.shape == f.mel.shape and not np.allclose(changed[-1], f.mel[-1])


def test_features_do_not_depend_on_summation_order():
    """Quiet bands stay at the floor however the linear algebra of a machine adds."""
    media = audio.encode_wav(audio.padded(b"ab " * 4_000))
    ref = audio.features(media).mel
    power_order = np.random.default_rng(3).permutation(audio.FRAME // 2 + 1)
    _, samples = audio.decode_wav(media)
    y = np.concatenate(list(audio.resample(np.frombuffer(samples, np.uint8))))
    y = np.concatenate([y, np.zeros((len(ref) - 1) * audio.HOP + audio.FRAME - len(y))])
    frames = np.lib.stride_tricks.sliding_window_view(y, audio.FRAME)[:: audio.HOP] * audio._WINDOW
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    assert np.allclose(np.log(power[:, power_order] @ audio._MEL[power_order] + 1e-6), ref, rtol=0, atol=1e-9)


def test_resampling_is_the_direct_convolution():
    x = np.random.default_rng(2).integers(0, 256, 4000, dtype=np.uint8)
    y = np.concatenate(list(audio.resample(x)))
    s = (x.astype(float) - 128) / 128
    for m in range(0, len(y), 37):
        at, phase = m * audio.DOWN // audio.UP, (m * audio.DOWN) % audio.UP
        want = sum(audio._PHASES[phase][k] * s[j] for k in range(2 * audio.TAPS) if 0 <= (j := at + audio.TAPS - k) < len(s))
        assert abs(y[m] - want) < 1e-5


def test_hysteresis():
    levels = np.array([0, 0, 2, 0.5, 0, -1, 0.5, 3, 0, 0, 0], float)
    step = audio.HOP / audio.OUT_RATE
    assert np.allclose(audio.segments(levels), [(2 * step, 5 * step), (7 * step, 11 * step)])


def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    from .test_text_operators import brute_hits, brute_near, distance, near_limit

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    keep = {r.doc_id for r in toxicity.score(docs, labels).collect() if not r.predicted}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in keep)
    # equal lines of any length but 0, and near ones by their length
    places = [(d, j, line.strip(" \t\r").lower()) for d, t in rows for j, line in enumerate(t.split("\n"))]
    places = [p for p in places if p[2]]
    kinds = sorted({p[2] for p in places})
    root = {k: k for k in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    long = sorted((x for x in kinds if len(x) >= 16), key=len)
    counts = np.array([[x.count(c) for c in "abcdefghijklmnopqrstuvwxyz .,"] for x in long])
    sizes = np.array([len(x) for x in long])
    for i, x in enumerate(long):
        most = near_limit(len(x))
        top = int(np.searchsorted(sizes, len(x) + most, "right"))
        for k in np.flatnonzero(np.abs(counts[i + 1 : top] - counts[i]).sum(1) <= 2 * most):
            if distance(x, long[i + 1 + k]) <= most:
                root[find(x)] = find(long[i + 1 + k])
    first, gone = {}, {}
    for d, j, line in places:
        if first.setdefault(find(line), (d, j)) != (d, j):
            gone.setdefault(d, set()).add(j)
    rows = [(d, "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone.get(d, ()))) for d, t in rows if d not in gone or "".join(x for j, x in enumerate(t.split("\n")) if j not in gone[d]).strip(" ")]
    kept = {r[0] for r in brute_near(rows, 5, 80) if r[3]}
    rows = [(d, t) for d, t in rows if d in kept and not brute_hits(t, items)[1]]
    now = docs
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == columns, name
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert sorted((r.doc_id, r.text) for r in now.collect()) == rows
    want = sorted(map(tuple, mixing.mix(now).collect()))
    assert sorted(map(tuple, P.run(spark, SF).collect())) == want and want
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and ids, extra columns with the names that stages use inside, and empty tables."""
    import corpus_pipeline as P

    extra = ("row", "node", "component", "class", "line", "id", "key", "h", "epoch", "block", "place", "first", "hits", "score", "n")
    long, leak = " ".join(f"w{i}" for i in range(60)), "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, long, "en", "a", 5), (1, long, "en", "a", 5), (None, None, None, None, None), (2, "", "en", "b", 0), (3, "one line\nanother line", "en", "b", 21), (4, "x " + leak + " y", "en", "c", 60), (5, "z " * 50_000, "en", "c", 100_000), (3, "other text of three", "en", None, 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in extra})
    spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for first in (docs, docs.limit(0)):
        now = first
        for name, stage in P.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns, name
            path = str(tmp_path / f"{name}-{first is docs}")
            now.write.parquet(path)
            now = spark.read.parquet(path)
        left = sorted(((r.doc_id, r.text) for r in now.collect()), key=str)
        # the second row of id 1 has only lines of the first, and the empty text no word
        assert left == (sorted([(1, long), (None, None), (2, ""), (3, rows[4][1]), (5, rows[6][1]), (3, rows[7][1])], key=str) if first is docs else [])
        assert P.STAGES[-1][1](spark, now, str(tmp_path)).count() == 0 or first is docs


@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_toxicity", "op4_mixing", "op5_license_scan", "op8_token_counts", "op9_minhash", "op10_audio"])
def test_queries_of_empty_tables_and_clashing_columns(spark, tmp_path, name):
    extra = {c: F.lit(c) for c in ("row", "id", "key", "section", "media", "feature", "label", "anchor", "score", "class", "h")}
    docs = spark.createDataFrame([(1, "All rights reserved.\nA line of its own", "s"), (2, None, None), (2, None, None)], "doc_id long, text string, source string").withColumns(extra)
    for part, rows in (("some", docs), ("none", docs.limit(0))):
        rows.write.parquet(str(tmp_path / part / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / part / "labels.parquet"))
    some, none = (queries.queries()[name](spark, str(tmp_path / part)) for part in ("some", "none"))
    assert none.count() == 0 and some.dtypes == none.dtypes and some.where("doc_id = 1").count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    import duckdb

    from tools.verify import TABLES, digest

    df = queries.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert digest(rows, df.columns) == digest(found.fetchall(), names)


def test_names(spark):
    own = [n for n in queries.queries() if n.startswith("op")]
    assert own == sorted(own, key=lambda n: int(n[2:].split("_")[0])) and len(own) == 10
    assert decontaminate.SIZE == 10 and neardup.HASHES == 125
