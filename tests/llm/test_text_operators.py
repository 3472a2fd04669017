import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wakeline.llm import chat, decontaminate, licenses, linededup, mixing, neardup, queries, tokens, toxicity
from wakeline.llm import words as Wd

DOCS = "doc_id long, text string"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
NASTY = [(900, None), (901, ""), (902, "   \n\t"), (903, "É" * 50), (904, "x " * 20_000), (905, "tie"), (906, "tie"), (906, "tie")]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def rnd_text(rnd, n, words=None):
    words = words or [f"w{i}" for i in range(40)] + ["É", "ß9"]
    return "".join(rnd.choice(words).title() + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(n))


@pytest.mark.parametrize(("table", "pattern"), [(Wd.ALNUM, ALNUM), (Wd.NONSPACE, SPACE)])
def test_words_match_the_pattern(table, pattern):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aZ9 -\n\x0bé中_'") for _ in range(rnd.randrange(30))) for _ in range(300)] + ["", "ab", "ab"]
    got, codes = [], {}
    for c in Wd.chunks(pa.array(texts, pa.large_string()), table, 200):
        h = Wd.hashes(c.data, c.starts, c.ends)
        for r in range(c.rows):
            own = range(c.row_words[r], c.row_words[r + 1])
            got.append([c.word(i).decode() for i in own])
            for i in own:
                assert codes.setdefault(c.word(i), int(h[i])) == int(h[i])
    assert got == [pattern.findall(lower(t)) for t in texts]
    assert len(set(codes.values())) == len(codes)


def test_hash_of_very_long_words():
    a = np.frombuffer(b"x" * (1 << 21) + b" " + b"x" * (1 << 21) + b" ab", np.uint8)
    n = 1 << 21
    h = Wd.hashes(a, np.array([0, n + 1, 2 * n + 2]), np.array([n, 2 * n + 1, 2 * n + 4]))
    assert h[0] == h[1] != h[2]


def brute_hits(text, items, size=10):
    w = ALNUM.findall(lower(text))
    hit, met = set(), set()
    for item, t in items:
        v = ALNUM.findall(lower(t))
        n = min(size, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n and item is not None else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                met.add(str(item))
    return len(w), len(hit), met


@pytest.fixture(scope="module")
def leaked(spark):
    rnd = random.Random(3)
    items = [(i, rnd_text(rnd, rnd.randrange(1, 30))) for i in range(12)] + [(None, rnd_text(rnd, 15)), (40, None), (41, "..."), (3, "only THREE words")]
    rows = []
    for i in range(60):
        t = rnd_text(rnd, rnd.randrange(60))
        if i % 3 == 0:
            t += " " + lower(items[i % 12][1]).upper() + " " + rnd_text(rnd, 5)
        rows.append((i, t))
    rows += [*NASTY, (None, "Only, three words!")]
    return rows, items


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_decontamination_report(spark, leaked, most):
    rows, items = leaked
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.report(docs_of(spark, rows), bench, most=most).collect()), key=str)
    want = []
    for d, t in rows:
        n, hit, met = brute_hits(t, items)
        want.append((d, n, hit, len(met), decontaminate.items_digest(met), hit > 0))
    assert got == sorted(want, key=str)


def test_decontamination_removes(spark, leaked):
    rows, items = leaked
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, rows).withColumn("n_hit", F.lit("own column")).withColumn("n_chars", F.length("text").cast("long"))
    clean = {(d, t) for d, t in rows if not brute_hits(t, items)[1]}
    for most in (1 << 20, 0):
        kept = decontaminate.decontaminate(docs, bench, most=most)
        assert kept.columns == docs.columns and {(r.doc_id, r.text) for r in kept.collect()} == clean
    cut = decontaminate.decontaminate(docs, bench, remove="spans").collect()
    by = dict(rows)
    for r in cut:
        assert r.n_hit == "own column"
        if r.doc_id is not None and by[r.doc_id] != r.text:
            assert r.n_chars == len(r.text) and len(ALNUM.findall(r.text)) == brute_hits(by[r.doc_id], items)[0] - brute_hits(by[r.doc_id], items)[1]
    joined = decontaminate.decontaminate(docs, bench, remove="spans", most=0)
    assert joined.columns == docs.columns and sorted(map(str, joined.collect())) == sorted(map(str, cut))
    empty = docs.limit(0)
    assert decontaminate.report(empty, bench).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_broadcast_benchmark_is_compact():
    import tracemalloc

    rnd = random.Random(17)
    items = [(i, " ".join(rnd.choice("aeiou") + str(rnd.randrange(10**5)) for _ in range(2000))) for i in range(80)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    windows = decontaminate._item_windows(items, 10)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sum(len(k) for k, _, _ in windows.by_length.values()) > 150_000 and held < 12 * size


def test_one_of_two_rows_of_a_doc_id_is_removed(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    docs = docs_of(spark, [(None, "one two three four five six seven eight nine ten"), (None, "clean"), (1, "clean too"), (1, "x one two three four five six seven eight nine ten")])
    for most in (1 << 20, 0):
        assert {r.text for r in decontaminate.decontaminate(docs, bench, most=most).collect()} == {"clean", "clean too"}


def brute_near(rows, k, percent):
    sets = []
    for _, t in rows:
        w = SPACE.findall(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min(least[find(i)]), d == min(least[find(i)])) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "percent", "small"), [(3, 85, 16), (5, 80, 16), (3, 85, 2)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, k, percent, small):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    bases = [[rnd.choice(words) for _ in range(rnd.randrange(20, 120))] for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(bases[i % 6 if i < 70 else 0])
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 6, 12])):
            w[rnd.randrange(len(w))] = rnd.choice(words).upper()
        rows.append((i, rnd.choice([" ", "\n"]).join(w)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "Two words"), (204, "two WORDS"), (205, "z " * 3000)]
    docs = docs_of(spark, rows).withColumn("node", F.lit(1)).withColumn("component_id", F.lit("x"))
    assert sorted(map(tuple, neardup.near_duplicates(docs, k, percent).collect())) == brute_near(rows, k, percent)
    kept = neardup.without_near_duplicates(docs, k, percent)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in brute_near(rows, k, percent) if r[3]}


def test_near_duplicates_are_removed_row_by_row(spark):
    long, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(3, long), (3, other), (2, long + " end"), (7, "alone here"), (7, "alone here"), (None, other), (None, None), (None, None), (8, "clean of 8"), (8, long)]
    docs = docs_of(spark, rows).withColumn("row", F.lit(1)).withColumn("place", F.lit("x")).withColumn("class", F.lit(2.0))
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, other), (2, long + " end"), (7, "alone here"), (None, None), (None, None), (8, "clean of 8")], key=str)
    assert neardup.without_near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(docs_of(spark, []), 3, 85).count() == 0
    assert neardup.least_matches(85, 1e-5)[-1] < 0.85 * neardup.HASHES


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(rnd, s, n):
    b = list(s)
    for _ in range(n):
        i, k = rnd.randrange(len(b)), rnd.random()
        if k < 0.4:
            b[i] = rnd.choice("abcdé")
        elif k < 0.7:
            b.insert(i, "z")
        else:
            b.pop(i)
    return "".join(b)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rnd = random.Random(6)
    rows = []
    for _ in range(300):
        a = "".join(rnd.choice("abcdé") for _ in range(rnd.randint(8, 30)))
        rows.append((a, edited(rnd, a, rnd.randint(0, 5))))
    df = spark.createDataFrame([(list(a), list(b)) for a, b in rows if abs(len(a) - len(b)) <= edits], "x array<string>, y array<string>")
    for r in df.select("x", "y", linededup.banded_distance(F.col("x"), F.col("y"), edits).alias("d")).collect():
        want = distance(r.x, r.y)
        assert (r.d <= edits) == (want <= edits) and (want > edits or r.d == want)


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup_matches_brute_force(spark, edits):
    rnd = random.Random(8)
    lines = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(14, 24))) for _ in range(25)]
    rows = [(i, "\n".join(edited(rnd, rnd.choice(lines), rnd.randint(0, 2)) for _ in range(rnd.randint(1, 5)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "A" * 30), (104, " " + "a" * 30 + "\t"), (105, "b" * 5000)]
    norm = [(d, j, line.strip(" \t\r").lower()) for d, t in rows for j, line in enumerate((t or "").split("\n"))]
    norm = [x for x in norm if len(x[2]) >= linededup.LEAST]
    kinds = sorted({x[2] for x in norm})
    root = {x: x for x in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(kinds):
        for y in kinds[:i]:
            if abs(len(x) - len(y)) <= edits and distance(x, y) <= edits:
                root[find(x)] = find(y)
    first, gone = {}, {}
    for d, j, line in sorted(norm):
        if first.setdefault(find(line), (d, j)) != (d, j):
            gone.setdefault(d, []).append(j)
    docs = docs_of(spark, rows).withColumn("first", F.lit(1)).withColumn("at", F.lit("x"))
    got = {r.doc_id: r for r in linededup.report(docs, edits).collect()}
    assert {d: r.dropped for d, r in got.items()} == {d: ",".join(map(str, sorted(gone.get(d, [])))) for d, _ in rows}
    assert all(got[d].n_lines == (t or "").count("\n") + 1 for d, t in rows)
    kept = linededup.without_repeated_lines(docs, edits)
    assert kept.columns == docs.columns
    want = {}
    for d, t in rows:
        left = [x for j, x in enumerate((t or "").split("\n")) if j not in gone.get(d, [])]
        if d not in gone:
            want[d] = t
        elif "".join(left).strip(" "):
            want[d] = "\n".join(left)
    assert {r.doc_id: r.text for r in kept.collect()} == want
    assert linededup.report(docs.limit(0)).count() == 0


def near_limit(n):
    """Edits that a line of n characters may be apart from one as long or longer."""
    return 1 if n < 40 else 2 if n < 64 else 3 if n < 80 else 4 if n < 112 else 5


def test_line_dedup_allows_more_edits_in_longer_lines(spark):
    rnd = random.Random(9)
    bases = ["".join(rnd.choice("abcdeé ") for _ in range(n)).strip() + "." for n in (15, 17, 30, 38, 41, 57, 63, 66, 78, 81, 95, 110, 113, 127, 130, 160, 400) for _ in range(2)]
    kinds = sorted({x for b in bases for i in range(12) for x in [edited(rnd, b, i // 2)] if len(x) >= linededup.LEAST and x == x.strip()})
    want = {frozenset((x, y)) for i, x in enumerate(kinds) for y in kinds[:i] if abs(len(x) - len(y)) <= 5 and distance(x, y) <= near_limit(min(len(x), len(y)))}
    assert {distance(*p) for p in want} == {1, 2, 3, 4, 5}
    own = spark.createDataFrame(list(enumerate(kinds)), "id long, line string")
    got = [frozenset((kinds[r.a], kinds[r.b])) for r in linededup.near_pairs(own, None, linededup.LEAST).collect()]
    assert set(got) == want and len(got) == len(want)
    words = "the committee will publish its full report on the state of the harbour before the end of the coming winter season"
    docs = docs_of(spark, [(1, words), (2, words.replace("state", "shape")), (3, words[:30]), (4, words[:28] + "xy")])
    assert {r.doc_id: r.dropped for r in linededup.report(docs).collect()} == {1: "", 2: "0", 3: "", 4: ""}


def linked(pairs, kinds):
    root = {x: x for x in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        root[find(x)] = find(y)
    groups = {}
    for x in kinds:
        groups.setdefault(find(x), set()).add(x)
    return sorted(sorted(g) for g in groups.values())


def test_crowded_line_buckets_link_all_that_is_near(spark, monkeypatch):
    """Buckets of more than two lines go by centres and parts; the classes stay those of all pairs."""
    monkeypatch.setattr(linededup, "SMALL", 2)
    rnd = random.Random(23)
    kinds = set()
    for n in (16, 24, 45, 70, 120):
        head = "".join(rnd.choice("abcdefgh ") for _ in range(n)).strip() + "."
        for _ in range(14):  # lines that share a part with many, and some of them near each other
            tail = "".join(rnd.choice("0123456789") for _ in range(n // 2))
            for line in (head + tail, tail + head, head[: n // 2] + tail + head[n // 2 :]):
                kinds |= {line, edited(rnd, line, rnd.randint(1, 5))}
    kinds = sorted(x for x in kinds if len(x) >= linededup.LEAST and x == x.strip())
    want = [(x, y) for i, x in enumerate(kinds) for y in kinds[:i] if abs(len(x) - len(y)) <= 5 and distance(x, y) <= near_limit(min(len(x), len(y)))]
    own = spark.createDataFrame(list(enumerate(kinds)), "id long, line string")
    got = [(kinds[r.a], kinds[r.b]) for r in linededup.near_pairs(own, None, linededup.LEAST).collect()]
    assert {frozenset(p) for p in got} <= {frozenset(p) for p in want}
    assert linked(got, kinds) == linked(want, kinds) and len(linked(want, kinds)) < len(kinds)


@pytest.mark.parametrize(("small", "a_line"), [(16, 40), (linededup.SMALL, 40)])
def test_numbered_lines_make_candidates_in_proportion(spark, monkeypatch, small, a_line):
    """The pairs that a line makes depend on SMALL, not on how many lines share a part once these are more than SMALL."""
    monkeypatch.setattr(linededup, "SMALL", small)
    made = []
    held = linededup._candidates

    def counted(*args):
        found = held(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(linededup, "_candidates", counted)
    totals = []
    for n in (500, 2000):
        made.clear()
        rows = [(i, f"entry of the ledger no. {i * 7919:012d}") for i in range(n)]
        got = linededup.near_pairs(spark.createDataFrame(rows, "id long, line string"), None, linededup.LEAST).collect()
        assert all(distance(rows[r.a][1], rows[r.b][1]) == 1 for r in got)
        totals.append(sum(made))
    assert totals[1] < a_line * 2000 and (small > 500 or totals[1] < 6 * totals[0] + 2000)


def test_letters_before_and_after_a_place_lose_no_near_lines(spark, monkeypatch):
    """Every bucket counts as crowded; the pairs stay all that are near, each of them once."""
    monkeypatch.setattr(linededup, "CROWD", 1)
    rnd = random.Random(31)
    bases = ["".join(rnd.choice("etaoin shré") for _ in range(n)).strip() + "." for n in (18, 41, 66, 83, 113, 127, 129, 250) for _ in range(2)]
    kinds = sorted({x for b in bases for i in range(14) for x in [edited(rnd, b, i // 2)] if len(x) >= linededup.LEAST and x == x.strip()})
    want = {frozenset((x, y)) for i, x in enumerate(kinds) for y in kinds[:i] if abs(len(x) - len(y)) <= 5 and distance(x, y) <= near_limit(min(len(x), len(y)))}
    got = [frozenset((kinds[r.a], kinds[r.b])) for r in linededup.near_pairs(spark.createDataFrame(list(enumerate(kinds)), "id long, line string"), None, linededup.LEAST).collect()]
    assert set(got) == want and len(got) == len(want)


def test_lines_of_the_same_letters_in_other_places_make_few_candidates(spark, monkeypatch):
    """Copies of a line in each of which two words are exchanged: not near, and told apart without being compared in full."""
    words = "the committee will publish its longest report on the state of every harbour before winter ends and after the session of the council has closed its books for good".split()
    made, held = [], linededup._candidates

    def counted(*args):
        made.append(held(*args).count())
        return held(*args)

    monkeypatch.setattr(linededup, "_candidates", counted)
    lines = []
    for i in range(12):
        for j in range(16, len(words) - 1):
            if len(words[i]) > 3 < len(words[j]):
                w = list(words)
                w[i], w[j] = w[j], w[i]
                lines.append(" ".join(w))
    rows = sorted(set(lines))
    want = {frozenset((x, y)) for i, x in enumerate(rows) for y in rows[:i] if distance(x, y) <= near_limit(min(len(x), len(y)))}
    got = [frozenset((rows[r.a], rows[r.b])) for r in linededup.near_pairs(spark.createDataFrame(list(enumerate(rows)), "id long, line string"), None, linededup.LEAST).collect()]
    assert set(got) == want and len(got) == len(want)
    assert len(rows) > 30 and sum(made) < len(rows) * (len(rows) - 1) // 6


def test_registered_line_dedup_drops_equal_short_lines(spark, tmp_path):
    docs_of(spark, [(1, "Yes\n\nNo\n\nyet"), (2, " yes\nno!\nx"), (3, "X\n\nYES")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["op2_line_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.dropped for r in got} == {1: "", 2: "0", 3: "0,2"}


def test_toxicity_learns_and_scores_every_row(spark):
    rnd = random.Random(11)
    syllables = ["ta", "no", "ri", "el", "mu", "so", "ka", "vi"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    bad = ["grumblor", "stinkfap", "wretchim"]
    rows, labels = [], []
    for i in range(500):
        y = i % 4 == 0
        rows.append((i, " ".join(rnd.choice(bad) if y and rnd.random() < 0.1 else word() for _ in range(rnd.randint(15, 80)))))
        labels.append((i, 0, int(y)))
    labels += [(7000, 1, None), (None, 0, 1)]
    docs = docs_of(spark, [*rows, *NASTY, (None, "x")]).withColumn("score", F.lit("own")).withColumn("toxic", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, lab).collect()
    assert len(out) == len(rows) + len(NASTY) + 1
    by = {r.doc_id: r for r in out}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [(by[i].predicted, y) for i, _, y in labels[:500] if by[i].held_out]
    assert sum(p == y for p, y in held) >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert by[900].score == by[901].score == by[902].score
    kept = toxicity.without_toxic(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in out)
    alone = toxicity.score(docs, lab.where("toxic = 0")).collect()
    assert {r.score for r in alone} == {0.0}
    assert toxicity.score(docs.limit(0), lab).count() == 0


def test_mixing_meets_weights_and_budget(spark):
    rnd = random.Random(12)
    sizes = {"big": 400, "mid": 80, "rare": 20, None: 5}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, "w " * rnd.randint(5, 40), s, "x"))
            i += 1
    rows += [(5000, None, "void", "x"), (5001, "", "big", "x"), (5001, "", "big", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block string")
    out = mixing.mix(docs, entropy=0.9, repeats=3.0, block_tokens=1000).collect()
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    own = {}
    for _, t, s, _ in rows:
        own[s or ""] = own.get(s or "", 0) + len((t or "").split())
    own = {s: n for s, n in own.items() if n}
    measure = mixing.local_measure([own[s] / total for s in sorted(own)], 1.0)
    alpha = mixing.temperature(measure, len(own), 0.9, 3.0)
    z = sum((n / total) ** alpha for n in own.values())
    drawn = {}
    for r in out:
        drawn.setdefault(r.source, []).append(r)
    assert set(drawn) == set(own)
    for s, n in own.items():
        quota = (n / total) ** alpha / z * total
        got = sum(r.n_tokens for r in drawn[s])
        assert quota <= got + 1e-6 and got < quota + 41
        assert got / n <= 3.0 + 41 / n
        seen = {}
        for r in drawn[s]:
            seen.setdefault(r.epoch, []).append(r.doc_id)
        for e in range(max(seen)):  # every epoch but the last deals each document
            assert sorted(seen[e]) == sorted(d for d, _, x, _ in rows if (x or "") == s)
    blocks = {}
    for r in out:
        blocks.setdefault(r.block, []).append(r)
    for b in blocks.values():
        assert sorted(r.slot for r in b) == list(range(len(b)))
        assert sum(r.n_tokens for r in b) < total / len(blocks) + 41 * len(own)
    again = mixing.mix(docs.repartition(7), entropy=0.9, repeats=3.0, block_tokens=1000).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mix(docs.where("text = ''")).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_temperature_bisection():
    shares = [0.7, 0.2, 0.1]
    m = mixing.local_measure(shares, 1.0)
    a = mixing.temperature(m, 3, 0.9, 100.0)
    assert abs(m(a).entropy - 0.9 * np.log(3)) < 1e-6
    b = mixing.temperature(m, 3, 1.0, 2.0)
    assert abs(m(b).repeats - 2.0) < 1e-6
    assert mixing.temperature(m, 3, 0.0, 100.0) == 1.0 and mixing.temperature(m, 1, 1.0, 1.0) == 1.0


def test_mixing_temperature_matches_a_grid(spark):
    """alpha by a fine grid over plain definitions, and quotas from it."""
    rows = [(i, "w " * (1 + i % 9), s) for s, n in (("a", 300), ("b", 60), ("c", 9)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    total = sum(size.values())
    for entropy, repeats in ((0.8, 100.0), (0.95, 4.0), (0.0, 100.0)):
        best = None
        for k in range(4001):
            alpha = k / 4000
            z = sum((n / total) ** alpha for n in size.values())
            p = {s: (n / total) ** alpha / z for s, n in size.items()}
            if -sum(x * np.log(x) for x in p.values()) >= entropy * np.log(3) - 1e-9:
                best = alpha
        while max((size[s] / total) ** best / sum((n / total) ** best for n in size.values()) * total / size[s] for s in size) > repeats:
            best += 1 / 4000
        z = sum((n / total) ** best for n in size.values())
        drawn = {}
        for r in mixing.mix(docs, entropy=entropy, repeats=repeats).collect():
            drawn[r.source] = drawn.get(r.source, 0) + r.n_tokens
        for s, n in size.items():
            assert abs(drawn[s] - (n / total) ** best / z * total) < 10 + 0.005 * total


def test_mixing_refuses_a_limit_that_cannot_be_kept(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(12)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="16.67 times"):
        mixing.mix(docs, budget=2000, repeats=4)
    assert mixing.mix(docs, budget=480, repeats=4).count() == 48


def test_mixing_of_many_sources_is_measured_by_spark(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 9 if i % 2 else 0}") for i in range(300)], "doc_id long, text string, source string")
    one = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    monkeypatch.setattr(mixing, "STEPS", 25)
    assert len(one) == pytest.approx(mixing.mix(docs).count(), abs=3)


def test_license_scan(spark):
    rnd = random.Random(13)
    phrases = ["under the MIT license", "Apache License, Version 2", "CC BY-NC"]
    rows = []
    for i in range(80):
        w = [rnd.choice(["a", "the", "under", "mit", "cc", "by", "nc", "License"]) for _ in range(rnd.randrange(25))]
        for _ in range(rnd.randrange(3)):
            w.insert(rnd.randrange(len(w) + 1), rnd.choice(phrases))
        rows.append((i, rnd.choice([" ", "-", "\n"]).join(w)))
    rows += [*NASTY, (None, "x K under the mıt license"), (950, "Permission is hereby granted, free of charge, to each person obtaining a copy of the software and associated documentation files, to deal in the Software without restriction")]
    docs = docs_of(spark, rows).withColumn("row", F.lit(1)).withColumn("label", F.lit(2))
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect()), key=str)
    want = []
    for d, t in rows:
        w, at, names = ALNUM.findall(lower(t)), [], set()
        for x in licenses.BASE:
            v = ALNUM.findall(lower(x.text))
            own = [i for i in range(len(w) - len(v) + 1) if w[i : i + len(v)] == v]
            at += own
            names |= {x.label} if own else set()
        want.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names))))
    assert got == sorted(want, key=str)
    by = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert by[950].labels == "mit" and by[950].base_labels == "" and 0.6 <= by[950].score < 1
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in by.values())
    assert licenses.scan(docs.limit(0)).count() == 0


def brute_labels(text):
    """Labels and best cover by the definition: places of a template found at a start or near it."""
    w, labels, best = ALNUM.findall(lower(text)), set(), 0.0
    for x in [t._replace(base=True) for t in licenses.BASE] + licenses.METHOD:
        v = ALNUM.findall(lower(x.text))
        drift = 0 if x.base else min(3, len(v) // 4)
        grams, own = [v[i : i + 3] for i in range(len(v) - 2)], [w[i : i + 3] for i in range(len(w) - 2)]
        for a in range(-len(v), len(w)):
            if any(0 <= a + p < len(own) and own[a + p] == g for p, g in enumerate(grams)):
                cover = sum(any(0 <= a + p + e < len(own) and own[a + p + e] == g for e in range(-drift, drift + 1)) for p, g in enumerate(grams)) / len(grams)
                if cover >= (1 if x.base else 0.6):
                    labels.add(x.label)
                    best = max(best, cover)
    return ",".join(sorted(labels)), best


def test_license_labels_match_brute_force(spark, tmp_path):
    rnd = random.Random(19)
    rows = [(1, "All rights reserved."), (2, "All rights reserved. All rights reserved."), (3, "all rights reserved " * 50), (4, "all all rights reserved reserved rights"), (5, ""), (6, None)]
    for i in range(60):
        t = rnd.choice(licenses.METHOD).text.split()
        for _ in range(rnd.randrange(5)):
            k = rnd.randrange(len(t))
            rnd.choice([lambda: t.insert(k, "extra"), lambda: t.pop(k), lambda: t.insert(k, t[k])])()
        rows.append((100 + i, " ".join(["some words before", *t * rnd.choice([1, 1, 2]), "and after"])))
    docs = docs_of(spark, rows).withColumn("anchor", F.lit("x")).withColumn("template", F.lit(1))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    for d, t in rows:
        labels, cover = brute_labels(t)
        assert got[d][0] == labels and got[d][1] == pytest.approx(cover), t
    assert got[1] == got[2] == got[3] == ("proprietary", 1.0)
    templates = [licenses.Template("p", "All rights reserved"), licenses.Template("long", " ".join(f"word{i}" for i in range(150)))]
    text = " ".join(f"word{i}" for i in range(150) if i != 70)
    found = licenses.spans(docs_of(spark, [(1, "All rights reserved. All rights reserved."), (2, "x y " + text)]), templates)
    assert sorted((r.doc_id, r.label, r.start, r.end) for r in found.collect()) == [(1, "p", 0, 3), (1, "p", 3, 6), (2, "long", 2, 151)]
    assert sorted(str((r["doc_id"], r["labels"])) for r in by_sql("op5_license_scan", "documents", docs.drop("anchor", "template"), tmp_path)) == sorted(str((d, v[0])) for d, v in got.items())


@pytest.mark.parametrize("most", [0])
def test_license_templates_beyond_the_broadcast_bound(spark, monkeypatch, most):
    docs = docs_of(spark, [(1, "x under the MIT license, all rights reserved"), (2, None)])
    want = sorted(map(str, licenses.scan(docs).collect()))
    monkeypatch.setattr(licenses, "MOST_BROADCAST", most)
    assert sorted(map(str, licenses.scan(docs).collect())) == want


def by_sql(name, table, df, tmp_path):
    """Rows that the SQL of a query gives for a fixture."""
    df.write.parquet(str(tmp_path / table))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path / table}/*.parquet'")
    found = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def test_chat_links_quotations(spark, tmp_path):
    rows = [
        (1, 0, "user", "How do I sort a list?\nIt has a million rows."),
        (1, 1, "assistant", "Use the sort method of the list."),
        (1, 2, "user", "Ann wrote:\n> How do I  SORT a list?\nI have the same question."),
        (1, 3, "assistant", ">> How do I sort a list?\n> I have the same question.\nSee the answer above, please."),
        (1, 4, "user", "> nobody ever said this line\nhm"),
        (2, 0, "user", "> How do I sort a list?"),
        (2, 1, None, None),
        (None, 1, "user", "> Use the sort method of the list."),
        (3, 5, "user", "same turn original line"),
        (3, 5, "user", "> same turn original line"),
        (4, 0, "user", "the common line of all"),
        *((4, t, "user", "> the common line of all\nthe common line of all") for t in range(1, 1100, 100)),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("row", F.lit(1)).withColumn("thread", F.lit("x"))
    out = chat.format_chat(df).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn): r for r in out}
    assert [(by[1, t].reply_to, by[1, t].thread) for t in range(5)] == [(None, 0), (None, 1), (0, 0), (2, 0), (None, 4)]
    assert by[1, 2].text == "I have the same question." and by[1, 3].text == "See the answer above, please."
    assert by[1, 3].n_quoted == 2 and by[1, 3].n_linked == 2 and by[1, 4].text == "hm"
    assert by[2, 0].reply_to is None and by[2, 1].text == "" and by[None, 1].reply_to is None and by[3, 5].reply_to is None
    for t in range(101, 1100, 100):
        assert by[4, t].reply_to == t - 100 and by[4, t].thread == 0
    assert by[1, 1].formatted == "<|assistant|>\nUse the sort method of the list.\n<|end|>"
    names = sorted(out[0].asDict())
    want = by_sql("op7_chat_format", "conversations", df.drop("row", "thread"), tmp_path)
    assert sorted(str([r[n] for n in names]) for r in out) == sorted(str([r[n] for n in names]) for r in want)
    plain = chat.format_chat(df.where("conv_id = 1 and turn < 2")).collect()
    assert {r.reply_to for r in plain} == {None} and chat.format_chat(df.limit(0)).count() == 0


def test_chat_passages_short_lines_and_threads_by_message(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_MESSAGES", 2)
    rows = [
        (1, 0, "user", "The first point is long\nand goes on here.\n\nYes"),
        (1, 1, "assistant", "> the first point\n> is long and goes\n> on here.\nAgreed."),
        (1, 2, "user", "> yes\nFine"),
        (1, 2, "assistant", "> Agreed.\nAlso fine"),
        (1, 3, "user", ">> yes\n> Also fine\nThanks"),
        (1, 3, "user", "A question of its own"),
        (1, 4, "user", "> Fine\n" + "long " * 20_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = {r.text[:20]: r for r in chat.format_chat(df).collect()}
    assert [(by[k].reply_to, by[k].thread, by[k].place) for k in ("Agreed.", "Fine", "Also fine", "Thanks", "A question of its ow")] == [(0, 0, 1), (0, 0, by["Fine"].place), (1, 0, by["Also fine"].place), (2, 0, 4), (None, 3, 0)]
    assert {by["Fine"].place, by["Also fine"].place} == {2, 3} and by["Thanks"].n_linked == 2 and by["Agreed."].n_linked == 3
    assert by["long " * 4].reply_to == 2
    parts = chat.chats(df).collect()
    assert sorted((r.thread, r.part, len(r.messages)) for r in parts) == [(0, 0, 2), (0, 1, 2), (0, 2, 2), (3, 0, 1)]
    first = next(r for r in parts if r.thread == 0 and r.part == 0)
    assert first.chat == "<|user|>\nThe first point is long\nand goes on here.\n\nYes\n<|end|>\n<|assistant|>\nAgreed.\n<|end|>"


@pytest.mark.parametrize("rule", tokens.RULES)
def test_token_attribution(spark, rule):
    rnd = random.Random(15)
    rows = [(i, "".join(rnd.choice(["the ", "\n", "\n\n", "  \n ", "naïve", "中文", " 123", "don't", "<|endoftext|>"]) for _ in range(rnd.randrange(40)))) for i in range(60)] + NASTY
    enc, _ = tokens.encoding(tokens.VOCABULARY)
    docs = docs_of(spark, rows).withColumn("section", F.lit("x"))
    got = {}
    for r in tokens.count(docs, rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, t in rows:
        t = t or ""
        if d == 906:
            continue
        ids, parts = enc.encode_ordinary(t), got[d]
        assert sum(r.n_tokens for r in parts) == pytest.approx(len(ids)) and {r.doc_tokens for r in parts} == {len(ids)}
        assert "".join(t[r.start : r.end] for r in sorted(parts, key=lambda r: r.section)) == t
        # brute force: a section for each byte
        section, s = [], 0
        for b in t.encode():
            section.append(s)
            s += b == 10
        counts, at = {}, 0
        for i in ids:
            n = len(enc.decode_single_token_bytes(i))
            own = section[at : at + n]
            at += n
            if rule == "start":
                share = {own[0]: 1}
            elif rule == "end":
                share = {own[-1]: 1}
            elif rule == "majority":
                share = {max(sorted(set(own)), key=own.count): 1}
            else:
                share = {x: own.count(x) / n for x in set(own)}
            for k, v in share.items():
                counts[k] = counts.get(k, 0) + v
        assert {r.section: r.n_tokens for r in parts if r.n_tokens} == pytest.approx({k: v for k, v in counts.items() if v})
    with pytest.raises(ValueError):
        tokens.count(docs, "none")


@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens_of_fields(spark, rule):
    rows = [(1, "A title", "the body\n\nof it"), (2, None, "naïve 中文 body"), (3, "", ""), (4, "only", None), (4, "only", None)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string").withColumn("field", F.lit("x"))
    enc, _ = tokens.encoding(tokens.VOCABULARY)
    got = {}
    for r in tokens.count_fields(docs, ["title", "text"], rule, " ").collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, title, text in rows[:3]:
        whole, border = f"{title or ''} {text or ''}", len(f"{title or ''} ".encode())
        want, at = [0.0, 0.0], 0
        for i in enc.encode_ordinary(whole):
            n = len(enc.decode_single_token_bytes(i))
            first = max(0, min(border, at + n) - at) / n
            at += n
            share = {"start": float(first > 0), "end": float(first == 1), "majority": float(first >= 0.5), "split": first}[rule]
            want = [want[0] + share, want[1] + 1 - share]
        own = sorted(got[d], key=lambda r: r.start)
        assert [r.n_tokens for r in own] == pytest.approx(want) and {r.doc_tokens for r in own} == {len(enc.encode_ordinary(whole))}
        assert "".join(whole[r.start : r.end] for r in own) == whole and [r.field for r in own] == ["title", "text"]
    assert len(got[4]) == 4 and tokens.count_fields(docs.limit(0), ["title"]).count() == 0
