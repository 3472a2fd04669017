"""Steps that stay in bounds on large tables: each by its bounded way and by the other, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_graph import make_edges, make_nodes
from wakeline.functions import scores as S
from wakeline.operators import builders as B
from wakeline.operators import components as Cp
from wakeline.operators import consumers as K
from wakeline.operators import graph as G
from wakeline.operators import metrics as M
from wakeline.operators import reports as Rp
from wakeline.operators import risk as R


@pytest.mark.parametrize("in_row", [200_000, 20, 0])
def test_two_hops_match_brute_force(spark, monkeypatch, in_row):
    monkeypatch.setattr(R, "MOST_IN_ROW", in_row)
    rnd = random.Random(3)
    pairs = {(f"n{rnd.randrange(20):02}", f"n{rnd.randrange(20):02}") for _ in range(50)} | {(f"m{i}", "hub") for i in range(15)} | {("n00", "m1")}
    into = {}
    for a, b in pairs:
        if a != b:
            into.setdefault(b, set()).add(a)
    far = {n: {f for c in own for f in into.get(c, ())} - own - {n} for n, own in into.items()}
    direct, second = R.two_hops(make_edges(spark, sorted(pairs)))
    assert {r.name: r.n for r in direct.collect()} == {n: len(x) for n, x in into.items()}
    assert {r.name: r.n for r in second.collect()} == {n: len(x) for n, x in far.items() if x}


@pytest.mark.parametrize("in_task", [500_000, 8, 0])
def test_components_by_contraction(spark, monkeypatch, in_task):
    monkeypatch.setattr(Cp, "MOST_EDGES_IN_TASK", in_task)
    rnd = random.Random(5)
    pairs = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 201 + i) for i in range(20)] + [(300, 300)]
    least = {x: x for p in pairs for x in p}
    for _ in range(100):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = Cp.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == least and len(got) == len(least)


@pytest.mark.parametrize("in_row", [100_000, 30, 0])
@pytest.mark.parametrize("backward", [True, False])
def test_reach_of_all_is_that_of_each(spark, monkeypatch, in_row, backward):
    monkeypatch.setattr(G, "MOST_IN_ROW", in_row)
    rnd = random.Random(7)
    pairs = [(f"n{rnd.randrange(25):02}", f"n{rnd.randrange(25):02}") for _ in range(40)] + [(f"m{i}", "hub") for i in range(12)] + [("hub", "n00"), ("n00", "hub")]
    edges = make_edges(spark, pairs)
    seeds = edges.select(F.col("target" if backward else "source").alias("seed")).distinct()
    want = sorted(tuple(r) for r in G.reach(edges, seeds, 3, backward).drop("parent").collect())
    assert sorted(tuple(r) for r in G.reach_all(edges, 3, backward).collect()) == want


def test_evidence_is_not_gathered(spark):
    refs = spark.createDataFrame([(f"r{i}", "a", "o") for i in range(30)] * 2 + [("r0", "b", "o")], "report string, project string, object string")
    uses = spark.createDataFrame([("o", "b"), ("o", "c")], "object string, project string")
    edges = B.report_edges(refs, uses)
    assert "collect_set" not in edges._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.source, r.target): (r.weight, r.evidence, r.evidence_total) for r in edges.collect()}
    first = sorted(f"r{i}:o" for i in range(30))[:10]
    assert got == {("a", "b"): (30.0, first, 30), ("a", "c"): (30.0, first, 30), ("b", "c"): (1.0, ["r0:o"], 1)}


def test_equal_proofs_of_different_objects_count_once(spark):
    refs = spark.createDataFrame([("r:x", "a", "y"), ("r", "a", "x:y"), (None, "a", "r:x:y")], "report string, project string, object string")
    uses = spark.createDataFrame([("y", "b"), ("x:y", "b"), ("r:x:y", "b")], "object string, project string")
    assert [(r.weight, r.evidence) for r in B.report_edges(refs, uses).collect()] == [(1.0, ["r:x:y"])]


def test_shared_object_edges_go_both_ways_with_the_smallest_proofs(spark):
    uses = spark.createDataFrame([(p, f"o{i:02}") for p in "ab" for i in range(12)] + [("c", "o11"), ("c", "o11")], "project string, object string")
    edges = B.shared_object_edges(uses)
    assert "collect_set" not in edges._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.source, r.target): (r.evidence_total, r.evidence) for r in edges.collect()}
    ten = [f"o{i:02}" for i in range(10)]
    assert got == {("a", "b"): (12, ten), ("b", "a"): (12, ten)} | {p: (1, ["o11"]) for p in [("a", "c"), ("c", "a"), ("b", "c"), ("c", "b")]}


def test_solutions_beyond_one_word(spark):
    rnd = random.Random(9)
    names = [f"n{i}" for i in range(40)]
    solutions = {n: sorted({f"s{rnd.randrange(150)}" for _ in range(6)}) for n in names[:35]}
    pairs = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(120)}) + [("n0", "gone")]
    want = {}
    for s in {s for x in solutions.values() for s in x}:
        ends = [(set(solutions.get(a, ())), set(solutions.get(b, ()))) for a, b in pairs if b != "gone"]
        inner, outer = sum(s in a and s in b for a, b in ends), sum((s in a) != (s in b) for a, b in ends)
        into, out = {o for a, b in ends if s in b for o in a - b}, {o for a, b in ends if s in a for o in b - a}
        want[s] = (sum(s in x for x in solutions.values()), inner, outer, outer / (inner + outer) if inner + outer else 0.0, sorted(into), sorted(out))
    metrics = M.solution_metrics(make_nodes(spark, names, solutions=solutions), make_edges(spark, pairs))
    assert "sides-" in "".join(metrics.inputFiles())  # what edges lead to is gathered by node, not by edge
    assert {r.solution: tuple(r)[1:] for r in metrics.collect()} == want


@pytest.mark.parametrize("most", [100_000, 0])
def test_funnel_with_few_and_many_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(K, "MOST_BROADCAST", most)
    edges = make_edges(spark, [("a", "t"), ("b", "t"), ("lone", "t"), ("a.Tests", "t")])
    files = spark.createDataFrame([(f"{p}/{i}", p, text) for p in ("a", "b", "a.Tests") for i, text in enumerate(["using Ns; new Cls()", "using Ns;", None])], "path string, project string, text string")
    targets = spark.createDataFrame([("t", "Ns", "Cls", None)], "target string, namespace string, class_name string, method_name string")
    got = sorted((r.consumer, r.path or "", r.passed) for r in K.funnel(edges, files, targets, ("*.Tests",)).collect())
    want = [(p, f"{p}/{i}", n) for p in ("a", "b") for i, n in enumerate((5, 3, 2))] + [("a.Tests", f"a.Tests/{i}", 1) for i in range(3)] + [("lone", "", 2)]
    assert got == sorted(want)


def test_prediction_records_are_whole(spark):
    dims = spark.createDataFrame([("a", 0.5, 0.1, 0.0, 0.123456, 1.0, 0.0, None)], "name string, " + ", ".join(f"{d} double" for d in S.DIMENSIONS))
    n = lambda k: spark.createDataFrame([("a", k)], "name string, n long")
    row = Rp.prediction_rows(R.profile(dims), n(3), n(4), n(5)).first()
    assert (row.scores["database"], row.scores["change_surface"], row.available["database"], row.available["change_surface"]) == (0.1235, None, True, False)
    assert (row.changed_type_count, row.direct_consumers, row.transitive_consumers, row.outcome) == (5, 3, 4, None)
    assert row.risk_factors == ["blast_radius", "change_surface", "structural"]
