import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import clusters as C
from wakeline.operators import cycles as Y
from wakeline.operators import graph as G
from wakeline.operators import metrics as M
from wakeline.operators.components import connected_components
from wakeline.schemas import EDGES, NODES, REFERENCE


def make_edges(spark, pairs, kind=REFERENCE):
    return spark.createDataFrame([(a, b, k if k else kind, 1.0, [f"{a}>{b}"], 1) for a, b, *k in ((p[0], p[1], *([p[2]] if len(p) > 2 else [""])) for p in pairs) for k in [k[0]]], EDGES)


def make_nodes(spark, names, objects=None, solutions=None):
    return spark.createDataFrame([(n, f"src/{n}", n, None, "sdk", None, 1, [f"{n}Type"], (objects or {}).get(n, []), (solutions or {}).get(n, []), []) for n in names], NODES)


def reach(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    done = {}
    for a in out:
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        done[a] = seen
    return done


def test_components_match_brute_force(spark):
    rnd = random.Random(1)
    pairs = [(f"n{rnd.randrange(60):02}", f"n{rnd.randrange(60):02}") for _ in range(45)] + [("x", "x")]
    both = reach([*pairs, *((b, a) for a, b in pairs)])
    want = {(a, min(both[a] | {a})) for p in pairs for a in p}
    df = spark.createDataFrame([*pairs, (None, "n01")], "src string, dst string")
    assert {tuple(r) for r in connected_components(df).collect()} == want


@pytest.mark.parametrize("in_task", [500_000, 0])
def test_cycles_match_brute_force(spark, monkeypatch, in_task):
    monkeypatch.setattr(Y, "MOST_EDGES_IN_TASK", in_task)
    rnd = random.Random(2)
    pairs = list({(f"n{rnd.randrange(30):02}", f"n{rnd.randrange(30):02}") for _ in range(48)})
    far = reach(pairs)
    groups = {}
    for a in far:
        own = {b for b in far[a] if a in far.get(b, ())} | ({a} if a in far[a] else set())
        if len(own | {a}) > 1 and a in far[a]:
            groups[min(own)] = sorted(own)
    found = {r.component: r for r in Y.cycle_groups(make_edges(spark, pairs)).collect()}
    assert {k: r.members for k, r in found.items()} == groups
    for k, r in found.items():
        inside = {p for p in pairs if p[0] != p[1] and p[0] in groups[k] and p[1] in groups[k]}
        assert r.edge_count == len(inside)


def test_cycle_kinds_and_lengths(spark):
    edges = make_edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "d"), ("e", "f", "namespace_usage"), ("f", "e", "namespace_usage")])
    groups = Y.cycle_groups(edges)
    assert [(r.component, r.size, r.edge_count) for r in groups.collect()] == [("a", 3, 4)]
    assert [tuple(r) for r in Y.shortest_cycles(edges, groups).collect()] == [("a", 2)]
    assert Y.cycle_groups(edges, None).count() == 2


@pytest.mark.parametrize(("in_task", "n"), [(500_000, 60), (0, 6)])
def test_large_cycle_starts_at_its_first_node(spark, monkeypatch, in_task, n):
    monkeypatch.setattr(Y, "MOST_EDGES_IN_TASK", in_task)
    ring = [f"n{i:03}" for i in range(n)]
    edges = make_edges(spark, list(zip(ring, ring[1:] + ring[:1])))
    assert [tuple(r) for r in Y.shortest_cycles(edges, Y.cycle_groups(edges)).collect()] == [("n000", n)]


def test_metrics_of_a_small_graph(spark):
    edges = make_edges(spark, [("a", "b"), ("b", "c"), ("a", "c", "namespace_usage")])
    m = {r.name: r for r in M.coupling_metrics(make_nodes(spark, "abcd", {"a": ["o"], "b": ["o", "p"]}), edges).collect()}
    assert (m["c"].fan_in, m["c"].afferent, m["c"].instability) == (1, 2, 0.0)
    assert (m["a"].fan_out, m["a"].instability, m["a"].coupling) == (1, 1.0, 1.5)
    assert (m["b"].shared_db_density, m["d"].coupling, m["d"].consumer_count) == (0.5, 0.0, 0)


def test_breadth_first_search_stops_and_leaves_out_its_seed(spark):
    edges = make_edges(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("a", "c")])
    seeds = spark.createDataFrame([("a",)], "seed string")
    got = {(r.name, r.depth, r.parent) for r in G.transitive_consumers(edges, seeds, 2).collect()}
    assert got == {("b", 1, "a"), ("c", 2, "b")}


def test_graph_edits(spark):
    edges = make_edges(spark, [("a", "b"), ("a", "b", "type_usage"), ("b", "a"), ("a", "a")])
    assert G.remove_edges(edges, "a", "source", ["type_usage"]).count() == 3
    assert G.remove_edges(edges, "a", "target").count() == 2
    assert G.incident(edges, "a").count() == 5 and G.between(edges, "a", "b").count() == 3
    many = spark.createDataFrame([("a", "b", "x", 1.0, [f"{i:02}" for i in range(20, 0, -1)], None)], EDGES)
    row = G.cap_evidence(many).first()
    assert row.evidence == [f"{i:02}" for i in range(1, 11)] and row.evidence_total == 20
    assert G.dangling_edges(make_nodes(spark, "a"), edges).count() == 3


def brute_labels(edges):
    near = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {}).setdefault(y, 0.0)
            near[x][y] += w
    label = {n: n for n in near}
    for _ in range(100):
        before = dict(label)
        for n in sorted(near):
            votes = {}
            for o, w in near[n].items():
                votes[label[o]] = votes.get(label[o], 0) + w
            label[n] = sorted(votes, key=lambda v: (-votes[v], v))[0]
        if label == before:
            break
    return label


def test_label_propagation(spark):
    rnd = random.Random(4)
    pairs = [(f"g{g}n{rnd.randrange(12):02}", f"g{g}n{rnd.randrange(12):02}") for g in range(3) for _ in range(40)] + [("g0n00", "g1n00"), ("g1n00", "g2n00")]
    pairs = [(a, b) for a, b in pairs if a != b]
    edges = make_edges(spark, pairs)
    comps = connected_components(edges, "source", "target")
    got = {r.name: r.label for r in C.label_propagation(edges, comps).collect()}
    sums = {}
    for p in pairs:
        sums[p] = sums.get(p, 0) + 1.0
    assert got == brute_labels([(*p, w) for p, w in sums.items()])


def test_label_propagation_is_the_same_beyond_the_bound(spark, monkeypatch):
    rnd = random.Random(6)
    pairs = {(f"n{rnd.randrange(12):02}", f"n{rnd.randrange(12):02}") for _ in range(22)} | {(f"m{i}", f"m{i + 1}") for i in range(5)}
    edges = make_edges(spark, [p for p in pairs if p[0] != p[1]])
    comps = connected_components(edges, "source", "target")
    want = {r.name: r.label for r in C.label_propagation(edges, comps).collect()}
    monkeypatch.setattr(C, "MOST_EDGES_IN_TASK", 0)
    assert {r.name: r.label for r in C.label_propagation(edges, comps).collect()} == want
    assert want == brute_labels([(*p, 1.0) for p in pairs if p[0] != p[1]]) and len(set(want.values())) > 1


def test_registered_clusters_split_large_components(spark):
    """The registered query against plain components and sweeps over the same edges."""
    import __spark_entry__ as entry
    from wakeline.plans.graph_queries import module_nodes, references

    sf = "/root/testdata/sf0.001"
    sums = {}
    for r in references(spark, sf).collect():
        if r.source != r.target:
            sums[r.source, r.target] = sums.get((r.source, r.target), 0.0) + r.weight
    near = {}
    for a, b in sums:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    groups, seen = [], set()
    for n in sorted(near):
        if n not in seen:
            todo, own = [n], set()
            while todo:
                x = todo.pop()
                if x not in own:
                    own.add(x)
                    todo += near[x]
            seen |= own
            groups.append(own)
    want = set()
    for own in groups:
        parts = [own]
        if len(own) > 20:
            labels = brute_labels([(a, b, w) for (a, b), w in sums.items() if a in own])
            parts = [{n for n in own if labels[n] == x} for x in set(labels.values())]
        want |= {(n, min(p)) for p in parts if len(p) > 1 for n in p}
    known = {r.name for r in module_nodes(spark, sf).collect()}
    got = {(r.name, r.cluster) for r in entry.queries()["clusters"](spark, sf).collect()}
    assert got == {x for x in want if x[0] in known} and max(map(len, groups)) > 20


def test_feasibility_counts_a_crossing_cycle(spark):
    edges = make_edges(spark, [("a.x", "a.y"), ("a.y", "b.z"), ("b.z", "a.x")])
    nodes = make_nodes(spark, ["a.x", "a.y", "b.z"], {"a.x": ["o"], "b.z": ["o"]})
    members = spark.createDataFrame([("a.x", "a.x"), ("a.y", "a.x"), ("b.z", "b.z")], "name string, cluster string")
    cyc = Y.members_of(Y.cycle_groups(edges))
    row = {r.cluster: r for r in C.describe(nodes, edges, members, cyc).collect()}["a.x"]
    assert (row.internal, row.external, row.cohesion) == (1, 2, 0.5)
    assert abs(row.feasibility - (1 - (0.4 * 2 / 3 + 0.25 * 1 / 1 + 0.2))) < 1e-6


def test_results_do_not_depend_on_partitions(spark):
    edges = make_edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")])
    nodes = make_nodes(spark, "abcde")
    one = sorted(map(tuple, M.coupling_metrics(nodes.coalesce(1), edges.coalesce(1)).collect()))
    assert one == sorted(map(tuple, M.coupling_metrics(nodes.repartition(8), edges.repartition(8, F.col("target"))).collect()))
