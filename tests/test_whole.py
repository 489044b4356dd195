from roadmesh.plans import catalog
from roadmesh.plans.inputs import Inputs


def walks(spark):
    i = Inputs(spark, "/root/testdata/sf0.001")
    return i, {(r["city"], r["u"], r["v"]) for r in catalog.walk(i).collect()}


def test_components_of_all_edges(spark):
    i, edges = walks(spark)
    want = {}
    for city in {c for c, _, _ in edges}:
        near = {}
        for c, u, v in edges:
            if c == city:
                near.setdefault(u, set()).add(v), near.setdefault(v, set()).add(u)
        found = []
        while near:
            part, front = set(), [next(iter(near))]
            while front:
                n = front.pop()
                if n in near:
                    part.add(n), front.extend(near.pop(n))
            found.append(part)
        want[city] = max(len(p) for p in found)
    got = {}
    for r in catalog.gf26_components(i).collect():
        got[r["city"]] = got.get(r["city"], 0) + 1
    assert got == want


def test_contraction_of_all_edges(spark):
    """Nodes of a degree other than 2 and 4 stay end points with all their edges."""
    i, edges = walks(spark)
    degree = {}
    for r in catalog.walk(i).collect():
        for n in (r["u"], r["v"]):
            degree[r["city"], n] = degree.get((r["city"], n), 0) + 1
    ends = {k for k, d in degree.items() if d not in (2, 4)}
    direct = {(c, u, v) for c, u, v in edges if (c, u) in ends and (c, v) in ends}
    assert direct and direct <= {(r["city"], r["u"], r["v"]) for r in catalog.gf1_contraction(i).collect()}


def test_linear_models_are_all_scored(spark):
    got = {(r["model"], r["fold"]) for r in catalog.m6_m7_linear_cv(Inputs(spark, "/root/testdata/sf0.001")).collect()}
    assert got == {(m, k) for m in ("LR", "Ridge", "Lasso") for k in range(7)}


def test_centroid_distances(spark):
    i = Inputs(spark, "/root/testdata/sf0.001")
    got = catalog.a36_m25_centroids(i).collect()
    n = i.matrix().where("city is not null").select("city").distinct().count()
    assert len(got) == n * (n - 1) // 2
    assert all(abs(r["distance"] ** 2 - (r["a_pc0"] - r["b_pc0"]) ** 2 - (r["a_pc1"] - r["b_pc1"]) ** 2) < 1e-9 for r in got)


def test_every_feature_is_attributed(spark):
    i = Inputs(spark, "/root/testdata/sf0.001")
    assert {r["feature"] for r in catalog.m22_permutation_importance(i).collect()} == set(catalog.FEATURES)
    assert {r["feature"] for r in catalog.m23_sampled_attribution(i).select("feature").distinct().collect()} == set(catalog.FEATURES)
