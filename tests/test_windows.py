"""Points in active windows against a comparison of every pair."""

import random

from oscilla.operators import matching


def test_inside_windows(spark):
    rng = random.Random(4)
    points = [(k, float(rng.randrange(60)), i) for i, k in enumerate(rng.choices(["hot", "a", "b", None, "free"], [20, 3, 3, 3, 2], k=400))]
    points.append(("a", None, 400))
    windows = [(k, float(s), float(s + rng.randrange(-2, 6))) for k in ("hot", "hot", "hot", "a", "b", "b", None) for s in rng.sample(range(60), 4)]
    windows += [("a", None, 70.0), ("free", 5.0, None), ("nowhere", 1.0, 2.0)]
    p = spark.createDataFrame(points, "k string, t double, inside_id long")
    w = spark.createDataFrame(windows, "k string, start double, stop double")
    got = {(r["inside_id"], r["k"], r["t"], r["inside"]) for r in matching.inside_windows(p, w, ["k"]).collect()}
    want = set()
    for k, t, i in points:
        own = [(s, e) for name, s, e in windows if name == k and s is not None and e is not None]
        want.add((i, k, t, t is not None and (not own or any(s <= t <= e for s, e in own))))
    assert got == want
    plan = matching.inside_windows(p, w, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan
    none = matching.inside_windows(p, w.limit(0), ["k"])
    assert none.filter("inside").count() == 400 and none.count() == 401
    assert matching.inside_windows(p.limit(0), w, ["k"]).count() == 0


def test_sessions(spark):
    rows = [("a", float(t)) for t in (1, 2, 2, 4, 9, 10, 30)] + [(None, 5.0), ("b", None)]
    got = matching.sessions(spark.createDataFrame(rows, "k string, t double"), ["k"], 2.0)
    assert {tuple(r) for r in got.select("k", "start", "stop").collect()} == {("a", 1.0, 4.0), ("a", 9.0, 10.0), ("a", 30.0, 30.0), (None, 5.0, 5.0)}
