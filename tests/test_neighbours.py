"""Nearest neighbours against comparing all pairs, with ties, copies and odd vectors, and how many pairs it takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import neighbours as N


def unit(v):
    if v is None or any(x is None or not np.isfinite(x) for x in v):
        return None
    x = np.array(v, "f4").astype(float)
    n = np.sqrt((x * x).sum())
    return x / n if n > 0 else None


def plain(probes, entries, threshold, k):
    """All pairs of a tenant (and of equal guards and length)."""
    by = {}
    for i, group, v in entries:
        u = unit(v)
        if i is not None and None not in group and u is not None:
            by.setdefault((group, len(v)), []).append((i, u))
    out = set()
    for i, group, v in probes:
        u = unit(v)
        if i is None or u is None or (group, len(v)) not in by:
            continue
        ids, m = zip(*by[(group, len(v))], strict=True)
        s = np.rint(np.array(m) @ u * 1e6) / 1e6
        out |= {(i, ids[j], float(s[j]), r + 1) for r, j in enumerate(np.lexsort((ids, -s))[:k]) if s[j] >= threshold}
    return out


def frames(spark, probes, entries, guards=False):
    also = ", guards array<string>" if guards else ""
    p = spark.createDataFrame([(i, *g, v) for i, g, v in probes], f"probe_id long, tenant int{also}, embedding array<float>")
    e = spark.createDataFrame([(i, *g, v) for i, g, v in entries], f"entry_id long, tenant int{also}, embedding array<float>").repartition(5)
    return p, e


def clustered(seed=3, n=4000, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, dims))
    rows = [(i, (int(rng.integers(0, 2)),), (base[rng.integers(0, 40)] + rng.normal(size=dims) * 0.15).astype("f4").tolist()) for i in range(n)]
    rows += [(n + i, (0,), rows[0][2]) for i in range(n // 2)]  # a third are copies of one
    return rows + [(50_000, (0,), [0.0] * dims), (50_001, (1,), None), (50_002, (None,), rows[0][2]), (50_003, (0,), [1.0] * 5), (50_004, (0,), [float("nan")] * dims), (None, (0,), rows[0][2]), (50_005, (0,), [])]


@pytest.mark.parametrize(("threshold", "k"), [(-1.0, 3), (0.92, 1)])
def test_nearest_equals_all_pairs(spark, monkeypatch, threshold, k):
    monkeypatch.setattr(N, "UNSALTED", 100)  # keys of these tables are salted too
    entries = clustered()
    probes = [r for r in entries if r[0] is not None and r[0] % 40 == 0 or r[0] in (50_002, 50_003)] + [(60_000, (7,), entries[0][2]), (60_001, (0,), None), (60_002, (1,), np.ones(16).tolist()), (60_003, (0,), [0.0] * 16)]
    p, e = frames(spark, probes, entries)
    index = N.Index(e, None, k, ring=64)
    found, looks = index.search(p, threshold)
    want = plain(probes, entries, threshold, k)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    pairs = looks.join(index.rings, "ring").agg(F.sum("n")).first()[0]
    sizes = {t: sum(1 for _, g, v in entries if g == (t,) and v and len(v) == 16) for t in (0, 1)}
    assert pairs < 0.2 * sum(sizes.get(g[0], 0) for _, g, _ in probes)


def test_vectors_without_clusters_and_with_ties(spark):
    rng = np.random.default_rng(9)
    entries = [(i, (0,), rng.integers(-1, 2, 4).astype(float).tolist()) for i in range(700)] + [(1000 + i, (0,), (rng.normal(size=4)).tolist()) for i in range(700)]
    probes = [(i, g, v) for i, g, v in entries if i % 9 == 0]
    p, e = frames(spark, probes, entries)
    for threshold, k in ((-1.0, 7), (0.999999, 2)):
        assert {tuple(r) for r in N.nearest(p, e, threshold, k, pivots=8, ring=20).collect()} == plain(probes, entries, threshold, k)


def test_guards_must_be_equal(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    entries = [(i, (i % 2, (["a"], ["b", "a"], None, [])[i % 4]), (base + rng.normal(size=8) * 0.01).tolist()) for i in range(40)]
    probes = [(100 + i, g, v) for i, g, v in entries[:12]]
    hashed = lambda rows: [(i, (g[0], tuple(g[1]) if g[1] is not None else None), v) for i, g, v in rows]
    p, e = frames(spark, probes, entries, guards=True)
    assert {tuple(r) for r in N.nearest(p, e, 0.5, 2).collect()} == plain(hashed(probes), hashed(entries), 0.5, 2)


def test_nothing_to_find(spark):
    p, e = frames(spark, [(1, (0,), [1.0, 2.0])], [])
    assert N.nearest(p, e, 0.5, 1).collect() == []
    assert N.nearest(*frames(spark, [], [(1, (0,), [1.0, 2.0])]), 0.5, 1).collect() == []
    with pytest.raises(ValueError):
        N.Index(e, k=1).search(p, 0.5, k=2)
