"""Operators against brute force and planted truth on small inputs."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import ordering, sequence, stats
from weftline.functions.runs import by_runs
from weftline.model import CONTIGS, LAYOUT, LIBRARIES, PAIRS
from weftline.operators import cluster, layout, links, longread, merge, regress, superscaffold
from weftline.operators.components import connected_components
from weftline.plans import queries, scaffolding
from weftline.sources import readers, sinks

LIBS = [("PE", "PE", 800, 15.0), ("MP", "MP", 3000, 15.0)]


def one(spark, lib, p1, m1, p2, m2, c=(1, 2)):
    pairs = spark.createDataFrame([(lib, c[0], p1, m1, c[1], p2, m2)], PAIRS)
    return links.link_observations(pairs, spark.createDataFrame(LIBS, LIBRARIES)).collect()


@pytest.mark.parametrize(
    "lib,p1,m1,p2,m2,diff,cons",
    [
        ("PE", 100, 200, 300, 200, 800 - 300 + 100, 1),
        ("PE", 100, 200, 200, 300, 800 + 200 + 100, -1),
        ("PE", 200, 100, 300, 200, 200 + 300 - 800, -1),
        ("PE", 200, 100, 200, 300, 200 - 200 - 800, 1),
        ("MP", 200, 100, 200, 300, 2800 - 200 + 200, 1),
        ("MP", 200, 100, 300, 200, 2800 + 300 + 200, -1),
        ("MP", 100, 200, 200, 300, 100 + 200 - 2800, -1),
        ("MP", 100, 200, 300, 200, 100 - 300 - 2800, 1),
    ],
)
def test_offsets(spark, lib, p1, m1, p2, m2, diff, cons):
    (r,) = one(spark, lib, p1, m1, p2, m2)
    assert (r["diff"], r["cons"]) == (diff, cons)


def test_ties_have_no_orientation(spark):
    assert one(spark, "PE", 100, 100, 300, 200) == []


def test_span_filter_bounds(spark):
    contigs = spark.createDataFrame([(1, 2000), (2, 2000)], CONTIGS)
    libs = spark.createDataFrame(LIBS, LIBRARIES)
    at = 800 + 45
    rows = [("PE", 1, 2000 - at, 2000 - at + 50, 2, 90, 40), ("PE", 1, 2000 - at - 1, 2000 - at + 50, 2, 90, 40), ("PE", 1, 10, 10, 2, 90, 40), ("PE", 1, 1900, 1950, 1, 90, 40)]
    got = links.span_filter(spark.createDataFrame(rows, PAIRS), libs, contigs).collect()
    assert {(r.p1, r.c2) for r in got} == {(2000 - at, 2), (10, 2)}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{100 + i: 100 for i in range(40)}, 500: 500}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_density_splits_keep_the_gap_rules():
    r = np.random.default_rng(0)
    for _ in range(300):
        x = np.sort(r.integers(0, 400, r.integers(1, 30))).astype(float)
        sd = float(r.integers(10, 60))
        gap, same = np.diff(x), np.diff(cluster.density_splits(x, sd)) == 0
        assert same[gap < sd / 2].all() and not same[gap > sd].any()


def planted(n=12, flips=(), outliers=0, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        for j in (i + 1, i + 2):
            if j < n:
                oi, oj = (-1 if i in flips else 1), (-1 if j in flips else 1)
                rows.append((i, j, oi * oj, oi * (1050.0 * (j - i) + r.normal() * 3), 50.0, 4.0))
    for _ in range(outliers):
        i, j = sorted(r.choice(n, 2, replace=False).tolist())
        rows.append((i, j, 1, 9000.0, 5.0, 4.0))
    return pd.DataFrame(rows, columns=["c1", "c2", "cons", "y", "w", "v"])


def test_solution_and_covariance_match_the_pseudo_inverse():
    d = planted()
    i, j, y, w, v = (d[c].to_numpy() for c in ("c1", "c2", "y", "w", "v"))
    x, a = regress.solve(12, i, j, y, w)
    m = np.zeros((len(d), 12))
    m[np.arange(len(d)), i], m[np.arange(len(d)), j] = -1, 1
    m = np.vstack([m, np.eye(12)[0]])
    big, vv = np.diag(np.r_[w, 100]), np.diag(np.r_[v, 0])
    lam = np.linalg.pinv(m.T @ big @ m) @ m.T @ big
    assert np.allclose(x, lam @ np.r_[y, 0], atol=1e-6)
    assert np.allclose(regress.covariance(12, i, j, w, v, a), lam @ vv @ lam.T, atol=1e-8)


def test_fit_recovers_flips_and_drops_outliers():
    flips = {3, 4, 9}
    d = planted(flips=flips, outliers=2)
    votes = pd.DataFrame([(a, b, 20 if s > 0 else 0, 20 if s < 0 else 0) for a, b, s in d[["c1", "c2", "cons"]].itertuples(index=False) if abs(a - b) <= 2], columns=["c1", "c2", "n_pos", "n_neg"]).drop_duplicates(["c1", "c2"])
    got = sorted(regress.fit(list(range(12)), d, votes, 100.0, 5), key=lambda r: r["node"])
    assert [r["orient"] for r in got] == [-1 if i in flips else 1 for i in range(12)]
    assert np.allclose([r["x"] for r in got], 1050 * np.arange(12), atol=60)


def test_levelled_matrix_solves_like_one_block():
    r = np.random.default_rng(2)
    n = 400
    i = np.r_[np.arange(n - 1), np.arange(n - 2), r.integers(0, n - 9, 50)]
    j = np.r_[np.arange(1, n), np.arange(2, n), i[-50:] + r.integers(1, 9, 50)]
    w, v, y = r.random(len(i)) + 0.1, r.random(len(i)), r.normal(size=len(i))
    one, many = regress.NormalMatrix(n, i, j, w, dense=n), regress.NormalMatrix(n, i, j, w, dense=10)
    assert len(one.inverse) == 1 and len(many.inverse) > 30
    b = r.normal(size=(n, 3))
    assert np.allclose(one.solve(b), many.solve(b)) and np.allclose(one.solve(b[:, 0]), many.solve(b)[:, 0])
    cov = regress.covariance(n, i, j, w, v, many)
    p, q = np.arange(n - 1), np.arange(1, n)
    assert np.allclose(regress.difference_variance(many, i, j, w, v, p, q), cov[p, p] + cov[q, q] - 2 * cov[p, q])


def literal_fit(nodes, rows, votes, tolerance, min_links, strict=True):
    """Trimming by its definition on dense matrices: a design matrix with a first row that holds node 0, pseudo-inverses, the order
    statistic of all residuals, and a new start for every part that falls off. {node: (scaffold, x, orient)} and kept rows."""
    out, kept = {}, []

    def go(own):
        own = sorted(own)
        if len(own) == 1:
            out[own[0]] = (own[0], 0.0, 1)
            return
        inside = [(own.index(a), own.index(b), p, q) for a, b, p, q in votes if a in own and b in own]
        d = regress.orient(len(own), inside, min_links)
        lines = [(own.index(a), own.index(b), y * d[own.index(a)], w, r) for r, (a, b, c, y, w, _) in enumerate(rows) if a in own and b in own and c == d[own.index(a)] * d[own.index(b)]]
        x = np.zeros((len(lines) + 1, len(own)))
        x[0, 0] = 1
        for k, (i, j, *_) in enumerate(lines, 1):
            x[k, i], x[k, j] = -1, 1
        y, w = np.array([0.0, *(t[2] for t in lines)]), np.array([100.0, *(t[3] for t in lines)])
        keep, step = np.ones(len(y), bool), max(1, int(np.floor(len(y) * 0.01)))
        for it in range(1, 300):
            parts = regress.parts_of(len(own), np.array([t[0] for t, k in zip(lines, keep[1:]) if k], int), np.array([t[1] for t, k in zip(lines, keep[1:]) if k], int))
            if len(parts) > 1:
                for p in parts:
                    go([own[q] for q in p])
                return
            m = x[keep]
            sol = np.linalg.pinv(m.T @ (w[keep, None] * m)) @ m.T @ (w[keep] * y[keep])
            err = np.abs(x @ sol - y)
            if err[keep].max() <= tolerance:
                out.update({n: (own[0], s, int(o)) for n, s, o in zip(own, sol, d)})
                kept.extend(t[4] for t, k in zip(lines, keep[1:]) if k)
                return
            if step * it >= len(lines):
                break
            bound = np.sort(err)[len(y) - step * it]
            keep = err < bound if strict else err <= bound
            keep[0] = True
            if not keep[1:].any():
                break
        out.update({n: (n, 0.0, 1) for n in own})

    for p in regress.parts_of(len(nodes), np.array([nodes.index(r[0]) for r in rows], int), np.array([nodes.index(r[1]) for r in rows], int)):
        go([nodes[q] for q in p])
    return out


@pytest.mark.parametrize("strict", [True, False])
def test_trimming_follows_its_definition(strict):
    r = np.random.default_rng(8)
    seen = set()
    for case in range(25):
        n, turn = 14, r.choice([-1, 1], 14)
        rows, votes = [], []
        for a in range(n):
            for b in (a + 1, a + 2):
                if b < n and not (case % 3 == 1 and a < 7 <= b):
                    for _ in range(int(r.integers(2, 9))):
                        away = 9000.0 * r.random() if r.random() < 0.06 else 0.0
                        rows.append((a, b, int(turn[a] * turn[b]), float(turn[a] * (700.0 * (b - a) + r.normal() * 20 + away)), float(r.uniform(1, 9)), float(r.uniform(1, 5))))
                    votes.append((a, b, *((9, 0) if turn[a] * turn[b] > 0 else (0, 9))))
        if case % 3 == 1:  # two halves that only conflicting rows join
            rows += [(5, 8, int(turn[5] * turn[8]), float(turn[5] * (2100.0 + off)), w, 2.0) for off, w in ((0.0, 2.0), (6000.0, 1.0))]
            votes.append((5, 8, *((9, 0) if turn[5] * turn[8] > 0 else (0, 9))))
        if case % 5 == 4:  # nothing fits
            rows = [(a, b, c, float(r.uniform(-9e4, 9e4)), w, v) for a, b, c, _, w, v in rows]
        table = pd.DataFrame(rows, columns=["c1", "c2", "cons", "y", "w", "v"])
        said = pd.DataFrame(votes, columns=["c1", "c2", "n_pos", "n_neg"])
        got = {x["node"]: x for x in regress.fit(list(range(n)), table, said, 100.0, 5, strict)}
        want = literal_fit(list(range(n)), rows, votes, 100.0, 5, strict)
        assert {k: (v["scaffold"], v["orient"]) for k, v in got.items()} == {k: (v[0], v[2]) for k, v in want.items()}
        assert all(abs(got[k]["x"] - want[k][1]) < 1e-6 for k in want)
        seen.add(len({v[0] for v in want.values()}))
    assert len(seen) > 1  # whole ones and parts


def test_refits_with_few_changes_equal_new_factors():
    r = np.random.default_rng(3)
    n = 300
    i, j = np.arange(n - 1), np.arange(1, n)
    a = r.integers(0, n - 7, 400)
    i, j = np.r_[i, a], np.r_[j, a + r.integers(1, 7, 400)]
    y, w = r.normal(size=len(i)) * 9, r.uniform(0.5, 4, len(i))
    fits, keep = regress.Refit(n, i, j, y, w), np.ones(len(i), bool)
    for step in range(30):
        x = regress.solve(n, i[keep], j[keep], y[keep], w[keep])[0]
        assert np.abs(fits.solve(keep) - x).max() < 1e-8
        keep = keep.copy()
        keep[r.integers(n - 1, len(i), 4)] ^= True
    assert 1 < fits.factored < 10


def test_spread_of_gaps_on_chains_and_far_pairs():
    r = np.random.default_rng(4)
    n = 400
    i, j = np.repeat(np.arange(n - 1), 3), np.repeat(np.arange(1, n), 3)
    w, v = r.uniform(0.5, 3, len(i)), r.uniform(1, 9, len(i))
    a = regress.NormalMatrix(n, i, j, w)
    by = lambda t: t.reshape(-1, 3).sum(axis=1)
    assert np.allclose(regress.difference_variance(a, i, j, w, v, np.arange(n - 1), np.arange(1, n)), by(w * w * v) / by(w) ** 2)
    p, q = np.array([0, 10, 300]), np.array([7, 399, 302])  # no row joins these
    cov = regress.covariance(n, i, j, w, v, a)
    assert np.allclose(regress.difference_variance(a, i, j, w, v, p, q), cov[p, p] + cov[q, q] - 2 * cov[p, q])


def literal_orient(n, votes, least, full=False):
    """The search and the flips by their definition on dense matrices."""
    total, weight, sign = (np.zeros((n, n)) for _ in range(3))
    for i, j, p, q in votes:
        total[i, j] = total[j, i] = p - q
        weight[i, j] = weight[j, i] = max(p, q)
        if max(p, q) > least:
            sign[i, j] = sign[j, i] = 1 if p >= q else -1
    d, seen = [0] * n, {0}
    d[0] = 1

    def visit(a):
        for b in sorted(range(n), key=lambda b: (-weight[a, b], b)):
            if weight[a, b] > 0 and b not in seen and sign[a, b]:
                d[b] = int(sign[a, b]) * d[a]
                seen.add(b)
                visit(b)

    visit(0)
    d = [x or 1 for x in d]
    agreement = lambda: sum(total[a, b] * d[a] * d[b] for a in range(n) for b in range(a, n))
    last = -100
    while agreement() > last:
        last = agreement()
        field = [d[a] * sum(total[a, b] * d[b] for b in range(0 if full else a, n)) for a in range(n)]
        k = int(np.argmin(field))
        if field[k] >= 0:
            break
        d[k] = -d[k]
        if agreement() <= last:
            d[k] = -d[k]
    return d


def test_orientations_follow_their_definition():
    from weftline.plans.queries import CASES

    r = np.random.default_rng(1)
    sets = [c[0] for c in CASES]
    for _ in range(2000):
        n = int(r.integers(2, 7))
        votes = [(i, j, int(r.integers(0, 30)), int(r.integers(0, 30))) for i in range(n) for j in range(i + 1, n) if r.random() < 0.7]
        sets.append([v for v in votes if v[2] + v[3]])
    sets.append([(0, 1, 60, 0), (1, 2, 60, 0), (0, 2, 0, 55), (0, 3, 9, 4)] + [(4 + i, 5 + i, 0, 300) for i in range(2)])
    for votes in sets:
        n = max([1, *(v[1] + 1 for v in votes)])
        for full in (False, True):
            assert regress.orient(n, votes, 5, full).tolist() == literal_orient(n, votes, 5, full)
    for votes, field, whole, tree in CASES:
        assert (literal_orient(5, votes, 5), literal_orient(5, votes, 5, True), regress.spanning_orient(5, votes).tolist()) == (field, whole, tree)


def test_kernel_sums_of_large_groups():
    r = np.random.default_rng(3)
    for x in (np.sort(r.normal(0, 400, 5000)), np.sort(r.integers(-3000, 3000, 6000)).astype(float), np.sort(np.r_[r.normal(0, 3, 3000), r.normal(1e6, 500, 3000)])):
        for h in (5.0, 100.0):
            want = np.array([np.exp(-0.5 * ((x - v) / h) ** 2).sum() for v in x])
            assert np.abs(cluster.kernel_sums(x, h) / want - 1).max() < 1e-12
    x = np.sort(r.normal(0, 3000, 1_000_000))
    began = time.time()
    assert len(cluster.density_splits(x, 15.0)) == len(x) and time.time() - began < 60


def test_splits_of_large_groups_equal_direct_ones(monkeypatch):
    r = np.random.default_rng(6)
    for sd in (10.0, 15.0, 200.0):
        x = np.sort(np.concatenate([r.normal(c, sd / 3, 300) for c in np.cumsum(r.uniform(0.5, 3, 12)) * sd]).round(3))
        direct = cluster.density_splits(x[:2000], sd)
        monkeypatch.setattr(cluster, "DIRECT", 10)
        assert (cluster.density_splits(x[:2000], sd) == direct).all()
        monkeypatch.setattr(cluster, "DIRECT", 2000)


def test_a_read_with_very_many_alignments_is_divided(spark):
    r = np.random.default_rng(7)
    rows = [(q, int(r.integers(1, 9)), 0, int(r.integers(0, 2)), -int(r.integers(1, 99)), 90.0, int(r.integers(0, 50)), 500, 600, int(k), int(k) + 50, 9000) for q, n in ((1, 150), (2, 3), (3, 1)) for k in r.integers(0, 5000, n)]
    names = ["qname", "tname", "qstrand", "tstrand", "score", "pct_sim", "tstart", "tend", "tlength", "qstart", "qend", "qlength"]
    align = spark.createDataFrame(rows, names)
    want = longread.pair_links(align, 1 << 20).collect()
    assert sorted(longread.pair_links(align, 16).collect()) == sorted(want) and len(want) > 5000
    assert sorted(longread.pair_links(align, 1).where("qname = 2").collect()) == sorted(x for x in want if x.qname == 2)


def test_draws_are_followed_between_fragments_only():
    votes = [(0, 1, 9, 9), (1, 2, 0, 9), (0, 3, 0, 9)]
    assert regress.orient(4, votes, 5).tolist() == [1, 1, -1, -1]
    assert regress.orient(4, votes, 5, draws=False).tolist()[3] == -1


def no_votes():
    return pd.DataFrame({"c1": [], "c2": [], "n_pos": [], "n_neg": []})


def test_fit_splits_where_support_ends():
    d = planted(12)
    d = d[~((d.c1 < 6) & (d.c2 >= 6))]
    bad = pd.DataFrame([(5, 6, -1, 1050.0, 1.0, 4.0), (4, 7, -1, 3150.0, 1.0, 4.0)], columns=d.columns)  # against the orientation
    got = regress.fit(list(range(12)), pd.concat([d, bad]), no_votes(), 100.0, 5)
    assert {(r["scaffold"], r["node"]) for r in got} == {(0 if i < 6 else 6, i) for i in range(12)}
    assert all(abs(r["x"] - 1050 * (r["node"] - r["scaffold"])) < 60 for r in got)


def test_fit_gives_up_as_single_fragments():
    d = pd.DataFrame([(0, 1, 1, 100.0, 1.0, 1.0), (1, 2, 1, 100.0, 1.0, 1.0), (0, 2, 1, 9000.0, 1.0, 1.0)], columns=["c1", "c2", "cons", "y", "w", "v"])
    got = regress.fit([0, 1, 2], d, no_votes(), 1.0, 5, max_fits=1)
    assert sorted(r["scaffold"] for r in got) == [0, 1, 2] and all(r["x"] == 0 for r in got)


def test_trimming_up_to_the_bound_keeps_ties():
    # four rows of one pair: two agree, two are off by the same residual
    d = pd.DataFrame([(0, 1, 1, y, 1.0, 1.0) for y in (100.0, 100.0, 400.0, 400.0)], columns=["c1", "c2", "cons", "y", "w", "v"])
    strict, loose = (regress.fit([0, 1], d, no_votes(), 10.0, 5, strict=s, max_fits=3) for s in (True, False))
    assert sorted(r["scaffold"] for r in strict) == [0, 1]  # every residual is the bound: nothing is under it
    assert sorted(r["scaffold"] for r in loose) == [0, 1] and len(loose) == 2


def test_std_follows_the_intervals_of_reversed_fragments():
    d = planted(3, flips={1})
    votes = pd.DataFrame([(0, 1, 0, 9), (1, 2, 0, 9), (0, 2, 9, 0)], columns=["c1", "c2", "n_pos", "n_neg"])
    got = {r["node"]: r for r in regress.fit([0, 1, 2], d, votes, 100.0, 5, lengths={0: 1000, 1: 2500, 2: 1000})}
    # the reversed fragment reaches from -1450 to 1050, so it is the first one and the last has no gap behind it
    assert got[1]["orient"] == -1 and got[1]["std"] > 0 and got[2]["std"] == 0


def test_spanning_tree_takes_the_heavier_votes():
    votes = [(0, 1, 0, 30), (1, 2, 20, 0), (0, 2, 5, 0), (3, 4, 0, 2)]
    assert regress.spanning_orient(5, votes).tolist() == [1, -1, -1, 1, -1]
    assert regress.spanning_orient(2, [(0, 1, 0, 0)]).tolist() == [1, 1]


def brute_energy(n, votes, d):
    return sum(d[i] * d[j] * (p - m) for i, j, p, m in votes)


def test_flips_never_lower_the_sum():
    r = np.random.default_rng(7)
    for _ in range(60):
        n = int(r.integers(2, 9))
        votes = [(i, j, int(r.integers(0, 9)), int(r.integers(0, 9))) for i in range(n) for j in range(i + 1, n) if r.random() < 0.7]
        for full in (False, True):
            d = regress.orient(n, votes, 3, full)
            assert set(d.tolist()) <= {1, -1}
            if full:  # the field is the real gain then, so no flip is left that would raise the sum
                best = brute_energy(n, votes, d)
                for i in range(n):
                    e = d.copy()
                    e[i] = -e[i]
                    assert brute_energy(n, votes, e) <= best


def test_pieces_are_connected_and_within_the_cap(spark):
    edges = [(i, i + 1) for i in range(300)] + [(i, i + 2) for i in range(0, 299, 3)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5000, 5001)]
    frame = spark.createDataFrame(edges, "c1 long, c2 long")
    comp = connected_components(frame, "c1", "c2")
    got = {x.node: x.component for x in regress.bounded_pieces(comp, frame, 16).collect()}
    assert set(got) == {x for e in edges for x in e} and got[5001] == got[5000] == 5000
    parts = {}
    for node, c in got.items():
        parts.setdefault(c, set()).add(node)
    for c, nodes in parts.items():
        assert min(nodes) == c and len(nodes) <= 16
        reached, todo = {c}, [c]
        while todo:
            a = todo.pop()
            for x, y in edges:
                for p, q in ((x, y), (y, x)):
                    if p == a and q in nodes and q not in reached:
                        reached.add(q)
                        todo.append(q)
        assert reached == nodes
    assert sum(len(p) > 4 for p in parts.values() if min(p) < 1000) >= 15  # pieces grow, they do not stay single


def test_rounds_do_not_multiply_the_estimated_size(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "c1 long, c2 long")
    comp = spark.createDataFrame([(i, 0) for i in range(61)], "node long, component long")
    linked = connected_components(chain.select(F.col("c1").alias("src"), F.col("c2").alias("dst")))
    for df in (regress.bounded_pieces(comp, chain, 8), linked):
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**100


def test_components_over_the_cap_are_solved_in_pieces(spark):
    from weftline.plans.queries import Data

    d = Data(spark, "/root/testdata/sf0.001")
    laid = scaffolding.contig_layout(d.obs, d.libraries, d.contigs, scaffolding.Options(component_cap=4))[0].collect()
    by = {}
    for x in laid:
        by.setdefault(x.scaffold_id, []).append(x)
    assert len(laid) == 200 and max(map(len, by.values())) == 4
    for rs in by.values():
        first = min(rs, key=lambda x: x.contig_id)
        assert all(abs(x.start - first.start - 1050 * (x.contig_id - first.contig_id)) <= 60 for x in rs)


def test_strands_split_conflicts_and_rejoin_singles():
    start, end = [0.0, 10.0, 1000.0, 2050.0, 3100.0], [900.0, 910.0, 2000.0, 3000.0, 4000.0]
    links = {1: {3: 9}, 3: {1: 9, 4: 8}, 4: {3: 8, 5: 7}, 5: {4: 7}}
    assert sorted(layout.strands_of([1, 2, 3, 4, 5], start, end, links, 3000, 15, 6)) == [[0, 2, 3, 4], [1]]
    # 2 is passed over but joins the chain of its most-linked fragment where it overlaps nothing
    start[1], end[1] = 4100.0, 4900.0
    order = [0, 2, 3, 4, 1]
    ids = [[1, 2, 3, 4, 5][k] for k in order]
    far = links | {2: {1: 7}, 1: {3: 9, 2: 7}}
    got = layout.strands_of(ids, [start[k] for k in order], [end[k] for k in order], far, 3000, 15, 6)
    assert got == [[0, 1, 2, 3, 4]]


def test_neighbourhood_with_one_very_long_fragment(spark):
    r = np.random.default_rng(4)
    at = r.integers(0, 20_000, 60).tolist()
    rows = [(1, i, float(s), float(s + r.integers(50, 400))) for i, s in enumerate(at)] + [(1, 100, -500.0, 90_000.0), (2, 101, 0.0, 10.0), (2, 102, 5.0, 8.0)]
    lay = spark.createDataFrame(rows, "scaffold_id long, contig_id long, start double, end double")
    got = {(x.contig_id_i, x.contig_id_j) for x in layout.neighbourhood(lay, F.lit(300.0)).collect()}
    order = sorted(rows, key=lambda x: (x[0], x[2], x[3], x[1]))
    assert got == {(a[1], b[1]) for k, a in enumerate(order) for b in order[k + 1 :] if a[0] == b[0] and b[2] < a[3] + 300}


def test_prune_read():
    assert longread.prune_read([0, 50, 500], [100, 200, 600], [2000, 500, 400]) == [True, False, True]
    assert longread.prune_read([0, 50], [100, 200], [500, 2000]) == [False, True]


def test_sequences(spark):
    d = spark.createDataFrame([(1, "NNACnNNGT"), (2, "ACGT")], "scaffold_id long, seq string")
    got = [(r.scaffold_id, r.seq, r.n_gap, r.contig_id) for r in sequence.cut_at_n(d).orderBy("contig_id").collect()]
    assert got == [(1, "", 2, 1), (1, "ACn", 2, 2), (1, "GT", 0, 3), (2, "ACGT", 0, 4)]
    assert d.select(sequence.revcomp(F.lit("aXCGt")).alias("x")).first().x == "ACGXT"
    assert d.select(sequence.wrapped(F.lit("A" * 200)).alias("x")).first().x == "A" * 100 + "\n" + "A" * 100


def test_merge_pair():
    r = np.random.default_rng(3)
    s = "".join(r.choice(list("ACGT"), 400))
    assert merge.merge_pair(s[:230], s[170:], 200, 40, 80) == s
    assert merge.merge_pair(s[:200], s[200:], 150, 0, 80) is None
    gap = s[:200] + s[201:230]  # one base of the overlap lost
    assert merge.banded(gap, s[170:], 40, 80)[0] == 59 - 5


def plain_chain(seq, start, end, std, max_sd):
    """One pair after the other on whole texts: (fragments, start, end, std, text) of each unit."""
    out, left = [], ([0], start[0], end[0], std[0], seq[0])
    for k in range(1, len(seq)):
        overlap, spread, merged = left[2] - start[k], max(left[3], std[k], max_sd), None
        low, up = max(int(overlap - spread), 0), int(overlap + spread)
        if overlap <= 10_000 and up > 0:
            merged = merge.merge_pair(left[4], seq[k], int(overlap) + max(500, int(overlap) - low, up - int(overlap)), low, up)
        if merged is None:
            out.append(left)
            left = ([k], start[k], end[k], std[k], seq[k])
        else:
            left = (left[0] + [k], left[1], end[k], float(np.sqrt((left[3] ** 2 + std[k] ** 2) / 2)), merged)
    return [*out, left]


def test_chains_merge_from_left_to_right_like_whole_texts(spark):
    r = np.random.default_rng(6)
    letters = list("ACGT")
    seqs, rows, want = [], [], []
    for s in range(30):
        text = "".join(r.choice(letters, 3000))
        at, seq, start = 0, [], []
        while at < 2600:
            size = int(r.integers(60, 700))
            piece = list(text[at : at + size])
            for _ in range(int(r.integers(0, 4))):  # mismatches, lost and added bases, mostly near the ends
                place = int(r.choice([r.integers(0, 60), len(piece) - 1 - r.integers(0, 40)]))
                if 0 <= place < len(piece):
                    piece[place : place + int(r.integers(0, 3))] = r.choice(letters, int(r.integers(0, 4))).tolist()
            seq.append("".join(piece))
            start.append(float(at + r.integers(-9, 10)))
            at += max(size - int(r.integers(0, 130)), 20)
        std = r.choice([0.0, 3.5, 12.0, 40.0], len(seq)).tolist()
        end = [a + len(x) for a, x in zip(start, seq)]
        order = sorted(range(len(seq)), key=lambda k: (start[k], end[k], k))
        seq, start, end, std = ([x[k] for k in order] for x in (seq, start, end, std))
        direct = r.choice(["F", "R"], len(seq)).tolist()
        turn = str.maketrans("ACGT", "TGCA")
        for k, x in enumerate(seq):
            rows.append((s, s * 1000 + k, start[k], end[k], std[k], direct[k], len(x)))
            seqs.append((s * 1000 + k, x if direct[k] == "F" else x[::-1].translate(turn)))
        for u in plain_chain(seq, start, end, std, 15.0):
            want.append((s, "+".join(str(s * 1000 + k) for k in u[0]), u[1], u[2], round(u[3], 9), direct[u[0][0]] if len(u[0]) == 1 else "F", u[4]))
    lay = spark.createDataFrame(rows, "scaffold_id long, contig_id long, start double, end double, std double, direct string, len long")
    got = merge.merged_units(lay, spark.createDataFrame(seqs, "contig_id long, seq string"), 15.0).collect()
    assert sorted((x.scaffold_id, x.ids, x.start, x.end, round(x.std, 9), x.direct, x.seq) for x in got) == sorted(want)
    assert any(len(x.ids.split("+")) > 3 for x in got) and len(got) < len(rows)


def table_of(a, b, low, high):
    """The full table of best local scores that end at each cell of the band."""
    n, m = len(a), len(b)
    h = np.zeros((n + 1, m + 1), int)
    ok = lambda p, q: n - high <= p - q <= n - low
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if ok(i, j):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -2), (h[i - 1, j] - 5) if ok(i - 1, j) else 0, (h[i, j - 1] - 5) if ok(i, j - 1) else 0)
    return h


def end_to_end(a, b):
    """Best score of a and b aligned from end to end."""
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    h[0], h[:, 0] = -5 * np.arange(len(b) + 1), -5 * np.arange(len(a) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -2), h[i - 1, j] - 5, h[i, j - 1] - 5)
    return h[-1, -1]


def test_texts_of_documents_are_not_dealt_out(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b " * 100_000) for i in range(2)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plans = []
    cut = queries.checkpointed
    with pytest.MonkeyPatch.context() as m:
        m.setattr(queries, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df.limit(0)))
        queries.QUERIES["overlap_merge"](spark, str(tmp_path))
    below = plans[0].split("RepartitionByExpression")[1]
    assert "sha2" in below  # the hash is taken before rows are dealt out


def test_banded_alignments_like_the_full_table():
    r = np.random.default_rng(5)
    pairs = []
    for k in range(150):
        a, b = ("".join(r.choice(list("ACGT"), r.integers(1, 45))) for _ in range(2))
        if k % 2:  # an overlap with an edit
            shared = list("".join(r.choice(list("ACGT"), 30)))
            other = shared[:14] + [["", "A", "AC", "GTA"][k % 4]] + shared[14 + k % 3 :]
            a, b = a + "".join(shared), "".join(other) + b
        low = int(r.integers(0, 20))
        pairs.append((a, b, low, low + int(r.integers(0, 40))))
    pairs += [("A", "A", 0, 5), ("ACGT", "", 0, 4), ("ACGT", "ACGT", 9, 4), ("ACGTACGT", "ACGT", 30, 40)]
    got = merge.aligned([(a.encode(), b.encode(), lo, hi) for a, b, lo, hi in pairs])
    for (a, b, low, high), (score, i0, i1, j0, j1) in zip(pairs, got.tolist()):
        assert merge.banded(a, b, low, high) == (score, i0, i1, j0, j1)  # alone as among others
        h = table_of(a, b, low, high) if a and b else np.zeros((1, 1), int)
        assert score == h.max()
        if score:
            i, j = min(zip(*np.nonzero(h == score)))
            assert (i1, j1) == (i, j) and end_to_end(a[i0:i1], b[j0:j1]) >= score
        else:
            assert (i0, i1, j0, j1) == (0, 0, 0, 0)


def test_config_and_evidence(spark):
    c = readers.parse_config("# library_name, type\nfrag, PE, 800, 10, a.fq, b.fq\nlong, 3GS, 0, 0, c.fa, -\n# parameters\nthreads, 8\n")
    assert [x[:3] for x in c.libraries] == [("frag", "PE", "800"), ("long", "3GS", "0")] and c.parameters["threads"] == "8"
    # headings list their fields or explain them; names are those of the templates
    for heading in ("# parameters", "# parameters (thread: the number of threads; reg_m: links; ScafIter: rounds)"):
        c = readers.parse_config(f"# library_name, type, insert_size\n2k, MP,  2000, 200, a, b\nP1, 3GS, 0, 0, c, NA\n\n{heading}\nthread, 40\nreg_m, 15\nScafIter, 3\n")
        o = scaffolding.Options.of(c, max_error=80.0)
        assert c.classes() == {"PE": [], "MP": ["2k"], "3GS": ["P1"]} and (o.min_links, o.rounds, o.max_error) == (15, 3, 80.0)
    assert scaffolding.Options.of(readers.parse_config("")).min_links == 12
    assert [tuple(r) for r in c.frame(spark).collect()] == [("2k", "MP", 2000, 200.0), ("P1", "3GS", 0, 0.0)]
    lines = ["s1\t900\t2", "1\tf\t300\t0\t50\t0", "2\tf\t400\t0\t0\t0", "~~~~~", "s2\t10\t1", "3\tf\t10\t0\t0\t0"]
    got = readers.parse_evidence(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")).orderBy("contig_id").collect()
    assert [(r.scaffold_id, r.ord, r.contig_id, r.pos) for r in got] == [(1, 0, 1, 0), (1, 1, 2, 350), (2, 0, 3, 0)]


def test_text_round_trips(spark, tmp_path):
    seqs = spark.createDataFrame([("a", "ACGT" * 60), ("b", "NNAC")], "name string, seq string")
    sinks.fasta_lines(seqs).coalesce(1).write.text(str(tmp_path / "f"))
    assert {(r.name, r.seq) for r in readers.read_fasta(spark, str(tmp_path / "f")).collect()} == {("a", "ACGT" * 60), ("b", "NNAC")}
    (tmp_path / "detail.txt").write_text("contig1\t1\t500\ncontig2\t1\t700\n")
    assert [(r.contig_id, r.len) for r in readers.read_contigs(spark, str(tmp_path / "detail.txt")).collect()] == [(1, 500), (2, 700)]


def test_streaming_counts_match_batch(spark, tmp_path):
    from weftline.streaming.link_counts import streaming_link_counts

    libs = spark.createDataFrame(LIBS, LIBRARIES)
    rows = [("PE", 1, 100, 200, 2, 300, 200)] * 3 + [("MP", 2, 200, 100, 3, 200, 300)] * 2
    spark.createDataFrame(rows, PAIRS).write.parquet(str(tmp_path / "in"))
    stream = streaming_link_counts(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")), libs)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    got = {tuple(r) for r in spark.sql("select * from counts").collect()}
    q.stop()
    assert got == {tuple(r) for r in links.link_counts(links.link_observations(spark.createDataFrame(rows, PAIRS), libs)).collect()}


def test_windows_of_a_stream_close(spark, tmp_path):
    from weftline.streaming.link_counts import windowed_link_counts

    libs = spark.createDataFrame(LIBS, LIBRARIES)
    folder, schema = str(tmp_path / "in"), PAIRS + ", at timestamp"

    def arrive(*minutes):
        rows = [("PE", 1, 100, 200, 2, 300, 200, m) for m in minutes]
        spark.createDataFrame(rows, PAIRS + ", m long").selectExpr("* except (m)", "timestamp_seconds(m * 60) as at").coalesce(1).write.mode("append").parquet(folder)

    arrive(0, 1, 11)
    stream = windowed_link_counts(spark.readStream.schema(schema).parquet(folder), libs, "at", "10 minutes", "5 minutes")
    q = stream.writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    arrive(40)  # closes the first two windows
    q.processAllAvailable()
    arrive(2, 41)  # one comes too late
    q.processAllAvailable()
    got = sorted((int(r.start.timestamp()) // 60, r.c1, r.c2, r.n) for r in spark.sql("select * from windows").collect())
    q.stop()
    assert got == [(0, 1, 2, 2), (0, 2, 1, 2), (10, 1, 2, 1), (10, 2, 1, 1)]
    whole = windowed_link_counts(spark.read.schema(schema).parquet(folder), libs, "at", "10 minutes", "5 minutes")
    assert sorted((int(r.start.timestamp()) // 60, r.c1, r.n) for r in whole.collect()) == [(0, 1, 3), (0, 2, 3), (10, 1, 1), (10, 2, 1), (40, 1, 2), (40, 2, 2)]


def test_lines_of_texts_in_pieces(spark):
    r = np.random.default_rng(9)
    texts = {k: "".join(r.choice(list("ACGTN"), n)) for k, n in enumerate((0, 1, 99, 100, 101, 250, 1000, 4321))}
    rows = []
    for k, text in texts.items():
        ends = sorted({0, len(text), *r.integers(0, len(text) + 1, 9).tolist()})
        rows += [(f"s{k}", a, text[a:b]) for a, b in zip(ends, ends[1:])] + [(f"s{k}", 0, "")]
    pieces = spark.createDataFrame(rows, "name string, offset long, seq string")
    got = {}
    for x in sinks.fasta_rows(pieces, pieces.select("name").distinct()).collect():
        got.setdefault(x.name, {})[x.line] = x.value
    for k, text in texts.items():
        want = {-1: f">s{k}"} | {i // 100: text[i : i + 100] for i in range(0, len(text), 100)}
        assert got[f"s{k}"] == want


def test_fasta_pieces_across_splits(spark, tmp_path):
    r = np.random.default_rng(2)
    records = [("".join(r.choice(list("ACGTN"), int(n)))) for n in (0, 1, 99, 100, 101, 5000, 40_000, 0, 0, 700, 3)]
    names = [f"r{k} > x > y" if k % 2 else f"r{k}" for k in range(len(records))]
    lines = [x for n, q in zip(names, records) for x in [">" + n, *(q[i : i + 100] for i in range(0, len(q), 100))]]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.fa").write_text("lost before any heading\n" + "\n".join(lines) + "\n")
    (tmp_path / "f" / "b.fa").write_text(">r1\r\nac gt\r\n\r\nNN")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("700b", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            for piece in (64, 100, 1 << 20):
                rows = readers.fasta_pieces(spark, str(tmp_path / "f"), piece).collect()
                assert max(len(x.seq) for x in rows) <= piece
                by = {}
                for x in sorted(rows, key=lambda x: (x.file, x.record, x.offset, len(x.seq))):
                    name, text = by.setdefault((x.file[-4:], x.record), (x.name, ""))
                    assert x.offset == len(text) and x.name == name
                    by[x.file[-4:], x.record] = (name, text + x.seq)
                want = {("a.fa", k + 1): (n, q) for k, (n, q) in enumerate(zip(names, records))} | {("b.fa", 1): ("r1", "acgtNN")}
                assert by == want
            assert sorted((x.name, x.seq) for x in readers.read_fasta(spark, str(tmp_path / "f")).collect()) == sorted([*zip(names, records), ("r1", "acgtNN")])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_newest_layout_of_a_fragment_counts(spark, tmp_path):
    import os

    head = "longest position is 9.0\n"
    for k, (name, text) in enumerate((("b", "1 0.0 5.0 F 1.0 0.0 5\n2 6.0 9.0 R 1.0 0.0 3\n"), ("c", "2 0.0 3.0 F 1.0 0.0 3\n3 4.0 9.0 F 1.0 0.0 5\n"), ("a", "2 7.0 10.0 R 1.0 0.0 3\n"))):
        (tmp_path / name).write_text(head + text)
        os.utime(tmp_path / name, (1_700_000_000 + 10 * min(k, 1),) * 2)  # the last two at the same time: by name
    lay = readers.read_layouts(spark, str(tmp_path))
    assert lay.count() == 5
    got = sorted((x.contig_id, x.scaffold_id, x.start, x.direct) for x in layout.last_wins(lay, *superscaffold.FILE).collect())
    assert got == [(1, 1, 0.0, "F"), (2, 2, 0.0, "F"), (3, 2, 4.0, "F")]
    obs = spark.createDataFrame([("PE", "PE", 1, 2, 1, 9.0), ("PE", "PE", 2, 3, 1, 4.0)], "lib string, lib_type string, c1 long, c2 long, cons int, diff double")
    once = superscaffold.scaffold_offsets(obs, lay).collect()
    assert [(x.s1, x.s2, x.diff) for x in once] == [(1, 2, 9.0)]


def test_layouts_of_many_scaffolds_share_files_and_splits(spark, tmp_path):
    rows = [(k, 10 * k + i, 100.0 * i, 100.0 * i + 90, "FR"[i % 2], 1.0, 90) for k in range(200) for i in range(1, 1 + k % 5)]
    lay = layout.gaps(spark.createDataFrame(rows, LAYOUT))
    path = str(tmp_path / "layouts")
    sinks.layout_text(lay).write.text(path)
    assert len(list((tmp_path / "layouts").glob("part-*"))) <= 4  # one for every scaffold before
    conf = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.minPartitionNum": "40"}  # a scaffold goes on in the next split
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = sorted((x.scaffold_id, x.contig_id, x.start, x.end, x.direct, x.std, x.len) for x in readers.read_layouts(spark, path).collect())
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert got == sorted((10 * r[0] + 1, *r[1:]) for r in rows)


# ---- places, runs, texts of a run ----
def test_numbers_and_running_sums_agree_with_one_window(spark):
    r = np.random.default_rng(8)
    rows = [(int(x), float(v)) for x, v in zip(r.permutation(5000), r.random(5000))]
    df = spark.createDataFrame(rows, "line long, v double").repartition(7)
    got = {x.line: x.n for x in ordering.numbered(df, "line").collect()}
    assert got == {i: i + 1 for i in range(5000)}
    flags = df.withColumn("f", (F.col("line") % 7 == 0).cast("int"))
    assert {x.line: x.s for x in ordering.running_sum(flags, "f", "line", "s", block=64).collect()} == {i: i // 7 + 1 for i in range(5000)}
    sparse = flags.withColumn("line", F.col("line") * 10**8)
    sums = ordering.running_sum(sparse, "f", "line", "s", block=64)
    assert {x.line: x.s for x in sums.collect()} == {i * 10**8: i // 7 + 1 for i in range(5000)}
    assert ordering.numbered(df.limit(0), "line").count() == 0


def test_percentiles_of_groups_of_any_size(spark):
    r = np.random.default_rng(9)
    rows = [("a", float(x)) for x in r.integers(0, 40, 3000)] + [("b", 5.0), ("c", 1.0), ("c", 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    ranks = ordering.ranked(df, "g", "x")
    for p in (0.0, 0.1, 0.5, 0.75, 1.0):
        got = {q.g: q.v for q in ordering.percentile_of(ranks, "g", "x", p, "v").collect()}
        want = {g: np.percentile([v for k, v in rows if k == g], p * 100) for g in "abc"}
        assert got == pytest.approx(want)
    assert ordering.percentile(df, "x", 0.5).first()[0] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert {q.g: q.madn for q in stats.madn(df, "g", "x").collect()}["c"] == pytest.approx(0.5 / 0.675)


def test_runs_cross_batches_and_keep_their_order(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).select((F.col("id") % 9).alias("g"), F.col("id").alias("v"), F.col("id").cast("string").alias("t"))
        seen = lambda g: {"g": g["g"][:1], "n": np.array([len(g["v"])]), "ok": np.array([bool((np.diff(g["v"]) < 0).all())]), "t": g["t"][:1]}
        got = by_runs(df.withColumn("w", -F.col("v")), ["g"], ["w"], seen, "g long, n long, ok boolean, t string").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.g: (r.n, r.ok, int(r.t) % 9) for r in got} == {g: (len(range(g, 500, 9)), True, g) for g in range(9)}


def test_cut_without_empty_pieces_and_with_text_names(spark):
    d = spark.createDataFrame([("b", "NNACNNGTN"), ("a", "ACGT"), ("c", "NNN")], "scaffold_id string, seq string")
    got = [(r.scaffold_id, r.seq, r.n_gap, r.contig_id) for r in sequence.cut_at_n(d, drop_empty=True).orderBy("contig_id").collect()]
    assert got == [("a", "ACGT", 0, 1), ("b", "AC", 2, 2), ("b", "GT", 1, 3)]


def test_run_writes_merged_fragments_gaps_and_breaks(spark, tmp_path):
    r = np.random.default_rng(10)
    s = "".join(r.choice(list("ACGT"), 900))
    seqs = spark.createDataFrame([(1, s[:500]), (2, sequence_reversed(s[440:900])), (3, "A" * 350), (4, "C" * 320), (9, "G" * 120)], "contig_id long, seq string")
    lay = spark.createDataFrame([(1, 1, 0.0, 500.0, "F", 5.0, 500), (1, 2, 440.0, 900.0, "R", 5.0, 460), (1, 3, 930.0, 1280.0, "F", 5.0, 350), (1, 4, 9000.0, 9320.0, "F", 5.0, 320)], "scaffold_id long, contig_id long, start double, end double, direct string, std double, len long")
    small = spark.createDataFrame([(9, 120)], CONTIGS)
    got = scaffolding.sequences(lay, small, seqs, 3000, 15, scaffolding.Options())
    text = {x.name: x.seq for x in got["fasta"].collect()}
    assert text == {"scaffold1": s + "N" * 30 + "A" * 350, "scaffold2": "C" * 320, "scaffold3": "G" * 120}
    scaffolding.write_run(got | {"layout": lay}, str(tmp_path / "out"))
    lines = lambda name: [x.value for x in readers.read_lines(spark, str(tmp_path / "out" / name)).orderBy("line_no").collect()]
    assert lines("log") == [">scaffold1", "NewCtg1+2", "N* 30", "contig3", "too long gap", ">scaffold2", "contig4", "N* 0", ">scaffold3", "contig9"]
    assert lines("evidence") == [">scaffold1|size1280|tigs3", "f_tig1|size500|links10|gaps-60p-360P240", "r_tig2|size460|links10|gaps30p-270P330", "f_tig3|size350|links10|gaps0p-300P300", ">scaffold2|size320|tigs1", "f_tig4|size320|links10|gaps0p-300P300", ">scaffold3|size120|tigs1", "f_tig9|size120|links10|gaps0p0P0"]
    log = readers.parse_scaffold_log(readers.read_lines(spark, str(tmp_path / "out" / "log"))).collect()
    assert sorted((x.scaffold_id, x.kind, x.contig_id) for x in log) == [(1, "contig", 3), (1, "merged", 1), (1, "merged", 2), (2, "contig", 4), (3, "contig", 9)]
    back = {x.name: x.seq for x in readers.read_fasta(spark, str(tmp_path / "out" / "fasta")).collect()}
    assert back == text


def sequence_reversed(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_components_write_few_files_for_few_edges(spark):
    from weftline.operators.components import connected_components

    edges = spark.range(300).selectExpr("id as src", "id + 1 as dst").where("src % 3 > 0")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        made = []
        write = type(edges).checkpoint
        type(edges).checkpoint = lambda self, *a, **k: made.append(out := write(self, *a, **k)) or out
        got = {r.node: r.component for r in connected_components(edges, rows=200).collect()}
    finally:
        type(edges).checkpoint = write
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == {i: i - (i - 1) % 3 for i in range(1, 301)}
    assert made and all(d.rdd.getNumPartitions() == 1 for d in made)
