"""Orientation and robust regression of one component, and their grouped application.

Only aggregated rows reach a component's task: cluster rows of both orientations (clusters do not depend on the
orientation, so they are formed before it is known) and votes. Components over the cap are cut into connected pieces
by Spark first, so the cap bounds what a task holds. Weights and variances stay vectors; the normal matrix is the
weighted Laplacian with the first node held at 0, factored by levels of distance from it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.runs import by_runs

from .components import checkpointed


def orient(n: int, votes: list[tuple[int, int, int, int]], min_links: int, full_field: bool = False, draws: bool = True) -> np.ndarray:
    """+1 / -1 per node 0..n-1 from votes (i, j, pos, neg): heaviest-first search from node 0, then single flips.

    A vote's sign counts in the search when its stronger side has over min_links votes; a draw counts as +1 with `draws`
    (between fragments), and is not followed without (between scaffolds). Nodes that the search does not reach are +1. Flips
    follow the field d_i * sum over j > i of J_ij d_j (with full_field, over all j), the most negative first, while there is
    one and the sum of J d d grows; none are made where that sum is -100 or less after the search. Ties: the smallest node.
    """
    d = np.ones(n, int)
    if not n:
        return d
    near: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    around: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i, j, pos, neg in votes:
        weight, total = max(pos, neg), pos - neg
        for a, b in ((i, j), (j, i)):
            if weight > min_links and (total or draws):
                near[a].append((-weight, b, 1 if total >= 0 else -1))
            around[a].append((b, total))
    for x in near:
        x.sort()
    seen, stack = {0}, [(0, iter(near[0]))]
    while stack:
        node, rest = stack[-1]
        step = next(rest, None)
        if step is None:
            stack.pop()
        elif step[1] not in seen:
            seen.add(step[1])
            d[step[1]] = step[2] * d[node]
            stack.append((step[1], iter(near[step[1]])))
    counts = lambda i, j: full_field or j > i
    field = np.array([d[i] * sum(t * d[j] for j, t in around[i] if counts(i, j)) for i in range(n)], float)
    if sum(t * d[i] * d[j] for i in range(n) for j, t in around[i] if j > i) <= -100:
        return d
    while True:
        i = int(np.argmin(field))
        if field[i] >= 0 or sum(t * d[i] * d[j] for j, t in around[i]) >= 0:  # what the sum loses twice by the flip
            return d
        d[i] = -d[i]
        field[i] = -field[i]
        for j, t in around[i]:
            if counts(j, i):
                field[j] += 2 * t * d[j] * d[i]


def spanning_orient(n: int, votes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Orientation along a maximum spanning tree of the votes (Kruskal); an alternative to `orient`."""
    root, tree = list(range(n)), [[] for _ in range(n)]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j, pos, neg in sorted(votes, key=lambda v: (-max(v[2], v[3]), v[0], v[1])):
        a, b = find(i), find(j)
        if a != b and pos + neg:
            root[a] = b
            s = 1 if pos >= neg else -1
            tree[i].append((j, s))
            tree[j].append((i, s))
    d, stack, seen = np.ones(n, int), [], set()
    for r in range(n):
        if r not in seen:
            seen.add(r)
            stack.append(r)
            while stack:
                a = stack.pop()
                for b, s in tree[a]:
                    if b not in seen:
                        seen.add(b)
                        d[b] = s * d[a]
                        stack.append(b)
    return d


class NormalMatrix:
    """X'WX of rows x_j - x_i with x_0 held at 0, for a connected graph.

    Nodes are taken by their distance from node 0: rows join only nodes of one level or of neighbouring ones, so the
    matrix is block tridiagonal. A chain of fragments has many small blocks; up to `dense` nodes are one block.
    """

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, dense: int = 150):
        self.n = n
        level = np.ones(n, int)
        level[0] = 0
        if n > dense:
            level = levels(n, i, j)
        self.order = np.argsort(level, kind="stable")[1:]
        ends = np.flatnonzero(np.diff(level[self.order])) + 1
        self.cuts = [0, *ends.tolist(), n - 1]
        self.place = np.full(n, -1)
        self.place[self.order] = np.arange(n - 1)
        own, self.below = self.blocks(i, j, w)
        self.inverse, self.carry = [], []
        for k, s in enumerate(own):
            if k:
                self.carry.append(self.below[k - 1] @ self.inverse[-1])
                s = s - self.carry[-1] @ self.below[k - 1].T
            self.inverse.append(np.linalg.inv(s))

    def blocks(self, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """X'WX of any rows between these levels: the blocks on the diagonal, and those below."""
        a, b = self.place[i], self.place[j]
        diagonal = np.bincount(np.r_[a, b][np.r_[a, b] >= 0], np.r_[w, w][np.r_[a, b] >= 0], self.n - 1)
        both = (a >= 0) & (b >= 0)
        low, high, w = np.minimum(a, b)[both], np.maximum(a, b)[both], w[both]
        by = np.argsort(high, kind="stable")
        low, high, w = low[by], high[by], w[by]
        on, below = [], []
        for k, (lo, hi) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            r = slice(*np.searchsorted(high, [lo, hi]))
            s = np.diag(diagonal[lo:hi])
            own = low[r] >= lo
            np.add.at(s, (high[r][own] - lo, low[r][own] - lo), -w[r][own])
            np.add.at(s, (low[r][own] - lo, high[r][own] - lo), -w[r][own])
            on.append(s)
            if k:
                before = self.cuts[k - 1]
                e = np.zeros((hi - lo, lo - before))
                np.add.at(e, (high[r][~own] - lo, low[r][~own] - before), -w[r][~own])
                below.append(e)
        return on, below

    def sandwich(self, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The blocks on and below the diagonal of A^-1 (X'WX) A^-1 for any rows between these levels.

        It is minus the derivative of (A + t X'WX)^-1 at t = 0, so the recursions for the inverse's own blocks (forward
        for the factors, backward for the inverse) are carried on with their derivatives; no other entry is formed.
        """
        d_on, d_below = self.blocks(i, j, w)
        p, e, count = self.inverse, self.below, len(self.inverse)
        dp = []
        for k in range(count):
            ds = d_on[k]
            if k:
                f = d_below[k - 1] @ p[k - 1] @ e[k - 1].T
                ds = ds - f - f.T - e[k - 1] @ dp[k - 1] @ e[k - 1].T
            dp.append(-p[k] @ ds @ p[k])
        g, dg = p[-1], dp[-1]
        on, below = [-dg], []
        for k in range(count - 2, -1, -1):
            m, dm = e[k] @ p[k], d_below[k] @ p[k] + e[k] @ dp[k]
            below.append(dg @ m + g @ dm)
            dg = dp[k] + dm.T @ g @ m + m.T @ dg @ m + m.T @ g @ dm
            g = p[k] + m.T @ g @ m
            on.append(-dg)
        return on[::-1], below[::-1]

    def solve(self, b: np.ndarray) -> np.ndarray:
        """A^-1 b with 0 for node 0, for one right side or several columns."""
        x = b[self.order].astype(float)
        spans = list(zip(self.cuts[:-1], self.cuts[1:]))
        for k in range(1, len(spans)):
            x[slice(*spans[k])] -= self.carry[k - 1] @ x[slice(*spans[k - 1])]
        for k in range(len(spans) - 1, -1, -1):
            own = slice(*spans[k])
            rest = x[own] - self.below[k].T @ x[slice(*spans[k + 1])] if k + 1 < len(spans) else x[own]
            x[own] = self.inverse[k] @ rest
        out = np.zeros(b.shape)
        out[self.order] = x
        return out


def levels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of steps from node 0 to each node."""
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(i.tolist(), j.tolist()):
        near[a].append(b)
        near[b].append(a)
    level, now, depth = np.full(n, -1), [0], 0
    level[0] = 0
    while now:
        depth += 1
        now = [b for b in dict.fromkeys(b for a in now for b in near[a]) if level[b] < 0]
        level[now] = depth
    return level


def solve(n: int, i: np.ndarray, j: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, NormalMatrix | None]:
    """Weighted least squares of x_j - x_i = y with x_0 = 0, and the factored normal matrix."""
    if n < 2:
        return np.zeros(n), None
    a = NormalMatrix(n, i, j, w)
    return a.solve(np.bincount(j, w * y, n) - np.bincount(i, w * y, n)), a


class Refit:
    """Solutions for a set of rows that changes a little from one to the next.

    The matrix is factored once; rows that have come or gone since are corrections of rank one, of which each needs one
    more solution with the factor, kept while the factor is (Woodbury's formula, and one step of refinement). With more than
    MOST changes the matrix is factored anew.
    """

    MOST = 64

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.n, self.i, self.j, self.y, self.w = n, i, j, y, w
        self.base: np.ndarray | None = None
        self.factored = 0

    def factor(self, keep: np.ndarray) -> NormalMatrix:
        """The factor of exactly these rows."""
        if self.base is None or (keep != self.base).any():
            self.base, self.a = keep.copy(), NormalMatrix(self.n, self.i[keep], self.j[keep], self.w[keep])
            self.at, self.z = {}, np.zeros((self.n, 0))
            self.factored += 1
        return self.a

    def solve(self, keep: np.ndarray) -> np.ndarray:
        i, j = self.i, self.j
        wy = np.where(keep, self.w * self.y, 0.0)
        b = np.bincount(j, wy, self.n) - np.bincount(i, wy, self.n)
        changed = np.flatnonzero(keep != self.base) if self.base is not None else np.zeros(0, int)
        if self.base is None or len(changed) > self.MOST:
            return self.factor(keep).solve(b)
        if not len(changed):
            return self.a.solve(b)
        new = [r for r in changed.tolist() if r not in self.at]
        if new:
            u = np.zeros((self.n, len(new)))
            u[j[new], np.arange(len(new))] += 1
            u[i[new], np.arange(len(new))] -= 1
            self.at |= {r: self.z.shape[1] + c for c, r in enumerate(new)}
            self.z = np.hstack([self.z, self.a.solve(u)])
        z = self.z[:, [self.at[r] for r in changed.tolist()]]
        sign = np.where(keep[changed], 1.0, -1.0) / self.w[changed]
        small = np.diag(sign) + z[j[changed]] - z[i[changed]]

        def corrected(right: np.ndarray) -> np.ndarray:
            x = self.a.solve(right)
            return x - z @ np.linalg.solve(small, x[j[changed]] - x[i[changed]])

        x = corrected(b)
        flow = np.where(keep, self.w * (x[j] - x[i]), 0.0)
        rest = b - np.bincount(j, flow, self.n) + np.bincount(i, flow, self.n)
        rest[0] = 0.0
        return x + corrected(rest)


def difference_variance(a: NormalMatrix, i: np.ndarray, j: np.ndarray, w: np.ndarray, v: np.ndarray, p: np.ndarray, q: np.ndarray, step: int = 64) -> np.ndarray:
    """Variance of x_q - x_p under the covariance A^-1 (X' W V W X) A^-1.

    Pairs within a level or in neighbouring ones read it from the blocks of the covariance that the factor gives; for
    others, which no row joins, a column each is solved, a few at a time.
    """
    out = np.zeros(len(p))
    if not len(p):
        return out
    on, below = a.sandwich(i, j, w * w * v)
    block = np.searchsorted(a.cuts, np.arange(a.n - 1), side="right") - 1
    diagonal = np.r_[np.concatenate([np.diag(c) for c in on]), 0.0]  # the last for node 0, which is held
    x, y = np.minimum(a.place[p], a.place[q]), np.maximum(a.place[p], a.place[q])
    out = diagonal[a.place[p]] + diagonal[a.place[q]]
    far = np.zeros(len(p), bool)
    for at in np.flatnonzero(x >= 0).tolist():
        kx, ky = block[x[at]], block[y[at]]
        if ky == kx:
            out[at] -= 2 * on[kx][x[at] - a.cuts[kx], y[at] - a.cuts[kx]]
        elif ky == kx + 1:
            out[at] -= 2 * below[kx][y[at] - a.cuts[ky], x[at] - a.cuts[kx]]
        else:
            far[at] = True
    others = np.flatnonzero(far)
    for at in range(0, len(others), step):
        own = others[at : at + step]
        cols = np.arange(len(own))
        b = np.zeros((a.n, len(cols)))
        b[p[own], cols] -= 1
        b[q[own], cols] += 1
        z = a.solve(b)
        out[own] = ((w * w * v)[:, None] * (z[j] - z[i]) ** 2).sum(axis=0)
    return np.maximum(out, 0.0)


def covariance(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, v: np.ndarray, a: NormalMatrix | None) -> np.ndarray:
    """The whole covariance; zero for node 0."""
    if a is None:
        return np.zeros((n, n))
    z = a.solve(np.eye(n) - np.eye(n)[:, :1] * (np.arange(n) == 0))
    rows = np.sqrt(w * w * v)[:, None] * (z[j] - z[i])
    return rows.T @ rows


def parts_of(n: int, i: np.ndarray, j: np.ndarray) -> list[list[int]]:
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(i.tolist(), j.tolist()):
        near[a].append(b)
        near[b].append(a)
    seen, out = [False] * n, []
    for r in range(n):
        if not seen[r]:
            seen[r], part = True, [r]
            for a in part:
                for b in near[a]:
                    if not seen[b]:
                        seen[b] = True
                        part.append(b)
            out.append(sorted(part))
    return out


def fit(nodes: list[int], rows: Mapping, votes: Mapping, tolerance: float, min_links: int, strict: bool = True, max_fits: int = 299, lengths: Mapping[int, float] | None = None, draws: bool = True) -> list[dict]:
    """Layouts of one component: list of {scaffold, node, x, orient, std}.

    Work list of node sets. A set is oriented, rows consistent with the orientation (cons = o1 o2) are taken, with
    y negated for a reversed first node; then fits alternate with trimming: k = 1 % of the rows (at least one) more
    go in each round, by the order statistic of the residuals of all rows, until the largest kept residual is within
    the tolerance. If the kept rows fall apart, the parts are put on the list instead; if the rows or rounds run
    out, the nodes become single layouts. strict keeps residuals under the bound, otherwise up to it. std is that of
    the gap to the next fragment, in order of the intervals that the lengths give.
    """
    column = lambda t, name, kind: np.asarray(t[name], kind)
    c1, c2 = column(rows, "c1", np.int64), column(rows, "c2", np.int64)
    cons, y0, w0, v0 = (column(rows, c, float) for c in ("cons", "y", "w", "v"))
    va, vb, pos, neg = (column(votes, c, np.int64) for c in ("c1", "c2", "n_pos", "n_neg"))
    out: list[dict] = []

    def single(node: int) -> None:
        out.append({"scaffold": node, "node": node, "x": 0.0, "orient": 1, "std": 0.0})

    everyone = np.array(sorted(nodes), np.int64)
    work = [everyone[p] for p in parts_of(len(everyone), np.searchsorted(everyone, c1), np.searchsorted(everyone, c2))]
    while work:
        own = np.asarray(work.pop(), np.int64)
        n = len(own)
        if n == 1:
            single(int(own[0]))
            continue
        inside = np.isin(va, own) & np.isin(vb, own)
        d = orient(n, list(zip(np.searchsorted(own, va[inside]).tolist(), np.searchsorted(own, vb[inside]).tolist(), pos[inside].tolist(), neg[inside].tolist())), min_links, draws=draws)
        take = np.flatnonzero(np.isin(c1, own) & np.isin(c2, own))
        i, j = np.searchsorted(own, c1[take]), np.searchsorted(own, c2[take])
        ok = cons[take] == d[i] * d[j]
        take, i, j = take[ok], i[ok], j[ok]
        y, w, v = y0[take] * d[i], w0[take], v0[take]
        keep, m = np.ones(len(take), bool), len(take)
        pair = np.unique(np.minimum(i, j) * n + np.maximum(i, j), return_inverse=True)[1]
        # the row that holds the first node counts among the rows, as one without residual
        k, done, pairs = max(1, math.floor((m + 1) * 0.01)), False, -1
        fits = Refit(n, i, j, y, w)
        for it in range(1, max_fits + 1):
            left = int((np.bincount(pair[keep], minlength=1) > 0).sum())
            if left != pairs:  # only the loss of a pair's last row can disconnect
                pairs, parts = left, parts_of(n, i[keep], j[keep])
                if len(parts) > 1:
                    work += [own[p] for p in parts]
                    done = True
                    break
            x = fits.solve(keep)
            r = np.abs(x[j] - x[i] - y)
            if r[keep].max() <= tolerance:
                length = np.array([lengths[int(c)] for c in own]) if lengths else np.zeros(n)
                place = np.lexsort((own, np.where(d > 0, x + length, x), np.where(d > 0, x, x - length)))
                std = np.zeros(n)
                std[place[:-1]] = np.sqrt(difference_variance(fits.factor(keep), i[keep], j[keep], w[keep], v[keep], place[:-1], place[1:]))
                out += [{"scaffold": int(own[0]), "node": int(own[p]), "x": float(x[p]), "orient": int(d[p]), "std": float(std[p])} for p in range(n)]
                done = True
                break
            if k * it >= m:
                break
            bound = np.sort(r)[m - k * it]
            keep = r < bound if strict else r <= bound
            if not keep.any():
                break
        if not done:
            for node in own.tolist():
                single(node)
    return out


def bounded_pieces(comp: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """comp (node, component), with components of over `cap` nodes cut into connected pieces of at most cap nodes.

    Nodes begin as pieces of their own. In each round the pieces toss a coin; a tail joins the neighbouring head that it
    has most edges with, and a head takes them in, the best linked first, while it stays within the cap. It ends when no
    two neighbouring pieces fit together. A piece is named by its smallest node.
    """
    sizes = comp.groupBy("component").agg(F.count("*").alias("k")).where(F.col("k") > cap)
    big = checkpointed(comp.join(sizes.select("component"), "component", "left_semi"))
    if big.isEmpty():
        return comp
    within = edges.select(F.col("c1").alias("src"), F.col("c2").alias("dst")).join(big.select(F.col("node").alias("src")), "src")
    within = checkpointed(within.unionByName(within.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    piece, toss = checkpointed(big.select("node", F.col("node").alias("piece"))), 0
    while True:
        toss += 1
        size = piece.groupBy("piece").agg(F.count("*").alias("k"))
        side = piece.join(size, "piece")
        a = side.select(F.col("node").alias("src"), F.col("piece").alias("a"), F.col("k").alias("ka"))
        b = side.select(F.col("node").alias("dst"), F.col("piece").alias("b"), F.col("k").alias("kb"))
        fits = within.join(a, "src").join(b, "dst").where(F.col("a") != F.col("b")).where(F.col("ka") + F.col("kb") <= cap)
        fits = checkpointed(fits.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("ka").alias("ka"), F.first("kb").alias("kb")), forget=True)
        if fits.isEmpty():
            break
        head = lambda c: F.pmod(F.xxhash64(c, F.lit(toss)), F.lit(2)) == 1
        wish = fits.where(~head("a") & head("b")).groupBy("a").agg(F.max_by(F.struct("b", "n", "ka", "kb"), F.struct("n", -F.col("b"))).alias("w"))
        wish = wish.select("a", "w.*").withColumn("room", F.sum("ka").over(Window.partitionBy("b").orderBy(F.desc("n"), "a")) + F.col("kb"))
        moves = wish.where(F.col("room") <= cap).select(F.col("a").alias("piece"), F.col("b").alias("to"))
        piece = checkpointed(piece.join(moves, "piece", "left").select("node", F.coalesce("to", "piece").alias("piece")), forget=True)
    names = piece.groupBy("piece").agg(F.min("node").alias("component"))
    cut = piece.join(names, "piece").select("node", "component")
    return comp.join(sizes.select("component"), "component", "left_anti").select("node", "component").unionByName(cut)


SOLVED = "scaffold_id long, contig_id long, x double, orient int, std double"
NODE, ROW, VOTE = 0, 1, 2


def _gathered(comp: DataFrame, votes: DataFrame, rows: DataFrame | None = None, contigs: DataFrame | None = None) -> DataFrame:
    """Nodes (with their lengths as w), cluster rows and votes of each component in one table, without nulls."""
    zero = lambda *names: [F.lit(0.0).alias(n) for n in names]
    a = comp.select(F.col("node").alias("c1"), "component")
    b = comp.select(F.col("node").alias("c2"), F.col("component").alias("k2"))
    nodes = comp.select("component", F.col("node").alias("contig_id"))
    if contigs is None:
        nodes = nodes.withColumn("len", F.lit(0.0))
    else:
        nodes = nodes.join(contigs.select("contig_id", F.col("len").cast("double").alias("len")), "contig_id", "left").fillna({"len": 0.0})
    out = nodes.select("component", F.lit(NODE).alias("kind"), F.col("contig_id").alias("c1"), F.lit(0).cast("long").alias("c2"), *zero("cons", "y"), F.col("len").alias("w"), *zero("v"))
    inside = lambda t: t.join(a, "c1").join(b, "c2").where("component = k2")
    if rows is not None:
        out = out.unionByName(inside(rows).select("component", F.lit(ROW).alias("kind"), "c1", "c2", F.col("cons").cast("double").alias("cons"), "y", "w", "v"))
    v = inside(votes.where("c1 < c2")).select("component", F.lit(VOTE).alias("kind"), "c1", "c2", *zero("cons", "y"), F.col("n_pos").cast("double").alias("w"), F.col("n_neg").cast("double").alias("v"))
    return out.unionByName(v)


def regress(comp: DataFrame, rows: DataFrame, votes: DataFrame, tolerance: float, min_links: int, strict: bool = True, cap: int = 3000, contigs: DataFrame | None = None, draws: bool = True) -> DataFrame:
    """Solve every component (node, component) from its cluster rows and votes: SOLVED."""
    comp = bounded_pieces(comp, rows, cap)

    def run(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        node, row, vote = (g["kind"] == k for k in (NODE, ROW, VOTE))
        obs = {c: g[c][row] for c in ("c1", "c2", "cons", "y", "w", "v")}
        said = {"c1": g["c1"][vote], "c2": g["c2"][vote], "n_pos": g["w"][vote], "n_neg": g["v"][vote]}
        got = fit(g["c1"][node].tolist(), obs, said, tolerance, min_links, strict, lengths=dict(zip(g["c1"][node].tolist(), g["w"][node].tolist())), draws=draws)
        col = lambda k, kind: np.array([r[k] for r in got], kind)
        return {"scaffold_id": col("scaffold", np.int64), "contig_id": col("node", np.int64), "x": col("x", float), "orient": col("orient", np.int32), "std": col("std", float)}

    return by_runs(_gathered(comp, votes, rows, contigs), ["component"], ["kind", "c1", "c2", "cons", "y", "w"], run, SOLVED)


def orientations(comp: DataFrame, votes: DataFrame, min_links: int, tree: bool = False, full_field: bool = False, cap: int = 3000) -> DataFrame:
    """(component, node, orient) of every component by `orient`, or along a spanning tree.

    A component over the cap is oriented in pieces of at most cap nodes. Then the pieces are the nodes of a smaller graph, whose
    votes are the sums of those between them as the pieces stand, and are turned as wholes in the same way (in pieces of
    pieces where these are too many), so that they agree with each other.
    """
    pieces = bounded_pieces(comp, votes.where("c1 < c2").where(F.greatest("n_pos", "n_neg") > min_links), cap)

    def run(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        node, vote = g["kind"] == NODE, g["kind"] == VOTE
        own = np.sort(g["c1"][node])
        votes_ = list(zip(np.searchsorted(own, g["c1"][vote]).tolist(), np.searchsorted(own, g["c2"][vote]).tolist(), g["w"][vote].astype(int).tolist(), g["v"][vote].astype(int).tolist()))
        d = spanning_orient(len(own), votes_) if tree else orient(len(own), votes_, min_links, full_field)
        return {"component": np.full(len(own), g["component"][0]), "node": own, "orient": d.astype(np.int32)}

    turned = by_runs(_gathered(pieces, votes), ["component"], ["kind", "c1", "c2"], run, "component long, node long, orient int")
    if pieces is comp:
        return turned
    turned = checkpointed(turned.withColumnRenamed("component", "piece").join(comp, "node"), forget=True)
    a = turned.select(F.col("node").alias("c1"), F.col("piece").alias("p1"), F.col("orient").alias("o1"), F.col("component").alias("k1"))
    b = turned.select(F.col("node").alias("c2"), F.col("piece").alias("p2"), F.col("orient").alias("o2"), F.col("component").alias("k2"))
    between = votes.where("c1 < c2").join(a, "c1").join(b, "c2").where("p1 <> p2 and k1 = k2")
    same = F.col("o1") == F.col("o2")
    sums = F.sum(F.when(same, F.col("n_pos")).otherwise(F.col("n_neg"))).alias("n_pos"), F.sum(F.when(same, F.col("n_neg")).otherwise(F.col("n_pos"))).alias("n_neg")
    between = checkpointed(between.groupBy(F.least("p1", "p2").alias("c1"), F.greatest("p1", "p2").alias("c2")).agg(*sums), forget=True)
    whole = turned.select(F.col("piece").alias("node"), "component").distinct()
    if between.isEmpty() or whole.count() == turned.count():  # nothing between the pieces, or none that holds two nodes
        return turned.select("component", "node", "orient")
    up = orientations(checkpointed(whole), between, min_links, tree, full_field, cap)
    up = up.select(F.col("node").alias("piece"), F.col("orient").alias("way"))
    return turned.join(up, "piece").select("component", "node", (F.col("orient") * F.col("way")).cast("int").alias("orient"))
