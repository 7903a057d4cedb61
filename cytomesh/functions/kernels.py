"""Small numeric kernels that run inside Spark tasks on bounded blocks of rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Pairs that are held at a time where blocks meet: a tile stays in a core's cache.
TILE_ROWS, TILE_COLUMNS = 128, 2048


def sym_sqrt(m: np.ndarray) -> np.ndarray:
    """Square root of symmetric positive semi-definite matrices (stacked)."""
    vals, vecs = np.linalg.eigh((m + np.swapaxes(m, -1, -2)) / 2)
    return (vecs * np.sqrt(np.clip(vals, 0, None))[..., None, :]) @ np.swapaxes(vecs, -1, -2)


def w2_cov_term(c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """tr(C1 + C2 - 2 (C2^1/2 C1 C2^1/2)^1/2) for stacked covariances, not below 0."""
    root = sym_sqrt(c2)
    inner = root @ c1 @ root
    vals = np.linalg.eigvalsh((inner + np.swapaxes(inner, -1, -2)) / 2)
    trace = np.trace(c1, axis1=-2, axis2=-1) + np.trace(c2, axis1=-2, axis2=-1)
    return np.clip(trace - 2 * np.sqrt(np.clip(vals, 0, None)).sum(-1), 0, None)


def pairwise_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances from explicit differences, one dimension at a time."""
    d2 = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        diff = a[:, j, None] - b[None, :, j]
        d2 += diff * diff
    return np.sqrt(d2)


def _finite(x: np.ndarray) -> bool:
    return bool(np.isfinite((x * x).sum()))


def near_tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray, float]]:
    """Rows, columns, their squared distances about, and by how much these may be wrong, tile by tile.

    Matrix products around the middle of ``b`` give them; where values are not finite, explicit differences.
    """
    exact = not (len(a) and len(b) and _finite(a) and _finite(b))
    if not exact:
        middle = b.mean(axis=0)
        ca, cb = a - middle, b - middle
        na, nb = (ca * ca).sum(axis=1), (cb * cb).sum(axis=1)
        margin = 16 * (a.shape[1] + 4) * np.finfo(float).eps * float(na.max() + nb.max())
        exact = not np.isfinite(margin)
    if not exact:
        left = np.column_stack([-2 * ca, na, np.ones(len(a))])
        right = np.ascontiguousarray(np.column_stack([cb, np.ones(len(b)), nb]).T)
    for i in range(0, len(a), TILE_ROWS):
        rows = slice(i, min(i + TILE_ROWS, len(a)))
        for j in range(0, len(b), TILE_COLUMNS):
            cols = slice(j, min(j + TILE_COLUMNS, len(b)))
            yield (rows, cols, pairwise_distance(a[rows], b[cols]) ** 2, 0.0) if exact else (rows, cols, left[rows] @ right[:, cols], margin)


def squared_differences(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (r, c) from explicit differences."""
    d2 = np.zeros(len(r))
    for t in range(a.shape[1]):
        diff = a[r, t] - b[c, t]
        d2 += diff * diff
    return d2


def distance_sums(a: np.ndarray, b: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Per row of ``a`` the sum of the distances to the rows of ``b`` of each group 0, 1, ...

    Short distances, whose root would show the rounding of a product, come from explicit differences: equal rows add 0.
    """
    order = np.argsort(group, kind="stable")
    group, b = group[order], b[order]
    out = np.zeros((len(a), int(group[-1]) + 1 if len(b) else 0))
    for rows, cols, d2, margin in near_tiles(a, b):
        if margin:
            r, c = np.nonzero(d2 <= 1e6 * margin)
            d2[r, c] = squared_differences(a[rows], b[cols], r, c)
        own = group[cols]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[rows, own[starts]] += np.add.reduceat(np.sqrt(d2, out=d2), starts, axis=1)
    return out


def shortest_longest(a: np.ndarray, b: np.ndarray, labels: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float | None, float | None]]:
    """Per labelling (codes of the rows of ``a`` and of ``b``, -1 without one) the smallest distance between different
    labels and the largest inside one. Products find the pairs that may better what is known; only those are looked at."""
    least, most = np.full(len(labels), np.inf), np.full(len(labels), -np.inf)
    apart = np.array([len(np.union1d(x[x >= 0], y[y >= 0])) > 1 for x, y in labels])
    alike = np.array([len(np.intersect1d(x[x >= 0], y[y >= 0])) > 0 for x, y in labels])
    for rows, cols, d2, margin in near_tiles(a, b):
        low, high = max(least[apart], default=-np.inf), min(most[alike], default=np.inf)
        r, c = np.nonzero((d2 <= low + margin) | (d2 >= high - margin))
        if not len(r):
            continue
        r, c = r + rows.start, c + cols.start
        exact = squared_differences(a, b, r, c)
        for i, (x, y) in enumerate(labels):
            known, same = (x[r] >= 0) & (y[c] >= 0), x[r] == y[c]
            least[i] = np.fmin.reduce(exact[known & ~same], initial=least[i])
            most[i] = np.fmax.reduce(exact[known & same], initial=most[i])
    return [(float(np.sqrt(x)) if x < np.inf else None, float(np.sqrt(y)) if y >= 0 else None) for x, y in zip(least, most, strict=True)]


def nearest_rows(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``a``, row of ``b`` and distance for the k nearest rows of ``b``; the earlier row wins a tie. Values are finite.

    Products tell which pairs can be among them; the distances of those pairs, and the order, come from explicit differences.
    """
    k = min(k, len(b))
    if not k or not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    found, waiting, best = [], [], ()
    for rows, cols, near, margin in near_tiles(a, b):
        if cols.start == 0:
            best, turn, due = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), 0, 1
            limit = np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * margin if near.shape[1] > k else np.full(len(near), np.inf)
        turn += 1
        r, c = np.nonzero(near <= limit[:, None])
        waiting.append((r, c + cols.start))
        last = cols.stop == len(b)
        if turn == due or last or sum(len(w[0]) for w in waiting) > 1_000_000:
            due = max(due, 2 * turn)
            best, waiting = _best_rows(a[rows], b, best, waiting, k), []
            have = np.bincount(best[0], minlength=len(near))
            kth = best[2][np.cumsum(have) - 1]
            limit = np.where(have == k, kth * kth * (1 + 1e-15) + 2 * margin, np.inf)
        if last:
            found.append((best[0] + rows.start, best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _best_rows(a: np.ndarray, b: np.ndarray, best: tuple, waiting: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, c = (np.concatenate(x) for x in zip(*waiting, strict=True))
    d = np.sqrt(squared_differences(a, b, r, c))
    r, c, d = np.concatenate([best[0], r]), np.concatenate([best[1], c]), np.concatenate([best[2], d])
    order = np.lexsort((c, d, r))
    r, c, d = r[order], c[order], d[order]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    rank = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
    keep = rank < k
    return r[keep], c[keep], d[keep]


def transport_cost(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> float:
    """Exact optimal-transport cost between two small discrete distributions; costs are not negative.

    Each round sends as much mass as possible along the cheapest path from a row with supply left to a column with demand
    left. Potentials keep the costs of all remaining arcs from being negative, so paths are found node by node, nearest
    first; a node is settled once, and no path can close on itself.
    """
    n, m = cost.shape
    supply, demand, flow = a / a.sum(), b / b.sum(), np.zeros((n, m))
    potential = np.zeros(n + m)
    eps = 1e-13
    while supply.max() > eps and demand.max() > eps:
        far = np.concatenate([np.where(supply > eps, 0.0, np.inf), np.full(m, np.inf)])
        settled = np.zeros(n + m, bool)
        before = np.full(n + m, -1)
        while True:
            k = int(np.where(settled, np.inf, far).argmin())
            settled[k] = True
            if k >= n and demand[k - n] > eps:
                break
            if k < n:
                side, arcs, price = slice(n, n + m), ~settled[n:], cost[k]
            else:
                side, arcs, price = slice(0, n), ~settled[:n] & (flow[:, k - n] > eps), -cost[:, k - n]
            step = far[k] + np.maximum(price + potential[k] - potential[side], 0.0)
            better = arcs & (step < far[side])
            far[side] = np.where(better, step, far[side])
            before[side] = np.where(better, k, before[side])
        potential += np.minimum(far, far[k])
        path = [k]
        while before[path[-1]] >= 0:
            path.append(int(before[path[-1]]))
        arcs_of = [(u, v - n, 1) if u < n else (v, u - n, -1) for v, u in zip(path, path[1:])]
        send = min([supply[path[-1]], demand[k - n], *[flow[i, j] for i, j, s in arcs_of if s < 0]])
        for i, j, s in arcs_of:
            flow[i, j] += s * send
        supply[path[-1]] -= send
        demand[k - n] -= send
    return float((flow * cost).sum())


def smallest_k(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column positions of the k smallest distances per row; the smaller id wins a tie."""
    order = np.argsort(ids, kind="stable")
    d = dist[:, order]
    k = min(k, d.shape[1])
    if k == d.shape[1]:
        return order[np.argsort(d, axis=1, kind="stable")]
    part = np.sort(np.argpartition(d, k - 1, axis=1)[:, :k], axis=1)
    val = np.take_along_axis(d, part, 1)
    cols = np.take_along_axis(part, np.argsort(val, axis=1, kind="stable"), 1)
    tied = np.flatnonzero((d <= val.max(1, keepdims=True)).sum(1) > k)
    if len(tied):  # the partition may have dropped a smaller id among equals
        cols[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :k]
    return order[cols]


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(v) / math.sqrt(2.0)) if v == v else float("nan") for v in z])


def chi2_upper(x: float, df: float) -> float:
    """P(chi-square_df > x) by the usual series / continued fraction of the incomplete gamma function."""
    if x is None or x != x or df <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    s, h = df / 2.0, x / 2.0
    scale = math.exp(-h + s * math.log(h) - math.lgamma(s))
    if h < s + 1:
        term = total = 1.0 / s
        n = s
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= h / n
            total += term
        return max(0.0, 1.0 - scale * total)
    tiny = 1e-300
    b = h + 1 - s
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 10_000):
        an = -i * (i - s)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        out *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * out


def least_members(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Per vertex 0 .. n - 1 the smallest vertex of its component under the edges a - b."""
    p = np.arange(n)
    while len(a):
        ra, rb = p[a], p[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            q = p[p]
            if np.array_equal(q, p):
                break
            p = q
    return p


def lightest_forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Marks the edges of the minimum spanning forest; edges come in ascending order, so it is unique."""
    chosen = np.zeros(len(a), bool)
    left = np.flatnonzero(a != b)
    part = np.arange(n)
    while len(left):
        best = np.full(n, len(a))
        ca, cb = part[a[left]], part[b[left]]
        np.minimum.at(best, ca, left)
        np.minimum.at(best, cb, left)
        parts = np.flatnonzero(best < len(a))
        e = best[parts]
        chosen[e] = True
        other = np.where(part[a[e]] == parts, part[b[e]], part[a[e]])
        up = np.arange(n)
        up[parts] = other
        pair = (up[up] == np.arange(n)) & (np.arange(n) < up)  # both chose one edge: the smaller one is the root
        up[pair] = np.flatnonzero(pair)
        while True:
            q = up[up]
            if np.array_equal(q, up):
                break
            up = q
        part = up[part]
        left = left[part[a[left]] != part[b[left]]]
    return chosen
