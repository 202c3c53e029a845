"""Plain NumPy statements of the rules, used as a second opinion."""

from functools import cache
from itertools import combinations

import numpy as np

from resight.operators import series as S


def resample(v, length):
    n = len(v)
    if n == 1:
        return np.repeat(v, length, axis=0)
    return np.interp(np.arange(length), np.linspace(0, length, n), v)


def smooth(v, sigma=5.0):
    w = np.array(S.kernel_weights(sigma))
    r, n = len(w) // 2, len(v)
    at = np.mod(np.arange(-r, n + r), 2 * n)
    return np.convolve(v[np.where(at < n, at, 2 * n - 1 - at)], w[::-1], "valid")


def extrema(v, order):
    n = len(v)
    around = [[v[min(max(i + o, 0), n - 1)] for o in range(-order, order + 1) if o] for i in range(n)]
    return [all(v[i] > x for x in a) for i, a in enumerate(around)], [all(v[i] < x for x in a) for i, a in enumerate(around)]


def dog(xy, steps, m, s):
    w = np.array(S.dog_weights(steps, m, s))
    return sum(np.convolve(xy[:, k], w[::-1], "valid") ** 2 for k in (0, 1))


def curvature(contour, radii):
    """Points as complex numbers: turning by the chord is one multiplication."""
    z = contour[:, 0] + 1j * contour[:, 1]
    out = np.full((len(z), len(radii)), np.nan)
    for j, r in enumerate(radii):
        for i, c in enumerate(z):
            near = z[np.abs(z - c) ** 2 <= r * r] - c
            turned = near * np.exp(-1j * np.angle(near[-1] - near[0]))
            x, y = turned.real, turned.imag
            below = (np.diff(x) * (y[1:] + y[:-1] + 2 * r) / 2).sum()
            width = min(x.max(), r) - max(x.min(), -r)
            out[i, j] = 0.5 if len(near) == 1 else below / (width * 2 * r)
    return out


def keypoints(smoothed, p):
    """Positions by rank; whatever is outermost, an end or an extremum beside it, ranks above all."""
    high, low = ([i for i, hit in enumerate(flags) if hit] for flags in extrema(smoothed, p.extremum_order))
    if not high and not low:
        return []
    first, last = min(high or low), max(low or high)
    rank = {i: abs(smoothed[i] - 0.5) for i in high + low}
    rank[0 if first > 1 else first] = np.inf
    rank[p.length - 1 if last < p.length - 2 else last] = np.inf
    return sorted(sorted(rank, key=lambda i: (-rank[i], i))[: p.num_keypoints])


def descriptors(v, p):
    raw = resample(v, p.length)
    out = {}
    for a, b in combinations(keypoints(smooth(raw, p.smooth_sigma), p), 2):
        piece = resample(raw[a:b + 1], p.feat_dim)
        out[a, b] = piece / np.sqrt(piece @ piece)
    return out


def gauss_descriptors(xy, p):
    n = p.length
    curve = xy if len(xy) == n else np.stack([resample(xy[:, k], n) for k in (0, 1)], 1)
    steps = 1 + 4 * p.keypoint_m * p.keypoint_s
    q = dog(curve, steps, p.keypoint_m, p.keypoint_s)
    peaks = [i for i in range(1, len(q) - 1) if q[i] > q[i - 1] and q[i] > q[i + 1]]
    peaks = sorted(peaks, key=lambda i: (-q[i], i))[: p.num_keypoints - 2]
    spots = [0, *sorted(i + steps // 2 for i in peaks), n]
    if p.uniform:
        spots = sorted({k * n // (p.num_keypoints - 1) for k in range(p.num_keypoints)})
    out = {}
    for m, s in p.scales:
        for a, b in combinations(spots, 2):
            width = p.feat_dim + 4 * m * s
            piece = np.stack([resample(curve[a:b, k], width) for k in (0, 1)], 1)
            f = dog(piece, 1 + 4 * m * s, m, s)
            out[f"{m},{s}", a, b] = f / np.sqrt((f * f).sum())
    return out


def warp(a, b, weights, window, kind):
    """Cheapest path by recursion over its last step; series are (length, channels)."""

    @cache
    def cheapest(i, j):
        if i == j == 0:
            return 0.0
        if i < 1 or j < 1 or not i - window <= j < i + window:
            return np.inf
        gap = (a[i] - b[j]) ** 2
        if kind == "chi_square":
            step = sum(g / (abs(x - 0.5) + abs(y - 0.5) + 1e-6) for g, x, y in zip(gap, a[i], b[j]))
        else:
            step = gap.sum() ** 0.5
        return weights[i] * weights[j] * step + min(cheapest(i - 1, j - 1), cheapest(i - 1, j), cheapest(i, j - 1))

    return cheapest(len(a) - 1, len(b) - 1)


def chains(peaks):
    """peaks: {(i, j): (pi, pj, ni, nj)} -> {smallest cell: cells in order}."""
    fwd, bwd = {}, {}
    for (i, j), (pi, pj, ni, nj) in peaks.items():
        sides = {1: [], -1: []}
        for o in ((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)):
            if o in peaks:
                side = np.sign((peaks[o][0] - pi) * nj - (peaks[o][1] - pj) * ni)
                if side:
                    sides[side].append((np.hypot(pi - peaks[o][0], pj - peaks[o][1]), o))
        fwd[i, j] = min(sides[1])[1] if sides[1] else None
        bwd[i, j] = min(sides[-1])[1] if sides[-1] else None

    def kept(links):
        return {p: t if t is not None and p in (fwd[t], bwd[t]) else None for p, t in links.items()}

    ahead, behind, seen, out = kept(fwd), kept(bwd), set(), {}

    def walk(p):
        path = []
        while p is not None and p not in seen:
            seen.add(p)
            path.append(p)
            p = next((t for t in (ahead[p], behind[p]) if t is not None and t not in seen), None)
        return path

    for p in sorted(peaks):
        if p not in seen:
            seen.add(p)
            first = walk(ahead[p])
            out[p] = first[::-1] + [p] + walk(behind[p])
    return out
