"""NumPy helpers for one segment (at most 200 points) or one grid, used inside tasks."""

from __future__ import annotations

import numpy as np


def mask_around(centres, n: int, length: int) -> np.ndarray:
    """Ones with ``length`` zeros around each centre; windows at an end cover that end."""
    at = np.asarray(centres, dtype=np.int64) - length // 2
    start = np.where(at <= 0, 0, np.where(at + 2 * (length // 2) >= n, max(0, n - length), at))
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, np.minimum(start + length, n), -1)
    return (edges[:n].cumsum() == 0).astype(np.int32)


def local_peaks(grid: np.ndarray, distance: int = 1, relative: float | None = None) -> np.ndarray:
    """Cells that are the largest within ``distance`` cells each way, highest first.

    A peak exceeds the grid's minimum and ``relative`` times its maximum. Of
    peaks closer together than ``distance`` only the highest stays.
    """
    if grid.max() == grid.min():
        return np.empty((0, grid.ndim), dtype=int)
    top = np.pad(grid, distance, mode="edge")
    for axis in range(grid.ndim):
        top = np.lib.stride_tricks.sliding_window_view(top, 2 * distance + 1, axis=axis).max(axis=-1)
    floor = grid.min() if relative is None else max(grid.min(), relative * grid.max())
    found = np.argwhere((grid == top) & (grid > floor))
    found = found[np.argsort(-grid[tuple(found.T)], kind="stable")]
    kept: list[np.ndarray] = []
    taken = np.zeros(grid.shape, dtype=bool)
    for cell in found:
        if not taken[tuple(cell)]:
            kept.append(cell)
            taken[tuple(slice(max(0, c - distance + 1), c + distance) for c in cell)] = True
    return np.array(kept, dtype=int).reshape(-1, grid.ndim)


def repeated_peaks(grid, least: int, most: int, relative: float = 0.0, distance: int = 2) -> np.ndarray:
    """Peaks found again and again with those already found set to zero, until there are more than ``least``.

    Stops when a round finds nothing, as each round takes cells away. Of more than
    ``most`` peaks the highest stay.
    """
    work = grid.copy()
    found = np.empty((0, grid.ndim), dtype=int)
    while len(found) <= least:
        peaks = local_peaks(work, distance, relative)
        if not len(peaks):
            break
        found = np.concatenate([found, peaks])
        work[tuple(peaks.T)] = 0
    if len(found) > most:
        found = found[np.argsort(-grid[tuple(found.T)], kind="stable")][:most]
    return found


# Variance of each kernel on its natural scale, so that a bandwidth is a standard deviation.
KERNEL_VARIANCE = {"epa": 1 / 5, "box": 1 / 3, "tri": 1 / 6}


def kernel_2d(kind: str, bandwidth: float, step: float) -> np.ndarray:
    """Weights of a radial kernel on grid offsets, summing to one."""
    reach = 4.0 * bandwidth if kind == "gaussian" else bandwidth / np.sqrt(KERNEL_VARIANCE[kind])
    r = int(np.ceil(reach / step))
    offsets = np.arange(-r, r + 1) * step
    d = np.hypot(offsets[:, None], offsets[None, :]) / reach
    weight = {
        "epa": np.clip(1 - d**2, 0, None), "box": (d <= 1).astype(float), "tri": np.clip(1 - d, 0, None),
        "gaussian": np.exp(-0.5 * (d * 4.0) ** 2),
    }[kind]
    return weight / weight.sum()


def binned_density(x: np.ndarray, y: np.ndarray, axis: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Points shared out linearly over the four cells around each, then smoothed; indexed [x, y].

    The kernel is laid over each cell that holds something. Densities are rounded
    to twelve places, so that ties do not hang on the order of a sum.
    """
    size, step = len(axis), axis[1] - axis[0]
    cells = np.zeros((size, size))
    fx, fy = (x - axis[0]) / step, (y - axis[0]) / step
    ix, iy = np.minimum(fx.astype(int), size - 2), np.minimum(fy.astype(int), size - 2)
    dx, dy = fx - ix, fy - iy
    for ox, wx in ((0, 1 - dx), (1, dx)):
        for oy, wy in ((0, 1 - dy), (1, dy)):
            np.add.at(cells, (ix + ox, iy + oy), wx * wy)
    r = len(kernel) // 2
    out = np.zeros((size + 2 * r, size + 2 * r))
    for i, j in np.argwhere(cells):
        out[i: i + 2 * r + 1, j: j + 2 * r + 1] += cells[i, j] * kernel
    return np.round(out[r: r + size, r: r + size] / len(x), 12)


def density_mask(lat: np.ndarray, lon: np.ndarray, length: int, bandwidth: float = 1.0, kind: str = "epa") -> np.ndarray:
    """Mask around the points nearest to the density peaks of a trajectory.

    Both coordinates are scaled to 0..100 and mirrored at their ends, so the
    density lives on a 300 x 300 grid whose middle third is the trajectory.
    """
    side, scale = 100, 100.0

    def scaled(v):
        width = v.max() - v.min()
        return (v - v.min()) / width * scale if width > 0 else np.zeros_like(v)

    x, y = scaled(lat), scaled(lon)
    mx, my = (np.concatenate([2 * v.min() - v, v, 2 * v.max() - v]) for v in (x, y))
    low, high = min(mx.min(), my.min()) - 1, max(mx.max(), my.max()) + 1
    axis = np.linspace(low, high, 3 * side)
    grid = binned_density(mx, my, axis, kernel_2d(kind, bandwidth, axis[1] - axis[0]))
    peaks = repeated_peaks(grid, 12, 48, 0.1, 2)
    middle = peaks[((peaks >= side) & (peaks < 2 * side)).all(axis=1)] - side
    nearest = [int(np.argmin((x - px) ** 2 + (y - py) ** 2)) for px, py in middle]
    return mask_around(nearest, len(x), length)


def rbf_costs(values: np.ndarray) -> np.ndarray:
    """Cost of every stretch [i, j): within-stretch scatter under a Gaussian kernel at the median distance.

    Costs are rounded to nine places, so that ties do not hang on the order of a sum.
    """
    v = np.asarray(values, dtype=float).reshape(len(values), -1)
    square = ((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)
    middle = np.median(square[np.triu_indices(len(v), 1)]) if len(v) > 1 else 0.0
    gram = np.exp(-np.clip(square * (1 / middle if middle > 0 else 1.0), 1e-2, 1e2))
    np.fill_diagonal(gram, 1.0)
    n = len(v)
    area = np.zeros((n + 1, n + 1))
    area[1:, 1:] = gram.cumsum(0).cumsum(1)
    i, j = np.arange(n + 1)[:, None], np.arange(n + 1)[None, :]
    inside = area[j, j] - area[i, j] - area[j, i] + area[i, i]
    size = np.where(j > i, j - i, 1)
    return np.round(np.where(j > i, (j - i) - inside / size, 0.0), 9)


def change_points_penalised(values: np.ndarray, penalty: float = 1.0, least: int = 3) -> list[int]:
    """Ends of the stretches that minimise cost plus a penalty per stretch."""
    cost, n = rbf_costs(values), len(values)
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
    best[0] = 0.0
    for end in range(least, n + 1):
        total = best[: end - least + 1] + cost[: end - least + 1, end] + penalty
        back[end] = int(np.argmin(total))
        best[end] = total[back[end]]
    ends, at = [], n
    while at > 0 and np.isfinite(best[at]):
        ends.append(at)
        at = back[at]
    return ends[::-1] or [n]


def change_points_fixed(values: np.ndarray, changes: int, least: int = 3, jump: int = 2) -> list[int]:
    """Ends of ``changes`` + 1 stretches of least cost, cut at multiples of ``jump``."""
    cost, n = rbf_costs(values), len(values)
    places = np.array([0, *[p for p in range(jump, n, jump)], n])
    m = len(places)
    wide = places[None, :] - places[:, None] >= least
    step = np.where(wide, cost[np.ix_(places, places)], np.inf)
    changes = max(0, min(changes, n // max(least, jump) - 1))
    while True:
        best, backs = step[0].copy(), []
        for _ in range(changes):
            total = best[:, None] + step
            backs.append(total.argmin(axis=0))
            best = total.min(axis=0)
        if np.isfinite(best[m - 1]) or changes == 0:
            break
        changes -= 1
    ends, at = [n], m - 1
    for back in reversed(backs):
        at = int(back[at])
        ends.append(int(places[at]))
    return ends[::-1]
