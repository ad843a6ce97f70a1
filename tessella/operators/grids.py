"""Kernels over score maps and images, for use behind Arrow functions: NumPy only."""

from __future__ import annotations

import numpy as np


def distance_transform(score: np.ndarray, linear: float, quadratic: float) -> tuple[np.ndarray, np.ndarray]:
    """For each place p the best of score[q] - linear * (q - p) - quadratic * (q - p) ** 2 and the q it comes from.

    The lower envelope of parabolas, in linear time; quadratic must be positive.
    """
    n = len(score)
    if quadratic <= 0:
        raise ValueError("the quadratic weight must be positive")
    # maximise f(q) - a q^2 ... as parabolas in p: shift the linear part into the vertex
    vertex = np.arange(n) + linear / (2 * quadratic)
    height = score + linear**2 / (4 * quadratic)
    hull, edge = [0], [-np.inf]
    for q in range(1, n):
        while True:
            r = hull[-1]
            meet = (height[r] - height[q] + quadratic * (vertex[q] ** 2 - vertex[r] ** 2)) / (2 * quadratic * (vertex[q] - vertex[r]))
            if meet <= edge[-1] and len(hull) > 1:
                hull.pop()
                edge.pop()
            else:
                break
        hull.append(q)
        edge.append(meet)
    source = np.array(hull)[np.searchsorted(np.array(edge), np.arange(n), side="left") - 1]
    step = source - np.arange(n)
    return score[source] - linear * step - quadratic * step**2, source


def distance_transform_2d(score: np.ndarray, linear: tuple, quadratic: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows first, then columns; the best score of each cell and the (y, x) it comes from."""
    across = [distance_transform(row, linear[0], quadratic[0]) for row in score]
    best, from_x = np.stack([a[0] for a in across]), np.stack([a[1] for a in across])
    down = [distance_transform(column, linear[1], quadratic[1]) for column in best.T]
    out, from_y = np.stack([d[0] for d in down]).T, np.stack([d[1] for d in down]).T
    return out, from_y, np.take_along_axis(from_x, from_y, axis=0)


def tree_max_sum(unary: dict, children: dict, springs: dict, root) -> tuple[float, dict]:
    """Best placement of a tree of parts: each part's map plus its children's, spread by springs; then the way back.

    ``springs``: child -> (dy, dx, linear (x, y), quadratic (x, y)), the ideal offset from the parent first.
    """
    came: dict = {}

    def total(part) -> np.ndarray:
        score = unary[part].copy()
        for child in children.get(part, ()):
            dy, dx, linear, quadratic = springs[child]
            moved, from_y, from_x = distance_transform_2d(total(child), linear, quadratic)
            h, w = moved.shape
            ys, xs = np.clip(np.arange(h) + dy, 0, h - 1), np.clip(np.arange(w) + dx, 0, w - 1)
            score += moved[np.ix_(ys, xs)]
            came[child] = from_y[np.ix_(ys, xs)], from_x[np.ix_(ys, xs)]
        return score

    score = total(root)
    places = {root: tuple(int(v) for v in np.unravel_index(score.argmax(), score.shape))}

    def back(part) -> None:
        for child in children.get(part, ()):
            at = places[part]
            places[child] = int(came[child][0][at]), int(came[child][1][at])
            back(child)

    back(root)
    return float(score.max()), places


def oriented_histograms(image: np.ndarray, cell: int = 8, bins: int = 9, clip: float = 0.2) -> np.ndarray:
    """(rows, columns, bins) of cells: gradients by orientation, each cell of unit length, clipped, of unit length again."""
    gy, gx = np.gradient(image.astype(float))
    size = np.hypot(gx, gy)
    turn = (np.arctan2(gy, gx) % np.pi) / np.pi * bins
    low = np.floor(turn).astype(int) % bins
    share = turn - np.floor(turn)
    h, w = image.shape[0] // cell, image.shape[1] // cell
    out = np.zeros((h, w, bins))
    y, x = np.divmod(np.arange(h * cell * w * cell), w * cell)
    for which, part in ((low, 1 - share), ((low + 1) % bins, share)):
        np.add.at(out, (y // cell, x // cell, which[y, x]), (size * part)[y, x])
    for _ in range(2):
        out = out / np.maximum(np.linalg.norm(out, axis=2, keepdims=True), 1e-12)
        out = np.minimum(out, clip) if _ == 0 else out
    return out


def binary_patterns(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, weight) of each cell: which of its eight neighbours alone is above it, 0 to 7 from the right counter-clockwise, with weight 1.

    Cells with none or several above them, and the border, have code and weight 0.
    """
    code, weight = np.zeros(image.shape, np.uint8), np.zeros(image.shape, np.uint8)
    if min(image.shape) < 3:
        return code, weight
    h, w = image.shape
    around = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]
    above = np.stack([image[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] > image[1:-1, 1:-1] for dy, dx in around])
    alone = above.sum(axis=0) == 1
    weight[1:-1, 1:-1] = alone
    code[1:-1, 1:-1] = np.where(alone, above.argmax(axis=0), 0)
    return code, weight


def slide(features: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Score of a template at each place where it fits: the dot product over rows, columns and channels."""
    windows = np.lib.stride_tricks.sliding_window_view(features, template.shape[:2], axis=(0, 1))
    return np.einsum("yxchw,hwc->yx", windows, template)


def min_max(score: np.ndarray) -> np.ndarray:
    low, high = score.min(), score.max()
    return (score - low) / (high - low) if high > low else np.zeros_like(score, float)
