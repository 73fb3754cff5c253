"""Vantage-point trees over binary codes under the Hamming distance."""

from __future__ import annotations

import numpy as np


class VantageTree:
    """A tree whose leaves are the shards.

    A node holds a vantage point and a radius: codes within the radius belong inside, the others outside. With the
    triangle inequality a ball around a code at distance d can reach inside only if d - r <= radius, and outside only
    if d + r > radius; other branches are pruned.
    """

    def __init__(self, points: list[int], radii: list[int], children: list[tuple[int, int]], leaves: int):
        self.points, self.radii, self.children, self.leaves = points, radii, children, leaves

    @classmethod
    def build(cls, codes: np.ndarray, leaf_size: int, seed: int = 1) -> VantageTree:
        """Splits at the median distance from a random code, until a part has leaf_size codes or no split parts it.

        Children: a node's index, or -1 - leaf.
        """
        chance = np.random.default_rng(seed)
        points, radii, children, leaves = [], [], [], 0
        todo = [(codes, None, 0)]
        while todo:
            part, parent, side = todo.pop()
            made = None
            if len(part) > max(1, leaf_size):
                for point in part[chance.integers(0, len(part), 4)]:
                    d = np.bitwise_count(part ^ point)
                    # of the radii near the median, the one that parts most evenly
                    radius = min({int(np.median(d)) + k for k in (-1, 0)}, key=lambda x: abs(2 * int((d <= x).sum()) - len(part)))
                    inside = d <= radius
                    if 0 < (n := int(inside.sum())) < len(part) and (made is None or abs(2 * n - len(part)) < made[0]):
                        made = (abs(2 * n - len(part)), point, radius, inside)
            if made is None:
                at, leaves = -1 - leaves, leaves + 1
            else:
                at = len(points)
                points.append(int(made[1]))
                radii.append(made[2])
                children.append([0, 0])
                todo += [(part[made[3]], at, 0), (part[~made[3]], at, 1)]
            if parent is not None:
                children[parent][side] = at
        return cls(points, radii, [tuple(x) for x in children], leaves)

    def route(self, codes: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that the ball of radius `reach` around a row's code may meet, its own included."""
        if not self.points:
            return np.arange(len(codes)), np.zeros(len(codes), np.int64)
        rows, leaves, todo = [], [], [(0, np.arange(len(codes)))]
        while todo:
            at, idx = todo.pop()
            if not len(idx):
                continue
            if at < 0:
                rows.append(idx)
                leaves.append(np.full(len(idx), -1 - at, np.int64))
                continue
            d = np.bitwise_count(codes[idx] ^ codes.dtype.type(self.points[at])).astype(np.int16)
            inside, outside = self.children[at]
            todo += [(inside, idx[d - reach <= self.radii[at]]), (outside, idx[d + reach > self.radii[at]])]
        return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(leaves or [np.zeros(0, np.int64)])


def linked_groups(codes: np.ndarray, reach: int, small: int = 768) -> np.ndarray:
    """For each code the index of its group's first; groups are the components of pairs at distance <= reach.

    Parts larger than `small` are split by a vantage point, the codes within `reach` of the boundary go to both
    parts; a part that no vantage point splits well is compared whole, in blocks.
    """
    label = np.arange(len(codes))
    todo = [label.copy()]
    while todo:
        idx = todo.pop()
        if len(idx) > small:
            d = np.bitwise_count(codes[idx] ^ codes[idx[len(idx) // 2]]).astype(np.int16)
            radius = int(np.median(d))
            inside, outside = idx[d - reach <= radius], idx[d > radius]
            if len(inside) <= 0.9 * len(idx) and len(inside) + len(outside) <= 1.5 * len(idx):
                todo += [inside, outside]
                continue
        step = max(1, (1 << 21) // len(idx))
        for at in range(0, len(idx), step):
            near = np.bitwise_count(codes[idx[at : at + step], None] ^ codes[None, idx[at:]]) <= reach
            i, j = np.nonzero(near)
            _join(label, idx[at + i], idx[at + j])
    return label


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    a, b = label[i], label[j]
    differ = a != b
    if not differ.any():
        return
    pairs = np.unique(np.stack([np.maximum(a, b)[differ], np.minimum(a, b)[differ]], 1), axis=0)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    for x, y in pairs.tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    to = np.arange(len(label))
    for x in parent:
        to[x] = root(x)
    label[:] = to[label]
