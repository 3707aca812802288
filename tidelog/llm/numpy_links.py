"""Connected components of links held in numpy arrays, for one block of a job."""

from __future__ import annotations

import numpy as np


class Blocks:
    """Components over ``n`` items that grow as links come in. ``forest`` gives one link
    from each item to the least of its component: so much a block sends out, however
    many links it found."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        linked = np.flatnonzero(self.root != np.arange(len(self.root)))
        return linked, self.root[linked]
