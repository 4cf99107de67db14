"""Union-find over the positions of one numpy block."""

from __future__ import annotations

import numpy as np


class Forest:
    """label[i] is a root position; after add() all labels are flat, so pairs already joined cost one vector compare."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            todo = a != b
            if not todo.any():
                return
            i, j = i[todo], j[todo]
            low, high = np.minimum(a[todo], b[todo]), np.maximum(a[todo], b[todo])
            order = np.lexsort((low, high))
            first = np.flatnonzero(np.diff(high[order], prepend=-1))
            label[high[order][first]] = low[order][first]  # each root hooks to the least of its partners
            while True:
                flat = label[label]
                if np.array_equal(flat, label):
                    break
                label[:] = flat
