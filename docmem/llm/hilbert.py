"""Hilbert curve index of quantised coordinates, as a column expression and for NumPy.

The curve is walked from the highest bits down. A state is (entry corner, axis);
one step turns the bits of the point into the number of the subcube and the
next state. The steps of all states are put into one table, made by the rule of
Hamilton and Rau-Chaplin (compact Hilbert indices).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Subcube number and next state by [state, bits], state = entry * dims + axis."""
    size = 1 << dims

    def turn(x: int, k: int) -> int:
        k %= dims
        return ((x << k) | (x >> (dims - k))) & (size - 1)

    gray = [i ^ (i >> 1) for i in range(size)]
    order = {g: i for i, g in enumerate(gray)}
    ones = [(~i & (i + 1)).bit_length() - 1 for i in range(size)]  # trailing ones
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, size)]
    axis = [0] + [ones[i - 1 if i % 2 == 0 else i] % dims for i in range(1, size)]
    number = np.zeros((size * dims, size), np.int64)
    follow = np.zeros((size * dims, size), np.int64)
    for e in range(size):
        for d in range(dims):
            for bits in range(size):
                w = order[turn(bits ^ e, dims - d - 1)]
                number[e * dims + d, bits] = w
                follow[e * dims + d, bits] = (e ^ turn(entry[w], d + 1)) * dims + (d + axis[w] + 1) % dims
    return number, follow


def index_column(coordinates: list[Column], bits: int) -> Column:
    """Curve index of integer coordinates of `bits` bits each."""
    dims = len(coordinates)
    number, follow = steps(dims)
    plan = F.lit([int(n) | int(f) << dims for n, f in zip(number.ravel(), follow.ravel())])

    def step(acc: Column, b: Column) -> Column:
        point = F.lit(0)
        for c in coordinates:
            point = point * 2 + F.call_function("shiftright", c.cast("int"), b).bitwiseAND(1)
        at = F.get(plan, acc["state"] * (1 << dims) + point)
        return F.struct(
            F.shiftright(at, dims).cast("int").alias("state"),
            (acc["key"] * (1 << dims) + at.bitwiseAND((1 << dims) - 1)).cast("bigint").alias("key"),
        )

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("key"))
    return F.aggregate(F.lit(list(range(bits - 1, -1, -1))), start, step)["key"]


def index_array(points: np.ndarray, bits: int, plan: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Curve index of each row of an integer array; `plan` comes from `steps`."""
    number, follow = plan
    dims = points.shape[1]
    state = np.zeros(len(points), np.int64)
    key = np.zeros(len(points), np.int64)
    for b in range(bits - 1, -1, -1):
        at = np.zeros(len(points), np.int64)
        for j in range(dims):
            at = (at << 1) | ((points[:, j] >> b) & 1)
        key = (key << dims) | number[state, at]
        state = follow[state, at]
    return key
