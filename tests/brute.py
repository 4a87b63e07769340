"""Independent plain-Python versions of pairs, interpolation and search."""

import itertools
import math
import random

from aeroweave.schemas import BANK_ANGLES, ENCOUNTER_CUTS

CLEAR = len(BANK_ANGLES) - 1


def random_group(rng: random.Random, conflict: str, n: int, box: float):
    return [
        (conflict, rng.uniform(-box, box), rng.uniform(-box, box), rng.uniform(0, 6.28), rng.uniform(8, 22))
        for _ in range(n)
    ]


def local_state(own, intr):
    _, la, lo, h, v = own
    _, lb, lp, g, w = intr
    dx, dy = lb - la, lp - lo
    x, y = dx * math.cos(h) + dy * math.sin(h), dy * math.cos(h) - dx * math.sin(h)
    return None if abs(x) > 2000 or abs(y) > 2000 else (x, y, g - h, v, w)


def corners(point, cuts=ENCOUNTER_CUTS):
    axes, stride = [], 1
    for value, axis in zip(point, cuts):
        value = min(max(value, axis[0]), axis[-1])
        options = []
        for k, cut in enumerate(axis):
            if cut == value:
                options = [(k * stride, 1.0)]
                break
            if cut > value:
                t = (value - axis[k - 1]) / (cut - axis[k - 1])
                options = [((k - 1) * stride, 1 - t), (k * stride, t)]
                break
        axes.append(options)
        stride *= len(axis)
    for combo in itertools.product(*axes):
        yield sum(c[0] for c in combo), math.prod(c[1] for c in combo)


def pair_values(point, table):
    out = [0.0] * table.shape[1]
    for index, weight in corners(point):
        for j in range(len(out)):
            out[j] += weight * float(table[index, j])
    return out


def search(group, table, order_of=None, max_iter=100):
    """Sequential search of one group; returns (actions, rounded total, sweeps)."""
    n = len(group)
    q = {}
    for i in range(n):
        for k in range(n):
            if i != k:
                state = local_state(group[i], group[k])
                q[i, k] = None if state is None else pair_values(state, table)
    current, best = [CLEAR] * n, [CLEAR] * n
    utils = [None] * n
    best_total, sweeps = None, 0
    improving = True
    while improving and sweeps < max_iter:
        improving = False
        for i in order_of(sweeps) if order_of else range(n):
            worst = []
            for a in range(CLEAR + 1):
                low = math.inf
                for k in range(n):
                    if k == i:
                        continue
                    if q[i, k] is None:
                        low = min(low, 0.0 if a == CLEAR else -0.5)
                    else:
                        low = min(low, q[i, k][a * (CLEAR + 1) + current[k]])
                worst.append(low)
            utils[i] = max(worst)
            current[i] = worst.index(utils[i])
            if None not in utils:
                total = round(math.fsum(utils), 10)
                if best_total is None or total > best_total:
                    best_total, best, improving = total, list(current), True
        sweeps += 1
    return best, best_total, sweeps
