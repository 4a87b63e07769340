"""Arrow-batch helpers: multilinear interpolation of whole batches in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

POINT_COLUMNS = ("x", "y", "bearing", "v_own", "v_int")

SLICE_ROWS = 1024


def vertices(
    points: np.ndarray, cuts: tuple[tuple[float, ...], ...], whole: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Index and weight of the 2^d corners around each point, shapes ``(2^d, n)``.

    A coordinate on a cut, or clamped to the edge, gets weight 0 on its second corner, which has
    the index of the first. Without ``whole``, an axis on which that holds for all points has one corner only.
    """
    n = len(points)
    index = np.zeros((1, n), dtype=np.int64)
    weight = np.ones((1, n))
    stride = 1
    for dim, axis in enumerate(cuts):
        axis = np.asarray(axis)
        coord = np.clip(points[:, dim], axis[0], axis[-1])
        hi = np.searchsorted(axis, coord, side="left")
        exact = axis[hi] == coord
        if not whole and exact.all():
            index = index + hi * stride
            stride *= len(axis)
            continue
        lo = np.where(exact, hi, hi - 1)
        span = np.where(exact, 1.0, axis[hi] - axis[lo])
        low = np.where(exact, 1.0, 1.0 - (coord - axis[lo]) / span)
        index = np.concatenate([index + lo * stride, index + hi * stride])
        weight = np.concatenate([weight * low, weight * (1.0 - low)])
        stride *= len(axis)
    return index, weight


def utilities(points: np.ndarray, cuts, table: np.ndarray, shift: np.ndarray | None = None) -> np.ndarray:
    """Interpolated rows of ``table`` (states x actions), summed in vertex order.

    Works through slices whose temporaries stay in the processor cache. Points that are clamped on the same axes are
    taken together, as they need no second corner there. ``shift`` is added to the states of each point, for tables that
    are stacked.
    """
    clamped = np.zeros(len(points), dtype=np.int64)
    for dim, axis in enumerate(cuts):
        clamped |= ((points[:, dim] <= axis[0]) | (points[:, dim] >= axis[-1])).astype(np.int64) << dim
    order = np.argsort(clamped.astype(np.uint8) if len(cuts) <= 8 else clamped, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(clamped[order])) + 1, len(order))
    out = np.empty((len(points), table.shape[1]))
    gathered, sums = np.empty((2, SLICE_ROWS, table.shape[1]))
    for first, end in zip(np.append(0, ends[:-1]), ends):
        for start in range(first, end, SLICE_ROWS):
            some = order[start : min(start + SLICE_ROWS, end)]
            index, weight = vertices(points[some], cuts, whole=False)
            if shift is not None:
                index = index + shift[some]
            total, rows = sums[: len(some)], gathered[: len(some)]
            total[:] = 0.0
            for corner in range(len(index)):
                np.take(table, index[corner], axis=0, out=rows, mode="clip")
                rows *= weight[corner][:, None]
                total += rows
            out[some] = total
    return out


def point_matrix(batch, names=POINT_COLUMNS) -> np.ndarray:
    """Coordinate columns of a pyarrow batch or table as a matrix, one row per point."""
    return np.column_stack([batch.column(name).to_numpy(zero_copy_only=False) for name in names])


def vertex_lists(points: np.ndarray, cuts) -> pa.ListArray:
    """``list<struct<state_idx,w>>`` per point without the doubled corners; null where not finite."""
    valid = ~np.isnan(points).any(axis=1)
    index, weight = vertices(np.where(valid[:, None], points, 0.0), cuts)
    present = np.tile(valid, (1, 1))
    for dim, axis in enumerate(cuts):
        single = np.isin(np.clip(points[:, dim], axis[0], axis[-1]), axis)
        present = np.concatenate([present, present & ~single])
    kept = present.T
    offsets = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32)
    structs = pa.StructArray.from_arrays(
        [pa.array(index.T[kept].astype(np.int32)), pa.array(weight.T[kept])], ["state_idx", "w"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets), structs, mask=pa.array(~valid))


def brick_sums(lists: pa.ListArray, bricks: np.ndarray, missing: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Weighted rows of ``bricks`` (states x corners x actions), added up in the order of each list of vertices.

    A list's first vertex names its brick and ``numbers`` the corner that lies so far beyond it. Lists are taken by length
    and brick, slices of them at a time; a vertex that ``missing`` marks raises.
    """
    n_states, n_corners, n_joint = bricks.shape
    offsets = lists.offsets.to_numpy().astype(np.int64)
    first, sizes = offsets[:-1], np.diff(offsets)
    state = lists.values.field("state_idx").to_numpy()
    weight = lists.values.field("w").to_numpy()
    listed = slice(offsets[0], offsets[-1])
    base = np.repeat(state[first], sizes).astype(np.int64)
    away = state[listed] - base
    inside = (base >= 0) & (base < n_states) & (away >= 0) & (away < len(numbers))
    corner = np.where(inside, numbers[np.where(inside, away, 0)], -1)
    at = np.where(corner >= 0, base * n_corners + corner, 0)
    unmet = (corner < 0) | missing.ravel()[at]
    if unmet.any():
        raise ValueError(f"the utility table has no state {state[listed][unmet][0]}")
    return _listed_sums(bricks.reshape(-1, n_joint), at, weight[listed], first - offsets[0], sizes)


def vertex_sums(lists: pa.ListArray, states: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Weighted rows of ``table``, added up in the order of each list of vertices; ``states`` names its rows, ascending.

    A vertex that ``states`` lacks raises.
    """
    offsets = lists.offsets.to_numpy().astype(np.int64)
    listed = slice(offsets[0], offsets[-1])
    state = lists.values.field("state_idx").to_numpy()[listed]
    weight = lists.values.field("w").to_numpy()[listed]
    at = np.minimum(np.searchsorted(states, state), max(len(states) - 1, 0))
    unmet = states[at] != state if len(states) else np.ones(len(state), bool)
    if unmet.any():
        raise ValueError(f"the utility table has no state {state[unmet][0]}")
    return _listed_sums(table, at, weight, offsets[:-1] - offsets[0], np.diff(offsets))


def _listed_sums(flat: np.ndarray, at: np.ndarray, weight: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Weighted rows of ``flat`` for lists that begin at ``first``, taken by length and first row, slices of them at a time."""
    n_joint = flat.shape[1]
    order = np.lexsort((at[first], sizes))
    out = np.empty((len(first), n_joint))
    gathered, sums = np.empty((2, SLICE_ROWS, n_joint))
    for run in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        for start in range(0, len(run), SLICE_ROWS):
            some = run[start : start + SLICE_ROWS]
            total, rows = sums[: len(some)], gathered[: len(some)]
            total[:] = 0.0
            for k in range(sizes[some[0]]):
                vertex = first[some] + k
                np.take(flat, at[vertex], axis=0, out=rows, mode="clip")
                rows *= weight[vertex][:, None]
                total += rows
            out[some] = total
    return out
