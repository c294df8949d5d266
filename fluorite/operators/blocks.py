"""Dense work on voxel tables in blocks with their neighbours' borders.

A task cuts its rows into pieces, one for each block that needs them: the block a voxel lies in, and those whose border it is
part of. Pieces are two byte strings (places in the block, values), so one shuffle moves every voxel once and the border
voxels once for each neighbour; what a filter costs doesn't depend on its kernel's size. The task that holds a block's pieces
fills an array with them and works on it with numpy. A block has a fixed size, wider only where a filter's reach is, so no
task's memory grows with the image.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Voxels along an axis of a block at least.
SIZE = {"z": 16, "y": 64, "x": 64}


def in_blocks(img: DataFrame, keys: Sequence[str], axes: str, value: str, reach: dict[str, int], work: Callable, columns: str, size: dict[str, int] | None = None, borders: bool = False) -> DataFrame:
    """``keys``, ``axes`` and ``columns`` (a schema) of what ``work`` finds in each block.

    ``work(values, there, start)`` gets the block's array with its borders (float64 or int64, as ``value`` is), where it has
    voxels, and the place of its first cell; it returns an array of booleans, which cells are in the result, and one array for
    each column. Of these, the cells without the borders are kept. ``reach``: the width of the border along each axis. Voxels
    that are missing are no part of ``there`` and 0; blocks without a voxel in reach don't occur. ``borders``: cells of the
    borders are kept too, and each row tells its block (t and the axis) and whether the cell is the block's own (inner).
    """
    reach = [int(reach.get(a, 0)) for a in axes]
    size = [max((size or SIZE)[a], 2 * r) for a, r in zip(axes, reach, strict=True)]
    shape = tuple(s + 2 * r for s, r in zip(size, reach, strict=True))
    whole = dict(img.dtypes)[value] in ("bigint", "int", "smallint", "tinyint")
    dtype, to = (np.int64, "long") if whole else (np.float64, "double")
    steps = list(itertools.product(*[range(-math.ceil(r / s), math.ceil(r / s) + 1) for s, r in zip(size, reach, strict=True)]))
    rows = img.select(*keys, *[F.col(a).cast("long").alias(a) for a in axes], F.col(value).cast(to).alias("_v")).where(F.col("_v").isNotNull())
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    targets = [f"_t{a}" for a in axes]
    if borders:
        columns += "".join(f", t{a} long" for a in axes) + ", inner boolean"

    def scatter(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(a).to_numpy() for a in axes])
            home, values = at // np.array(size)[:, None], b.column("_v").to_numpy()
            code = np.zeros(b.num_rows, np.int64)
            for k in keys:
                d = b.column(k).dictionary_encode(null_encoding="encode")
                code = code * max(1, len(d.dictionary)) + d.indices.to_numpy()
            found = []
            for step in steps:
                block = home + np.array(step)[:, None]
                place = at - block * np.array(size)[:, None] + np.array(reach)[:, None]
                own = np.flatnonzero(((place >= 0) & (place < np.array(shape)[:, None])).all(0))
                found.append((own, block[:, own], np.ravel_multi_index(tuple(place[:, own]), shape).astype(np.int32)))
            row, block, place = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found], 1), np.concatenate([f[2] for f in found])
            order = np.lexsort((*block[::-1], code[row]))
            row, block, place = row[order], block[:, order], place[order]
            new = np.ones(len(row), bool)
            new[1:] = (np.diff(code[row]) != 0) | (np.diff(block) != 0).any(0)
            begin = np.append(np.flatnonzero(new), len(row))
            spans = list(zip(begin[:-1], begin[1:], strict=True))
            first = pa.array(row[begin[:-1]])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k).take(first) for k in keys], *[pa.array(block[i, begin[:-1]]) for i in range(len(axes))], pa.array([place[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([values[row[i:j]].tobytes() for i, j in spans], pa.binary())],
                names=[*keys, *targets, "_places", "_values"],
            )

    pieces = rows.mapInArrow(scatter, ", ".join(filter(None, [kinds, *[f"{t} long" for t in targets], "_places binary, _values binary"])))
    inner = tuple(slice(r, r + s) for r, s in zip(reach, size, strict=True))
    names = [c.split()[0] for c in columns.split(", ")]

    def fill(group: pa.Table) -> pa.Table:
        values, there = np.zeros(shape, dtype), np.zeros(shape, bool)
        for p, v in zip(group["_places"], group["_values"], strict=True):
            p = np.frombuffer(p.as_buffer(), np.int32)
            values.ravel()[p] = np.frombuffer(v.as_buffer(), dtype)
            there.ravel()[p] = True
        block = [group[t][0].as_py() for t in targets]
        kept, *out = work(values, there, [b * s - r for b, s, r in zip(block, size, reach, strict=True)])
        part = tuple(slice(None) for _ in axes) if borders else inner
        at = np.nonzero(kept[part])
        n = len(at[0])
        if borders:
            own = np.zeros(shape, bool)
            own[inner] = True
            out += [*[np.full(shape, b, np.int64) for b in block], own]
        made = {k: pa.chunked_array([group[k].slice(0, 1)]).combine_chunks().take(pa.array(np.zeros(n, np.int64))) for k in keys}
        made |= {a: pa.array(x + b * s - r * borders) for a, x, b, s, r in zip(axes, at, block, size, reach, strict=True)}
        return pa.table(made | {c: pa.array(x[part][at]) for c, x in zip(names, out, strict=True)})

    schema = ", ".join(filter(None, [kinds, *[f"{a} long" for a in axes], columns]))
    return pieces.groupBy(*keys, *targets).applyInArrow(fill, schema)


def band(n: int, weights: Sequence[tuple[int, float]], start: int = 0, mirror: tuple[int, int] | None = None) -> np.ndarray:
    """The matrix that sums ``n`` cells with ``weights`` (offset, weight); cells beyond its ends count as zero.

    ``mirror``: first and last cell of the image, at whose edges it is mirrored (edge cells count twice), where cell 0 is at ``start``.
    """
    out = np.zeros((n, n))
    at = np.arange(n)
    for d, w in weights:
        of = at + d
        if mirror:
            wide = mirror[1] - mirror[0] + 1
            k = (of + start - mirror[0]) % (2 * wide)
            of = np.where(k < wide, k, 2 * wide - 1 - k) + mirror[0] - start
        ok = (of >= 0) & (of < n)
        np.add.at(out, (at[ok], of[ok]), w)
    return out


def along(values: np.ndarray, axis: int, matrix: np.ndarray) -> np.ndarray:
    """``values`` summed along one axis by ``matrix``."""
    return np.moveaxis(np.tensordot(matrix, values, (1, axis)), 0, axis)
