"""Tiles with seams and one-to-one matching against the whole plane and every assignment."""

import itertools

import numpy as np
import pytest

from fluorite.operators import spots as sp
from fluorite.operators import tiles


def by_flooding(mask):
    out, name = np.zeros(mask.shape, int), 0
    for p in zip(*np.nonzero(mask), strict=True):
        if out[p]:
            continue
        name += 1
        todo = [p]
        out[p] = name
        while todo:
            y, x = todo.pop()
            for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not out[q]:
                    out[q] = name
                    todo.append(q)
    return out


def parts(labels):
    """A labelling without its names."""
    groups = {}
    for p, k in labels.items():
        groups.setdefault(k, set()).add(p)
    return {frozenset(g) for g in groups.values()}


def test_connected_labels_against_flooding():
    rng = np.random.default_rng(0)
    spiral = np.zeros((21, 21), bool)
    for k in range(0, 10, 2):
        spiral[k, k : 21 - k] = spiral[k : 21 - k, 20 - k] = spiral[20 - k, k : 21 - k] = True
        spiral[k + 2 : 21 - k, k] = True
        spiral[k + 2, k + 1] = True
    for mask in (spiral, np.zeros((3, 4), bool), np.ones((3, 4), bool), *[rng.random((17, 23)) < s for s in (0.3, 0.5, 0.6, 0.8)]):
        got, want = tiles.connected_labels(mask), by_flooding(mask)
        assert parts(dict(np.ndenumerate(got))) == parts(dict(np.ndenumerate(want))) and (got > 0).tolist() == mask.tolist()


@pytest.mark.parametrize("tile, overlap", [(4, 1), (8, 3), (64, 2)])
def test_tiles_give_the_labels_of_the_whole_plane(spark, tile, overlap):
    rng = np.random.default_rng(tile)
    planes = {(i, p): rng.normal(size=(19, 30)) for i in range(2) for p in range(2)}
    df = spark.createDataFrame([(i, p, y, x, float(v)) for (i, p), a in planes.items() for (y, x), v in np.ndenumerate(a)], "image_id long, plane long, y long, x long, v double").repartition(3)
    got = tiles.label_tiles(df, tiles.threshold_segmenter(-0.1), tile, overlap).collect()
    want = {(i, p, *q): (i, p, k) for (i, p), a in planes.items() for q, k in np.ndenumerate(by_flooding(a >= -0.1)) if k}
    assert len(got) == len(want) and parts({(r.image_id, r.plane, r.y, r.x): r.label for r in got}) == parts(want)


def test_odd_tiles(spark):
    df = spark.createDataFrame([], "plane long, y long, x long, v double")
    assert tiles.label_tiles(df, tiles.threshold_segmenter(0), 8, 1).count() == 0
    with pytest.raises(ValueError):
        tiles.label_tiles(df, tiles.threshold_segmenter(0), 8, 5)


def test_assignment_against_every_choice():
    rng = np.random.default_rng(1)
    for rows, cols in itertools.product(range(1, 6), repeat=2):
        gain = np.where(rng.random((rows, cols)) < 0.7, rng.random((rows, cols)), 0)
        got = sp._assignment(gain)
        assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})
        wide = gain if rows <= cols else gain.T
        best = max(sum(wide[k, c] for k, c in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert sum(gain[a, b] for a, b in got) == pytest.approx(best)


def test_labels_match_one_to_one(spark):
    rng = np.random.default_rng(3)
    truth, found = {}, {}
    for plane in range(3):
        for side, n in ((truth, 5), (found, 4)):
            for k in range(1, n + 1):
                y, x = rng.integers(0, 9, 2)
                for p in itertools.product(range(y, y + 4), range(x, x + 4)):
                    side[(plane, *map(int, p))] = k
    df = lambda side: spark.createDataFrame([(*p, k) for p, k in side.items()], "plane long, y long, x long, label long")
    got = sp.match_labels(df(truth), df(found)).collect()
    for plane in range(3):
        own = lambda side: {k: {p for p, j in side.items() if p[0] == plane and j == k} for k in {j for p, j in side.items() if p[0] == plane}}  # noqa: B023, E731
        t, f = own(truth), own(found)
        iou = {(a, b): len(t[a] & f[b]) / len(t[a] | f[b]) for a in t for b in f}
        names = [*f, *[None] * len(t)]
        best = max(sum(iou.get((a, b), 0) for a, b in zip(t, p, strict=False)) for p in itertools.permutations(names, len(t)))
        rows = [r for r in got if r.plane == plane]
        assert {r.label for r in rows} == set(t) and sum(r.iou for r in rows) == pytest.approx(best)
        named = [r.matched for r in rows if r.matched is not None]
        assert len(named) == len(set(named)) and all(r.iou == pytest.approx(iou[r.label, r.matched]) if r.matched else r.iou == 0 for r in rows)
