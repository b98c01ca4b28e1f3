"""Codes against plain k-means over every entry; the balls skip work and change nothing."""

import math

import numpy as np

from tidemark.llm import ballcodes as bc


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, code, error, label_error, digest) by comparing every part with every entry, in Python integers."""
    ok = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(parts, -(-max(len(v) for _, v, _ in ok) // parts) * parts)
    ints = [[math.floor(scale * x) for x in v] + [0] * (dims - len(v)) for _, v, _ in ok]
    order = sorted(range(len(ok)), key=lambda k: (ok[k][0] is None, ok[k][0] or 0, ok[k][1]))
    w = dims // parts
    cut = [[x[p * w:(p + 1) * w] for p in range(parts)] for x in ints]
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def assign():
        out = []
        for x in cut:
            out.append([min((sum((a - b) ** 2 for a, b in zip(x[p], e)), j) for j, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [x[p] for x, g in zip(cut, got) if g[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    got = assign()
    error = [sum(d for d, _ in g) for g in got]
    of = {}
    for (_, _, lab), e in zip(ok, error):
        of[lab] = of.get(lab, 0) + e
    digest = bc.hex_sha256(",".join(str(c) for p in books for e in p for c in e).encode())
    return sorted([(i, "".join(f"{j:02x}" for _, j in g), e, of[lab], digest) for (i, _, lab), g, e in zip(ok, got, error)], key=repr)


def rows_of(rng, n, dims, spread=0.02):
    centres = rng.normal(0, 0.3, (12, dims))
    return [(int(i), [float(np.float32(x)) for x in centres[rng.integers(12)] + rng.normal(0, spread, dims)], int(rng.integers(3))) for i in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_assign_equals_plain_search_from_any_filing():
    rng = np.random.default_rng(1)
    for spread in (3, 40, 4000):
        entries = rng.integers(-2000, 2000, (16, 8))
        entries[5] = entries[3]                                        # equal entries: the lower index wins
        parts = entries[rng.integers(0, 16, 4000)] + rng.integers(-spread, spread + 1, (4000, 8))
        d = ((parts[:, None] - entries) ** 2).sum(axis=2)
        for filed in (d.argmin(axis=1), rng.integers(0, 16, 4000)):
            code, least = bc.Balls(entries).assign(parts, filed)
            assert (code == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def test_stable_cores_and_rings_skip_work():
    rng = np.random.default_rng(2)
    entries = rng.integers(-4000, 4000, (16, 8))
    parts = entries[rng.integers(0, 16, 4000)] + rng.integers(-100, 101, (4000, 8))
    balls = bc.Balls(entries)
    code, _ = balls.assign(parts, ((parts[:, None] - entries) ** 2).sum(axis=2).argmin(axis=1))
    assert balls.seen < 1.2 * len(parts)                               # one distance a part, 16 without the balls


def test_codes_equal_plain(spark):
    rows = rows_of(np.random.default_rng(3), 400, 64)
    nan, inf = float("nan"), float("inf")
    odd = [(500, None, 1), (501, [nan] * 64, 1), (502, [inf] + [0.0] * 63, 1), (503, [None] + [0.5] * 63, 1), (504, [0.25] * 64, None),
           (505, [0.25] * 64, None), (7, rows[9][1], 2), (7, rows[7][1], 2), (None, [-0.125] * 64, 0), (3, [-3.0] * 64, 1)]
    rows += odd
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", id int, x string").repartition(5)
    assert sorted(map(tuple, bc.encode(df).collect()), key=repr) == plain(rows)


def test_few_and_ragged_vectors(spark):
    rows = [(1, [0.5, 0.25], 1), (2, [0.5, 0.25, -0.75, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 2), (3, [], 1)]
    got = sorted(map(tuple, bc.encode(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == plain(rows)
    for none in (rows[:0], [(1, None, 1), (2, [None], 2)]):
        df = bc.encode(spark.createDataFrame(none, SCHEMA))
        assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and df.count() == 0


def test_large_components_count_as_the_limit(spark):
    top = bc.component_limit(64)
    rows = [(1, [1e30] * 64, 1), (2, [-3e38] * 64, 1), (3, [0.0] * 64, 1)]
    got = {r[0]: r for r in bc.encode(spark.createDataFrame(rows, SCHEMA), rounds=0, entries=1).collect()}
    assert got[3].error == 64 * top * top and got[2].error == 64 * 4 * top * top and got[1].error == 0
    assert got[1].label_error == sum(r.error for r in got.values()) < 1 << 63
