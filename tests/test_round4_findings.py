"""Findings of round 4: searches of large spaces in blocks."""

import numpy as np
import pytest

from tessera.functions.dealt import add_nearest_dealt
from tessera.operators import scoring as H
from tessera.operators.space import Space


def cosines_by_hand(entries, vec):
    """Entries of a row that come twice count twice, in dot product and norm."""
    q = {i: v or 0.0 for i, v in (vec.items() if isinstance(vec, dict) else enumerate(vec or []))}
    norm, own = max(sum(v * v for v in entries_values(entries)) ** 0.5, 1e-8), max(sum(v * v for v in q.values()) ** 0.5, 1e-8)
    return sum(q.get(c, 0.0) * v for c, v in entries if c is not None and v is not None) / (norm * own)


def entries_values(entries):
    return [v for c, v in entries if c is not None and v is not None]


def nearest_by_hand(rows, entries, vec, last):
    of = {}
    for p, c, v in entries:
        if p is not None:
            of.setdefault(p, []).append((c, v))
    ranked = sorted(rows, key=lambda r: (-round(cosines_by_hand(of.get(r[0], []), vec), 12) + 0.0, -r[1] if last else r[1], r[0] is not None, r[0]))
    return ranked[0]


def planes(seed, n):
    """A space like that of i5: one component of few that all rows of a group
    have, and one that all rows have."""
    rng = np.random.default_rng(seed)
    rows = [(f"r{k}", int(k) * 3) for k in rng.permutation(n)]
    entries = [(p, int(rng.integers(5)), 1.0) for p, _ in rows] + [(p, 25, float(round(rng.uniform(-0.1, 1), 2))) for p, _ in rows]
    return rows, entries


def frames(spark, rows, entries):
    r = spark.createDataFrame(rows, "predicate string, row_order bigint")
    e = spark.createDataFrame(entries, "predicate string, component bigint, value double")
    return Space(r, e, e.select("component").distinct())


@pytest.mark.parametrize("last", [False, True])
def test_blocks_of_a_large_space_equal_all_rows(spark, last):
    rows, entries = planes(1, 300)
    entries += entries[:40] + entries[300:340]  # entries that come twice
    entries += [("r7", None, 1.0), ("r8", 3, None), (None, 2, 1.0), ("r9", 40, 0.0), ("unknown", 2, 1.0)]
    rows += [("r5", 2), ("r5", 5000), ("zero", 4), ("zero2", 1), (None, 7)]  # a name that comes twice, rows without entries
    rng = np.random.default_rng(2)
    asked = [[1.0 if i == k % 5 else 0.0 for i in range(25)] + [float(round(rng.uniform(-0.1, 1), 2))] for k in range(60)]
    asked += [None, [], [0.0, 0.0], [None, 1.0], [0.0] * 25 + [-1.0], [0.0] * 30 + [1.0], [1e-9], [-1.0] * 26]
    asked = [(k % 50, v) for k, v in enumerate(asked)] + [(None, asked[0]), (None, asked[7])]  # ids that come twice and none
    space = frames(spark, rows, entries)
    queries = spark.createDataFrame(asked, "id bigint, vec array<double>")
    got = add_nearest_dealt(queries, "vec", space.rows, space.entries, last, size=60, most=7)
    want = sorted(((i, v, *nearest_by_hand(rows, entries, v, last)) for i, v in asked), key=str)
    assert sorted(((r.id, r.vec, r.nearest, r.nearest_order) for r in got.collect()), key=str) == want


def test_blocks_of_wide_and_of_empty_spaces(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{k}", k) for k in range(80)]
    entries = [(p, int(c), float(rng.normal())) for p, _ in rows for c in rng.choice(40, 25, replace=False)]
    space = frames(spark, rows, entries)
    asked = [(k, {int(c): float(rng.normal()) for c in rng.choice(45, 20, replace=False)}) for k in range(50)]
    queries = spark.createDataFrame(asked, "id bigint, vec map<bigint,double>")
    got = add_nearest_dealt(queries, "vec", space.rows, space.entries, size=200, most=9)
    of = {p: [(c, v) for q, c, v in entries if q == p] for p, _ in rows}
    assert {r.id: (r.nearest, r.nearest_order) for r in got.collect()} == {k: nearest_by_hand(rows, entries, v, False) for k, v in asked}
    assert all(abs(r.sim - cosines_by_hand(of[r.nearest], r.vec)) < 1e-12 for r in got.collect())
    none = add_nearest_dealt(queries, "vec", space.rows.limit(0), space.entries.limit(0))
    assert [tuple(r) for r in none.select("nearest", "nearest_order", "sim").distinct().collect()] == [(None, None, None)]
    zero = add_nearest_dealt(queries, "vec", space.rows, space.entries.limit(0))
    assert [tuple(r) for r in zero.select("nearest", "nearest_order", "sim").distinct().collect()] == [("p0", 0, 0.0)]


def test_a_large_space_with_common_components_is_not_joined(spark):
    rows, entries = planes(4, 400)
    space = frames(spark, rows, entries)
    asked = [(k, [1.0 if i == k % 5 else 0.0 for i in range(25)] + [k / 400]) for k in range(300)]
    queries = spark.createDataFrame(asked, "id bigint, vec array<double>")
    near = H.nearest_property(queries, space, ["id"], max_entries=0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "component" not in "".join(line for line in plan.splitlines() if "Join" in line)  # pairs of rows with a common component
    assert {r.id: r.nearest for r in near.collect()} == {r.id: r.nearest for r in H.nearest_property(queries, space, ["id"]).collect()}
