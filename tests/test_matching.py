"""Matchings by rounds of joins against augmenting paths on one machine."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import matching, montecarlo


def largest(edges, per_cell):
    """How many films the largest matching has: one augmenting path after the other, cells split into their places."""
    cells = {}
    for film, cell in sorted(set(edges)):
        cells.setdefault(cell, []).append(film)
    owner = {}

    def place(start):
        seen, stack, path = set(), [(start, iter(cells[start[0]]))], []
        while stack:
            film = next((x for x in stack[-1][1] if x not in seen), None)
            if film is None:
                stack.pop()
                del path[-1:]
                continue
            seen.add(film)
            path.append(film)
            if film not in owner:
                owner.update((x, c) for x, (c, _) in zip(path, stack))
                return
            stack.append((owner[film], iter(cells[owner[film][0]])))

    for k in range(per_cell):
        for c in sorted(cells):
            place((c, k))
    return len(owner)


def checked(df, edges, per_cell):
    rows = [tuple(r) for r in df.select("film", "cell").collect()]
    assert set(rows) <= set(edges) and len({f for f, _ in rows}) == len(rows)
    sizes = {}
    for _, c in rows:
        sizes[c] = sizes.get(c, 0) + 1
    assert max(sizes.values()) <= per_cell
    return rows, sizes


@pytest.mark.parametrize("seed,per_cell", [(1, 1), (2, 2)])
def test_scarce_films_need_long_paths(spark, seed, per_cell):
    """Cells that share few films, among them a chain where the last to come moves all others."""
    rng = random.Random(seed)
    edges = [(f"f{rng.randrange(40)}", f"c{rng.randrange(25)}") for _ in range(70)] + [(f"g{i}", f"d{i + k}") for i in range(12) for k in (0, 1)]
    df = spark.createDataFrame(edges + edges[:5] + [(None, "c1"), ("f1", None)], "film string, cell string")
    rows, _ = checked(matching.matched(df, "film", "cell", per_cell), edges, per_cell)
    assert len(rows) == largest(edges, per_cell)


def test_ten_thousand_cells(spark):
    """As many as on one machine; a third of all edges lie at one cell."""
    rng = random.Random(5)
    edges = [(f"f{rng.randrange(14_000)}", f"c{i % 10_000}") for i in range(16_000)] + [(f"f{i}", "hot") for i in range(8_000)]
    found = montecarlo.assigned(spark.createDataFrame(edges, "film string, cell string").repartition(8), "film", "cell", 1)
    rows, _ = checked(found, edges, 1)
    assert len(rows) == largest(edges, 1)


def test_levels_are_even(spark):
    edges = [(f"f{i}", f"c{j}") for i in range(40) for j in range(4) if (i + j) % 2 == 0 or j == 0]
    _, sizes = checked(matching.matched(spark.createDataFrame(edges, "film string, cell string"), "film", "cell", 3), edges, 3)
    assert sizes == {f"c{j}": 3 for j in range(4)}


def test_nothing_to_match(spark):
    df = spark.createDataFrame([], "film string, cell string")
    assert matching.matched(df, "film", "cell", 2).collect() == [] and matching.matched(df.withColumn("x", F.lit(1)), "film", "cell", 1).columns == ["film", "cell"]
