"""Films matched to cells of limited room, as many as can be, by rounds of joins: for many cells, with nothing but counts on the driver.

Cells are filled level by level: none gets its second film while another could still get its first. In a round all cells with
room search at once, breadth first: a film that a cell could have, then the cell that has it now, and so on. Each film and each
cell is reached from one searching cell only, the first, so that paths to free films, one a searching cell, share nothing
and are all followed at once: films along them change cells, the free one comes in. A level is done when a round finds none;
then no path is left, and the matching is the largest. Which films are taken is settled by digests: the same in each run.

Films or cells that are null match nothing; repeated edges count once, as a film takes one cell of those that reach it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.sources.tables import written


def _round(edges: DataFrame, cells: DataFrame, now: DataFrame, level: int) -> DataFrame | None:
    """The films (film, cell) that change or get their cell by one path from each searching cell; None if there is no path.

    A film may be reached from the cell that has it: that cell searches or was reached before, so no path goes through that film anyway.
    """
    full = written(now.groupBy("cell").count().where(F.col("count") >= level).select("cell"), "full")
    front = written(cells.join(full, "cell", "left_anti").withColumn("root", F.col("cell")), "front")
    layers: list[tuple[DataFrame, DataFrame]] = []
    seen_cells, seen_films = front.select("cell"), None
    # At a level's start all cells search, and all edges lead on.
    reach = edges.withColumn("root", F.col("cell")) if full.isEmpty() else edges.join(front.select("cell", "root"), "cell")
    while True:
        if seen_films is not None:
            # An anti join would be moved below the join with the front, to all edges.
            reach = reach.join(seen_films.withColumn("seen", F.lit(True)), "film", "left").where("seen is null").drop("seen")
        # A cell's root goes with it, and is the cell itself at first.
        first = F.min(F.struct(F.xxhash64("film", "cell").alias("order"), "cell", *(["root"] if layers else []))).alias("x")
        films = written(reach.groupBy("film").agg(first).select("film", "x.cell", F.col("x.root" if layers else "x.cell").alias("root")), "films")
        layers.append((films, front))
        free = written(films.join(now, "film", "left_anti").groupBy("root").agg(F.min(F.struct(F.xxhash64("film").alias("order"), "film")).alias("x")).select("root", "x.film"), "free")
        if not free.isEmpty():
            break
        seen_films = films.select("film") if seen_films is None else seen_films.unionByName(films.select("film"))
        held = films.select("film", "root").join(now, "film").join(seen_cells, "cell", "left_anti")
        front = written(held.groupBy("cell").agg(F.min(F.struct(F.xxhash64("film").alias("order"), "film", "root")).alias("x")).select("cell", F.col("x.film").alias("via"), "x.root"), "front")
        if front.isEmpty():
            return None
        seen_cells = seen_cells.unionByName(front.select("cell"))
        reach = edges.join(front.select("cell", "root"), "cell")
    # Back from the free films: each goes to the cell that reached it, and the film by which that cell was reached moves on.
    changes, at = [], free.select("film")
    for k in range(len(layers) - 1, -1, -1):
        films, front = layers[k]
        step = written(at.join(films, "film").select("film", "cell"), "step")
        changes.append(step)
        if k:
            at = step.join(front, "cell").select(F.col("via").alias("film"))
    return reduce(DataFrame.unionByName, changes)


def matched(edges: DataFrame, film: str, cell: str, per_cell: int) -> DataFrame:
    """(film, cell): each film at most once, each cell at most per_cell times, over pairs of edges; no matching has more."""
    rows = written(edges.select(F.col(film).alias("film"), F.col(cell).alias("cell")).where("film is not null and cell is not null"), "edges")
    cells = written(rows.select("cell").distinct(), "cells")
    now = rows.limit(0)
    for level in range(1, per_cell + 1):
        before = -1
        while (changes := _round(rows, cells, now, level)) is not None:
            now = written(now.join(changes.select("film"), "film", "left_anti").unionByName(changes), "matching")
            if (n := now.count()) <= before:
                raise RuntimeError("a round of the matching added nothing")
            before = n
    return now.select(F.col("film").alias(film), F.col("cell").alias(cell))
