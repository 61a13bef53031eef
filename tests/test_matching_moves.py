"""What the rounds of a matching do with all edges: read them, and shuffle only the least edge of each film."""

from assayer.operators import matching


def test_no_join_of_all_edges(spark, monkeypatch):
    """A level's first search joins the edges with nothing; later ones lose seen films after they met the front, not before."""
    plans, written = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or written(df, name))
    # A chain: the last cell's only film is taken, and all others have to move.
    edges = [(f"g{i}", f"d{i + k}") for i in range(6) for k in (0, 1)] + [(f"f{i}", "hot") for i in range(20)]
    found = [tuple(r) for r in matching.matched(spark.createDataFrame(edges + edges, "film string, cell string"), "film", "cell", 2).collect()]
    assert len(found) == len(set(found)) == 6 + 2 and set(found) <= set(edges)
    films = [p for name, p in plans if name == "films"]
    assert len(films) > 3 and "Join" not in films[0]
    assert not any("LeftAnti" in p for p in films)
    assert sum(name == "cells" for name, _ in plans) == 1 and "Aggregate" not in next(p for name, p in plans if name == "edges")
