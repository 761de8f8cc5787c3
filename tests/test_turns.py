"""The turn loop: a run that dies goes on where it stopped and gives the rows of an unbroken one."""

import pytest

from turnloom.operators import turns
from turnloom.plans import flows
from turnloom.registry import Tables

STAGES = ["respond", "index", "follow", "place", "dedup", "rewrite", "act", "fill", "balance", "filter"]


def rows(df):
    return sorted(map(str, df.collect()))




def test_a_killed_loop_goes_on(spark, sf, tmp_path, monkeypatch):
    t = Tables(spark, sf)
    whole, want = flows.turn_loop(t, str(tmp_path / "whole"), 3)
    assert whole.made == ["seeds-user", "seeds-assistant", *(f"turn{n}-{s}" for n in (1, 2, 3) for s in STAGES)]
    assert {len(r.history) for r in want.collect()} == {3}

    class Killed(Exception):
        pass

    act = turns.TurnLoop.act
    monkeypatch.setattr(turns.TurnLoop, "act", lambda self, rewrites: (_ for _ in ()).throw(Killed()) if rewrites.selectExpr("max(size(history))").first()[0] == 3 else act(self, rewrites))
    with pytest.raises(Killed):
        flows.turn_loop(t, str(tmp_path / "part"), 3)
    monkeypatch.undo()
    part, got = flows.turn_loop(t, str(tmp_path / "part"), 3)
    assert part.made == [f"turn3-{s}" for s in STAGES[6:]] and rows(got) == rows(want)
    again, _ = flows.turn_loop(t, str(tmp_path / "part"), 3)
    assert again.made == []
    other, _ = flows.turn_loop(t, str(tmp_path / "part"), 1, name="another")
    assert other.made == [f"turn1-{s}" for s in STAGES]


def test_stages_depend_on_what_they_are_made_from(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    tables = turns.StageTables(spark, str(tmp_path / "out"))
    double = lambda x, by: x.selectExpr(f"id * {by} as id")
    first = tables.run("double", double, {"x": tables.source(spark.read.parquet(str(tmp_path / "in")))}, by=2)
    tables.run("double", double, {"x": tables.source(spark.read.parquet(str(tmp_path / "in")))}, by=2)
    assert tables.made == ["double"] and sorted(r.id for r in first.df.collect()) == [0, 2, 4, 6, 8]
    tables.run("double", double, {"x": tables.source(spark.read.parquet(str(tmp_path / "in")))}, by=3)
    spark.range(2).write.mode("append").parquet(str(tmp_path / "in"))
    more = tables.run("double", double, {"x": tables.source(spark.read.parquet(str(tmp_path / "in")))}, by=2)
    assert tables.made == ["double"] * 3 and more.df.count() == 7
