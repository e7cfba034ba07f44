"""Registered queries that run at their operator's own defaults."""

from meshlark.plans import candidates, registry


def test_repair_surface_runs_at_its_defaults(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(candidates, "repair_surface", lambda *args, **kwargs: asked.update(kwargs))
    registry.queries()["repair_surface"](spark, "/root/testdata/sf0.001")
    assert not {"overlap", "iterations"} & set(asked)
