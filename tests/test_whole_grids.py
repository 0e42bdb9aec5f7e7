"""The supervised queries tune every family over its whole published grid."""

from types import SimpleNamespace

import pytest

from leadquarry.checks import supervised
from leadquarry.operators import supervised as SU


@pytest.mark.parametrize("query, families", [
    (supervised.supervised, {"LogisticRegression", "RandomForest", "BoostedTrees"}), (supervised.native, {"RandomForest"})])
def test_published_grids(monkeypatch, query, families):
    grids = {}

    class Asked(Exception):
        pass

    def train_models(df, specs):
        grids.update({name: spec[1] for name, spec in specs({"balanced_1": 1.0, "balanced_0": 1.0, "ratio": 1.0, "n": 10}).items()})
        raise Asked
    frame = SimpleNamespace(drop=lambda *_: None)
    monkeypatch.setattr(supervised, "ranked", lambda *_: frame)
    monkeypatch.setattr(SU, "presence_flags", lambda df: df)
    monkeypatch.setattr(SU, "pseudo_label", lambda df: df)
    monkeypatch.setattr(SU, "train_models", train_models)
    with pytest.raises(Asked):
        query(None, None)
    published = {"LogisticRegression": SU.LOGISTIC_GRID, "RandomForest": SU.FOREST_GRID, "BoostedTrees": SU.BOOSTED_GRID}
    assert grids == {name: published[name] for name in families}
