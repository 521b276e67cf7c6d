"""How many Python workers a task of a layer with slots holds."""

import numpy as np
import pytest

from driftline.plans import slots as S
from driftline.sources import synthetic


def workers(rows) -> int:
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    return sum("MapInArrow" in line for line in plan.splitlines())


@pytest.mark.parametrize("shared", [False, True])
def test_models_between_expansions_share_a_worker(spark, monkeypatch, shared):
    """All five slots filled: a task of a pass holds two workers at most, its own one among them, and one that applies the layer two; four each before."""
    seen, states = [], S._states

    def counted(rows, *more):
        seen.append(workers(rows) + 1)
        return states(rows, *more)

    monkeypatch.setattr(S, "_states", counted)
    rows = synthetic.embeddings(spark, "/root/testdata/sf0.001", size=8)
    layer = S.SlotLayer(((0, 1, 2, 3), (4, 5, 6, 7)), pca="PrincipalComponents", order="Ordering", expansions=("identity", "u08"), reduction="Whitening", parameters={"pca": {"outputs": 3}, "reduction": {"outputs": 4}, "outputs": 2, "ridge": 1e-6}, shared=shared)
    trained = S.train_slots(rows, layer, "class")
    assert seen == [1, 1, 2, 2]
    out = S.apply_slots(rows, trained)
    assert workers(out) == 2

    at = {r["sample_id"]: r["features"] for r in rows.collect()}
    models = [m for _, m in trained.steps if m]
    for r in out.collect():
        want = []
        for k, c in enumerate(layer.connections):
            own = [m[0 if shared else k] for m in models]
            y = own[1](own[0](np.array([[at[r["sample_id"]][p] for p in c]])))
            y = own[3](own[2](np.concatenate([y, np.abs(y) ** 0.8], axis=1)))
            want += y[0].tolist()
        assert np.allclose(r["features"], want, atol=1e-9)
