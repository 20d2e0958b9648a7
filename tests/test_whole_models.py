"""The registered model queries run the whole operator: all strengths, all models."""

from kinspark.matching import models
from kinspark.plans import core_queries


def test_lr_fit_predict_tunes_over_all_strengths(monkeypatch):
    tried = []

    def tune(name, names, train, val, strengths, balances):
        tried.extend(strengths)
        return type("F", (), {"score": lambda self, pairs: pairs})()

    monkeypatch.setattr(models, "_tune", tune)
    monkeypatch.setattr(core_queries, "_splits", lambda spark, d, attributes=None: [None, None, None])
    core_queries.lr_fit_predict(None, "")
    assert tried == [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]


def test_compare_report_has_every_model_for_both_strategies(spark, data):
    rows = core_queries.compare_report(spark, data).collect()
    assert len(rows) == 6 and {r["model"] for r in rows} == {"logistic", "distance", "text"}
