"""Queries on the main classifier train it as declared."""

from dataclasses import replace

import pytest

from rarefold.operators import boost
from rarefold.operators import select as R

SF = "/root/testdata/sf0.001"


@pytest.fixture
def asked(monkeypatch):
    """The settings that fits are asked for; two trees are grown of each."""
    seen, whole = [], boost.train_boosted

    def short(train, features, target, val=None, weight=1.0, params=boost.BoostParams(), categorical=None):
        assert val is not None
        seen.append(params)
        return whole(train, features, target, None, weight, replace(params, max_iter=2, early_stopping_rounds=None), categorical)

    monkeypatch.setattr(boost, "train_boosted", short)
    return seen


def test_ablation_is_whole(spark, monkeypatch, asked):
    from rarefold.plans.q_experiment import q_ablation

    episodes, whole = [], R.fit_accept_rule

    def counted(pool, *args, **kwargs):
        rule, summary = whole(pool, *args, **kwargs)
        episodes.append((min(R.EPISODE_SIZE, pool.count()), sorted(tuple(r) for r in summary.select("episode", "n_candidates").collect())))
        return rule, summary

    monkeypatch.setattr(R, "fit_accept_rule", counted)
    assert q_ablation(spark, SF).count() == 4
    assert asked == [boost.BoostParams()] * 4
    assert episodes == [(n, [(e, n) for e in range(R.EPISODES_PER_UPDATE)]) for n, _ in episodes] and len(episodes) == 1


def test_classifier_scores_are_of_the_declared_classifier(spark, asked):
    from rarefold.plans.q_model import q_classifier_scores

    assert q_classifier_scores(spark, SF).count() > 0
    assert asked == [boost.BoostParams()]


def test_train_evaluate_is_whole(spark, asked):
    from rarefold.plans.q_experiment import q_train_evaluate

    assert q_train_evaluate(spark, SF).count() == 4
    assert asked == [boost.BoostParams()] * 8  # four scenarios, the final model, three scenarios again
