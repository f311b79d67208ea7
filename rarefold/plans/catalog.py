"""All registered queries and their oracles."""

from __future__ import annotations

import importlib

from rarefold.plans.registry import ORACLES, QUERIES

_MODULES = (
    "rarefold.plans.q_metrics",
    "rarefold.plans.q_prep",
    "rarefold.plans.q_model",
    "rarefold.plans.q_oversample",
    "rarefold.plans.q_synth",
    "rarefold.plans.q_select",
    "rarefold.plans.q_experiment",
    "rarefold.plans.q_contract",
)


def load_all():
    for m in _MODULES:
        importlib.import_module(m)
    return QUERIES, ORACLES
