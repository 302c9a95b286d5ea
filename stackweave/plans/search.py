"""Search over parameters: spaces as data, grid and seeded random search, runs with stored parameters."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame

from ..operators.metrics import loss
from .scoring import Settings, evaluate, evaluate_two_stage

# Domains of the searched parameters, (low, high) uniform or a list of choices.
_HALVES = [k / 2 for k in range(11)]
_SHARED = {
    "aggregate": ["max", "avg_query", "avg_cand", "avg_short", "avg_long", "avg_query_cand"],
    "distinct_stacks": [False, True],
    "frequency_by_stack": [False, True],
    "trim_percent": (0.0, 130.0),
    "recursion": [None, "jumps", "repeats"],
}
_UNKNOWN = {"keep_unknown": [False, True], "frequency_of_unknown": [None, 99.999]}
_WEIGHTED = {"df_coef": (0.0, 100.0), "pos_coef": (0.0, 30.0), "diff_coef": (0.0, 30.0)}
SPACES: dict[str, dict[str, dict]] = {
    "weighted": {"shared": _SHARED, "own": _WEIGHTED},
    "weighted_no_place": {"shared": _SHARED, "own": _WEIGHTED | {"diff_coef": [0.0]}},
    "weighted_no_global": {"shared": _SHARED, "own": _WEIGHTED | {"df_coef": [0.0]}},
    "weighted_no_local": {"shared": _SHARED, "own": _WEIGHTED | {"pos_coef": [0.0]}},
    "weighted_no_norm": {"shared": _SHARED, "own": _WEIGHTED | {"no_norm": [True]}},
    "linear": {"shared": _SHARED, "own": {"gap": _HALVES, "coef_gap": [1.0], "mismatch": [0.0]}},
    "alignment": {"shared": _SHARED, "own": {"indel": _HALVES, "mismatch": _HALVES, "match": [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0]}},
    "positional": {"shared": _SHARED, "own": {"c": (0.0, 30.0), "o": (0.0, 30.0)}},
    "two_stage": {"shared": _SHARED | {"alpha": (0.0, 1.0), "n_top": list(range(1, 400))}, "own": {"c": (0.0, 30.0), "o": (0.0, 30.0)}},
    "prefix": {"shared": _SHARED, "own": {}},
    "bag": {"shared": {"n_gram": list(range(1, 8)), "keep_unknown": [True]}, "own": {}},
}


def space(method: str, search_unknown: bool = False) -> dict[str, dict]:
    """The method's domains, with those of unknown functions where a dataset has many."""
    found = SPACES[method]
    return {"shared": found["shared"] | (_UNKNOWN if search_unknown else {}), "own": found["own"]}


def _draw(domain: tuple | list, rng: random.Random) -> object:
    return rng.uniform(*domain) if isinstance(domain, tuple) else rng.choice(domain)


def random_settings(method: str, base: Settings, seed: int, search_unknown: bool = False) -> Iterator[Settings]:
    """Endless seeded draws from the method's space; drawn values override those of ``base``."""
    rng, domains = random.Random(seed), space(method, search_unknown)
    while True:
        own = {k: _draw(d, rng) for k, d in domains["own"].items()}
        shared = {k: _draw(d, rng) for k, d in domains["shared"].items()}
        if shared.get("trim_percent") == 0:
            continue
        yield replace(base, method=method.split("_no_")[0], params=base.params | own, **shared)


def grid_settings(method: str, base: Settings) -> Iterator[Settings]:
    """All combinations of a space of choices."""
    domains = space(method)
    if any(isinstance(d, tuple) for part in domains.values() for d in part.values()):
        raise ValueError(f"{method} has continuous domains")
    names = [*domains["own"], *domains["shared"]]
    for values in itertools.product(*domains["own"].values(), *domains["shared"].values()):
        drawn = dict(zip(names, values))
        yield replace(base, method=method, params=base.params | {k: drawn[k] for k in domains["own"]}, **{k: drawn[k] for k in domains["shared"]})


def run_search(settings: Iterator[Settings], evaluations: int, measure: Callable[[Settings], tuple[float | None, float | None]]) -> list[tuple[float, Settings]]:
    """(loss, settings) of each evaluation, best first. ``measure`` gives (mrr, auc)."""
    tried = [(loss(*measure(s)), s) for s in itertools.islice(settings, evaluations)]
    return sorted(tried, key=lambda t: t[0])


def measure_with(canonical: DataFrame, flat: DataFrame, queries: DataFrame, text_scores: DataFrame | None = None) -> Callable[[Settings], tuple[float | None, float | None]]:
    """Measures settings on one dataset; reads two single-row results. The method ``two_stage`` needs ``text_scores``."""

    def measure(s: Settings) -> tuple[float | None, float | None]:
        run = evaluate_two_stage(canonical, flat, queries, text_scores, s) if s.method == "two_stage" else evaluate(canonical, flat, queries, s)
        return run.recall.first().mrr, run.auc.first().auc

    return measure


def stored_settings(text: str, base: Settings) -> dict[str, Settings]:
    """Settings by chunk from JSON ``{chunk: {name: value}}``; names that are no shared knob are the method's own."""
    known = set(Settings.__dataclass_fields__) - {"params"}
    out = {}
    for chunk, given in json.loads(text).items():
        shared = {k: v for k, v in given.items() if k in known}
        own = {k: v for k, v in given.items() if k not in known}
        out[chunk] = replace(base, params=base.params | own, **shared)
    return out
