"""Named bundles of retrieval constants, and overrides from JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

#: The constants of the default profile and of those that differ from it.
_WEIGHTS = {"semantic": 0.5, "keyword": 0.5, "exact": 0.3, "fact": 0.4, "entity": 0.4, "graph": 0.5}


@dataclass(frozen=True)
class Profile:
    name: str = "default"
    k: float = 60.0
    weights: dict[str, float] = field(default_factory=lambda: dict(_WEIGHTS))
    depth: int = 100
    half_life_days: float = 90.0
    recency_floor: float = 0.8
    recency_kinds: tuple[str, ...] | None = ("note", "conversation")
    gap: float = 0.5
    min_results: int = 3
    bands: tuple[float, float, float] = (0.60, 0.45, 0.30)
    semantic_floor: float = 0.30
    limit: int = 10
    graph_auto: bool = True
    arms: tuple[str, ...] = ()
    fusion: str = "rrf"
    rerank_top: int = 0


_DEFAULT = Profile()
PROFILES = {
    p.name: p
    for p in (
        _DEFAULT,
        replace(_DEFAULT, name="precise", depth=200, gap=0.6, min_results=2, rerank_top=30),
        replace(_DEFAULT, name="recency", recency_kinds=None, recency_floor=0.6, half_life_days=30.0),
        replace(_DEFAULT, name="code", weights={"semantic": 0.4, "keyword": 0.4, "exact": 0.6, "fact": 0.4, "entity": 0.5, "graph": 0.5}, recency_kinds=()),
        replace(_DEFAULT, name="keyword-only", weights={"keyword": 1.0}, arms=("keyword",)),
        replace(_DEFAULT, name="semantic-only", weights={"semantic": 1.0}, arms=("semantic",)),
        replace(_DEFAULT, name="no-graph", arms=("semantic", "keyword", "exact", "fact", "entity"), graph_auto=True),
        replace(_DEFAULT, name="text-only", arms=("semantic", "keyword", "exact", "fact"), graph_auto=False),
        replace(_DEFAULT, name="minmax", fusion="minmax"),
    )
}
#: Bands of models whose cosines run higher.
MODEL_BANDS = {"granite-small": (0.88, 0.80, 0.72), "granite": (0.85, 0.75, 0.65)}


def for_model(profile: Profile, model: str | None) -> Profile:
    """A model's own bands replace the profile's, and its weakest band the floor."""
    bands = MODEL_BANDS.get(model or "")
    return replace(profile, bands=bands, semantic_floor=bands[2]) if bands else profile


def with_overrides(text: str) -> dict[str, Profile]:
    """All profiles after overrides: {"name": {"constant": value}}; unknown names or constants are errors."""
    out = dict(PROFILES)
    known = {f.name for f in fields(Profile)}
    for name, changes in json.loads(text).items():
        if name not in out:
            raise ValueError(f"unknown profile {name}")
        if bad := set(changes) - known:
            raise ValueError(f"unknown constants {sorted(bad)}")
        weights = {**out[name].weights, **changes.pop("weights", {})}
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in changes.items()}
        out[name] = replace(out[name], weights=weights, **values)
    return out


_MEANING = {
    "k": "rank constant of reciprocal-rank fusion", "weights": "vote of each arm", "depth": "candidates of each arm", "half_life_days": "age at which recency is halfway to its floor",
    "recency_floor": "least recency factor", "recency_kinds": "kinds that age (none given: all)", "gap": "relative fall that ends the list", "min_results": "results before a fall can end it",
    "bands": "cosine of strong, moderate and weak", "semantic_floor": "least cosine of what only meaning found", "limit": "results", "graph_auto": "structural arms when a query names entities",
    "arms": "arms that may run (none given: all)", "fusion": "rrf or minmax", "rerank_top": "results that a reranker orders again",
}


def describe(profile: Profile) -> str:
    return "\n".join(f"{k:15} {v!s:40} {_MEANING[k]}" for k, v in asdict(profile).items() if k in _MEANING)
