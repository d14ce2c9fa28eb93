"""Which arms a request runs; decided on the driver, before any plan exists."""

from __future__ import annotations

import re

from ..functions.text import IDENTIFIER, RELATIONAL
from .profiles import Profile

_identifier, _relational = re.compile(IDENTIFIER), re.compile(RELATIONAL)
#: Arms of each mode.
_MODES = {"keyword": ["keyword"], "exact": ["exact"], "semantic": ["semantic"], "hybrid": ["semantic", "keyword", "fact"], "graph": ["entity", "graph"]}


NO_MODEL = "no embedding model available; semantic arm skipped"


def arms(mode: str, queries: list[str], profile: Profile, n_entities: int = 0, has_vectors: bool = True) -> tuple[list[str], list[str]]:
    """Arms of one request (its query and alternates) in order, and why. Structural arms go by its first query alone."""
    why = [f"mode={mode}"]
    chosen = list(_MODES.get(mode, ["semantic", "keyword", "fact"]))
    if mode not in _MODES:
        if any(_identifier.search(q) for q in queries):
            chosen.insert(2, "exact")
            why.append("an identifier-like token: exact arm")
    if mode in ("auto", "hybrid") and profile.graph_auto and queries:
        if n_entities >= 2 or (n_entities == 1 and _relational.search(queries[0])):
            chosen += ["entity", "graph"]
            why.append("known entities: structural arms")
    if profile.arms:
        chosen = [a for a in chosen if a in profile.arms]
    if not has_vectors and "semantic" in chosen:
        chosen.remove("semantic")
        why.append(NO_MODEL)
    return chosen, why
