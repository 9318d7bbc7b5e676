"""Map dataset columns to the inputs of an analysis."""

from __future__ import annotations

from shoalwatch.plans.schema import Column

# fixed values: what else each type accepts, best first
ACCEPTS: dict[str, list[set[str]]] = {
    "text": [{"text"}, {"identifier", "url"}],
    "float": [{"float", "integer"}],
    "time": [{"time"}, {"datetime"}],
    "identifier": [{"identifier"}, {"url", "datetime"}, {"integer"}, {"text"}],
}
HINT_BONUS = 10


def compatibility(expected: str, actual: str) -> int | None:
    """0 for the same type, less for each tier further, None if incompatible."""
    if expected == actual:
        return 0
    for tier, types in enumerate(ACCEPTS.get(expected, [])):
        if actual in types:
            return -(tier + 1)
    return None


def hinted(name: str, hint: str) -> bool:
    """Every word of the hint is in the column's name, whatever the case."""
    return all(word in name.lower() for word in hint.lower().split(" "))


def automap(columns: dict[str, str], inputs: tuple[Column, ...]) -> dict[str, str]:
    """Input name to dataset column, by type and name hints.

    The first of the best wins; a column may serve several inputs; inputs
    without any compatible column are left out.
    """
    out = {}
    for wanted in inputs:
        scored = []
        for name, actual in columns.items():
            if (score := compatibility(wanted.type, actual)) is not None:
                scored.append((score + HINT_BONUS * any(hinted(name, h) for h in wanted.hints), name))
        if scored:
            out[wanted.name] = max(scored, key=lambda s: s[0])[1]
    return out
