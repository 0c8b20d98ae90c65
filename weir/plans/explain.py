"""Text forms of a query: its chain of steps and its possible filter orders."""

from __future__ import annotations

from itertools import permutations as orders


def query_plan(query) -> str:
    """Sink first, source last, one step a line."""
    source = f"source({query.input_type.name}, {query.path})" if query.frame is None else "source(DataFrame)"
    lines = [str(s) for s in reversed(query.steps)] + [source]
    text = "\n".join("  " * i + line for i, line in enumerate(lines))
    print(text)
    return text


def permutations(query) -> str:
    """Every order of each run of consecutive filters, numbered from 0."""
    out, run = [], []
    for step in [*query.steps, None]:
        if step is not None and step.kind == "filter":
            run += step.args[0].conjuncts()
            continue
        if len(run) > 1:
            out += [f"{k}: " + " -> ".join(map(str, order)) for k, order in enumerate(orders(run))]
        run = []
    text = "\n".join(out)
    print(text)
    return text
