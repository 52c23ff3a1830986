"""Which configurations of a graph are evaluated, when there are more than the budget takes."""

from __future__ import annotations

import itertools
import math

from .graph import Graph

Config = dict[str, str]


def plan(g: Graph, most: int = 64) -> tuple[list[Config], int]:
    """(configurations, size of the whole space): all of them if they fit, else a deterministic cover.

    The cover begins with the default and the configuration of every second choice, goes
    on with one later choice at a time, and fills up from a strided sample of the space: always
    the candidate that shows most unseen choices, then lies farthest from all chosen ones,
    then has the rarest choices, then comes first by name.
    """
    space = g.space()
    axes = sorted(space)
    whole = math.prod(len(space[a]) for a in axes)
    as_config = lambda choice: dict(zip(axes, choice, strict=True))
    if whole <= most:
        return [as_config(c) for c in itertools.product(*(space[a] for a in axes))], whole
    default = tuple(space[a][0] for a in axes)
    second = tuple(space[a][min(1, len(space[a]) - 1)] for a in axes)
    chosen = dict.fromkeys((default, second))
    for place in range(2, max(map(len, space.values()))):
        for i, a in enumerate(axes):
            if place < len(space[a]):
                chosen[default[:i] + (space[a][place],) + default[i + 1 :]] = None
    out = list(chosen)[:most]
    if len(out) < most:
        out += _fill(axes, space, out, whole, most)
    return [as_config(c) for c in out], whole


def _fill(axes: list[str], space: dict[str, list[str]], out: list[tuple], whole: int, most: int) -> list[tuple]:
    size = min(whole, max(512, 16 * most))
    stride = max(1, whole // size)
    while math.gcd(stride, whole) != 1:
        stride += 1

    def spell(number: int) -> tuple:
        digits = []
        for a in reversed(axes):
            number, digit = divmod(number, len(space[a]))
            digits.append(space[a][digit])
        return tuple(reversed(digits))

    taken = set(out)
    pool = [c for c in (spell(k * stride % whole) for k in range(size)) if c not in taken]
    count = {(i, choice): sum(c[i] == choice for c in out) for i, a in enumerate(axes) for choice in space[a]}
    apart = lambda c, d: sum(x != y for x, y in zip(c, d, strict=True))
    near = {c: min(apart(c, d) for d in out) for c in pool}
    more: list[tuple] = []
    while near and len(out) + len(more) < most:
        seen = lambda c: [count[i, x] for i, x in enumerate(c)]
        best = min(near, key=lambda c: (-seen(c).count(0), -near[c], -sum(1 / (1 + n) for n in seen(c)), c))
        del near[best]
        more.append(best)
        for i, x in enumerate(best):
            count[i, x] += 1
        for c in near:
            near[c] = min(near[c], apart(c, best))
    return more


def coverage(g: Graph, configs: list[Config]) -> dict[str, dict[str, int]]:
    """How often each choice of each axis is planned."""
    return {a: {x: sum(c[a] == x for c in configs) for x in ids} for a, ids in sorted(g.space().items())}


def finalists(g: Graph, configs: list[Config], scores: list[float], keep: int) -> list[int]:
    """Places of the best by approximate score (ties to the earlier), the default among them."""
    keep = min(keep, len(configs))
    best = sorted(range(len(configs)), key=lambda i: (-scores[i], i))[:keep]
    default = g.default_config()
    if keep > 1 and all(configs[i] != default for i in best) and default in configs:
        best[-1] = configs.index(default)
    return sorted(best)
