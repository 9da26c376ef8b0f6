"""Pairing of delimiter runs into emphasis, quotes, strikethrough, formulas, directive labels and cross references."""

from __future__ import annotations

from collections.abc import Callable

from inkstrata.core.tree import Node

#: How a matched pair is used up: parts of two runs, only the two ends, or everything from opener to closer.
RUN, ENDS, RANGE = "run", "ends", "range"


class Rule:
    """One kind of delimiter; `thirds` is the rule about lengths that are multiples of three."""

    __slots__ = ("name", "probe", "reduce", "thirds", "used")

    def __init__(self, name: str, used: str, thirds: bool, reduce: Callable, probe: Callable | None = None):
        self.name, self.used, self.thirds, self.reduce, self.probe = name, used, thirds, reduce, probe


class Mark:
    """One delimiter run in the text, and its neighbours among those still unpaired."""

    __slots__ = ("after", "before", "claim", "closes", "end", "left", "live", "node", "opens", "partner", "rule", "size", "start", "taken")

    def __init__(self, rule: Rule, node: Node, start: int, end: int, opens: bool, closes: bool, claim: int = 0):
        self.rule, self.node, self.start, self.end = rule, node, start, end
        self.opens, self.closes, self.claim = opens, closes, claim
        self.size = self.left = end - start
        self.live, self.taken = True, False
        self.before = self.after = self.partner = None


def _drop(mark: Mark) -> None:
    mark.live = False
    if mark.before is not None:
        mark.before.after = mark.after
    if mark.after is not None:
        mark.after.before = mark.before


def _fits(opener: Mark, closer: Mark) -> bool:
    if not opener.opens:
        return False
    if not closer.rule.thirds or not (closer.opens or opener.closes):
        return True
    return closer.size % 3 == 0 or (opener.size + closer.size) % 3 != 0


def pair(marks: list[Mark]) -> None:
    """Pair the marks, each closer with the nearest opener of its rule that fits.

    A closer that finds none bars the marks before it to later closers of its class, so that all searches together are
    linear.
    """
    marks = [m for m in marks if m.live]
    for a, b in zip(marks, marks[1:], strict=False):
        a.after, b.before = b, a
    if marks:
        marks[0].before = marks[-1].after = None
    stacks: dict[str, list[Mark]] = {}
    floors: dict[tuple[str, int], int] = {}
    for closer in marks:
        rule = closer.rule
        stack = stacks.setdefault(rule.name, [])
        while closer.live and closer.closes:
            key = (rule.name, closer.size % 3 if rule.thirds else 0)
            floor = floors.get(key, -1)
            while stack and not stack[-1].live:
                stack.pop()
            at, opener = len(stack) - 1, None
            while at >= 0 and stack[at].start >= floor:
                if stack[at].live and _fits(stack[at], closer):
                    opener = stack[at]
                    break
                at -= 1
            if opener is None:
                floors[key] = closer.start
                if not closer.opens:
                    _drop(closer)
                break
            use = (2 if opener.left >= 2 and closer.left >= 2 else 1) if rule.used == RUN else 0
            rule.reduce(opener, closer, use)
            if rule.used == ENDS:
                _drop(opener)
                _drop(closer)
                continue
            inner = closer.before
            while inner is not opener:
                _drop(inner)
                inner = inner.before
            if rule.used == RANGE:
                _drop(opener)
                _drop(closer)
                continue
            opener.left -= use
            closer.left -= use
            if not opener.left:
                _drop(opener)
            if not closer.left:
                _drop(closer)
        if closer.live:
            stack.append(closer)
