"""Fitting segments to a token budget: splitting what is too large, joining what is too small."""

from __future__ import annotations

import math
from dataclasses import replace

from .segments import Segment


class Budget:
    """Token estimates of line ranges: a quarter of their characters (UTF-16 units, line feeds counted), rounded up."""

    def __init__(self, lines: list[str], most: int, least: int):
        self.most, self.least, self.count = most, least, len(lines)
        self.size = [len(x) + 1 + sum(ch > "￿" for ch in x) for x in lines]
        self.upto = [0]
        for s in self.size:
            self.upto.append(self.upto[-1] + s)

    def tokens(self, first: int, last: int) -> int:
        last = min(last, self.count - 1)
        return math.ceil((self.upto[last + 1] - self.upto[first]) / 4) if last >= first else 0

    def over(self, part: Segment) -> bool:
        return self.tokens(part.first, part.last) > self.most


def by_lines(part: Segment, budget: Budget) -> list[Segment]:
    """Parts of whole lines: a new part begins before the line that would exceed the budget."""
    cuts, used, room = [part.first], 0, budget.most * 4
    for i in range(part.first, part.last + 1):
        size = budget.size[i] if i < budget.count else 1
        if used + size > room and i > cuts[-1]:
            cuts.append(i)
            used = 0
        used += size
    ends = [c - 1 for c in cuts[1:]] + [part.last]
    label = f"{part.symbol} " if part.symbol else ""
    return [Segment(a, b, part.kind + "_part", f"{label}(part {n})") for n, (a, b) in enumerate(zip(cuts, ends), 1) if a <= b]


def by_members(part: Segment, budget: Budget) -> list[Segment]:
    """One piece a member; text between members is a piece of its own if large enough, else the next member's."""
    out: list[Segment] = []
    at, owner = part.first, part.symbol or part.owner
    for child in part.children:
        symbol = f"{owner}.{child.symbol}" if child.symbol else part.symbol
        start = child.first
        if start > at:
            if budget.tokens(at, start - 1) >= budget.least:
                out.append(Segment(at, start - 1, part.kind + "_header", part.symbol))
            else:
                start = at
        else:
            start = min(at, start)
        out.append(Segment(start, child.last, child.kind, symbol, blocks=child.blocks))
        at = child.last + 1
    if at <= part.last:
        if budget.tokens(at, part.last) >= budget.least:
            out.append(Segment(at, part.last, part.kind + "_footer", part.symbol))
        elif out:
            out[-1].last = part.last
    return out


def by_blocks(part: Segment, budget: Budget) -> list[Segment]:
    """Runs of statements that fit the budget; the last one reaches the segment's end."""
    out: list[Segment] = []
    first, *later = part.blocks
    start = part.first
    if first.first > part.first and budget.tokens(part.first, first.first - 1) >= budget.least:
        out.append(Segment(part.first, first.first - 1, part.kind + "_header", part.symbol))
        start = first.first
    end = first.last
    for block in later:
        if budget.tokens(start, block.last) > budget.most:
            out.append(Segment(start, end, part.kind + "_block", part.symbol))
            start = end + 1
        end = block.last
    return [*out, Segment(start, part.last, part.kind + "_block", part.symbol)]


def fitted(part: Segment, budget: Budget) -> list[Segment]:
    """A segment cut to the budget: by members (then again), by blocks, or by lines."""
    if not budget.over(part):
        return [Segment(part.first, part.last, part.kind, part.symbol)]
    if part.children:
        return [piece for member in by_members(part, budget) for piece in fitted(member, budget)]
    return by_blocks(part, budget) if len(part.blocks) > 1 else by_lines(part, budget)


def joined(parts: list[Segment], budget: Budget) -> list[Segment]:
    """Neighbours joined while either is below the least size; the larger one names the result."""
    out: list[Segment] = []
    for part in parts:
        size = budget.tokens(part.first, part.last)
        if out:
            last = out[-1]
            have = budget.tokens(last.first, last.last)
            if have < budget.least or size < budget.least:
                named = part if have < size else last
                out[-1] = replace(last, last=part.last, kind=named.kind, symbol=named.symbol)
                continue
        out.append(replace(part))
    return out
