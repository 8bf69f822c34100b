"""The standard rules as rows: (gates, links, fates, edits), in the columns of :mod:`wireflow.operators.patterns`."""

from __future__ import annotations

from wireflow.schema import CONTROLLED, CX, H


def _beyond(gate: str, side: str, port: int = 0) -> tuple:
    return True, gate, side, port


def _own(gate: str, side: str, port: int = 0) -> tuple:
    return False, gate, side, port


def _bridge(rule: str, a: str, b: str, port: int = 0) -> list[tuple]:
    """The neighbours before a and after b are linked to each other."""
    return [(rule, *_beyond(a, "prev", port), *_beyond(b, "next", port)), (rule, *_beyond(b, "next", port), *_beyond(a, "prev", port))]


def cancel_rows(first: int, second: int, p1: float, p2: float) -> tuple[list, list, list, list]:
    rule = f"cancel {first} {second}"
    return ([(rule, "g", [first], p1), (rule, "h", [second], p2)], [(rule, "g", 0, "h", 0)], [(rule, x, True, None, None, False) for x in "gh"], _bridge(rule, "g", "h"))


def cancel_two_rows(code: int, param: float) -> tuple[list, list, list, list]:
    rule = f"cancel {code} {code}"
    return ([(rule, x, [code], param) for x in "gh"], [(rule, "g", p, "h", p) for p in (0, 1)], [(rule, x, True, None, None, False) for x in "gh"], _bridge(rule, "g", "h", 0) + _bridge(rule, "g", "h", 1))


def fuse_rows(first: int, second: int, p1: float, p2: float, code: int, param: float) -> tuple[list, list, list, list]:
    rule = f"fuse {first} {second}"
    edits = [(rule, *_own("g", "next"), *_beyond("h", "next")), (rule, *_beyond("g", "prev"), *_own("g", "prev")), (rule, *_beyond("h", "next"), *_own("g", "next"))]
    return ([(rule, "g", [first], p1), (rule, "h", [second], p2)], [(rule, "g", 0, "h", 0)], [(rule, "g", False, code, param, False), (rule, "h", True, None, None, False)], edits)


def commute_rows(code: int, param: float) -> tuple[list, list, list, list]:
    rule = f"commute {code}"
    edits = [(rule, *_beyond("g", "prev"), *_own("h", "prev")), (rule, *_own("h", "prev"), *_beyond("g", "prev")), (rule, *_own("h", "next"), *_own("g", "prev")),
             (rule, *_own("g", "prev"), *_own("h", "next")), (rule, *_own("g", "next"), *_beyond("h", "next")), (rule, *_beyond("h", "next"), *_own("g", "next"))]
    return ([(rule, "g", [code], param), (rule, "h", list(CONTROLLED), None)], [(rule, "g", 0, "h", 0)], [], edits)


def reverse_rows() -> tuple[list, list, list, list]:
    rule = "reverse cx"
    gates = [(rule, "cx", [15, CX], None), *[(rule, x, [H], 1.0) for x in ("l1", "l2", "r1", "r2")]]
    links = [(rule, "l1", 0, "cx", 0), (rule, "l2", 0, "cx", 1), (rule, "cx", 0, "r1", 0), (rule, "cx", 1, "r2", 0)]
    fates = [(rule, "cx", False, None, None, True), *[(rule, x, True, None, None, False) for x in ("l1", "l2", "r1", "r2")]]
    edits = []
    for side, one, two in (("prev", "l1", "l2"), ("next", "r1", "r2")):  # what is beyond the H on one wire comes to the other port
        for outer, port in ((one, 1), (two, 0)):
            edits += [(rule, *_beyond(outer, side), *_own("cx", side, port)), (rule, *_own("cx", side, port), *_beyond(outer, side))]
    return gates, links, fates, edits
