"""Scalar functions: readable names, two's complement, angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wireflow.schema import GATES


def readable(code) -> Column:
    """The readable name of a gate code."""
    names = F.create_map(*[x for c, _, _, _, r in GATES for x in (F.lit(c), F.lit(r))])
    return names[F.col(code).cast("int") if isinstance(code, str) else code.cast("int")]


def twos_complement(x: Column, bits: int) -> Column:
    """The lowest ``bits`` bits."""
    return F.right(F.lpad(F.bin(x.cast("bigint")), 64, "0"), F.lit(bits))


def common_angle(angle: Column, tolerance: float) -> Column:
    """k in 0..7 if the angle is k / 4 (multiples of pi, modulo 2) within a tolerance, else null."""
    turn = F.pmod(angle, F.lit(2.0)) * 4
    return F.when(F.abs(turn - F.round(turn)) <= tolerance, F.pmod(F.round(turn).cast("bigint"), F.lit(8)).cast("bigint"))
