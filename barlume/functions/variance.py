"""Variance contributions of one bar, as expressions on log prices. A null price gives a null contribution."""

from __future__ import annotations

import math

from pyspark.sql import Column

LN2 = math.log(2)


def ctc(c: Column, cp: Column) -> Column:
    return (c - cp) * (c - cp)


def parkinson(h: Column, lo: Column) -> Column:
    return (h - lo) * (h - lo) / (4 * LN2)


def garman_klass(o: Column, h: Column, lo: Column, c: Column) -> Column:
    return 0.5 * (h - lo) * (h - lo) - (2 * LN2 - 1) * (c - o) * (c - o)


def rogers_satchell(o: Column, h: Column, lo: Column, c: Column) -> Column:
    return (h - o) * (h - c) + (lo - o) * (lo - c)


def gk_yang_zhang(o: Column, h: Column, lo: Column, c: Column, cp: Column) -> Column:
    return (o - cp) * (o - cp) + garman_klass(o, h, lo, c)


def yz_weight(window: int) -> float:
    """The weight of the open-to-close term."""
    if window < 2:
        raise ValueError("the window must hold two bars")
    return 0.34 / (1.34 + (window + 1) / (window - 1))
