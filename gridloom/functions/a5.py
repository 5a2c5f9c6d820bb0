"""A5 cells: the hierarchy of their ids as column expressions.

An id has 64 bits and is written as hexadecimal digits without leading zeros.  The
six highest bits are the face (resolution 0) or the face times 5 and a fifth of
it; two bits follow for each resolution from 2 on, the place along the curve
through the fifth; the lowest bit that is set marks the resolution.  A face has five
children, all others four.

Only the arithmetic of ids is here: where a cell lies on the sphere needs A5's
projection, which this version has not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.guard import finer

NAME, GEODESIC = "a5", True
FACES, FIFTHS, TOP = 12, 5, 58


def marker(res: int) -> int:
    """The place of the bit that marks a resolution."""
    return TOP - 1 - res if res < 2 else TOP + 1 - 2 * res


def number(cell: Column) -> Column:
    """The id as a signed long of the same bits."""
    return F.conv(cell, 16, -10).cast("long")


def named(bits: Column) -> Column:
    return F.lower(F.hex(bits))


def resolution(cell: Column) -> Column:
    bits = number(cell)
    at = F.bit_count(bits.bitwiseAND(-bits) - 1)
    return F.when(at > TOP - 3, TOP - 1 - at).otherwise(((TOP + 1 - at) / 2).cast("int"))


def _head(cell: Column, res: int) -> Column:
    """The bits of a cell's ancestor without its marker."""
    bits = number(cell)
    top = F.shiftrightunsigned(bits, TOP)
    if res == 0:
        return F.shiftleft(F.when(bits.bitwiseAND((1 << TOP) - 1) == 1 << marker(0), top).otherwise(F.floor(top / FIFTHS)).cast("long"), TOP)
    if res == 1:
        return F.shiftleft(top, TOP)
    return bits.bitwiseAND(F.lit(-(1 << marker(res) + 1)))


def parent(cell: Column, res: int) -> Column:
    """The ancestor at ``res``; a cell at ``res`` is its own."""
    return named(_head(cell, res).bitwiseOR(F.lit(1 << marker(res))))


def _below(cell: Column, from_res: int, res: int, k: Column) -> Column:
    """Descendant ``k`` of a cell."""
    head = _head(cell, from_res)
    if from_res == 0:
        inner = leaf_count(1, res)
        head = F.shiftleft(F.shiftrightunsigned(head, TOP) * FIFTHS + F.floor(k / inner).cast("long"), TOP)
        k = k % inner
    place = F.shiftleft(k.cast("long"), marker(res) + 1) if res > 1 else F.lit(0)
    return named(head.bitwiseOR(place).bitwiseOR(F.lit(1 << marker(res))))


def children(cell: Column, from_res: int, res: int) -> Column:
    if res <= from_res:
        return F.array(cell)
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(leaf_count(from_res, res) - 1).cast("long")), lambda k: _below(cell, from_res, res, k))


def representative(cell: Column, res: int) -> Column:
    """The descendant with the lowest id; an error for a cell that is not coarser."""
    own = resolution(cell)
    out = _below(cell, 0, res, F.lit(0).cast("long"))
    out = F.when(own == 0, out).otherwise(named(number(cell).bitwiseAND(number(cell) - 1).bitwiseOR(F.lit(1 << marker(res)))))
    return finer(own, res, out)


def leaf_count(from_res: int, res: int) -> int:
    if res <= from_res:
        return 1
    return FIFTHS * 4 ** (res - 1) if from_res == 0 else 4 ** (res - from_res)


def ancestor(cell: str, parent_res: int) -> str:
    """``parent`` of one cell, on the driver."""
    bits = int(cell, 16)
    top = bits >> TOP
    if parent_res == 0:
        own = bits & (1 << TOP) - 1 == 1 << marker(0)
        return f"{(top if own else top // FIFTHS) << TOP | 1 << marker(0):x}"
    return f"{bits >> marker(parent_res) + 1 << marker(parent_res) + 1 | 1 << marker(parent_res):x}" if parent_res > 1 else f"{top << TOP | 1 << marker(1):x}"
