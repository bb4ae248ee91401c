"""Edge states, worlds as bit masks, and uniforms from hashes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of an edge's state in one byte.
FIXED_UP, FIXED_DOWN, FREE_UP, FREE_DOWN = 1, 2, 4, 8
UP, DOWN, FIXED, FREE = FIXED_UP | FREE_UP, FIXED_DOWN | FREE_DOWN, FIXED_UP | FIXED_DOWN, FREE_UP | FREE_DOWN


def has(state: Column, mask: int) -> Column:
    """Whether an edge's state is one of those in the mask."""
    return state.bitwiseAND(F.lit(mask)) != 0


def is_up(world: Column, edge: int | Column) -> Column:
    """1 if the edge is up in a world given as a mask, else 0."""
    e = F.lit(edge) if isinstance(edge, int) else edge
    return F.call_function("shiftright", world, e.cast("int")).bitwiseAND(F.lit(1)).cast("int")


def uniform(*key: Column | str | int) -> Column:
    """A number in (0, 1) that depends on the key alone, not on partitions or order."""
    text = F.concat_ws(":", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48) + F.lit(2.0**-49)


def random_world(edges: int, p: float, *key: Column | str | int) -> Column:
    """Mask of a world in which each edge is up with probability p."""
    if not 0 <= edges <= 63:
        raise ValueError("a mask holds at most 63 edges")
    out = F.lit(0).cast("long")
    for e in range(edges):
        out = out + F.when(uniform(*key, e) < p, F.lit(1 << e)).otherwise(F.lit(0)).cast("long")
    return out


def up_count(world: Column) -> Column:
    """Number of edges that are up."""
    return F.bit_count(world)


def decode(world: Column, edges: int) -> Column:
    """A world's states as an array of codes; the world is formed once, not once an edge."""
    codes = lambda w: F.transform(F.sequence(F.lit(0), F.lit(edges - 1)), lambda e: F.when(is_up(w, e) == 1, F.lit(FREE_UP)).otherwise(F.lit(FREE_DOWN)).cast("tinyint"))
    return F.transform(F.array(world), codes)[0]


def encode(states: Column) -> Column:
    """The mask of an array of state codes."""
    bit = F.transform(states, lambda s, e: F.when(has(s, UP), F.call_function("shiftleft", F.lit(1).cast("long"), e)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bit, F.lit(0).cast("long"), lambda a, x: a + x)
