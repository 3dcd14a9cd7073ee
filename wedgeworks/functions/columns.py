"""Column functions: vertex owners, the Lehmer generator, range predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lehmer generator (fixed values): multiplier, modulus, first value.
MULTIPLIER, MODULUS, FIRST = 16807, 2147483647, 1967017404


def whole(value: Column, by: Column | int) -> Column:
    """Integer division."""
    return F.call_function("div", value, F.lit(by) if isinstance(by, int) else by)


def owner(vertex: Column, nv: int, parts: int) -> Column:
    """Part of a vertex when part p holds the ids from nv * p div parts on, in closed form."""
    return whole((vertex + 1) * F.lit(parts) - 1, nv).cast("long")


def lehmer(k: Column) -> Column:
    """k-th value of the stream, for 0 <= k < 2^31, without its predecessors: one modular product per set
    bit of k, each below 2^62."""
    powers = [pow(MULTIPLIER, 1 << b, MODULUS) for b in range(31)]
    bit = lambda b: F.shiftright(k, b).bitwiseAND(F.lit(1).cast("long")) == 1
    # an array fold keeps the expression's size linear in the number of bits
    steps = F.array(*(F.when(bit(b), F.lit(p).cast("long")).otherwise(F.lit(1).cast("long")) for b, p in enumerate(powers)))
    return F.aggregate(steps, F.lit(FIRST).cast("long"), lambda x, p: (x * p) % MODULUS)


def unit(value: Column) -> Column:
    """A generator value scaled into the unit interval."""
    return value * F.lit(1.0 / MODULUS)


def within_range(value: Column, low: Column, high: Column) -> Column:
    return (value >= low) & (value <= high)


def distance(pairs: list[tuple[Column, Column]]) -> Column:
    """Euclidean distance."""
    return F.sqrt(reduce(lambda a, b: a + b, ((x - y) * (x - y) for x, y in pairs)))


def is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def round_up(n: int, multiple: int) -> int:
    return n if multiple == 0 else -(-n // multiple) * multiple
