"""Fingerprints of 64 bits as points: the popcounts of their two-bit segments, and distances of such points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: bytes.translate: A to Z in lower case.
LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))


def embedding(fp: Column) -> Column:
    """32 two-bit fields, each the popcount (0 to 2) of the two bits there."""
    low, other = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    one, two = fp.bitwiseXOR(other).bitwiseAND(low), fp.bitwiseAND(other).bitwiseAND(low)
    return one.bitwiseOR(F.shiftleft(two, 1))


def manhattan(a: Column, b: Column) -> Column:
    """The Manhattan distance of two embeddings. Fields hold 0, 1 or 2, so two differ by one just if their low bits do."""
    x = a.bitwiseXOR(b)
    odd, even = x.bitwiseAND(F.lit(0x5555555555555555)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x5555555555555555))
    return F.bit_count(odd) + 2 * F.bit_count(even.bitwiseAND(F.bitwise_not(odd)))


def close(a: str, b: str, distance: int) -> Column:
    """Whether the fingerprints in two columns differ in ``distance`` bits or fewer: by the lower bound first, then exactly."""
    one, two = F.col(a), F.col(b)
    return (manhattan(embedding(one), embedding(two)) <= distance) & (F.bit_count(one.bitwiseXOR(two)) <= distance)
