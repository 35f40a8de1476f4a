"""Chunks, Morton keys and boxes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BIAS, BITS = 1 << 21, 22
XZ, Y = 33_554_432, 2048


def chunk(v) -> Column:
    return F.shiftright(F.col(v) if isinstance(v, str) else v, 4)


def _spread(v: Column) -> Column:
    """The bits of v at even places, four at a time, so that the expression has v only six times: where a filter on a
    computed key is pushed to the scan, its generated code must stay small to be compiled.

    Four copies of four bits are masked to bit i of copy i, five places apart; a product without carries moves them.
    """
    v = v.cast("bigint") + BIAS
    number = lambda n: F.lit(n).cast("bigint")
    bits = [F.shiftright(v, 4 * k).bitwiseAND(number(15)) for k in range(6)]
    moved = [F.shiftright((b * number(0x1111)).bitwiseAND(number(0x8421)) * number(0x249), 9).bitwiseAND(number(0x55)) for b in bits]
    return reduce(lambda p, q: p.bitwiseOR(q), [F.shiftleft(m, 8 * k) for k, m in enumerate(moved)])


def morton(cx: Column, cz: Column) -> Column:
    """The key of a chunk: both biased, x in the even bits."""
    return _spread(cx).bitwiseOR(F.shiftleft(_spread(cz), 1))


def _squeeze(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(0x5555555555555555).cast("bigint"))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return (v - BIAS).cast("int")


def unmorton(c) -> dict[str, Column]:
    c = F.col(c) if isinstance(c, str) else c
    return {"cx": _squeeze(c), "cz": _squeeze(F.shiftrightunsigned(c, 1))}


def morton_int(cx: int, cz: int) -> int:
    return sum(((cx + BIAS) >> i & 1) << 2 * i | ((cz + BIAS) >> i & 1) << 2 * i + 1 for i in range(BITS))


def local(x, y, z) -> Column:
    """Place within the chunk: 4 bits of x, 4 of z, 12 of y."""
    low = lambda v: F.col(v).bitwiseAND(F.lit(15))
    return F.shiftleft(low(x), 16).bitwiseOR(F.shiftleft(low(z), 12)).bitwiseOR((F.col(y) + 2048).bitwiseAND(F.lit(4095)))


def from_local(c, p) -> dict[str, Column]:
    at = unmorton(c)
    p = F.col(p)
    part = lambda n: F.shiftright(p, n).bitwiseAND(F.lit(15))
    return {"x": F.shiftleft(at["cx"], 4) + part(16), "y": p.bitwiseAND(F.lit(4095)) - 2048, "z": F.shiftleft(at["cz"], 4) + part(12)}


@dataclass(frozen=True)
class Box:
    """Blocks, all six faces inclusive."""

    x0: int
    y0: int
    z0: int
    x1: int
    y1: int
    z1: int

    def __post_init__(self):
        if self.x0 > self.x1 or self.y0 > self.y1 or self.z0 > self.z1:
            raise ValueError("a box's lower corner is above its upper one")

    @classmethod
    def around(cls, x: int, y: int, z: int, r: int) -> Box:
        at = lambda v, m: max(-m, min(m - 1, v))
        return cls(at(x - r, XZ), at(y - r, Y), at(z - r, XZ), at(x + r, XZ), at(y + r, Y), at(z + r, XZ))

    @classmethod
    def everything(cls) -> Box:
        return cls(-XZ, -Y, -XZ, XZ - 1, Y - 1, XZ - 1)

    @property
    def aligned(self) -> bool:
        return not (self.x0 & 15 or self.z0 & 15 or (self.x1 + 1) & 15 or (self.z1 + 1) & 15 or self.y0 > -Y or self.y1 < Y - 1)

    def holds(self) -> Column:
        return F.col("x").between(self.x0, self.x1) & F.col("y").between(self.y0, self.y1) & F.col("z").between(self.z0, self.z1)

    def chunks(self) -> tuple[int, int, int, int]:
        return self.x0 >> 4, self.z0 >> 4, self.x1 >> 4, self.z1 >> 4


def cover(rect: tuple[int, int, int, int], most: int = 64, gap: int = 8) -> list[tuple[int, int, bool]]:
    """Key ranges (low, high, exact) that hold all chunks of a rectangle, at most so many, rising.

    The square of all chunks is quartered breadth first: quarters inside are exact, those outside are dropped, and those
    still across the border when there would be more than `most` are taken whole. Ranges at most `gap` apart are joined.
    """
    x0, z0, x1, z1 = (v + BIAS for v in rect)
    done: list[tuple[int, int, bool]] = []
    level, size = [(0, 0, 0)], 1 << BITS
    while level:
        cut = []
        for x, z, key in level:
            if x > x1 or z > z1 or x + size <= x0 or z + size <= z0:
                continue
            if x >= x0 and z >= z0 and x + size - 1 <= x1 and z + size - 1 <= z1:
                done.append((key, key + size * size - 1, True))
            else:
                cut.append((x, z, key))
        if len(done) + 4 * len(cut) > most * 4:
            done += [(key, key + size * size - 1, False) for _, _, key in cut]
            break
        size >>= 1
        level = [(x + dx * size, z + dz * size, key + (dx + 2 * dz) * size * size) for x, z, key in cut for dz in (0, 1) for dx in (0, 1)]
    done.sort()
    out: list[tuple[int, int, bool]] = []
    for low, high, exact in done:
        if out and low - out[-1][1] - 1 <= gap:
            out[-1] = (out[-1][0], high, out[-1][2] and exact and low == out[-1][1] + 1)
        else:
            out.append((low, high, exact))
    while len(out) > most:  # join the pair with the least between
        k = min(range(len(out) - 1), key=lambda i: out[i + 1][0] - out[i][1])
        out[k : k + 2] = [(out[k][0], out[k + 1][1], False)]
    return out
