"""Packed longs of a record, as column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2025-01-01T00:00:00Z in milliseconds, and the ranges of fields.
EPOCH = 1735689600000
XZ, Y, STATE, WORLD = 33_554_432, 2048, (1 << 24) - 1, 4095


def _long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def _bits(c: Column, low: int, size: int) -> Column:
    return F.shiftrightunsigned(c, low).bitwiseAND(F.lit((1 << size) - 1).cast("bigint"))


def _signed(c: Column, low: int, size: int) -> Column:
    return F.shiftright(F.shiftleft(c, 64 - low - size), 64 - size)


def _mask(c, size: int) -> Column:
    return _long(c).bitwiseAND(F.lit((1 << size) - 1).cast("bigint"))


def pack_position(x, y, z) -> Column:
    """x in 26 bits, z in 26, y in 12, all signed."""
    return F.shiftleft(_long(x), 38).bitwiseOR(F.shiftleft(_mask(z, 26), 12)).bitwiseOR(_mask(y, 12))


def unpack_position(p) -> dict[str, Column]:
    return {"x": _signed(_long(p), 38, 26).cast("int"), "y": _signed(_long(p), 0, 12).cast("int"), "z": _signed(_long(p), 12, 26).cast("int")}


def pack_states(before, after, aux) -> Column:
    return F.shiftleft(_long(before), 40).bitwiseOR(F.shiftleft(_mask(after, 24), 16)).bitwiseOR(_mask(aux, 16))


def unpack_states(s) -> dict[str, Column]:
    return {"b": _bits(_long(s), 40, 24).cast("int"), "a": _bits(_long(s), 16, 24).cast("int"), "aux": _bits(_long(s), 0, 16).cast("int")}


def pack_actor_time(relative, actor) -> Column:
    return F.shiftleft(_long(relative), 24).bitwiseOR(_mask(actor, 24))


def unpack_actor_time(v) -> dict[str, Column]:
    return {"relative": _bits(_long(v), 24, 40), "actor_low": _bits(_long(v), 0, 24).cast("int")}


def pack_metadata(seq, w, cause, kind, actor) -> Column:
    parts = ((seq, 16, 48), (w, 12, 36), (cause, 8, 28), (kind, 4, 24))
    out = F.shiftleft(F.shiftrightunsigned(_long(actor), 24).bitwiseAND(F.lit(255).cast("bigint")), 16)
    for c, size, low in parts:
        out = out.bitwiseOR(F.shiftleft(_mask(c, size), low))
    return out


def unpack_metadata(m) -> dict[str, Column]:
    m = _long(m)
    return {"seq": _bits(m, 48, 16).cast("int"), "w": _bits(m, 36, 12).cast("int"), "cause": _bits(m, 28, 8).cast("int"), "kind": _bits(m, 24, 4).cast("int"), "actor_high": _bits(m, 16, 8).cast("int")}


def actor_id(high, low) -> Column:
    """32 bits as a signed int."""
    return _signed(F.shiftleft(_long(high), 24).bitwiseOR(_long(low)), 0, 32).cast("int")


def in_range(x, y, z) -> Column:
    return F.col(x).between(-XZ, XZ - 1) & F.col(y).between(-Y, Y - 1) & F.col(z).between(-XZ, XZ - 1)


def relative(ts) -> Column:
    return _long(ts) - EPOCH


def representable(ts) -> Column:
    return relative(ts).between(0, (1 << 40) - 1)


def stamp(ts, seq) -> Column:
    return F.shiftleft(_long(ts), 16).bitwiseOR(_mask(seq, 16))


def unstamp(s) -> dict[str, Column]:
    s = _long(s)
    return {"ts": F.shiftright(s, 16), "seq": _bits(s, 0, 16).cast("int"), "slot": _bits(s, 0, 6).cast("int")}
