"""Fixed-point codes of stored channels, as column functions.

Bytes are rounded half to even (``rint``). Code 0 of a distance means no data. Codes are ints: Spark has no unsigned byte.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SDF_CLIP = 20.0


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def _byte(value: Column, low: int = 0) -> Column:
    return clip(F.rint(value), float(low), 255.0).cast("int")


def encode_signed(value: Column) -> Column:
    """[-1, 1] to 0..255, zero between 127 and 128."""
    return _byte(127.5 + 127.5 * value)


def decode_signed(code: Column) -> Column:
    return (code - 127.5) / 127.5


def encode_sdf(value: Column, limit: float = SDF_CLIP) -> Column:
    """Signed distance, clipped to +-limit, to 1..255; 128 is the surface."""
    return _byte(128 + clip(value, -limit, limit) * (127.0 / limit), 1)


def decode_sdf(code: Column, limit: float = SDF_CLIP) -> Column:
    return (code - 128) * (limit / 127.0)


def encode_density(value: Column) -> Column:
    return _byte(value * 1000)


def decode_density(code: Column) -> Column:
    return code / 1000.0


def encode_prob(value: Column) -> Column:
    return _byte(value * 255)


def decode_prob(code: Column) -> Column:
    return code / 255.0


def to_byte(value: Column, kind: str) -> Column:
    """Source values as bytes: ``u16`` keeps the upper byte, ``float`` in [0, 1] is scaled and truncated, ``int`` is clipped."""
    if kind == "u16":
        return F.shiftright(value.cast("int"), 8)
    if kind == "float":
        return clip(value * 255, 0.0, 255.0).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(255), value.cast("int")))


def encode_band_distance(distance: Column, has_data: Column, half: float) -> Column:
    """Band byte: above 127 inside the half width, at or below 127 outside, up to 48 steps either way; 0 without data."""
    d = F.abs(distance)
    inside = 127 + clip(F.rint(half - d + 1), 1.0, 48.0)
    outside = 128 - clip(F.rint(d - half), 1.0, 48.0)
    return F.when(~has_data, 0).otherwise(F.when(d <= half, inside).otherwise(outside).cast("int"))


def hemisphere_bytes(nx: Column, ny: Column, nz: Column) -> tuple[Column, Column]:
    """x and y of a line's direction, turned so that z isn't negative, as bytes around 128."""
    sign = F.when(nz < 0, -1.0).otherwise(1.0)
    return _byte(128 + 127 * nx * sign), _byte(128 + 127 * ny * sign)


def body_sdf(inner: Column, outer: Column) -> Column:
    """Signed distance of the body between an inner and an outer face, positive inside."""
    return F.least(inner, -outer)


def face_distance(inner: Column, outer: Column) -> Column:
    return F.least(F.abs(inner), F.abs(outer))


def in_body(inner: Column, outer: Column) -> Column:
    return (inner > 0) & (outer < 0)


def face_saturated(inner_code: Column, outer_code: Column) -> Column:
    """Whether both faces are at an end of their code range, so that nothing is known between them."""
    return inner_code.isin(1, 255) & outer_code.isin(1, 255)


def zero_set(code: Column, tolerance: int = 1) -> Column:
    return (code != 0) & (F.abs(code - 128) <= tolerance)


def medial_sdf(inner: Column, outer: Column) -> Column:
    return 0.5 * (inner + outer)


def line_angle(first: Column, second: Column) -> Column:
    """Angle of an undirected line from its two codes: ``first`` has the cosine of twice the angle, ``second`` the cosine less the sine, both scaled to [0, 1]."""
    cosine = 2.0 * first - 1.0
    return F.atan2(cosine - math.sqrt(2.0) * (2.0 * second - 1.0), cosine) * 0.5


def line_codes(gx: Column, gy: Column, eps: float = 1e-12) -> tuple[Column, Column]:
    """The two codes of the line along (gx, gy)."""
    square = gx * gx + gy * gy + eps
    cosine, sine = (gx * gx - gy * gy) / square, 2.0 * gx * gy / square
    return 0.5 + 0.5 * cosine, 0.5 + 0.5 * (cosine - sine) / math.sqrt(2.0)


def scale_value(voxel_um: Column, base_um: float = 2.4) -> Column:
    """Resolution as octaves above the base pitch."""
    return F.log2(voxel_um / base_um)


def activate(raw: Column, kind: str) -> Column:
    """Raw output to its physical range: ``sigmoid``, ``relu``, ``clamp01`` or ``none``."""
    return {"sigmoid": 1 / (1 + F.exp(-raw)), "relu": F.greatest(F.lit(0.0), raw), "clamp01": clip(raw, 0.0, 1.0), "none": raw}[kind]


def softmax2(a: Column, b: Column) -> Column:
    """Probability of the second of two classes: a logistic of the difference."""
    return 1 / (1 + F.exp(a - b))


#: Blocks of channels in the order in which they are appended to a label store; an older store is a prefix.
CHANNEL_BLOCKS = {
    "base": ["sdf", "sdf_valid", "ink", "ink_valid"],
    "faces": ["sdf_in", "sdf_out", "faces_valid", "thickness"],
    "fiber": ["fiber_vt", "fiber_hz", "fiber_valid"],
    "rv": ["faces_source", "rv_class", "hzvt_class"],
    "winding_fine": ["wf_sin", "wf_cos", "wf_density", "wf_nx", "wf_ny", "wf_nz", "wf_conf", "wf_valid"],
}


def channel_names(*blocks: str) -> list[str]:
    """Channels of a store with the given optional blocks, in stored order."""
    unknown = set(blocks) - set(CHANNEL_BLOCKS)
    if unknown:
        raise KeyError(f"unknown channel blocks {sorted(unknown)}")
    return [c for b, names in CHANNEL_BLOCKS.items() if b == "base" or b in blocks for c in names]


def is_prefix(older: list[str], newer: list[str]) -> bool:
    return newer[: len(older)] == older


def octave_level(voxel_um: float, target_um: float, tolerance: float = 0.005) -> int:
    """Pyramid level whose pitch is the target's; an error if it's off by more than the tolerance."""
    level = round(math.log2(target_um / voxel_um))
    if abs(voxel_um * 2**level / target_um - 1) > tolerance:
        raise ValueError(f"no level of {voxel_um} um has a pitch of {target_um} um")
    return level
