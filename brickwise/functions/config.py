"""Strict run configurations, dotted overrides and merges of nested options."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class Region:
    start: tuple[int, int, int]
    size: tuple[int, int, int]

    @property
    def stop(self) -> tuple[int, ...]:
        return tuple(a + n for a, n in zip(self.start, self.size, strict=True))

    def scaled(self, factor: int) -> Region:
        """The region on a level that is coarser by the factor, which must divide it."""
        if any(v % factor for v in (*self.start, *self.size)):
            raise ValueError(f"{self} can't be divided by {factor}")
        return Region(tuple(v // factor for v in self.start), tuple(v // factor for v in self.size))


@dataclass(frozen=True)
class Run:
    """A run: where the volume is, its level and pitch, the region, and free options by stage."""

    volume: str
    region: Region
    level: int = 0
    voxel_um: float = 2.4
    extra: dict[str, Any] = field(default_factory=dict)


def _triple(value: Any, name: str, least: int) -> tuple[int, int, int]:
    if not isinstance(value, list) or len(value) != 3 or not all(isinstance(v, int) and v >= least for v in value):
        raise ValueError(f"{name} must be three integers of at least {least}")
    return tuple(value)


def parse_run(text: str) -> Run:
    """A run from JSON; unknown keys are errors at every level."""
    raw = json.loads(text)

    def known(given: dict, names: set[str], where: str) -> None:
        if extra := set(given) - names:
            raise ValueError(f"unknown keys in {where}: {sorted(extra)}")

    known(raw, {f.name for f in fields(Run)}, "run")
    known(raw["region"], {"start", "size"}, "region")
    region = Region(_triple(raw["region"]["start"], "start", 0), _triple(raw["region"]["size"], "size", 1))
    return Run(**{**raw, "region": region})


def merged(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``, dictionaries merged key by key."""
    return {**base, **{k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def overridden(options: dict, changes: dict[str, Any]) -> dict:
    """``options`` with values at dotted paths replaced or added."""
    out = options
    for path, value in changes.items():
        for key in reversed(path.split(".")):
            value = {key: value}
        out = merged(out, value)
    return out


def differing(want: dict, have: dict) -> list[str]:
    """Keys whose values differ or that only one side has."""
    return sorted(k for k in want.keys() | have.keys() if want.get(k, ...) != have.get(k, ...))


def byte_budget(items: dict[str, int], limit: int) -> str:
    """A table of byte estimates; an error if they exceed the limit, before anything is read."""
    total = sum(items.values())
    table = "\n".join(f"{n:>14,d}  {name}" for name, n in [*items.items(), ("total", total)])
    if total > limit:
        raise MemoryError(f"{total:,d} bytes exceed {limit:,d}\n{table}")
    return table


#: Version of affine descriptions that is read; fixed value.
TRANSFORM_VERSION = "1.0.0"


@dataclass(frozen=True)
class Transform:
    """An affine map between two volumes in x, y, z order, 4 x 4, with the name of the fixed one and the landmarks that it was fitted on."""

    matrix: list[list[float]]
    fixed_volume: str
    fixed_landmarks: list[list[float]] = field(default_factory=list)
    moving_landmarks: list[list[float]] = field(default_factory=list)


def parse_transform(text: str, version: str = TRANSFORM_VERSION) -> Transform:
    """An affine map from its JSON description; another version, a missing key or a matrix that isn't 3 x 4 is an error."""
    raw = json.loads(text)
    if raw.get("schema_version") != version:
        raise ValueError(f"version {raw.get('schema_version')!r} isn't {version!r}")
    if missing := {"fixed_volume", "transformation_matrix"} - set(raw):
        raise ValueError(f"missing keys {sorted(missing)}")
    rows = [[float(v) for v in r] for r in raw["transformation_matrix"]]
    if [len(r) for r in rows] != [4, 4, 4]:
        raise ValueError("the matrix must be 3 x 4")
    marks = {n: [[float(v) for v in p] for p in raw.get(n, [])] for n in ("fixed_landmarks", "moving_landmarks")}
    return Transform([*rows, [0.0, 0.0, 0.0, 1.0]], str(raw["fixed_volume"]), **marks)
