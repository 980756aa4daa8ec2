"""Settings of a run: dataclasses with defaults, optionally read from a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Normalise:
    max_numbers: int = 6
    pseudo_min_len: int = 5
    component_min_count: int = 40
    component_min_share: float = 0.5
    foreign_max_ratio: float = 0.2
    translit_min_count: int = 3
    translit_min_share: float = 0.5
    locality_min_share: float = 0.0005


@dataclass(frozen=True)
class Blocking:
    name_tokens: int = 5
    addr_tokens: int = 6
    number_keys: int = 3
    pair_tokens: int = 3
    key_cap: int = 150
    top: int = 8
    min_rel_votes: float = 0.35
    name1_key: bool = True
    addr_pair_key: bool = True
    num_del_key: bool = True


@dataclass(frozen=True)
class Split:
    valid: float = 0.10
    test: float = 0.10
    train: float = 0.50


@dataclass(frozen=True)
class Model:
    trees: int = 20
    depth: int = 5
    step: float = 0.2
    folds: int = 2
    stages: int = 3
    seed: int = 42
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Decide:
    min_prob: float = 0.0
    fill_min_prob: float = 0.5


@dataclass(frozen=True)
class Config:
    normalise: Normalise = field(default_factory=Normalise)
    blocking: Blocking = field(default_factory=Blocking)
    split: Split = field(default_factory=Split)
    model: Model = field(default_factory=Model)
    decide: Decide = field(default_factory=Decide)


def load(path: str) -> Config:
    """A TOML file with a table for each section; unknown keys are an error, missing ones keep their defaults."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    kinds = {f.name: f.default_factory for f in fields(Config)}
    if extra := set(raw) - set(kinds):
        raise KeyError(f"unknown sections: {sorted(extra)}")
    return Config(**{k: type(kinds[k]())(**{a: tuple(b) if isinstance(b, list) else b for a, b in v.items()}) for k, v in raw.items()})
