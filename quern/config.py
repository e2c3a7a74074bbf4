"""Settings of a run: a frozen dataclass, checked when made, also from the environment (``DEDUP_*``) or a JSON object."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Callable, Mapping
from typing import Any

from quern.errors import ConfigError

_RANGES: dict[str, tuple[Callable[[Any], bool], str]] = {
    "shingle_size": (lambda v: v >= 1, "at least 1"),
    "shingle_mode": (lambda v: v in ("char", "word"), "'char' or 'word'"),
    "cjk_ratio_threshold": (lambda v: 0 <= v <= 1, "within 0 and 1"),
    "num_hash_functions": (lambda v: v >= 1, "at least 1"),
    "lsh_bands": (lambda v: v >= 1, "at least 1"),
    "lsh_rows": (lambda v: v >= 1, "at least 1"),
    "jaccard_threshold": (lambda v: 0 <= v <= 1, "within 0 and 1"),
    "representative_strategy": (lambda v: v in ("longest", "first", "random"), "'longest', 'first' or 'random'"),
    "batch_size": (lambda v: v >= 1, "at least 1"),
    "random_seed": (lambda v: v >= 0, "at least 0"),
    "output_format": (lambda v: v in ("jsonl", "parquet"), "'jsonl' or 'parquet'"),
    "bloom_expected_pairs": (lambda v: v >= 1, "at least 1"),
    "bloom_false_positive_rate": (lambda v: 0 < v < 1, "between 0 and 1"),
    "min_cluster_size": (lambda v: v >= 2, "at least 2"),
}


@dataclasses.dataclass(frozen=True)
class PipelineConfig:
    """``use_numba``, ``use_bloom_filter`` and the Bloom settings are accepted for compatibility: signatures are always vectorised and pairs always exact."""

    shingle_size: int = 5
    shingle_mode: str = "char"
    cjk_ratio_threshold: float = 0.2
    num_hash_functions: int = 128
    use_numba: bool = False
    lsh_bands: int = 16
    lsh_rows: int = 8
    jaccard_threshold: float = 0.8
    high_precision_mode: bool = False
    representative_strategy: str = "longest"
    batch_size: int = 10_000
    random_seed: int = 42
    checkpoint_dir: str | None = None
    output_format: str = "jsonl"
    text_field: str = "text"
    id_field: str = "id"
    use_bloom_filter: bool = True
    bloom_expected_pairs: int = 1_000_000
    bloom_false_positive_rate: float = 0.01
    min_cluster_size: int = 2
    single_file: bool = False  # one output file instead of a directory of parts, for small outputs

    def __post_init__(self) -> None:
        for f in dataclasses.fields(self):
            value, wanted = getattr(self, f.name), type(f.default)
            if wanted is int and (isinstance(value, bool) or not isinstance(value, int)):
                raise ConfigError(f"{f.name} has to be a whole number, not {value!r}")
            if wanted is float and (isinstance(value, bool) or not isinstance(value, (int, float))):
                raise ConfigError(f"{f.name} has to be a number, not {value!r}")
            if wanted in (bool, str) and not isinstance(value, wanted):
                raise ConfigError(f"{f.name} has to be of type {wanted.__name__}, not {value!r}")
        for name, (ok, allowed) in _RANGES.items():
            if not ok(getattr(self, name)):
                raise ConfigError(f"{name} has to be {allowed}, not {getattr(self, name)!r}")
        if self.lsh_bands * self.lsh_rows != self.num_hash_functions:
            raise ConfigError(f"{self.lsh_bands} bands of {self.lsh_rows} rows don't make {self.num_hash_functions} hash functions")

    def replace(self, **changes: Any) -> PipelineConfig:
        return self.from_mapping(self.to_dict() | changes)

    def to_dict(self) -> dict[str, Any]:
        return dataclasses.asdict(self)

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any]) -> PipelineConfig:
        if unknown := set(values) - {f.name for f in dataclasses.fields(cls)}:
            raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values)

    @classmethod
    def from_env(cls, environ: Mapping[str, str] | None = None, **overrides: Any) -> PipelineConfig:
        """Settings named ``DEDUP_<NAME>``; ``overrides`` win."""
        given = os.environ if environ is None else environ
        found: dict[str, Any] = {}
        for f in dataclasses.fields(cls):
            raw = given.get(f"DEDUP_{f.name.upper()}")
            if raw is None:
                continue
            kind = type(f.default)
            try:
                found[f.name] = {"true": True, "1": True, "false": False, "0": False}[raw.lower()] if kind is bool else kind(raw) if kind in (int, float) else raw
            except (KeyError, ValueError) as e:
                raise ConfigError(f"DEDUP_{f.name.upper()} can't be {raw!r}") from e
        return cls.from_mapping(found | overrides)

    @classmethod
    def from_json(cls, path: str, **overrides: Any) -> PipelineConfig:
        try:
            with open(path, encoding="utf-8") as file:
                values = json.load(file)
        except (OSError, ValueError) as e:
            raise ConfigError(f"{path} can't be read as JSON: {e}") from e
        if not isinstance(values, dict):
            raise ConfigError(f"{path} doesn't hold a JSON object")
        return cls.from_mapping(values | overrides)
