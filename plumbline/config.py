"""Settings: defaults, then a YAML file, then overrides, then the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

from plumbline.errors import ConfigError

SEVERITIES = ["critical", "high", "medium", "low", "info"]
COMPONENTS = ["integrity", "duplicates", "leakage", "annotation_validity", "annotation_coverage", "class_balance", "blur", "image_stats"]
FILE_NAMES = ("plumbline.yaml", "plumbline.yml")


@dataclass
class Quality:
    blur_threshold: float = 100.0
    min_side_px: int = 64
    max_aspect_ratio: float = 4.0
    dark_brightness: float = 35.0
    bright_brightness: float = 220.0
    low_contrast_std: float = 20.0
    analysis_max_side: int = 1024


@dataclass
class Annotations:
    tiny_box_area: float = 0.0004
    large_box_area: float = 0.95
    duplicate_iou: float = 0.95
    bounds_tolerance: float = 0.005
    max_boxes_for_iou: int = 2000
    max_label_bytes: int = 16 * 1024 * 1024


@dataclass
class Duplicates:
    enabled: bool = True
    phash_max_distance: int = 6
    dhash_max_distance: int = 10
    min_hash_std: float = 2.0
    max_bucket: int = 5000


@dataclass
class Scoring:
    weights: dict[str, float] = field(default_factory=lambda: dict(zip(COMPONENTS, (20.0, 10.0, 20.0, 20.0, 10.0, 10.0, 5.0, 5.0), strict=True)))
    zero_at: dict[str, float] = field(default_factory=lambda: dict(zip(COMPONENTS, (0.05, 0.20, 0.05, 0.05, 0.25, 100.0, 0.30, 0.30), strict=True)))


@dataclass
class Gate:
    fail_on: str | None = "high"
    fail_under: float | None = None
    max_corrupt_rate: float | None = None
    max_leakage_rate: float | None = None
    max_invalid_annotation_rate: float | None = None
    max_duplicate_rate: float | None = None
    max_blur_rate: float | None = None


@dataclass
class Config:
    quality: Quality = field(default_factory=Quality)
    annotations: Annotations = field(default_factory=Annotations)
    duplicates: Duplicates = field(default_factory=Duplicates)
    scoring: Scoring = field(default_factory=Scoring)
    ci: Gate = field(default_factory=Gate)
    max_file_bytes: int = 512 * 1024 * 1024
    max_pixels: int = 178_000_000
    workers: int = 0
    use_cache: bool = True

    def to_dict(self) -> dict:
        return _plain(self)

    def check(self) -> Config:
        """The same settings, if they make sense."""
        s = self.scoring
        rules = [
            (self.ci.fail_on is None or self.ci.fail_on in SEVERITIES, "ci.fail_on", f"one of {', '.join(SEVERITIES)} or null"),
            (self.workers >= 0, "workers", "0 or more"),
            (all(w >= 0 for w in s.weights.values()) and sum(s.weights.values()) > 0, "scoring.weights", "0 or more, and not all 0"),
            (all(z > 0 for z in s.zero_at.values()) and s.zero_at["class_balance"] > 1, "scoring.zero_at", "above 0, and class_balance above 1"),
            (0 <= self.duplicates.phash_max_distance <= 7, "duplicates.phash_max_distance", "from 0 to 7: eight parts find all pairs up to 7 only"),
            (self.quality.analysis_max_side >= 64, "quality.analysis_max_side", "64 or more"),
        ]
        for holds, key, wanted in rules:
            if not holds:
                raise ConfigError(f"{key} must be {wanted}")
        return self


def _plain(x: Any) -> Any:
    if is_dataclass(x):
        return {f.name: _plain(getattr(x, f.name)) for f in fields(x)}
    return dict(x) if isinstance(x, dict) else x


def _coerced(value: Any, like: str, path: str) -> Any:
    """value as the annotated type; a truth value is no number, and only a truth value is one."""
    if value is None:
        return None
    kind = like.split(" | ")[0]
    try:
        if kind == "bool":
            if isinstance(value, bool):
                return value
        elif kind in ("int", "float"):
            if not isinstance(value, bool) and (kind == "float" or float(value) == int(value)):
                return {"int": int, "float": float}[kind](value)
        elif isinstance(value, str):
            return value
    except (TypeError, ValueError):
        pass
    raise ConfigError(f"{path}: {value!r} is no {kind}")


def merge(target: Any, given: dict, path: str = "") -> None:
    """Puts given values into a settings object; unknown keys are errors with their dotted path."""
    if not isinstance(given, dict):
        raise ConfigError(f"{path.rstrip('.') or 'settings'} must be a mapping")
    if isinstance(target, dict):
        for k, v in given.items():
            if k not in target:
                raise ConfigError(f"unknown setting {path}{k}")
            target[k] = _coerced(v, "float", f"{path}{k}")
        return
    kinds = {f.name: f.type for f in fields(target)}
    for k, v in given.items():
        if k not in kinds:
            raise ConfigError(f"unknown setting {path}{k}")
        own = getattr(target, k)
        if is_dataclass(own) or isinstance(own, dict):
            merge(own, v if v is not None else {}, f"{path}{k}.")
        else:
            setattr(target, k, _coerced(v, kinds[k], f"{path}{k}"))


def load_config(path: str | Path | None = None, overrides: dict | None = None, env: dict | None = None) -> Config:
    """Defaults, then the file at path, then overrides, then PLUMBLINE_WORKERS and PLUMBLINE_NO_CACHE."""
    out, env = Config(), os.environ if env is None else env
    if path is not None:
        import yaml

        try:
            merge(out, yaml.safe_load(Path(path).read_text("utf-8")) or {})
        except (OSError, yaml.YAMLError) as e:
            raise ConfigError(f"{path}: {e}") from e
    merge(out, overrides or {})
    if "PLUMBLINE_WORKERS" in env:
        out.workers = _coerced(env["PLUMBLINE_WORKERS"], "int", "PLUMBLINE_WORKERS")
    if env.get("PLUMBLINE_NO_CACHE", "").lower() in ("1", "true", "yes"):
        out.use_cache = False
    return out.check()


def find_config(root: str | Path) -> Path | None:
    """The settings file in a dataset's folder."""
    return next((p for name in FILE_NAMES if (p := Path(root) / name).is_file()), None)
