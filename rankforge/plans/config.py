"""Settings of a run: defaults, overlaid by dataset family."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class SplitConfig:
    rating_threshold: float = 4.0
    min_user_interactions: int = 5
    min_item_interactions: int = 5
    train_share: tuple[int, int] = (7, 10)  # exact fractions, so that every engine cuts at the same row
    valid_end: tuple[int, int] = (8, 10)
    item_cold_quantile: float = 0.05
    user_cold_quantile: float = 0.05
    long_tail_quantile: float = 0.20
    valid_per_user: int | None = None  # leave-last-n instead of the global cut
    test_per_user: int | None = None
    max_test_users: int | None = None
    num_negatives: int = 49
    negative_sampling: str = "uniform"  # or popularity
    seed: int = 42


@dataclass(frozen=True)
class FusionConfig:
    alpha: float = 0.5
    beta: float = 0.45
    gamma: float = 0.30
    popularity_penalty: float = 0.10
    tail_boost: float = 0.05


def overlay(config: Any, settings: dict[str, Any]) -> Any:
    """The settings of a dataset family over the defaults; unknown names are errors."""
    known = {f.name for f in fields(config)}
    if unknown := sorted(set(settings) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return replace(config, **settings)


def family(dataset: str) -> str:
    """movielens, yelp, amazon or mind, by the prefix of a dataset's name."""
    for prefix, name in {"ml-": "movielens", "yelp": "yelp", "amazon": "amazon", "mind": "mind"}.items():
        if dataset.lower().startswith(prefix):
            return name
    raise ValueError(f"no dataset family for {dataset!r}")


def load(path: str) -> dict[str, Any]:
    """A YAML file, or a JSON one where no YAML library is there; relative paths under ``paths`` are taken from the file's folder."""
    import json
    from pathlib import Path

    text = Path(path).read_text()
    try:
        import yaml

        config = yaml.safe_load(text)
    except ImportError:
        config = json.loads(text)
    root = Path(path).resolve().parent
    config["paths"] = {k: str((root / v).resolve()) for k, v in config.get("paths", {}).items()}
    return config
