"""Settings of search, re-ranking and trends, with their default values."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class SentimentBoost:
    enabled: bool = False
    factors: dict[str, float] = field(default_factory=lambda: {"positive": 1.2, "negative": 0.8, "mixed": 1.0, "not_applicable": 1.0})


@dataclass(frozen=True)
class AspectBoost:
    enabled: bool = True
    factor: float = 1.3


@dataclass(frozen=True)
class TimeDecay:
    enabled: bool = True
    rate: float = 0.001  # per day
    threshold: float = 0.005  # scores closer than this to a neighbour's decay


@dataclass(frozen=True)
class Diversity:
    enabled: bool = True
    weight: float = 0.8  # of relevance, against similarity to what is chosen already
    pool: int = 50


@dataclass(frozen=True)
class SearchConfig:
    rrf_k: int = 60
    page_size: int = 10
    max_page_size: int = 100
    keyword_rows: int = 100
    vector_rows: int = 100
    vector_probes: int = 0  # cells that a question's vector search reads, if the index has cells; 0: all vectors are compared
    trend_min_similarity: float = 0.6
    title_boost: float = 2.0
    k1: float = 1.2
    b: float = 0.75
    sentiment: SentimentBoost = SentimentBoost()
    aspect: AspectBoost = AspectBoost()
    decay: TimeDecay = TimeDecay()
    diversity: Diversity = Diversity()

    @classmethod
    def from_dict(cls, values: dict) -> SearchConfig:
        """From nested plain values, as a YAML or JSON file has them; what is missing keeps its default."""
        parts = {"sentiment": SentimentBoost, "aspect": AspectBoost, "decay": TimeDecay, "diversity": Diversity}
        return cls(**{k: parts[k](**v) if k in parts else v for k, v in values.items()})

    @classmethod
    def from_file(cls, path: str, section: str | None = None) -> SearchConfig:
        """From a JSON file, or a YAML file where a YAML reader is installed; section: only what is under this key."""
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                values = yaml.safe_load(f) or {}
            else:
                values = json.load(f)
        return cls.from_dict(values.get(section, {}) if section else values)
