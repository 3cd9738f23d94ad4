"""Parameters: command line over configuration file over defaults, validated once."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Scope:
    """`subreddit`: communities one by one; `global`: the corpus as a whole."""

    mode: str = "subreddit"

    def __post_init__(self) -> None:
        if self.mode not in ("subreddit", "global"):
            raise ValueError(f"unknown mode {self.mode}")

    @property
    def entity(self) -> str:
        return "subreddit" if self.mode == "subreddit" else "corpus"

    @property
    def keys(self) -> list[str]:
        return [self.entity, "token"]

    @property
    def join(self) -> list[str]:
        """Columns on which candidates meet token occurrences."""
        return ["subreddit", "token"] if self.mode == "subreddit" else ["token"]


TIME = {"monthly": ["year", "month"], "yearly": ["year"], "all_time": []}


@dataclass(frozen=True)
class Params:
    min_token_count: int = 100
    min_clean_ratio_score: float = 3.0
    spike_min_clean_ratio_score: float = 0.0
    min_spike_score: float = 1.6
    min_spike_periods: int = 1
    monthly_window: int = 6
    yearly_window: int = 3
    min_baseline_periods: int = 3
    min_period_count: int = 5
    min_baseline_total_tokens: int = 10_000
    smoothing_alpha: float = 1.0
    clean_ratio_c: float = 3.0
    clean_ratio_s: float = 0.4
    spike_monthly_c: float = 2.3
    spike_monthly_s: float = 0.4
    spike_yearly_c: float = 2.3
    spike_yearly_s: float = 0.4
    reliability_log: float = 101.0
    spike_boost_weight: float = 0.6
    power_transform: float = 1.0
    rank_top_k: int = 0
    rank_top_k_floor: float = 0.8
    tail_decay: float = 0.002
    min_len: int = 3
    allow_numbers: bool = False
    strict_gibberish: bool = False

    def __post_init__(self) -> None:
        for name in ("clean_ratio_s", "spike_monthly_s", "spike_yearly_s", "power_transform"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be above 0")
        if self.reliability_log <= 1:
            raise ValueError("reliability_log must be above 1")
        for name in ("spike_boost_weight", "rank_top_k_floor"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")
        if self.rank_top_k < 0 or self.tail_decay < 0:
            raise ValueError("rank_top_k and tail_decay must not be negative")

    def window(self, grain: str) -> int:
        return self.monthly_window if grain == "monthly" else self.yearly_window


#: For samples of a thousand posts.
SMALL = Params(min_token_count=5, min_clean_ratio_score=1.0, min_period_count=2, min_baseline_total_tokens=1000, rank_top_k=100, power_transform=0.4)


def load_params(path: str | None = None, **flags: object) -> Params:
    """Sections of the file are merged; flags that are not None win."""
    known, given = {f.name for f in fields(Params)}, {}
    if path:
        with open(path, encoding="utf-8") as f:
            for section in json.load(f).values():
                if isinstance(section, dict):
                    given |= {k: v for k, v in section.items() if k in known}
    return replace(Params(), **{**given, **{k: v for k, v in flags.items() if v is not None and k in known}})


def fraction_label(fraction: float) -> str:
    """0.1 is 10pct, 0.025 is 2_5pct."""
    return f"{round(fraction * 100, 6):g}".replace(".", "_") + "pct"


__all__ = ["SMALL", "TIME", "Params", "Scope", "asdict", "fraction_label", "load_params"]
