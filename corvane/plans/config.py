"""Typed settings of the panel, feature, graph, information and training stages, with the usual daily defaults."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

# Feature names in order, and those left out of the node matrix.
FEATURES = (
    "vol_21", "vol_63", "semivol_63", "volofvol_63", "skew_252", "kurt_252", "log_adv_63", "amihud_63",
    "zero_ret_frac_63", "beta_252", "idio_vol_252", "mom_21", "mom_63", "mom_252_21", "dist_52w_high",
)
EXCLUDED = ("amihud_63", "zero_ret_frac_63")
ANNUAL = 252


@dataclass(frozen=True)
class Universe:
    min_history: int = 1260
    max_missing: float = 0.02
    min_coverage: float = 0.80
    max_fill: int = 3
    full_history: bool = True
    start_tolerance: int = 7


@dataclass(frozen=True)
class Features:
    burn_in: int = 252
    winsor: float = 3.0
    exclude: tuple[str, ...] = EXCLUDED


@dataclass(frozen=True)
class Graph:
    window: int = 252
    n_factors: int = 1
    shrinkage: str = "ledoit_wolf"
    similarity: str = "signed"
    k: int = 10
    k_sweep: tuple[int, ...] = (5, 7, 10, 15, 20)
    symmetrise: str = "union"
    weighted: bool = True


@dataclass(frozen=True)
class Information:
    estimator: str = "ksg"
    n_neighbors: int = 4
    bins: int = 6
    scheme: str = "quantile"
    signed: bool = True
    n_perm: int = 100
    n_pairs: int = 200
    subsample: int | None = None


@dataclass(frozen=True)
class Model:
    hidden: int = 64
    embed: int = 16
    layers: int = 2
    dropout: float = 0.2


@dataclass(frozen=True)
class Training:
    vol_lambda: float = 0.0
    lr: float = 0.01
    weight_decay: float = 5e-4
    epochs: int = 200
    patience: int = 20
    seed: int = 42
    window: int = 36
    embargo: int = 1
    refit: int = 12


@dataclass(frozen=True)
class Config:
    universe: Universe = field(default_factory=Universe)
    features: Features = field(default_factory=Features)
    graph: Graph = field(default_factory=Graph)
    information: Information = field(default_factory=Information)
    model: Model = field(default_factory=Model)
    training: Training = field(default_factory=Training)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def digest(self) -> str:
        """Names cached results: a change of any setting names others."""
        return hashlib.sha256(self.to_json().encode()).hexdigest()[:16]

    @classmethod
    def from_dict(cls, values: dict[str, dict]) -> Config:
        base = cls()
        unknown = set(values) - set(asdict(base))
        if unknown:
            raise ValueError(f"unknown sections: {sorted(unknown)}")
        clean = {k: {n: tuple(v) if isinstance(v, list) else v for n, v in part.items()} for k, part in values.items()}
        return replace(base, **{k: replace(getattr(base, k), **part) for k, part in clean.items()})


def read_settings(text: str) -> dict[str, dict]:
    """Settings as from_dict takes them, from JSON, or from YAML if PyYAML is there."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as error:
            raise ValueError("settings are no JSON, and PyYAML is not there to read others") from error
        return yaml.safe_load(text)


#: Settings under which the tables at hand make a panel of nations by weeks.
WEEKLY = Config(
    universe=Universe(min_history=200, max_missing=0.25, start_tolerance=0),
    graph=Graph(k=5, k_sweep=(3, 5, 7)),
    model=Model(hidden=16, embed=4),
    training=Training(window=8, refit=6, epochs=30, patience=10),
)
