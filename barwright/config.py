"""Settings, as plain frozen dataclasses that turn into dicts and back."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Data:
    timeframe: str = "H1"
    symbol: str = "EURUSD"
    years: int = 5


@dataclass(frozen=True)
class Edges:
    p_value: float = 0.05
    min_sample: int = 100
    min_win_rate: float = 0.45
    lookahead: int = 10


@dataclass(frozen=True)
class Validation:
    train_bars: int = 252
    test_bars: int = 63
    step_bars: int = 21
    bootstrap: int = 10_000


@dataclass(frozen=True)
class Costs:
    spread: float = 1.5
    commission: float = 7.0
    slippage: float = 0.5
    point_value: float = 10.0


@dataclass(frozen=True)
class Config:
    data: Data = field(default_factory=Data)
    edges: Edges = field(default_factory=Edges)
    validation: Validation = field(default_factory=Validation)
    costs: Costs = field(default_factory=Costs)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        return _build(cls, values)


def _build(kind: type, values: dict):
    known = {f.name: f for f in fields(kind)}
    unknown = set(values) - set(known)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    made = kind()
    return kind(**{k: _build(type(getattr(made, k)), v) if is_dataclass(getattr(made, k)) else v for k, v in values.items()})
