"""Extension surface: strategies, management modules and their registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quantloom.causality import look_ahead
from quantloom.operators import signals as S
from quantloom.operators.search import Param, ParamSpace, standard_space

STAGES = ("draft", "research", "validated", "live", "retired")


@dataclass(frozen=True)
class Module:
    """A management module: its parameters, their group, and whether it needs the full simulation."""

    name: str
    group: str
    full: bool = True

    def params(self) -> list[Param]:
        return [p for p in standard_space().params if p.group == self.group]


#: The five modules; fixed values.
MODULES = (Module("trailing_stop", "exit_trailing"), Module("breakeven", "exit_protection_be"), Module("partial_close", "exit_protection"), Module("max_bars", "exit_time"), Module("stale_exit", "exit_time"))


@dataclass
class Strategy:
    """A signal plan: a function from bars and pip to signals, which Catalyst sees whole.

    ``causal`` declares that a signal at t uses nothing after t but the entry price.  The plan itself is
    read for that (``causality.look_ahead``); other strategies are refused.
    """

    name: str
    signals: Callable[..., DataFrame]
    space: ParamSpace = field(default_factory=ParamSpace)
    version: str = "1"
    causal: bool = True
    modules: tuple[Module, ...] = MODULES

    def generate(self, bars: DataFrame, pip: float, **options) -> DataFrame:
        if not self.causal:
            raise ValueError(f"{self.name} looks ahead")
        made = self.signals(bars, pip, **options)
        if found := look_ahead(made):
            raise ValueError(f"{self.name} looks ahead: {found[0]}")
        return made


_known: dict[str, Strategy] = {}
_aliases: dict[str, str] = {}
_stage: dict[str, str] = {}


def register(strategy: Strategy, *aliases: str, stage: str = "research") -> Strategy:
    if strategy.name in _known and _known[strategy.name] is not strategy:
        raise ValueError(f"{strategy.name} is registered already")
    _known[strategy.name] = strategy
    _aliases.update({a: strategy.name for a in aliases})
    set_stage(strategy.name, stage)
    return strategy


def get(name: str) -> Strategy:
    name = _aliases.get(name, name)
    if name not in _known:
        raise KeyError(f"unknown strategy {name!r}; known: {sorted(_known)}")
    return _known[name]


def names(stage: str | None = None) -> list[str]:
    return sorted(n for n in _known if stage in (None, _stage[n]))


def set_stage(name: str, stage: str) -> None:
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}")
    _stage[_aliases.get(name, name)] = stage


def stage_of(name: str) -> str:
    return _stage[_aliases.get(name, name)]


for _name, _alias in (("ema_crossover", "ema"), ("rsi_mean_reversion", "rsi"), ("macd_crossover", "macd"), ("bollinger_reversion", "bollinger"), ("stochastic_crossover", "stochastic"), ("adx_trend", "adx"), ("donchian_breakout", "donchian"), ("hidden_smash_day", "smash"), ("always_buy", "buy"), ("sma_crossover", "sma")):
    register(Strategy(_name, getattr(S, _name)), _alias)
register(Strategy("verification_test", S.verification_modes), "verification")
