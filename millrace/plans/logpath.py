"""Log paths: named sources, steps and destinations put together, the configuration of this library.

A path is a list of DataFrame functions; building one plans nothing yet. The same path runs over batch and streaming tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from millrace.operators.branch import delivered, union

Step = Callable[[DataFrame], DataFrame]


@dataclass
class LogPath:
    sources: list[str]
    steps: list[Step | str] = field(default_factory=list)
    destinations: list[str] = field(default_factory=list)
    filter: Column | None = None
    flags: tuple[str, ...] = ()


@dataclass
class Config:
    """Sources (name to table), reusable steps (name to function), destinations (name to writer) and paths."""

    sources: dict[str, DataFrame] = field(default_factory=dict)
    steps: dict[str, Step] = field(default_factory=dict)
    destinations: dict[str, Callable[[DataFrame], object]] = field(default_factory=dict)
    paths: list[LogPath] = field(default_factory=list)

    def step(self, name: str) -> Step:
        if name not in self.steps:
            raise KeyError(f"no step {name}; there are {sorted(self.steps)}")
        return self.steps[name]

    def table(self, path: LogPath) -> DataFrame:
        d = union(*[self.sources[s] for s in (self.sources if "catchall" in path.flags else path.sources)])
        if path.filter is not None:
            d = d.where(path.filter)
        for s in path.steps:
            d = d.transform(self.step(s) if isinstance(s, str) else s)
        return d

    def routed(self) -> DataFrame:
        """Every path's deliveries, with ``final`` and ``fallback`` between the paths of one set of sources."""
        from pyspark.sql import functions as F

        d = union(*self.sources.values())
        named = [(",".join(p.destinations), p.filter if p.filter is not None else F.lit(True), p.flags) for p in self.paths]
        return delivered(d, named)

    def run(self) -> None:
        for p in self.paths:
            d = self.table(p)
            for name in p.destinations:
                self.destinations[name](d)


_PLUGINS: dict[tuple[str, str], Callable] = {}


def plugin(kind: str, name: str):
    """Registers a user's parser, function, source or destination by kind and name."""

    def take(f: Callable) -> Callable:
        _PLUGINS[kind, name] = f
        return f

    return take


def load(kind: str, name: str) -> Callable:
    return _PLUGINS[kind, name]
