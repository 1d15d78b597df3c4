"""Sizes and levels of a table. All sizes are bytes, but ``bloom_bits``."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import NoSuchLevelError, OptionsError


@dataclass(frozen=True)
class Sink:
    """The last level: it takes whatever the others can't hold, and no tombstones."""

    block_size: int = 64 << 10
    run_size: int = 128 << 20
    cache_size: int = 1 << 20
    cache_shards: int = 1
    bloom_bits: int = 1 << 20

    def problems(self, name: str, key_max: int, value_max: int) -> list[str]:
        rules = [
            (self.block_size >= key_max, "block_size must hold the largest key"),
            (self.block_size >= value_max, "block_size must hold the largest value"),
            (self.cache_size >= self.block_size, "cache_size must hold a block"),
            (self.cache_shards >= 1, "cache_shards must be at least 1"),
            (self.run_size >= 1, "run_size must be at least 1"),
            (self.bloom_bits >= 1, "bloom_bits must be at least 1"),
        ]
        return [f"{name}: {text}" for good, text in rules if not good]


@dataclass(frozen=True)
class Level(Sink):
    """A bounded level: ``run_size * max_runs`` bytes of records; more moves down."""

    max_runs: int = 4

    @property
    def budget(self) -> int:
        return self.run_size * self.max_runs

    def problems(self, name: str, key_max: int, value_max: int) -> list[str]:
        return super().problems(name, key_max, value_max) + ([] if self.max_runs >= 1 else [f"{name}: max_runs must be at least 1"])


@dataclass(frozen=True)
class Options:
    path: str
    levels: tuple[Level, ...] = ()
    sink: Sink | None = field(default_factory=Sink)
    memtable_size: int = 4 << 20
    key_max: int = 1 << 10
    value_max: int = 64 << 10

    def level(self, i: int) -> Sink:
        """Level ``i``; the sink comes right after the last bounded level."""
        if 0 <= i < len(self.levels):
            return self.levels[i]
        if i == len(self.levels) and self.sink is not None:
            return self.sink
        raise NoSuchLevelError(f"no level {i}")

    def validate(self) -> list[str]:
        """Every rule that is broken, in words; an empty list when all hold."""
        found = []
        if not self.path:
            found.append("path must not be empty")
        for name in ("memtable_size", "key_max", "value_max"):
            if getattr(self, name) < 1:
                found.append(f"{name} must be at least 1")
        for i, level in enumerate(self.levels):
            found += level.problems(f"level {i}", self.key_max, self.value_max)
        return found + (["sink must be given"] if self.sink is None else self.sink.problems("sink", self.key_max, self.value_max))

    def check(self) -> Options:
        if found := self.validate():
            raise OptionsError(found)
        return self
