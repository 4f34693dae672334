"""Configuration of an experiment: a JSON file, overrides of single keys, and its replicates."""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass, field, fields, replace

from lastleg.sources.files import load_config, pair_seeds

MODELS = ("M1", "M2", "M3", "M4", "M5")


@dataclass(frozen=True)
class Experiment:
    """What a run needs; seeds may be lists, which are paired by position."""

    city: str
    zones: list[str]
    customers: int = 1000
    scenario: str = "low"
    demand_seed: int | list[int] = 101
    search_seed: int | list[int] = 42
    models: list[str] = field(default_factory=lambda: list(MODELS))
    capacity: float = 60.0
    shift_min: float = 480.0
    start: str = "09:00"
    iterations: int = 100
    stagnation: int = 20
    go_on_after_a_failed_zone: bool = True

    def __post_init__(self):
        wrong = [m for m in self.models if m not in MODELS]
        if wrong or not self.zones or self.customers <= 0 or self.capacity <= 0 or self.shift_min <= 0:
            raise ValueError(f"not an experiment: {f'unknown models {wrong}' if wrong else 'zones, customers, capacity and shift must be given'}")
        if self.scenario not in ("low", "medium", "high"):
            raise ValueError(f"unknown scenario {self.scenario}")


def replicates(experiment: Experiment) -> list[Experiment]:
    """One experiment for each pair of seeds."""
    return [replace(experiment, demand_seed=a, search_seed=b) for a, b in pair_seeds(experiment.demand_seed, experiment.search_seed)]


def folder_name(experiment: Experiment) -> str:
    """The folder of one replicate's results."""
    return f"{experiment.city}_{experiment.scenario}_{experiment.customers}_{experiment.demand_seed}_{experiment.search_seed}".lower()


def resolved(arguments: list[str]) -> list[Experiment]:
    """Replicates from a command line: --config FILE, then --set KEY=JSON for keys that differ."""
    parser = argparse.ArgumentParser(description="Delivery models over zones")
    parser.add_argument("--config", required=True)
    parser.add_argument("--set", action="append", default=[], metavar="KEY=JSON")
    given = parser.parse_args(arguments)
    base = load_config(given.config, Experiment)
    known = {f.name for f in fields(Experiment)}
    changes = {}
    for text in given.set:
        key, _, value = text.partition("=")
        if key not in known:
            raise ValueError(f"unknown key: {key}")
        changes[key] = json.loads(value)
    return replicates(replace(base, **changes))
