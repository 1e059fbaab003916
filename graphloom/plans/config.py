"""What a match may vary; no option changes the result."""
from __future__ import annotations

from dataclasses import dataclass

STRATEGIES = ("branch", "tree", "lattice", "fragment", "index", "bruteforce")
ORDERS = ("support", "static", "random")
DEFER = ("never", "always", "auto")


@dataclass(frozen=True)
class MatchConfig:
    strategy: str = "branch"
    order: str = "support"
    defer: str = "never"
    cost_split: bool = False
    candidates: bool = False
    bridge_filter: bool = False
    spoke_filter: bool = False
    seed: int = 0xC0DE
    limit: int | None = None

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES or self.order not in ORDERS or self.defer not in DEFER:
            raise ValueError(f"one of strategy {STRATEGIES}, order {ORDERS}, defer {DEFER} is unknown")
        if self.limit is not None and self.limit < 0:
            raise ValueError("the limit is negative")
        if self.cost_split and (self.strategy != "branch" or self.defer == "never"):
            raise ValueError("cost splitting needs deferred vertices, which only the branch strategy has")
        if self.defer != "never" and self.strategy != "branch":
            raise ValueError("only the branch strategy defers vertices")
        if (self.bridge_filter or self.spoke_filter) and not self.candidates:
            raise ValueError("bridge and spoke filters refine candidates, which are off")


#: The named variants of the anchored search and the other engines.
VARIANTS = {
    "afec": MatchConfig(defer="auto", cost_split=True),
    "afe": MatchConfig(),
    "afe_no_af": MatchConfig(strategy="bruteforce"),
    "afec_white": MatchConfig(defer="always", cost_split=True),
    "afec_black": MatchConfig(defer="never"),
    "afec_fixed": MatchConfig(order="static", defer="auto", cost_split=True),
    "afec_random": MatchConfig(order="random", defer="auto", cost_split=True),
    "treespan": MatchConfig(strategy="tree"),
    "decq": MatchConfig(strategy="fragment"),
    "sasum": MatchConfig(strategy="lattice"),
    "s3and_ssm": MatchConfig(strategy="index"),
}
