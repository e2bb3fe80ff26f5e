"""Settings of a linkage run."""

from __future__ import annotations

from dataclasses import dataclass, field

from quillon.functions import rules


@dataclass(frozen=True)
class LinkageConfig:
    """keep: candidates of an entity and source after ranking, shortlist: before; reverse: best entities a
    record keeps besides; tau: least score in pruning; caps: largest block of a key kind, times cap_factor."""

    keep: int = 15
    shortlist: int = 50
    reverse: int = 0
    tau: float = 0.01
    caps: dict[str, int] = field(default_factory=lambda: dict(rules.CAPS))
    entity_cap: int = rules.ENTITY_CAP
    cap_factor: float = 1.0
    with_ca: bool = False
    seed: int = 2026
    t_single: float = 0.5
    t_match: float = 0.3
    miss_mass: float = 0.05

    def cap(self, kind: str) -> int:
        return int(self.caps[kind] * self.cap_factor)
