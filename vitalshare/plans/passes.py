"""The seven patterns of unknown keys, as data.

``missing`` names what a record lacks; the amount is spread over exactly those
dimensions, in proportion to deaths at the finest level that has any, and by
population when none has.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PassSpec:
    number: int
    missing: frozenset[str]

    @property
    def local(self) -> bool:
        """The municipality is known, so the amount stays inside it."""
        return "mun" not in self.missing


PASSES = tuple(
    PassSpec(i, frozenset(missing.split()))
    for i, missing in enumerate(
        ("age", "sex", "age sex", "mun", "mun age", "mun sex", "mun age sex"), start=1
    )
)
