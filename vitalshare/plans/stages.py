"""The eleven stages that move ill-defined causes onto target causes, as data.

Stages are numbered in the order their results build on each other. ``round`` says when
a stage can be computed: a stage reads only the causes of its own pool, so stages whose
pools no earlier stage of the same round writes to share one pass over the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from vitalshare.domain import (
    CHRONIC,
    FEMALE,
    INJURIES,
    MATERNAL,
    NEONATAL,
    NEONATAL_AGES,
    PNEUMONIA,
    POOLED,
    TARGETS,
    UNDER_FIVE,
)
from vitalshare.options import COMPAT, Options

SUICIDE = "Injuries - Suicide"
_HOMICIDE = "Injuries - Homicide"
_STAGE6_AGES = tuple(str(a) for a in range(10, 55, 5))


@dataclass(frozen=True)
class StageSpec:
    number: int
    name: str
    label: str  # garbage label whose deaths move
    round: int
    pool: tuple[str, ...]  # causes that share in proportion to their deaths
    direct: tuple[str, ...] = ()  # causes that get a fixed weight
    ages: tuple[str, ...] | None = None  # eligible ages, None = all
    sex: str | None = None
    not_under_five: tuple[str, ...] = ()  # causes not eligible below age 5
    weighted: bool = False
    weights_by_age: bool = False
    shares_of: int | None = None  # take another stage's shares
    replaces: str | None = None  # cause that keeps only what this stage gives it

    @property
    def targets(self) -> tuple[str, ...]:
        return self.direct + self.pool

    def eligible(self, cause: str) -> str | None:
        """SQL condition on sexo and idade, None where every row is eligible."""
        tests = []
        if self.ages is not None:
            tests.append(f"idade IN ({_quoted(self.ages)})")
        if self.sex is not None:
            tests.append(f"sexo = '{self.sex}'")
        if cause in self.not_under_five:
            tests.append(f"idade NOT IN ({_quoted(UNDER_FIVE)})")
        return " AND ".join(tests) or None


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def stages(options: Options = COMPAT) -> tuple[StageSpec, ...]:
    wide = options.wide_eligibility
    last = (
        StageSpec(11, "all", "_all", 6, tuple(t for t in TARGETS if t != PNEUMONIA))
        if options.all_uses_own_shares
        else StageSpec(11, "all", "_all", 4, POOLED, shares_of=10)
    )
    injury_pools = (
        ("inj_hom_sui", "_inj (hom,sui)", (_HOMICIDE, SUICIDE)),
        (
            "inj_hom_sui_fall_road",
            "_inj (hom,suic, fall,road)",
            ("Injuries - Falls", _HOMICIDE, SUICIDE, "Injuries - Road"),
        ),
        (
            "inj_hom_sui_transp",
            "_inj (hom,sui,transp)",
            ("Injuries - Road", SUICIDE, _HOMICIDE, "Injuries - Other transport injuries"),
        ),
        ("inj_hom_sui_other", "_inj (hom,suic,other)", ("Injuries - Others", SUICIDE, _HOMICIDE)),
    )
    return (
        StageSpec(1, "injuries", "_injuries", 1, INJURIES),
        *(
            StageSpec(n, name, label, n, pool, not_under_five=(SUICIDE,))
            for n, (name, label, pool) in enumerate(injury_pools, start=2)
        ),
        StageSpec(
            6,
            "maternal",
            "_maternas",
            1,
            MATERNAL,
            ages=_STAGE6_AGES + (("55",) if wide else ()),
            sex=FEMALE,
        ),
        StageSpec(
            7,
            "neonatal",
            "_infant_neonat",
            1,
            NEONATAL,
            ages=None if wide else NEONATAL_AGES,
        ),
        StageSpec(8, "x59", "_x59", 2, POOLED, INJURIES, weighted=True),
        StageSpec(9, "y34", "_y34", 3, POOLED, CHRONIC + INJURIES, weighted=True),
        StageSpec(
            10,
            "pneumonia",
            "_pneumo",
            4,
            POOLED,
            (PNEUMONIA, *CHRONIC, *INJURIES),
            weighted=True,
            weights_by_age=True,
            replaces=PNEUMONIA,
        ),
        last,
    )
