"""Switches between the published method's exact behaviour and its corrected form."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """All False = the published behaviour; see README for each switch."""

    all_uses_own_shares: bool = False  # `_all` goes to every cause by fresh shares
    both_unknown_uses_population: bool = False  # age+sex fallback by population share
    lenient_population: bool = False  # population totals skip missing bands
    causes_from_unknown: bool = False  # grid also holds causes seen only in unknown rows
    wide_eligibility: bool = False  # maternal garbage at 55, neonatal garbage at "0"+
    zero_code_unknown: bool = False  # "000000" also means municipality unknown
    absent_causes_zero: bool = False  # causes never seen start at 0 instead of NULL

    @classmethod
    def corrected(cls) -> "Options":
        return cls(*([True] * 7))


COMPAT = Options()
