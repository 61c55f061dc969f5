"""From words to a formula: a translator proposes, the formula checker decides."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from factorloom.plans import formula


@dataclass(frozen=True)
class Proposal:
    feasible: bool
    formula: str = ""
    reason: str = ""
    nearest: str = ""


class Translator(Protocol):
    def propose(self, idea: str, card: str, errors: list[str]) -> Proposal: ...


class Scripted:
    """A translator that gives prepared answers, in turn."""

    def __init__(self, *answers: Proposal):
        self.answers = list(answers)

    def propose(self, idea: str, card: str, errors: list[str]) -> Proposal:
        return self.answers.pop(0)


def translate(idea: str, translator: Translator | None, attempts: int = 3) -> Proposal:
    """A valid formula for the idea, or why there is none. Errors go back to the translator; an illegal "nearest" is dropped."""
    if translator is None:
        return Proposal(False, reason="no translator is configured")
    errors: list[str] = []
    for _ in range(attempts):
        p = translator.propose(idea, formula.capability_card(), errors)
        if not p.feasible:
            return Proposal(False, reason=p.reason, nearest=p.nearest if formula.is_valid(p.nearest)[0] else "")
        ok, why = formula.is_valid(p.formula)
        if ok:
            return p
        errors.append(why)
    return Proposal(False, reason="; ".join(errors))
