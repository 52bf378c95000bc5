"""The query grammar of web searches: words are all required, "..." is a phrase, or, and -not."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tidewire.search.analysis import tokens


@dataclass(frozen=True)
class Phrase:
    """Terms at given distances from the first; a single word is a phrase of one."""

    terms: tuple[str, ...]
    offsets: tuple[int, ...]
    negated: bool = False


@dataclass(frozen=True)
class Query:
    """Alternatives, each a list of phrases that must (or must not) occur."""

    alternatives: tuple[tuple[Phrase, ...], ...]

    @property
    def terms(self) -> list[str]:
        return sorted({t for alt in self.alternatives for p in alt for t in p.terms})

    @property
    def positive(self) -> set[str]:
        return {t for alt in self.alternatives for p in alt if not p.negated for t in p.terms}

    @property
    def needs_all(self) -> bool:
        """Whether a story without any of the terms can match."""
        return any(all(p.negated for p in alt) for alt in self.alternatives)

    def matches(self, positions: dict[str, list[int]]) -> bool:
        """Whether a story with these positions of terms matches."""
        return any(all(bool(self.places(p, positions)) != p.negated for p in alt) for alt in self.alternatives)

    @staticmethod
    def places(p: Phrase, positions: dict[str, list[int]]) -> list[int]:
        starts = set(positions.get(p.terms[0], ()))
        for term, off in zip(p.terms[1:], p.offsets[1:], strict=True):
            starts &= {x - off for x in positions.get(term, ())}
        return sorted(starts)


def parse(text: str) -> Query:
    """Words that are only stop words, and alternatives without any term, are left out."""
    alternatives: list[list[Phrase]] = [[]]
    for minus, quoted, word in (m.groups() for m in re.finditer(r'(-?)"([^"]*)"?|(\S+)', text)):
        if word and word.lower() == "or":
            alternatives.append([])
            continue
        negated = minus == "-" or bool(word) and word.startswith("-")
        found = [(t, p) for t, p, *_ in tokens(quoted if quoted is not None else word) if t]
        if found:
            alternatives[-1].append(Phrase(tuple(t for t, _ in found), tuple(p - found[0][1] for _, p in found), negated))
    return Query(tuple(tuple(a) for a in alternatives if a))
