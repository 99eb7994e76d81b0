"""The rank profile: what a ranking looks for."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from . import lexicons as L


@dataclass(frozen=True)
class Aspect:
    weight: float
    query_text: str = ""
    keywords: tuple[str, ...] = ()


@dataclass(frozen=True)
class RankProfile:
    """Everything that is specific to one ranking. The defaults are the lists of `lexicons`."""

    role: str = ""
    band_min: float = 5
    band_max: float = 9
    ideal_min: float = 6
    ideal_max: float = 8
    aspects: dict[str, Aspect] = field(default_factory=dict)
    firms: tuple[str, ...] = ()
    home_country: str = "india"
    cities: tuple[str, ...] = tuple(L.TIER1_CITIES)
    reference_date: str = L.REFERENCE_DATE
    strong_titles: tuple[str, ...] = tuple(L.STRONG_TITLES)
    adjacent_titles: tuple[str, ...] = tuple(L.ADJACENT_TITLES)
    nontech_words: tuple[str, ...] = tuple(L.NONTECH_WORDS)
    nontech_prefixes: tuple[str, ...] = tuple(L.NONTECH_PREFIXES)
    areas: dict[str, list[str]] = field(default_factory=lambda: dict(L.AREAS))
    skills: tuple[str, ...] = tuple(L.AI_SKILLS)

    def ordered_aspects(self) -> list[tuple[str, Aspect]]:
        return sorted(self.aspects.items())

    def whole_text(self) -> str:
        """The role and every aspect's text, by aspect name, two spaces between."""
        return "  ".join(t for t in [self.role, *(a.query_text for _, a in self.ordered_aspects())] if t)

    def query_terms(self) -> list[str]:
        """Tokens of each aspect's text and then of its keywords, repeats kept."""
        import re

        return [t for _, a in self.ordered_aspects() for s in [a.query_text, *a.keywords] for t in re.findall("[a-z0-9]+", s.lower())]


def load_profile(path: str) -> RankProfile:
    with open(path, encoding="utf-8") as f:
        x = json.load(f)
    band = x.get("experience_band", {})
    aspects = {k: Aspect(float(v.get("weight", 0)), v.get("query_text", ""), tuple(v.get("keywords", ()))) for k, v in x.get("aspects", {}).items()}
    return RankProfile(x.get("role", ""), band.get("min", 5), band.get("max", 9), band.get("ideal_min", 6), band.get("ideal_max", 8), aspects, tuple(s.lower() for s in x.get("consulting_firms", [])))
