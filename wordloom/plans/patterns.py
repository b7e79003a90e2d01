"""Two pattern sets made by rule, for queries that need patterns but no file."""

from __future__ import annotations

CONSONANTS = "bcdfghjklmnpqrstvwxz"
VOWELS = "aeiou"
#: Letter pairs that one set keeps together.
TOGETHER = ["ch", "sh", "th", "ph", "qu", "ck", "sc"]


def open_syllables() -> list[str]:
    """Break before every consonant that a vowel follows."""
    return [f"1{c}{v}" for c in CONSONANTS for v in VOWELS]


def cluster_aware() -> list[str]:
    """The same, but never inside the pairs kept together, nor before a lone first consonant group."""
    return [*open_syllables(), *(f"{a}2{b}" for a, b in TOGETHER), *(f"1{p}{v}" for p in TOGETHER for v in VOWELS if p[1] not in VOWELS)]
