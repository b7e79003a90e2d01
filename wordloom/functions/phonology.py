"""Slovak sounds as column expressions; the inventory is a table of fixed linguistic facts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the Slovak sound inventory, which results depend on.
SHORT = list("aeiouyä")
LONG = list("áéíóúý")
DIPHTHONGS = ["ia", "ie", "iu", "ô"]
LONG_CONSONANTS = ["ŕ", "ĺ"]
FOREIGN_VOWELS = list("àâæèêëěîïöœùûüůÿ")
FOREIGN_CONSONANTS = {"ß": "s", "ç": "s", "ř": "r"}
LENGTHENED = {"a": "á", "e": "é", "i": "í", "o": "ó", "u": "ú", "y": "ý"}
HARD = ["h", "ch", "k", "g", "d", "t", "n", "l"]
SOFT = ["c", "č", "dz", "dž", "f", "j", "š", "ž", "ť", "ď", "ň", "ľ"]
AMBIGUOUS = ["v", "m", "r", "b", "p", "s", "ŕ", "z"]
VOICED = {"b": "p", "d": "t", "ď": "ť", "g": "k", "dz": "c", "dž": "č", "z": "s", "ž": "š"}
UNPAIRED = ["r", "l", "m", "n", "ň", "j"]
PLACES = {
    "bilabial": ["p", "b", "m"], "labiodental": ["f", "v"], "prealveolar": ["t", "d", "n", "s", "z", "c", "dz"],
    "postalveolar": ["š", "ž", "č", "dž", "r", "ŕ", "l", "ĺ"], "alveopalatal": ["ť", "ď", "ň", "ľ"], "palatal": ["j"],
    "velar": ["k", "g", "ch"], "laryngeal": ["h"],
}
MANNERS = {
    "plosive": ["p", "b", "m", "t", "d", "n", "ť", "ď", "ň", "k", "g"], "affricate": ["c", "č", "dz", "dž"],
    "fricative": ["s", "z", "š", "ž", "h", "ch", "f", "v", "ŕ", "l", "ĺ", "ľ"], "sonorant": ["m", "n", "ň", "j", "r", "l", "ĺ", "ľ"],
    "liquid": ["r", "l", "ŕ", "ĺ"], "vibrant": ["r", "ŕ"],
}
RESONANCE = {"back": ["o", "ó", "u", "ú"], "central": ["a", "á"], "front": ["e", "é", "i", "í", "y", "ý"]}
HEIGHT = {"high": ["i", "í", "y", "ý", "u", "ú"], "mid": ["e", "é", "o", "ó"], "low": ["a", "á", "ä"]}
ROUNDING = {"rounded": ["u", "ú", "o", "ó", "y", "ý"], "unrounded": ["i", "í", "e", "é", "a", "á"]}
OPENNESS = {"open": ["a", "á"], "half_open": ["e", "é", "o", "ó"], "closed": ["i", "í", "y", "ý", "u", "ú"]}
SONORITY = [
    ["p", "b", "t", "d", "ť", "ď", "k", "g", "c", "č", "dz", "dž", "f", "s", "z", "š", "ž", "ch", "h"],
    ["m", "n", "ň"], ["l", "ľ", "r"], ["v", "j"],
]
PALATAL = {"k": "č", "č": "k", "g": "ž", "ž": "g", "ch": "š", "š": "ch", "h": "ž", "c": "č", "d": "ď", "ď": "d", "t": "ť", "ť": "t", "n": "ň", "ň": "n", "l": "ľ", "ľ": "l", "r": "r"}
LINGUAL_DORSAL = {"k": "c", "c": "k", "g": "dz", "dz": "g", "ch": "s", "s": "ch", "h": "z", "z": "h", "sk": "šť", "šť": "sk", "st": "šť"}
NATIVE_LETTERS = list("aáäbcčdďeéfghiíjklĺľmnňoóôprŕsštťuúvxyýzž")
VOCALISED = {"v": ["v", "f"], "s": ["s", "z", "š", "ž"], "z": ["z", "s", "š", "ž"], "k": ["k", "g"]}
# End of fixed values.

VOWELS = SHORT + LONG
CONSONANTS = list(dict.fromkeys(chain.from_iterable(PLACES.values())))
PHONEME = "dž|ch|dz|ia|ie|iu|(?s)."
VOWEL_LIKE = VOWELS + DIPHTHONGS + FOREIGN_VOWELS


def _one(x: Column, *members: str) -> Column:
    return F.lower(x).isin(*members)


def _mapped(x: Column, table: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))[F.lower(x)]


def phonemes(word: Column) -> Column:
    """Digraphs, two-letter diphthongs, else single characters, in lower case (PHO-1)."""
    return F.regexp_extract_all(F.lower(word), F.lit(PHONEME), F.lit(0))


def is_vowel(x: Column) -> Column:
    return _one(x, *VOWELS, *FOREIGN_VOWELS)


def is_short_vowel(x: Column) -> Column:
    return _one(x, *SHORT)


def is_long_vowel(x: Column) -> Column:
    return _one(x, *LONG)


def is_consonant(x: Column) -> Column:
    return _one(x, *CONSONANTS, *FOREIGN_CONSONANTS)


def is_diphthong(x: Column) -> Column:
    return _one(x, *DIPHTHONGS)


def is_hard(x: Column) -> Column:
    return _one(x, *HARD)


def is_soft(x: Column) -> Column:
    return _one(x, *SOFT)


def is_voiced(x: Column) -> Column:
    return _one(x, *VOICED)


def is_voiceless(x: Column) -> Column:
    return _one(x, *VOICED.values())


def is_long_syllable(syllable: Column) -> Column:
    """A diphthong, a long vowel or a long consonant in it (PHO-5)."""
    return F.lower(syllable).rlike("|".join(DIPHTHONGS + LONG + LONG_CONSONANTS))


def voice_pair(x: Column) -> Column:
    return _mapped(x, VOICED | {b: a for a, b in VOICED.items()})


def lengthen(text: Column) -> Column:
    return F.translate(text, "".join(LENGTHENED), "".join(LENGTHENED.values()))


def shorten(text: Column) -> Column:
    """Long vowels made short; used on suffixes by the rhythmic law (PHO-8, PHT-3)."""
    return F.translate(text, "".join(LENGTHENED.values()), "".join(LENGTHENED))


def palatalised(x: Column) -> Column:
    return _mapped(x, PALATAL)


def lingual_dorsal(x: Column) -> Column:
    return _mapped(x, LINGUAL_DORSAL)


def native_spelling(cluster: Column) -> Column:
    return F.translate(cluster, "".join(FOREIGN_CONSONANTS), "".join(FOREIGN_CONSONANTS.values()))


def merge_qu(word: Column) -> Column:
    """qu counts as one consonant (SYL-7)."""
    return F.regexp_replace(word, "(?i)qu", "q")


def is_native(word: Column) -> Column:
    return F.lower(word).rlike(f"^[{''.join(NATIVE_LETTERS)}]+$")


def is_analysable(word: Column) -> Column:
    return F.lower(word).rlike(f"^[{''.join(NATIVE_LETTERS + FOREIGN_VOWELS + list(FOREIGN_CONSONANTS))}qw]+$")


def is_hyphenatable(word: Column) -> Column:
    return F.lower(word).rlike(f"^[{''.join(NATIVE_LETTERS + FOREIGN_VOWELS + list(FOREIGN_CONSONANTS))}]+$")


def nuclei(sounds: Column) -> Column:
    """Places of the nuclei in a phoneme array (SYL-3)."""
    like = lambda i: F.coalesce(F.get(sounds, i).isin(*VOWEL_LIKE), F.lit(False))
    short = lambda x, i: x.isin("r", "l") & ((i == 0) | ~like(i - 1)) & (i < F.size(sounds) - 1) & ~like(i + 1)
    found = F.transform(sounds, lambda x, i: F.when(x.isin(*VOWEL_LIKE, "ŕ", "ĺ") | short(x, i), i).otherwise(F.lit(-1)))
    return F.filter(found, lambda i: i >= 0)


def ends_with_two_consonants(sounds: Column) -> Column:
    """Two consonants close the stem; syllabic ones count as nuclei (PHT-4)."""
    last, before, third = (F.get(sounds, F.size(sounds) - k) for k in (1, 2, 3))
    syllabic = before.isin("r", "l") & F.coalesce(is_consonant(third), F.lit(False))
    plain = is_consonant(last) & is_consonant(before) & ~last.isin("ŕ", "ĺ") & ~before.isin("ŕ", "ĺ")
    return (F.size(sounds) >= 2) & F.coalesce(plain & ~syllabic, F.lit(False))


def preposition_fits(preposition: Column, following: Column) -> Column:
    """False where the vocalised form is needed before the next word (PHT-5)."""
    first = F.get(phonemes(following), F.lit(0))
    bad = F.lit(False)
    for form, before in VOCALISED.items():
        bad = bad | ((F.lower(preposition) == form) & first.isin(*before))
    return F.coalesce(~bad, F.lit(True))


def is_plausible(word: Column) -> Column:
    """Slovak letter, nucleus, at most four consonants in a row (PHT-1)."""
    sounds = phonemes(word)
    consonant = f"(?:dž|ch|dz|[{''.join(c for c in CONSONANTS if len(c) == 1 and c not in 'rlŕĺ')}{''.join(FOREIGN_CONSONANTS)}])"
    nucleus = F.exists(sounds, lambda x: x.isin(*VOWELS, *DIPHTHONGS, "r", "l", "ŕ", "ĺ"))
    return F.lower(word).rlike(f"[{''.join(NATIVE_LETTERS)}q]") & nucleus & ~F.lower(word).rlike(f"{consonant}{{5}}")


def feature_rows() -> list[tuple[str, str, str]]:
    """phoneme, feature, value for the dimension table of sound classes (PHO-11)."""
    groups = {"place": PLACES, "manner": MANNERS, "resonance": RESONANCE, "height": HEIGHT, "rounding": ROUNDING, "openness": OPENNESS, "hardness": {"hard": HARD, "soft": SOFT, "ambiguous": AMBIGUOUS}, "sonority": {str(i): x for i, x in enumerate(SONORITY)}}
    return [(x, feature, value) for feature, values in groups.items() for value, members in values.items() for x in members]
