"""Syllables, stress and IPA of Albanian words: a stateful parse, so an Arrow UDF, applied to distinct words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Graphemes with their sounds, vowels, and the consonants that may begin a syllable together.
DIGRAPHS = {"dh": "ð", "gj": "ɟ", "ll": "ɫ", "nj": "ɲ", "rr": "r", "sh": "ʃ", "th": "θ", "xh": "dʒ", "zh": "ʒ"}
LETTERS = {
    "a": "a", "b": "b", "c": "ts", "ç": "tʃ", "d": "d", "e": "ɛ", "ë": "ə", "f": "f", "g": "ɡ", "h": "h", "i": "i", "j": "j", "k": "k", "l": "l", "m": "m", "n": "n", "o": "ɔ", "p": "p", "q": "c", "r": "ɾ", "s": "s", "t": "t", "u": "u",
    "v": "v", "x": "dz", "y": "y", "z": "z",
}
VOWELS = set("aeëiouy")
ONSETS = re.compile(r"(?:[^ ]+|[pbtdkgfv] [lr]|s [plmnrtkv]|sh [ptkr]|(?:s|sh) [ptk] [lr])?")
_GRAPHEME = re.compile("|".join(DIGRAPHS) + "|.", re.DOTALL)


def syllables(word: str) -> list[list[str]]:
    """Graphemes of each syllable. Between vowels the longest run that may begin a syllable goes to the right; consonants without a vowel give none."""
    out: list[list[str]] = []
    onset: list[str] = []
    for g in _GRAPHEME.findall(word.lower()):
        if g not in VOWELS:
            onset.append(g)
            continue
        if out:
            cut = next(k for k in range(len(onset) + 1) if ONSETS.fullmatch(" ".join(onset[k:])))
            out[-1] += onset[:cut]
            onset = onset[cut:]
        out.append([*onset, g])
        onset = []
    if out:
        out[-1] += onset
    return out


def stressed(parts: list[list[str]], override: int | None = None) -> int:
    """Number of the stressed syllable: an override, the last if it ends in j after its vowel, else the last but one."""
    if not parts:
        return -1
    if override is not None and 0 <= override < len(parts):
        return override
    if len(parts) == 1 or parts[-1][-2:-1] and parts[-1][-2] in VOWELS and parts[-1][-1] == "j":
        return len(parts) - 1
    return len(parts) - 2


def ipa(text: str | None, overrides: dict[str, int] | None = None) -> str | None:
    if text is None:
        return None
    sound = lambda g: DIGRAPHS.get(g) or LETTERS.get(g, g)
    words = []
    for word in text.split():
        lower = word.lower()
        parts = syllables(lower)
        at = stressed(parts, (overrides or {}).get(lower))
        words.append("".join("ˈ" * (k == at) + "".join(map(sound, p)) for k, p in enumerate(parts)) if parts else "".join(map(sound, _GRAPHEME.findall(lower))))
    return " ".join(words)


def pronounce(forms: DataFrame, column: str = "form", overrides: dict[str, int] | None = None) -> DataFrame:
    """forms with ipa, syllables (joined by dots, words by spaces); each distinct form is parsed once. overrides: word to number of the stressed syllable."""
    fixed = dict(overrides or {})

    def run(batches):
        for pdf in batches:
            form = pdf[column]
            cut = form.map(lambda t: None if t is None else " ".join(".".join("".join(p) for p in syllables(w)) or w.lower() for w in t.split()))
            yield pd.DataFrame({column: form, "ipa": form.map(lambda t: ipa(t, fixed)), "syllables": cut})

    distinct = forms.select(F.col(column).cast("string").alias(column)).filter(F.col(column).isNotNull()).distinct()
    return forms.join(distinct.mapInPandas(run, f"{column} string, ipa string, syllables string"), column, "left")
