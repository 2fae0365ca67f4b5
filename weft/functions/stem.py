"""The English (Porter 2) stemmer, from its published description."""

from __future__ import annotations

_VOWELS = frozenset("aeiouy")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI_BEFORE = frozenset("cdeghkmnrt")

# Words with a stem of their own, and words left alone, before step 1 and after step 1a.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
# Endings and what replaces them, longest first where one ends another.
_STEP2 = [
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"),
    ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"),
    ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", ""), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic"]


def _after_vowel_consonant(w: str, at: int) -> int:
    """The place after the first consonant that follows a vowel, from ``at`` on."""
    for i in range(at + 1, len(w)):
        if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
            return i + 1
    return len(w)


def _ends_in_short_syllable(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS and w[-1] not in "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters or fewer stay."""
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word[1:] if word[0] == "'" else word
    # A y that begins the word or follows a vowel is a consonant, written Y.
    marked = list(w)
    for i, c in enumerate(marked):
        if c == "y" and (i == 0 or marked[i - 1] in _VOWELS):
            marked[i] = "Y"
    w = "".join(marked)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _after_vowel_consonant(w, 0)
    r2 = _after_vowel_consonant(w, r1)

    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    # 1b
    ending = next((s for s in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(s)), "")
    if ending in ("eed", "eedly"):
        if len(w) - len(ending) >= r1:
            w = w[: len(w) - len(ending)] + "ee"
    elif ending and any(c in _VOWELS for c in w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _ends_in_short_syllable(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # 2
    for s, t in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and (s != "ogi" or w[-4:-3] == "l") and (s != "li" or w[-3:-2] in _LI_BEFORE):
                w = w[: -len(s)] + t
            break
    # 3
    for s, t in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + t
            break
    # 4
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_in_short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
