"""The Porter2 (Snowball English) stemmer, from its published description."""

from __future__ import annotations

import re

# The vowels, doubles, endings and exceptions that the algorithm's description lists.
_VOWEL = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble",
    "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_REGION = re.compile(rf"[{_VOWEL}][^{_VOWEL}]")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    head = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), "")
    m = _REGION.search(word)
    r1 = len(head) or (m.end() if m else len(word))
    m = _REGION.search(word, r1)
    return r1, m.end() if m else len(word)


def _ends_short(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search(rf"[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]\Z|\A[{_VOWEL}][^{_VOWEL}]\Z", word))


def stem(word: str) -> str:
    """The stem of a lower-cased word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = word.removeprefix("'")
    w = re.sub(rf"\Ay|(?<=[{_VOWEL}])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s'\Z|'s\Z|'\Z", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(rf"[{_VOWEL}]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    if w.endswith(("eed", "eedly")):
        end = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), "")
        if end and re.search(rf"[{_VOWEL}]", w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _ends_short(w):
                w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    # 2
    end = next((e for e in _STEP2 if w.endswith(e)), "")
    if end:
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + _STEP2[end]
    elif w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
        w = w[:-1]
    elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple(_LI):
        w = w[:-2]
    # 3
    end = next((e for e in _STEP3 if w.endswith(e)), "")
    if end:
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + _STEP3[end]
    elif w.endswith("ative") and len(w) - 5 >= r2:
        w = w[:-5]
    # 4
    end = next((e for e in _STEP4 if w.endswith(e)), "")
    if end:
        if len(w) - len(end) >= r2:
            w = w[: -len(end)]
    elif w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
        w = w[:-3]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _ends_short(w[:-1])):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()
