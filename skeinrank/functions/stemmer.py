"""The English Snowball stemmer ("Porter2"), written from its published description."""

from __future__ import annotations

import re

# Fixed values of the published algorithm: suffix lists, exceptions, and the English stop list of common search engines.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
UNCHANGED_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
ENGLISH_STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don should now".split()
)


def _regions(word: str) -> tuple[int, int]:
    """Starts of R1 and R2: after the first vowel-consonant pair, and after the next."""
    found = []
    at = 0
    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            found.append(len(prefix))
            at = len(prefix)
            break
    while len(found) < 2:
        m = re.compile(r"[aeiouy][^aeiouy]").search(word, at)
        at = m.end() if m else len(word)
        found.append(at)
    return found[0], found[1]


def _short_syllable(word: str) -> bool:
    return re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", word) is not None


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word.lstrip("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"(?:'s'|'s|')$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].+$", w[:-1]):
        w = w[:-1]
    if w in UNCHANGED_AFTER_1A:
        return w
    # past and progressive forms
    if w.endswith(("eed", "eedly")):
        stem = w[: -3 if w.endswith("eed") else -5]
        if len(stem) >= r1:
            w = stem + "ee"
    else:
        m = re.search(r"(?:ingly|edly|ing|ed)$", w)
        if m and re.search(r"[aeiouy]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _short_syllable(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # derivational suffixes
    for suffix in sorted(STEP2, key=len, reverse=True):
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + STEP2[suffix]
            break
    else:
        if w.endswith("ogi"):
            w = w[:-1] if len(w) - 3 >= r1 and w[-4:-3] == "l" else w
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] and w[-3] in LI_ENDINGS:
            w = w[:-2]
    for suffix in sorted([*STEP3, "ative"], key=len, reverse=True):
        if w.endswith(suffix):
            start = len(w) - len(suffix)
            if suffix == "ative":
                w = w[:start] if start >= r2 else w
            elif start >= r1:
                w = w[:start] + STEP3[suffix]
            break
    for suffix in (*STEP4[:0], *sorted((*STEP4, "ion"), key=len, reverse=True)):
        if w.endswith(suffix):
            start = len(w) - len(suffix)
            if start >= r2 and (suffix != "ion" or w[start - 1] in "st"):
                w = w[:start]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
