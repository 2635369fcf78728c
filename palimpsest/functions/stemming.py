"""English stems by the published Porter2 rules, and the stop list that goes with them."""

from __future__ import annotations

import re

# Words that full-text search leaves out.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)

# Irregular forms and endings of the published algorithm.
_IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_STAY = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": ""}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_VOWEL = "aeiouy"
_REGION = re.compile(f"[{_VOWEL}][^{_VOWEL}]")
_SHORT_END = re.compile(f"(?:[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]|^[{_VOWEL}][^{_VOWEL}])$")


def _regions(w: str) -> tuple[int, int]:
    m = re.match("gener|commun|arsen", w)
    first = m.end() if m else (x.end() if (x := _REGION.search(w)) else len(w))
    return first, x.end() if (x := _REGION.search(w, first)) else len(w)


def _ends(w: str, table) -> str:
    return max((e for e in table if w.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    w = word.lstrip("'") if word[0] == "'" else word
    # A y at the start or behind a vowel counts as a consonant.
    w = re.sub(f"(^|(?<=[{_VOWEL}]))y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_VOWEL}].", w[:-1]):
        w = w[:-1]
    if w in _STAY:
        return w
    if e := _ends(w, ("eedly", "eed")):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif (e := _ends(w, ("ingly", "edly", "ing", "ed"))) and re.search(f"[{_VOWEL}]", w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT_END.search(w):
            w += "e"
    if re.search(f"[^{_VOWEL}][yY]$", w) and len(w) > 2:
        w = w[:-1] + "i"
    if e := _ends(w, _STEP2):
        at = len(w) - len(e)
        if at >= r1 and not (e == "ogi" and w[at - 1 : at] != "l") and not (e == "li" and w[at - 1 : at] not in tuple("cdeghkmnrt")):
            w = w[:at] + _STEP2[e]
    if e := _ends(w, _STEP3):
        at = len(w) - len(e)
        if at >= r1 and (e != "ative" or at >= r2):
            w = w[:at] + _STEP3[e]
    if e := _ends(w, _STEP4):
        at = len(w) - len(e)
        if at >= r2 and (e != "ion" or w[at - 1 : at] in ("s", "t")):
            w = w[:at]
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
