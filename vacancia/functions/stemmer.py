"""English stemming by the published Porter2 rules, one word at a time; callers remember the words of a batch."""

from __future__ import annotations

import re

# Fixed values of the published algorithm.
VOWELS, DOUBLES, LI_ENDINGS = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
REGION_PREFIXES = ("gener", "commun", "arsen")
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")

_REGION = re.compile(r"^.*?[aeiouy][^aeiouy]")
_SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _begin(word: str, at: int) -> int:
    """Where the region begins behind the first consonant that follows a vowel."""
    m = _REGION.match(word[at:])
    return at + m.end() if m else len(word)


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def porter2(word: str) -> str:
    """The stem of a lower-case word; of other than letters and apostrophes, the word itself."""
    if len(word) <= 2 or not word.replace("'", "").isalpha() or not word.isascii():
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.removeprefix("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1 = next((len(p) for p in REGION_PREFIXES if w.startswith(p)), None) or _begin(w, 0)
    r2 = _begin(w, r1)
    w = re.sub(r"(?:'s'|'s|')$", "", w)
    w = _plural(w)
    if w in AFTER_PLURAL:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    w = _swapped(w, STEP_2, r1) or _lone(w, r1)
    w = _swapped(w, STEP_3, r1) or (w[:-5] if w.endswith("ative") and len(w) - 5 >= r2 else w)
    w = _cut(w, r2)
    if w.endswith("e"):
        rest = w[:-1]
        if len(rest) >= r2 or len(rest) >= r1 and not _SHORT.search(rest):
            w = rest
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")) or not w.endswith("s"):
        return w
    return w[:-1] if _has_vowel(w[:-2]) else w


def _past(w: str, r1: int) -> str:
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not w.endswith(s):
            continue
        rest = w[: -len(s)]
        if s in ("eedly", "eed"):
            return rest + "ee" if len(rest) >= r1 else w
        if not _has_vowel(rest):
            return w
        if rest.endswith(("at", "bl", "iz")):
            return rest + "e"
        if rest.endswith(DOUBLES):
            return rest[:-1]
        return rest + "e" if len(rest) <= r1 and _SHORT.search(rest) else rest
    return w


def _swapped(w: str, table: dict[str, str], r1: int) -> str | None:
    """With the longest ending of the table replaced, if it lies in the region; None where no ending fits."""
    for s in sorted(table, key=len, reverse=True):
        if w.endswith(s):
            return w[: -len(s)] + table[s] if len(w) - len(s) >= r1 else w
    return None


def _lone(w: str, r1: int) -> str:
    """The two endings of the second step that depend on the letter before them."""
    if w.endswith("ogi") and len(w) - 3 >= r1 and w[:-3].endswith("l"):
        return w[:-1]
    if w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] and w[-3] in LI_ENDINGS:
        return w[:-2]
    return w


def _cut(w: str, r2: int) -> str:
    for s in STEP_4:
        if w.endswith(s):
            return w[: -len(s)] if len(w) - len(s) >= r2 else w
    if w.endswith("ion") and len(w) - 3 >= r2 and w[:-3].endswith(("s", "t")):
        return w[:-3]
    return w
