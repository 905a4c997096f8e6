"""English stemming by Porter's algorithm of 1980: five steps of suffix rules on the measure of the stem."""

from __future__ import annotations

import re

#: The algorithm's suffixes and what takes their place.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

PLAIN = re.compile("[a-z]+$")


def shape(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", shape(word)))


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    if len(word) < 3 or not PLAIN.match(word):
        return word
    for ending, kept in (("sses", 2), ("ies", 2), ("ss", 0), ("s", 1)):
        if word.endswith(ending):
            word = word[: len(word) - kept]
            break
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        ending = longest(word, ("ed", "ing"))
        if ending and "v" in shape(word[: -len(ending)]):
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif doubled(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif measure(word) == 1 and short(word):
                word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP2, STEP3):
        ending = longest(word, rules)
        if ending and measure(word[: -len(ending)]) > 0:
            word = word[: -len(ending)] + rules[ending]
    ending = longest(word, STEP4)
    if ending and measure(word[: -len(ending)]) > 1 and (ending != "ion" or word[-4] in "st"):
        word = word[: -len(ending)]
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not short(word[:-1])):
        word = word[:-1]
    if doubled(word) and word[-1] == "l" and measure(word[:-1]) > 1:
        word = word[:-1]
    return word
