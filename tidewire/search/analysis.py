"""Words to terms: lower case, accents removed, stop words dropped, English suffixes stripped (the published Porter2 algorithm)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from tidewire.functions.text import unaccented

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
#: English words too common to be searched for.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)

VOWELS = "aeiouy"
# The published algorithm's word lists and suffixes.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP2 = {"ization": "ize", "ational": "ate", "ousness": "ous", "iveness": "ive", "fulness": "ful", "tional": "tion", "lessli": "less", "biliti": "ble", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "fulli": "ful", "ousli": "ous", "iviti": "ive", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin: behind the first consonant that follows a vowel, and the same again."""

    def after(i: int) -> int:
        for j in range(i + 1, len(w)):
            if w[j] not in VOWELS and w[j - 1] in VOWELS:
                return j + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    """A short syllable at the end."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS + "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    if len(word) <= 2 or word in INVARIANT:
        return word
    w = word.lstrip("'").replace("’", "'")
    w = re.sub(r"(^y|(?<=[aeiouy])y)", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w.lower()
    # 1b: past and progressive
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in VOWELS for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    # 1c: y to i
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # 2
    s = _longest(w, (*STEP2, "ogi", "li"))
    if s and len(w) - len(s) >= r1:
        if s in STEP2:
            w = w[: -len(s)] + STEP2[s]
        elif s == "ogi" and w[-4:-3] == "l":
            w = w[:-1]
        elif s == "li" and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    # 3
    s = _longest(w, (*STEP3, "ative"))
    if s and len(w) - len(s) >= r1:
        if s == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(s)] + STEP3[s]
    # 4
    s = _longest(w, (*STEP4, "ion"))
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def term_of(word: str) -> str | None:
    """What a word is found under; None for a stop word."""
    plain = (unaccented(word) or "").lower()
    return None if plain in STOP_WORDS else stem(plain)


#: What is remembered of words: the terms of so many, and of none that is longer.
WORDS_KNOWN, KNOWN_LENGTH = 200_000, 32


def each_token(text: str | None, known: dict[str, str | None] | None = None) -> Iterator[tuple[str | None, int, int, int]]:
    """(term, position, start, end) of each word; the term of a stop word is None, but it takes a position. known remembers the terms of WORDS_KNOWN words that aren't long."""
    known = {} if known is None else known
    for i, m in enumerate(WORD.finditer(text or "")):
        word = m[0]
        if len(word) > KNOWN_LENGTH:
            yield term_of(word), i + 1, m.start(), m.end()
            continue
        if word not in known:
            if len(known) >= WORDS_KNOWN:
                known.clear()
            known[word] = term_of(word)
        yield known[word], i + 1, m.start(), m.end()


def tokens(text: str | None, known: dict[str, str | None] | None = None) -> list[tuple[str | None, int, int, int]]:
    """`each_token` as a list."""
    return list(each_token(text, known))


def terms(text: str | None) -> list[str]:
    return [t for t, *_ in tokens(text) if t]
