"""English tokens: accents folded, ASCII words, stopwords out, stems."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Folded letters (ß becomes ss) and stopwords.
ACCENTED = "áàäâãåéèëêíìïîóòöôõúùüûñçýÿÁÀÄÂÃÅÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyaaaaaaeeeeiiiiooooouuuuncy"
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but "
    "by can could did do does doing down during each few for from further had has have having he her here hers herself "
    "him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or "
    "other our ours ourselves out over own same she should so some such than that the their theirs them themselves then "
    "there these they this those through to too under until up very was we were what when where which while who whom why "
    "with would you your yours yourself yourselves"
).split()
# Suffix rules, in the order in which they are tried.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = [(s, "") for s in "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()]


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _first_rule(word: str, rules: list[tuple[str, str]], above: int) -> str:
    """The first rule whose suffix fits and whose stem's measure is above the bound; not the longest suffix."""
    for suffix, to in rules:
        stem = word.removesuffix(suffix)
        if stem != word and stem and _measure(stem) > above:
            return stem + to
    return word


def stem(word: str) -> str:
    """A Porter-like stem of a lower-case ASCII word; its deviations from Porter are part of the index's results.

    Plurals lose a single final s only (ties: tie). A word in -eed whose stem is too short falls through to -ed (feed: fe).
    """
    if len(word) < 3:
        return word
    if re.search("[^s]s$", word):
        word = word[:-1]
    shorter = _first_rule(word, [("eed", "ee")], 0)
    if shorter == word and (m := re.fullmatch("(.+)(?:ed|ing)", word)) and "v" in _shape(m[1]):
        word = m[1]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _doubled(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    else:
        word = shorter
    if len(word) > 1 and word[-1] == "y" and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _first_rule(_first_rule(word, STEP2, 0), STEP3, 0)
    shorter = _first_rule(word, STEP4, 1)
    if shorter == word and word.endswith(("sion", "tion")) and _measure(word[:-3]) > 1:
        shorter = word[:-3]
    word = shorter
    if len(word) > 1 and word[-1] == "e" and ((m := _measure(word[:-1])) > 1 or (m == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def fold(text: Column) -> Column:
    return F.translate(F.replace(text, F.lit("ß"), F.lit("ss")), ACCENTED, PLAIN)


def tokens(text: Column, stopwords: bool = True) -> Column:
    """Lower-case words of ASCII letters, in order, without stopwords.

    Only A-Z are lowered, so no other letter can turn into an ASCII one and cut or join words; a text that is all ASCII
    needs no table of letters.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    other = F.translate(F.replace(text, F.lit("ß"), F.lit("ss")), ACCENTED + upper, PLAIN + upper.lower())
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(other)
    words = F.regexp_extract_all(plain, F.lit("([a-z]+)"), F.lit(1))
    # A list of literals this long becomes a hash set.
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS)) if stopwords else words


def query_tokens(text: str) -> list[str]:
    folded = text.replace("ß", "ss").translate(str.maketrans(ACCENTED, PLAIN))
    return [w for w in (x.lower() for x in re.findall("[A-Za-z]+", folded)) if w not in STOPWORDS]


#: A stem differs from its word behind this many of its own letters, counted from its end, at most.
STEM_CHANGES = 2


def stem_prefix(s: str) -> str:
    """What every word with the stem s begins with: rules change or drop letters at a word's end only."""
    return s[: max(1, len(s) - STEM_CHANGES)]


def stem_column(word: Column) -> Column:
    """Stems of a column of distinct tokens."""

    @F.arrow_udf("string")
    def stems(column: pa.Array) -> pa.Array:
        return pa.array([None if w is None else stem(w) for w in column.to_pylist()], pa.string())

    return stems(word)
