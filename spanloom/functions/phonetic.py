"""How English words sound alike, without pronunciations: spelling forms and their similarity."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.text import skeleton

#: Contractions (without apostrophes) and what they stand for.
CONTRACTIONS = {
    "im": "i am", "ive": "i have", "ill": "i will", "id": "i would", "youre": "you are", "youve": "you have", "youll": "you will", "youd": "you would", "theyre": "they are", "theyve": "they have", "theyll": "they will", "theyd": "they would",
    "were": "we are", "weve": "we have", "well": "we will", "wed": "we would", "cant": "can not", "wont": "will not", "dont": "do not", "didnt": "did not", "doesnt": "does not", "isnt": "is not", "arent": "are not", "wasnt": "was not", "werent": "were not",
    "shouldnt": "should not", "couldnt": "could not", "wouldnt": "would not", "theres": "there is", "thats": "that is", "whats": "what is", "lets": "let us",
}
#: Words that sound alike, and fillers, each with the one that stands for it.
ALIKE = {"their": "their", "there": "their", "your": "your", "to": "to", "too": "to", "two": "to", "for": "for", "four": "for", "its": "its", "mmm": "mm", "mm": "mm", "mhm": "mm", "hmm": "mm", "uh": "uh", "uhh": "uh", "um": "um", "umm": "um"}


@F.pandas_udf(T.StringType())
def bare(text: pd.Series) -> pd.Series:
    """Lower case, without accents and punctuation, words by single spaces."""

    def one(t: str) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn")
        return " ".join(re.sub(r"[^\w\s]", "", plain).split())

    return text.map(lambda t: None if t is None else one(t))


def spoken_form(text: Column, english: bool = True) -> Column:
    """A text as it is compared: bare, and in English with contractions expanded, and one spelling for words and fillers that
    sound alike. Null stays null."""
    plain = bare(text)
    if not english:
        return plain
    table = F.create_map(*[F.lit(x) for kv in (ALIKE | CONTRACTIONS).items() for x in kv])
    return F.array_join(F.transform(F.split(plain, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def spoken_similarity(a: Column, b: Column, english: bool = True, alike: float = 0.93, least: float = 0.95) -> Column:
    """0 to 1: how alike two texts' spoken forms are; 0 where either is empty or null, 1 where they are equal. Single English
    words whose ratio is ``alike`` or more count as ``least`` at least.

    This is what pronunciations fall back to where there are none; ``with_skeletons`` adds what consonants tell.
    """
    from spanloom.operators.align import similarity

    x, y = spoken_form(a, english), spoken_form(b, english)
    ratio = similarity(x, y)
    single = F.lit(english) & ~F.contains(x, F.lit(" ")) & ~F.contains(y, F.lit(" "))
    some = (F.length(x) > 0) & (F.length(y) > 0)
    return F.when(F.coalesce(some, F.lit(False)), F.when(x == y, 1.0).when(single & (ratio >= alike), F.greatest(ratio, F.lit(least))).otherwise(ratio)).otherwise(0.0)


def with_skeletons(score: Column, a: Column, b: Column, share: float = 0.95) -> Column:
    """A score of two English texts, or ``share`` of how alike their consonants are, if that is more. Forms without
    consonants tell nothing."""
    from spanloom.operators.align import similarity

    x, y = skeleton(spoken_form(a)), skeleton(spoken_form(b))
    told = F.coalesce((F.length(x) > 0) & (F.length(y) > 0), F.lit(False))
    return F.when(told, F.greatest(score, similarity(x, y) * share)).otherwise(score)
