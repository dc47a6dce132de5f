"""Intent router: a rule machine with three answers and "ambiguous", in column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft import vocab
from weft.functions.text import TOKEN, tokens, words_of

AMBIGUOUS = "ambiguous"
INTENT_WORDS = [*vocab.SALUTATIONS, *vocab.THANKS, *vocab.FILLERS]
#: Words of the capability phrases themselves, less those that carry no content.
CAPABILITY_WORDS = sorted({w for p in vocab.CAPABILITY_PHRASES for w in re.findall(TOKEN, p)} - set(vocab.STOPWORDS) - set(INTENT_WORDS))


def route(question: Column) -> Column:
    """salutation, thanks, capability, ambiguous, or null for a question to look up."""
    words = tokens(question)
    joined = F.array_join(words, " ")
    any_in = lambda some: F.arrays_overlap(words, words_of(some))
    phrase_in = lambda some: joined.rlike("|".join(some))
    remaining = F.array_except(words, words_of([*INTENT_WORDS, *vocab.STOPWORDS]))
    leftover = F.size(F.array_except(remaining, words_of(CAPABILITY_WORDS))) > 0
    capability, own, pointed = phrase_in(vocab.CAPABILITY_PHRASES), any_in(vocab.SELF_WORDS) | phrase_in(vocab.SELF_PHRASES), any_in(vocab.ANAPHORA)
    none = F.lit(None).cast("string")
    with_content = F.when(~capability | (pointed & ~own) | (leftover & ~own), none).when(~leftover & own, "capability").otherwise(AMBIGUOUS)
    bare = (
        F.when(capability & pointed & ~own, none).when(capability & own, "capability").when(capability, AMBIGUOUS)
        .when(any_in(vocab.THANKS), "thanks").when(any_in(vocab.SALUTATIONS), "salutation").otherwise(none)
    )
    return F.when(F.size(words) == 0, none).when(F.size(remaining) > 0, with_content).otherwise(bare)


def classify(question: Column) -> Column:
    """As route(), ambiguous questions being looked up."""
    return F.nullif(route(question), F.lit(AMBIGUOUS))
