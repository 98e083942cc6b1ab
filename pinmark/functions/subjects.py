"""The sample functions under observation, as Column expressions with their failure guards.

``*_py`` are the same functions in Python, for the Arrow form of capture and for replay.
"""

from __future__ import annotations

import random
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.capture import Guard, Outcome
from .text import python_float, python_repr_text, python_split

# Rate and messages the captured behaviour shows.
RATE = 1.05
NEGATIVE_AMOUNT = "Transaction amount cannot be negative."
DIVISION = "division by zero"
NOT_A_NUMBER_TEXT = "could not convert string to float: "
NULL_AMOUNT = "float() argument must be a string or a real number, not 'NoneType'"
NO_CANDIDATE = "empty range for randrange() (0, 0, 0)"
EMPTY_LIST = "list index out of range"

_ALPHABET = list(string.ascii_lowercase)


def process_transaction(amount: Column, *, text: bool = False, rate: float = RATE, name: str = "__amount") -> Outcome:
    """Amount times rate; null, unreadable, negative and zero amounts raise. NaN passes through.

    ``name`` is the column for the parsed amount; give each amount its own if several are captured in one pass.
    """
    value = F.col(name)
    guards = [Guard(amount.isNull(), TypeError, NULL_AMOUNT)]
    if text:
        unreadable = F.concat(F.lit(NOT_A_NUMBER_TEXT), python_repr_text(amount))
        guards.append(Guard(value.isNull(), ValueError, unreadable))
    guards += [
        Guard(value < 0, ValueError, NEGATIVE_AMOUNT),
        Guard(value == 0, ZeroDivisionError, DIVISION),
    ]
    return Outcome(value * F.lit(rate), tuple(guards), {name: python_float(amount) if text else amount.cast("double")})


def process_transaction_py(amount, rate: float = RATE):
    value = float(amount)
    if value < 0:
        raise ValueError(NEGATIVE_AMOUNT)
    if value == 0:
        raise ZeroDivisionError(DIVISION)
    return value * rate


def characters(word: Column) -> Column:
    """Code points of a string; the empty string has none."""
    # Splitting on nothing steps over UTF-8 characters without a regular expression.
    return F.when(word == "", F.array().cast("array<string>")).otherwise(F.split(word, ""))


def _in(letters: Column, c: Column) -> Column:
    # array_contains is NULL, not false, for a miss in an array that holds a NULL.
    return F.coalesce(F.array_contains(letters, c), F.lit(False))


def has_player_won(word: Column, letters: Column) -> Outcome:
    return Outcome(F.forall(characters(word), lambda c: _in(letters, c)))


def get_word_progress(word: Column, letters: Column) -> Outcome:
    shown = F.transform(characters(word), lambda c: F.when(_in(letters, c), c).otherwise(F.lit("_")))
    return Outcome(F.array_join(shown, ""))


def get_available_letters(letters: Column) -> Outcome:
    alphabet = F.array(*[F.lit(c) for c in _ALPHABET])
    return Outcome(F.array_join(F.filter(alphabet, lambda c: ~_in(letters, c)), ""))


def unique_letters(word: Column) -> Outcome:
    return Outcome(F.size(F.array_distinct(characters(word))))


def revealed_candidates(word: Column, pool: Column) -> Column:
    return F.filter(characters(word), lambda c: F.contains(pool, c))


def _pick(candidates: Column, key: Column, seed: int) -> Column:
    """A pseudo-random element that depends on the row only, so a retried task picks the same."""
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.size(candidates).cast("bigint")).cast("int") + 1
    return F.when(F.size(candidates) > 0, F.try_element_at(candidates, place))


def revealed(word: Column, pool: Column, *, key: Column, seed: int = 0) -> Outcome:
    """One of the word's letters that are in the pool, repeats counting."""
    candidates = revealed_candidates(word, pool)
    return Outcome(_pick(candidates, key, seed), (Guard(F.size(candidates) == 0, ValueError, NO_CANDIDATE),))


def choose_word(words: Column, *, key: Column, seed: int = 0) -> Outcome:
    return Outcome(_pick(words, key, seed), (Guard(F.size(words) == 0, IndexError, EMPTY_LIST),))


def load_words(text: Column) -> Column:
    """Words of the first line."""
    return python_split(F.regexp_extract(text, r"^([^\n\r]*)", 1))


def has_player_won_py(word, letters):
    return all(c in letters for c in word)


def get_word_progress_py(word, letters):
    return "".join(c if c in letters else "_" for c in word)


def get_available_letters_py(letters):
    return "".join(c for c in string.ascii_lowercase if c not in letters)


def unique_letters_py(word):
    return len(set(word))


def revealed_py(word, pool):
    candidates = [c for c in word if c in pool]
    if not candidates:
        raise ValueError(NO_CANDIDATE)
    return random.choice(candidates)


def choose_word_py(words):
    return random.choice(words)
