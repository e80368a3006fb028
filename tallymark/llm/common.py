"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between ASCII blanks, and words of ASCII letters and digits or other code points.
BLANK_WORD = r"[^\x20\x09-\x0D]+"
#: `PLAIN_WORD` is for text in lower case; `ANY_CASE_WORD` finds the same words before that.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: For `bytes.translate`: A-Z in lower case, what parts plain words becomes a blank.
PLAIN_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def by_value(module: str) -> None:
    """Ship the functions of `module` to Python workers by value, so that they need no path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def double_array(values) -> Column:
    """An array literal of any length that stays one constant in the plan."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once.

    A plain column that is used inside a function over an array may be computed again for every
    element, as the optimizer merges projections.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def plain_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and non-ASCII code points, A-Z in lower case, as UTF-8."""
    return text.encode().translate(PLAIN_BYTES).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z in lower case, as UTF-8."""
    return text.encode().lower().split() if text else []


by_value(__name__)
