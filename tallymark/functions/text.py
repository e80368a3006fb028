"""Titles, headers and labels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions import vocab
from tallymark.functions.numbers import strip


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_any(text: Column, words: list[str]) -> Column:
    return any_of([F.contains(text, F.lit(w)) for w in words])


def normalise_header(name: Column, space_to_underscore: bool = False) -> Column:
    out = F.lower(strip(name))
    return F.replace(out, F.lit(" "), F.lit("_")) if space_to_underscore else out


def lines_of(text: Column) -> Column:
    """Trimmed, non-blank lines."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def first_line(text: Column) -> Column:
    """First line with text, trimmed; the rest of a long text is not read."""
    return F.coalesce(strip(F.regexp_extract(text, r"(?U)^\s*([^\n]*)", 1)), F.lit(""))


def is_noisy(title: Column) -> Column:
    """The title is a figure, an arrow or scroll text rather than a name."""
    return (
        (F.coalesce(title, F.lit("")) == "")
        | ((F.length(title) <= 2) & title.rlike(vocab.NOISE_ARROW))
        | title.rlike(vocab.NOISE_LEADING)
        | title.rlike(vocab.NOISE_DIGITS)
        | title.rlike(vocab.NOISE_NUMBER)
        | title.rlike(vocab.NOISE_SCROLL)
    )


def safe_title(text: Column, max_len: int = 80) -> Column:
    """First line, double quotes made single, shortened for display."""
    line = F.replace(first_line(text), F.lit('"'), F.lit("'"))
    return F.when(
        F.length(line) > max_len, F.concat(F.rtrim(F.left(line, F.lit(max_len))), F.lit("…"))
    ).otherwise(line)


def snippet(text: Column, max_len: int = 80) -> Column:
    """One-line preview of a visual's text."""
    return F.left(F.replace(text, F.lit("\n"), F.lit(" | ")), F.lit(max_len))


def undouble(text: Column) -> Column:
    """`abab` is read as `ab`; anything else stays."""
    half = (F.length(text) / 2).cast("int")
    front = F.left(text, half)
    return F.when(F.concat(front, front) == text, front).otherwise(text)


def point_label(label: Column) -> Column:
    """`Category. Measure. Value.` as a struct; null when it is not a point."""
    def point(parts: Column) -> Column:
        size = F.size(parts)
        measure = F.when(size == 3, strip(F.get(parts, F.lit(1)))).when(size > 3, F.array_join(
            F.slice(parts, F.lit(2), F.greatest(size - 2, F.lit(0))), ", "))
        return F.when((F.length(strip(label)) >= 3) & (size >= 2), F.struct(
            strip(F.get(parts, F.lit(0))).alias("category"),
            measure.alias("measure"),
            strip(F.try_element_at(parts, F.lit(-1))).alias("value"),
        ))

    return let(F.split(F.regexp_replace(strip(label), r"\.$", ""), r"\. "), point)


def api_column(name: Column) -> Column:
    """`[X]` and `Table[X]` become `x`."""
    whole = F.regexp_extract(name, r"(?s)^\[(.*)\]$", 1)
    inner = F.regexp_replace(F.regexp_extract(name, r"(?s)^[^\[]*\[(.*)$", 1), r"\]+$", "")
    return F.lower(F.trim(
        F.when(name.rlike(r"(?s)^\[.*\]$"), whole)
        .when(name.rlike(r"(?s)\[.*\]$"), inner)
        .otherwise(name)
    ))


def match_form(name: Column) -> Column:
    """Letters and digits only, for fuzzy matching."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]", "")


def human_label(title: Column, visual_type: Column, index: Column) -> Column:
    return F.coalesce(
        F.nullif(title, F.lit("")),
        F.concat(
            F.nullif(visual_type, F.lit("")), F.lit("["),
            F.coalesce(index.cast("string"), F.lit("None")), F.lit("]"),
        ),
        F.lit("Unknown"),
    )


def error_phrase(text: Column) -> Column:
    """First known error phrase in the text, or null."""
    found = F.lit(None).cast("string")
    for phrase in reversed(vocab.ERROR_PHRASES):
        found = F.when(F.contains(text, F.lit(phrase)), F.lit(phrase)).otherwise(found)
    return found


def is_numeric_type(type_name: Column) -> Column:
    return contains_any(F.upper(type_name), vocab.NUMERIC_TYPE_WORDS)


def is_date_type(type_name: Column) -> Column:
    return contains_any(F.upper(type_name), vocab.DATE_TYPE_WORDS)


def is_text_type(type_name: Column) -> Column:
    return contains_any(F.upper(type_name), vocab.TEXT_TYPE_WORDS)


def inferred_aggregate(column: Column, type_name: Column, title: Column | None = None) -> Column:
    """`SUM`, `COUNT`, `AVG`, or `""` for a column to group by."""
    words = F.lower(F.concat(title if title is not None else F.lit(""), F.lit(" "), column))
    return (
        F.when(
            contains_any(words, vocab.COUNTING_WORDS),
            F.when(F.contains(words, F.lit("count")), F.lit("COUNT")).otherwise(F.lit("SUM")),
        )
        .when(contains_any(words, vocab.AVERAGE_WORDS + vocab.RATIO_WORDS), F.lit("AVG"))
        .when(is_numeric_type(type_name), F.lit("SUM"))
        .when(is_text_type(type_name), F.lit(""))
        .otherwise(F.lit("SUM"))
    )
