"""What the corpus operators share: words and white space as columns, and the tables and shipping of the rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadwell.shipping import ship
from roadwell.storage import drop, materialise, new_folder, table

__all__ = ["drop", "materialise", "new_folder", "ship", "table"]

#: The white space that ends a word: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def without_spaces(text: Column) -> Column:
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def only_spaces_apart(text: Column) -> Column:
    """The text with every kind of white space turned into a plain space."""
    for space in SPACES[1:]:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """The words of a text, in order; none for an empty one.

    Splitting at single spaces takes Java's fast path, which a pattern does not.
    """
    return F.array_remove(F.split(only_spaces_apart(text), " "), "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")
