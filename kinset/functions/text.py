"""Text normalisation, grams, shingles, subjects and quoted tails.

All but `folded` are column expressions. Spark has no function for Unicode normalisation (NFKC
and case folding); what it leaves in letters and digits of ASCII is made from tables in the
JVM (`folding`), the whole folded text by an Arrow-batched UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinset.functions.expressions import let
from kinset.functions.folding import folded_ascii

SHINGLE_SEPARATOR = "\x1f"
#: What ends a message's own text: a line of only these (fixed values).
TAIL = r"(?iuU)^\s*(?:[-_ \t]*original[ \t]+message[-_ \t]*|on[ \t][^\n]+[ \t]+wrote:[ \t]*)\s*$"


@F.pandas_udf(StringType())
def _fold_unicode(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def folded(text: Column) -> Column:
    """NFKC and case folding of whole texts; those that are not ASCII leave the JVM for it.

    Where only letters and digits of ASCII count, `folded_ascii` gives the same without that.
    """
    plain = text.rlike("^[\\x00-\\x7F]*$")
    return F.coalesce(F.when(plain, F.lower(text)), _fold_unicode(F.when(~plain, text)))


def normalize_ascii(text: Column) -> Column:
    """Lower case, anything but a-z and 0-9 to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normalize_unicode(text: Column | str) -> Column:
    """NFKC and case folding before the ASCII rule; accents are dropped with their letters."""
    return normalize_ascii(folded_ascii(F.col(text) if isinstance(text, str) else text))


def grams(text: Column, n: int = 3) -> Column:
    """All n-letter substrings in order; none of a shorter text."""
    def cut(t: Column) -> Column:
        count = F.length(t) - (n - 1)
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.substr(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return let(text, cut)


def field_features(**fields: Column) -> Column:
    """Grams of every normalised field, each tagged with the field's name."""
    def tagged(name: str, c: Column) -> Column:
        return F.transform(grams(normalize_ascii(F.coalesce(c, F.lit("")))), lambda g: F.concat(F.lit(f"{name}="), g))

    return F.flatten(F.array(*[tagged(name, c) for name, c in fields.items()]))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(words: Column, n: int = 5) -> Column:
    """Runs of n words joined by a separator no word contains; none of fewer words."""
    def cut(w: Column) -> Column:
        count = F.size(w) - (n - 1)
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(w, i, F.lit(n)), SHINGLE_SEPARATOR))).otherwise(F.array().cast("array<string>"))

    return let(words, cut)


def canonical_subject(subject: Column) -> Column:
    """Words of a subject, folded, without its reply and forward marks."""
    # a possessive group is matched in a loop: any number of marks, no deep stack
    bare = F.regexp_replace(folded(subject), r"^(?U:\s*)(?:(?:re(?:\[[0-9]+\])?|fw|fwd):[ \t]*)*+", "")
    return F.array_join(tokens(bare), " ")


def without_quotes(body: Column) -> Column:
    """The lines of a body but for those that begin with '>', up to a quoted tail.

    A quoted line is no tail. Line breaks become \\n; breaks at the end become one, if any.
    """
    lines = F.filter(F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n"), lambda x: ~x.rlike(r"(?U)^\s*>"))

    def cut(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda x: x.rlike(TAIL)), True)
        kept = F.when(first > 0, F.slice(lines, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))).otherwise(lines)
        return F.regexp_replace(F.array_join(kept, "\n"), "\n+\\z", "")

    ended = F.endswith(body, F.lit("\n")) | F.endswith(body, F.lit("\r"))
    return let(let(lines, cut), lambda text: F.when(ended & (text != ""), F.concat(text, F.lit("\n"))).otherwise(text))


def message_id(header: Column) -> Column:
    """The id between angle brackets; null where the header holds anything else."""
    got = F.regexp_extract(F.trim(header), r"^<([^<>\s]+)>$", 1)
    return F.when(got != "", got)


def strict_unsigned(text: Column) -> Column:
    """A number of digits without sign or leading zeros, below 2**64; else null."""
    return F.when(text.rlike("^(0|[1-9][0-9]{0,19})$") & (F.lpad(text, 20, "0") <= F.lit(str((1 << 64) - 1).zfill(20))), text.cast("decimal(20,0)"))


def split_numbers(text: Column) -> Column:
    """Comma-separated integers; an empty text has none."""
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(text, ","), lambda x: x.cast("bigint")))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def strict_integer(text: Column) -> Column:
    """A BIGINT of digits with an optional minus; else null."""
    return F.when(text.rlike("^-?[0-9]{1,19}$"), text.try_cast("bigint"))


def strict_double(text: Column) -> Column:
    """A finite decimal number, all of the text; else null."""
    value = F.when(text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)
