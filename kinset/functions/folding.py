"""What NFKC and case folding leave of a text in a-z and 0-9, as column expressions.

Everything but a-z and 0-9 in the result only separates, so a text folded here has the same
runs of a-z and 0-9 as the text folded in full; other characters may stay or be spaces. The
tables are made from Python's Unicode data by these rules:

1. Characters whose compatibility form holds a letter or digit of ASCII become that form:
   one for one by `translate`, the others (ligatures, units, fractions) by a regular
   expression for each that a text can hold.
2. A letter that composes with a mark behind it goes. A mark is kept from its letter by an
   earlier mark of its own combining class; of several classes the least composes first.
   The few compositions that case folding takes apart again leave their letter.
3. Letters that fold to several letters of ASCII (the German sharp s) become those.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinset.functions.expressions import let

_KEPT = frozenset(ascii_letters + digits)


@cache
def _characters() -> tuple[str, ...]:
    """All that have a class or a form of their own: planes 0 and 1, ideographs aside."""
    every = map(chr, (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000)))
    return tuple(c for c in every if unicodedata.combining(c) or unicodedata.decomposition(c) or c.casefold() != c)


def _holds(text: str) -> bool:
    return not _KEPT.isdisjoint(text)


def _class(characters: set[str]) -> str:
    """A regular expression's class of these characters, as ranges."""
    codes, out = sorted(map(ord, characters)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" if a < b else f"\\x{{{a:X}}}" for a, b in out) + "]"


@cache
def _marks() -> dict[int, set[str]]:
    """Marks by combining class."""
    out: dict[int, set[str]] = {}
    for c in _characters():
        if kind := unicodedata.combining(c):
            out.setdefault(kind, set()).add(c)
    return out


@cache
def _composing() -> dict[str, dict[int, tuple[frozenset[str], frozenset[str]]]]:
    """letter -> class -> (marks that compose for good, marks whose composition folds back)."""
    out: dict[str, dict[int, tuple[frozenset[str], frozenset[str]]]] = {}
    for letter in ascii_letters:
        for kind, marks in _marks().items():
            whole = {m: w for m in marks if len(w := unicodedata.normalize("NFC", letter + m)) == 1 and unicodedata.normalize("NFD", w)[1:] == m}
            back = frozenset(m for m, w in whole.items() if _holds(w.casefold()))
            if whole:
                out.setdefault(letter, {})[kind] = (frozenset(whole) - back, back)
    return out


@cache
def _taken_apart() -> dict[str, str]:
    """Characters with the form that they are read in, where it matters for letters and digits."""
    composing = _composing()
    lowest = {letter: min(k for k, (_, back) in kinds.items() if back) for letter, kinds in composing.items() if any(back for _, back in kinds.values())}
    out = {}
    for c in _characters():
        form = unicodedata.normalize("NFKC", c)
        parts = unicodedata.normalize("NFD", c)
        if form != c and _holds(form):
            out[c] = form
        elif len(parts) > 1 and (_holds(c.casefold()) or lowest.get(parts[0], 255) < unicodedata.combining(parts[1])):
            # a mark of a lesser class behind it composes first
            out[c] = parts
        elif unicodedata.combining(c) and parts != c:
            out[c] = parts
    return out


def _gone() -> str:
    """A regular expression of letters that compose with a mark behind them."""
    every, kinds = set().union(*_marks().values()), _marks()
    other = {k: f"{_class(every - marks)}*+" for k, marks in kinds.items()}
    ways: dict[str, list[str]] = {}
    for letter, by_class in _composing().items():
        before = ""
        for kind in sorted(by_class):
            good, back = by_class[kind]
            if good:
                ways.setdefault(f"{before}(?={other[kind]}{_class(set(good))})", []).append(letter)
            if back:
                # composed with this one, the letter takes no mark of a greater class
                before += f"(?!{other[kind]}{_class(set(back))})"
    return "|".join(f"[{''.join(letters)}]{rest}" for rest, letters in ways.items())


#: Stands for any character that asks for more than its own look-up.
_SIGN = "\uf8ff"


@cache
def _single() -> dict[str, str]:
    return {c: f for c, f in _taken_apart().items() if len(f) == 1}


@cache
def _several() -> dict[str, str]:
    return {c: f for c, f in _taken_apart().items() if len(f) > 1}


@cache
def _folds() -> dict[str, str]:
    return {c: f for c in _characters() if _holds(f := c.casefold()) and c not in _taken_apart()}


@cache
def _quiet() -> str:
    """An expression of texts that hold only characters of wide ranges without rules."""
    loud = sorted({ord(c) for c in (*_taken_apart(), *set().union(*_marks().values()))})
    gaps = [(a + 1, b - 1) for a, b in zip([-1, *loud], loud) if b - a > (64 if b < 0x600 else 400) and a < 0x10000]
    return "^[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in gaps) + "]*$"


def folded_ascii(text: Column) -> Column:
    """text with the letters and digits of its folded form, in lower case, all else as separators.

    A text of ASCII or of letters without rules (most that are written in Latin, Greek, Cyrillic
    or ideographs) is only put in lower case. null stays null.
    """
    single, several = _single(), _several()
    table = F.create_map(*[F.lit(x) for pair in sorted(several.items()) for x in pair])
    signs = "".join(sorted({*several, *set().union(*_marks().values())}))

    def apart(t: Column) -> Column:
        """Each character that becomes several, looked up."""
        kind = _class(set(several))
        pieces = F.regexp_extract_all(t, F.lit(f"{kind}|[^{kind[1:-1]}]+"), F.lit(0))
        return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.when(F.length(p) == 1, F.element_at(table, p)), p)), "")

    def ruled(t: Column) -> Column:
        needs = F.contains(F.translate(t, signs, _SIGN * len(signs)), F.lit(_SIGN))
        whole = F.when(needs, F.regexp_replace(F.translate(apart(t), "".join(single), "".join(single.values())), _gone(), " "))
        return whole.otherwise(F.translate(t, "".join(single), "".join(single.values())))

    def folds(t: Column) -> Column:
        for c, f in _folds().items():
            t = F.replace(t, F.lit(c), F.lit(f))
        return F.lower(t)

    quiet = F.when(text.rlike(_quiet()), text).otherwise(ruled(text))
    return F.when(text.rlike("^[\\x00-\\x7F]*$"), F.lower(text)).otherwise(folds(quiet))


def plain_runs(text: str) -> list[str]:
    """The same runs in plain Python, for tests."""
    return re.findall("[a-z0-9]+", unicodedata.normalize("NFKC", text).casefold())
