"""Regex and number helpers shared by all extraction profiles.

Every helper returns a ``Column`` built from JVM-side functions
(``regexp_extract``, ``rlike``, ``try_cast`` ...), so the work stays inside
whole-stage code generation; no Python runs per row.

Dialect notes (Python ``re`` on ``str`` versus ``java.util.regex``):

* ``(?U)`` makes ``\\d \\w \\s \\b`` and case-insensitive matching Unicode aware,
  as Python does by default.
* ``(?d)`` makes ``\\n`` the only line terminator, so ``.`` and ``$`` behave as
  in Python (``.`` matches ``\\r``; ``$`` matches before a final ``\\n``).
* Python's ``\\s`` also matches the separators ``\\x1c``-``\\x1f``; Java's does
  not.  :func:`py` rewrites every ``\\s`` outside a character class into
  ``[\\s\\x1c-\\x1f]`` so both agree on all 29 white-space characters.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"

# Fixed value: the 29 characters for which Python's str.isspace() is true.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                 "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

MOST = (1 << 31) - 1
IGNORECASE = "i"
DOTALL = "s"


def py(pattern: str, flags: str = "") -> str:
    """Translate a Python-style pattern into an equivalent Java pattern.

    ``flags`` holds Python flags as letters: ``i`` (IGNORECASE), ``s`` (DOTALL).
    """
    out = []
    i, in_class = 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s" and not in_class:
                out.append(WS)
            elif nxt == "s":
                out.append(r"\s\x1c-\x1f")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return f"(?{''.join(sorted(set(flags)))}Ud)" + "".join(out)


def strip(c: Column) -> Column:
    """Python ``str.strip()``: remove all Unicode white space at both ends.

    A character-set trim (no regex): ``btrim`` removes code points of the set
    from both ends, exactly what ``str.strip()`` does.
    """
    return F.btrim(c, F.lit(PY_WHITESPACE))


def collapse_ws(c: Column) -> Column:
    """``re.sub(r'\\s+', ' ', x)``."""
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")


def extract(text: Column, pattern: str, flags: str = "", group: int = 1) -> Column:
    """Raw capture of the first match ('' when no match or group unset)."""
    return F.regexp_extract(text, py(pattern, flags), group)


def filled(c: Column) -> Column:
    """NULL for an empty text, else the text; ``c`` is computed once.

    ``nullif`` repeats its argument, and within a branch Spark doesn't share the copies: every search whose
    result is used ran twice.  The filter also keeps the projection out of whole-stage code, whose one method
    of all columns is longer than the 8000 bytes that the JVM compiles; outside, each expression is a small method.
    """
    return F.get(F.filter(F.array(c), lambda v: v != F.lit("")), 0)


def bound(c: Column, use) -> Column:
    """``use(c)`` with ``c`` computed once and written once in the plan, however often ``use`` reads it."""
    return F.get(F.transform(F.array(c), use), 0)


def fold(text: Column) -> Column:
    """The text with its ASCII letters lower-cased, character by character; others stay.

    A pattern of ASCII letters matches at a place of the text ignoring case if and only if its
    lower-case form (:func:`folded`) matches there: the four other characters that Java takes for
    an ASCII letter are replaced by it.  Where only digits are captured, or a place or the mere
    presence is asked for, the folded text does, and is searched several times faster.  Only those four
    take fewer bytes in it, so texts of equal bytes have equal places (:func:`text_from`).
    """
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, ascii_uppercase + "\u017f\u212a\u0131\u0130", ascii_lowercase + "skii"))


def folded(pattern: str) -> str:
    """The pattern with its letters lower-cased, but for those behind a backslash."""
    return re.sub(r"\\.|[A-Z]", lambda m: m.group() if m.group()[0] == "\\" else m.group().lower(), pattern)


def has_any(low: Column, words: list[str]) -> Column:
    """Whether the folded text holds one of the words: a plain search, many times faster than a pattern's."""
    out = low.contains(words[0].lower())
    for w in words[1:]:
        out = out | low.contains(w.lower())
    return out


def extract_folded(low: Column, pattern: str, flags: str = "", group: int = 1) -> Column:
    """:func:`extract` ignoring case on a folded text, for captures without letters."""
    return extract(low, folded(pattern), flags, group)


def extract_ci(text: Column, low: Column, pattern: str, flags: str = "", group: int = 1) -> Column:
    """:func:`extract` ignoring case: the place is found in the folded text, the capture read from the text there.

    The pattern must not begin with a look behind.
    """
    return extract(text_from(text, low, pattern, flags), rf"\A(?:{pattern})", flags + "i", group)


def text_from(text: Column, low: Column, pattern: str, flags: str = "") -> Column:
    """The text from the first place of the pattern (ignoring case) on, found in the folded text, which has
    as many characters after it.  Without a match the whole text, at whose beginning the pattern doesn't match."""
    # by what is left: regexp_instr counts a character beyond the BMP twice, substring once; in bytes, as
    # counting the characters costs as much as the search
    rest = extract(low, rf"(?:{folded(pattern)})(?s:.*+)", flags, 0)
    return F.when(F.octet_length(low) == F.octet_length(text), F.substring(text.cast("binary"), -F.octet_length(rest), F.lit(MOST)).cast("string")) \
        .otherwise(F.substring(text, -F.length(rest), F.lit(MOST)))


def positive(c: Column) -> Column:
    """NULL for a number that isn't positive, else the number; computed once, as in :func:`filled`."""
    return F.get(F.filter(F.array(c), lambda v: v > 0), 0)


def rest_from(text: Column, start: str) -> Column:
    """The text from the first ``start`` on, '' without one."""
    return extract(text, rf"{start}.*+", "s", 0)


def one_of(words: list[str]) -> str:
    """A pattern for any of the words, tried only where one's first letter stands."""
    firsts = "".join(sorted({w[0] for w in words}))
    return rf"[{firsts}](?:" + "|".join(rf"(?<={w[0]}){w[1:]}" for w in words) + ")"


def from_first(start: str, rest: str) -> str:
    """A pattern that finds what ``(start)rest`` finds, where ``rest`` matches after a later
    ``start`` only if it does after the first one.

    A search would try ``rest``, which may read the whole text, from every ``start``;
    here the first one is fixed (atomic group), and the time grows with the text's length only.
    """
    return rf"\A(?>(?s:.*?)(?={start})){start}{rest}"


def matches(text: Column, pattern: str, flags: str = "") -> Column:
    """``re.search(pattern, text) is not None``."""
    return text.rlike(py(pattern, flags))


def first_value(text: Column, pattern: str, flags: str = "is", default: str | Column = "") -> Column:
    """First capture, stripped; blank -> default."""
    v = strip(extract(text, pattern, flags))
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(filled(v), d)


def _searched(text: Column, low: Column | None, pattern: str, flags: str) -> Column:
    return extract(text, pattern, flags) if low is None else extract_ci(text, low, pattern, flags.replace("i", ""))


def first_nonblank(text: Column, patterns: list[str], flags: str = "is",
                   default: str | Column = "", needs: list[Column] | None = None, low: Column | None = None) -> Column:
    """Cascade; the first pattern giving a non-blank stripped capture wins; ``needs`` and ``low`` as in :func:`first_matching`."""
    d = default if isinstance(default, Column) else F.lit(default)
    needs = needs or [F.lit(True)] * len(patterns)
    vals = [F.when(n, filled(strip(_searched(text, low, p, flags)))) for p, n in zip(patterns, needs)]
    return F.coalesce(*vals, d)


def first_matching(text: Column, patterns: list[str], flags: str = "i",
                   default: str | Column = "", post=strip, nonempty: bool = False,
                   needs: list[Column] | None = None, low: Column | None = None) -> Column:
    """Cascade; the first pattern that matches wins, even when its capture is blank.

    ``nonempty=True`` declares that every pattern's group 1 cannot match the
    empty string; then "matched" equals "capture non-empty" and each pattern
    is evaluated once (``coalesce`` of captures) instead of twice.  ``needs``: per
    pattern a cheap condition without which it can't match.  ``low``: the folded text, for patterns
    that ignore case; places are then looked up in it (:func:`extract_ci`).
    """
    d = default if isinstance(default, Column) else F.lit(default)
    needs = needs or [F.lit(True)] * len(patterns)
    if nonempty:
        raw = F.coalesce(*[F.when(n, filled(_searched(text, low, p, flags))) for p, n in zip(patterns, needs)])
        return F.coalesce(post(raw), d)
    out = d
    for p, n in reversed(list(zip(patterns, needs))):
        out = F.when(n & matches(text, p, flags), post(extract(text, p, flags))).otherwise(out)
    return out


def digits_to_double(s: Column) -> Column:
    """Parse text made only of digits and dots (``1.2.3``, ``.`` or ``''`` -> NULL).

    No shape check is needed: with only digits and dots left, Spark's cast
    accepts exactly what Python's ``float`` accepts.
    """
    # an empty text is left out first: its failing cast costs more than the search that gave it
    return filled(s).try_cast("double")


def number_loose(s: Column) -> Column:
    """P5: keep digits and dots, parse as double; failure -> 0.0."""
    kept = F.regexp_replace(s, r"(?U)[^\d.]", "")
    return F.coalesce(digits_to_double(kept), F.lit(0.0))


def number_strict(s: Column) -> Column:
    """Drop commas, parse as double; failure -> 0.0.  ``s`` is a capture of
    digits, commas and dots."""
    return F.coalesce(digits_to_double(F.regexp_replace(s, ",", "")), F.lit(0.0))


_NUMERIC_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _to_double(s: Column) -> Column:
    """Parse text the way Python ``float`` does for plain decimal shapes.

    Spark's cast also accepts ``1d``/``1f`` suffixes that Python rejects, so the
    shape is checked first.  Non-ASCII digits are rejected by the shape check.
    """
    t = strip(s)
    return F.when(t.rlike(_NUMERIC_SHAPE), t.try_cast("double"))


def money(v: Column) -> Column:
    """Remove currency symbols and commas, parse; failure -> 0.0."""
    return F.coalesce(_to_double(F.translate(v, "₹$,", "")), F.lit(0.0))


def lines_stripped_nonblank(text: Column) -> Column:
    """Split on newline, strip each line, drop blank lines."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != F.lit(""))


def is_upper(x: Column) -> Column:
    """Python ``str.isupper()`` (has a cased character, none lower-case)."""
    return (F.upper(x) == x) & (F.lower(x) != x)


def contains_ci(text: Column, needle: str) -> Column:
    """``needle.lower() in text.lower()``."""
    return F.lower(text).contains(needle.lower())
