"""Text as columns: cleaning, tokens, headings, units, prefixes, query pieces.

White space and word characters are those of Unicode, spelt out, as the JVM's shorthand classes are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For character classes. Single characters below U+0100 are a look-up in a table, categories a call, so those come
#: first and these last; all separators (category Z) are spelt out.
_WIDE = "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = r"\t\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0" + _WIDE
SPACE = r"\n" + _BLANK
WORD = r"a-zA-Z0-9_\p{L}\p{N}"
#: The same as a string.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TOKEN = rf"[{WORD}]+|[^{WORD}{SPACE}]"
_CLOSING = (".", ",", ":", ";", "?", "!", ")", "]", "}")
_OPENING = ("(", "[", "{")


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def dehyphenated(c: Column) -> Column:
    return F.regexp_replace(c, rf"([{WORD}])-\n([{WORD}])", "$1$2")


def normalized(c: Column) -> Column:
    """Joins words hyphenated over a line end, makes line ends LF, blanks single, blank lines one at most,
    and strips every line's end and the whole. In this order, so that CR LF after a hyphen is kept, and
    lines that only look blank may leave more than one blank line. Text in which no pattern could find anything is only
    stripped, which is told by plain searches for what each of them needs."""
    changes = F.lit(False)
    for mark in ("-\n", "\r", "\t", "\x0b", "\f", "  ", "\n\n\n", *(f"{x}\n" for x in SPACES if x not in "\t\n\x0b\f\r")):
        changes = changes | F.contains(c, F.lit(mark))
    return F.when(changes, _normalized(c)).otherwise(strip(c))


def _normalized(c: Column) -> Column:
    c = F.regexp_replace(newlines(dehyphenated(c)), r"[ \t\x0B\r\f]{2,}|[\t\x0B\r\f]", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, rf"[{_BLANK}]++(?=\n)", ""))


def tokens(c: Column) -> Column:
    """Runs of word characters, and every other character that isn't white space by itself."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN))


def detokenized(t: Column) -> Column:
    """Tokens with one blank between, none before closing punctuation, and none behind an opening bracket
    that is the very first token."""
    return closed_up(F.array_join(t, " "))


def closed_up(c: Column) -> Column:
    """detokenized() of tokens that are joined by blanks."""
    # tokens hold no blank, so one before such a character stands before such a token
    for mark in _CLOSING:
        c = F.replace(c, F.lit(f" {mark}"), F.lit(mark))
    first = F.substring(c, 1, 1)
    return F.when(first.isin(*_OPENING) & (F.substring(c, 2, 1) == " "), F.concat(first, F.substring(c, 3, 1 << 30))).otherwise(c)


def is_heading(line: Column) -> Column:
    """A line that begins with a dotted number and a word, has six ASCII letters or more and all of them
    capitals, or is at most 80 characters long and ends with a colon."""
    line = strip(line)
    letters = F.regexp_replace(line, "[^A-Za-z]", "")
    numbered = line.rlike(rf"^[\p{{Nd}}]+(\.[\p{{Nd}}]+)*[{SPACE}]+[^{SPACE}]+")
    capitals = (F.length(letters) >= 6) & (letters == F.upper(letters))
    return (F.length(line) > 0) & (numbered | capitals | (line.endswith(":") & (F.length(line) <= 80)))


def heading_title(line: Column) -> Column:
    return F.regexp_replace(strip(line), r"^:+|:+\z", "")


def quick_tokens(c: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(c, rf"[{SPACE}]+"), lambda x: x != "")


def alpha_ratio(c: Column) -> Column:
    return F.coalesce(F.try_divide(F.regexp_count(c, F.lit(r"\p{L}")), F.length(c)), F.lit(0.0))


def digit_ratio(c: Column) -> Column:
    """Of decimal digits; superscripts and the like don't count."""
    return F.coalesce(F.try_divide(F.regexp_count(c, F.lit(r"\p{Nd}")), F.length(c)), F.lit(0.0))


def capitals_ratio(t: Column) -> Column:
    """Of tokens that have letters, all of them capitals, among all tokens."""
    capital = F.filter(t, lambda w: w.rlike(r"\p{L}") & ~w.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]"))
    return F.coalesce(F.try_divide(F.size(capital), F.size(t)), F.lit(0.0))


def equals_per_100(c: Column) -> Column:
    return F.coalesce(F.try_divide((F.length(c) - F.length(F.replace(c, F.lit("="), F.lit("")))) * F.lit(100.0), F.length(c)), F.lit(0.0))


def units(c: Column) -> Column:
    """The units of a text: each heading line, and the sentences of every other line."""
    lines = F.filter(F.transform(F.split(normalized(c), "\n"), strip), lambda x: x != "")
    split = F.transform(lines, lambda x: F.when(is_heading(x), F.array(x)).otherwise(F.filter(F.transform(F.split(x, rf"(?<=[.!?])[{SPACE}]+"), strip), lambda s: s != "")))
    return F.flatten(split)


def prefixed(c: Column, prefix: str) -> Column:
    """With the prefix unless it is there already in any case."""
    return c if not prefix else F.when(F.startswith(F.lower(c), F.lit(prefix.lower())), c).otherwise(F.concat(F.lit(prefix), c))


def token_windows(c: Column, size: int, overlap: int) -> Column:
    """Pieces of `size` tokens joined by blanks, beginning every size - overlap tokens; the first that
    reaches the end is the last. No tokens, no piece; size 0 or less leaves the text whole."""
    if size <= 0:
        return F.array(c)
    step = max(1, size - overlap)
    t = tokens(c)
    n = F.size(t)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int")) * step, F.lit(step))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(t, i + 1, size), " ")))


def safe_lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def safe_name(c: Column) -> Column:
    """For use as a folder's name."""
    return F.regexp_replace(c, "[^a-zA-Z0-9_.-]+", "_")


def rewritten(c: Column, hint: str = "") -> Column:
    """The heuristic query rewriter: single blanks, one question mark for whatever ends the question, and
    the hint in brackets unless the question has it in any case."""
    c = F.regexp_replace(strip(F.regexp_replace(c, rf"[{SPACE}]+", " ")), r"[?!.]+\z", "?")
    return c if not hint else F.when(F.contains(F.lower(c), F.lit(hint.lower())), c).otherwise(F.concat(c, F.lit(f" ({hint})")))


def seconds(c: Column) -> Column:
    """Of a duration in nanoseconds; one of a million or less counts as seconds already, a missing or negative one is -1."""
    return F.when(c.isNull() | (c < 0), F.lit(-1.0)).when(c > 1e6, c / 1e9).otherwise(c.cast("double"))


def augmented(text: Column, summary: Column) -> Column:
    return F.concat(F.lit("Summary: "), summary, F.lit("\n\n"), text)


def summary_input(text: Column, most: int = 6000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def summary_output(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), r'^"+|"+\z', ""))


def processor(table: Column, model: str) -> Column:
    """GPU or CPU, from the first row of a process table that names the model; GPU prevails; else unknown."""
    rows = F.filter(F.split(table, "\n"), lambda x: F.contains(x, F.lit(model)))
    row = F.upper(F.get(rows, F.lit(0)))
    return F.when(F.contains(row, F.lit("GPU")), "GPU").when(F.contains(row, F.lit("CPU")), "CPU").otherwise("unknown")
