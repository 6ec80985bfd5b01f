"""Cleaning profiles, and which chunks are noise."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Literals that mark references.
MARKERS = ("et al", "doi", "journal", "vol.", "pp.", "http", "www.")


@dataclass(frozen=True)
class Profile:
    name: str = "basic"
    strip_nonprinting: bool = True
    collapse_whitespace: bool = True
    dehyphenate: bool = False
    remove_headers_footers: bool = False
    drop_reference_like_chunks: bool = False
    drop_abbreviation_like_chunks: bool = False
    drop_low_signal_chunks: bool = False
    min_alpha_ratio: float = 0.55
    min_token_count: int = 40
    max_digit_ratio: float = 0.25
    max_allcaps_ratio: float = 0.35
    max_equals_per_100_chars: float = 1.5

    @classmethod
    def of(cls, config: dict | None) -> Profile:
        """From a configuration; unknown keys are ignored, missing ones have their defaults."""
        config = config or {}
        return cls(**{f.name: type(f.default)(config[f.name]) for f in fields(cls) if config.get(f.name) is not None})

    @property
    def filters(self) -> bool:
        return self.drop_reference_like_chunks or self.drop_abbreviation_like_chunks or self.drop_low_signal_chunks


BASIC = Profile()
DEEP = Profile("deep", dehyphenate=True, remove_headers_footers=True, drop_reference_like_chunks=True, drop_abbreviation_like_chunks=True, drop_low_signal_chunks=True)


def cleaned(c: Column, profile: Profile = BASIC) -> Column:
    """A page's text under a profile; null counts as empty. Characters that don't print go first, and CR is
    one of them."""
    c = F.coalesce(c, F.lit(""))
    if profile.strip_nonprinting and profile.collapse_whitespace:
        # a text in which no pattern could find anything is only stripped; searches tell, one for a character and plain ones for the rest
        changes = c.rlike(r"[\x00-\x09\x0B-\x1F\x7F]")
        for mark in ("  ", "\n\n\n", *(["-\n"] if profile.dehyphenate else [])):
            changes = changes | F.contains(c, F.lit(mark))
        return F.when(changes, _cleaned(c, profile)).otherwise(T.strip(c))
    return _cleaned(c, profile)


def _cleaned(c: Column, profile: Profile) -> Column:
    if profile.strip_nonprinting:
        c = F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    if profile.dehyphenate:
        c = T.dehyphenated(c)
    c = T.newlines(c)
    if profile.collapse_whitespace:
        c = T.strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n"))
    return c


def reference_like(c: Column) -> Column:
    low = F.lower(c)
    years = F.regexp_count(low, F.lit(r"\b(19|20)[0-9]{2}\b"))
    semicolons = F.length(low) - F.length(F.replace(low, F.lit(";"), F.lit("")))
    markers = sum((F.regexp_count(low, F.lit(rf"\Q{m}\E")) for m in MARKERS), F.lit(0))
    return ((years >= 3) & (semicolons >= 3)) | ((markers >= 2) & (years >= 2))


def abbreviation_like(c: Column) -> Column:
    defined = F.regexp_count(c, F.lit(rf"\b[A-Z]{{2,}}\b[{T.SPACE}]*(=|:)[{T.SPACE}]*"))
    capitals, equals = T.capitals_ratio(T.quick_tokens(c)), T.equals_per_100(c)
    return ((capitals >= 0.40) & ((equals >= 1.0) | (defined >= 3))) | (defined >= 6)


def low_signal(c: Column, p: Profile) -> Column:
    t = T.quick_tokens(c)
    return (F.size(t) < p.min_token_count) | (T.alpha_ratio(c) < p.min_alpha_ratio) | (T.digit_ratio(c) > p.max_digit_ratio) | (T.capitals_ratio(t) > p.max_allcaps_ratio) | (T.equals_per_100(c) > p.max_equals_per_100_chars)


def is_noise(c: Column, profile: Profile) -> Column:
    """Empty texts are noise under any profile."""
    noise = T.strip(F.coalesce(c, F.lit(""))) == ""
    if profile.drop_low_signal_chunks:
        noise = noise | low_signal(c, profile)
    if profile.drop_reference_like_chunks:
        noise = noise | reference_like(c)
    if profile.drop_abbreviation_like_chunks:
        noise = noise | abbreviation_like(c)
    return noise


def without_noise(chunks: DataFrame, profile: Profile, always: bool = False) -> DataFrame:
    """Chunks that aren't noise; profiles without a filter keep all, unless `always` is set."""
    return chunks.where(~is_noise(F.col("text"), profile)) if always or profile.filters else chunks
