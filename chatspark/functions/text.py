"""Text functions of columns: terms, surface flags, token overlap, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flag name and the pattern that sets it.
SURFACE = {
    "question_mark": "[?？]", "exclamation": "[!！]", "mention": "@[^ ]+", "link": "https?://", "number": "[0-9]", "ellipsis": r"\.\.\.|…", "laughter": "(?i)haha|hhh|哈哈|lol",
    "latin": "[A-Za-z]{2,}", "quote": "[\"“”「」]", "newline": "\n",
}


def compact(text: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def characters(text: Column) -> Column:
    """Letters and digits of the compact text, as an array of code points."""
    return F.filter(F.split(compact(text), ""), lambda c: c.rlike(r"^[\p{L}\p{N}]$"))


def terms(text: Column, singles: int = 12) -> Column:
    """The first `singles` characters and all character bigrams."""
    c = characters(text)
    pairs = F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.concat(F.slice(c, 1, singles), pairs)


def surface_flags(text: Column) -> list[Column]:
    """A boolean for each pattern, and one for a character that is there three times in a row."""
    return [text.rlike(p).alias(n) for n, p in SURFACE.items()] + [text.rlike(r"(.)\1{2}").alias("repeated_character")]


def profile_compat(a: Column, b: Column, weight: float) -> Column:
    """+weight where two known values are equal, -weight where they differ, 0 where one is unknown."""
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, weight).otherwise(-weight)


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the distinct terms of two texts; 0 when both have none."""
    x, y = F.array_distinct(terms(a, 1 << 20)), F.array_distinct(terms(b, 1 << 20))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def alias_flags(name: Column) -> list[Column]:
    """Whether a name is uncertain, unclean or contextual, and its parts."""
    return [
        name.rlike("[?？]|可能|疑似|maybe|perhaps").alias("uncertain"), name.rlike(r"[<>\[\]{}|\\]|^\s|\s$").alias("unclean"), name.rlike("(?i)^(he|she|they|you|i|me|他|她|你|我)$").alias("contextual"),
        F.filter(F.split(F.trim(name), r"\s*[/、,;]\s*"), lambda x: x != "").alias("aliases"),
    ]


def naming_statements(text: Column) -> Column:
    """Names of "my name is X", "call me X", "我叫X", outside quotations."""
    plain = F.regexp_replace(text, "[\"“「][^\"”」]*[\"”」]", " ")
    return F.regexp_extract_all(plain, F.lit(r"(?:[Mm]y name is|[Cc]all me|我叫|叫我)\s*([\p{L}\p{N}]{1,16})"), 1)


def vocatives(text: Column) -> Column:
    """Names that begin a line before a comma."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^([\p{L}]{2,12})[,，]"), 1)


def validity_state(kind: Column, valid_to: Column, today: Column) -> Column:
    """current, expired, open or timeless, by the temporal kind and the last valid day."""
    end = F.to_date(valid_to)
    return F.when(kind == "timeless", "timeless").when(end.isNull(), "open").when(end < today, "expired").otherwise("current")


def owner_shift(flag_a: Column, flag_b: Column, base: Column) -> Column:
    """A flag on one side alone overrides the base probability of A."""
    return F.when(flag_a & ~flag_b, 0.0).when(flag_b & ~flag_a, 1.0).otherwise(base)


def threshold_correct(base: Column, choice: Column, confidence: Column, threshold: float) -> Column:
    """The small model's choice where it differs and is sure enough, else the base verdict."""
    return F.when((choice != base) & (confidence >= threshold), choice).otherwise(base)
