"""Scalar functions on columns: ratings, dates, lists, vectors and cursors."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of event kinds.
EVENT_WEIGHTS = {"view": 1.0, "click": 1.5, "purchase": 3.0, "signup": 0.8, "error": 0.5}
#: Fixed value: the year that stands in for an unknown one.
UNKNOWN_YEAR = 2010
#: Words that mean an empty list.
NULL_WORDS = ("", "nan", "none", "null", "[]")


def bayesian_rating(votes: Column, mean: Column, *, m: float = 25.0, prior: float = 5.0) -> Column:
    """Mean drawn towards the prior by m votes; without votes the mean itself."""
    return F.when(votes <= 0, mean).otherwise((votes * mean + m * prior) / (votes + m))


def recency_decay(year: Column, *, ref_year: int, half_life: float = 15.0) -> Column:
    return F.exp(-math.log(2) / half_life * F.greatest(F.lit(0), F.lit(ref_year) - year))


def genre_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def genre_affinity(item: Column, profile: Column) -> Column:
    return genre_overlap(item, profile) / F.greatest(F.size(F.array_distinct(profile)), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 where either is empty."""
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a side is the zero vector."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once a row: inside a lambda a plain expression is computed anew for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def l2_normalize(a: Column) -> Column:
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))
    return bound(a, lambda v: bound(norm(v), lambda n: scaled(v, n)))


def graded_label(rating: Column) -> Column:
    """Rating less 1, rounded half to even, within 0 to 4."""
    return F.least(F.lit(4), F.greatest(F.lit(0), F.bround(rating - 1, 0))).cast("int")


def parse_list(text: Column) -> Column:
    """A list written as JSON, or with quotes in brackets, or parted by comma, bar or semicolon."""
    bare = F.trim(text)
    json = F.from_json(F.replace(bare, F.lit("'"), F.lit('"')), "array<string>")
    parts = F.transform(F.split(bare, r"[,|;]"), lambda x: F.trim(x))
    listed = F.when(bare.startswith("["), F.coalesce(json, F.transform(F.split(F.regexp_replace(bare, r"[\[\]]", ""), r"[,|;]"), lambda x: F.trim(x, F.lit(" '\""))))).otherwise(parts)
    return F.when(text.isNull() | F.lower(bare).isin(*NULL_WORDS), F.array().cast("array<string>")).otherwise(F.filter(listed, lambda x: x.isNotNull() & (x != "")))


def extract_names(text: Column, key: str = "name") -> Column:
    """Names in a JSON array of objects, or of strings."""
    objects = F.filter(F.transform(F.from_json(text, f"array<struct<`{key}`:string>>"), lambda x: x[key]), lambda x: x.isNotNull())
    strings = F.from_json(text, "array<string>")
    return F.when(F.size(objects) > 0, objects).otherwise(F.coalesce(F.when(~F.exists(strings, lambda x: x.startswith("{")), strings), F.array().cast("array<string>")))


def safe_float(text: Column, default: float = 0.0) -> Column:
    x = text.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def parse_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def multi_hot(values: Column, vocabulary: list[str], prefix: str = "genre_") -> list[Column]:
    return [F.array_contains(values, g).cast("int").alias(f"{prefix}{g}") for g in vocabulary]


def release_year(date: Column, title: Column) -> Column:
    """First four characters of the date when a number, else a (YYYY) in the title, else the unknown year."""
    named = F.nullif(F.regexp_extract(title, r"\((\d{4})\)", 1), F.lit(""))
    return F.coalesce(F.substring(date, 1, 4).try_cast("int"), named.try_cast("int"), F.lit(UNKNOWN_YEAR))


def title_year(title: Column) -> Column:
    """The year only where the title ends in (YYYY)."""
    return F.nullif(F.regexp_extract(F.trim(title), r"\((\d{4})\)$", 1), F.lit("")).try_cast("int")


def sql_release_year(date: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(date, 1, 4), F.lit("")), F.lit(str(UNKNOWN_YEAR))).try_cast("long")


def release_month(date: Column) -> Column:
    return F.month(F.try_to_date(date, "yyyy-MM-dd"))


def release_decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def first_or_unknown(values: Column) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(1)), F.lit("<unknown>"))


def year_match(year: Column, user_mean: Column) -> Column:
    return F.abs(year - user_mean)


def genre_match(flags: Column, preferences: Column) -> Column:
    """Preference-weighted count of an item's genres."""
    return dot(flags, preferences)


def keyset_encode(value: Column, item_id: Column) -> Column:
    return F.base64(F.concat_ws("|", value.cast("string"), item_id.cast("string")).cast("binary"))


def keyset_decode(cursor: Column) -> list[Column]:
    parts = F.split(F.unbase64(cursor).cast("string"), r"\|")
    return [F.try_element_at(parts, F.lit(1)).try_cast("double").alias("value"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("item_id")]


def event_weight(kind: Column, weights: dict[str, float] | None = None, default: float = 1.0) -> Column:
    pairs = [F.lit(x) for kv in (weights or EVENT_WEIGHTS).items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit(default))


def hash_bucket(token: Column, size: int) -> Column:
    """The token's md5, a 128-bit number, modulo `size`."""
    digits = F.split(F.md5(token.cast("binary")), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda s, d: (s * 16 + F.conv(d, 16, 10).cast("long")) % size)


def year_bucket(date: Column, bucket: str) -> Column:
    """Release within a year, a range of years or a named period, by comparing strings."""
    year = F.substring(date, 1, 4)
    ranges = {"2020-2023": ("2020", "2023"), "2020s": ("2020", "2029"), "2010s": ("2010", "2019"), "2000s": ("2000", "2009")}
    if bucket == "classic":
        return (date != "") & (year < "2000")
    low, high = ranges.get(bucket) or (bucket.split("-") if "-" in bucket else (bucket, bucket))
    return (year >= low) & (year <= high)


def status(date: Column, wanted: str, today: str) -> Column:
    return (date > today) if wanted == "upcoming" else (date != "") & (date <= today)


def contains_text(text: Column, needle: str) -> Column:
    """Case-insensitive contains; % and _ in the needle stand for themselves."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def soup(genres: Column, director: Column, cast: Column, keywords: Column | None = None, *, actors: int = 5) -> Column:
    """Words that describe an item: genres, director and actors without spaces, keywords."""
    glued = lambda x: F.regexp_replace(x, " ", "")
    parts = [F.concat_ws(" ", genres), glued(F.coalesce(director, F.lit(""))), F.concat_ws(" ", F.transform(F.slice(F.coalesce(cast, F.array().cast("array<string>")), 1, actors), glued))]
    if keywords is not None:
        parts.append(F.concat_ws(" ", keywords))
    return F.trim(F.concat_ws(" ", *parts))


def item_text(title: Column, genres: Column, overview: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". Genres: "), F.concat_ws(", ", genres), F.lit(". "), F.coalesce(overview, F.lit("")))


def soup_tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), 1)
    return F.filter(tokens, lambda t: ~t.isin(*stop_words)) if stop_words else tokens
