"""Message tables: mentions, title links, critiques and intents by tables of phrases.

A message is read as a line of tokens in lower case: words, numbers and single marks. A phrase holds where its tokens stand
side by side. Which phrases mean what is told by the caller's tables; `slatewise.operators.phrases` has those of one chat.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.session import written

#: A token: a number, a word, "at least", or one other mark.
TOKEN = r"[0-9]+\.[0-9]+|[\p{L}\p{M}\p{N}_]+|>=|[^\s\p{L}\p{M}\p{N}_]"
#: Marks that end a span.
ENDS = [".", ",", "!", "?", '"', "'", "“", "”"]
YEARS = "(?:19|20)[0-9]{2}"
#: A title in double quotation marks.
TITLE = '["“”][^"“”]*["“”]'


@dataclass(frozen=True)
class Language:
    name: str
    letters: str = ""
    words: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Span:
    """The tokens after a lead-in (and a filler or mark) up to a stop word or mark, less the tails; no answer where it is one of `never`, or a phrase of `unless` holds."""

    leads: list[str]
    fillers: list[str] = field(default_factory=list)
    stops: list[str] = field(default_factory=list)
    tails: list[str] = field(default_factory=list)
    never: list[str] = field(default_factory=list)
    unless: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Number:
    """A number of one digit, with or without another behind the point, after a lead-in and a filler, or before a mark."""

    leads: list[str]
    fillers: list[str] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Intent:
    """Holds where a phrase of `says` does, the span `holds` is found, or, for `searches`, any search field is: one alone gives the intent its own name. `keeps` leaves the search fields told."""

    name: str
    says: list[str] = field(default_factory=list)
    holds: str | None = None
    searches: bool = False
    keeps: bool = False


@dataclass(frozen=True)
class Grammar:
    spans: dict[str, Span]
    genres: dict[str, str]
    rating: Number
    intents: list[Intent]
    languages: list[Language] = field(default_factory=list)
    #: Where no language is told by its letters or words, and where no intent holds.
    other_language: str = "en"
    other_intent: str = "fallback"


@dataclass(frozen=True)
class Critiques:
    triggers: list[str]
    exclusions: list[str]
    hints: dict[str, str]
    rating: Number
    newer: list[str]
    older: list[str]
    newer_year: int
    older_year: int


def extract_mentions(messages: DataFrame, *, key: str = "message_id", text: str = "text", most: int = 10, shortest: int = 3, quotes: str = "'\"“”", words: int = 5) -> DataFrame:
    """(key, mentions): quoted spans of 2 to 80 characters, then phrases of up to `words` capitalised words and at least `shortest` letters, each once, at most `most`; no text, none."""
    inner = r"[\p{L}\p{M}\p{N}_'’-]*"
    quoted = F.regexp_extract_all(text, F.lit(f"[{quotes}]([^{quotes}]{{2,80}})[{quotes}]"), 1)
    phrases = F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{M}}\p{{N}}_])\p{{Lu}}{inner}(?:\s+[\p{{Lu}}0-9]{inner}){{0,{words - 1}}}"), 0)
    phrases = F.transform(phrases, lambda x: F.regexp_replace(x, "['’-]+$", ""))
    quoted = F.filter(F.transform(quoted, F.trim), lambda x: x != "")
    found = F.slice(F.array_distinct(F.concat(quoted, F.filter(phrases, lambda x: F.length(x) >= shortest))), 1, most)
    return messages.select(key, F.coalesce(found, F.array().cast("array<string>")).alias("mentions"))


def similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _segment(length: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and width of segment i of the edits + 1 nearly equal ones that a title is cut into."""
    start = F.floor(i * length / (edits + 1)).cast("int")
    return start, F.floor((i + 1) * length / (edits + 1)).cast("int") - start


def title_candidates(mentions: DataFrame, titles: DataFrame, *, cutoff: float) -> DataFrame:
    """(m, t, item_id, edits): at least once every pair of texts whose similarity is `cutoff` or more, and few others.

    mentions: (m); titles: (t, item_id). The longer of two texts bounds the edits between them. A title is cut into one segment
    more than that bound, so one segment comes back whole in the mention, and near its own place: before segment i lie at most i
    edits, behind it at most the rest. Segments are met by an equi-join on what bound, length and number they have.
    """
    most = lambda length: F.floor((1 - cutoff) * length + 1e-9).cast("int")
    key = lambda text, at, width: F.xxhash64("length", "edits", "i", F.substr(text, at + 1, width))
    t = titles.withColumn("length", F.length("t"))
    t = t.withColumn("edits", F.explode(F.sequence(most(F.col("length")), most(F.floor(F.col("length") / cutoff + 1e-9)))))
    t = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    start, width = _segment(F.col("length"), F.col("edits"), F.col("i"))
    index = t.select("t", "item_id", key(F.col("t"), start, width).alias("key"))

    own = F.length("m")
    m = mentions.select("m", F.explode(F.sequence(F.ceil(cutoff * own - 1e-9).cast("int"), F.floor(own / cutoff + 1e-9).cast("int"))).alias("length"))
    m = m.join(titles.select(F.length("t").alias("length")).distinct(), "length")
    m = m.withColumn("edits", most(F.greatest(own, F.col("length")))).filter(F.abs(own - F.col("length")) <= F.col("edits"))
    m = m.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    start, width = _segment(F.col("length"), F.col("edits"), F.col("i"))
    longer, behind = own - F.col("length"), F.col("edits") - F.col("i")
    low = F.greatest(F.lit(0), start - F.col("i"), start + longer - behind)
    high = F.least(own - width, start + F.col("i"), start + longer + behind)
    m = m.withColumn("width", width).withColumn("places", F.when(low <= high, F.sequence(low, high)))
    keys = F.array_distinct(F.transform("places", lambda at: key(F.col("m"), at, F.col("width"))))
    return m.select("m", "edits", F.explode(keys).alias("key")).join(index, "key").select("m", "t", "item_id", "edits")


def link_titles(mentions: DataFrame, titles: DataFrame, *, cutoff: float = 0.6, firm: float = 0.85) -> DataFrame:
    """(message_id, mention, item_id, score): exact lower-case title, else the closest whose similarity reaches the cutoff.

    A mention links one item at most, ties to the smaller item; of a message's mentions of one item the closest stays, ties to
    the smaller text. mentions: (message_id, mention); titles: (item_id, title); nulls link nothing. Distinct mentions meet
    distinct titles only, and those that a title is `firm` for never look further: few edits are cheap to search, many are not.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff lies in (0, 1]")
    mentions = written(mentions.select("message_id", "mention"), "mentions")  # each rung reads them, their texts are read once
    m = mentions.select(F.lower("mention").alias("m")).distinct()
    t = written(titles.groupBy(F.lower("title").alias("t")).agg(F.min("item_id").alias("item_id")), "titles")
    found = m.join(t, F.col("m") == F.col("t")).select("m", "item_id", F.lit(1.0).alias("score"))
    for rung in sorted({max(cutoff, firm), cutoff}, reverse=True):
        rest = m.join(found.select("m"), "m", "left_anti")
        near = title_candidates(rest, t, cutoff=rung).filter("levenshtein(m, t, edits) >= 0").withColumn("score", similarity(F.col("m"), F.col("t"))).filter(F.col("score") >= rung)
        best = near.groupBy("m").agg(F.min_by(F.struct("item_id", "score"), F.struct(-F.col("score"), F.col("item_id"))).alias("_best"))
        found = written(found.unionByName(best.select("m", "_best.*")), "links")
    rows = mentions.join(found, F.lower("mention") == F.col("m")).select("message_id", "mention", "item_id", F.round("score", 4).alias("score"))
    first = F.min_by(F.struct("mention", "score"), F.struct(-F.col("score"), F.col("mention"))).alias("_first")
    return rows.groupBy("message_id", "item_id").agg(first).select("message_id", "_first.mention", "item_id", "_first.score")


def spoken(text: Column) -> Column:
    """The tokens of a text in lower case, with a space before, between and behind them; a null is no token."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0), " "), F.lit(" "))


def phrase(words: str) -> str:
    """A phrase as `spoken` has it."""
    return " " + " ".join(re.findall(r"[0-9]+\.[0-9]+|\w+|>=|[^\w\s]", words.lower())) + " "


def says(line: Column, phrases: list[str]) -> Column:
    """Does one of the phrases hold?"""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(line, F.lit(phrase(p)))
    return found


def named(line: Column, table: dict[str, str]) -> Column:
    """The names of the phrases that hold, in the table's order."""
    return F.filter(F.array(*[F.when(says(line, [p]), F.lit(name)) for p, name in table.items()]), lambda x: x.isNotNull())


def _one_of(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(phrase(w).strip()) for w in words) + ")"


def span(line: Column, s: Span) -> Column:
    """What a span holds after the first of its lead-ins, in the table's order, that the line has; null where it holds nothing."""
    rest = F.coalesce(*[F.when(F.contains(line, F.lit(phrase(p))), F.substring(line, F.instr(line, phrase(p)) + len(phrase(p)) - 1, F.length(line))) for p in s.leads])
    filler = f"(?:{_one_of(s.fillers)} )?" if s.fillers else ""
    rest = F.regexp_replace(rest, f"^ {filler}(?:{_one_of(ENDS)} )?", " ")
    for stop in (*s.stops, *ENDS):
        rest = F.concat(F.substring_index(rest, phrase(stop), 1), F.lit(" "))
    if s.tails:
        rest = F.regexp_replace(rest, f" {_one_of(s.tails)} +$", " ")
    told = F.filter(F.array(F.trim(rest)), lambda x: x.isNotNull() & ~x.isin("", *s.never))
    return F.when(~says(line, s.unless), F.get(told, F.lit(0)))


def number(line: Column, n: Number) -> Column:
    """The number that a lead-in or a mark tells, as a double."""
    filler = f"(?:{_one_of(n.fillers)} )?" if n.fillers else ""
    told = [F.regexp_extract(line, f" {_one_of(n.leads)} {filler}([0-9](?:\\.[0-9])?) ", 1)]
    if n.marks:
        told.append(F.regexp_extract(line, f" ([0-9](?:\\.[0-9])?) {_one_of(n.marks)} ", 1))
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in told]).try_cast("double")


def year(line: Column, more: str = "") -> Column:
    """The first token that is a year, as a text; `more` are further forms."""
    return F.nullif(F.regexp_extract(line, f" ({YEARS}{more}) ", 1), F.lit(""))


def parse_critique(messages: DataFrame, *, text: str = "text", tables: Critiques | None = None) -> DataFrame:
    """is_critique, exclude_genres, genre, min_rating, newer_than, older_than and diverse of each message.

    A message that holds no trigger is no critique and has nulls. An exclusion takes all genres hinted at; else the first hint
    is the genre wished for. A year, or a word for newer or older, bounds the release; "diverse" is a plain wish for more. A null
    or empty text is no critique. What stands in double quotation marks is a title and wishes for nothing, whatever its words are.
    """
    if tables is None:
        from slatewise.operators.phrases import CRITIQUES as tables
    line = F.col("_line")
    rows = messages.withColumn("_line", spoken(F.regexp_replace(text, TITLE, ' " ')))
    rows = rows.withColumns({"is_critique": says(line, tables.triggers), "_out": says(line, tables.exclusions), "_named": named(line, tables.hints)})
    newer = F.coalesce(year(line).cast("int"), F.when(says(line, tables.newer), F.lit(tables.newer_year)))
    told = {
        "exclude_genres": F.when(F.col("_out"), F.array_sort(F.array_distinct("_named"))).otherwise(F.array().cast("array<string>")),
        "min_rating": number(line, tables.rating),
        "newer_than": newer,
        "genre": F.when(~F.col("_out") | (F.size("_named") == 0), F.try_element_at("_named", F.lit(1))),
        "older_than": F.when(newer.isNull() & says(line, tables.older), F.lit(tables.older_year)),
    }
    rows = rows.withColumns({name: F.when(F.col("is_critique"), x) for name, x in told.items()}).drop("_line", "_out", "_named")
    bound = (F.size("exclude_genres") > 0) | F.greatest(*[F.col(c).isNotNull() for c in ("genre", "min_rating", "newer_than", "older_than")])
    return rows.withColumn("diverse", F.col("is_critique") & ~F.coalesce(bound, F.lit(False)))


def language(text: Column, line: Column, languages: list[Language], other: str = "en") -> Column:
    """The first language of which the text has a letter, or its `spoken` line a word; else `other`."""
    out = F.lit(other)
    for x in reversed(languages):
        letter = F.coalesce(F.lower(text).rlike(f"[{x.letters}]"), F.lit(False)) if x.letters else F.lit(False)
        out = F.when(letter | says(line, x.words), x.name).otherwise(out)
    return out


def detect_intent(messages: DataFrame, *, text: str = "text", grammar: Grammar | None = None) -> DataFrame:
    """intent, language, target_title, genres, director, actor, year and min_rating of each message.

    The intent is the first of the grammar's that holds, else its `other_intent`. The title is told with the intent of its span, the other
    fields with intents that keep them, genres with searches. A null text is an empty one.
    """
    if grammar is None:
        from slatewise.operators.phrases import GRAMMAR as grammar
    line = F.col("_line")
    rows = messages.withColumn("_line", spoken(F.col(text)))
    rows = rows.withColumn("language", language(F.col(text), line, grammar.languages, grammar.other_language))
    rows = rows.withColumns({f"_{name}": span(line, s) for name, s in grammar.spans.items()})
    rows = rows.withColumns({"_year": year(line, "|20[12]0s"), "_rating": number(line, grammar.rating), "_genres": F.array_distinct(named(line, grammar.genres))})
    fields = {"year": F.col("_year").isNotNull(), "director": F.col("_director").isNotNull(), "actor": F.col("_actor").isNotNull(), "genre": F.size("_genres") > 0, "rating": F.col("_rating").isNotNull()}
    active = sum((x.cast("int") for x in fields.values()), F.lit(0))
    alone = F.coalesce(*[F.when(x, F.lit(name)) for name, x in fields.items()])
    intent, keeps, title = F.lit(grammar.other_intent), F.lit(False), F.lit(None).cast("string")
    for i in reversed(grammar.intents):
        held = says(line, i.says)
        if i.holds:
            held = held | F.col(f"_{i.holds}").isNotNull()
        if i.searches:
            held = held | (active > 0)
        intent = F.when(held, F.when(active == 1, alone).otherwise(F.lit(i.name)) if i.searches else F.lit(i.name)).otherwise(intent)
        keeps = F.when(held, F.lit(i.keeps)).otherwise(keeps)
        title = F.when(held, F.col(f"_{i.holds}") if i.holds else F.lit(None).cast("string")).otherwise(title)
    rows = rows.withColumns({"intent": intent, "_keeps": keeps, "target_title": title})
    searched = F.col("intent").isin([i.name for i in grammar.intents if i.searches] + list(fields))
    told = {"director": F.col("_director"), "actor": F.col("_actor"), "year": F.col("_year"), "min_rating": F.col("_rating")}
    rows = rows.withColumns({name: F.when(F.col("_keeps"), x) for name, x in told.items()} | {"genres": F.when(searched, F.col("_genres")).otherwise(F.array().cast("array<string>"))})
    return rows.drop("_line", "_keeps", "_year", "_rating", "_genres", *[f"_{name}" for name in grammar.spans])
