"""Linking texts to names: exact phrases, aliases, fuzzy phrases and contained words.

No text meets a name unless they share a key: phrases of a text are equi-joined
with the names, similar phrases through shared segments, contained words through
the substrings of the (short) names.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotherm.functions.distributed import number_rows
from isotherm.functions.lookups import COUNTRY_OF_CITY, STATION_ALIASES, map_column
from isotherm.functions.questions import requested_year, search_terms
from isotherm.functions.text import has_any, normalize, shingles, words
from isotherm.session import materialize

# Words a place search ignores.
PLACE_STOP_WORDS = [
    "what", "is", "the", "temperature", "weather", "climate", "trend", "in", "at", "of",
    "for", "show", "tell", "me", "about", "could", "be", "reason", "why", "how", "today",
    "current",
]

# Words that ask for the lowest or the highest rows of a year.
LOW_WORDS = ["lowest", "coldest", "coolest", "least", "minimum", "min"]
HIGH_WORDS = ["highest", "hottest", "warmest", "most", "top", "maximum", "max"]


def dictionary(*columns: tuple[DataFrame, str, str]) -> DataFrame:
    """``kind, name, phrase, n_words`` of the distinct names, from (table, column, kind) triples.

    A written table: the optimizer knows its size in every join against it.
    """
    out = None
    for df, column, kind in columns:
        part = df.select(F.lit(kind).alias("kind"), F.col(column).alias("name")).distinct()
        out = part if out is None else out.unionByName(part)
    named = out.withColumn("phrase", normalize(F.col("name"))).where(F.length("phrase") >= 3)
    return materialize(named.distinct().withColumn("n_words", F.size(F.split("phrase", " "))))


def _sizes(names: DataFrame) -> list[int]:
    """The lengths in words that occur among the names: a handful."""
    return [r[0] for r in names.select("n_words").distinct().orderBy("n_words").collect()]


def _phrase_rows(
    texts: DataFrame, key: str, text: str, sizes: list[int], aliases: dict[str, str] | None = None
) -> DataFrame:
    """``key, phrase``: distinct phrases per text, with the full names of the aliases among them.

    The words become a column before they are cut into phrases, and the arrays are
    exploded with the outer variant: the filter the optimizer adds to an inner
    explode would compute them twice.
    """
    tokens = F.col("_words")
    phrases = shingles(tokens, sizes)
    if aliases:
        short = shingles(tokens, sorted({len(a.split()) for a in aliases}))
        known = F.filter(short, lambda p: p.isin(list(aliases)))
        phrases = F.array_union(phrases, F.transform(known, lambda p: map_column(aliases, p)))
    split = texts.select(key, words(F.col(text)).alias("_words"))
    return split.select(key, F.explode_outer(phrases).alias("phrase")).where("phrase IS NOT NULL")


def mentions(
    texts: DataFrame, key: str, text: str, names: DataFrame, aliases: dict[str, str] | None = None
) -> DataFrame:
    """``key, kind, name`` of every name that a text holds at word boundaries.

    With a written dictionary that is small this is one narrow stage: the phrases
    of a row are streamed through a broadcast hash join.
    """
    exploded = _phrase_rows(texts, key, text, _sizes(names), aliases)
    return exploded.join(names.select("kind", "name", "phrase"), "phrase").select(key, "kind", "name")


def sequence_ratio(a: str, b: str) -> Column:
    """Share of characters in matching blocks, for distinct candidate pairs only.

    The function is local, so it travels to the executors by value and they need
    not have this package installed.
    """

    @F.pandas_udf(T.DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def _edits(measure: str, threshold: float, length: Column) -> tuple[Column, Column, Column]:
    """Bounds for a phrase of ``length``: edits, shortest and longest similar name.

    The matching blocks of two strings are a common subsequence, so a ratio of at
    least t leaves at most (1 - t) * (sum of lengths) insertions and deletions, and
    the sum is bounded by the length ratio. For the edit distance it is
    (1 - t) * (longer length).
    """
    t = threshold
    if measure == "ratio":
        longest = F.floor(length * (2 - t) / t + 1e-9)
        return F.floor((1 - t) * (length + longest) + 1e-9), F.ceil(length * t / (2 - t) - 1e-9), longest
    longest = F.floor(length / t + 1e-9)
    return F.floor((1 - t) * longest + 1e-9), F.ceil(length * t - 1e-9), longest


def _segment_bounds(length: Column, pieces: Column, i: Column) -> tuple[Column, Column]:
    start = F.floor(i * length / pieces)
    return start, F.floor((i + 1) * length / pieces) - start


def _name_segments(names: DataFrame, threshold: float, measure: str) -> DataFrame:
    """``kind, name, name_phrase, n_words, len, i, seg``: what a phrase of ``len`` that is similar to the name holds as segment ``i``."""
    own = F.length("name_phrase")
    # Every phrase length a name of this length can be similar to.
    wide = F.ceil(own / threshold + own * (1 - threshold) * 2 / threshold) + 1
    lengths = names.select("kind", "name", F.col("phrase").alias("name_phrase"), "n_words").select(
        "*", F.explode(F.sequence(F.lit(1).cast("bigint"), wide)).alias("len")
    )
    edits, shortest, longest = _edits(measure, threshold, F.col("len"))
    spots = (
        lengths.where(own.between(shortest, longest))
        .select("*", edits.alias("edits"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("edits"))).alias("i"))
    )
    start, size = _segment_bounds(F.col("len"), F.col("edits") + 1, F.col("i"))
    low = F.greatest(start - F.col("edits"), F.lit(0))
    high = F.least(start + F.col("edits"), own - size)
    placed = spots.select("*", size.alias("size"), F.when(high >= low, F.sequence(low, high)).alias("at"))
    return placed.select("kind", "name", "name_phrase", "n_words", "len", "i", "size", F.explode("at").alias("at")).select(
        "kind", "name", "name_phrase", "n_words", "len", "i",
        F.substring("name_phrase", F.col("at") + 1, F.col("size")).alias("seg"),
    )


SLOTS = 1 << 20  # bytes of the map


def _slot(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(SLOTS)).cast("int")


def _length_slot(n_words: Column, length: Column) -> Column:
    return _slot(n_words.cast("bigint"), length.cast("bigint"))


def _segment_slot(n_words: Column, length: Column, i: Column, seg: Column) -> Column:
    return _slot(*[c.cast("bigint") for c in (n_words, length, i)], seg)


def _possible(windows: DataFrame, key: str, names: DataFrame | None, fuzzy: DataFrame, threshold: float, measure: str) -> DataFrame:
    """``key, phrase`` of the windows that may be one of ``names`` or similar to one of ``fuzzy``, some more than once: a written table.

    A map of SLOTS bytes, whatever the names are, marks the hashes of the names, of the lengths similar to them and of
    their segments. It is probed in the stage that cuts the texts, so what cannot match is never shuffled or written.
    No match is lost; names by the ten thousand fill the map, which then only lets more through.
    """
    segments = _name_segments(fuzzy, threshold, measure).select("n_words", "len", "i", "seg").distinct()
    of = [F.col(c) for c in ("n_words", "len", "i", "seg")]
    slots = F.array(_length_slot(*of[:2]), _segment_slot(*of))
    marks = segments.select(F.explode(slots).alias("slot"))
    if names is not None:
        marks = marks.unionByName(names.select(_slot(F.col("phrase")).alias("slot")))
    filled = bytearray(SLOTS)
    for slot in marks.agg(F.collect_set("slot")).first()[0]:  # at most SLOTS numbers
        filled[slot] = 1
    held = windows.sparkSession.createDataFrame([(filled,)], "slots binary").scalar()
    marked = lambda slot: F.substring(held, slot + 1, F.lit(1)) == F.lit(bytes([1]))

    length = F.length("phrase")
    edits, _, _ = _edits(measure, threshold, length)
    n_words = length - F.length(F.replace(F.col("phrase"), F.lit(" "))) + 1
    sized = windows.select(key, "phrase", n_words.alias("n_words"), length.alias("len"), (edits + 1).alias("pieces"))
    # Segment -1 is the whole phrase.
    whole = F.when(marked(_slot(F.col("phrase"))), F.array(F.lit(-1).cast("bigint"))) if names is not None else F.lit(None)
    parts = F.when(marked(_length_slot(F.col("n_words"), F.col("len"))), F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))
    cut = sized.select("*", F.explode_outer(F.coalesce(whole, parts)).alias("i")).where("i IS NOT NULL")
    start, size = _segment_bounds(F.col("len"), F.col("pieces"), F.col("i"))
    seg = F.substring(F.col("phrase"), (start + 1).cast("int"), size.cast("int"))
    near = marked(_segment_slot(F.col("n_words"), F.col("len"), F.col("i"), seg))
    return materialize(cut.where((F.col("i") < 0) | near).select(key, "phrase"), "windows")


def similar_pairs(
    phrases: DataFrame, names: DataFrame, threshold: float, measure: str = "ratio"
) -> DataFrame:
    """``phrase, n_words, kind, name, similarity`` of the pairs that reach ``threshold``.

    A phrase is cut into one segment more than edits are allowed, so a similar
    name holds one of them unchanged, shifted by at most that many places. Both
    sides emit (length, segment number, segment text) and are equi-joined, which
    loses no pair. ``phrases`` must be distinct (``phrase, n_words``).
    """
    length = F.length("phrase")
    edits, _, _ = _edits(measure, threshold, length)
    cut = phrases.select("phrase", "n_words", length.alias("len"), (edits + 1).alias("pieces")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("i")
    )
    start, size = _segment_bounds(F.col("len"), F.col("pieces"), F.col("i"))
    left = cut.select("phrase", "n_words", "len", "i", F.substring("phrase", start + 1, size).alias("seg"))
    right = _name_segments(names, threshold, measure).distinct()

    pairs = left.join(right, ["n_words", "len", "i", "seg"]).select(
        "phrase", "n_words", "kind", "name", "name_phrase"
    ).distinct()
    distance = F.levenshtein("phrase", "name_phrase")
    if measure == "ratio":
        near = pairs.where(distance <= (1 - threshold) * (F.length("phrase") + F.length("name_phrase")) + 1e-9)
        scored = near.withColumn("similarity", sequence_ratio("name_phrase", "phrase"))
    else:
        scored = pairs.withColumn("similarity", 1 - distance / F.greatest(F.length("phrase"), F.length("name_phrase")))
    return scored.where(F.col("similarity") >= threshold).select(
        "phrase", "n_words", "kind", "name", "similarity"
    )


def _similar_phrases(windows: DataFrame, fuzzy: DataFrame, threshold: float, measure: str) -> DataFrame:
    """``phrase, kind, name, similarity`` for the phrases among ``windows`` that are similar to a name.

    Equal phrases are compared once, however many texts hold them: they meet before they are shuffled.
    """
    distinct = windows.select("phrase").distinct().withColumn("n_words", F.size(F.split("phrase", " ")))
    return similar_pairs(distinct, fuzzy, threshold, measure).drop("n_words")


def fuzzy_mentions(
    texts: DataFrame,
    key: str,
    text: str,
    names: DataFrame,
    threshold: float = 0.88,
    measure: str = "ratio",
    exact_single: bool = True,
    aliases: dict[str, str] | None = None,
) -> DataFrame:
    """``key, kind, name, similarity``: a window of the text is similar to the name.

    Windows have as many words as the name; with ``exact_single`` one-word names must match exactly. The
    texts are cut once; the windows that may be similar to some name are a written table.
    """
    fuzzy = names.where("n_words > 1") if exact_single else names
    sizes = _sizes(fuzzy)
    if not sizes:
        none = texts.select(key).limit(0)
        return none.select(
            key, *[F.lit(None).cast(t).alias(c) for c, t in
                   (("kind", "string"), ("name", "string"), ("similarity", "double"))]
        )
    windows = _phrase_rows(texts, key, text, sizes, aliases)
    few = _possible(windows, key, None, fuzzy, threshold, measure)
    hits = few.join(_similar_phrases(few, fuzzy, threshold, measure), "phrase")
    return hits.groupBy(key, "kind", "name").agg(F.max("similarity").alias("similarity"))


def linked_names(
    texts: DataFrame,
    key: str,
    text: str,
    names: DataFrame,
    threshold: float = 0.88,
    measure: str = "ratio",
    exact_single: bool = True,
    aliases: dict[str, str] | None = None,
) -> DataFrame:
    """``key, kind, name`` by exact phrase, alias or similarity.

    The texts are cut once. The windows that may be a name or similar to one are a written table; the names' own
    phrases and the phrases similar to one are put together and joined with it.
    """
    sizes = _sizes(names)
    windows = _phrase_rows(texts, key, text, sizes, aliases)
    fuzzy = names.where("n_words > 1") if exact_single else names
    exact = names.select("phrase", "kind", "name")
    several = F.col("phrase").contains(" ")
    few = _possible(windows, key, names, fuzzy, threshold, measure)
    near = _similar_phrases(few.where(several) if exact_single else few, fuzzy, threshold, measure).drop("similarity")
    known = exact.unionByName(near).distinct()
    return few.join(known, "phrase").select(key, "kind", "name").distinct()


def names_place(
    texts: DataFrame, key: str, text: str, names: DataFrame, measure: str = "ratio"
) -> DataFrame:
    """``key, names_place``: does the text name any known place, exactly or nearly?

    Only keys are joined; the texts themselves are not shuffled.
    """
    hit = linked_names(texts, key, text, names, measure=measure).select(key).distinct().withColumn("_hit", F.lit(True))
    return texts.select(key).join(hit, key, "left").select(key, F.coalesce("_hit", F.lit(False)).alias("names_place"))


def substrings(names: DataFrame, name: str, shortest: int = 1) -> DataFrame:
    """``name, part``: every distinct substring of the lower-cased name.

    Grows with the square of a name's length, so it is meant for names, not texts.
    """
    low = F.lower(F.col(name))
    n = F.length(low)
    starts = names.select(name, low.alias("_low"), n.alias("_n")).where(F.col("_n") >= shortest).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("_n") - shortest + 1)).alias("_s")
    )
    return starts.select(
        name, "_low", "_s", F.explode(F.sequence(F.lit(shortest), F.col("_n") - F.col("_s") + 1)).alias("_l")
    ).select(name, F.substring("_low", F.col("_s"), F.col("_l")).alias("part")).distinct()


def pick_rows(
    texts: DataFrame, key: str, text: str, rows: DataFrame, names: DataFrame, order: list[Column],
    max_rows: int = 20, measure: str = "ratio", part: str | None = None, keys: DataFrame | None = None,
) -> DataFrame:
    """The rows of a country table each question is about, at most ``max_rows`` in table order.

    First hit wins: countries named (phase 1), regions named (2), a search term
    inside a country or region name (3), else the first rows of the table (4).
    The phase of a question is settled on names alone, before any row is joined.
    With ``part``, a column of both sides, a question sees only the rows of its part of the table. ``keys`` is
    ``texts`` without the text, where that is a written table.
    """
    parts = [part] if part else []
    keys = texts.select(key, *parts) if keys is None else keys
    places = rows.select(*parts, F.lit("Country").alias("kind"), F.col("Country").alias("name")).unionByName(
        rows.select(*parts, F.lit("Region").alias("kind"), F.col("Region").alias("name"))
    ).distinct()
    present = names.join(places.select("kind", "name").distinct(), ["kind", "name"], "left_semi")
    linked = linked_names(texts, key, text, present, measure=measure).withColumn(
        "phase", F.when(F.col("kind") == "Country", 1).otherwise(2)
    )
    terms = texts.select(key, F.explode_outer(search_terms(F.col(text))).alias("part_")).where("part_ IS NOT NULL")
    inside_names = substrings(present, "name", 3).join(present.select("name", "kind"), "name").withColumnRenamed("part", "part_")
    inside = terms.join(materialize(inside_names, "parts"), "part_").select(key, "kind", "name", F.lit(3).alias("phase"))
    named = linked.unionByName(inside).distinct()
    if part:
        named = named.join(keys, key).join(places, [part, "kind", "name"], "left_semi")
    found = materialize(named, "found")
    first = found.groupBy(key).agg(F.min("phase").alias("phase"))
    chosen = found.join(first, [key, "phase"], "left_semi")

    # No question takes more than max_rows rows of one region.
    in_region = W.partitionBy(*parts, "Region").orderBy(*order)
    leading = rows.withColumn("_n", F.row_number().over(in_region)).where(F.col("_n") <= max_rows).drop("_n")
    of = lambda kind: chosen.where(F.col("kind") == kind).select(key, *parts, "phase", F.col("name").alias(kind))
    hits = rows.join(of("Country"), [*parts, "Country"]).unionByName(leading.join(of("Region"), [*parts, "Region"]))
    hits = hits.repartition(key).distinct()  # the numbering takes the rows as they are dealt here
    numbered = hits.withColumn("row_no", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    best = numbered.where(F.col("row_no") <= max_rows)

    rest = _first_rows(keys, first, key, rows, order, max_rows, part).withColumn("phase", F.lit(4))
    columns = [key, "phase", "row_no", *rows.columns]
    return best.select(*columns).unionByName(rest.select(*columns))


def yearly_rows(
    yearly: DataFrame, questions: DataFrame, key: str, text: str, names: DataFrame, max_rows: int = 20, measure: str = "ratio"
) -> DataFrame:
    """``key, row_no`` and the yearly rows each question is about.

    Rows of the year it asks for (all years if it asks for none, or for one without rows); hottest or
    coldest first if it says so, else the rows of the places it names. The rows of one year are a part of the
    table, all rows together are one more.
    """
    columns = yearly.columns
    parts = yearly.withColumn("_part", F.col("Year")).unionByName(yearly.withColumn("_part", F.lit(-1)))
    q = F.lower(F.col(text))
    year = requested_year(F.col(text), yearly.select(F.max("Year")).scalar())
    asked = questions.select(key, text, year.alias("Year"), has_any(q, LOW_WORDS).alias("_low"), has_any(q, LOW_WORDS + HIGH_WORDS).alias("_ranked"))
    years = yearly.select("Year", F.col("Year").alias("_found")).distinct()
    asked = asked.join(years, "Year", "left").withColumn("_part", F.coalesce("_found", F.lit(-1))).drop("_found", "Year")

    ranked = None
    for low in (True, False):
        way = F.asc("AvgTemperature") if low else F.desc("AvgTemperature")
        place = F.row_number().over(W.partitionBy("_part").orderBy(way, "Country", "Region", "Year"))
        side = parts.where("AvgTemperature IS NOT NULL").withColumn("row_no", place).where(F.col("row_no") <= max_rows)
        side = side.withColumn("_low", F.lit(low))
        ranked = side if ranked is None else ranked.unionByName(side)
    other = "NOT coalesce(_ranked, false)"
    told = materialize(asked.drop(text), "asked")
    top = told.where("_ranked").select(key, "_part", "_low").join(ranked, ["_part", "_low"]).select(key, "row_no", *columns)
    others, keys = asked.where(other).select(key, text, "_part"), told.where(other).select(key, "_part")
    order = [F.asc("Country"), F.asc("Year"), F.asc("Region")]
    named = pick_rows(others, key, text, parts, names, order, max_rows, measure, part="_part", keys=keys)
    return top.unionByName(named.select(key, "row_no", *columns))


def matched_or_first(
    texts: DataFrame, key: str, text: str, rows: DataFrame, column: str, names: DataFrame, order: list[Column],
    n: int, threshold: float = 0.82, measure: str = "ratio",
) -> DataFrame:
    """All rows whose name a text holds, exactly or nearly; the first ``n`` rows for a text without any."""
    present = names.where(F.col("kind") == column).join(rows.select(F.col(column).alias("name")), "name", "left_semi")
    linked = materialize(linked_names(texts, key, text, present, threshold, measure, exact_single=False), "linked")
    hits = linked.select(key, F.col("name").alias(column)).join(rows, column).withColumn("matched", F.lit(True))
    rest = _first_rows(texts, linked.select(key).distinct(), key, rows, order, n).withColumn("matched", F.lit(False))
    columns = [key, "matched", *rows.columns]
    return hits.select(*columns).unionByName(rest.select(*columns))


def _first_rows(
    texts: DataFrame, served: DataFrame, key: str, rows: DataFrame, order: list[Column], n: int, part: str | None = None
) -> DataFrame:
    """The first ``n`` rows of a table, or of each text's part of it, numbered, for every text that is not ``served``.

    They travel as one short array per part.
    """
    missed = texts.select(key, *([part] if part else [])).join(served.select(key), key, "left_anti")
    if part is None:
        head = rows.orderBy(*order).limit(n).withColumn("row_no", F.row_number().over(W.orderBy(*order)))
        listed = head.agg(F.array_sort(F.collect_list(F.struct("row_no", *rows.columns))))
        return missed.withColumn("_h", F.explode(listed.scalar())).select(key, "_h.*")
    head = rows.withColumn("row_no", F.row_number().over(W.partitionBy(part).orderBy(*order))).where(F.col("row_no") <= n)
    return missed.join(head, part)


def keyword_rows(
    texts: DataFrame, key: str, text: str, rows: DataFrame, column: str, order: list[Column], n: int = 20,
    fallback: int = 10,
) -> DataFrame:
    """Rows scored by how many words of the text their name contains, cities standing for countries.

    The best ``n`` per text, or the first ``fallback`` rows of the table if none scores.
    """
    split = texts.select(key, words(F.col(text)).alias("_all")).withColumn(
        "_kept", F.filter("_all", lambda w: ~w.isin(PLACE_STOP_WORDS))
    )
    used = split.select(key, F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.col("_all")).alias("_used"))
    cities = F.transform("_used", lambda w: map_column(COUNTRY_OF_CITY, w))
    # Texts with the same words are scored once: a word of one letter is part of nearly every name. Their words are
    # told by a hash, so that what is grouped and sorted is short however long the texts are.
    listed = F.array_sort(F.filter(F.concat("_used", cities), lambda w: w.isNotNull()))
    bags = used.select(key, F.coalesce(F.array_join(listed, "|"), F.lit("")).alias("_bag"))
    bags = bags.select(key, F.unhex(F.sha2("_bag", 256)).alias("_id"), "_bag")
    # A word counts as often as the text has it.
    keywords = bags.select("_id", "_bag").dropDuplicates(["_id"]).select("_id", F.explode(F.split("_bag", r"\|")).alias("part"))
    parts = materialize(substrings(rows.select(column).distinct(), column), "parts")
    scores = keywords.join(parts, "part").groupBy("_id", column).agg(F.count("*").alias("score"))
    # Rows are named by their place in the table until the best are known.
    placed = number_rows(rows, *order, name="_at")
    by_score = W.partitionBy("_id").orderBy(F.desc("score"), "_at")
    best = (
        scores.join(placed.select(column, "_at"), column)
        .withColumn("row_no", F.row_number().over(by_score))
        .where(F.col("row_no") <= n)
    )
    scored = materialize(best.select("_id", "score", "row_no", "_at"), "scored")
    told = materialize(bags.select(key, "_id"), "told")
    best = told.join(scored, "_id").join(placed, "_at")
    served = told.join(scored.select("_id"), "_id", "left_semi")
    rest = _first_rows(texts, served, key, rows, order, fallback).withColumn("score", F.lit(0).cast("bigint"))
    columns = [key, "score", "row_no", *rows.columns]
    return best.select(*columns).unionByName(rest.select(*columns))


def match_countries(places: DataFrame, place: str, countries: DataFrame, n: int = 20) -> DataFrame:
    """``place, Country, score``: 100 for the same name, 50 if contained, 10 per contained word.

    Works on the distinct place names; a country without score is no match.
    """
    known = countries.select("Country").distinct()
    asked = places.select(F.col(place).alias("place")).where("place IS NOT NULL").distinct()
    plain = normalize(F.col("place"))
    asked = asked.withColumn("wanted", F.coalesce(map_column(STATION_ALIASES, plain), plain)).where("wanted <> ''")
    parts = materialize(substrings(known, "Country"), "parts")
    whole = asked.join(parts, asked["wanted"] == parts["part"]).select(
        "place", "Country", F.when(F.col("wanted") == F.lower("Country"), 100).otherwise(50).alias("tier"),
        F.lit(0).alias("words"),
    )
    tokens = asked.select("place", F.explode(F.split("wanted", " ")).alias("part"))
    partial = tokens.join(parts, "part").select(
        "place", "Country", F.lit(None).cast("int").alias("tier"), F.lit(10).alias("words")
    )
    scores = whole.unionByName(partial).groupBy("place", "Country").agg(
        F.coalesce(F.max("tier").cast("bigint"), F.sum("words")).alias("score")
    )
    by_score = W.partitionBy("place").orderBy(F.desc("score"), "Country")
    return scores.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= n)
