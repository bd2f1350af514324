"""Text normalisation, dates and places in text, as native column expressions.

``(?U)`` gives ``\\b``, ``\\s`` and ``\\w`` their Unicode meaning, so that a keyword does
not end inside an accented word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.functions.lookups import MONTHS, PLACE_ALIASES, map_column


def _shorter_forms(names) -> str:
    """A pattern for the names in which one that continues another is its optional rest."""
    stems = [n for n in names if not any(n != m and n.startswith(m) for m in names)]
    rest = lambda n: "|".join(m[len(n):] for m in names if m != n and m.startswith(n))
    return "|".join(n + (f"(?:{rest(n)})?" if rest(n) else "") for n in stems)


MONTH_NAMES = _shorter_forms(list(MONTHS))  # the longer form is tried first
# Fixed value: a year.
YEAR = r"(?U)\b(19[0-9]{2}|20[0-9]{2})\b"

# Words that end a place phrase, and words that are no place.
PLACE_END = "today|now|with|against|and|based|using|from"
NOT_A_PLACE = ["today", "now", "current", "live", "the", "a", "an", "what", "was"]


def squeeze(c: Column) -> Column:
    """Trim and turn runs of white space into one space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize(c: Column) -> Column:
    """Lower case, anything but letters and digits to one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    """Words of the normalised text."""
    return F.filter(F.split(normalize(c), " "), lambda w: w != "")


def shingles(tokens: Column, sizes) -> Column:
    """Distinct phrases of ``sizes`` consecutive words; the whole text is used.

    ``tokens`` must be a column of the table, not an expression: the phrases read
    it once per word.
    """

    def of_size(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1)))
        phrases = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
        return F.coalesce(phrases, F.array().cast("array<string>"))

    parts = [tokens if n == 1 else of_size(n) for n in sizes]
    return F.array_distinct(F.concat(*parts) if len(parts) > 1 else parts[0])


def any_of(keywords) -> str:
    """A pattern that finds any of the keywords as substring, branching letter by letter.

    A plain alternation tries every keyword at every place of the text; here each
    place is left after its first letter. A keyword that starts with another one
    adds nothing and is cut off.
    """
    tails: dict[str, set[str]] = {}
    for word in keywords:
        tails.setdefault(word[0], set()).add(word[1:])
    branches = [first + ("" if "" in rest else any_of(sorted(rest))) for first, rest in sorted(tails.items())]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def has_any(text: Column, keywords: list[str], whole_words: bool = False) -> Column:
    """Does the lower-cased text hold one of the keywords, as substring or as whole words?"""
    if whole_words:
        return text.rlike(rf"(?U)\b(?:{'|'.join(k.strip() for k in keywords)})\b")
    return text.rlike(any_of(keywords))


def _past_day(year: Column, month: Column, day: Column, as_of: Column) -> Column:
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(~year.isin("", "0000") & (iso.try_cast("date") < as_of), iso)


def _past_month(year: Column, month: Column, as_of: Column) -> Column:
    iso = F.concat_ws("-", year, month)
    first = F.concat(iso, F.lit("-01")).try_cast("date")
    return F.when(~year.isin("", "0000") & (first < as_of), iso)


# Date layouts in order, with the groups of year, month and day.
DATE_LAYOUTS = [
    (rf"({MONTH_NAMES})\s+([0-9]{{1,2}})[,\s]+([0-9]{{4}})", 3, 1, 2),
    (rf"([0-9]{{1,2}})(?:st|nd|rd|th)?\s+({MONTH_NAMES})\s+([0-9]{{4}})", 3, 2, 1),
    (r"([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})", 1, 2, 3),
    (r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})", 3, 2, 1),
    (rf"({MONTH_NAMES})\s+([0-9]{{4}})", 2, 1, None),
    (rf"([0-9]{{4}})\s+({MONTH_NAMES})", 1, 2, None),
]


def with_date(df: DataFrame, text: str, as_of: Column, name: str = "date") -> DataFrame:
    """Add ``YYYY-MM-DD``, ``YYYY-MM`` or ``YYYY`` of the first valid past date in the text.

    Layouts in order: month day year, day month year, year-month-day,
    day-month-year, month year, year month, year. Every layout scans the text
    once; its parts are read from the short match. Texts without four digits in a
    row are not scanned at all, those without a month or a sign only for the layouts without.
    """
    q = F.lower(F.col(text))
    dated = df.withColumn("_q", F.when(q.rlike("[0-9]{4}"), q)).withColumns({
        "_worded": F.when(F.col("_q").rlike(MONTH_NAMES), F.col("_q")),
        "_signed": F.when(F.col("_q").contains("/") | F.col("_q").contains("-"), F.col("_q")),
    })
    # No match is an empty text; as null, nothing more is looked for in it.
    found = {f"_l{i}": F.nullif(F.regexp_extract("_worded" if MONTH_NAMES in p else "_signed", p, 0), F.lit("")) for i, (p, *_) in enumerate(DATE_LAYOUTS)}
    found["_in"] = F.regexp_extract("_q", r"(?U)(?:in|during|for|of|year)\s+((?:19|20)[0-9]{2})\b", 1)
    found["_bare"] = F.regexp_extract("_q", YEAR, 1)
    dates = []
    parts = {}
    for i, (pattern, *groups) in enumerate(DATE_LAYOUTS):
        for part, group in zip("ymd", groups):
            if group is not None:
                value = F.regexp_extract(f"_l{i}", pattern, group)
                worded = part == "m" and MONTH_NAMES in pattern
                parts[f"_{part}{i}"] = map_column(MONTHS, value) if worded else value
        year, month = F.col(f"_y{i}"), F.col(f"_m{i}")
        dates.append(_past_day(year, month, F.col(f"_d{i}"), as_of) if groups[2] else _past_month(year, month, as_of))
    parts["_year"] = F.when(F.col("_in") != "", F.col("_in")).otherwise(F.col("_bare"))
    dates.append(F.when(F.col("_year").try_cast("int") <= F.year(as_of), F.col("_year")))
    read = dated.withColumns(found).withColumns(parts)
    return read.select(*df.columns, F.coalesce(*dates).alias(name))


def with_place(df: DataFrame, text: str, name: str = "place") -> DataFrame:
    """Add the place named after in / at / for / a weather word, with dates taken out first.

    What is taken out are whole words, so a text without any of the words before a place has none afterwards either.
    """
    weather = "weather|temperature|temp|forecast|condition|conditions"
    led = F.when(F.col(text).rlike(rf"(?iU)\b(?:in|at|for|{weather})\s"), F.col(text))
    t = F.regexp_replace(led, rf"(?iU)\b({MONTH_NAMES})\b", "")
    t = F.regexp_replace(t, r"(?U)\b(19|20)[0-9]{2}\b", "")
    t = F.regexp_replace(t, r"(?U)\b[0-9]{1,2}(st|nd|rd|th)?\b", "")
    t = squeeze(F.regexp_replace(t, r"(?iU)\bon\b", ""))
    # A place phrase and the words before it.
    phrase = rf"([A-Za-z][A-Za-z\s]{{1,40}}?)(?:\s+(?:{PLACE_END})|\?|$)"
    patterns = [
        rf"(?iU)\bin\s+{phrase}",
        rf"(?iU)\bat\s+{phrase}",
        rf"(?iU)\bfor\s+{phrase}",
        rf"(?iU)\b(?:{weather})\s+(?:in\s+|for\s+|at\s+|of\s+)?{phrase}",
    ]
    found = df.withColumn("_clean", t).withColumn(name, F.lit(None).cast("string"))
    for p in patterns:  # each only where those before it found nothing
        found = found.withColumn("_p", F.when(F.col(name).isNull(), squeeze(F.regexp_extract("_clean", p, 1))))
        kept = F.when((F.length("_p") >= 2) & ~F.lower("_p").isin(NOT_A_PLACE), F.col("_p"))
        found = found.withColumn(name, F.coalesce(name, kept))
    return found.select(*df.columns, name)


def parse_texts(df: DataFrame, text: str, as_of: Column) -> DataFrame:
    """Add ``q`` (lower case), ``place`` and ``date``, from which the classifiers read."""
    return with_date(with_place(df.withColumn("q", F.lower(F.col(text))), text), "q", as_of)


def place_name(c: Column) -> Column:
    """Short place names spelt out, everything else in title case."""
    t = F.trim(c)
    return F.coalesce(map_column(PLACE_ALIASES, F.lower(t)), F.initcap(t), F.lit(""))


def period_bounds(period: Column, as_of: Column) -> Column:
    """Struct ``mode, start_date, end_date, label`` of a day, month or year text.

    The end is not after ``as_of``; all null for another format.
    """
    day = period.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    month = period.rlike(r"^[0-9]{4}-[0-9]{2}$")
    year = period.rlike(r"^[0-9]{4}$")
    first = (
        F.when(day, period)
        .when(month, F.concat(period, F.lit("-01")))
        .when(year, F.concat(period, F.lit("-01-01")))
        .try_cast("date")
    )
    last = (
        F.when(day, first)
        .when(month, F.least(F.last_day(first), as_of))
        .when(year, F.least(F.last_day(F.add_months(first, 11)), as_of))
    )
    mode = F.when(day, "day").when(month, "month").when(year, "year")
    known = first.isNotNull()
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    return F.struct(
        F.when(known, mode).alias("mode"),
        iso(first).alias("start_date"),
        F.when(known, iso(last)).alias("end_date"),
        F.when(known & month, F.date_format(first, "MMMM yyyy")).when(known, period).alias("label"),
    )
