"""Turns of conversations: recent history and the state carried between answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isotherm.functions.distributed import carry_all
from isotherm.functions.questions import early_route, followup_route, keyword_route, source_of, with_routes
from isotherm.operators.linking import linked_names
from isotherm.session import materialize


def recent_turns(turns: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` turns per conversation, trimmed per task before the shuffle."""
    latest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= n).drop("_n").withColumns(
        {"role": F.coalesce("role", F.lit("user")), "text": F.coalesce("text", F.lit(""))}
    )


def history_text(turns: DataFrame, n: int = 8) -> DataFrame:
    """The last ``n`` turns as ``ROLE: text`` lines, one row per conversation."""
    content = F.regexp_replace("text", r"^\s+|\s+$", "")
    line = F.when(content != "", F.concat(F.upper("role"), F.lit(": "), content))
    rows = recent_turns(turns, n).withColumn("line", line)
    # At most n lines per conversation reach this aggregation.
    listed = F.array_sort(F.collect_list(F.struct("turn", "line")))
    joined = F.array_join(F.transform(listed, lambda x: x["line"]), "\n")
    return rows.groupBy("conv_id").agg(
        F.coalesce(F.nullif(joined, F.lit("")), F.lit("No previous conversation.")).alias("history")
    )


def routed_texts(
    texts: DataFrame, key: str, text: str, names: DataFrame, as_of: Column, measure: str = "ratio"
) -> DataFrame:
    """``place, fixed, follow, keyword`` of each text, with all other columns of ``texts`` but the text itself.

    A place counts as named exactly or nearly. It is looked for only in texts whose keywords leave that open,
    and the texts are left behind before anything is shuffled.
    """
    kept = [c for c in texts.columns if c != text]
    routed = with_routes(texts, text, as_of).select(*kept, "place", "fixed", "follow", "early", "late")
    # A filter would be pushed below the text's own expression and repeat it.
    open_ones = texts.select(key, F.when(early_route(F.lower(F.col(text))).isNull(), F.col(text)).alias(text))
    named = linked_names(open_ones, key, text, names, measure=measure).select(key).distinct().withColumn("_named", F.lit(True))
    joined = routed.join(named, key, "left")
    keyword = keyword_route(F.col("early"), F.coalesce("_named", F.lit(False)), F.col("late"))
    return joined.withColumn("keyword", keyword).drop("early", "late", "_named")


def route_turns(routed: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """``conv_id, turn, place, followup, last_source, route, led``; ``last_source`` is the state a turn starts from.

    ``routed`` needs ``conv_id, turn, place, fixed, follow, keyword``. A follow-up takes over the
    source of the turn before it, which may itself be taken over. That chain ends
    at the last turn that is no follow-up, so a carry finds it. Follow-ups with no
    such turn before them take the state the conversation came with (``seeds``: ``conv_id, seed``), or
    hang on the first of them that keywords can place. ``last_source`` of a mixed answer reads
    ``hybrid`` for the whole chain of follow-ups; their route is climate. ``led`` marks follow-ups before any such
    turn: all that depends on the state the conversation came with.
    """
    follow = F.col("fixed").isNull() & F.col("follow")
    known = routed.select("conv_id", "turn", "place", "fixed", follow.alias("follow"), "keyword")
    seed = F.lit(None).cast("string")
    if seeds is not None:
        known, seed = known.join(seeds, "conv_id", "left"), F.col("seed")
    known = materialize(known, "turns")
    # Where no anchor comes before, all follow-ups before are led ones, so both values are carried at once.
    led = carry_all(known, "conv_id", "turn", {
        "_anchor": (F.when(~F.col("follow"), source_of(F.coalesce("fixed", "keyword"))), "last"),
        "_lead": (F.when(F.col("follow"), source_of(F.col("keyword"))), "first"),
    })
    state = F.coalesce(F.col("_anchor"), seed, F.col("_lead"))
    own = F.coalesce("fixed", "keyword")
    taken = F.coalesce(followup_route(state), "keyword")
    return led.select(
        "conv_id",
        "turn",
        "place",
        F.col("follow").alias("followup"),
        state.alias("last_source"),
        F.when(F.col("follow"), taken).otherwise(own).alias("route"),
        (F.col("follow") & F.col("_anchor").isNull()).alias("led"),
    )


def conversation_parts(routes: DataFrame) -> DataFrame:
    """One row per conversation of ``route_turns`` without seeds: what these turns make of any state they may start from.

    ``anchored``: some turn settles its source by itself; ``led``: follow-ups come before; ``source, place``: what is
    left if the conversation starts here; ``tail``: the place that turns after the leading follow-ups leave.
    """
    latest = lambda value: F.max_by(value, F.when(value.isNotNull(), F.col("turn")))
    source, place = source_of(F.col("route")), place_left(F.col("route"), F.col("place"))
    return routes.groupBy("conv_id").agg(
        F.bool_or(~F.col("followup") & source.isNotNull()).alias("anchored"), F.bool_or("led").alias("led"),
        latest(source).alias("source"), latest(place).alias("place"), latest(F.when(~F.col("led"), place)).alias("tail"),
    )


def place_left(route: Column, place: Column) -> Column:
    """The place a turn leaves behind: an empty text takes it away, null leaves it as it was."""
    return (
        F.when(route == "climate", "")
        .when(route.isin("hybrid", "historical_weather"), F.coalesce(place, F.lit("")))
        .when(route == "weather", place)
    )


def carried_answers(routed: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """``route_turns`` with the exact state before each turn: ``last_source`` of the last answer in scope, ``last_place``.

    ``seeds`` (``conv_id, seed, seed_place``) is the state the conversations came with.
    """
    turns = route_turns(routed, None if seeds is None else seeds.select("conv_id", "seed"))
    both = carry_all(turns, "conv_id", "turn", {
        "_source": (source_of(F.col("route")), "last"), "_place": (place_left(F.col("route"), F.col("place")), "last"),
    })
    if seeds is None:
        both = both.withColumns({"seed": F.lit(None).cast("string"), "seed_place": F.lit(None).cast("string")})
    else:
        both = both.join(seeds, "conv_id", "left")
    return both.select(
        "conv_id", "turn", "place", "followup", F.coalesce("_source", "seed").alias("last_source"),
        F.nullif(F.coalesce("_place", "seed_place"), F.lit("")).alias("last_place"), "route",
    )
