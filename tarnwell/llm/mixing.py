"""Mixing sources to target weights: iterative proportional fitting, then sampling with calibrated probabilities.

1. Documents are reduced to cells (source, language, topic) with their tokens.
2. Raking: the cells' weights are scaled so that the sums by source, by language and by topic meet their targets in
   turn, until all three hold. No cell may weigh more than its documents can give to a sample of the budget's size: a
   margin that is short grows by its other cells, so the caps are part of the fit and not a cut after it. Windows over the
   cell table do it; a cell table is small beside its documents, and no step needs it in one place.
3. Calibration: a document of a cell stays with probability budget * weight / tokens, which is at most 1.
4. A hash of the row decides, so the same rows stay when the job runs again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: A dimension's targets: shares by value, or an exponent that flattens the tokens' own shares.
Target = Mapping[str, float] | float
TARGETS: dict[str, Target] = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Share of all tokens that the sample is to have.
BUDGET = 0.6
TOLERANCE, MAX_ROUNDS, ROUNDS_AT_ONCE = 1e-5, 36, 3
SEED = 11
#: Up to so many cells are sent to every executor; more are joined by their keys, with the rows of a cell over SALTS tasks.
BROADCAST_CELLS, SALTS = 50_000, 64
NONE = "(none)"
DIMENSIONS = ("source", "lang", "topic")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """What a text is about, as far as its marks tell: rules in order."""
    text = F.coalesce(text, F.lit(""))
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (
        F.when(F.contains(text, F.lit("icense")), "legal")
        .when(text.rlike(r"[\w.]@\w"), "contact")
        .when(bars * 50 > F.length(text), "tabular")
        .when(F.contains(text, F.lit("!!")), "loud")
        .when(text.rlike(r"\d\.\d+\.\d|://"), "technical")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> Column:
    """A struct of key columns, tokens and the row's draw from [0, 1)."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(SEED)), 11).cast("double") / F.lit(float(1 << 53))
    return F.struct(named("source"), named("lang"), topic_of(F.col("text")).alias("topic"), tokens_of(F.col("text")).alias("tokens"), draw.alias("draw"))


def _targets(cells: DataFrame, dimension: str, target: Target) -> DataFrame:
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens"))
    if isinstance(target, Mapping):
        share = F.lit(0.0)
        for value, part in target.items():
            share = F.when(F.col(dimension) == value, F.lit(float(part))).otherwise(share)
    else:
        share = F.pow(F.col("tokens").cast("double"), F.lit(float(target)))
    wanted = sums.select(dimension, F.when(F.col("tokens") > 0, share).otherwise(0.0).alias("share"))
    total = wanted.agg(F.sum("share")).first()[0] or 1.0
    return wanted.select(dimension, (F.col("share") / total).alias(f"want_{dimension}"))


def rake(cells: DataFrame, targets: Mapping[str, Target] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with weight: sums to 1, its margins meet the targets, and no weight is more than
    the cell's tokens over the budget's (a share of all tokens); and gap: how far the margins of a cell are from their targets at most.

    A value that no target names gets no weight. Targets that the cells cannot meet together, or not under the caps, are met
    as nearly as the rounds bring them, until no weight moves by TOLERANCE or MAX_ROUNDS are over; weights may then sum to less than 1,
    and gap tells what is missing. Ties need no order.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    rows = cells.withColumns({"weight": F.col("tokens") / F.lit(float(max(total, 1))), "_cap": F.col("tokens") / F.lit(max(budget * total, 1e-9))})
    for d in targets:
        rows = rows.join(_targets(cells, d, targets[d]), d)
    if cells.count() <= BROADCAST_CELLS:
        rows = rows.coalesce(1)  # so few that every window finds them in one task, without a shuffle
    rows = cut(rows)
    free = F.col("weight") < F.col("_cap") * (1 - 1e-12)
    for _ in range(0, MAX_ROUNDS, ROUNDS_AT_ONCE):
        rows = rows.withColumn("_was", F.col("weight"))
        for _ in range(ROUNDS_AT_ONCE):
            for d in targets:
                among, want = Window.partitionBy(d), F.col(f"want_{d}")
                held, able = F.sum(F.when(~free, F.col("weight"))).over(among), F.sum(F.when(free, F.col("weight"))).over(among)
                held, able = F.coalesce(held, F.lit(0.0)), F.coalesce(able, F.lit(0.0))
                # too much: all shrink; too little: those below their caps grow
                factor = F.when(held + able >= want, F.when(held + able > 0, want / (held + able)).otherwise(0.0)).otherwise(F.when(free & (able > 0), (want - held) / able).otherwise(1.0))
                rows = rows.withColumn("weight", F.least("_cap", F.col("weight") * factor))
        rows = cut(rows)
        if (rows.agg(F.max(F.abs(F.col("weight") - F.col("_was")))).first()[0] or 0.0) < TOLERANCE:
            break
    short = [F.abs(F.sum("weight").over(Window.partitionBy(d)) - F.col(f"want_{d}")) for d in targets]
    return rows.withColumn("gap", F.greatest(*short, F.lit(0.0))).drop("_cap", "_was", *[f"want_{d}" for d in targets])


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """Raked ``cells`` with probability, so that the expected tokens of each are its weight's share of ``budget`` tokens."""
    chance = F.least(F.lit(1.0), F.lit(float(budget)) * F.col("weight") / F.col("tokens"))
    return cells.withColumn("probability", F.when(F.col("tokens") > 0, chance).otherwise(0.0))


def mix(docs: DataFrame, targets: Mapping[str, Target] = TARGETS, budget: float = BUDGET, carry: Sequence[str] | None = None) -> DataFrame:
    """_row, source, lang, topic, tokens, weight and gap (of the cell), probability and kept.

    _row holds all columns of ``docs``, or those named by ``carry``, whose rows are then kept between the two passes, so that
    texts are read once. Null sources and languages are the value "(none)". Null and empty texts have no tokens; a cell
    without tokens has probability 0. Very long texts count whole. Repeated rows share their fate. An empty table gives an
    empty result.
    """
    rows = docs.select(F.struct(*(docs.columns if carry is None else carry)).alias("_row"), described(docs).alias("_d"))
    if carry is not None:
        rows = cut(rows)
    keys = [F.col(f"_d.{d}").alias(d) for d in DIMENSIONS]
    cells = cut(rows.select("_d").groupBy(*keys).agg(F.sum("_d.tokens").alias("tokens")))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    chances = cut(calibrate(rake(cells, targets, budget), budget * total).select(*DIMENSIONS, "weight", "probability", "gap"))
    found = rows.select("_row", *keys, F.col("_d.tokens").alias("tokens"), F.col("_d.draw").alias("_draw"))
    if chances.count() <= BROADCAST_CELLS:
        found = found.join(F.broadcast(chances), list(DIMENSIONS))
    else:
        found = found.withColumn("_salt", F.floor(F.col("_draw") * 1e9).cast("long") % SALTS)
        salted = chances.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        found = found.join(salted.hint("merge"), [*DIMENSIONS, "_salt"])
    return found.select("_row", *DIMENSIONS, "tokens", "weight", "gap", "probability", (F.col("_draw") < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, targets: Mapping[str, Target] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """The sampled rows of ``docs``, all columns."""
    return mix(docs, targets, budget).where("kept").select("_row.*")
