"""Mixing documents to target weights by iterative proportional fitting. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.plans.scale import checkpointed, is_small

#: Cycles at most, each raking every dimension once, and the deviation from a target share that ends them.
CYCLES = 25
TOLERANCE = 1e-4
#: How far tempered targets even out: shares go with this power of the tokens. With a lower power half of a
#: corpus cannot meet the targets, as its rare values have too few tokens.
POWER = 0.85
#: Cells that one task rakes at most, and the cycles of such a job.
FEW_CELLS = 100_000
CYCLES_AT_ONCE = 4
WORDS = r"[^\x20\x09-\x0D]+"


def word_tokens(text: Column) -> Column:
    """Words of a whole text between ASCII white space; a null text has none."""
    squeezed = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_count(squeezed, F.lit(WORDS)).cast("long")


def unit_hash(*columns: Column) -> Column:
    """A number from 0 up to 1 that is drawn by a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), *columns), 11) / F.lit(float(1 << 53))


def tempered(cells: DataFrame, dimension: str, power: float = POWER) -> DataFrame:
    """(value, share): target shares in proportion to a power of the tokens that each value has."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    weighted = sums.select("value", F.pow("t", F.lit(power)).alias("w"))
    total = weighted.agg(F.sum("w").alias("all"))
    return weighted.join(F.broadcast(total)).select("value", (F.col("w") / F.col("all")).alias("share"))


def cells_of(docs: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimensions, tokens): the tokens of each combination of values; a null value is a value of its own."""
    return docs.groupBy(*dimensions).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))


def raked(
    cells: DataFrame, targets: dict[str, DataFrame], budget: float, cycles: int = CYCLES, tolerance: float = TOLERANCE, few: int = FEW_CELLS
) -> DataFrame:
    """Cells with the tokens ``w`` to take from each: raked in turn to each dimension's target shares of the
    ``budget`` (tokens), never more than a cell has. Values without a target get none; targets without
    documents are lost, the others keep their proportions. Targets that the tokens cannot meet are missed by what
    full cells lack; ``missed`` tells by how much.

    Up to ``few`` cells, which are counted first, are raked in one task, several cycles to a job. More are
    raked by grouped sums, combined before their shuffle, and joins to a dimension's values, which are merged
    as many broadcasts would fill the driver. Either way plans are cut by a checkpoint. Stops when a cycle
    changes no cell by more than ``tolerance`` of the budget.
    """
    table = cells.where("tokens > 0").withColumn("w", F.col("tokens").cast("double"))
    for name, target in targets.items():
        want = target.select(F.col("value").alias("__t"), F.col("share").alias(f"__want_{name}"))
        table = table.join(want, table[name].eqNullSafe(F.col("__t")), "left").drop("__t")
    table = checkpointed(table)
    together = table.count() <= few
    done = 0
    while done < cycles:
        for _ in range(CYCLES_AT_ONCE if together else 1):
            table = (table.coalesce(1) if together else table).withColumn("__old", F.col("w"))
            for name in targets:
                table = _rake_few(table, name, budget) if together else checkpointed(_rake(table, name, budget))
            table = table.withColumn("w", F.least("w", F.col("tokens").cast("double")))
            done += 1
        table = checkpointed(table)
        moved = table.agg(F.max(F.abs(F.col("w") - F.col("__old")))).first()[0] or 0.0
        table = table.drop("__old")
        if moved <= tolerance * budget:
            break
    return table.drop(*[f"__want_{name}" for name in targets])


def missed(table: DataFrame, targets: dict[str, DataFrame], budget: float) -> DataFrame:
    """(dimension, value, wanted, reached): the tokens that each target asks of a raked ``table`` and what it has, a
    row for every value of a target or of the table. Where cells are full, or values have no cell, the two differ:
    raking alone does not say so."""
    parts = []
    for name, target in targets.items():
        reached = table.groupBy(F.col(name).cast("string").alias("value")).agg(F.sum("w").alias("reached"))
        wanted = target.select(F.col("value").cast("string").alias("__value"), (F.col("share") * budget).alias("wanted"))
        both = reached.join(wanted, reached["value"].eqNullSafe(F.col("__value")), "full")
        value = F.when(F.col("wanted").isNull() | F.col("value").isNotNull(), F.col("value")).otherwise(F.col("__value"))
        amounts = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("wanted", "reached")]
        parts.append(both.select(F.lit(name).alias("dimension"), value.alias("value"), *amounts))
    return reduce(DataFrame.unionByName, parts)


def _scaled(name: str, budget: float, total: Column) -> Column:
    want = F.coalesce(F.col(f"__want_{name}"), F.lit(0.0)) * budget
    return F.when(total > 0, F.col("w") * want / total).otherwise(0.0)


def _rake_few(table: DataFrame, name: str, budget: float) -> DataFrame:
    return table.withColumn("w", _scaled(name, budget, F.sum("w").over(W.partitionBy(name))))


def _rake(table: DataFrame, name: str, budget: float) -> DataFrame:
    sums = table.groupBy(F.col(name).alias("__v")).agg(F.sum("w").alias("__sum"))
    joined = table.join(sums.hint("merge"), table[name].eqNullSafe(F.col("__v")))
    return joined.withColumn("w", _scaled(name, budget, F.col("__sum"))).drop("__v", "__sum")


def mixed(
    docs: DataFrame, dimensions: list[str], targets: dict[str, DataFrame] | None = None, share: float = 0.5, power: float = POWER, identity: list[str] | None = None
) -> DataFrame:
    """Documents (with ``tokens`` and the ``dimensions``) and two more columns: ``probability``, by which a
    sample has the raked weights on average, and ``selected``, drawn by a hash of ``identity`` (doc_id).

    The sample is to hold ``share`` of all tokens. Dimensions without ``targets`` are tempered. All documents
    of a cell have one probability; those without tokens keep none of the weight and have probability 0, as
    have all where nothing has tokens. Equal rows are drawn alike.
    """
    cells = checkpointed(cells_of(docs, dimensions))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    wanted = {d: tempered(cells, d, power) for d in dimensions} | (targets or {})
    table = raked(cells, wanted, share * total)
    rates = checkpointed(table.select(*[F.col(d).alias(f"__{i}") for i, d in enumerate(dimensions)], (F.col("w") / F.col("tokens")).alias("__p")))
    same = [docs[d].eqNullSafe(rates[f"__{i}"]) for i, d in enumerate(dimensions)]
    joined = docs.drop("probability", "selected").join(F.broadcast(rates) if is_small(rates) else rates, same, "left")
    probability = F.when(F.col("tokens") > 0, F.coalesce("__p", F.lit(0.0))).otherwise(0.0)
    draw = unit_hash(*[docs[c] for c in identity or ["doc_id"]])
    joined = joined.withColumn("probability", probability).withColumn("selected", draw < F.col("probability"))
    return joined.drop("__p", *[f"__{i}" for i in range(len(dimensions))])


#: Topics stand in for labels that the table does not have: the form of a document, by its words.
NOTE_WORDS, ARTICLE_WORDS = 120, 600


def form_topic(tokens: Column) -> Column:
    return F.when(tokens < NOTE_WORDS, "note").when(tokens < ARTICLE_WORDS, "article").otherwise("long read")
