"""Operator 13: a mix of sources at target weights, by Pareto order sampling.

A source's target is its share of all words. Every document is taken as many whole times as the target holds the whole source; what is left of the
target is a sample in which a document's chance rises with its weight. Chances are solved so that the expected words are
those wanted; chances of one are certain copies. The others are sampled in strata of nearly equal size: the number to take is fixed for each stratum, what
rounding leaves goes on to the next smaller size, and the documents of the smallest ratio of random odds to odds of
inclusion are taken (Pareto order sampling). Random numbers are hashes of the rows, so reruns agree whatever the partitions are.

Documents with no words have weight none and are never taken. Null text has no words; null source is a source, the last one. Equal rows are
one unit that is dealt out again at the end; rows that share an id are rows of their own. Extra columns are not
returned and their names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenvault.llm.common import WORD_SPLIT, keyed_join, release
from lumenvault.operators.graph import cut

WEIGHTS = (1, 2, 3)
#: No document is taken more often.
MOST_COPIES = 3
SEED = 20
#: Sizes in a stratum differ by less than one part in this many of a doubling.
CLASSES = 8
#: Rows of the crossing bin of a stratum that one task sorts, about.
BIN_ROWS = 10_000
#: Equal rows that one row holds until they are dealt out again.
UNIT_ROWS = 100_000
BILLION = 1_000_000_000


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, u) of documents: the number of words, and a random number in (0, 1) from the row itself."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), WORD_SPLIT), lambda w: w != "")).cast("long")
    text = F.coalesce(F.xxhash64("text"), F.lit(0))
    drawn = F.xxhash64(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), F.coalesce(F.col("source").cast("string"), F.lit("\0")), text)
    # 52 bits, so that neither 0 nor 1 is drawn.
    u = (F.shiftrightunsigned(drawn, 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), u.alias("u"))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with ``place``, from 0 in an order; they are sorted in ranges, and only the ranges' sizes meet in one task."""
    # The number of a row is its range's number times 2^33 and its place there.
    ranged = cut(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    placed = ranged.join(F.broadcast(before), F.shiftright("_at", 33) == F.col("_range"))
    out = cut(placed.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_range", "_before"))
    release(ranged)
    return out


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """sources (source, source_size, ...) with ``target``: shares of all words by repeating weights, none above ``most`` times the source.

    What a source cannot take is shared again by weight among those that still can. A round is one
    sum that comes to the driver.
    """
    each = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    known = numbered(sources, [F.asc_nulls_last("source")]).withColumns({"weight": each, "room": F.col("source_size") * F.lit(float(most))})
    level = 0.0
    while True:
        full = F.col("room") <= F.col("weight") * F.lit(level)
        total, held, free, n = known.agg(F.sum("source_size"), F.sum(F.when(full, F.col("room"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        new = ((total or 0) - (held or 0.0)) / free if free else level
        if not free or new <= level:
            break
        level = new
    return known.select(*sources.columns, F.least(F.col("room"), F.col("weight") * F.lit(level)).alias("target"))


def chances(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, scale): chance of inclusion is least(1, scale * weight), so that the expected words of a source are its ``rest``.

    units: (source, size, weight, n), weight a whole number; wanted: (source, rest), rest being less than the source. Each round raises
    the scale by what the documents that reached one leave to the others, until none reaches one any more. Sums are of
    whole numbers, so that they don't depend on the order of rows.
    """
    grouped = cut(units.where("size > 0").groupBy("source", "weight").agg(F.sum(F.col("size") * F.col("n")).cast("decimal(20,0)").alias("words")))
    scales = cut(wanted.where("rest > 0").select("source", "rest", F.lit(0.0).alias("scale")))
    while True:
        met = grouped.join(scales.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        sure = F.col("weight") * F.col("scale") >= 1
        free = F.when(~sure, F.col("words") * F.col("weight").cast("decimal(17,0)"))
        sums = met.groupBy("source", "rest", "scale").agg(F.coalesce(F.sum(F.when(sure, F.col("words"))), F.lit(0)).cast("double").alias("held"), F.sum(free).cast("double").alias("free"))
        new = F.when(F.col("free") > 0, F.greatest("scale", (F.col("rest") - F.col("held")) / F.col("free"))).otherwise(F.col("scale"))
        last, scales = scales, cut(sums.select("source", "rest", new.alias("scale"), (new > F.col("scale") * (1 + 1e-12)).alias("moved")))
        release(last)
        if not scales.where("moved").head(1):
            release(grouped)
            return scales.select("source", "scale")


def _numbers_to_take(strata: DataFrame) -> DataFrame:
    """(source, class, take) of strata (source, class, expected, words, n): from the largest sizes to the smallest, rounding's rest going on.

    Rounding is random, by a hash, so that a rare long document has its chance, but only to numbers whose rest the
    smaller sizes can make up for; where there is none, to the nearest. A source has at most CLASSES strata for each doubling of sizes.
    """
    drawn = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), F.coalesce("source", F.lit("\0")), "class"), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    row = F.struct((-F.col("class")).alias("order"), "class", (F.col("words") / F.col("expected")).alias("mean"), "words", "n", drawn.alias("drawn"))
    room = F.col("words") / F.col("expected") * F.col("n")
    listed = strata.groupBy("source").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.sum("words").alias("words"), F.sum(room).alias("room"))
    start = F.struct(F.lit(0.0).alias("carry"), F.col("words").alias("words"), F.col("room").alias("room"), F.array().cast("array<struct<class:int,take:bigint>>").alias("found"))

    def step(state: Column, x: Column) -> Column:
        words, room, want = state["words"] - x["words"], state["room"] - x["mean"] * x["n"], x["words"] + state["carry"]
        least, greatest = F.ceil((want - (room - words)) / x["mean"]), F.floor((want + words) / x["mean"])
        chosen = F.greatest(least, F.least(greatest, F.floor(want / x["mean"] + x["drawn"])))
        rounded = F.when(least <= greatest, chosen).otherwise(F.floor(want / x["mean"] + 0.5))
        take = F.greatest(F.lit(0), F.least(x["n"], rounded)).cast("bigint")
        return F.struct((want - take * x["mean"]).alias("carry"), words.alias("words"), room.alias("room"), F.concat(state["found"], F.array(F.struct(x["class"].alias("class"), take.alias("take")))).alias("found"))

    found = listed.select("source", F.explode(F.aggregate("rows", start, step)["found"]).alias("f"))
    return found.select("source", "f.class", "f.take")


def pareto_sample(units: DataFrame, strata: DataFrame) -> DataFrame:
    """units (source, class, ratio, n, ...) with ``taken``: how many of its n equal rows are among the ``take`` of smallest ratio of its stratum.

    Strata (source, class, take, n) of any size: ratios are counted in bins first, as many as the largest stratum asks for, and only the rows of the bin in which
    the number is reached are sorted.
    """
    key = ["source", "class"]
    largest, total = strata.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bins = max(1, -(-largest // BIN_ROWS))
    # A ratio in (0, oo) as a number in (0, 1), in the same order.
    binned = units.withColumn("_bin", F.floor(F.col("ratio") / (1 + F.col("ratio")) * bins))
    counts = binned.groupBy(*key, "_bin").agg(F.sum("n").alias("_m"))
    before = counts.withColumn("_before", F.sum("_m").over(Window.partitionBy(*key).orderBy("_bin")) - F.col("_m"))
    named = before.select(F.col("source").alias("_s"), F.col("class").alias("_c"), "_bin", "_before")
    of = F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c")) & (F.col("_before") < F.col("take"))
    reached = strata.join(named, of, "left").groupBy(*key, "n", "take").agg(F.max(F.when(F.col("_bin").isNotNull(), F.struct("_bin", "_before"))).alias("_in"))
    placed = keyed_join(binned, reached, key, total)
    last = F.col("_bin") == F.col("_in._bin")
    clear = placed.where(~F.coalesce(last, F.lit(False))).withColumn("taken", F.when(F.col("_bin") < F.col("_in._bin"), F.col("n")).otherwise(F.lit(0)))
    order = Window.partitionBy(*key).orderBy("ratio", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("take") - F.col("_in._before") - (F.sum("n").over(order) - F.col("n"))
    split = placed.where(last).withColumn("taken", F.greatest(F.lit(0), F.least(F.col("n"), left)))
    return clear.unionByName(split).drop("_bin", "_in", "take")


def mix(docs: DataFrame, weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of documents (doc_id, text, source): the words and copies that a mix of all words takes of each.

    weight: what a document's chance of one more copy rises with, an expression on size that is above 0 where size is (to six decimals);
    without one its logarithm, so that a long text is preferred to a fragment, but no more than a few times.
    """
    wish = F.log2(F.col("size") + 1.0) if weight is None else weight
    found = sized(docs).groupBy("doc_id", "source", "size", "u").agg(F.count("*").alias("n"))
    units = cut(found.withColumn("weight", F.when(F.col("size") > 0, F.round(wish * 1_000_000).cast("long"))))
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n"))
    planned = targets(sources, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio)
    planned = cut(planned.withColumns({"whole": whole, "rest": F.col("target") - whole * F.col("source_size")}))
    scales = chances(units, planned.select("source", "rest")).withColumnRenamed("source", "_s")
    plan = cut(planned.join(scales, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "n", "source_size", "target", "whole", "scale"))
    # In billionths.
    chance = F.when(F.col("size") > 0, F.round(F.least(F.lit(1.0), F.coalesce(F.col("scale") * F.col("weight"), F.lit(0.0))) * BILLION)).otherwise(0).cast("long")
    known = cut(keyed_join(units, plan, ["source"], units.count()).withColumn("chance", chance).drop("scale", "weight"))
    drawing = F.col("chance").between(1, BILLION - 1)
    drawn = known.where(drawing).withColumns({
        "class": F.floor(F.log2("size") * CLASSES).cast("int"),
        "ratio": (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (BILLION - F.col("chance"))),
    })
    expected = F.sum(F.col("chance") * F.col("n")) / BILLION
    words = F.sum((F.col("chance") * F.col("n")).cast("decimal(20,0)") * F.col("size").cast("decimal(17,0)")).cast("double") / BILLION
    strata = cut(drawn.groupBy("source", "class").agg(expected.alias("expected"), words.alias("words"), F.sum("n").alias("n")))
    take = _numbers_to_take(strata).select(F.col("source").alias("_s"), F.col("class").alias("_c"), "take")
    numbers = strata.join(take, F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c"))).select("source", "class", "take", "n")
    numbers = cut(numbers)
    sampled = pareto_sample(drawn, numbers).drop("class", "ratio")
    certain = known.where(~drawing).withColumn("taken", F.when(F.col("chance") > 0, F.col("n")).otherwise(F.lit(0)))
    both = certain.unionByName(sampled)
    # Equal rows are dealt out in parts, so that no row becomes too many at once.
    starts = both.withColumn("_start", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(UNIT_ROWS))))
    again = starts.withColumn("_place", F.explode(F.sequence(F.col("_start"), F.least(F.col("n"), F.col("_start") + UNIT_ROWS) - 1)))
    copies = (F.col("whole") + F.when(F.col("_place") < F.col("taken"), 1).otherwise(0)).cast("long")
    out = cut(again.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies")))
    release(units, planned, plan, known, strata, numbers)
    return out
