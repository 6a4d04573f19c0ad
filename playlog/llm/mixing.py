"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected to be taken target / size times. Along a fixed order of the source's documents
these expectations are summed up, one random offset is added to the sums, and a document is taken once for each whole
number that its step crosses. The order is by size, so that every size is taken in its share and the taken words come
near the target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlog.llm.tables import blocks, count_words, free_name, release, stored

WEIGHTS = (5, 2, 1)
MOST = 3
_ROW_BITS = 33  # of the ids that Spark gives to the rows of a partition


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        columns = {name: block.column(name) for name in block.schema.names if name != "text"}
        yield pa.record_batch(columns | {"size": pa.array(count_words(block.column("text")))})
    release()


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Sources with their ``target``: shares by weight of all sizes, none above ``most`` times its source's size.

    ``sources`` has a row for each source, ``no_source, name, source_size``. In order of the sizes a source could give
    per weight, those that can't fill their share stand first; what they leave is shared by the weights of the rest.
    The windows see one row per source, never documents.
    """
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy("no_source", "name")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * most)
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "no_source", "name")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    level = ranked.withColumn("level", (total - before) / rest)
    level = level.withColumn("capped", F.col("ratio") <= F.col("level"))
    shared = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * shared)
    return level.withColumn("target", target).select("no_source", "name", "source_size", "target")


def offset(no_source: Column, name: Column, seed: int) -> Column:
    """The random offset of a source, from 0 to below 1, in steps that keep sums with whole numbers exact."""
    key = F.concat(F.lit(f"{seed}:"), no_source.cast("string"), F.lit(":"), name)
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("double") / 65536


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 1) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken``, a row for each input row.

    ``docs`` has ``doc_id, text, source``. The size of a document is its number of words, 0 for a null text; ``copies``
    is how often it is taken and ``taken`` the words that gives. Sources by code point, null last, have the given
    weights in turn. A null source is a source, an empty one another. Repeated rows are documents of their own. An empty
    table gives an empty one, sources without words have target 0.

    A source is never brought together in one place: rows are dealt by ranges of source, size and id, and numbered by
    adding the counts of the ranges before.
    """
    return _mixed(docs, weights, most, seed, {}).select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("name")).alias("source"),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def _mixed(docs: DataFrame, weights: Sequence[int], most: int, seed: int, keys: dict[str, Column]) -> DataFrame:
    """The sizes and copies of all rows, with further whole numbers that decide between rows of one size and id."""
    named = docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("name"),
        *[key.alias(name) for name, key in keys.items()],
        "text",
    )
    schema = ", ".join(["doc_id bigint, no_source boolean, name string", *[f"{name} bigint" for name in keys], "size bigint"])
    sized = stored(named.mapInArrow(_sizes, schema), "mixing-sizes")
    order = ["no_source", "name", "size", "doc_id", *keys]
    dealt = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumn("row", F.monotonically_increasing_id()), "mixing-order")
    placed = placed.withColumn("part", F.shiftright("row", _ROW_BITS))

    parts = placed.groupBy("no_source", "name", "part").agg(
        F.count("*").alias("n"), F.min("row").alias("first"), F.sum("size").alias("words")
    )
    source = Window.partitionBy("no_source", "name")
    counted = parts.select(
        "no_source",
        "name",
        "part",
        "first",
        F.coalesce(
            F.sum("n").over(source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    sources = parts.groupBy("no_source", "name").agg(F.sum("words").alias("source_size"))
    # A row for each source and range: what joins the documents is far smaller than they are.
    facts = counted.join(source_targets(sources, weights, most), ["no_source", "name"])
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    index = F.col("before") + F.col("row") - F.col("first")
    start = offset(F.col("no_source"), F.col("name"), seed)
    copies = F.floor(start + (index + 1) * share) - F.floor(start + index * share)
    return placed.join(facts, ["no_source", "name", "part"]).withColumn("copies", copies)


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 1) -> DataFrame:
    """The documents of a mix: all columns of ``docs``, each row as often as it is taken.

    Every row has a decision of its own, found again by a digest of all its columns (but maps), so rows without an id, or of one id,
    are told apart; rows that agree in everything are taken as often as all of them together. Null texts and sources,
    sources without words, and an empty table are as for ``mix``. Columns of any name are kept.
    """
    hashed = [F.col(f"`{name}`") for name, kind in docs.dtypes if "map<" not in kind]
    keys = {f"key_{place}": F.xxhash64(F.lit(place), *hashed) for place in range(2)}
    taken = _mixed(docs, weights, most, seed, keys).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    taken = stored(taken.where("copies > 0"), "mixing-taken")
    copies, copy = free_name(docs, "copies"), free_name(docs, "copy")
    names = [free_name(docs, name) for name in keys]
    keyed = docs.withColumns(dict(zip(names, keys.values(), strict=True)))

    def found(where: str) -> DataFrame:
        return keyed.join(taken.where(where).drop("n").toDF(*names, copies), names)

    rows = found("n = 1")
    if not taken.where("n > 1").isEmpty():
        rows = rows.unionByName(found("n > 1").dropDuplicates(names))
    copied = F.explode(F.sequence(F.lit(1), F.col(f"`{copies}`").cast("int")))
    return rows.withColumn(copy, copied).select(*[F.col(f"`{name}`") for name in docs.columns])
