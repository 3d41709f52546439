"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

#: Sub-groups of the documents of one source and size, so that no group is one task's alone.
FANS = 256
#: Offsets tried for each source, evenly spaced from its random one.
TRIES = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _fraction(key: Column, seed: int) -> Column:
    """In (0, 1), a multiple of 2**-21, from the md5 of a text."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}/"), key).cast("binary")), 1, 5)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(1048576.0)


def _named(source: Column) -> Column:
    """Never null, so that joins and windows share one dealing of the rows."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def source_targets(sources: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per source of `sources` (source, source_size): weight and target.

    Sources in order of code points, null last, have the weights in turn and share the sum of all
    sizes; a target stops at `cap` times its source's size and the rest is shared by weight again
    until none is above.  That is min(weight * level, cap * size) at one level for all, found by
    running sums in order of cap * size / weight: with the first k sources at their caps the level
    of the others rises while a source at its cap stands below it, and falls after, so the highest
    of these levels is the one sought.  One row a source goes through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filling = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.lit(list(weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    levels = (
        ranked.withColumn("full_at", (F.col("source_size") * cap).cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum(F.col("source_size") * cap).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("open_weight"))
        .withColumn("level", F.max("level").over(everything))
    )
    target = F.least(F.col("weight") * F.col("level"), (F.col("source_size") * cap).cast("double"))
    return levels.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, size: Column, tie: Column, source: str = "source", key: str = "doc_id", cap: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """Every row of docs with size, source_size, target (its source's) and copies (0 to cap).

    Within a source each document expects target / source_size copies.  The prefix sum of these,
    in order of size, plus one offset of the source drawn from `seed`, crosses some integers in
    each document's share; it is taken once for each.  Order by size keeps the words taken within
    the source's largest document of the target, whatever the offset.  Where few long documents
    make up a source that may still be far, so of TRIES evenly spaced offsets, the first of them
    random, that one serves whose words come nearest, which the group counts tell.

    The prefix sum is a rank times a constant.  The rank is the position in a (source, size, fan)
    group, where the fan is a hash of the key, plus the rows in the groups before it: running sums
    over a source's distinct sizes and over a size's fans.  So a source or a group of copies that holds a third of all rows is dealt by
    size and fan.  Rows with equal keys are each a document, in order of `tie`, so that which of two
    texts under one key is taken does not depend on the run.  An empty source has its own share; a
    null source is one too; sources without words have target 0.  Extra columns pass through.
    """
    fan = F.conv(F.substring(F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")), 1, 2), 16, 10).cast("int") % FANS
    rows = docs.select(F.struct("*").alias("row"), _named(F.col(source)).alias("name"), size.alias("size"), F.col(key).alias("key"), tie.alias("tie")).withColumn("fan", fan)
    groups = rows.groupBy("name", "size", "fan").agg(F.count("*").alias("n"))
    # The rows before a group: those of smaller sizes, and those of its size in lower fans.
    sizes = groups.groupBy("name", "size").agg(F.sum("n").alias("of_size"))
    lower = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("name", "size", F.coalesce(F.sum("of_size").over(lower(["name"], "size")), F.lit(0)).alias("smaller"))
    fans = groups.withColumn("fans", F.coalesce(F.sum("n").over(lower(["name", "size"], "fan")), F.lit(0)))
    totals = groups.groupBy("name").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    plan = source_targets(totals.withColumn("source", F.when(F.col("name") != "null", F.substring("name", 2, 1 << 30))), cap, weights)
    plan = plan.select(
        _named(F.col("source")).alias("name"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        _fraction(_named(F.col("source")), seed).alias("offset"),
    )
    # A source's plan meets its sizes, then they meet the groups: no join of groups is by source alone.
    placed = lambda plan: fans.join(sizes.join(plan, "name"), ["name", "size"]).withColumn("before", F.col("smaller") + F.col("fans"))
    crossed = lambda u, lo, hi: F.floor(u + F.col("rate") * hi) - F.floor(u + F.col("rate") * lo)
    tried = [(F.col("offset") + k / TRIES) % 1.0 for k in range(TRIES)]
    taken = [F.sum(F.col("size") * crossed(u, F.col("before"), F.col("before") + F.col("n"))) for u in tried]
    missed = placed(plan).groupBy("name").agg(F.array(*(F.abs(t - F.first("target")) for t in taken)).alias("missed"))
    plan = plan.join(missed, "name").withColumn("offset", F.element_at(F.array(*tried), F.array_position("missed", F.array_min("missed")).cast("int"))).drop("missed")
    shares = placed(plan).select("name", "size", "fan", "before", "source_size", "target", "rate", "offset")
    place = F.row_number().over(Window.partitionBy("name", "size", "fan").orderBy("key", "tie"))
    ranked = rows.withColumn("place", place).join(shares, ["name", "size", "fan"]).withColumn("rank", F.col("before") + F.col("place"))
    return ranked.select("row", "size", "source_size", "target", F.least(crossed(F.col("offset"), F.col("rank") - 1, F.col("rank")), F.lit(cap)).cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken."""
    mixed = mix(docs, word_count(F.col(text)), F.xxhash64(text), **options)
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def mix_report(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted)."""
    slim = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("words"), F.xxhash64(text).alias("of_text"))
    return mix(materialise(slim, "sizes"), F.col("words"), F.col("of_text"), **options).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def oracle(text: str = "text", key: str = "doc_id", cap: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, table: str = "documents") -> str:
    """mix_report in DuckDB's SQL."""
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {} {} END".format(len(weights), " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights)))
    return f"""
WITH sized AS (
  SELECT {key} AS doc_id, source, CAST(coalesce(len(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, 2) AS BIGINT) % {FANS} AS fan
  FROM {table}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, fan, doc_id) AS place FROM sized),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (
  SELECT *, {weight} AS weight FROM sums),
filling AS (
  SELECT *, CAST(source_size * {cap} AS DOUBLE) / weight AS full_at, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS all_weight FROM named),
running AS (
  SELECT *, CAST(coalesce(sum(source_size * {cap}) OVER w, 0) AS BIGINT) AS capped, all_weight - CAST(coalesce(sum(weight) OVER w, 0) AS BIGINT) AS open_weight
  FROM filling WINDOW w AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, CAST(total - capped AS DOUBLE) / open_weight AS own FROM running),
plan AS (
  SELECT source, source_size, coalesce(least(weight * max(own) OVER (), CAST(source_size * {cap} AS DOUBLE)), 0.0) AS target,
         (CAST(CAST('0x' || substr(md5('{seed}/' || coalesce('s' || source, 'null')), 1, 5) AS BIGINT) AS DOUBLE) + 0.5) / 1048576.0 AS u
  FROM levels),
rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM plan),
placed AS (
  SELECT ranked.*, source_size, target, rate, u FROM ranked JOIN rated ON ranked.source IS NOT DISTINCT FROM rated.source),
tried AS (
  SELECT *, unnest(range({TRIES})) AS k FROM placed),
missed AS (
  SELECT source, k, abs(sum(size * (floor((u + k / {TRIES}.0) % 1.0 + rate * place) - floor((u + k / {TRIES}.0) % 1.0 + rate * (place - 1)))) - any_value(target)) AS miss
  FROM tried GROUP BY source, k),
best AS (
  SELECT source, min_by(k, (miss, k)) AS k FROM missed GROUP BY source)
SELECT doc_id, size, source_size, target,
       size * least(CAST(floor((u + k / {TRIES}.0) % 1.0 + rate * place) - floor((u + k / {TRIES}.0) % 1.0 + rate * (place - 1)) AS BIGINT), {cap}) AS taken
FROM placed JOIN best ON placed.source IS NOT DISTINCT FROM best.source"""
