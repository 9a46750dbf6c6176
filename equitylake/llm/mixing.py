"""Mix sources to target weights by systematic sampling.

Every source has a weight; its target is its share of the whole corpus, but
at most ``cap`` times its own size, the excess going to the other sources by
weight. Inside a source all documents expect ``target / size`` copies. With the
documents in order of size, out along the even ranks and back along the odd
ones so that errors of the two ways cancel, the running sum of expected copies plus one random
offset crosses an integer boundary as often as a document is emitted, so each
source comes out within about one document of its target.

The running sum is a rank, found in two levels: a range sort by (source, size,
id) spreads a large source over many tasks, each task numbers its own rows, and
a table with one row per (task, source) holds the counts before it.

Edge cases: null text has size 0; null sources form one source, sorted last;
documents of size 0 are sampled like others and add nothing; identical rows are
interchangeable; an empty table gives an empty result. All input columns are
kept in a struct while sampling, so their names can't clash. A very long text is
counted whole, in proportion to its length, and is one document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BROADCAST_RUNS = 200_000  # rows of some 100 bytes
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(no_src, src, source_size) -> the same plus ``target``, one row a source.

    The fair level per unit of weight is what remains for the uncapped sources
    over their weights; a source is capped while its cap lies below the level
    that holds if all sources with a lower cap per weight are capped.
    """
    by_name = Window.orderBy("no_src", "src")
    by_ratio = Window.orderBy("ratio", "no_src", "src")
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          (F.row_number().over(by_name) - 1) % len(weights) + 1)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    return (sizes.withColumn("weight", weight)
            .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
            .withColumn("ratio", F.col("most") / F.col("weight"))
            .withColumn("level", (F.sum("source_size").over(every)
                                  - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                        / F.sum("weight").over(onward))
            .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
            .withColumn("target", F.least("most", F.col("weight") * F.col("level")))
            .select("no_src", "src", "source_size", "target"))


def offset(no_src: Column, src: Column, seed: str) -> Column:
    """The source's random offset in [0, 1), a multiple of 2**-16."""
    key = F.concat(F.lit(seed), F.when(no_src, F.lit(":n")).otherwise(F.concat(F.lit(":s"), src)))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("long") / F.lit(65536.0)


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: float = 3.0,
                seed: str = "mix", carry: Sequence[str] | None = None) -> DataFrame:
    """One row per document: ``doc`` (struct of the ``carry`` columns, default
    all), ``doc_id``, ``size``, ``source``, ``source_size``, ``target``,
    ``copies`` and ``taken`` (= copies * size)."""
    spark = docs.sparkSession
    keep = list(docs.columns if carry is None else carry)
    rows = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("doc") if keep else F.lit(None).cast("struct<none:int>").alias("doc"),
        docs["doc_id"].alias("doc_id"), docs["source"].isNull().alias("no_src"),
        F.coalesce(docs["source"], F.lit("")).alias("src"), word_count(docs["text"]).alias("size"),
        # after them, rows that are alike in all of source, size and id: so that
        # no range holds more of them than its share
        F.xxhash64(docs["text"]).alias("like"), F.monotonically_increasing_id().alias("nth"))
    order = ["no_src", "src", "size", "doc_id", "like", "nth"]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # task number and place of each row: fixed by writing them down
    rows = staged(rows.withColumn("part", F.spark_partition_id())
                      .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "mix")
    runs = rows.groupBy("part", "no_src", "src").agg(
        F.count("*").alias("n"), F.sum("size").alias("run_size"), F.min("place").alias("from_place"))
    earlier = Window.partitionBy("no_src", "src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = runs.groupBy("no_src", "src").agg(F.sum("run_size").alias("source_size"), F.sum("n").alias("docs"))
    runs = runs.select("part", "no_src", "src",
                       (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("from_place")).alias("shift"))
    plan = runs.join(targets(sizes.drop("docs"), weights, cap), ["no_src", "src"]).join(
        sizes.select("no_src", "src", "docs"), ["no_src", "src"])
    # a row per run, so at most tasks plus sources: broadcast if that is small, so
    # that the documents stay where they are; else joined by shuffle
    plan = staged(plan, "mix_plan")
    if plan.count() <= BROADCAST_RUNS:
        plan = F.broadcast(plan)
    copies = F.coalesce(F.least(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(float(cap))), F.lit(0.0))
    by_size = F.col("place") + F.col("shift")
    rank = F.when(by_size % 2 == 0, F.floor(by_size / 2)).otherwise(F.col("docs") - 1 - F.floor(by_size / 2))
    start = offset(F.col("no_src"), F.col("src"), seed)
    return (rows.join(plan, ["part", "no_src", "src"])
            .withColumn("per_doc", copies).withColumn("start", start)
            .withColumn("copies", F.least(F.floor(F.col("start") + F.col("per_doc") * (rank + 1))
                                          - F.floor(F.col("start") + F.col("per_doc") * rank),
                                          F.lit(int(cap))).cast("long"))
            .select("doc", "doc_id", "size", F.when(~F.col("no_src"), F.col("src")).alias("source"),
                    "source_size", F.col("target").cast("double").alias("target"), "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it was taken."""
    return (mixed.where("copies > 0")
            .select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
            .select("doc.*"))
