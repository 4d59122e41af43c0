"""Mixing sources to target weights: budgets by water-filling, cuts by distributed prefix sums.

A source's documents are ordered by a hash of their id. Because hashes are
uniform, equal ranges of them hold equal numbers of documents: each source is
cut into ranges of about ROWS documents, a window sums inside each range, and a
small window over the ranges' totals gives each range its offset. No task sees
a whole source, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, checkpoint, row_hash, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 17
#: Documents in a range of hashes.
ROWS = 4_000


def _key(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(f":{seed}")))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, n_rows with a column target.

    Sources in order of code points, null last, have the weights in turn. They
    share `share` times all words by weight, none above `cap` times its size;
    what is over goes to the others by weight. In order of size over weight the
    sources fill up one after another, so the level at which the rest is shared
    follows from running sums. One row a source: no input rows here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % n + 1)
    rows = sources.withColumn("_w", w).withColumn("_most", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("_most") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_left", F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_most").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", F.col("_left") / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # the first source that doesn't fill up sets the level for itself and all after it
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_most"), F.struct(F.col("_most") / F.col("_w"), "_level"))).over(everything)["_level"]
    rows = rows.withColumn("target", F.coalesce(F.least(F.col("_most"), level * F.col("_w")), F.col("_most")))
    return rows.select("source", "source_size", "n_rows", "target")


#: Equal rows that one row is multiplied into at once.
TIMES = 1000


def _each(rows: DataFrame, times: str, number: str) -> DataFrame:
    """Every row `times` times, numbered from 0; a row of very many is first cut into pieces, which are dealt out."""
    rows = rows.withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / TIMES))))
    few, many = rows.where(F.col(times) <= TIMES), rows.where(F.col(times) > TIMES)
    if not many.isEmpty():
        few = few.unionByName(many.repartition(F.xxhash64(number)))
    last = F.least(F.col(times) - 1, F.col(number) * TIMES + TIMES - 1)
    return few.withColumn(number, F.explode(F.sequence(F.col(number) * TIMES, last)))


def _allotted(sized: DataFrame, seed: int, rows: int, **budget) -> tuple[DataFrame, Column]:
    """The distinct rows of sized with _times, source_size, target; and what the _i-th of equal ones takes."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    plan = targets(sources, **budget).withColumnRenamed("source", "_source")
    got = sized.groupBy(*sized.columns).agg(F.count("*").alias("_times"))
    got = got.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    got = got.withColumn("_key", _key("doc_id", seed))
    unit = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    got = got.withColumn("_range", F.floor(unit * F.ceil(F.col("n_rows") / rows)).cast("long"))
    part = Window.partitionBy("source", "_range").orderBy("_key", F.col("doc_id").asc_nulls_last(), *[c for c in sized.columns if c not in ("doc_id", "source")])
    words = F.col("size") * F.col("_times")
    got = got.withColumn("_sum", F.sum(words).over(part.rowsBetween(Window.unboundedPreceding, -1)))
    totals = got.groupBy("source", "_range").agg(F.sum(words).alias("_total"))
    across = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_offset"))
    got = got.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - epochs * F.col("source_size")).cast("long")
    before = F.col("_offset") + F.coalesce(F.col("_sum"), F.lit(0))
    got = got.withColumns({"_epochs": epochs, "_rest": rest - before}).drop("_key", "_range", "_sum", "_s", "_r", "_offset", "n_rows")
    mine = F.least(F.col("size"), F.col("_rest") - F.col("_i") * F.col("size"))
    return got, F.col("_epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), mine)


def take(sized: DataFrame, seed: int = SEED, rows: int = ROWS, **budget) -> DataFrame:
    """sized (doc_id, source, size) with source_size, target and taken.

    A target of more than the source's size repeats the whole source as often
    as it fits; the rest of the budget, whole words, takes documents in order of
    their hash, and of the last one the first words only. So taken sums to the
    target, rounded down, and reruns agree. Null ids hash as the empty string;
    rows that repeat an id stand next to each other in order of their other
    columns, and equal rows are one row with a number until the end, so that
    neither makes a range larger than its distinct rows; a source without words
    has target 0; an empty table gives an empty one.
    """
    got, taken = _allotted(sized, seed, rows, **budget)
    return _each(checkpoint(got), "_times", "_i").withColumn("taken", taken).drop("_times", "_i", "_epochs", "_rest")


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source and size, the number of words of the text (null: 0)."""
    return docs.select("doc_id", "source", _size(text).alias("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as the mix takes it, the last partial copy cut after its words.

    Documents without words are in it once: they cost no budget. Rows that
    repeat an id keep their own texts; equal rows each take their own share; an
    empty table gives an empty one.
    The columns are those of docs; n_chars, if there, is that of the cut text.
    """
    one, two, first, second, size, part, copy = unused(docs, "row_one", "row_two", "taken_one", "taken_two", "row_size", "row_taken", "row_copy")
    hashed = docs.withColumns({one: row_hash(docs, 0), two: row_hash(docs, 1)})
    counted = checkpoint(hashed.select("doc_id", "source", F.col(one).alias("_h1"), F.col(two).alias("_h2"), _size("text").alias("size")))
    groups, taken = _allotted(counted, **{"seed": SEED, "rows": ROWS} | options)
    groups = checkpoint(groups)
    alike = (F.col(one) == F.col(first)) & (F.col(two) == F.col(second))
    named = lambda x: x.select(F.col("_h1").alias(first), F.col("_h2").alias(second), F.col("size").alias(size), F.col("taken").alias(part))
    single = named(groups.where("_times = 1").withColumn("_i", F.lit(0)).withColumn("taken", taken))
    got = hashed.join(single, alike)
    if not groups.where("_times > 1").isEmpty():  # equal rows: one of them stands for all, as often as they are
        several = named(_each(groups.where("_times > 1"), "_times", "_i").withColumn("taken", taken))
        distinct = hashed.join(several.select(first, second).distinct(), alike, "left_semi").dropDuplicates([one, two])
        got = got.unionByName(distinct.join(several, alike))
    copies = F.transform(F.sequence(F.lit(0), F.floor(F.col(part) / F.col(size)).cast("int")), lambda i: F.least(F.col(size), F.col(part) - i * F.col(size)))
    words = F.when(F.col(size) > 0, F.filter(copies, lambda k: k > 0)).otherwise(F.array(F.lit(0).cast("long")))
    got = got.withColumn(copy, F.explode(words))
    short = F.col(copy) < F.col(size)
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"[{SPACE}]*{WORD}"), F.lit(0)), F.lit(1), F.col(copy).cast("int")), "")
    got = got.withColumn("text", F.when(short, first).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(short, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return got.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = take(checkpoint(sized(docs)))
    return got.select("doc_id", "size", "source_size", "target", "taken", "source")


SQL = {
    "op5_mixing": f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS most FROM s),
f AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER b, 0) AS rest, (SELECT sum(w) FROM w) - coalesce(sum(w) OVER b, 0) AS ws
    FROM w WINDOW b AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(rest / ws, most / w) AS level FROM f WHERE rest / ws * w <= most),
t AS (SELECT source, source_size, coalesce(least(most, level * w), most) AS target FROM f LEFT JOIN l ON true),
o AS (SELECT d.doc_id, d.source, size, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - before)) AS taken, source FROM o"""
}
QUERIES = {"op5_mixing": op5_mixing}
