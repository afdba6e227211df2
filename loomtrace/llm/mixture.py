"""Mix sources to target weights: hash-random order within each source, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm.common import WORD, cut, whole_text

WEIGHTS = (3, 1, 2)  # by place of the source in code-point order, repeating
SHARE = 1.5  # of all words together
EPOCHS = 2  # times a source may be taken whole
SPAN_ROWS = 1000  # rows of one range of keys, on average


def random_key(doc_id: Column) -> Column:
    """60 bits of a digest of the id: the same on every run."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Per source: rows, source_size and target. Sources are ranked by code point, null last.

    The level (words per unit of weight) rises while sources reach `epochs` times their size; the excess of those is
    shared again by weight. Each round is one small aggregate; it ends when no further source is full.
    """
    sources = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row per source
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(sources.withColumn("weight", weight).withColumn("most", epochs * F.col("source_size")))
    level, full = 0.0, -1
    while True:
        open_ = F.col("most") > level * F.col("weight")
        row = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(~open_, F.col("most"))).alias("closed"),
            F.sum(F.when(open_, F.col("weight"))).alias("open"), F.count(F.when(~open_, 1)).alias("full"),
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (share * row["all"] - (row["closed"] or 0)) / row["open"]
    target = F.least(F.col("most").cast("double"), F.lit(float(level)) * F.col("weight"))
    return ranked.select("source", "rows", "source_size", target.alias("target"))


def mix_sizes(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, span_rows: int = SPAN_ROWS) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken.

    A source's documents stand in the order of a digest of their ids. Its budget (the whole part of the target) is
    filled by whole epochs and then by the documents in that order, the last one cut at the exact word. No source is in
    one task: keys are cut into ranges of about `span_rows` rows, words are summed per range, and a running sum over the
    ranges gives each range its start. Null texts and ids are empty ones; a source of empty texts has target 0; repeated
    rows stand side by side. Ties are ordered by id and size, so reruns agree.
    """
    sizes = cut(
        docs.select(
            "doc_id", "source", F.regexp_count(whole_text(), F.lit(WORD)).cast("bigint").alias("size"), random_key(F.col("doc_id")).alias("key")
        )
    )
    targets = cut(source_targets(sizes, weights, share, epochs))
    same = sizes["source"].eqNullSafe(targets["source"])
    spans = F.ceil(F.col("rows") / span_rows)
    keyed = sizes.join(targets, same).select(
        sizes["source"], "doc_id", "size", "key", "source_size", "target", F.floor(F.col("key") / (F.lit(2.0**60) / spans)).alias("span")
    )
    before_span = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("source", "span").agg(F.sum("size").alias("words"))
    starts = starts.select(F.col("source").alias("s"), F.col("span").alias("p"), F.coalesce(F.sum("words").over(before_span), F.lit(0)).alias("start"))
    in_span = Window.partitionBy("source", "span").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("before", F.sum("size").over(in_span) - F.col("size"))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("span") == F.col("p")))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size") - F.col("before") - F.col("start")
    taken = F.col("size") * whole + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as taken whole, and the one at the cut with its first words only.

    All columns stay; n_chars, where there is one, follows the text. A document with no words stays as it is when its
    source has no budget to fill or is taken at all.
    """
    mixed = mix_sizes(docs, **how).select(F.col("doc_id").alias("mix_id"), F.col("size").alias("mix_size"), "taken").distinct()
    left = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"),
        F.regexp_count(whole_text(), F.lit(WORD)).cast("bigint").alias("size"),
    )
    best = mixed.groupBy("mix_id", "mix_size").agg(F.max("taken").alias("taken"))
    found = left.join(best, F.col("id").eqNullSafe(F.col("mix_id")) & (F.col("size") == F.col("mix_size")))
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(1))
    part = F.when(F.col("size") > 0, F.expr("taken % size")).otherwise(F.lit(0))
    counts = F.concat(F.array_repeat(F.lit(-1).cast("bigint"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = found.select("row", F.explode(counts).alias("words"))
    # only a cut document is taken apart into words
    lead = F.when(F.col("words") < 0, F.col("row.text")).otherwise(
        F.array_join(F.slice(F.regexp_extract_all(whole_text("row.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    )
    changed = rows.withColumn("lead", lead)
    columns = [
        F.col("lead").alias(c) if c == "text"
        else F.when(F.col("words") < 0, F.col("row.n_chars")).otherwise(F.length("lead").cast(docs.schema["n_chars"].dataType)).alias(c) if c == "n_chars"
        else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return changed.select(*columns)
