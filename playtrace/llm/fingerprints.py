"""Document fingerprints: bottom-k sketches of hashed word shingles.

A fingerprint holds the K smallest distinct 64-bit hashes of a text's runs of SHINGLE lower-case words. Fingerprints
of parts merge into that of the whole; two of them estimate resemblance and containment, one the number of distinct
shingles. Everything is a column expression. A text of fewer words is one shingle; a text without words has the empty fingerprint,
which resembles only itself.

``edited`` gives each document the beginning of the next one in place of its second half. The next document is found in
ranges of (id, first characters of the text): each range is sorted by itself, with the first document of the following
range at its end. The ranges are cut at quantiles of a sample, as many as the bytes of the table ask for; they only share
out the work, so the sample changes no result. Ids may be of any type that can be ordered.

Nulls: a null text counts as empty; null ids come first in the order. Rows with equal ids follow each other in the order of
their texts. In a table of one row the next document is the document itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtrace.llm.common import WORD, query, table
from playtrace.session import durable

K, SHINGLE = 128, 5
RANGES, MAX_RANGES = 256, 1 << 16
RANGE_BYTES = 64 << 20
SAMPLES = 8  # sampled rows for each range; at most 524,288, in one row
BEGINNING = 64  # characters of a text that part rows of one id


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The fingerprint as an ascending array of at most k hashes."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))

    def smallest(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1)))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, shingle)))
        return F.when(F.size(w) > 0, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), smallest)[0]  # the words are made once, however often smallest uses them


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of both texts together (shingles across the seam left out)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A ∩ B| / |A ∪ B|: the share of the union's sketch that both hold."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A ∩ B| / |A|, from 0 to 1; 1 for an empty A."""
    common = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def written(a: Column) -> Column:
    """The fingerprint as text: 16 hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _place() -> Column:
    """What ranges are cut by; in Spark's order of structs nulls come first."""
    return F.struct(F.col("doc_id"), F.substring("text", 1, BEGINNING).alias("beginning"))


def _ranged(rows: DataFrame) -> DataFrame:
    """The rows with the number of their range, ``_range``. The number of cuts at or below a row is found in two steps of about their root."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(MAX_RANGES, max(2, RANGES, partitions, -(-size // RANGE_BYTES)))
    step = int((n - 1) ** 0.5)
    chance = F.xxhash64("doc_id", F.monotonically_increasing_id())
    sample = rows.select(_place().alias("place"), chance.alias("chance")).orderBy("chance").limit(n * SAMPLES)
    at = lambda i: F.element_at("all", F.floor(i.cast("long") * F.size("all") / n).cast("int") + 1)
    fine = F.when(F.size("all") > 0, F.transform(F.sequence(F.lit(1), F.lit(n - 1)), at))
    cuts = durable(sample.agg(F.sort_array(F.collect_list("place")).alias("all")).select(fine.alias("fine")))
    coarse = cuts.select(F.filter("fine", lambda _, i: i % step == 0)).scalar()
    below = lambda some, place: F.size(F.filter(some, lambda cut: cut <= place))
    marked = rows.withColumns({"_place": _place(), "_coarse": coarse, "_fine": cuts.scalar()})
    marked = marked.withColumn("_block", F.greatest(below(F.col("_coarse"), F.col("_place")) - 1, F.lit(0)) * step)
    rest = below(F.slice("_fine", F.col("_block") + 1, step), F.col("_place"))
    return marked.withColumn("_range", F.col("_block") + rest).drop("_coarse", "_fine", "_block")


def edited(docs: DataFrame, k: int = K) -> DataFrame:
    """For every row: doc_id, text, next_text, edited_text, and the sketches sketch, next_sketch, edited_sketch."""
    text = F.coalesce("text", F.lit(""))
    rows = _ranged(docs.select("doc_id", text.alias("text")))
    firsts = rows.groupBy("_range").agg(F.min("_place").alias("_first"))  # one row for each range, whose number is bounded
    order = Window.partitionBy(F.lit(0)).orderBy("_range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = firsts.select("_range", "_first", F.coalesce(F.lag("_range").over(order), F.max("_range").over(whole)).alias("_before"))
    heads = rows.withColumnRenamed("_range", "_r").join(F.broadcast(before), (F.col("_r") == F.col("_range")) & F.col("_place").eqNullSafe(F.col("_first")))
    ring = heads.groupBy("_before", "doc_id").agg(F.min("text").alias("text")).withColumnRenamed("_before", "_range")
    rows = rows.drop("_place")
    both = rows.withColumn("_copy", F.lit(0)).unionByName(ring.withColumn("_copy", F.lit(1))).withColumn("sketch", sketch(F.col("text"), k))
    follow = Window.partitionBy("_range").orderBy("_copy", "doc_id", "text")
    both = both.withColumns({"next_text": F.lead("text").over(follow), "next_sketch": F.lead("sketch").over(follow)}).where("_copy = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    both = both.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    return both.withColumn("edited_sketch", sketch(F.col("edited_text"), k)).drop("_range", "_copy")


@query("op6_bottom_k_fingerprints")
def _(spark, sf_dir):
    e = edited(table(spark, sf_dir, "documents"))
    return e.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained"),
    )
