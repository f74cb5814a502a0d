"""Removal of repeated runs of lines, found by winnowing.

A run is MIN_LINES = GRAM + WINDOW - 1 neighbouring lines; or one line of LONG_WORDS words or more; or a whole document of fewer than
MIN_LINES lines that has a word.

The grams of a document are its runs of GRAM neighbouring lines. Of every WINDOW neighbouring grams the one with the smallest
hash is a fingerprint (the last, if several are smallest). Two equal runs of MIN_LINES lines share a fingerprint at
the same place, so counting fingerprints leaves few candidates. At each candidate the match is extended to both sides, into all
runs of MIN_LINES lines around it. Long lines and short documents are winnowed with windows of one: each is a fingerprint of its own. A run is a later one
if an equal run of its kind starts earlier, in the order of
(doc_id, hash of the text, line). All lines of later runs go, which removes maximal repeated runs as a whole. Runs are
judged on the input; they may overlap, also with their earlier copy.

Lines end at line feeds only. Nulls: a null text has no lines; a null id comes first in the order. An empty text is one empty line. Rows
with equal id and text are one document, given as often as it came: none is a later copy of the other. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.llm.common import WORD, query, table
from playtrace.session import durable

GRAM, WINDOW, LONG_WORDS = 2, 2, 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """_gram (hash), _runs (start, number of lines and two hashes of the runs around it), with doc_id and _text (hash)."""
    length = gram + window - 1
    rows = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("_text"), F.col("text").rlike(WORD).alias("_words"), _lines(F.col("text")).alias("_l"))
    rows = rows.withColumn("_n", F.size("_l"))
    rows = rows.withColumns({"_h": F.transform("_l", lambda x: F.xxhash64(x)), "_h2": F.transform("_l", lambda x: F.xxhash64(F.lit(1), x))})
    whole, none = F.col("_n") >= length, F.array().cast("array<int>")
    rows = rows.withColumn("_g", F.when(whole, F.transform(F.sequence(F.lit(0), F.col("_n") - gram), lambda i: F.xxhash64(F.slice("_h", i + 1, gram)))))

    def chosen(s: Column) -> Column:
        part = F.slice("_g", s + 1, window)
        return s + window - F.array_position(F.reverse(part), F.array_min(part)).cast("int")

    def run(s: Column, lines) -> Column:
        lines = F.lit(lines) if isinstance(lines, int) else lines
        return F.struct(s.alias("start"), lines.alias("lines"), F.xxhash64(lines, F.slice("_h", s + 1, lines)).alias("a"), F.xxhash64(lines, F.slice("_h2", s + 1, lines)).alias("b"))

    def entry(a: Column) -> Column:
        around = F.sequence(F.greatest(F.lit(0), a - (window - 1)), F.least(a, F.col("_n") - length))
        return F.struct(F.element_at("_g", a + 1).alias("gram"), F.transform(around, lambda s: run(s, length)).alias("runs"))

    def own(s: Column, lines, kind: int) -> Column:
        """A run that is its own fingerprint."""
        one = run(s, lines)
        return F.struct(F.xxhash64(F.lit(kind), one["a"]).alias("gram"), F.array(one).alias("runs"))

    rows = rows.withColumn("_at", F.when(whole, F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("_n") - length), chosen))).otherwise(none))
    if length > 1:
        is_long = lambda x: F.regexp_count(x, F.lit(WORD)) >= long_words
        places = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: is_long(F.element_at("_l", i + 1)))
        short = F.when(~whole & (F.col("_n") > 1) & F.col("_words"), F.array(own(F.lit(0), F.col("_n"), 3)))
        lone = (F.col("_n") == 1) & F.col("_words")
        long_ = F.transform(F.when(lone, F.array(F.lit(0))).otherwise(places), lambda i: own(i, 1, 2))
        entries = F.concat(F.transform("_at", entry), long_, F.coalesce(short, F.filter(long_, lambda _: F.lit(False))))
    else:
        entries = F.transform("_at", entry)
    rows = rows.select("doc_id", "_text", F.explode(entries).alias("_e"))
    return rows.select("doc_id", "_text", F.col("_e.gram").alias("_gram"), F.col("_e.runs").alias("_runs"))


def later_runs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, _text and _later: first line and number of lines of all runs that occur earlier."""
    marks = durable(fingerprints(docs, gram, window, long_words))
    repeated = marks.groupBy("_gram").agg(F.count("*").alias("_c")).where("_c > 1").select("_gram")
    runs = marks.join(repeated, "_gram").select("doc_id", "_text", F.explode("_runs").alias("_r"))
    runs = runs.select("doc_id", "_text", F.col("_r.start").alias("_s"), F.col("_r.lines").alias("_m"), F.col("_r.a").alias("_a"), F.col("_r.b").alias("_b"))
    runs = durable(runs)
    place = F.struct("doc_id", "_text", "_s")
    first = runs.groupBy("_a", "_b").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where(~F.col("_first").eqNullSafe(F.col("_last")))
    later = runs.join(first.drop("_last"), ["_a", "_b"]).where(~place.eqNullSafe(F.col("_first")))
    return later.groupBy("doc_id", "_text").agg(F.collect_set(F.struct(F.col("_s").alias("s"), F.col("_m").alias("m"))).alias("_later"))


def without_repeats(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """For every row: doc_id, text, kept_text, n_lines, n_removed and n_runs (maximal removed runs)."""
    found = later_runs(docs, gram, window, long_words).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), "_later")
    rows = docs.select("doc_id", "text").withColumn("_text", F.xxhash64("text"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left").withColumn("_l", _lines(F.col("text")))
    gone = F.array_distinct(F.flatten(F.transform("_later", lambda r: F.sequence(r["s"], r["s"] + r["m"] - 1))))
    rows = rows.withColumn("_gone", F.when(F.col("_later").isNotNull(), gone))
    left = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), F.col("_gone"))
    kept = F.array_join(F.transform(left, lambda i: F.element_at("_l", i + 1)), "\n")
    runs = F.size("_gone") - F.size(F.array_intersect("_gone", F.transform("_gone", lambda i: i + 1)))
    return rows.select(
        "doc_id",
        "text",
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("_l")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
        F.when(F.col("_gone").isNull(), 0).otherwise(runs).cast("long").alias("n_runs"),
    )


_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, pos, line, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, l1, l2 ORDER BY doc_id, pos) > 1 AS again FROM r WHERE l2 IS NOT NULL),
short AS (SELECT doc_id, len(string_split(text, chr(10))) AS lines, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS again FROM documents
  WHERE len(string_split(text, chr(10))) < 3 AND regexp_matches(text, '[^\\x20\\x09-\\x0D]')),
single AS (SELECT l.doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY l.doc_id, pos) > 1 AS again FROM l LEFT JOIN short ON short.doc_id = l.doc_id AND lines = 1
  WHERE lines = 1 OR len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 50),
g AS (SELECT l.doc_id, l.pos, l.line, greatest(coalesce(single.again, false)::INT, coalesce(short.again AND lines = 2, false)::INT,
    max(coalesce(f.again, false)::INT) OVER (PARTITION BY l.doc_id ORDER BY l.pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS gone
  FROM l LEFT JOIN f USING (doc_id, pos) LEFT JOIN single USING (doc_id, pos) LEFT JOIN short USING (doc_id)),
e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 AS begins FROM g),
k AS (SELECT doc_id, count(*) AS n_lines, sum(gone)::BIGINT AS n_removed, count(*) FILTER (WHERE begins) AS n_runs, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone = 0), '') AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)"""


@query("op1_winnowed_lines", _SQL)
def _(spark, sf_dir):
    kept = F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_runs", kept)
