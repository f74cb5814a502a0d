"""Similarity join of documents on their sets of word shingles, and the groups its links make.

Two documents link when their sets' intersection is at least ``least`` hundredths of their union. Documents with equal
sets become one node first. Shingles are ordered rarest first: by a table of 2**TABLE counts over all shingles of the corpus, then by hash.
(The table makes common shingles come late. Any order gives the same links; a better one gives fewer candidates.) A
linked pair shares a shingle among the first n - ceil(least * n / 100) + 1 of each, the prefixes, on which nodes are joined.

A bucket of a shingle can hold very many near copies, so pairs come in steps, and no bucket is expanded into all its pairs:

1. The head of a bucket is the node in which its shingle comes earliest: the one with the fewest rarer shingles, so the likeliest
   to resemble all others. Every node is compared with the head it meets in most buckets; the links make first components: one comparison for a node, and large
   groups are left in few components.
2. Pairs that are not yet in one component, and that meet in a prefix of the longer and the first n - ceil(2 * least * n / (100 + least)) + 1
   shingles of the shorter set, are listed, if they can link by size (length filter), by the places of the common
   shingle (positional filter) and by the common shingles of the whole prefixes. All of them are compared.

A comparison bounds the intersection by parts of the sorted sets (suffix filter), then counts it, once for each pair. Pairs
within a component need none, as they cannot change the groups.

Nulls: a null or empty text has no shingles, links with nothing and is its own group. A null id counts as no id when the
smallest of a group is taken. Rows with equal ids are rows of their own, linked if their texts are. An empty table gives an
empty result. Fewer words than a shingle has make one shingle of the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.llm.common import Words, byte_codes, mixed, packed, query, released, table, text_slices
from playtrace.llm.components import components
from playtrace.session import durable

WORDS, LEAST, TABLE = 5, 80, 22
_BLOCK = 1 << 16

_CODES = byte_codes(3)
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of all shingles, with repeats, in the order of the texts."""
    w = Words(texts, _CODES)
    first, h = w.grams(words)
    doc = w.doc[first]
    count = np.bincount(w.doc, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        begin = np.searchsorted(w.doc, short)
        extra = np.array([int(count[d]) for d in short], np.uint64)
        for k in range(int(count[short].max())):
            on = count[short] > k
            extra[on] = mixed(extra[on] * np.uint64(0xD6E8FEB86659FD93) + w.hash[begin[on] + k])
        doc, h = np.concatenate([doc, short]), np.concatenate([h, extra])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def _count(words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                np.add.at(total, (shingles(texts, words)[1] >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        yield from _blocks({k: part for k, part in enumerate(total.reshape(-1, min(_BLOCK, len(total)))) if part.any()})

    return released(run)


def _blocks(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, part in parts.items():
        kind = np.min_scalar_type(int(part.max()))
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([kind.itemsize], pa.int32()), pa.array([pa.compress(part.astype(kind).tobytes(), "zstd", asbytes=True)], pa.binary())], ["block", "width", "counts"])


def _add(size: int):
    """Sum the tables of counts in a partition, block by block, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, width, data in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(pa.decompress(data, size * width, "zstd", asbytes=True), f"u{width}")
                sums[k] = sums.get(k, 0) + part.astype(np.int64)
        yield from _blocks(sums)

    return run


def rarity(docs: DataFrame, words: int, bits: int = TABLE) -> np.ndarray:
    """For every hash range a class from 0 (rare) to 255: four for each doubling of its count. The driver gets 2**bits counts, whatever the corpus."""
    size, schema = min(_BLOCK, 1 << bits), "block int, width int, counts binary"
    tables = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_count(words, bits), schema)
    tables = tables.withColumn("_salt", F.spark_partition_id() % 64).repartition("block", "_salt").drop("_salt").mapInArrow(_add(size), schema)
    total = np.zeros(1 << bits, np.int64)
    for k, width, data in tables.repartition("block").mapInArrow(_add(size), schema).collect():
        total[k * size : (k + 1) * size] = np.frombuffer(pa.decompress(bytes(data), size * width, "zstd", asbytes=True), f"u{width}")
    return np.minimum(255, 4 * np.log2(total + 1)).astype(np.uint8)


def token_sets(texts: list[bytes], words: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as numbers that sort rarest first, and where each text's begin (and end)."""
    doc, h = shingles(texts, words)
    shift = np.uint64(64 - (len(classes).bit_length() - 1))
    token = (classes[(h >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(55)) | (h >> np.uint64(9))
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    doc, token = doc[fresh], token[fresh]
    return token.view(np.int64), np.searchsorted(doc, np.arange(len(texts) + 1))


def prefix_length(n, least: int):
    return n - -(-least * n // 100) + 1


def _prefixes(words: int, least: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                token, bounds = token_sets(texts, words, shared.value)
                n = np.diff(bounds)
                length = np.where(n > 0, prefix_length(n, least), 0)
                ends = np.cumsum(length)
                take = np.arange(ends[-1]) + np.repeat(bounds[:-1] - (ends - length), length)
                digest = [hashlib.blake2b(token[i:j].tobytes(), digest_size=16).digest() if j > i else None for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(token[take]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("_text")[a:b], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), prefix], ["doc_id", "_text", "n", "digest", "prefix"])

    return released(run)


def _needed(n, m, least: int):
    """The smallest intersection of sets of n and m members that makes a link."""
    return -(-least * (n + m) // (100 + least))


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 2) -> int:
    """At least the intersection of two sorted sets: both are parted by a member of the middle, over and over."""
    if not depth or not len(a) or not len(b):
        return min(len(a), len(b))
    i = len(a) // 2
    j = int(np.searchsorted(b, a[i]))
    return suffix_bound(a[:i], b[:j], depth - 1) + suffix_bound(a[i:], b[j:], depth - 1)


def linked(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    need = _needed(len(a), len(b), least)
    return suffix_bound(a, b) >= need and len(np.intersect1d(a, b, assume_unique=True)) >= need


def _verify(words: int, least: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, j, one, two in text_slices(batch.column("text_a"), batch.column("text_b")):
                token, at = token_sets(one + two, words, shared.value)
                n = j - i
                keep += [linked(token[at[k] : at[k + 1]], token[at[n + k] : at[n + k + 1]], least) for k in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return released(run)


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, least: int, shared) -> DataFrame:
    """The pairs (a, b) that link. Only texts of nodes in pairs are gathered."""
    ids = pairs.select(F.col("a").alias("nid")).union(pairs.select("b")).distinct()
    keys = nodes.select("nid", F.col("doc_id").alias("_d"), F.col("_text").alias("_t")).join(ids, "nid", "leftsemi")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("_h"))
    texts = rows.join(keys, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t"))).select("nid", "text")
    texts = durable(texts.dropDuplicates(["nid"]))
    side = [texts.select(F.col("nid").alias(k), F.col("text").alias(f"text_{k}")) for k in ("a", "b")]
    return durable(pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify(words, least, shared), "a long, b long"))


def _merged(facts: DataFrame, links: DataFrame) -> DataFrame:
    """facts (nid, comp, ...) with components joined by links between nodes."""
    comp = [facts.select(F.col("nid").alias(k), F.col("comp").alias(f"_{k}")) for k in ("a", "b")]
    edges = links.join(comp[0], "a").join(comp[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    new = components(edges).select(F.col("id").alias("comp"), F.col("comp").alias("_new"))
    return durable(facts.join(new, "comp", "left").withColumn("comp", F.coalesce("_new", "comp")).drop("_new"))


def _undecided(met: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows of met, with facts, whose bucket holds several components."""
    meet = met.join(facts, "nid")
    several = meet.groupBy("token").agg(F.min("comp").alias("_l"), F.max("comp").alias("_h")).where("_l < _h").select("token")
    return durable(meet.join(several, "token", "leftsemi"))


def _favourites(meetings: DataFrame) -> DataFrame:
    """(a, b): each node with the one head it meets in most buckets."""
    often = meetings.groupBy("nid", "head").agg(F.count("*").alias("c"))
    return often.groupBy("nid").agg(F.max(F.struct("c", "head")).alias("m")).select(F.col("nid").alias("a"), F.col("m.head").alias("b"))


def keyed_groups(docs: DataFrame, words: int = WORDS, least: int = LEAST, bits: int = TABLE) -> DataFrame:
    """As groups, and _comp: the number of the component, null without shingles. Components without a link can share a component_id, never a _comp."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity(docs, words, bits))
    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("_text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = durable(source.mapInArrow(_prefixes(words, least, shared), f"doc_id {id_type}, _text long, n long, digest binary, prefix array<long>"))

    one = F.struct("doc_id", "_text", "n", "prefix")
    nodes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min(one).alias("_one"), F.min("doc_id").alias("low"))
    nodes = durable(nodes.select("digest", "low", "_one.*").withColumn("nid", F.monotonically_increasing_id()))
    entries = nodes.select("nid", F.posexplode("prefix").alias("pos", "token"))
    heads = entries.groupBy("token").agg(F.min(F.struct("pos", "nid")).alias("_h"), F.min("nid").alias("_l"), F.max("nid").alias("_g"))
    heads = heads.where("_l < _g").select("token", F.col("_h.nid").alias("head"))
    met = durable(entries.join(heads, "token"))

    # step 1: each node with the head it meets most often
    stars = _favourites(met.where("nid <> head"))
    n = F.col("n")
    indexed = n - F.ceil(2 * least * n / F.lit(100 + least)) + 1  # of the shorter set of a pair so many shingles do
    facts = nodes.select("nid", "n", indexed.alias("indexed"), F.size("prefix").alias("p"), F.element_at("prefix", -1).alias("last"), F.col("nid").alias("comp"))
    facts = _merged(facts, _links(durable(stars), nodes, docs, words, least, shared))
    # step 2: all pairs of different components that can still link; y is the shorter set, x the longer
    meet = _undecided(met.drop("head"), facts)
    # with anyone of another component a node has at most so many prefix shingles in common
    meet = meet.join(meet.groupBy("nid").agg(F.count("*").alias("most")), "nid")
    carried = ("n", "pos", "p", "last", "most")
    y = meet.where("pos < indexed").select("token", "comp", F.col("nid").alias("b"), *[F.col(c).alias(f"{c}_b") for c in carried])
    others = y.groupBy("token", "comp").agg(F.min("n_b").alias("_low"), F.max("n_b").alias("_high")).withColumnsRenamed({"token": "_token", "comp": "_comp"})
    x = meet.join(others, (F.col("token") == F.col("_token")) & (F.col("_comp") != F.col("comp")) & (F.col("_low") <= n) & (F.col("_high") * 100 >= n * least))
    x = x.select("token", F.col("_comp").alias("comp"), F.col("nid").alias("a"), *[F.col(c).alias(f"{c}_a") for c in carried])
    sizes = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a")))
    sizes = sizes & (100 * F.col("n_b") >= least * F.col("n_a"))
    need = F.ceil(least * (F.col("n_a") + F.col("n_b")) / F.lit(100 + least))
    # no more than the smaller number before the common shingle, itself, and the smaller number behind it
    places = F.least("pos_a", "pos_b") + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= need
    # common shingles of the prefixes, and at most all behind the prefix that ends first
    behind = F.when(F.col("last_a") <= F.col("last_b"), F.col("n_a") - F.col("p_a")).otherwise(F.col("n_b") - F.col("p_b"))
    least_common = need - behind
    enough = F.least("most_a", "most_b") >= least_common
    # so the first common one leaves room for the rest in both prefixes
    room = (F.col("pos_a") + least_common <= F.col("p_a")) & (F.col("pos_b") + least_common <= F.col("p_b"))
    pairs = x.join(y, ["token", "comp"]).where(sizes & places & enough & room)
    pairs = durable(pairs.select("a", "b", least_common.alias("need")).distinct())
    prefixes = [nodes.select(F.col("nid").alias(k), F.col("prefix").alias(f"prefix_{k}")) for k in ("a", "b")]
    pairs = pairs.join(prefixes[0], "a").join(prefixes[1], "b")
    pairs = durable(pairs.where(F.size(F.array_intersect("prefix_a", "prefix_b")) >= F.col("need")).select("a", "b"))
    facts = _merged(facts, _links(pairs, nodes, docs, words, least, shared))
    comp = facts.select("nid", "comp")
    named = durable(nodes.select("nid", "digest", "low").join(comp, "nid"))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "comp").select("digest", "component_id", F.col("comp").alias("_comp"))
    result = rows.select("doc_id", "_text", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    return result.select("doc_id", "_text", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "_comp")


def groups(docs: DataFrame, words: int = WORDS, least: int = LEAST, bits: int = TABLE) -> DataFrame:
    """For every row: doc_id, _text (hash of the text), n_shingles and component_id, the smallest id its links reach."""
    return keyed_groups(docs, words, least, bits).drop("_comp")


def one_of_each(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """docs with one row of each group, the one of smallest (doc_id, hash of the text); documents without words all stay."""
    found = durable(keyed_groups(docs, words, least))
    place = F.struct("doc_id", "_text")
    first = found.where("n_shingles > 0").groupBy("_comp").agg(F.min(place).alias("_p")).select(F.col("_p.doc_id").alias("_d"), F.col("_p._text").alias("_t"), F.lit(True).alias("_first"))
    alone = found.where("n_shingles = 0").select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), F.lit(False).alias("_first")).distinct()
    rows, back = packed(docs, ["doc_id", "text"])
    rows = rows.withColumn("_h", F.xxhash64("text")).join(first.unionByName(alone), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")))
    copies = Window.partitionBy("_d", "_t").orderBy(F.lit(1))  # rows that are the same in id and text
    rows = rows.withColumn("_copy", F.row_number().over(copies)).where("_copy = 1 OR NOT _first")
    return rows.select(*back.values())


@query("op3_ngram_jaccard")
def _(spark, sf_dir):
    return groups(table(spark, sf_dir, "documents"), words=4, least=85).drop("_text")
