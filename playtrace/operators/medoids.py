"""The member of a cluster with the least total distance to all members, exactly, without a table of all pairs.

Rows named ``profile`` stand for ``weight`` equal sessions; ``part`` is a cluster.

* Cosine: with vectors of length one, the total follows from the sum vector of the cluster.
* Manhattan: the total is a sum over features, and each feature's follows from running sums over its sorted values.
* Euclidean, Jensen-Shannon and edit distance: bounds from pivots. By the triangle inequality a member's total is at least
  the sum over groups of members of |group weight * distance to the pivot - the group's total distance to the pivot|.
  Members of the least bounds and drawn ones are compared with their whole cluster, in numpy, a block of members against a chunk of them at a time. Their totals bound those of the members near
  them, some of them become pivots, and the search ends when no bound is below the best total. Texts of a cluster are all compared in the first step, up to
  TEXTS times as many as vectors. In many dimensions bounds are
  weak and most members are compared, but never more than a batch at once. Every measure here is a metric, but for the edit distance over the longer length: there the
  plain edit distance makes the bounds, in groups of alike length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.operators import ordered
from playtrace.session import durable

BATCH = 96  # members of a cluster of least bounds, and as many drawn ones, compared in the first step
GROWTH = 8  # times as many in each further step
BLOCK, CHUNK = 2048, 512  # members, and others, whose distances a task computes together
TEXTS = 256  # times as many texts in the first step: bounds leave few of them out, and a distance costs little
TEXT_CHUNK = 2048  # texts of a chunk, so that more of them begin alike
KEPT = 1 << 25  # bytes of columns of edit distances that a task holds
PIVOTS = 16  # drawn members of a step that become pivots
BINS = 16  # groups of a pivot's distances in a range of one
DIGITS = 9  # means are compared to so many digits, as sums have no fixed order
PART = ["game_id", "part"]


def flat_vectors(points: pa.Array, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points (lists of feature and value) as three flat arrays: row, feature's number, value."""
    flat = points.flatten()
    codes = flat.field("feature").dictionary_encode()
    number = np.array([place.setdefault(f, len(place)) for f in codes.dictionary.to_pylist()], np.int64)
    rows = np.repeat(np.arange(len(points)), np.diff(points.offsets.to_numpy()))
    return rows, number[codes.indices.to_numpy(zero_copy_only=False)], flat.field("value").to_numpy(zero_copy_only=False)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.where(x > 0, x, 1.0))


def _vector_distances(measure: str, members: pa.Array, others: pa.Array) -> Iterator[np.ndarray]:
    """For each other vector its distances to all members; only the features of the other one are looked at."""
    place: dict[str, int] = {}
    (row, feature, value), (at, own, have) = flat_vectors(members, place), flat_vectors(others, place)
    table = np.zeros((len(place), len(members)))
    table[feature, row] = value
    total, square = np.bincount(row, value, len(members)), np.bincount(row, value * value, len(members))
    entropic = measure == "jensenshannon"
    if entropic:
        table = np.divide(table, total, out=table, where=total > 0)
        logs = _xlogx(table)
    ends = np.searchsorted(at, np.arange(len(others) + 1))
    for i in range(len(others)):
        f, v = own[ends[i] : ends[i + 1]], have[ends[i] : ends[i + 1]]
        x = table[f]
        if entropic:
            q = (v / v.sum())[:, None]
            both = x + q
            js = 0.5 * (logs[f] + _xlogx(q) - both * np.log(both / 2)).sum(0) + 0.5 * np.log(2.0) * (1 - x.sum(0))
            yield np.sqrt(np.maximum(0.0, js) / np.log(2.0))
        elif measure == "manhattan":
            yield np.maximum(0.0, total + v.sum() - 2 * np.minimum(x, v[:, None]).sum(0))
        else:
            dot, n2 = v @ x, (v * v).sum()
            if measure == "euclidean":
                yield np.sqrt(np.maximum(0.0, square + n2 - 2 * dot))
            else:
                length = np.sqrt(square) * np.sqrt(n2)
                yield np.maximum(0.0, 1 - np.divide(dot, length, out=np.zeros(len(dot)), where=length > 0))


def _signs(texts: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in texts.to_pylist()]


def _next_column(column: list[tuple], masks: list[np.ndarray], top: int) -> list[tuple]:
    """The next column of the usual table of edit distances, for many texts at once: Myers' bit vectors, in words.

    A word holds, for some signs of each member, where the column steps up and where it steps down; what leaves a word at its
    top goes into the next one. The first row of the table grows by one with every column.
    """
    out, plus, minus = [], 1, 0
    for (up, down), same in zip(column, masks):
        if out:  # members that have ended are left out
            plus, minus = plus[: len(up)], minus[: len(up)]
        vertical = same | down
        same = same | minus
        flat = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(flat | up), up & flat
        after = rise >> top, fall >> top
        rise, fall = (rise << 1) | plus, (fall << 1) | minus
        out.append((fall | ~(vertical | rise), rise & vertical))
        plus, minus = after
    return out


def edit_distances(members: list[np.ndarray], others: list[np.ndarray]) -> list[np.ndarray]:
    """For each other text (numbers of signs) its edit distances to all members.

    Members go by length, longest first. Others go in order, so one that begins like the one before starts from the column behind
    what both share; columns of KEPT bytes at most are held.
    """
    size = np.array([len(x) for x in members], np.int64)
    order = np.argsort(-size, kind="stable")
    wide = max(1, int(size.max(initial=0)))
    bits = next((b for b in (8, 16, 32) if wide <= b), 64)
    kind = np.dtype(f"u{bits // 8}")
    flat = np.concatenate([members[i] for i in order] or [np.zeros(0, np.uint32)])
    row = np.repeat(np.arange(len(order)), size[order])
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size[order]) - size[order], size[order])
    by = np.argsort(flat, kind="stable")
    signs, first = np.unique(flat[by], return_index=True)
    places = dict(zip(signs.tolist(), np.split(by, first[1:])))
    left = [int((size > w).sum()) for w in range(0, wide, bits)]

    def words(some: np.ndarray) -> list[np.ndarray]:
        """A bit for each of some signs of the members."""
        table = np.zeros((len(left), len(order)), kind)
        np.bitwise_or.at(table, (at[some] // bits, row[some]), kind.type(1) << (at[some] % bits).astype(kind))
        return [t[:n] for t, n in zip(table, left)]

    there = words(np.arange(len(flat)))
    none = [np.zeros(n, kind) for n in left]
    held = max(1, KEPT // max(1, 2 * sum(x.nbytes for x in none)))
    masks: dict[int, list[np.ndarray]] = {}
    sequences = [tuple(x.tolist()) for x in others]
    found: list[np.ndarray] = [np.zeros(0)] * len(others)
    columns, before = [[(~n, n) for n in none]], ()
    for i in sorted(range(len(others)), key=sequences.__getitem__):
        own = sequences[i]
        shared = next((j for j, (a, b) in enumerate(zip(own, before)) if a != b), min(len(own), len(before)))
        del columns[min(shared, held - 1) + 1 :]
        column = columns[-1]
        for j in range(len(columns) - 1, len(own)):
            mask = masks.get(own[j])
            if mask is None:
                mask = words(places[own[j]]) if own[j] in places else none
                if len(masks) < held:
                    masks[own[j]] = mask
            column = _next_column(column, mask, bits - 1)
            if len(columns) == j + 1 < held:
                columns.append(column)
        before = own
        d = np.full(len(order), len(own), np.int64)
        for (up, down), bit in zip(column, there):
            d[: len(up)] += np.bitwise_count(up & bit)
            d[: len(up)] -= np.bitwise_count(down & bit)
        found[i] = np.empty(len(order), np.int32)
        found[i][order] = d
    return found


def _edit_distances(members: pa.Array, others: pa.Array) -> Iterator[np.ndarray]:
    """For each other text its edit distances to all members."""
    return (d.astype(float) for d in edit_distances(_signs(members), _signs(others)))


class Pairs:
    """Distances within parts, on Arrow batches: blocks of members against chunks of others of the same part, so no task holds a whole part.

    points: game_id, profile, point; distances: members' points, others' points -> for each other, its distances to the members.
    chunk: others of a chunk; first: times BATCH, members compared in a search's first step.
    """

    def __init__(self, points: DataFrame, distances: Callable[[pa.Array, pa.Array], Iterator[np.ndarray]], chunk: int = CHUNK, first: int = 1):
        self.points, self.distances, self.chunk, self.first = points, distances, chunk, first

    def __call__(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """(game_id, part, profile), (game_id, part, other) -> (game_id, part, profile, other, raw) for all pairs of one part."""
        return self._run(self.blocks(left), self._chunks(right.select(*PART, "other"), []), _rows, "profile string, other string, raw double")

    def blocks(self, members: DataFrame) -> DataFrame:
        """Members of a part in blocks: game_id, part, and a list of their other columns and points."""
        if "point" not in members.columns:
            members = members.join(self.points, ["game_id", "profile"])
        return grouped(members, "profile", BLOCK, "_members")

    def to_few(self, blocks: DataFrame, few: DataFrame) -> DataFrame:
        """(game_id, profile, weight, len, point, near) for all members of blocks; near: tag, _len and raw, its distance to each of the few (game_id, other, tag, _len) of its game."""
        named = self.points.select("game_id", F.col("profile").alias("other"), "point")
        each = few.join(named, ["game_id", "other"]).groupBy("game_id").agg(F.collect_list(F.struct("tag", "_len", "point")).alias("_few"))
        distances, kind = self.distances, self.points.schema["point"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    members, others = (batch.column(c).slice(i, 1).flatten() for c in ("_members", "_few"))
                    n, k = len(members), len(others)
                    raw = np.stack(list(distances(members.field("point"), others.field("point")))).T.ravel()
                    tag, size = (np.tile(others.field(c).to_numpy(zero_copy_only=False), n) for c in ("tag", "_len"))
                    near = pa.StructArray.from_arrays([pa.array(tag, pa.int32()), pa.array(size, pa.int32()), pa.array(raw, pa.float64())], ["tag", "_len", "raw"])
                    near = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), near)
                    own = [members.field(c) for c in ("profile", "weight", "len", "point")]
                    yield pa.RecordBatch.from_arrays([pa.array(batch.column("game_id").slice(i, 1).to_pylist() * n, pa.string()), *own, near], ["game_id", "profile", "weight", "len", "point", "near"])

        schema = f"game_id string, profile string, weight long, len int, point {kind}, near array<struct<tag: int, _len: int, raw: double>>"
        return blocks.join(each, "game_id").select("game_id", "_members", "_few").mapInArrow(run, schema)

    def _chunks(self, others: DataFrame, extra: list[str]) -> DataFrame:
        named = self.points.select("game_id", F.col("profile").alias("other"), "point")
        return grouped(others.select(*PART, "other", *extra).join(named, ["game_id", "other"]), "other", self.chunk, "_others")

    def totals(self, blocks: DataFrame, others: DataFrame) -> DataFrame:
        """(game_id, part, other, total, compared): the weighted total of the others (game_id, part, other, _len) to all members of their part."""
        parts = self._run(blocks, self._chunks(others, ["_len"]), _part_totals, "other string, _t double, _n long")
        return parts.groupBy(*PART, "other").agg(F.sum("_t").alias("_total"), F.sum("_n").alias("_compared"))

    def around(self, blocks: DataFrame, others: DataFrame) -> DataFrame:
        """(game_id, part, profile, low): the largest _total - _all * distance over the others (game_id, part, other, _total, _all)."""
        parts = self._run(blocks, self._chunks(others, ["_total", "_all"]), _part_lows, "profile string, low double")
        return parts.groupBy(*PART, "profile").agg(F.max("low").alias("low"))

    def _run(self, blocks: DataFrame, chunks: DataFrame, reduce_: Callable, schema: str) -> DataFrame:
        distances = self.distances

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    game, part, members, others = (batch.column(c).slice(i, 1) for c in ("game_id", "part", "_members", "_others"))
                    members, others = members.flatten(), others.flatten()
                    for out in reduce_(distances(members.field("point"), others.field("point")), members, others):
                        n = len(out[0])
                        yield pa.RecordBatch.from_arrays([pa.array(game.to_pylist() * n), pa.array(part.to_pylist() * n, pa.int32()), *out], names)

        kind = f"game_id string, part int, {schema}"
        names = [c.split()[0] for c in kind.split(", ")]
        rows = blocks.join(chunks.withColumnRenamed("_k", "_c"), PART)
        # a part is one key of the join, so its blocks and chunks are dealt out anew
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(tasks, *PART, "_k", "_c").select(*PART, "_members", "_others").mapInArrow(run, kind)


def grouped(rows: DataFrame, name: str, most: int, into: str) -> DataFrame:
    """Rows of a part in groups of about ``most``, each as a list of structs, numbered _k."""
    counts = rows.groupBy(*PART).agg(F.ceil(F.count("*") / F.lit(most)).alias("_k"))
    dealt = rows.join(counts, PART).withColumn("_k", F.pmod(F.xxhash64(name), "_k"))
    fields = F.struct(*[c for c in rows.columns if c not in PART])
    return dealt.groupBy(*PART, "_k").agg(F.collect_list(fields).alias(into))


def _rows(distances: Iterator[np.ndarray], members: pa.StructArray, others: pa.StructArray) -> Iterator[list]:
    for other, d in zip(others.field("other").to_pylist(), distances):
        yield [members.field("profile"), pa.array([other] * len(d)), pa.array(d)]


def _part_totals(distances: Iterator[np.ndarray], members: pa.StructArray, others: pa.StructArray) -> Iterator[list]:
    weight, size = (members.field(c).to_numpy(zero_copy_only=False) for c in ("weight", "len"))
    lengths = others.field("_len").to_numpy(zero_copy_only=False)
    sums = [float((weight * (d / np.maximum(1, np.maximum(size, n)))).sum()) for d, n in zip(distances, lengths)]
    yield [others.field("other"), pa.array(sums, pa.float64()), pa.array([len(members)] * len(sums), pa.int64())]


def _part_lows(distances: Iterator[np.ndarray], members: pa.StructArray, others: pa.StructArray) -> Iterator[list]:
    low = np.full(len(members), -np.inf)
    for total, all_, d in zip(others.field("_total").to_pylist(), others.field("_all").to_pylist(), distances):
        low = np.maximum(low, total - all_ * d)
    yield [members.field("profile"), pa.array(low)]


def vector_pairs(cells: DataFrame, measure: str) -> Pairs:
    """Distances of vectors (game_id, profile, feature, value)."""
    points = cells.groupBy("game_id", "profile").agg(F.collect_list(F.struct("feature", "value")).alias("point"))
    return Pairs(points, partial(_vector_distances, measure))


def text_pairs(texts: DataFrame) -> Pairs:
    """Edit distances of step strings (game_id, profile, text)."""
    return Pairs(texts.select("game_id", "profile", F.col("text").alias("point")), _edit_distances, TEXT_CHUNK, TEXTS)


def scaled(raw: Column, a: Column, b: Column) -> Column:
    """The measure itself: an edit distance counts over the longer length; vectors have length 0."""
    return raw / F.greatest(F.lit(1), a, b)


def _bounds(near: DataFrame) -> DataFrame:
    """A bound from below of every member's total: (game_id, part, profile, low), from its distances to pivots.

    near: game_id, part, profile, weight, len, other (the pivot), raw, with all members of the part for each pivot.
    """
    size = F.ceil(4 * F.log2(F.greatest(F.lit(1), F.col("len"))))
    groups = near.groupBy(*PART, "other", size.alias("_size"), F.floor(BINS * F.col("raw") / F.greatest(F.lit(1), F.col("len"))).alias("_bin")).agg(
        F.max("len").alias("len"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("raw")).alias("e")
    )
    groups = groups.groupBy(*PART, "other").agg(F.collect_list(F.struct("len", "w", "e")).alias("_g"))
    rows = near.select(*PART, "profile", "len", "other", "raw").join(groups, [*PART, "other"])
    low = F.aggregate("_g", F.lit(0.0), lambda t, g: t + scaled(F.abs(g["w"] * F.col("raw") - g["e"]), g["len"], F.col("len")))
    return rows.withColumn("_low", low).groupBy(*PART, "profile").agg(F.max("_low").alias("low"))


def _searched(members: DataFrame, near: DataFrame, pairs: Pairs) -> DataFrame:
    """(game_id, part, profile, weight, total, compared): totals of all members that can be the best; null for the others."""
    everyone = members.select(*PART, "profile")
    blocks = durable(pairs.blocks(members))
    members, batch = members.drop("point"), BATCH * pairs.first
    if pairs.first > 1 and members.groupBy(*PART).agg(F.count("*").alias("n")).where(F.col("n") > batch).isEmpty():  # one step is enough for all parts
        every = pairs.totals(blocks, members.select(*PART, F.col("profile").alias("other"), F.col("len").alias("_len")))
        found = every.select(*PART, F.col("other").alias("profile"), F.col("_total").alias("total"), F.col("_compared").alias("compared"))
        return members.withColumn("low", F.lit(0.0)).join(found, [*PART, "profile"])
    state = durable(
        members.join(_bounds(near), [*PART, "profile"]).withColumns({"total": F.lit(None).cast("double"), "compared": F.lit(None).cast("long")})
    )
    while True:
        best = state.groupBy(*PART).agg(F.min("total").alias("best"), F.sum("weight").alias("all"))
        able = F.col("total").isNull() & (F.col("best").isNull() | (F.col("low") <= F.col("best") + F.col("all") * 10.0 ** (1 - DIGITS)))
        left = state.join(best, PART).where(able)
        least = ordered.top_k(left, PART, ["low", "profile"], batch)
        drawn = ordered.top_k(left.withColumn("_h", F.xxhash64("profile")), PART, ["_h", "profile"], batch).drop("_h")
        both = least.withColumn("pivot", F.lit(False)).unionByName(drawn.withColumn("pivot", F.col("rank") <= PIVOTS))
        tried = durable(both.groupBy(*PART, F.col("profile").alias("other")).agg(F.max("len").alias("_len"), F.max("all").alias("_all"), F.max("pivot").alias("pivot")))
        if tried.isEmpty():
            return state
        totals = durable(tried.select(*PART, "other", "_all", "_len", "pivot").join(pairs.totals(blocks, tried), [*PART, "other"]))
        found = totals.select(*PART, F.col("other").alias("profile"), "_total", "_compared")
        state = state.join(found, [*PART, "profile"], "left")
        # bounds are only of use in parts with members left that no step has tried
        open_ = state.where("total IS NULL AND _total IS NULL").select(*PART).distinct()
        some = durable(totals.join(open_, PART, "left_semi"))
        if some.isEmpty():
            return state.select(*members.columns, "low", F.coalesce("total", "_total").alias("total"), F.coalesce("compared", "_compared").alias("compared"))
        pivots = pairs(everyone, some.where("pivot").select(*PART, "other")).join(members, [*PART, "profile"])
        # of vectors, also: a total differs by no more than the distance times all weights
        around = pairs.around(blocks, some.where("_len = 0"))
        bounds = _bounds(pivots).unionByName(around).groupBy(*PART, "profile").agg(F.max("low").alias("_low"))
        state = durable(
            state.join(bounds, [*PART, "profile"], "left").select(
                *members.columns, F.greatest("low", "_low").alias("low"), F.coalesce("total", "_total").alias("total"), F.coalesce("compared", "_compared").alias("compared")
            )
        )
        batch *= GROWTH


def _cosine_totals(members: DataFrame, cells: DataFrame) -> DataFrame:
    length = cells.groupBy("game_id", "profile").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_n"))
    unit = cells.join(length, ["game_id", "profile"]).join(members, ["game_id", "profile"]).withColumn("u", F.col("value") / F.col("_n"))
    sums = unit.groupBy(*PART, "feature").agg(F.sum(F.col("weight") * F.col("u")).alias("_s"))
    near = unit.join(sums, [*PART, "feature"]).groupBy(*PART, "profile", "weight").agg(F.sum(F.col("u") * F.col("_s")).alias("_dot"))
    every = members.groupBy(*PART).agg(F.sum("weight").alias("_all"))
    return near.join(every, PART).select(*PART, "profile", "weight", (F.col("_all") - F.col("_dot")).alias("total"), F.lit(0).cast("long").alias("compared"))


def _manhattan_totals(members: DataFrame, cells: DataFrame) -> DataFrame:
    own = cells.join(members, ["game_id", "profile"])
    every = members.groupBy(*PART).agg(F.sum("weight").alias("_all"))
    values = own.groupBy(*PART, "feature", "value").agg(F.sum("weight").alias("_w")).withColumn("_s", F.col("_w") * F.col("value"))
    # A value is a ratio of two counts of a session: a feature has at most as many values as a third of the square of the longest session.
    whole = Window.partitionBy(*PART, "feature")
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = values.select(
        *PART, "feature", "value", F.sum("_w").over(upto).alias("_wl"), F.sum("_s").over(upto).alias("_sl"), F.sum("_w").over(whole).alias("_wt")
    )
    v = F.col("value")
    # what the value costs more than 0, which members without the feature have
    per = sums.join(every, PART).withColumn("_c", v * (F.col("_all") - 2 * (F.col("_wt") - F.col("_wl"))) - 2 * F.col("_sl"))
    zero = own.groupBy(*PART).agg(F.sum(F.col("weight") * v).alias("_zero"))
    total = own.join(per.select(*PART, "feature", "value", "_c"), [*PART, "feature", "value"]).groupBy(*PART, "profile", "weight").agg(F.sum("_c").alias("_c"))
    return total.join(zero, PART).select(*PART, "profile", "weight", (F.col("_zero") + F.col("_c")).alias("total"), F.lit(0).cast("long").alias("compared"))


def totals(members: DataFrame, near: DataFrame, measure: str, pairs: Pairs, cells: DataFrame | None = None) -> DataFrame:
    """Total distance of the members that can have the least one, and with how many others each was compared.

    members: game_id, part, profile, weight, len, and maybe point; near: members with other and raw, their distances to some pivots;
    cells: the vectors, for measures that are one.
    """
    if measure == "cosine":
        return _cosine_totals(members, cells)
    if measure == "manhattan":
        return _manhattan_totals(members, cells)
    return _searched(members, near, pairs)


def best(found: DataFrame) -> DataFrame:
    """(game_id, part, profile): the least total of each part, the first profile on ties."""
    every = found.groupBy(*PART).agg(F.sum("weight").alias("_all"))
    mean = F.round(F.col("total") / F.col("_all"), DIGITS)
    least = found.join(every, PART).where(F.col("total").isNotNull()).groupBy(*PART).agg(F.min(F.struct(mean.alias("m"), "profile")).alias("b"))
    return least.select(*PART, F.col("b.profile").alias("profile"))
