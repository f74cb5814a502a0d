"""Clustering sessions by behaviour, and a network profile of every cluster.

All sessions take part. Equal vectors are one profile with a weight, named by its smallest session, and all games and
restarts go through the same rounds together. A profile is compared with the centres of its game only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.functions.scalars import round_half_up
from playtrace.operators import distance, medoids, network, ordered, sequences
from playtrace.operators.sequences import SEP, SESSION
from playtrace.session import durable

# Limits of the rounds and of the reported lists.
RESTARTS = 4
KMEANS_ROUNDS = 40
MEDOID_ROUNDS = 50
TOP_STATES = 4
SAMPLE_ROWS = 24
SAMPLE_STEPS = 60
GROUP = ("game_id", "cluster")
DIGITS = 9  # distances are compared to so many digits, as sums have no fixed order


def clamp_k(k: int | None) -> int:
    return max(2, min(8, 3 if k is None else k))


def readiness(steps: DataFrame, k: int = 3) -> DataFrame:
    """Games with too few usable sessions cannot be clustered."""
    need = max(clamp_k(k), 4)
    lengths = steps.groupBy(*SESSION).agg(F.count("*").alias("length"))
    usable = F.count_if(F.col("length") >= 2)
    return lengths.groupBy("game_id").agg(usable.alias("usable"), F.count("*").alias("total"), (usable >= need).alias("enough"))


def profiles(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(game_id, session_id, profile), the profiles' vectors, and (game_id, profile, weight, n2: squared length)."""
    whole = vectors.groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("v"))
    whole = durable(whole.withColumn("_h", F.xxhash64("v")))  # read twice; the hash spares most comparisons of lists
    # in two steps, so that a game's most common vector is never one task's work
    first = whole.groupBy("game_id", "_h", "v").agg(F.min("session_id").alias("profile"), F.count("*").alias("weight"))
    first = durable(first)
    members = whole.join(first.select("game_id", "_h", "v", "profile"), ["game_id", "_h", "v"]).select(*SESSION, "profile")
    cells = first.select("game_id", "profile", F.inline("v"))
    size = F.aggregate("v", F.lit(0.0), lambda t, x: t + x["value"] * x["value"])
    return members, cells, first.select("game_id", "profile", "weight", size.alias("n2"))


def _drawn(rows: DataFrame, step: int, share: Column) -> DataFrame:
    """(game_id, run, cluster, profile): one profile for each game and restart, with chances in proportion to share.

    The smallest of -ln(u) / share wins, with u in (0, 1) from a hash of profile, restart and step, so every run draws alike.
    """
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", "profile", F.col("run").cast("string"), F.lit(str(step)))), 1, 8), 16, 10)
    u = (digits.cast("double") + 0.5) / float(1 << 32)
    best = rows.where(share > 0).groupBy("game_id", "run").agg(F.min(F.struct((-F.log(u) / share).alias("key"), "profile")).alias("m"))
    return best.select("game_id", "run", F.lit(step).alias("cluster"), F.col("m.profile").alias("profile"))


def _seeds(facts: DataFrame, k: int, runs: int, squared: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Up to k profiles for each restart: the first drawn by weight, each further one by weight times the squared distance to the nearest before it.

    squared: from seeds (game_id, run, cluster, profile), every profile's squared distance d to those of its game.
    A game with fewer than k different profiles gets as many seeds as it has profiles.
    """
    rows = facts.select("game_id", "profile", "weight", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    seeds = durable(_drawn(rows, 0, F.col("weight")))
    near = None
    for step in range(1, k):
        d = squared(seeds.where(F.col("cluster") == step - 1)).select("game_id", "profile", "weight", "run", "d")
        if near is not None:
            d = d.unionByName(near)
        near = durable(d.groupBy("game_id", "profile", "run").agg(F.max("weight").alias("weight"), F.min("d").alias("d")))
        seeds = durable(seeds.unionByName(_drawn(near, step, F.col("weight") * F.col("d"))))
    return seeds


def _distances(cells: DataFrame, facts: DataFrame, centres: DataFrame) -> DataFrame:
    """Squared distance of every profile to every centre of its game and restart."""
    size = centres.groupBy("game_id", "run", "cluster").agg(F.sum(F.col("value") * F.col("value")).alias("c2"))
    dots = cells.join(centres.withColumnRenamed("value", "cv"), ["game_id", "feature"])
    dots = dots.groupBy("game_id", "profile", "run", "cluster").agg(F.sum(F.col("value") * F.col("cv")).alias("dot"))
    every = facts.join(size, "game_id").join(dots, ["game_id", "profile", "run", "cluster"], "left")
    d = F.greatest(F.lit(0.0), F.col("n2") - 2 * F.coalesce("dot", F.lit(0.0)) + F.col("c2"))
    return every.select("game_id", "profile", "weight", "run", "cluster", F.round(d, DIGITS).alias("d"))


def _joined(blocks: DataFrame, run: Callable, schema: str, **centres: DataFrame) -> DataFrame:
    """run(members, centres by name) on the Arrow arrays of every block; centres are a row for each game, of at most RESTARTS x 8 vectors."""
    rows = blocks
    for name, own in centres.items():
        vectors = own.groupBy("game_id", "run", "cluster").agg(F.collect_list(F.struct("feature", "value")).alias("point"))
        rows = rows.join(vectors.groupBy("game_id").agg(F.sort_array(F.collect_list(F.struct("run", "cluster", "point"))).alias(name)), "game_id")
    kind = f"game_id string, {schema}"
    names, given = [c.split()[0] for c in kind.split(", ")], list(centres)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = run(batch.column("_members").slice(i, 1).flatten(), *(batch.column(c).slice(i, 1).flatten() for c in given))
                game = pa.array(batch.column("game_id").slice(i, 1).to_pylist() * len(out[0]), pa.string())
                yield pa.RecordBatch.from_arrays([game, *out], names)

    return rows.select("game_id", "_members", *given).mapInArrow(per_batch, kind)


def _nearest_of(table: np.ndarray, n2: np.ndarray, place: dict[str, int], centres: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each restart and member: the place of its nearest centre among all centres, and the squared distance; with all centres' restarts and clusters."""
    runs, clusters = (centres.field(c).to_numpy(zero_copy_only=False) for c in ("run", "cluster"))
    at, feature, value = medoids.flat_vectors(centres.field("point"), place)
    dense = np.zeros((len(centres), len(place)))
    dense[at, feature] = value
    d = n2 - 2 * (dense[:, : len(table)] @ table) + (dense * dense).sum(1)[:, None]
    d = np.floor(np.maximum(0.0, d) * 10.0**DIGITS + 0.5) / 10.0**DIGITS
    own = [np.flatnonzero(runs == r) for r in np.unique(runs)]  # by cluster, so the first of equal distances wins
    best = np.stack([k[np.argmin(d[k], axis=0)] for k in own])
    return best, np.take_along_axis(d, best, axis=0), runs, clusters


def _members_of(members: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    place: dict[str, int] = {}
    row, feature, value = medoids.flat_vectors(members.field("point"), place)
    table = np.zeros((len(place), len(members)))
    table[feature, row] = value
    return table, *(members.field(c).to_numpy(zero_copy_only=False) for c in ("weight", "n2")), place


def _round(members: pa.StructArray, centres: pa.StructArray, before: pa.StructArray) -> list[pa.Array]:
    """Sums of a block for the next centres: weight times value by restart, cluster and feature; without feature the weight, and how many members moved."""
    table, weight, n2, place = _members_of(members)
    names = list(place)
    best, _, runs, clusters = _nearest_of(table, n2, dict(place), centres)
    old, _, _, old_clusters = _nearest_of(table, n2, dict(place), before)
    moved = (clusters[best] != old_clusters[old]).sum(1)
    out = []
    for i, own in enumerate(best):
        for k in np.unique(own):
            w = np.where(own == k, weight, 0)
            out.append((runs[k], clusters[k], None, float(w.sum()), int(moved[i])))
            sums = table @ w
            out += [(runs[k], clusters[k], names[f], float(sums[f]), 0) for f in np.flatnonzero(sums)]
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int64())
    return [pa.array([None if x is None else x for x in c], t) for c, t in zip(zip(*out), kinds)]


def _assigned(members: pa.StructArray, centres: pa.StructArray) -> list[pa.Array]:
    table, weight, n2, place = _members_of(members)
    best, d, runs, clusters = _nearest_of(table, n2, place, centres)
    n = len(best)
    return [
        pa.array(members.field("profile").to_pylist() * n, pa.string()), pa.array(runs[best].ravel(), pa.int32()),
        pa.array(np.tile(weight, n), pa.int64()), pa.array(clusters[best].ravel(), pa.int32()), pa.array(d.ravel()),
    ]


def _means(sums: DataFrame) -> DataFrame:
    """The weighted mean vector of each cluster, from the sums of a round."""
    key = ["game_id", "run", "cluster"]
    total = sums.where("feature IS NULL").groupBy(*key).agg(F.sum("s").alias("total"))
    whole = sums.where("feature IS NOT NULL").groupBy(*key, "feature").agg(F.sum("s").alias("s"))
    return whole.join(total, key).select(*key, "feature", (F.col("s") / F.col("total")).alias("value"))


def _best_run(assigned: DataFrame, cost: str) -> DataFrame:
    """The restart of least total cost of every game."""
    costs = assigned.groupBy("game_id", "run").agg(F.round(F.sum(F.col("weight") * F.col(cost)), 6).alias("c"))
    return costs.groupBy("game_id").agg(F.min(F.struct("c", "run")).alias("m")).select("game_id", F.col("m.run").alias("run"))


def kmeans(vectors: DataFrame, k: int = 3, restarts: int = RESTARTS, rounds: int = KMEANS_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(game_id, session_id, cluster) for every session, and the squared error sse of every game; the best restart wins."""
    k = clamp_k(k)
    members, cells, facts = profiles(vectors)
    cells = durable(cells)
    at = lambda seeds: cells.join(seeds, ["game_id", "profile"]).select("game_id", "run", "cluster", "feature", "value")
    centres = durable(at(_seeds(facts, k, restarts, lambda seeds: _distances(cells, facts, at(seeds)))))
    points = cells.groupBy("game_id", "profile").agg(F.collect_list(F.struct("feature", "value")).alias("point"))
    whole = facts.join(points, ["game_id", "profile"]).withColumn("part", F.lit(0))
    blocks = durable(medoids.grouped(whole, "profile", medoids.BLOCK, "_members").drop("part"))
    step = lambda now, before: durable(_joined(blocks, _round, "run int, cluster int, feature string, s double, moved long", centres=now, before=before))
    sums = step(centres, centres)
    for _ in range(rounds):
        before, centres = centres, durable(_means(sums))
        sums = step(centres, before)
        if sums.where("moved > 0").isEmpty():
            break
    assigned = durable(_joined(blocks, _assigned, "profile string, run int, weight long, cluster int, d double", centres=centres))
    assigned = assigned.join(_best_run(assigned, "d"), ["game_id", "run"])
    sse = assigned.groupBy("game_id").agg(round_half_up(F.sum(F.col("weight") * F.col("d")), 3).alias("sse"))
    return members.join(assigned.select("game_id", "profile", "cluster"), ["game_id", "profile"]).select(*SESSION, "cluster"), sse


def k_medoids(vectors: DataFrame, measure: str = "jensenshannon", k: int = 3, rounds: int = MEDOID_ROUNDS) -> DataFrame:
    """(game_id, session_id, cluster, medoid) for every session, by one of the four measures of vectors."""
    members, cells, facts = profiles(vectors)
    cells = durable(cells)
    found = _medoids(facts.withColumn("len", F.lit(0)), measure, medoids.vector_pairs(cells, measure), cells, clamp_k(k), rounds)
    return members.join(found, ["game_id", "profile"]).select(*SESSION, "cluster", "medoid")


def edit_medoids(steps: DataFrame, k: int = 3, rounds: int = MEDOID_ROUNDS) -> DataFrame:
    """(game_id, session_id, cluster, medoid) for every session, by edit distance over the longer length; equal sequences are one profile."""
    texts = durable(distance.step_strings(steps))
    facts = durable(
        texts.groupBy("game_id", "text").agg(F.min("session_id").alias("profile"), F.count("*").alias("weight")).withColumn("len", F.length("text"))
    )
    found = _medoids(facts.drop("text"), "sequence", medoids.text_pairs(facts.select("game_id", "profile", "text")), None, clamp_k(k), rounds)
    members = texts.join(facts.select("game_id", "text", "profile"), ["game_id", "text"])
    return members.join(found, ["game_id", "profile"]).select(*SESSION, "cluster", "medoid")


def _medoids(facts: DataFrame, measure: str, pairs: medoids.Pairs, cells: DataFrame | None, k: int, rounds: int) -> DataFrame:
    """(game_id, profile, cluster, medoid): a profile joins its nearest medoid, then the member of the least total distance becomes the medoid."""
    length = facts.select("game_id", F.col("profile").alias("other"), F.col("len").alias("_len"))
    blocks = durable(pairs.blocks(facts.select("game_id", F.lit(0).alias("part"), "profile", "weight", "len")))

    def few(centres: DataFrame) -> DataFrame:
        return centres.select("game_id", F.col("profile").alias("other"), F.col("cluster").alias("tag")).join(length, ["game_id", "other"])

    def rounded(x: Column) -> Column:
        return F.round(medoids.scaled(x["raw"], F.col("len"), x["_len"]), DIGITS)

    def squared(seeds: DataFrame) -> DataFrame:
        """Of the one seed of every game."""
        d = rounded(F.col("near")[0])
        return pairs.to_few(blocks, few(seeds)).select("game_id", "profile", "weight", F.lit(0).alias("run"), (d * d).alias("d"))

    def nearest(after: bool) -> Column:
        """(d, cluster, raw) of the centres of this round (tag: cluster), or of the round before (tag: -1 - cluster), the nearest first."""
        own = F.filter("near", lambda x: x["tag"] < 0 if after else x["tag"] >= 0)
        cluster = lambda x: -1 - x["tag"] if after else x["tag"]
        return F.array_sort(F.transform(own, lambda x: F.struct(rounded(x).alias("d"), cluster(x).alias("cluster"), x["raw"].alias("raw"))))  # at most eight

    centres, before = _seeds(facts, k, 1, squared), None
    for _ in range(rounds):
        both = few(centres)
        if before is not None:
            both = both.unionByName(few(before).withColumn("tag", -1 - F.col("tag")))
        each = pairs.to_few(blocks, both).withColumns({"old": nearest(True)[0]["cluster"] if before is not None else F.lit(None).cast("int"), "near": nearest(False)})
        assigned = durable(each.withColumn("cluster", F.col("near")[0]["cluster"]))
        own = assigned.withColumn("part", F.col("cluster"))
        if before is not None:  # a cluster with the same members keeps its medoid
            changed = durable(assigned.where("cluster <> old").select("game_id", F.explode(F.array("cluster", "old")).alias("part")).distinct())
            if changed.isEmpty():
                break
            own = own.join(changed, ["game_id", "part"], "left_semi")
        rows = own.select("game_id", "part", "profile", "weight", "len")
        pivots = own.select(*rows.columns, F.explode("near").alias("n")).select(*rows.columns, F.col("n.cluster").alias("other"), F.col("n.raw").alias("raw"))
        least = medoids.best(medoids.totals(own.select(*rows.columns, "point"), pivots, measure, pairs, cells))
        new = least.select("game_id", F.lit(0).alias("run"), F.col("part").alias("cluster"), "profile")
        if before is not None:
            new = new.unionByName(centres.join(new, ["game_id", "cluster"], "left_anti"))
        centres, before = durable(new), centres
    named = centres.select("game_id", "cluster", F.col("profile").alias("medoid"))
    return assigned.select("game_id", "profile", "cluster").join(named, ["game_id", "cluster"])


def silhouette(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """Mean silhouette width per game, on squared distances, over all sessions; clusters of one are left out.

    The mean squared distance to a cluster follows from its mean vector and its mean squared length, so no pairs are made.
    """
    lengths = vectors.groupBy(*SESSION).agg(F.sum(F.col("value") * F.col("value")).alias("x2"))
    rows = lengths.join(assigned.select(*SESSION, F.col("cluster").alias("own")), SESSION)
    groups = rows.groupBy("game_id", F.col("own").alias("cluster")).agg(F.count("*").alias("n"), F.avg("x2").alias("y2"))
    member = assigned.select(*SESSION, "cluster")
    means = vectors.join(member, SESSION).groupBy("game_id", "cluster", "feature").agg(F.sum("value").alias("s"))
    means = means.join(groups.select("game_id", "cluster", "n"), ["game_id", "cluster"]).select("game_id", "cluster", "feature", (F.col("s") / F.col("n")).alias("mean"))
    dots = vectors.join(means, ["game_id", "feature"]).groupBy(*SESSION, "cluster").agg(F.sum(F.col("value") * F.col("mean")).alias("dot"))
    d = rows.join(groups, "game_id").join(dots, [*SESSION, "cluster"], "left")
    d = d.withColumn("d", F.greatest(F.lit(0.0), F.col("x2") - 2 * F.coalesce("dot", F.lit(0.0)) + F.col("y2")))
    own = F.col("own") == F.col("cluster")
    inside = F.when(own & (F.col("n") > 1), F.col("d") * F.col("n") / (F.col("n") - 1))
    width = d.groupBy(*SESSION).agg(F.max(inside).alias("i"), F.min(F.when(~own, F.col("d"))).alias("o")).where("i IS NOT NULL AND o IS NOT NULL")
    return width.groupBy("game_id").agg(round_half_up(F.avg(F.coalesce(F.try_divide(F.col("o") - F.col("i"), F.greatest("i", "o")), F.lit(0.0))), 3).alias("silhouette"))


def by_size(assigned: DataFrame) -> DataFrame:
    """Clusters relabelled 1.. from the largest down, with size and share."""
    sizes = assigned.groupBy("game_id", "cluster").agg(F.count("*").alias("size"))
    game = Window.partitionBy("game_id")  # at most eight clusters
    return sizes.select(
        "game_id",
        "cluster",
        "size",
        (F.col("size") / F.sum("size").over(game)).alias("share"),
        F.row_number().over(game.orderBy(F.desc("size"), "cluster")).alias("label"),
    )


def _grouped(steps: DataFrame, assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    member = assigned.select(*SESSION, "cluster")
    return steps.join(member, SESSION), sequences.transitions(steps).join(member, SESSION)


def profile(steps: DataFrame, assigned: DataFrame, weight: str = "probability") -> DataFrame:
    """Size, share, network size, mean length, self-loops and top states of each cluster."""
    s, tr = _grouped(steps, assigned)
    nodes = network.nodes(s, GROUP)
    stats = network.stats(nodes, network.edges(tr, weight, GROUP), GROUP)
    top = (
        ordered.top_k(nodes, list(GROUP), [F.desc("frequency"), "state"], TOP_STATES)
        .groupBy(*GROUP)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "state"))).alias("t"))
        .select(*GROUP, F.array_join(F.transform("t", lambda x: x["state"]), ", ").alias("top_states"))
    )
    return (
        by_size(assigned).join(stats, list(GROUP)).join(top, list(GROUP))
        .select(
            "game_id", "label", "size", "share", "states", "transitions", "distinct_transitions", "self_loops",
            round_half_up(F.col("events") / F.col("size"), 1).alias("avg_len"), "top_states",
        )
    )


def networks(steps: DataFrame, assigned: DataFrame, weight: str = "probability") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of every cluster's own transition network."""
    s, tr = _grouped(steps, assigned)
    return network.nodes(s, GROUP), network.edges(tr, weight, GROUP)


def sample_sequences(steps: DataFrame, assigned: DataFrame) -> DataFrame:
    """The first sessions of each cluster in session order, clipped, with their full length."""
    lengths = steps.groupBy(*SESSION).agg(F.count("*").alias("length")).join(assigned.select(*SESSION, "cluster"), SESSION)
    first = ordered.top_k(lengths, list(GROUP), ["session_id"], SAMPLE_ROWS)
    shown = steps.where(F.col("pos") < SAMPLE_STEPS).join(first, SESSION)
    return (
        shown.groupBy(*GROUP, "session_id", "rank", "length")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "type"))).alias("s"))
        .select(*GROUP, "rank", "session_id", "length", F.array_join(F.transform("s", lambda x: x["type"]), SEP).alias("path"))
    )


def cluster(steps: DataFrame, algorithm: str = "kmeans", measure: str = "jensenshannon", k: int = 3) -> DataFrame:
    """Assignment of every usable session by the chosen algorithm; games without enough sessions are left out."""
    ready = readiness(steps, k).where("enough").select("game_id")
    steps = steps.join(ready, "game_id", "left_semi").join(distance.usable(steps).select(*SESSION), SESSION, "left_semi")
    if algorithm == "kmeans":
        return kmeans(distance.vectors(steps), k)[0]
    return (edit_medoids(steps, k) if measure == "sequence" else k_medoids(distance.vectors(steps), measure, k)).drop("medoid")
