"""Markov transition networks of all games (or any other grouping) at once.

The grouping columns default to ``game_id``; cluster profiles pass ``game_id, cluster``.
Node and edge tables have one row per activity or activity pair, so they are small
however many events there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrace.functions.scalars import round_half_up
from playtrace.operators import sequences
from playtrace.session import durable

GAME = ("game_id",)
TIE = 1e-12  # path lengths closer than this are equal
DAMPING = 0.85
MAX_ROUNDS = 100


def edges(transitions: DataFrame, weight: str = "probability", by: tuple[str, ...] = GAME) -> DataFrame:
    """Edges with count, probability (count over the source's total) and weight."""
    counts = transitions.groupBy(*by, "src", "dst").agg(F.count("*").alias("count"))
    return weigh(counts, weight, by)


def weigh(counts: DataFrame, weight: str = "probability", by: tuple[str, ...] = GAME) -> DataFrame:
    source = Window.partitionBy(*by, "src")
    out = counts.withColumn("probability", F.col("count") / F.sum("count").over(source))
    return out.withColumn("weight", F.col("count").cast("double") if weight == "frequency" else F.col("probability"))


def nodes(steps: DataFrame, by: tuple[str, ...] = GAME) -> DataFrame:
    """States with frequency, times a session starts there, and initial probability."""
    states = steps.groupBy(*by, F.col("type").alias("state")).agg(
        F.count("*").alias("frequency"), F.count_if(F.col("pos") == 0).alias("starts")
    )
    return states.withColumn("initial", F.col("starts") / F.sum("starts").over(Window.partitionBy(*by)))


def stats(nodes_df: DataFrame, edges_df: DataFrame, by: tuple[str, ...] = GAME) -> DataFrame:
    n = nodes_df.groupBy(*by).agg(
        F.sum("starts").alias("sessions"), F.count("*").alias("states"), F.sum("frequency").alias("events")
    )
    e = edges_df.groupBy(*by).agg(
        F.sum("count").alias("transitions"),
        F.count("*").alias("distinct_transitions"),
        F.sum(F.when(F.col("src") == F.col("dst"), F.col("count")).otherwise(0)).alias("self_loops"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("transitions", "distinct_transitions", "self_loops")]
    return n.join(e, list(by), "left").select(*by, "sessions", "states", "events", *zero)


def strengths(nodes_df: DataFrame, edges_df: DataFrame, by: tuple[str, ...] = GAME) -> DataFrame:
    """Sum of outgoing and incoming weights; a self-loop counts in both."""
    out = edges_df.groupBy(*by, F.col("src").alias("state")).agg(F.sum("weight").alias("out_strength"))
    inn = edges_df.groupBy(*by, F.col("dst").alias("state")).agg(F.sum("weight").alias("in_strength"))
    key = [*by, "state"]
    return nodes_df.select(*key).join(out, key, "left").join(inn, key, "left").fillna(0.0, ["out_strength", "in_strength"])


def distances(edges_df: DataFrame, by: tuple[str, ...] = GAME) -> DataFrame:
    """Shortest path length for every reachable ordered pair; an edge is 1/weight long.

    All games and sources relax together; each round extends only the pairs that got
    shorter in the round before, until none does.
    """
    key = [*by, "src", "dst"]
    length = 1 / F.when(F.col("weight") > 0, F.col("weight")).otherwise(1e-9)
    hop = durable(edges_df.where("src <> dst").select(*key, length.alias("d")))
    best, fresh = hop, hop
    while not fresh.isEmpty():
        longer = (
            fresh.withColumnRenamed("dst", "via")
            .join(hop.select(*by, F.col("src").alias("via"), "dst", F.col("d").alias("hop")), [*by, "via"])
            .where("src <> dst")
            .groupBy(*key)
            .agg(F.min(F.col("d") + F.col("hop")).alias("new"))
        )
        both = durable(
            best.join(longer, key, "full_outer").select(
                *key,
                F.least("d", "new").alias("d"),
                (F.col("d").isNull() | (F.col("new") < F.col("d") - TIE)).alias("fresh"),
            )
        )
        best, fresh = both.drop("fresh"), both.where("fresh").drop("fresh")
    return best


def closeness(nodes_df: DataFrame, dist: DataFrame, by: tuple[str, ...] = GAME) -> DataFrame:
    """Outward harmonic closeness."""
    size = nodes_df.groupBy(*by).agg(F.count("*").alias("n"))
    harm = dist.groupBy(*by, F.col("src").alias("state")).agg(F.sum(1 / F.col("d")).alias("h"))
    return (
        nodes_df.select(*by, "state")
        .join(size, list(by))
        .join(harm, [*by, "state"], "left")
        .select(*by, "state", F.when(F.col("n") > 1, F.coalesce("h", F.lit(0.0)) / (F.col("n") - 1)).otherwise(0.0).alias("closeness"))
    )


def path_steps(edges_df: DataFrame, dist: DataFrame, by: tuple[str, ...] = GAME) -> DataFrame:
    """The last steps (u, dst) of the shortest paths from each src; at most edges times sources rows."""
    key = [*by, "src", "dst"]
    length = 1 / F.when(F.col("weight") > 0, F.col("weight")).otherwise(1e-9)
    hop = edges_df.where("src <> dst").select(*by, F.col("src").alias("u"), F.col("dst"), length.alias("hop"))
    to_u = dist.select(*by, "src", F.col("dst").alias("u"), F.col("d").alias("du"))
    origin = hop.select(*by, F.col("u").alias("src"), "u", F.lit(0.0).alias("du")).distinct()
    # steps along shortest paths: d(src, u) + hop = d(src, dst)
    return durable(
        to_u.unionByName(origin)
        .join(hop, [*by, "u"])
        .join(dist, key)
        .where(F.abs(F.col("du") + F.col("hop") - F.col("d")) <= TIE)
        .select(*by, "src", "u", "dst")
    )


def path_counts(dag: DataFrame, by: tuple[str, ...] = GAME) -> DataFrame:
    """Number of shortest paths for every reachable ordered pair, counted hop by hop."""
    key = [*by, "src", "dst"]
    wave = durable(dag.where("src = u").select(*key, F.lit(1.0).alias("paths")))
    waves = []
    while not wave.isEmpty():
        waves.append(wave)
        wave = durable(
            wave.withColumnRenamed("dst", "u").join(dag, [*by, "src", "u"]).groupBy(*key).agg(F.sum("paths").alias("paths"))
        )
    every = reduce(DataFrame.unionByName, waves) if waves else wave
    return every.groupBy(*key).agg(F.sum("paths").alias("paths"))


def betweenness(nodes_df: DataFrame, edges_df: DataFrame, dist: DataFrame, by: tuple[str, ...] = GAME) -> DataFrame:
    """Share of shortest paths through each state; directed, end points excluded."""
    key = [*by, "src", "dst"]
    dag = path_steps(edges_df, dist, by)
    counts = durable(path_counts(dag, by))
    before = counts.select(*by, "src", F.col("dst").alias("u"), F.col("paths").alias("upto"))
    # the share of the paths to dst that come through u, its predecessor on them
    share = durable(dag.join(before, [*by, "src", "u"]).join(counts, key).select(*key, "u", (F.col("upto") / F.col("paths")).alias("share")))
    wave, waves = counts.select(*key, F.lit(1.0).alias("x")), []
    while True:  # every target hands its share back, hop by hop
        wave = durable(wave.join(share, key).groupBy(*by, "src", F.col("u").alias("dst")).agg(F.sum(F.col("x") * F.col("share")).alias("x")))
        if wave.isEmpty():
            break
        waves.append(wave)
    every = reduce(DataFrame.unionByName, waves) if waves else wave
    through = every.groupBy(*by, F.col("dst").alias("state")).agg(F.sum("x").alias("betweenness"))
    return nodes_df.select(*by, "state").join(through, [*by, "state"], "left").fillna(0.0, ["betweenness"])


def page_rank(nodes_df: DataFrame, edges_df: DataFrame, by: tuple[str, ...] = GAME, rounds: int = MAX_ROUNDS) -> DataFrame:
    """Damped random walk over probabilities; states without a way out spread evenly.

    Stops early once no rank moves by more than 1e-12: further rounds change nothing
    that can be seen at the reported four digits.
    """
    game = Window.partitionBy(*by)
    ways = edges_df.groupBy(*by, F.col("src").alias("state")).agg(
        F.collect_list(F.struct(F.col("dst").alias("state"), F.col("probability").alias("p"))).alias("ways")
    )
    # Each state carries its outgoing edges, so a round reads the ranks once.
    rank = durable(
        nodes_df.select(*by, "state")
        .join(ways, [*by, "state"], "left")
        .withColumn("n", F.count("*").over(game))
        .withColumn("rank", 1 / F.col("n"))
    )
    kind = rank.schema["ways"].dataType
    stay = F.array(F.struct("state", F.lit(0.0).alias("flow"), "ways"))
    send = F.transform(
        F.coalesce("ways", F.lit([]).cast(kind)),
        lambda e: F.struct(e["state"].alias("state"), (e["p"] * F.col("rank")).alias("flow"), F.lit(None).cast(kind).alias("ways")),
    )
    done, chunk = 0, 10
    while done < rounds:
        before = rank
        for _ in range(min(chunk, rounds - done)):
            rank = (
                rank.withColumn("loose", F.sum(F.when(F.col("ways").isNull(), F.col("rank")).otherwise(0.0)).over(game))
                .select(*by, "n", "loose", F.inline(F.concat(stay, send)))
                .groupBy(*by, "state")
                .agg(
                    F.max("n").alias("n"),
                    ((1 - DAMPING + DAMPING * F.max("loose")) / F.max("n") + DAMPING * F.sum("flow")).alias("rank"),
                    F.first("ways", ignorenulls=True).alias("ways"),
                )
            )
            done += 1
        rank = durable(rank)
        old = before.select(*by, "state", F.col("rank").alias("old"))
        if rank.join(old, [*by, "state"]).where(F.abs(F.col("rank") - F.col("old")) > 1e-12).isEmpty():
            break
    return rank.select(*by, "state", F.col("rank").alias("page_rank"))


def centrality(nodes_df: DataFrame, edges_df: DataFrame, by: tuple[str, ...] = GAME) -> DataFrame:
    """All node measures, rounded as reported."""
    nodes_df, edges_df = durable(nodes_df), durable(edges_df)
    dist = distances(edges_df, by)
    key = [*by, "state"]
    return (
        strengths(nodes_df, edges_df, by)
        .join(betweenness(nodes_df, edges_df, dist, by), key)
        .join(closeness(nodes_df, dist, by), key)
        .join(page_rank(nodes_df, edges_df, by), key)
        .select(
            *key,
            round_half_up("out_strength").alias("out_strength"),
            round_half_up("in_strength").alias("in_strength"),
            round_half_up("betweenness", 3).alias("betweenness"),
            round_half_up("closeness").alias("closeness"),
            round_half_up("page_rank").alias("page_rank"),
        )
    )


def model(steps: DataFrame, weight: str = "probability", by: tuple[str, ...] = GAME) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of the sessions' transition network."""
    return nodes(steps, by), edges(sequences.transitions(steps), weight, by)
