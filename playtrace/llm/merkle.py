"""A manifest of a dataset as a Merkle tree, with a proof for every row.

A row's leaf is the digest of its fields. Within a group, leaves in the order of their key are nodes of height 0; FANOUT consecutive
nodes become the digest of their concatenated hex digests, until one node is left, the group's subroot. Subroots in the order of their groups
are the leaves of a second tree of the same kind, whose top is the root.

Slot pivot: one group by (group, place // FANOUT) with a conditional aggregate for each slot spreads the children of a parent into
FANOUT columns. Concatenating them gives the parent's digest; the columns before and after a child's own are its siblings. So a
level costs one shuffle of the nodes below it and a lookup by place costs nothing. Paths go down the same tables: a parent hands its path, with its
children's siblings in front, to each child. Levels are written tables, each FANOUT times smaller than the one below.

Places are exact row numbers: rows are parted by range of (group, key, leaf), numbered within a part, and the sizes of the parts,
a row for each part and group, are added up. No group is ever in one task, nor one window, except its part totals.

Nulls: a null field counts as "-"; a null group is a group and comes first; a null key comes first in its group. Empty texts are
"0:". Rows with equal keys follow in the order of their leaves; rows equal in all fields are leaves of their own. An
empty table gives an empty result. Other columns play no part, whatever they are called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.llm.common import crc_of, query, table
from playtrace.session import durable

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 1_000_000  # part totals up to this number are broadcast, more are joined by shuffle


def digest(*parts: Column) -> Column:
    """sha256 of the concatenated parts, in hex."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A field as it enters a leaf: "-" for null, otherwise its length in bytes, a colon and its text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    return digest(*map(encoded, fields))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda h, x: digest(x["before"], h, x["after"]))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings on a path, from the leaf's up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "").cast("binary"), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with _at, their place from 0 within _group, in the given order."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "_group", *order).sortWithinPartitions("_group", *order)
    # bounds come from a sample, so everything below must see one result
    dealt = durable(dealt.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    sizes = dealt.groupBy("_group", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each part
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    shifts = durable(sizes.select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), shift.alias("_shift")))
    if shifts.count() <= BROADCAST_ROWS:
        shifts = F.broadcast(shifts)
    both = dealt.join(shifts, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return both.withColumn("_at", F.col("_row") + F.col("_shift")).drop("_g", "_p", "_shift", "_part", "_row")


def _slots(fanout: int) -> list[str]:
    return [f"_c{k}" for k in range(fanout)]


def levels(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The parents of height 1, 2, ... with their children in columns, and (_group, _height, _node) of each group's top.

    nodes: _group, _at, and _node, a struct with the field digest first.
    """
    assert fanout >= 2
    out, tops, slot = [], [], F.col("_at") % fanout
    while True:
        spread = [F.max(F.when(slot == k, F.col("_node"))).alias(c) for k, c in enumerate(_slots(fanout))]
        wide = durable(nodes.groupBy("_group", F.expr(f"_at div {fanout}").alias("_at")).agg(*spread))
        alone = (F.col("_at") == 0) & F.col("_c1").isNull()  # the only node of its group: nothing is built on it
        tops.append(wide.where(alone).select("_group", F.lit(len(out)).alias("_height"), F.struct(F.col("_c0.digest").alias("digest")).alias("_node"), F.col("_c0") if not out else F.lit(None).alias("_c0")))
        parents = wide.where(~alone)
        if parents.isEmpty():
            leaf = tops[0].schema["_c0"].dataType
            return out, reduce(DataFrame.unionAll, [t.withColumn("_c0", F.col("_c0").cast(leaf)) for t in tops])
        out.append(parents)
        whole = digest(*[F.coalesce(F.col(c)["digest"], F.lit("")) for c in _slots(fanout)])
        nodes = parents.select("_group", "_at", F.struct(whole.alias("digest")).alias("_node"))


_PATH = "array<struct<before: string, after: string>>"


def with_paths(parents: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Every leaf: _node, _path, and what tops tells of its group in _of. tops: _group, _height, _c0 (a lone leaf), _path, _of."""
    known = None
    for height in range(len(parents), 0, -1):
        at = tops.where(F.col("_height") == height).select(F.col("_group").alias("_g"), F.lit(0).cast("long").alias("_a"), "_path", "_of")
        at = at if known is None else at.unionAll(known)
        rows = parents[height - 1].join(at, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_at") == F.col("_a")))
        texts = [F.coalesce(F.col(c)["digest"], F.lit("")) for c in _slots(fanout)]
        each = []
        for k, c in enumerate(_slots(fanout)):
            step = F.struct(F.concat(F.lit(""), *texts[:k]).alias("before"), F.concat(F.lit(""), *texts[k + 1 :]).alias("after"))
            each.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("slot"), F.col(c).alias("node"), step.alias("step"))))
        rows = rows.select("_g", "_at", "_path", "_of", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("_x"))
        path = F.concat(F.array("_x.step"), "_path").alias("_path")
        if height == 1:
            known = rows.select(F.col("_x.node").alias("_node"), path, "_of")
        else:
            known = rows.select("_g", (F.col("_at") * fanout + F.col("_x.slot")).alias("_a"), path, "_of")
    alone = tops.where(F.col("_height") == 0).select(F.col("_c0").alias("_node"), "_path", "_of")
    return alone if known is None else known.unionAll(alone)


def manifest(rows: DataFrame, fields=FIELDS, group: str = "lang", key: str = "doc_id", fanout: int = FANOUT, carry: dict[str, Column] | None = None) -> DataFrame:
    """For every row: key, leaf, subroot, root, path (of structs before, after: the siblings of each level), and the columns of carry."""
    carry = carry or {}
    leaves = rows.select(
        F.col(group).alias("_group"), F.struct(leaf_digest([F.col(c) for c in fields]).alias("digest"), F.col(key).alias("key"), *[c.alias(n) for n, c in carry.items()]).alias("_node")
    ).withColumns({"_key": F.col("_node.key"), "_leaf": F.col("_node.digest")})
    leaves = placed(durable(leaves), ["_key", "_leaf"]).select("_group", "_at", "_node")
    lower, tops = levels(leaves, fanout)
    tops = durable(tops)
    # the tree of the subroots, with all groups as one
    subroots = tops.select(F.lit(0).alias("_group"), F.col("_group").alias("_key"), F.struct(F.col("_node.digest").alias("digest"), F.col("_group").alias("key")).alias("_node"))
    upper, top = levels(placed(subroots, ["_key"]).select("_group", "_at", "_node"), fanout)
    top = top.select("_group", "_height", "_c0", F.array().cast(_PATH).alias("_path"), F.col("_node.digest").alias("_of"))
    above = with_paths(upper, top, fanout).select(F.col("_node.key").alias("_g"), F.col("_node.digest").alias("_subroot"), "_path", F.col("_of").alias("_root"))
    tops = tops.join(above, F.col("_group").eqNullSafe(F.col("_g"))).select("_group", "_height", "_c0", "_path", F.struct(F.col("_subroot").alias("subroot"), F.col("_root").alias("root")).alias("_of"))
    out = with_paths(lower, durable(tops), fanout)
    return out.select(F.col("_node.key").alias(key), F.col("_node.digest").alias("leaf"), "_of.subroot", "_of.root", F.col("_path").alias("path"), *[F.col("_node")[n].alias(n) for n in carry])


def _sql(fanout: int = FANOUT) -> str:
    """A twin that builds both trees with recursive queries and looks siblings up by place."""
    h = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = " || ".join(h(c) for c in FIELDS)
    odd = leaf.replace(h("text"), h("lowered"))
    shift = "list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295, [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]), lambda a, b: {shift.replace('[c,', '[xor(a, b),')}), 4294967295)"

    def tree(name: str, base: str, cols: str) -> str:
        return f"""{name} AS (SELECT {cols}, 0 AS lvl, pos, digest, n FROM {base}
  UNION ALL SELECT {cols}, lvl + 1, pos // {fanout}, sha256(string_agg(digest, '' ORDER BY pos)), (n + {fanout - 1}) // {fanout} FROM {name} WHERE n > 1 GROUP BY {cols}, lvl, pos // {fanout}, n)"""

    return f"""
WITH RECURSIVE d AS (SELECT *, translate(text, '{UPPER}', '{LOWER}') AS lowered, coalesce({crc} % 3 = 0, false) AS odd FROM documents),
l AS (SELECT doc_id, lang, sha256({leaf}) AS leaf, CASE WHEN odd THEN sha256({odd}) ELSE sha256({leaf}) END AS other FROM d),
p AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
{tree('t', 'p', 'lang')},
s AS (SELECT lang, digest, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
s0 AS (SELECT 0 AS one, * FROM s),
{tree('u', 's0', 'one')},
a AS (SELECT p.doc_id, p.leaf, p.lang, p.pos AS own, t.lvl, string_agg(t.digest, '' ORDER BY t.pos) FILTER (WHERE t.pos < p.pos // ({fanout} ** t.lvl)::BIGINT) AS before,
    string_agg(t.digest, '' ORDER BY t.pos) FILTER (WHERE t.pos > p.pos // ({fanout} ** t.lvl)::BIGINT) AS after
  FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.n > 1 AND t.pos // {fanout} = p.pos // ({fanout} ** t.lvl)::BIGINT // {fanout} GROUP BY ALL),
b AS (SELECT s.lang, u.lvl + 1000 AS lvl, string_agg(u.digest, '' ORDER BY u.pos) FILTER (WHERE u.pos < s.pos // ({fanout} ** u.lvl)::BIGINT) AS before,
    string_agg(u.digest, '' ORDER BY u.pos) FILTER (WHERE u.pos > s.pos // ({fanout} ** u.lvl)::BIGINT) AS after
  FROM s JOIN u ON u.n > 1 AND u.pos // {fanout} = s.pos // ({fanout} ** u.lvl)::BIGINT // {fanout} GROUP BY ALL),
steps AS (SELECT lang, own, lvl, before, after FROM a UNION ALL SELECT p.lang, p.pos, b.lvl, b.before, b.after FROM p JOIN b ON b.lang IS NOT DISTINCT FROM p.lang),
way AS (SELECT lang, own, list({{'x': coalesce(before, ''), 'y': coalesce(after, '')}} ORDER BY lvl) AS path FROM steps GROUP BY ALL),
f AS (SELECT p.doc_id, p.leaf, p.lang, coalesce(way.path, []) AS path, p.other AS h, 1 AS i FROM p LEFT JOIN way ON way.lang IS NOT DISTINCT FROM p.lang AND way.own = p.pos
  UNION ALL SELECT doc_id, leaf, lang, path, sha256(path[i].x || h || path[i].y), i + 1 FROM f WHERE i <= len(path))
SELECT f.doc_id, f.leaf, s.subroot, r.digest AS root, sha256(array_to_string([z.x || z.y FOR z IN path], '')) AS proof_sha256, h AS folded_root, h = r.digest AS verified
FROM f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang, (SELECT digest FROM u WHERE n = 1) r WHERE i > len(path)"""


@query("op11_merkle_manifest", _sql())
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lowered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    changed = F.when(crc_of(F.col("doc_id")) % 3 == 0, leaf_digest(lowered))
    m = manifest(docs, carry={"changed": changed})
    m = m.withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": fold(F.coalesce("changed", "leaf"), F.col("path"))})
    return m.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
