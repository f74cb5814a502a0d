"""The manifest tree, the filter audit and the language model against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from playtrace.llm import filter_audit, language_model, merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes, fanout):
    """The top, and for each node the siblings of each level as (before, after)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            base = p // fanout * fanout
            paths[i].append(("".join(level[base:p]), "".join(level[p + 1 : base + fanout])))
        level = [sha("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)]
        at = [p // fanout for p in at]
    return level[0], paths


def plain_manifest(rows, fanout):
    """For every row: id, leaf, subroot, root, siblings' digest."""
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        groups[lang].append((i, sha("".join(map(field, (i, source, lang, n, text))))))
    low = lambda v: (v is not None, v or 0)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[1] for x in sorted(groups[g], key=lambda x: (low(x[0]), x[1]))], fanout) for g in names}
    root, above = plain_tree([trees[g][0] for g in names], fanout)
    out = []
    for g, way in zip(names, above):
        for (i, leaf), path in zip(sorted(groups[g], key=lambda x: (low(x[0]), x[1])), trees[g][1]):
            out.append((i, leaf, trees[g][0], root, sha("".join(a + b for a, b in path + way))))
    return sorted(out, key=str)


def manifest(d, **options):
    m = merkle.manifest(d, **options)
    m = m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.fold(F.col("leaf"), F.col("path")))
    got = [tuple(r) for r in m.collect()]
    assert all(r[3] == r[5] for r in got)  # every path leads to the root
    return sorted((r[:5] for r in got), key=str)


@pytest.mark.parametrize("fanout", [2, 8])
def test_manifest_odd_rows(docs, rows, none, fanout):
    assert manifest(docs, fanout=fanout) == plain_manifest([r[:5] for r in rows], fanout)
    assert manifest(none, fanout=fanout) == []


def test_manifest_group_sizes(spark):
    """Groups of one, of whole and of broken runs, and more groups than a run holds."""
    r = random.Random(4)
    rows = [(k * 1000 + j, "t" * r.randrange(4), f"l{k}" if k else None, "s", j) for k, n in enumerate([1, 8, 9, 64, 65, 1, 2, 7, 3, 1, 17]) for j in range(n)]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest(d) == plain_manifest(rows, 8)
    one = d.where("doc_id = 0")
    assert manifest(one) == plain_manifest([x for x in rows if x[0] == 0], 8)  # the leaf is the root, no siblings


def test_a_changed_field_is_found(docs):
    m = merkle.manifest(docs, carry={"other": merkle.leaf_digest([F.concat("text", F.lit("!")) if c == "text" else F.col(c) for c in merkle.FIELDS]), "text": F.col("text")})
    got = m.select("text", (merkle.fold(F.col("other"), F.col("path")) == F.col("root")).alias("same")).collect()
    assert all(r.same == (r.text is None) for r in got)


def plain_flags(rows):
    least = {}
    for i, text in ((r[0], r[1] or "") for r in rows):
        if i is not None:
            least[text] = min(i, least.get(text, i))
    out = []
    for i, text in ((r[0], r[1] or "") for r in rows):
        w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
        bits = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > least[text]]
        out.append(sum(1 << k for k, b in enumerate(bits) if b))
    return out


def plain_audit(rows, labels):
    marks = [(r[2] or "", m, *(any(x[0] == r[0] and x[c] == 1 for x in labels if x[0] is not None) for c in (1, 2))) for r, m in zip(rows, plain_flags(rows))]
    out = {}
    for part in {m[0] for m in marks}:
        own, alone = [m for m in marks if m[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                fails, gone = [m for m in own if m[1] & bit], [m for m in left if m[1] & bit]
                left = [m for m in left if not m[1] & bit]
                alone[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(m[1] == bit for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone), f]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = alone[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_plain_version(spark, docs, rows, none):
    r = random.Random(3)
    more = [(1000 + k, " ".join(r.choice(["a", "Bb", "c", "d#"][: r.randint(1, 4)]) for _ in range(r.choice([0, 5, 250]))), r.choice(["en", None, ""])) for k in range(40)]
    more += [(1100 + k, more[k % 3][1], "en") for k in range(9)]
    plain = [r[:3] for r in rows] + more
    d = docs.select("doc_id", "text", "lang", "shard").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in [*range(0, 60, 2), *range(1000, 1049, 3), 4, 4, None]]
    got = filter_audit.audit(filter_audit.mask_counts(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    got = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in got}
    assert got == plain_audit(plain, labels)
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.mask_counts(none, no_labels)).count() == 0


def test_sketch_never_clears_a_repeat(spark):
    r = random.Random(8)
    texts = [f"text {k}" for k in range(3000)]
    rows = [(t,) for t in texts] + [(r.choice(texts),) for _ in range(500)] + [(None,), ("",)]
    often = Counter(t or "" for (t,) in rows)
    d = spark.createDataFrame(rows, "text string").repartition(7)
    flagged = d.select("text", filter_audit.possible_repeat(d).alias("again")).collect()
    assert all(x.again for x in flagged if often[x.text or ""] > 1)
    once = [x.again for x in flagged if often[x.text or ""] == 1]
    assert sum(once) <= 0.05 * len(once)


def test_a_full_sketch_only_costs_time(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "sketch_bits", lambda n: 10)
    rows = [(k, f"w{k % 900}", "en") for k in range(1500)]
    counts = filter_audit.mask_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.mask: r.n for r in counts.collect()} == {1: 900, 17: 600}


def plain_tokens(text):
    return [x for x in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if x] + [None]


def plain_model(rows, held, order, mu):
    counts = Counter()
    for r, out in zip(rows, held):
        t = [b" ", *plain_tokens(r[1])]
        if not out:
            counts.update(tuple(t[i : i + k]) for k in range(1, order + 1) for i in range(len(t) - k + 1))
    single = {g[0]: c for g, c in counts.items() if len(g) == 1 and g != (b" ",)}
    n, v = sum(single.values()), len(single)

    def chance(g):
        if len(g) == 1:
            return (single.get(g[0], 0) + 1) / (n + v + 1)
        return (counts[g] + mu * chance(g[1:])) / (counts[g[:-1]] + mu) if counts[g[:-1]] else chance(g[1:])

    out = []
    for r, h in zip(rows, held):
        t = [b" ", *plain_tokens(r[1])]
        score = sum(math.log10(chance(tuple(t[max(0, i - order + 1) : i + 1]))) for i in range(1, len(t)))
        base = sum(math.log10(chance((x,))) for x in t[1:])
        out.append((r[0], h, len(t) - 1, sum(x in single for x in t[1:]), n, round(base, 5), round(score, 5)))
    return sorted(out, key=str)


def is_held(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


def modelled(d, order, mu, **options):
    out = language_model.scored(d, language_model.held_out(F.col("doc_id")), order, mu, **options)
    return sorted(((r[0], *r[1:5], round(r[5], 5), round(r[6], 5)) for r in out.collect()), key=str)


@pytest.mark.parametrize("order,block,ranges", [(1, 8_000_000, 1 << 21), (2, 500, 100), (3, 2000, 1000), (4, 8_000_000, 64)])
def test_model_against_plain_version(docs, rows, none, monkeypatch, order, block, ranges):
    want = plain_model(rows, [is_held(r[0]) for r in rows], order, 3.0)
    assert modelled(docs, order, 3.0, block_bytes=block, range_tokens=ranges) == want
    assert modelled(none, order, 3.0) == []


def test_lanes_carry_the_state(rows):
    held = np.array([is_held(r[0]) for r in rows])
    block = language_model.Block.of([(r[1] or "").encode() for r in rows], held)
    for order in (1, 2, 3):
        counts = [block.training_counts(at, len(distinct)) for distinct, _, at in block.grams(order)]
        words, tokens = 500, 30_000
        machine = language_model.Automaton(block, counts, tokens, words, 5.0)
        whole = machine.scores(block, order, 10**9)
        for lane in (1, 2, 7, 100):
            assert np.allclose(machine.scores(block, order, lane), whole, rtol=1e-12)


def test_model_without_training_rows(spark):
    ids = [i for i in range(60) if is_held(i)]
    d = spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string")
    assert modelled(d, 2, 5.0) == sorted(((i, True, 4, 0, 0, 0.0, 0.0) for i in ids), key=str)


def test_probabilities_sum_to_one():
    """After any history, the chances of all known tokens and of one unknown one add up to 1."""
    train, words = ["a b a c", "b b a", "c a b", ""], ["a", "b", "c", "unknown", ""]
    probes = [f"{h} {w}" for h in words for w in words]
    texts = [t.encode() for t in train + probes]
    block = language_model.Block.of(texts, np.arange(len(texts)) >= len(train))
    counts = [block.training_counts(at, len(distinct)) for distinct, _, at in block.grams(2)]
    known = {x: language_model.Words([x.encode()], language_model._CODES).hash[0] if x else language_model.END for x in words}
    number = {h: i for i, h in enumerate(next(block.grams(1))[0])}
    machine = language_model.Automaton(block, counts, 14, 4, 2.0)
    state = machine.root_next[[number[known[h]] for h in ("a", "b", "c")] + [number[language_model.BEGIN]]]
    assert (state > 0).all()
    for s in state:
        chances = [10 ** machine.read(np.array([s]), np.array([number[known[w]]]))[1][0] for w in words]
        assert abs(sum(chances) - 1) < 1e-12


def test_pack():
    r = np.random.default_rng(1)
    for top in (1, 255, 256, 70_000, 2**40, 2**64 - 1):
        x = r.integers(0, top, 50, dtype=np.uint64, endpoint=True)
        assert (language_model.unpack(language_model.pack(x)) == x).all()
    assert len(language_model.unpack(language_model.pack(np.zeros(0, np.uint64)))) == 0
