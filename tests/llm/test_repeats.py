"""Line and byte repeats, near copies, fingerprints, token counts."""

import datetime
import hashlib
import random
import string
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from playtrace.llm import fingerprints, jaccard, line_dedup, suffixes, token_counts
from playtrace.llm.components import components


def runs(lines, least, long_words):
    """All runs of a document, with their first lines."""
    out = [(tuple(lines[s : s + least]), s) for s in range(len(lines) - least + 1)]
    if least > 1:
        out += [((x,), s) for s, x in enumerate(lines) if len(x.split()) >= long_words or len(lines) == 1 and x.split()]
        if 1 < len(lines) < least and any(x.split() for x in lines):
            out.append((tuple(lines), 0))
    return out


def test_lines_against_plain_version(spark):
    r = random.Random(2)
    docs = [(i, "\n".join(r.choice(["a", "b", "c", "d d", "e e e", "f f f f"]) for _ in range(r.choice([0, 1, 1, 2, 2, 3, 6, 14])))) for i in range(50)] + [(90, None), (91, ""), (3, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for gram, window in ((2, 2), (1, 2), (2, 4), (1, 1)):
        least, first = gram + window - 1, {}
        lines = {i: t.split("\n") for i, t in docs[:50]}
        for i in sorted(lines):
            for run, s in runs(lines[i], least, 3):
                first.setdefault(run, (i, s))
        want = {}
        for i, own in lines.items():
            gone = {p for run, s in runs(own, least, 3) if first[run] != (i, s) for p in range(s, s + len(run))}
            want[i] = (len(own), len(gone), sum(p - 1 not in gone for p in gone), "\n".join(x for p, x in enumerate(own) if p not in gone))
        got = {x.doc_id: (x.n_lines, x.n_removed, x.n_runs, x.kept_text) for x in line_dedup.without_repeats(d.where("doc_id < 50 AND text IS NOT NULL"), gram, window, 3).collect()}
        assert got == want
    odd = {(x.doc_id, x.n_lines, x.kept_text) for x in line_dedup.without_repeats(d.where("doc_id >= 90")).collect()}
    assert odd == {(90, 0, None), (91, 1, "")}


def test_lines_odd_rows(docs, rows, none):
    got = line_dedup.without_repeats(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    twice = [r for r in got if r.doc_id == 4]
    assert len({tuple(r) for r in twice}) == 1 and len(twice) == 3  # one document, three times
    assert line_dedup.without_repeats(none).count() == 0


def plain_bytes(rows, length):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    starts = Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if starts[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def spans(d, **options):
    return sorted((tuple(r) for r in suffixes.without_repeats(d, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)


@pytest.mark.parametrize("crowd", [2000, 1])
def test_bytes_against_plain_version(spark, crowd):
    r = random.Random(5)
    pool = ["".join(r.choice("abcdé ") for _ in range(r.choice([30, 60, 200]))) for _ in range(9)]
    docs = [(i, "".join(r.choice(pool) if r.random() < 0.7 else "".join(r.choice("xyz") for _ in range(r.choice([1, 5, 25]))) for _ in range(r.randint(0, 6)))) for i in range(60)]
    docs += [(200, None), (None, docs[5][1]), (7, docs[7][1]), (201, "a" * 300), (202, "ab" * 200), (203, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for length, gram in ((40, 10), (60, 59)):
        assert spans(d, length=length, gram=gram, crowd=crowd) == plain_bytes(docs, length)


def test_bytes_when_a_join_becomes_a_broadcast_at_run_time(spark):
    """As on large tables: a join planned as a sort-merge one, of which the counts turn out to fit into a broadcast; adaptive execution leaves the other rows where they were read."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "12KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    r = random.Random(12)
    text = lambda n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
    core = [text(420) for _ in range(100)]
    docs = [(i, text(30) + core[i // 2] + text(30)) for i in range(200)]
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
        assert spans(d) == plain_bytes(docs, suffixes.LENGTH)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_bytes_of_texts_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(suffixes, "_BLOCK", 1 << 9)
    r = random.Random(8)
    text = "".join(r.choice("abcdefgh") for _ in range(5000)).encode()
    whole = sorted((int(p), int(a), int(b)) for _, ps, lo, hi, *_ in suffixes.anchors([text], 60, 20) for p, a, b in zip(ps, lo, hi))
    starts = [s for _, a, b in whole for s in range(a, b + 1)]
    assert sorted(starts) == list(range(5000 - 60 + 1))  # every string has just one anchor


def test_bytes_odd_rows(docs, rows, none):
    assert spans(docs) == plain_bytes(rows, suffixes.LENGTH)
    assert spans(none) == []


def test_deep_shallow_sort():
    r = random.Random(3)
    for _ in range(3000):
        base = bytes(r.choice(b"ab") for _ in range(40))
        s = [base[: r.randint(0, 40)] + bytes(r.choice(b"ab") for _ in range(r.randint(0, 8))) for _ in range(r.choice([1, 2, 5, 30]))]
        order, prefix = suffixes.deep_shallow(s, r.choice([0, 1, 4, 16]))
        assert sorted(order) == list(range(len(s))) and [s[i] for i in order] == sorted(s)
        for a, b, n in zip(order, order[1:], prefix[1:]):
            assert s[a][:n] == s[b][:n] and (n == min(len(s[a]), len(s[b])) or s[a][n] != s[b][n])


def plain_groups(rows, words, least):
    return sorted(((i, n, low) for i, n, low, _ in plain_components(rows, words, least)), key=str)


def plain_components(rows, words, least):
    """For each row: id, size of its set, component_id, and the root of its component."""
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= least * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)].append(r[0])
    return [(r[0], len(sets[i]), (min(low[find(i)]) if low[find(i)] else None) if sets[i] else r[0], find(i)) for i, r in enumerate(rows)]


def grouped(d, words, least, **options):
    return sorted((tuple(r) for r in jaccard.groups(d, words, least, **options).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def near_copies(n=110):
    r = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            t = r.choice(out)[1].split()
            for _ in range(r.choice([0, 1, 2, 5])):
                if t:
                    t[r.randrange(len(t))] = r.choice(words)
            t = t[: r.choice([len(t), len(t), len(t) * 9 // 10])]
        else:
            t = [r.choice(words) for _ in range(r.choice([0, 1, 3, 5, 30, 60, 90]))]
        out.append((i, " ".join(t)))
    return out


@pytest.mark.parametrize("words,least,bits", [(4, 85, 22), (2, 60, 8), (5, 80, 16)])
def test_groups_against_plain_version(spark, words, least, bits):
    rows = near_copies() + [(500, None), (None, "w1 w2 w3 w4 w5"), (3, "w1 w2 w3 w4 w5"), (None, None)]
    assert grouped(spark.createDataFrame(rows, "doc_id long, text string"), words, least, bits=bits) == plain_groups(rows, words, least)


def test_groups_odd_rows(docs, rows, none):
    assert grouped(docs, 4, 85) == plain_groups(rows, 4, 85)
    assert grouped(none, 4, 85) == []


def test_one_of_each(docs, rows, none):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    groups = plain_components(rows, 5, 80)
    empty = sum(1 for g in groups if g[1] == 0)
    assert len(kept) == empty + len({g[3] for g in groups if g[1]})
    assert jaccard.one_of_each(none).count() == 0


def test_one_of_each_keeps_unlinked_texts_of_one_id(spark):
    r = random.Random(13)
    texts = [" ".join(f"{k}w{r.randrange(500)}" for _ in range(20)) for k in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3] + " end"), (8, texts[4]), (None, texts[4]), (9, texts[5])]
    # every two components are told apart by their texts, which share no word
    roots = {x[1].split("w")[0] for x in rows}
    kept = [(x.doc_id, x.text) for x in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == len(roots) == 6 and {t.split("w")[0] for _, t in kept} == roots
    assert set(kept) <= set(rows)


def test_suffix_bound_never_rejects_a_link():
    import numpy as np

    r = np.random.default_rng(4)
    for _ in range(300):
        a, b = (np.unique(r.integers(0, 80, r.integers(0, 60))) for _ in range(2))
        assert jaccard.suffix_bound(a, b) >= len(np.intersect1d(a, b))


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x.id: x.comp for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b}
    assert {v: c for v, c in got.items()} == {v: find(v) for v in root if v in got} and set(root) - set(got) <= loops
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_sketch(text, k=fingerprints.K, n=fingerprints.SHINGLE):
    import re

    words, out = re.findall(r"[^\x20\x09-\x0D]+", text.lower()), set()
    for i in range(max(1, len(words) - n + 1)) if words else ():
        h = 42
        for w in words[i : i + n]:
            h = xxhash.xxh64(w.encode(), seed=h).intdigest()
        out.add(h - 2**64 if h >= 2**63 else h)
    return sorted(out)[:k]


def plain_likeness(a, b, k=fingerprints.K):
    union = sorted(set(a) | set(b))[:k]
    return 1.0 if not union else sum(x in a and x in b for x in union) / len(union)


@pytest.mark.parametrize("ranges", [256, 3])
def test_fingerprints_against_plain_version(docs, rows, monkeypatch, ranges):
    monkeypatch.setattr(fingerprints, "RANGES", ranges)
    order = sorted(((r[0] is not None, r[0] or 0, r[1] or "", r[0]) for r in rows))
    want = []
    for i, (_, _, t, doc) in enumerate(order):
        following = order[(i + 1) % len(order)][2]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        s, e, f = plain_sketch(t), plain_sketch(new), plain_sketch(following)
        want.append((doc, t, new, s, e, round(plain_likeness(s, e), 9), round(plain_likeness(s, f), 9)))
    e = fingerprints.edited(docs)
    got = e.select("doc_id", "text", "edited_text", "sketch", "edited_sketch", fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")), fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")))
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in got.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fingerprint_estimates(spark, none):
    a, b = " ".join(f"a{k}" for k in range(3004)), " ".join(f"a{k}" for k in range(1000, 4004))
    d = spark.createDataFrame([(a, b, a[:9000], a[8000:])], "a string, b string, p string, q string")
    s = {c: fingerprints.sketch(F.col(c)) for c in "abpq"}
    r = d.select(fingerprints.resemblance(s["a"], s["b"]), fingerprints.containment(s["a"], s["b"]), fingerprints.distinct_shingles(s["a"]), fingerprints.resemblance(fingerprints.merged(s["p"], s["q"]), s["a"])).first()
    assert abs(r[0] - 0.5) < 0.13 and abs(r[1] - 2 / 3) < 0.17 and abs(r[2] - 3000) < 800 and r[3] > 0.97
    assert fingerprints.edited(none).count() == 0


def test_next_document_wraps_around(spark):
    d = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert fingerprints.edited(d).first().edited_text == "abcabc"


COUNT = token_counts.counter(f"{token_counts.FOLDER}/{token_counts.FILE}")


def whole(text):
    return sum(COUNT[p] for part in COUNT.pieces(text) for p in part)


def test_counts_follow_edits():
    r, letters = random.Random(1), "ab  \n\t,.'s1é"
    for _ in range(400):
        t = "".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 50, 700])))
        tree = token_counts.Tree(t, *token_counts.leaves(t, COUNT), COUNT)
        for _ in range(4):
            a = r.randint(0, len(t) + 2)
            b, new = a + r.choice([0, 0, 1, 3, 40]), "".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 9, 300, 1200])))
            t = t[:a] + new + t[max(a, b) :]
            tree.edit(a, b, new)
            assert tree.text() == t and tree.total() == whole(t)


def test_few_pre_tokens_are_encoded_again():
    t = "some words of a long text, " * 5000
    tree = token_counts.Tree(t, *token_counts.leaves(t, COUNT), COUNT)
    tree.edit(60_000, 60_010, "new")
    assert tree.total() == whole(tree.text()) and tree.encoded <= 4 * token_counts.LEAF


def test_chunks_of_long_texts(monkeypatch):
    t = "it's   a \n\n longtext,, of 123 'rest' words " * 50 + " " * 500 + "x" * 700
    want = COUNT.pattern.findall(t)
    monkeypatch.setattr(token_counts, "CHUNK", 37)
    assert [p for part in COUNT.pieces(t) for p in part] == want


def test_recount(spark, docs, rows, none):
    edits = token_counts.sample_edits(F.col("_text"))
    got = token_counts.recount(token_counts.count_trees(docs, ["doc_id", "text"]), edits).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r.text or ""
        assert r._n_tokens == whole(t)
        n = len(t)
        third = n // 3
        t = t[:third] + t[third + 40 :]
        t = t[: third * 2] + (r.text or "")[:30] + t[third * 2 :]
        end = n - min(40, n - third) + min(30, n)
        t = t[: max(0, end - 20)] + (r.text or "")[:20].upper() + t[end:] if r.text is not None else t
        assert r._edited_chars == len(t) and r._n_edited == whole(t) and r._edited_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert token_counts.recount(token_counts.count_trees(none, ["doc_id"]), edits).count() == 0
    odd = F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"), F.lit(" end").alias("text")))
    got = token_counts.recount(token_counts.count_trees(docs, ["text"]), odd).collect()
    assert all(r._n_edited == whole((r.text or "") + " end") for r in got)
    none_at_all = F.lit(None).cast("array<struct<start:int,stop:int,text:string>>")
    assert all(r._n_edited == r._n_tokens for r in token_counts.recount(token_counts.count_trees(docs, ["text"]), none_at_all).collect())


def test_fingerprints_with_ids_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGES", 40)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abc d") for _ in range(rnd.randrange(90))) for _ in range(300)]
    kinds = {
        "string": [None if i % 3 else f"é{i % 70}" for i in range(300)],  # most rows share the null id
        "long": [(1 << 60) + i % 50 for i in range(300)],
        "date": [datetime.date(2024, 1, 1 + i % 28) for i in range(300)],
    }
    for kind, ids in kinds.items():
        got = fingerprints.edited(spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string").repartition(5))
        order = sorted(zip(ids, texts), key=lambda r: (r[0] is not None, r[0].encode() if isinstance(r[0], str) else r[0] or 0, r[1].encode()))
        want = [(i, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order)]
        assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text, r.next_text)) for r in got.collect()), kind
