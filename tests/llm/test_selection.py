"""Mixing, sharding, quality, language and decontamination."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from playtrace.llm import decontamination, language, mixing, quality, sharding
from playtrace.llm.common import table


def plain_seats(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        got[max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got


def test_apportionment_is_sainte_lague():
    r = random.Random(1)
    for _ in range(60):
        votes = [Fraction(r.choice([0, 1, 5, 5, 13, 77])) for _ in range(r.randint(1, 7))]
        if sum(votes):
            for seats in (0, 1, 7, 60):
                assert mixing.apportion(votes, seats) == plain_seats(votes, seats)


def test_targets_stop_at_the_cap():
    t = mixing.targets([1, 100, 100], [5, 2, 1], 3)
    assert t[0] == 3 and sum(t) == 201 and t[1] == 2 * t[2]
    assert mixing.targets([0, 0], [5, 2], 3) == [0, 0]


def check_mix(rows, got):
    assert len(got) == len(rows)
    assert Counter((g[0], g[1]) for g in got) == Counter((r[0], len((r[1] or "").encode().split())) for r in rows)
    by = defaultdict(list)
    for g in got:
        by[g[2], g[3]].append(g)
        assert 0 <= g[4] <= 3 * g[1]
    for (_, target), own in by.items():
        assert abs(sum(g[4] for g in own) - target) <= 2 * mixing.BLOCK_WORDS


def test_mix(docs, rows, none):
    pick = ["_size", "_source_size", "_target", "_taken"]
    run = lambda d: sorted((tuple(x) for x in mixing.mix(d, ["doc_id"]).select("doc_id", *pick).collect()), key=str)
    got = run(docs)
    check_mix(rows, got)
    assert got == run(docs.repartition(5))
    assert run(none) == []


def test_mixed_documents_have_the_words_taken(docs, none):
    taken = sum(r[0] for r in mixing.mix(docs, ["doc_id"]).select("_taken").collect())
    m = mixing.mixed_documents(docs)
    assert m.columns == docs.columns
    out = m.collect()
    assert sum(len((r.text or "").encode().split()) for r in out) == taken
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    assert mixing.mixed_documents(none).count() == 0


def check_shards(rows, got, shards):
    assert Counter((g[0], g[1], g[2]) for g in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    size, slots = Counter(), defaultdict(list)
    for g in got:
        size[g[3]] += g[1]
        slots[g[3]].append(g[4])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(size) <= set(range(shards))
    total, most = sum(size.values()), max(g[1] for g in got)
    assert all(abs(size[k] - total / shards) <= 2 * most + 0.002 * total for k in range(shards))


def test_shards(spark, docs, rows, none):
    run = lambda d, n: [tuple(x) for x in sharding.shard(d, ["doc_id"], n).select("doc_id", "_size", "_crc", "_shard", "_slot").collect()]
    for n in (1, 2, 5):
        check_shards(rows, run(docs, n), n)
    assert run(none, 4) == []
    same = [(1, "the same text")] * 400 + [(k, "other") for k in range(400)] + [(k, str(k)) for k in range(400)]  # a third is one row, a third one text
    check_shards(same, run(spark.createDataFrame(same, "doc_id long, text string"), 7), 7)


def test_sharded_documents_keep_their_columns(docs, rows):
    got = sharding.sharded_documents(docs, 3)
    assert set(got.columns) == set(docs.columns) | {"slot"}
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r[0], r[1]) for r in rows)


def test_sharding_of_the_table_is_even(spark, sf):
    docs = table(spark, sf, "documents")
    got = [tuple(x) for x in sharding.shard(docs, ["doc_id"], 10).select("doc_id", "_size", "_crc", "_shard", "_slot").collect()]
    check_shards([tuple(r) for r in docs.select("doc_id", "text").collect()], got, 10)


def test_quality_holds_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = {r.doc_id: r for r in quality.scores(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(got[x.doc_id].predicted, x.quality) for x in labels.collect() if got[x.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert np.mean([a for a, b in held if b == 1]) > 0.97


def test_quality_odd_rows(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60)] + [(None, 1, 0), (3, None, 0), (5, 0, 1), (4, 0, 0)], "doc_id long, quality long, toxic long")
    got = quality.scores(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {True}
    assert quality.scores(none, quality.fit(docs, labels)).count() == 0
    assert {r.score for r in quality.scores(docs, quality.fit(none, labels)).collect()} == {0.5}
    assert quality.good_documents(docs, labels.limit(0)).count() == len(rows)
    assert quality.good_documents(docs, labels).columns == docs.columns


def test_votes_are_those_of_the_nearest():
    texts = [f"clean words number {k} are here to read.".encode() for k in range(9)] + [f"JUNK{k}!! JUNK!! {k} ###$$$".encode() for k in range(9)]
    m = quality.train(texts, [1] * 9 + [0] * 9)
    q = quality.terms([b"clean words to read here.", b"JUNK!! $$$ JUNK!!"])
    cosine = np.maximum(m.project(q) @ m.vectors.T, 0)
    want = []
    for row in cosine:
        near = sorted(range(18), key=lambda i: -row[i])[: quality.NEIGHBOURS]
        want.append(sum(row[i] ** quality.SHARPNESS * m.labels[i] for i in near) / sum(row[i] ** quality.SHARPNESS for i in near))
    assert np.allclose(m.score([b"clean words to read here.", b"JUNK!! $$$ JUNK!!"]), want, atol=1e-5)
    assert m.score([b""])[0] == 0


def test_gradients_of_the_recurrent_layer():
    rng = np.random.default_rng(0)
    layer = language.Layer(rng, 3)
    layer.p = {k: v.astype(np.float64) for k, v in layer.p.items()}
    x, weight = rng.integers(97, 101, (5, 4)).astype(np.uint8), rng.normal(size=(5, 3, 4))
    states, cache = layer.forward(x, True)
    grads = layer.backward(x, cache, weight)
    for name in ("e", "u"):
        for at in [(0, 98), (4, 99), (7, 100)] if name == "e" else [(0, 0), (4, 2), (8, 1)]:
            ends = []
            for step in (1e-3, -1e-3):
                layer.p[name][at] += step
                ends.append((layer.forward(x).astype(np.float64) * weight).sum())
                layer.p[name][at] -= step
            assert abs((ends[0] - ends[1]) / 2e-3 - grads[name][at]) < 2e-3


def test_language_holds_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in language.predict(docs, language.fit(docs)).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got.values())
    assert np.mean([r.lang_pred == truth[i] for i, r in got.items() if r.held_out]) > 0.95


def test_language_odd_rows(docs, rows, none, monkeypatch):
    monkeypatch.setattr(language, "ROUNDS", 5)
    got = language.predict(docs, language.fit(docs)).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"en", "de", "und"}
    odd = {r.doc_id: r for r in got}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (100, 101, 102, 105))
    assert language.predict(none, language.fit(docs)).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(none)).collect()} == {"und"}


ITEM = "If John Smith buys 12 apples for 3.5 dollars each, how much will John pay for 12 apples in total this week?"


def test_templates_catch_other_values(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "12 13 14 15 16 17 18 19 20"), (5, "why not now then"), (6, ITEM)], "item_id long, text string")
    docs = [
        (1, "Begin. " + ITEM + " The end."), (2, "If Mary Jones buys 77 apples for 4 dollars each, how much will Mary pay for 77 apples in total this week?"),
        (3, "Nothing of that kind is in here, not even 12 apples for 3 dollars."), (4, None), (5, ""), (6, "21 22 23 24 25 26 27 28 29"), (7, "Well, why not now then?"), (None, ITEM),
        (8, "If Mary Jones buys 77 pears and Bob 99 plums, how much will all of them pay in total this week?"), (1, "Begin. " + ITEM + " The end."),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontamination.contaminated(d, bench).collect()), key=str)
    assert got == sorted([(1, 1), (1, 6), (1, 1), (1, 6), (2, 1), (2, 6), (7, 5), (None, 1), (None, 6)], key=str)
    assert sorted((r.doc_id for r in decontamination.clean_documents(d, bench).collect()), key=str) == [3, 4, 5, 6, 8]
    assert decontamination.contaminated(d, bench.limit(0)).count() == 0
    assert decontamination.clean_documents(d, bench.limit(0)).count() == len(docs)
    assert decontamination.contaminated(d.limit(0), bench).count() == 0


def test_slots_must_be_consistent():
    index = decontamination.Index(pa.array([1]), [b"take 5 of the red balls and 5 of the blue balls now"])
    assert index.matches([b"take 9 of the red balls and 9 of the blue balls now"]) == [(0, 0, 13, 2)]
    assert all(m[2] < 13 for m in index.matches([b"take 9 of the red balls and 8 of the blue balls now"]))


def test_copies_match_whatever_their_literals(spark):
    items = ["What is 37 times 45?", "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9", "THE GREAT FIRE OF LONDON", "Then Anna Bell met Carl Dean near Old Mill Lane in New York City", "Yes", "12, 13!", "take 5 balls and 5 cups and 5 pens now"]
    changed = ["What is 38 times 45?", "3 1 4 2 5 9 2 7 5 3 5 8 8 7 9", "THE GREAT FIRE AT LONDON", "Then Anna Hill met Carl Ford near Old Barn Lane in Old York Town", "No", "12, 14!", "nothing of it"]
    cases = [str, str.lower, str.upper]
    docs = [(10 * i + k, f"Before it. {case(x)} {case('and')} after.") for i, x in enumerate(items) for k, case in enumerate(cases)]
    docs += [(10 * i + 9, f"Before it. {x} and after.") for i, x in enumerate(changed)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(d, bench).collect()}
    assert set(got) == {(10 * i + k, i) for i in range(len(items)) for k in range(3)}
    assert all(r.matched_tokens == r.item_tokens and r.changed_slots == 0 for r in got.values())
    assert sorted(r.doc_id for r in decontamination.clean_documents(d, bench).collect()) == [10 * i + 9 for i in range(len(items))]


def test_slices_of_the_benchmark_give_the_same(spark, sf, monkeypatch):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = sorted(map(tuple, decontamination.contaminated(docs, bench).collect()))
    items, texts = {r.item_id: r.text for r in bench.collect()}, {r.doc_id: r.text for r in docs.collect()}
    assert {(i, j) for i, t in texts.items() for j, x in items.items() if x in t} <= {(w[0], w[1]) for w in want}
    monkeypatch.setattr(decontamination, "SLICE", 1000)
    assert sorted(map(tuple, decontamination.contaminated(docs, bench).collect())) == want


def test_odd_documents(docs, rows, none):
    bench = docs.where("doc_id = 10").selectExpr("doc_id AS item_id", "text")
    got = decontamination.contaminated(docs, bench)
    assert got.columns == ["doc_id", "item_id", "matched_tokens", "item_tokens", "changed_slots"]
    assert decontamination.clean_documents(docs, bench).columns == docs.columns
    assert decontamination.clean_documents(none, bench).count() == 0


def test_templates_of_number_words_and_other_scripts(spark):
    items = ["she bought twelve apples and gave seven of them to her friends at school", "вчера утром в парке Иван Петров встретил старого друга и долго говорил с ним о работе"]
    changed = ["she bought twenty apples and gave nine of them to her friends at school", "вчера утром в парке Олег Смирнов встретил старого друга и долго говорил с ним о работе"]
    bench = spark.createDataFrame([(i, x) for i, x in enumerate(items)] + [(None, None)], "item_id int, text string")
    d = spark.createDataFrame([(i, f"Now, {x}.") for i, x in enumerate(changed)], "doc_id string, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(d, bench).collect()}
    assert set(got) == {("0", 0), ("1", 1)} and all(r.changed_slots == 2 for r in got.values())
    nothing = bench.selectExpr("CAST(NULL AS SMALLINT) AS item_id", "text")
    assert {r.item_id for r in decontamination.contaminated(d, nothing).collect()} == {None}


def test_all_texts_of_a_labelled_id_teach(spark, monkeypatch):
    monkeypatch.setattr(quality, "PER_LABEL", 4)
    docs = spark.createDataFrame([(1, f"text {k % 9}") for k in range(30)] + [(2, "b"), (2, "b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    got = quality.sample(docs, labels, F.lit(True)).collect()
    assert sorted((r.quality, r.doc_id) for r in got) == [(0, 2), (1, 1), (1, 1), (1, 1), (1, 1)]
    assert len({bytes(r.text) for r in got}) == 5
