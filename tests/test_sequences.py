import random

from pyspark.sql import functions as F

from playtrace.operators import process, sequences


def fold_by_definition(path):
    """Remove the second copy of the first adjacent repeat, shortest block first; start over."""
    path = list(path)
    while True:
        for size, i in ((n, i) for n in range(1, 7) for i in range(len(path) - 2 * n + 1)):
            if path[i : i + size] == path[i + size : i + 2 * size]:
                del path[i + size : i + 2 * size]
                break
        else:
            return path


def _random_paths():
    rnd = random.Random(11)
    paths = {("g", f"s{i}"): "".join(rnd.choice("abc"[: 2 + i % 2]) for _ in range(rnd.randrange(1, 40))) for i in range(150)}
    paths |= {("g", "loop"): "abcabcabc", ("g", "runs"): "aabb", ("g", "odd"): "ababc", ("g", "order"): "abcbabcbc", ("h", "long"): "abcdefg" * 9 + "ab" * 8}
    return paths


def test_folding_equals_its_definition(make_steps):
    paths = _random_paths()
    got = process.folded_paths(make_steps(paths)).collect()
    assert {(r["game_id"], r["session_id"]): r["path"] for r in got} == {k: fold_by_definition(p) for k, p in paths.items()}
    assert all(r["length"] == len(paths[r["game_id"], r["session_id"]]) for r in got)


def test_folding_of_sessions_longer_than_a_segment(make_steps):
    paths = {k: p for k, p in list(_random_paths().items())[-12:]}
    got = process.folded_paths(make_steps(paths), segment=8).collect()
    assert {(r["game_id"], r["session_id"]): r["path"] for r in got} == {k: fold_by_definition(p) for k, p in paths.items()}


def test_look_ahead_across_segments(make_steps):
    path = [str(i % 7) for i in range(23)]
    rows = sequences.with_next(make_steps({("g", "s"): path}), 3, segment=5).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(23))
    for r in rows:
        for n in (1, 2, 3):
            at = r["pos"] + n
            assert r[f"next{n}"] == (path[at] if at < len(path) else None)


def test_paths_continue_on_further_rows(make_steps):
    rows = sequences.paths(make_steps({("g", "s"): "abcdefgh"}), segment=3).orderBy("segment").collect()
    assert ["".join(r["path"]) for r in rows] == ["abc", "def", "gh"]


def test_steps_order_null_sessions_and_null_types(spark):
    rows = [("g", "s", 2, 9, "b"), ("g", "s", 2, 4, None), ("g", "s", 0, 11, "a"), ("g", None, 0, 12, "x")]
    ev = spark.createDataFrame(rows, "game_id string, session_id string, seq int, id long, type string").withColumn("t_ms", F.lit(0))
    assert [r["type"] for r in sequences.steps(ev).orderBy("pos").collect()] == ["a", "?", "b"]


def test_page_clamps_and_clips(make_steps):
    steps = make_steps({("g", f"s{i:02d}"): "ab" * 40 for i in range(10)})
    page = sequences.page(steps, offset=50, limit=4).orderBy("i").collect()
    assert [r["i"] for r in page] == [6, 7, 8, 9]
    assert all(r["clipped"] and r["length"] == 80 and len(r["path"].split(" > ")) == 60 for r in page)
