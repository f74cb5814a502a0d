"""The registered queries of the subpackage: SQL twins, columns of the contracts, and the pipeline's stages."""

import hashlib
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from playtrace.llm.common import ORACLES, QUERIES, table
from tests.compare import compare, connection
from tests.llm.test_repeats import plain_bytes, plain_groups, whole

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id n_lines n_removed n_runs kept_sha256",
    2: "doc_id n_bytes n_removed n_spans kept_sha256",
    3: "doc_id n_shingles component_id",
    4: "doc_id n_tokens n_tokens_edited n_encoded_again edited_chars edited_sha256",
    5: "doc_id held_out lang_pred score",
    6: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    7: "doc_id held_out score predicted",
    8: "doc_id item_id matched_tokens item_tokens changed_slots",
    9: "doc_id size text_crc32 law shard slot grown_shard",
    10: "doc_id size source_size target taken",
    11: "doc_id leaf subroot root proof_sha256 folded_root verified",
    12: "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    13: "doc_id held_out n_tokens n_known train_tokens base_score score",
}


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, connection(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, note


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    got, n = QUERIES[name](spark, SF), int(re.match(r"op(\d+)_", name)[1])
    assert got.columns[: len(COLUMNS[n].split())] == COLUMNS[n].split()
    rows = got.collect()
    documents = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    if n not in (8, 12):
        assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in documents)
    if n == 2:
        assert sorted(map(tuple, rows), key=str) == plain_bytes(documents, 400)
    if n == 3:
        assert sorted(map(tuple, rows), key=str) == plain_groups(documents, 4, 85)
    if n == 4:
        assert {r.doc_id: r.n_tokens for r in rows} == {i: whole(t) for i, t in documents}
    if n == 6:
        order = sorted(documents)
        for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
            r, half = next(r for r in rows if r.doc_id == i), len(t) // 2
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()


def test_stages(spark):
    docs = table(spark, SF, "documents")
    at = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
        if name != "sharding":
            assert at.columns == docs.columns
        at = spark.createDataFrame(kept.setdefault(name, at.collect()), at.schema)
    everything = {r.doc_id: r for r in docs.collect()}
    toxic_or_junk = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    good = kept["quality"]
    assert all(tuple(r) == tuple(everything[r.doc_id]) for r in good)
    assert sum(q == (i in {r.doc_id for r in good}) for i, q in toxic_or_junk.items()) >= 0.95 * len(toxic_or_junk)
    groups = plain_groups([(r.doc_id, r.text) for r in good], 5, 80)
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted(i for i, n, low in groups if i == low or n == 0)
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    clean = {r.doc_id for r in kept["decontamination"]}
    assert clean == {r.doc_id for r in kept["near_duplicates"] if not any(x in r.text for x in items)}
    words = lambda t: len((t or "").encode().split())
    size = sum(words(everything[i].text) for i in clean)
    assert abs(sum(words(r.text) for r in kept["mixing"]) - size) <= 20 * 32
    assert {r.doc_id for r in kept["mixing"]} <= clean and max(Counter(r.doc_id for r in kept["mixing"]).values()) <= 4
    assert Counter((r.doc_id, r.text) for r in kept["sharding"]) == Counter((r.doc_id, r.text) for r in kept["mixing"])
    assert corpus_pipeline.run(spark, SF).count() == len(kept["sharding"])
