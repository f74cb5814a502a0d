"""Scoring texts with a smoothed n-gram model, run as a weighted backoff automaton.

Tokens are lower-cased (A-Z) words and one end for each text; a begin stands before each text and is never predicted. An n-gram's
probability is (count + MU * probability without its first token) / (count of its history + MU), down to single tokens with
(count + 1) / (N + V + 1): N training tokens, V distinct ones, one unknown token. As an automaton, every history seen in training
is a state, a seen n-gram is an arc with its probability, and a failure arc leads to the history without its first token, at a cost of
MU / (count of the history + MU). The root has an arc for every token.

1. Documents become blocks of about BLOCK bytes: distinct word hashes and, for each token, its place among them. Blocks are written once.
2. Each block asks for the counts of its distinct n-grams, and tells its own training counts. Requests are parted by range of the n-gram's hash, whose
   number follows from the number of tokens; a range adds up all blocks' counts and answers every block in the order of its request.
3. Blocks meet their answers. A block builds the part of the automaton its own texts can reach, and runs through all of them from left to right, one
   token of every text at a time. Long texts run in several lanes; a lane first reads the ORDER - 1 tokens before it, which
   fix its state.

So no task, nor the driver, holds the model; the driver gets N and V only. A frequent n-gram is one entry in each block. Tokens are told apart by 64-bit hashes.

Nulls: a null text is empty and has the end only; a null id counts as held out. Repeated rows are documents of their own: each teaches, each is scored. Without
training documents every token has probability 1. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.llm.common import Words, byte_codes, bytes_of, crc_of, mixed, query, slices, table
from playtrace.session import durable

ORDER, MU, BLOCK, RANGE, LANE = 2, 200.0, 5_000_000, 1 << 21, 2048
BEGIN, END = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)

_CODES = byte_codes(13)
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes each, first all low bytes, then the next ones, so that files compress them."""
    top = int(values.max()) if len(values) else 0
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)
    raw = values.astype(kind)
    return bytes([raw.itemsize]) + raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    size = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(size, -1).T
    return np.ascontiguousarray(raw).view(f"<u{size}").ravel().astype(np.uint64)


class Block:
    """The tokens of some texts: lengths with begin and end, and hashes; and their n-grams."""

    def __init__(self, lengths: np.ndarray, hashes: np.ndarray, held: np.ndarray):
        self.lengths, self.hashes, self.held = lengths, hashes, held
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.place = np.arange(len(hashes)) - self.starts[self.doc]

    @classmethod
    def of(cls, texts: list[bytes], held: np.ndarray) -> Block:
        w = Words(texts, _CODES)
        lengths = np.bincount(w.doc, minlength=len(texts)) + 2
        ends = np.cumsum(lengths)
        hashes = np.empty(int(lengths.sum()), np.uint64)
        hashes[ends - lengths], hashes[ends - 1] = BEGIN, END
        hashes[np.arange(len(w.hash)) + 2 * w.doc + 1] = w.hash
        return cls(lengths, hashes, held)

    def grams(self, order: int):
        """For each order: the distinct hashes, the first position of each, and for every position its number among them (-1: none ends there)."""
        h = self.hashes
        for k in range(1, order + 1):
            if k > 1:
                h = mixed(np.concatenate([h[:1], h[:-1]]) * np.uint64(0xD6E8FEB86659FD93) + self.hashes + np.uint64(k))
            valid = np.flatnonzero(self.place >= k - 1)
            distinct, first, number = np.unique(h[valid], return_index=True, return_inverse=True)
            at = np.full(len(h), -1, np.int64)
            at[valid] = number
            yield distinct, valid[first] if len(valid) else first, at

    def training_counts(self, at: np.ndarray, size: int) -> np.ndarray:
        teaches = (at >= 0) & ~self.held[self.doc]
        return np.bincount(at[teaches], minlength=size)


class Automaton:
    """States: 0 is the root, others are seen histories. Only what the block's texts can reach."""

    def __init__(self, block: Block, counts: list[np.ndarray], tokens: int, words: int, mu: float):
        """counts: training counts of the block's distinct n-grams, by order."""
        order = len(counts)
        grams = list(block.grams(order))
        self.token = grams[0][2]
        self.known, self.alphabet = counts[0] > 0, len(counts[0])
        offset = np.concatenate([[1], 1 + np.cumsum([len(c) for c in counts])])  # of each order's n-grams, as states
        chance = (counts[0] + 1) / (tokens + words + 1)
        self.base = self.root = np.log10(chance)
        self.root_next = np.where(self.known & (order > 1), offset[0] + np.arange(self.alphabet), 0)
        size = int(offset[order - 1])
        self.fail, self.fail_cost = np.zeros(size, np.int64), np.zeros(size)
        keys, costs, nexts = [], [], []
        for k in range(2, order + 1):
            _, first, at = grams[k - 1]
            lower, history, word = grams[k - 2][2][first], grams[k - 2][2][first - 1], self.token[first]
            seen = counts[k - 1] > 0
            of_history = counts[k - 2]
            chance = (counts[k - 1] + mu * chance[lower]) / (of_history[history] + mu)
            self.fail_cost[offset[k - 2] : offset[k - 1]] = np.log10(mu / (of_history + mu))
            if k < order:
                self.fail[offset[k - 1] : offset[k]] = offset[k - 2] + lower
            keys.append(((offset[k - 2] + history) * self.alphabet + word)[seen])
            costs.append(np.log10(chance[seen]))
            nexts.append((offset[k - 1] + np.arange(len(seen)) if k < order else offset[k - 2] + lower)[seen])
        empty = np.zeros(0, np.int64)
        keys, costs, nexts = (np.concatenate([empty, *x]) for x in (keys, costs, nexts))
        by = np.argsort(keys, kind="stable")
        self.keys, self.costs, self.nexts = keys[by].astype(np.int64), costs[by], nexts[by].astype(np.int64)

    def read(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state and the log-probability of the token, for each lane."""
        cost, out, open_ = np.zeros(len(state)), np.zeros(len(state), np.int64), np.arange(len(state))
        while len(open_):
            s, t = state[open_], token[open_]
            at_root = s == 0
            i = np.searchsorted(self.keys, key := s * self.alphabet + t)
            arc = ~at_root & (i < len(self.keys))
            arc[arc] = self.keys[i[arc]] == key[arc]
            done = open_[arc]
            cost[done] += self.costs[i[arc]]
            out[done] = self.nexts[i[arc]]
            done = open_[at_root]
            cost[done] += self.root[t[at_root]]
            out[done] = self.root_next[t[at_root]]
            open_ = open_[~arc & ~at_root]
            cost[open_] += self.fail_cost[state[open_]]
            state = state.copy()
            state[open_] = self.fail[state[open_]]
        return out, cost

    def scores(self, block: Block, order: int, lane: int = LANE) -> np.ndarray:
        """The log-probability of each text, from one pass over all tokens from left to right."""
        pieces = -(-(block.lengths - 1) // lane)
        of = np.repeat(np.arange(len(pieces)), pieces)
        number = np.arange(len(of)) - (np.cumsum(pieces) - pieces)[of]
        begin = 1 + number * lane  # the first token a lane scores, within its text
        end = np.minimum(begin + lane, block.lengths[of])
        start = np.maximum(0, begin - max(order - 1, 0))
        by = np.argsort(start - end, kind="stable")  # longest first
        of, begin, end, start = of[by], begin[by], end[by], start[by]
        first, steps = block.starts[of], end - start
        state, total = np.zeros(len(of), np.int64), np.zeros(len(of))
        for step in range(int(steps.max()) if len(steps) else 0):
            n = int(np.searchsorted(-steps, -step, "left"))
            state[:n], cost = self.read(state[:n], self.token[first[:n] + start[:n] + step])
            total[:n] += np.where(start[:n] + step >= begin[:n], cost, 0.0)
        return np.bincount(of, weights=total, minlength=len(block.lengths))


def held_out(doc_id: Column, part: int = 2, parts: int = 7) -> Column:
    return F.coalesce(crc_of(doc_id) % parts == part, F.lit(True))


def blocks(docs: DataFrame, held: Column, block_bytes: int = BLOCK) -> DataFrame:
    """block, ids, held and lengths of its texts, words (distinct hashes) and stream (of every token, its place in words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, out = bytes_of(batch.column("text")), batch.column("_held").to_numpy(zero_copy_only=False).astype(bool)
            for a, b in slices(texts, block_bytes):
                block = Block.of(texts[a:b], out[a:b])
                words, stream = np.unique(block.hashes, return_inverse=True)
                one = lambda x: pa.ListArray.from_arrays([0, b - a], x)  # noqa: B023, E731
                columns = [pa.array([number], pa.int64()), one(batch.column("doc_id")[a:b]), one(pa.array(out[a:b])), one(pa.array(block.lengths, pa.int64())), pa.array([pack(words)], pa.binary()), pa.array([pack(stream)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "held", "lengths", "words", "stream"])
                number += 1

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), held.alias("_held"))
    return rows.mapInArrow(run, f"block long, ids array<{docs.schema['doc_id'].dataType.simpleString()}>, held array<boolean>, lengths array<long>, words binary, stream binary")


def _read(row: dict) -> Block:
    hashes = unpack(row["words"])[unpack(row["stream"]).astype(np.int64)]
    return Block(np.asarray(row["lengths"], np.int64), hashes, np.asarray(row["held"], bool))


def counted(written: DataFrame, order: int, ranges: int) -> DataFrame:
    """block, order, range, counts (of the block's distinct n-grams in that range, by hash), and on one row of each range its distinct and all training tokens."""
    bits = max(0, math.ceil(math.log2(max(1, ranges))))
    bounds = np.array([k << (64 - bits) for k in range(1, 1 << bits)], np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _read(row)
                for k, (distinct, _, at) in enumerate(block.grams(order), 1):
                    own = block.training_counts(at, len(distinct))
                    cuts = np.concatenate([[0], np.searchsorted(distinct, bounds), [len(distinct)]])
                    some = np.flatnonzero(np.diff(cuts))
                    columns = [pa.array(some, pa.int64()), pa.array(np.full(len(some), k), pa.int32()), pa.array(np.full(len(some), row["block"]), pa.int64())]
                    columns += [pa.array([pack(x[cuts[i] : cuts[i + 1]]) for i in some], pa.binary()) for x in (distinct, own)]
                    yield pa.RecordBatch.from_arrays(columns, ["range", "order", "block", "grams", "counts"])

    def add(asked: pa.Table) -> pa.Table:
        grams = [unpack(x) for x in asked.column("grams").to_pylist()]
        counts = np.concatenate([unpack(x) for x in asked.column("counts").to_pylist()])
        distinct, number = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(number, weights=counts).astype(np.int64)  # exact up to 2 ** 53
        ends = np.cumsum([len(g) for g in grams])
        answers = [pack(total[number[e - len(g) : e]]) for e, g in zip(ends, grams)]
        single = asked.column("order")[0].as_py() == 1
        taught = total[distinct != BEGIN] if single else total[:0]
        once = lambda x: pa.array([int(x)] + [0] * (len(grams) - 1), pa.int64())
        return pa.table([asked.column("block"), asked.column("order"), asked.column("range"), pa.array(answers, pa.binary()), once((taught > 0).sum()), once(taught.sum())], ["block", "order", "range", "counts", "words", "tokens"])

    asked = written.select("block", "held", "lengths", "words", "stream").mapInArrow(ask, "range long, order int, block long, grams binary, counts binary")
    return asked.groupBy("order", "range").applyInArrow(add, "block long, order int, range long, counts binary, words long, tokens long")


def scored(docs: DataFrame, held: Column, order: int = ORDER, mu: float = MU, block_bytes: int = BLOCK, range_tokens: int = RANGE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    assert order >= 1
    written = durable(blocks(docs, held, block_bytes))
    size = written.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    answers = durable(counted(written, order, -(-size // range_tokens)))
    words, tokens = (int(x or 0) for x in answers.agg(F.sum("words"), F.sum("tokens")).first())
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(texts: pa.Table, told: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        block = _read(row)
        told = told.sort_by([("order", "ascending"), ("range", "ascending")])
        by = told.column("order").to_numpy()
        data = [unpack(x).astype(np.int64) for x in told.column("counts").to_pylist()]
        counts = [np.concatenate([np.zeros(0, np.int64), *(d for d, o in zip(data, by) if o == k)]) for k in range(1, order + 1)]
        machine = Automaton(block, counts, tokens, words, mu)
        n, scoring = len(block.lengths), block.place > 0
        token, doc = machine.token[scoring], block.doc[scoring]
        known = np.bincount(doc, weights=machine.known[token], minlength=n).astype(np.int64)
        base = np.bincount(doc, weights=machine.base[token], minlength=n)
        ids = texts.column("ids").combine_chunks().flatten()
        columns = [ids, pa.array(block.held), pa.array(block.lengths - 1), pa.array(known), pa.array(np.full(n, tokens, np.int64)), pa.array(base), pa.array(machine.scores(block, order))]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return written.groupBy("block").cogroup(answers.select("block", "order", "range", "counts").groupBy("block")).applyInArrow(score, schema)


_SQL = rf"""
WITH crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS c, text FROM documents),
d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(c % 7 = 2, true) AS held,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM crc),
t AS (SELECT rn, held, unnest(list_append(w, ' end')) AS tok, unnest(list_prepend(' begin', w)) AS prev FROM d),
uni AS (SELECT tok, count(*) FILTER (WHERE NOT held) AS c FROM t GROUP BY 1),
hist AS (SELECT prev, count(*) FILTER (WHERE NOT held) AS c FROM t GROUP BY 1),
bi AS (SELECT prev, tok, count(*) FILTER (WHERE NOT held) AS c FROM t GROUP BY 1, 2),
size AS (SELECT sum(c)::BIGINT AS n, count(*) FILTER (WHERE c > 0) AS v FROM uni),
p AS (SELECT t.rn, uni.c > 0 AS known, (uni.c + 1)::DOUBLE / (size.n + size.v + 1) AS p1, CASE WHEN hist.c = 0 THEN NULL ELSE hist.c END AS h, bi.c AS b
    FROM t JOIN uni USING (tok) JOIN hist USING (prev) JOIN bi USING (prev, tok), size),
s AS (SELECT rn, count(*) AS n_tokens, count(*) FILTER (WHERE known) AS n_known, sum(log10(p1)) AS base_score, sum(log10(coalesce((b + {MU} * p1) / (h + {MU}), p1))) AS score FROM p GROUP BY 1)
SELECT doc_id, held AS held_out, n_tokens, n_known, n AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM s JOIN d USING (rn), size"""


@query("op13_backoff_automaton", _SQL)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, held_out(F.col("doc_id"))).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})
