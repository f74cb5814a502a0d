"""Removal of repeated byte strings with a sparse suffix array, sorted in deep-shallow manner.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else, too, in the same or another document. All
such strings need not be sorted: of the starts within each one, the one with the smallest hash of the next 8 bytes is its anchor, so equal strings have
their anchor at the same place. An anchor stands for the neighbouring strings that share it; its context is the bytes they cover.

1. Anchors whose next GRAM bytes occur once cannot repeat and are left out after counting.
2. Equal contexts (same bytes around the anchor) are collapsed to one class with a count; with two or more, all of it repeats.
3. Where a gram has several classes, the bytes of one context of each are fetched, and the suffixes behind the anchor, and those before it read backwards, are
   sorted: multikey quicksort to a depth of SHALLOW bytes, then a blind trie for every group that is still equal. The common prefixes of
   neighbours in both orders tell which strings two classes share.

A gram with over CROWD classes is not sorted in one task: its contexts are parted by eighths of the starts and the bytes common to
all strings that start there, then by smaller ranges, until a part is small enough or one string is left. Document order does not matter.

Matches never cross rows. Nulls: a null text is empty; a null id is an id like any other. A text shorter than LENGTH keeps all. Rows
with equal id and text are documents of their own, so they repeat each other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.llm.common import bytes_of, mixed, query, slices, table
from playtrace.session import durable

LENGTH, GRAM, SHALLOW, CROWD = 400, 100, 16, 2000
_BLOCK = 1 << 20


def _smallest(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours, by doubling."""
    size, m = 1, key
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(key) - width + 1], m[width - size :]) if size < width else m


def _anchors_of(data: np.ndarray, doc: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Anchor, first start and last start of all anchors in a block of at most 2**20 bytes (doc: text of each byte, ends: of each text)."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3
    w = data.astype(np.uint64)
    for k in (1, 2, 4):
        w[:-k] |= w[k:] << np.uint64(8 * k)
    key = (mixed(w) >> np.uint64(20) << np.uint64(20)) | np.arange(len(data), dtype=np.uint64)
    place = (_smallest(key, length - gram + 1) & np.uint64(_BLOCK - 1)).astype(np.int64)[: len(data) - length + 1]
    start = np.arange(len(place))
    valid = start + length <= ends[doc[: len(place)]]
    start, place = start[valid], place[valid]
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    turn = np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(turn)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return place[first], start[first], start[last]


def anchors(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Text number, anchor, first and last start, hash of the gram, hash of the context; in blocks."""
    for a, b in slices(texts, _BLOCK // 2):
        many = b > a + 1 or len(texts[a]) <= _BLOCK
        joined = b"".join(texts[a:b])
        step = len(joined) if many else _BLOCK - length
        sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
        for base in range(0, max(1, len(joined) - length + 1) if not many else 1, max(1, step)):
            part = joined if many else joined[base : base + _BLOCK - 1]
            data = np.frombuffer(part, np.uint8)
            ends = np.cumsum(sizes) if many else np.array([len(part)])
            doc = np.repeat(np.arange(b - a), sizes) if many else np.zeros(len(part), np.int64)
            p, lo, hi = _anchors_of(data, doc, ends, length, gram)
            grams = np.fromiter((xxhash.xxh3_64_intdigest(part[i : i + gram]) for i in p.tolist()), np.uint64, len(p)).view(np.int64)
            context = np.fromiter((xxhash.xxh3_64_intdigest(part[i : j + length], seed=k - i) for k, i, j in zip(p.tolist(), lo.tolist(), hi.tolist())), np.uint64, len(p)).view(np.int64)
            d = doc[lo]
            shift = base - (ends - sizes)[d] if many else np.full(len(p), base)
            yield d + a, p + shift, lo + shift, hi + shift, grams, context


def _map_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, *numbers in anchors(bytes_of(batch.column("text")), length, gram):
                d = pa.array(d)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(d), batch.column("_text").take(d), *(pa.array(x, t) for x, t in zip(numbers, (pa.int64(),) * 5))], ["doc_id", "_text", "at", "lo", "hi", "gram", "context"])

    return run


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, by halving; the first `known` bytes are equal."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low if a[low : low + 1] != b[low : low + 1] else low + 1


class _Node:
    __slots__ = ("depth", "branches", "leaf")

    def __init__(self, depth: int, leaf: int = -1):
        self.depth, self.branches, self.leaf = depth, {}, leaf


def blind_trie(strings: list[bytes], group: list[int], known: int) -> tuple[list[int], list[int]]:
    """Order of the strings in group, and the common prefix of each with the one before (the first: 0). All share `known` bytes.

    Inner nodes hold the depth at which strings part and one branch for each next byte (-1 at a string's end);
    the bytes between are not compared on the way down, but once with the leaf found there.
    """
    root = _Node(known)
    for i in group:
        s, path, node = strings[i], [root], root
        while node.branches and node.leaf < 0:
            c = s[node.depth] if node.depth < len(s) else -1
            node = node.branches.get(c) or next(iter(node.branches.values()))
            path.append(node)
        if node.leaf < 0:  # the empty trie
            root.branches[s[known] if known < len(s) else -1] = _Node(len(s), i)
            continue
        other = strings[node.leaf]
        depth = common_prefix(s, other, known)
        k = next(k for k, n in enumerate(path) if n.depth >= depth or n.leaf >= 0)
        below = path[k]
        mine, theirs = (x[depth] if depth < len(x) else -1 for x in (s, other))
        if below.leaf < 0 and below.depth == depth:
            place = below
        else:
            if mine == theirs:  # equal strings: beside each other in one bucket
                below.branches[len(below.branches)] = _Node(len(s), i)
                continue
            place = _Node(depth)
            place.branches[theirs] = below
            if k == 0:
                root = place
            else:
                parent = path[k - 1]
                key = next(c for c, n in parent.branches.items() if n is below)
                parent.branches[key] = place
        if mine == -1 and -1 in place.branches:
            end = place.branches[-1]
            end.branches[len(end.branches)] = _Node(len(s), i)
        else:
            place.branches[mine] = _Node(len(s), i)
    order, prefix = [], []

    def walk(start: _Node):
        stack = [(start, 0)]
        while stack:
            node, shared = stack.pop()
            if node.leaf >= 0:
                order.append(node.leaf)
                prefix.append(shared)
                for n in node.branches.values():
                    order.append(n.leaf)
                    prefix.append(len(strings[n.leaf]))
                continue
            keys = sorted(node.branches)
            for c in reversed(keys[1:]):
                stack.append((node.branches[c], node.depth))
            if keys:
                stack.append((node.branches[keys[0]], shared))

    walk(root)
    return order, prefix


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of all strings and the common prefix of each with the one before."""
    order: list[int] = []
    prefix: list[int] = []
    stack = [(list(range(len(strings))), 0, 0)]  # strings equal to a depth; what the first shares with the one before
    while stack:
        group, depth, shared = stack.pop()
        if len(group) == 1 or depth < 0:  # one string, or equal ones
            order += group
            prefix += [shared] + [len(strings[group[0]])] * (len(group) - 1)
            continue
        if depth >= shallow:
            own, among = blind_trie(strings, group, depth)
            order += own
            prefix += [shared, *among[1:]]
            continue
        pivot = strings[group[len(group) // 2]][depth : depth + 1]  # empty at a string's end
        parts: tuple[list[int], list[int], list[int]] = ([], [], [])
        for i in group:
            c = strings[i][depth : depth + 1]
            parts[(c >= pivot) + (c > pivot)].append(i)
        less, same, more = parts
        todo = []
        for part, deeper in ((less, depth), (same, depth + 1 if pivot else -1), (more, depth)):  # without a pivot they have ended, so are equal
            if part:
                todo.append((part, deeper, shared if not todo else depth))
        stack += reversed(todo)
    return order, prefix


def shared_strings(contexts: list[bytes], before: list[int], length: int, low: int = 0, high: int | None = None) -> list[list[tuple[int, int]]]:
    """Of contexts around one gram (before: bytes ahead of the anchor) the ranges (from, to) that strings in two of them cover.

    Only strings that start from low to high bytes ahead of the anchor count.
    """
    n = len(contexts)
    if n < 2:
        return [[] for _ in contexts]
    right = [c[k:] for c, k in zip(contexts, before)]
    left = [c[:k][::-1] for c, k in zip(contexts, before)]
    r_order, r_prefix = deep_shallow(right)
    l_order, l_prefix = deep_shallow(left)
    first = np.array([length - len(r) for r in right])  # a string starts from so many bytes before the anchor ...
    last = np.array(before)  # ... to so many
    steps = np.arange(max(low, int(first.min())), min(int(last.max()), length if high is None else high) + 1)
    if not len(steps):
        return [[] for _ in contexts]
    r_class, l_class = np.empty((n, len(steps)), np.int64), np.empty((n, len(steps)), np.int64)
    r_class[r_order] = np.cumsum(np.array(r_prefix)[:, None] < (length - steps)[None, :], axis=0)
    l_class[l_order] = np.cumsum(np.array(l_prefix)[:, None] < steps[None, :], axis=0)
    key = l_class * (n + 1) + r_class
    valid = (first[:, None] <= steps) & (steps <= last[:, None])
    key[~valid] = -1 - np.broadcast_to(np.arange(n)[:, None], key.shape)[~valid]
    rank = np.argsort(key, axis=0, kind="stable")
    ordered = np.take_along_axis(key, rank, 0)
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(key.shape, bool)
    twice[:-1] |= same
    twice[1:] |= same
    hit = np.zeros(key.shape, bool)
    np.put_along_axis(hit, rank, twice, 0)
    out = []
    for i in range(n):
        d = steps[hit[i]]
        runs = np.split(d, np.flatnonzero(np.diff(d) > 1) + 1) if len(d) else []
        out.append([(before[i] - int(r[-1]), before[i] - int(r[0]) + length) for r in runs])
    return out


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


_FOUND = "gram long, context long, ranges array<struct<start: long, stop: long>>"
_CONTEXT = "gram long, context long, before int, bytes binary, k1 long, k2 long, low int, high int"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in r] for r in cols[2]], _RANGES)], ["gram", "context", "ranges"])


def _sort_contexts(length: int):
    """Rows arrive sorted by key (k1, k2); the classes of one key, at most CROWD, are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def close():
            if held:
                found = shared_strings([h[3] for h in held], [h[2] for h in held], length, *held[0][6:])
                out.extend((h[0], h[1], f) for h, f in zip(held, found) if f)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[4:6] != key:
                    close()
                    key, held = row[4:6], []
                held.append(row)
            if out:
                yield _found(out)
                out = []
        close()
        if out:
            yield _found(out)

    return run


def _split(length: int, size: int):
    """A row for each range of `size` starts; its key is the hash of the bytes that all strings with these starts have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gram, context, k, data, _, _, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                for a in range(low, high + 1, size):
                    b = min(a + size - 1, high)
                    if a <= k and b >= length - (len(data) - k):  # the context has strings with such starts
                        core = data[max(0, k - a) : k + length - b]
                        h = xxhash.xxh3_128_intdigest(core, seed=a * (length + 1) + min(a, k))
                        out.append((gram, context, k, data, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), a, b))
            cols = list(zip(*out)) or [()] * 8
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["gram", "context", "before", "bytes", "k1", "k2", "low", "high"])

    return run


def _common(contexts: DataFrame, length: int, crowd: int) -> list[DataFrame]:
    """The ranges shared by contexts of one key. Keys of over ``crowd`` contexts are split by starts, again and again, so that
    contexts stay together only while ever more of their bytes are equal; with one start left, they all share that string.
    """
    out, key, contexts = [], ["k1", "k2"], durable(contexts)
    for size in (length // 8, length // 64, 1):
        many = F.broadcast(contexts.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).drop("_n"))  # at most one row for each crowd of contexts
        # Dealt by a hash of the key: after a join by the same columns Spark would leave out this shuffle, and adaptive execution,
        # which sees no need to keep a key's rows together, may then deal the rows of that join to other tasks.
        few = contexts.join(many, key, "left_anti").select(*contexts.columns).repartition(F.xxhash64(*key)).sortWithinPartitions(*key)
        out.append(few.mapInArrow(_sort_contexts(length), _FOUND))
        contexts = durable(contexts.join(many, key).select(*contexts.columns).mapInArrow(_split(length, max(1, size)), _CONTEXT))
    equal = contexts.join(contexts.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1"), key)
    start = (F.col("before") - F.col("low")).cast("long")
    out.append(equal.groupBy("gram", "context").agg(F.collect_list(F.struct(start.alias("start"), (start + length).alias("stop"))).alias("ranges")))
    return out


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, _text (hash of the text) and spans: ranges of bytes (start, stop) that repeated strings cover; they may overlap."""
    source = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.col("text").cast("binary").alias("text")).where(F.length("text") >= length)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    marks = durable(source.mapInArrow(_map_anchors(length, gram), f"doc_id {id_type}, _text long, at long, lo long, hi long, gram long, context long"))
    counted = marks.groupBy("gram").agg(F.count("*").alias("_n"), (F.min("context") < F.max("context")).alias("_several")).where("_n > 1").drop("_n")
    marks = durable(marks.join(counted, "gram"))

    one = F.struct("doc_id", "_text", "lo", "at", "hi")
    classes = marks.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(one).alias("one"), F.first("_several").alias("several"))
    classes = durable(classes)
    whole = classes.where("n > 1").select("gram", "context", F.array(F.struct(F.lit(0).cast("long").alias("start"), (F.col("one.hi") - F.col("one.lo") + length).alias("stop"))).alias("ranges"))

    several = classes.where("several").select("gram", "context", F.col("one.doc_id").alias("_d"), F.col("one._text").alias("_t"), F.col("one.lo").alias("lo"), F.col("one.at").alias("at"), F.col("one.hi").alias("hi"))
    cut = F.substring(F.col("text"), (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo") + length).cast("int"))
    contexts = source.join(several, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")))
    contexts = contexts.select("gram", "context", (F.col("at") - F.col("lo")).cast("int").alias("before"), cut.alias("bytes")).dropDuplicates(["gram", "context"])
    keyed = contexts.withColumns({"k1": F.col("gram"), "k2": F.lit(0).cast("long"), "low": F.lit(0), "high": F.lit(length - gram)})
    found = reduce(DataFrame.unionByName, [whole, *_common(keyed, length, crowd)])
    found = durable(found).groupBy("gram", "context").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))

    spans = F.transform("ranges", lambda r: F.struct((F.col("lo") + r.start).alias("start"), (F.col("lo") + r.stop).alias("stop")))
    members = marks.select("doc_id", "_text", "lo", "gram", "context").distinct().join(found, ["gram", "context"])
    return members.select("doc_id", "_text", spans.alias("_s")).groupBy("doc_id", "_text").agg(F.flatten(F.collect_list("_s")).alias("spans"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, runs = [], [], []
        for text, spans in zip(bytes_of(batch.column("text")), batch.column("spans").to_pylist()):
            at, parts, gone, n = 0, [], 0, 0
            end = -1  # of the removed run so far
            for s, e in sorted((s["start"], s["stop"]) for s in spans or []):
                if s > end:
                    parts.append(text[at:s])
                    n += 1
                    end = s
                gone += max(0, e - end)
                end = at = max(end, e)
            parts.append(text[at:])
            kept.append(b"".join(parts))
            removed.append(gone)
            runs.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array([len(k) + r for k, r in zip(kept, removed)], pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """For every row: doc_id, kept (bytes), n_bytes, n_removed and n_spans (maximal removed runs)."""
    found = repeats(docs, length, gram, crowd).select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), "spans")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")), "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut_out, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept binary, n_bytes long, n_removed long, n_spans long")


@query("op2_suffix_dedup")
def _(spark, sf_dir):
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
