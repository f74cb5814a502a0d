"""Token counts that follow edits.

A tokenizer with byte-pair ranks cuts a text into pre-tokens, by a pattern that looks at most two characters ahead and never back, and each
pre-token into tokens on its own. A document's tree has runs of LEAF pre-tokens as leaves and sums of characters and tokens above
them. An edit finds its leaves by the sums of characters, re-encodes them from two characters of context before the edit on to the
first old boundary behind it where a new pre-token ends as well, and updates the sums on the paths to the root. All other leaves stay.

``count_trees`` keeps the leaves as columns of a table; ``recount`` takes them up again without encoding the text anew. The folder of
vocabulary files is a parameter.

Nulls: a null text has no tokens; null edits, or none, change nothing; a null bound of an edit is the end of the text, a null replacement is
empty; bounds outside the text are clipped. Edits apply one after the other, each to the result of the last. Repeated rows are
counted one by one.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.llm.common import query, table

FOLDER, FILE = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
LEAF, CACHED, CHUNK = 64, 300_000, 1 << 20

# Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counter(dict):
    """Tokens of a pre-token; remembers CACHED of them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        n = len(self.bpe.encode_single_piece(piece.encode("utf-8", "replace")))
        if len(self) >= CACHED:
            self.clear()
        self[piece] = n
        return n

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Lists of pre-tokens; long texts in chunks, each from the last sure boundary on."""
        at, step = 0, CHUNK
        while at + step < len(text):
            part = self.pattern.findall(text, at, at + step)[:-2]  # what the cut may have changed
            if part:
                at, step = at + sum(map(len, part)), CHUNK
                yield part
            else:
                step *= 2
        yield self.pattern.findall(text, at)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def leaves(text: str, count: Counter) -> tuple[list[int], list[int]]:
    """Characters and tokens of each run of LEAF pre-tokens."""
    chars, tokens, rest = [], [], []
    for part in count.pieces(text):
        rest += part
        whole = len(rest) - len(rest) % LEAF
        for i in range(0, whole, LEAF):
            run = rest[i : i + LEAF]
            chars.append(sum(map(len, run)))
            tokens.append(sum(map(count.__getitem__, run)))
        rest = rest[whole:]
    if rest:
        chars.append(sum(map(len, rest)))
        tokens.append(sum(map(count.__getitem__, rest)))
    return chars, tokens


class Tree:
    """Sums over the leaves of one text, in an array: node i has the children 2i and 2i + 1."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], count: Counter):
        self.count, self.encoded = count, 0
        self._build(self._cut(text, chars), chars, tokens)

    @staticmethod
    def _cut(text: str, chars: list[int]) -> list[str]:
        out, at = [], 0
        for n in chars:
            out.append(text[at : at + n])
            at += n
        return out

    def _build(self, texts: list[str], chars: list[int], tokens: list[int]):
        self.texts = texts or [""]
        self.size = 1 << (len(self.texts) - 1).bit_length()
        pad = [0] * (self.size - max(1, len(chars)))
        self.chars, self.tokens = [0] * self.size + (chars or [0]) + pad, [0] * self.size + (tokens or [0]) + pad
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.texts)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf with character `at` (the last with characters, at the end) and where it begins."""
        i, begin = 1, 0
        at = max(0, min(at, self.chars[1] - 1))
        while i < self.size:
            i *= 2
            if at - begin >= self.chars[i]:
                begin += self.chars[i]
                i += 1
        return i - self.size, begin

    def _set(self, leaf: int, text: str, tokens: int):
        self.texts[leaf] = text
        i = leaf + self.size
        self.chars[i], self.tokens[i] = len(text), tokens
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, stop: int, replacement: str):
        """Put replacement in place of the characters from start to stop."""
        length = self.chars[1]
        start = max(0, min(start, length))
        stop = max(start, min(stop, length))
        first, begin = self._find(start - 2)
        last, _ = self._find(max(stop - 1, start - 1, 0))
        old = "".join(self.texts[first : last + 1])
        region = old[: start - begin] + replacement + old[stop - begin :]
        behind = last + 1
        while True:  # until a new pre-token ends where the leaves behind begin
            while behind < len(self.texts) and not self.texts[behind]:
                behind += 1
            context, more = "", behind
            while more < len(self.texts) and len(context) < 2:
                context += self.texts[more]
                more += 1
            pieces = [p for part in self.count.pieces(region + context) for p in part]
            done, kept = 0, 0
            while kept < len(pieces) and done < len(region):
                done += len(pieces[kept])
                kept += 1
            if done == len(region):
                break
            region += self.texts[behind]
            behind += 1
        pieces = pieces[:kept]
        self.encoded += len(pieces)
        room = behind - first  # the same leaves take the new pre-tokens
        each = -(-len(pieces) // room)
        if each > 8 * LEAF:  # too many: the region gets leaves of its own, and the sums are made anew
            runs = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)]
            inner = ["".join(r) for r in runs], [sum(map(len, r)) for r in runs], [sum(map(self.count.__getitem__, r)) for r in runs]
            n = len(self.texts)
            outer = self.texts, self.chars[self.size : self.size + n], self.tokens[self.size : self.size + n]
            self._build(*(o[:first] + i + o[behind:] for o, i in zip(outer, inner)))
            return
        for k in range(room):
            run = pieces[k * each : (k + 1) * each]
            self._set(first + k, "".join(run), sum(map(self.count.__getitem__, run)))


def count_trees(docs: DataFrame, columns: list[str], path: str = f"{FOLDER}/{FILE}") -> DataFrame:
    """columns of docs, and _text, _chars and _tokens: characters and tokens of each leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            got = [leaves(t or "", count) for t in batch.column("_text").to_pylist()]
            extra = [pa.array([g[k] for g in got], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "_chars", "_tokens"])

    rows = docs.select(*columns, F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"{_ddl(rows)}, _chars array<int>, _tokens array<int>")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def recount(trees: DataFrame, edits: Column, path: str = f"{FOLDER}/{FILE}") -> DataFrame:
    """The columns of trees but the leaves, and _n_tokens, _n_edited, _encoded (pre-tokens encoded again), _edited_chars, _edited_sha256.

    edits: an array of structs (start, stop, text), applied in turn.
    """
    names = [c for c in trees.columns if c not in ("_text", "_chars", "_tokens")]
    rows = trees.withColumn("_edits", edits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            out = []
            for text, chars, tokens, todo in zip(*(batch.column(c).to_pylist() for c in ("_text", "_chars", "_tokens", "_edits"))):
                tree = Tree(text or "", chars, tokens, count)
                before = tree.total()
                for e in todo or []:
                    start, stop, new = e.values()
                    end = tree.chars[1]
                    tree.edit(end if start is None else start, end if stop is None else stop, new or "")
                after = tree.text()
                out.append((before, tree.total(), tree.encoded, len(after), hashlib.sha256(after.encode("utf-8", "replace")).hexdigest()))
            cols = [pa.array([o[k] for o in out], pa.int64()) for k in range(4)] + [pa.array([o[4] for o in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *cols], [*names, "_n_tokens", "_n_edited", "_encoded", "_edited_chars", "_edited_sha256"])

    schema = f"{_ddl(trees.select(*names))}, _n_tokens long, _n_edited long, _encoded long, _edited_chars long, _edited_sha256 string"
    return rows.select(*names, "_text", "_chars", "_tokens", "_edits").mapInArrow(run, schema)


def sample_edits(text: Column) -> Column:
    """Three edits made from the text itself: 40 characters go after a third, the first 30 come in after two thirds, and the last 20 become the first 20 in capitals."""
    n = F.coalesce(F.length(text), F.lit(0))
    third = F.floor(n / 3).cast("int")
    one = F.struct(third.alias("start"), (third + 40).alias("stop"), F.lit("").alias("text"))
    left = n - F.least(F.lit(40), n - third)
    two = F.struct((third * 2).alias("start"), (third * 2).alias("stop"), F.substring(text, 1, 30).alias("text"))
    end = left + F.least(F.lit(30), n)
    three = F.struct(F.greatest(F.lit(0), end - 20).alias("start"), end.alias("stop"), F.upper(F.substring(text, 1, 20)).alias("text"))
    return F.array(one, two, three)


@query("op4_edit_token_counts")
def _(spark, sf_dir):
    trees = count_trees(table(spark, sf_dir, "documents"), ["doc_id"])
    r = recount(trees, sample_edits(F.col("_text")))
    return r.select("doc_id", F.col("_n_tokens").alias("n_tokens"), F.col("_n_edited").alias("n_tokens_edited"), F.col("_encoded").alias("n_encoded_again"), F.col("_edited_chars").alias("edited_chars"), F.col("_edited_sha256").alias("edited_sha256"))
