"""Benchmark decontamination by templates, which also finds questions with other numbers, names or units.

Words of benchmark items and documents become template tokens: a number (of digits or an English number word), a name (a capitalised word that does not begin a sentence) and a
unit after a number turn into typed placeholders, all else into the hash of its lower-case form. Windows of
WINDOW tokens are looked up by hash; a window needs MIN_LITERAL tokens that are no placeholders. Windows of one document
and item on the same diagonal are one alignment; there each token is compared again, and the slots must be
consistent: one value of the item stands for one value of the document. Windows with another value are dropped.

Windows are also joined without placeholders, on the tokens' lower-case forms, whatever their literals. So a copy of an item
is found in full, also one of numbers or names only, or in other case (of ASCII letters). A
document is contaminated if the windows of both joins cover SHARE of an item's tokens, or LONG of them.

The benchmark is joined in slices of at most SLICE bytes of text, each broadcast; documents never move.

Nulls: a null text has no words and matches nothing; null ids are reported like any other. Items with fewer tokens
than a window match as a whole, even a single word; with fewer than MIN_LITERAL literal tokens only by a copy, as they hold no wording to
recognise with other values. Items without tokens match nothing. Repeated rows give repeated results; equal items are reported one by one.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from playtrace.llm.common import Words, byte_codes, query, released, table, text_slices

WINDOW, MIN_LITERAL, SHARE, LONG, SLICE = 8, 4, 0.5, 30, 8_000_000

# Units that may follow a number.
UNITS = """kg g mg lb lbs oz ton tons km m cm mm mi mile miles ft feet foot inch inches yard yards l ml litre litres liter liters
s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
percent dollar dollars euro euros cent cents pound pounds degree degrees mph kmh kw kwh w watt watts v volt volts""".split()

# Words that are numbers.
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()

_CAPITAL = np.array([chr(c).isupper() for c in range(1 << 16)])  # of every script, by code point

_CODES = byte_codes(8)
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]
_DIGIT, _WORD, _END = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _WORD[ord(_a) : ord(_b) + 1] = True
_WORD[128:] = True
_END[list(b".!?:\n")] = True
NUMBER, NAME, UNIT = 1, 2, 3  # types of slots; as hashes they stand for the token


def _inside(data: np.ndarray) -> np.ndarray:
    mask = _WORD[data]
    if len(data) > 2:  # a point or comma between digits belongs to the number
        digit = _DIGIT[data]
        mask[1:-1] |= ((data[1:-1] == ord(".")) | (data[1:-1] == ord(","))) & digit[:-2] & digit[2:]
    return mask




class Templates:
    """The template tokens of several texts: token (hash or slot type), kind (0 for a literal) and raw hash."""

    def __init__(self, texts: list[bytes]):
        self.words = w = Words(texts, _CODES, _inside)
        n, data = len(w.start), w.data
        self.doc, self.raw = w.doc, w.hash
        kind = np.zeros(n, np.int8)
        if n:
            digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
            number = (digits[w.end] > digits[w.start]) | np.isin(w.hash, _NUMBER_HASHES)
            capital = _CAPITAL[_first_letters(data, w.start)]
            same = np.concatenate([[False], w.doc[1:] == w.doc[:-1]])
            ends = np.concatenate([[0], np.cumsum(_END[data])])
            before = np.concatenate([[0], w.end[:-1]])
            begins = ~same | (ends[w.start] > ends[before])
            after_number = same & np.concatenate([[False], number[:-1]])
            kind[capital & ~begins] = NAME
            kind[after_number & np.isin(w.hash, _UNIT_HASHES)] = UNIT
            kind[number] = NUMBER
        self.kind = kind
        self.token = np.where(kind > 0, kind.astype(np.uint64), w.hash)
        self.literals = np.concatenate([[0], np.cumsum(kind == 0)])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First token and hash of all windows of n tokens with enough literals."""
        first, h = self.words.grams(n, self.token)
        enough = self.literals[first + n] - self.literals[first] >= MIN_LITERAL
        return first[enough], h[enough]


def _first_letters(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The code point at each start, 0 beyond the sixteenth bit."""
    a, b, c = (data[np.minimum(start + k, len(data) - 1)].astype(np.int64) for k in range(3))
    two, three = (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63
    return np.select([a < 0x80, a < 0xE0, a < 0xF0], [a, two, three], 0)


_NUMBER_HASHES = np.sort(Words([u.encode() for u in NUMBER_WORDS], _CODES).hash)
_UNIT_HASHES = np.sort(Words([u.encode() for u in UNITS], _CODES).hash)


class Index:
    """The windows of a slice of the benchmark, for look-up."""

    def __init__(self, ids: pa.Array, texts: list[bytes]):
        self.ids, self.t = ids, Templates(texts)
        bounds = np.searchsorted(self.t.doc, np.arange(len(ids) + 1))
        self.begin, self.length = bounds[:-1], np.diff(bounds)
        sizes = sorted({min(WINDOW, int(x)) for x in self.length if x})
        self.by_size = {n: self._sorted(n, *self.t.windows(n)) for n in sizes}
        self.exact = {n: self._sorted(n, *self.t.words.grams(n)) for n in sizes}

    def _sorted(self, n: int, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if n < WINDOW:  # only items of just this length
            own = self.length[self.t.doc[first]] == n
            first, h = first[own], h[own]
        order = np.argsort(h, kind="stable")
        return h[order], first[order]

    def copies(self, t: Templates) -> dict[tuple[int, int], set]:
        """The tokens of items that stand in texts as they are, in windows: by (text, item)."""
        found = defaultdict(set)
        for n, (hashes, first) in self.exact.items():
            at, h = t.words.grams(n)
            low = np.searchsorted(hashes, h, "left")
            hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == h) if len(hashes) else []
            if len(hit):  # where in a text a window stands does not matter, so once is enough
                hit = hit[np.unique(np.stack([t.doc[at[hit]].astype(np.uint64), h[hit]]), axis=1, return_index=True)[1]]
            for k in hit:
                i = int(at[k])
                for j in first[low[k] : np.searchsorted(hashes, h[k], "right")]:
                    if np.array_equal(t.raw[i : i + n], self.t.raw[j : j + n]):
                        found[int(t.doc[i]), int(self.t.doc[j])].update(range(int(j), int(j) + n))
        return found

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, covered tokens, changed slots) of all contaminations."""
        t = Templates(texts)
        found: dict[tuple[int, int], dict[int, set]] = defaultdict(lambda: defaultdict(set))
        for n, (hashes, first) in self.by_size.items():
            at, h = t.windows(n)
            low = np.searchsorted(hashes, h, "left")
            hit = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == h)) if len(hashes) else []
            for k in hit:
                i = int(at[k])
                for j in first[low[k] : np.searchsorted(hashes, h[k], "right")]:
                    if np.array_equal(t.token[i : i + n], self.t.token[j : j + n]):
                        found[int(t.doc[i]), int(self.t.doc[j])][i - int(j)].add((int(j), n))
        out, copied = [], self.copies(t)
        for text, item in sorted(found.keys() | copied.keys()):
            covered, changed = set(copied.get((text, item), ())), set()
            for shift, windows in found.get((text, item), {}).items():
                cells = {p for j, n in windows for p in range(j, j + n)}
                values: dict[tuple, Counter] = defaultdict(Counter)
                for p in cells:
                    if self.t.kind[p]:
                        values[self.t.kind[p], self.t.raw[p]][t.raw[p + shift]] += 1
                chosen = {k: min(c, key=lambda v: (-c[v], v)) for k, c in values.items()}
                odd = {p for p in cells if self.t.kind[p] and chosen[self.t.kind[p], self.t.raw[p]] != t.raw[p + shift]}
                for j, n in windows:
                    if odd.isdisjoint(own := range(j, j + n)):
                        covered.update(own)
                        changed.update(p for p in own if self.t.kind[p] and self.t.raw[p] != t.raw[p + shift])
            if covered and (len(covered) >= SHARE * self.length[item] or len(covered) >= LONG):
                out.append((text, item, len(covered), len(changed)))
        return out


def _indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in slices, one at a time; it arrives on the driver one partition at a time."""
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        if size > SLICE:
            yield Index(pa.array(ids, kind), texts)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(bytes(row[1] or b""))
        size += len(texts[-1])
    if ids:
        yield Index(pa.array(ids, kind), texts)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item it contains: doc_id, item_id, matched_tokens, item_tokens, changed_slots."""
    spark = docs.sparkSession
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, matched_tokens int, item_tokens int, changed_slots int"
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                for a, _, texts in text_slices(batch.column("text")):
                    hits = shared.value.matches(texts)
                    if hits:
                        cols = [ids.take(pa.array([a + h[0] for h in hits])), shared.value.ids.take(pa.array([h[1] for h in hits])), *(pa.array(x, pa.int32()) for x in ([h[2] for h in hits], [int(shared.value.length[h[1]]) for h in hits], [h[3] for h in hits]))]
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "matched_tokens", "item_tokens", "changed_slots"])

        return released(run)

    out = None
    for index in _indexes(benchmark):
        part = rows.mapInArrow(search(spark.sparkContext.broadcast(index)), schema)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item, with all their columns."""

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, texts in text_slices(batch.column("text")):
                    bad = {h[0] for h in shared.value.matches(texts)}
                    yield batch[a:b].filter(pa.array([i not in bad for i in range(b - a)], pa.bool_()))

        return released(run)

    for index in _indexes(benchmark):
        docs = docs.mapInArrow(keep(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs


@query("op8_template_decontamination")
def _(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
