"""Benchmark decontamination by template canonicalisation.

Words lose case and outer punctuation; numbers (in digits or words), quantities (a number with its
unit, written together or apart), units and names become typed placeholders. A capitalised word at
a sentence's beginning has two readings, the word itself and a name, and windows are hashed under
both. Five-word windows of these templates are joined by hash with the windows of the benchmark
items. A document leaks an item if at least 0.8 of the item's distinct windows are in it and the
slots agree: over the matched windows each filler of the item keeps one filler in the document, and
names map one to one (so a question with other numbers and names is caught, but a text that merely
shares its shape is not). An item with fewer than ``PLAIN`` words that aren't slots has too little
shape to go by: its fillers must be the same.

The join runs in three steps. Documents keep only those windows whose hash begins like one of the
benchmark's (a sorted array of 32-bit prefixes, bounded and broadcast in blocks). These meet the
items on each item's rarest windows, as many as a leak can't do without, so that windows which all
items share make no candidates. Each candidate pair is then checked with its whole windows. Leaks
depend on the text alone: exact copies are checked once, by a 128-bit hash of the text.

Defined cases: a null or empty text leaks nothing; an item without words (or null) is in no
document; an item of fewer than five words is one window of its own length. Repeated items and
documents are each reported. An empty benchmark leaves all documents. Other columns are kept;
``find_leaks`` replaces a column named ``leaks``, ``drop_leaking`` keeps it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.common import durable, frugal, mix64, table

WINDOW, COVERAGE, PLAIN = 5, 0.8, 3
#: The most hash prefixes broadcast at once (4 bytes each); more go in blocks, each a pass over the documents.
BLOCK = 8_000_000
#: The most leaking texts that are broadcast (some 50 bytes each) instead of joined by shuffle.
BROADCAST_TEXTS = 200_000
CACHE = 300_000
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb lbs oz t ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years km/h mph kph c f k hz khz mhz ghz w kw mw kwh j kj cal kcal v a mb gb tb kb % percent dollars dollar euros euro cents cent usd eur gbp pounds meters metres meter metre miles mile inches feet litres liters grams kilograms kilometers kilometres".split())
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
_PUNCTUATION = ".,;:!?()[]{}#*$%&|<>\"'"
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
_QUANTITY = re.compile(r"[$€£]?[+-]?\d[\d.,]*([a-z%/]+)")
#: LETTER is a unit of one letter, which counts only after a number.
NUMBER, QUANTITY, UNIT, NAME, LETTER = 1, 2, 3, 4, 5
_PLACEHOLDER = {k: xxhash.xxh3_64_intdigest(b"\0slot%d" % k) for k in (NUMBER, QUANTITY, UNIT, NAME)}

_QUANTITY_HASH = np.uint64(_PLACEHOLDER[QUANTITY])


def classify(chunk: str) -> tuple[int, int, int, bool]:
    """Hash of the chunk at a sentence's beginning (0: no word), hash and slot type elsewhere, and whether it ends a sentence."""
    ends = chunk.rstrip("\"')]»”").endswith((".", "!", "?", ":"))
    word = chunk.strip(_PUNCTUATION)
    letters = word.isalpha()
    if not letters:  # most chunks need no pattern
        word = chunk if chunk in ("%",) else _TRIM.sub("", chunk)
        if not word:
            return 0, 0, 0, ends
    low = word.lower()
    if low in NUMBERS or not letters and _NUMBER.fullmatch(low):
        kind = NUMBER
    elif low in UNITS:
        kind = UNIT if len(low) > 1 else LETTER
    elif not letters and (m := _QUANTITY.fullmatch(low)) and m[1] in UNITS:
        kind = QUANTITY
    else:
        kind = NAME if word[0].isupper() and not (len(word) > 1 and word.isupper()) else 0
    plain = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) | 1
    if kind in (0, LETTER):
        return plain, plain, kind, ends
    return plain if kind == NAME else _PLACEHOLDER[kind], _PLACEHOLDER[kind], kind, ends


class Known(dict):
    """Number of each chunk, classified when first met; ``rows`` holds what isn't in the tables yet."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int, int, bool]] = []

    def __missing__(self, chunk: str) -> int:
        at = self[chunk] = len(self)
        self.rows.append(classify(chunk))
        return at


class Canonical:
    """Chunks to template words, each distinct chunk classified once."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.known, self.table = Known(), None

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: template hash (a capitalised word is a name), the same with the other reading of sentences' beginnings, slot type, chunk place, and whether the next chunk is part of it."""
        if len(self.known) > CACHE:
            self._clear()
        size = len(self.known)
        at = list(map(self.known.__getitem__, chunks))
        rows = self.known.rows
        if self.table is None or rows:
            new = np.array([(a, b) for a, b, _, _ in rows], dtype=np.uint64).reshape(-1, 2)
            flags = np.array([(k, e) for _, _, k, e in rows], dtype=np.uint8).reshape(-1, 2)
            if self.table is None or size + len(new) > len(self.table):
                grown = max(1024, 2 * (size + len(new)))
                old, old_flags = self.table, getattr(self, "flags", None)
                self.table, self.flags = np.zeros((grown, 2), dtype=np.uint64), np.zeros((grown, 2), dtype=np.uint8)
                if old is not None:
                    self.table[:size], self.flags[:size] = old[:size], old_flags[:size]
            self.table[size : size + len(new)], self.flags[size : size + len(new)] = new, flags
            rows.clear()
        at = np.array(at, dtype=np.int64)
        flags, both = self.flags[at], self.table[at]
        real = np.flatnonzero(both[:, 0])
        begins = np.concatenate(([True], flags[:-1, 1].astype(bool)))[real] if len(at) else np.zeros(0, dtype=bool)
        kinds, names = flags[real, 0], both[real, 1]
        plain = np.where(begins, both[real, 0], names)
        joined = np.zeros(len(real), dtype=bool)
        if (kinds == NUMBER).any():  # a number and the unit after it are one quantity
            after = np.concatenate((kinds[1:], [0])) if len(kinds) else kinds
            joined = (kinds == NUMBER) & ((after == UNIT) | (after == LETTER)) & (flags[real, 1] == 0)
            if joined.any():
                kinds = np.where(joined, QUANTITY, kinds)
                names, plain = np.where(joined, _QUANTITY_HASH, names), np.where(joined, _QUANTITY_HASH, plain)
                stay = ~np.concatenate(([False], joined[:-1]))
                names, plain, kinds, real, joined = names[stay], plain[stay], kinds[stay], real[stay], joined[stay]
        return names, plain, np.where(kinds == LETTER, 0, kinds), real, joined


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each window."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15) + (out >> np.uint64(29))
    return mix64(out)


def filler(chunks: list[str], at: int, joined: bool) -> str:
    """What fills the slot: the chunk without outer punctuation, and its unit."""
    return "".join(_TRIM.sub("", c).lower() or c for c in chunks[at : at + 1 + joined])


def text_windows(text: str | None, canonical: Canonical, widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple]]:
    """For each width: the windows' hashes under both readings, and what ``canonical`` gave."""
    chunks = (text or "").split()
    words = canonical(chunks)
    for width in widths:
        names = window_hashes(words[0], width)
        yield width, names, window_hashes(words[1], width), (chunks, *words[2:])


@frugal
def _items(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Each item's distinct windows: hash under the name reading, hash under the other, place; and slot types and fillers of its words."""
    canonical = Canonical()
    for batch in batches:
        rows = []
        for h1, h2, text in zip(*(c.to_pylist() for c in batch.columns)):
            n = len(canonical((text or "").split())[0])
            if not n:
                continue
            width = min(size, n)
            _, names, plain, (chunks, kinds, real, joined) = next(text_windows(text, canonical, [width]))
            first = np.sort(np.unique(names, return_index=True)[1])
            fill = [filler(chunks, r, j) if k else "" for r, j, k in zip(real.tolist(), joined.tolist(), kinds.tolist())]
            rows.append((h1, h2, width, names.view(np.int64).tolist(), plain.view(np.int64).tolist(), len(first), kinds.tolist(), fill))
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        cols = list(zip(*rows)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), longs, longs, pa.int32(), ints, pa.list_(pa.string())))],
            names=["i1", "i2", "width", "names", "plain", "total", "kinds", "fillers"],
        )


@frugal
def _hits(batches: Iterator[pa.RecordBatch], prefixes: np.ndarray, widths: list[int]) -> Iterator[pa.RecordBatch]:
    """Of each text the windows whose hash begins like a benchmark window's: hash, place and the fillers of its words."""
    canonical = Canonical()
    bits = 22
    first = np.zeros(1 << bits, dtype=bool)  # spares most searches
    first[prefixes >> np.uint32(32 - bits)] = True
    for batch in batches:
        rows = []
        for h1, h2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found: dict[tuple[int, int], str] = {}
            for width, names, plain, (chunks, _, real, joined) in text_windows(text.as_py(), canonical, widths):
                for hashes in (names, plain):
                    at = np.flatnonzero(first[(hashes >> np.uint64(64 - bits)).astype(np.int64)])
                    if len(at):
                        near = (hashes[at] >> np.uint64(32)).astype(np.uint32)
                        at = at[prefixes[np.minimum(np.searchsorted(prefixes, near), len(prefixes) - 1)] == near]
                    for p in at.tolist():
                        if (key := (int(hashes[p].view(np.int64)), p)) not in found:
                            found[key] = "\x1f".join(filler(chunks, int(real[i]), bool(joined[i])) for i in range(p, p + width))
            if found:
                rows.append((h1, h2, [h for h, _ in found], [p for _, p in found], list(found.values())))
        cols = list(zip(*rows)) if rows else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["h1", "h2", "hashes", "places", "words"])


def covered(hits: tuple[list, list, list], item: tuple[int, list, list, int, list, list], coverage: float = COVERAGE) -> float | None:
    """Part of the item's distinct windows that the text's hits (hashes, places, words) hold, if that is a leak."""
    width, names, plain, total, kinds, fillers = item
    by_hash = defaultdict(list)
    for h, p, w in zip(*hits):
        by_hash[h].append((p, w))
    occurrences = defaultdict(set)  # item window -> (item place, text place, words)
    for q, (a, b) in enumerate(zip(names, plain)):
        for h in {a, b}:
            occurrences[a].update((q, p, w) for p, w in by_hash.get(h, ()))
    windows = {k: v for k, v in occurrences.items() if v}
    if len(windows) < coverage * total - 1e-9:
        return None
    # the occurrence of a window that lies on the most common diagonal is the one compared
    votes = defaultdict(int)
    for seen in windows.values():
        for d in {p - q for q, p, _ in seen}:
            votes[d] += 1
    best = max(votes, key=lambda d: (votes[d], -d))
    pairs = set()
    for seen in windows.values():
        q, _, words = min(seen, key=lambda o: (abs(o[1] - o[0] - best), o))
        pairs.update((kinds[q + i], fillers[q + i], w) for i, w in enumerate(words.split("\x1f")) if kinds[q + i])
    if sum(k == 0 for k in kinds) < PLAIN:
        fits = all(a == b for _, a, b in pairs)
    else:
        fits = consistent(pairs)
    return len(windows) / total if fits else None


def consistent(pairs: set[tuple[int, str, str]], part: float = COVERAGE) -> bool:
    """Whether each filler keeps its partner, and names map one to one, but for at most 1 - part of them (an edited copy may alter one)."""
    left, right = defaultdict(int), defaultdict(int)
    for kind, a, b in pairs:
        left[kind, a] += 1
        right[kind, b] += 1
    fine = sum(1 for kind, a, b in pairs if left[kind, a] == 1 and (kind != NAME or right[kind, b] == 1))
    return fine >= part * len(pairs)


@frugal
def _checked(batches: Iterator[pa.RecordBatch], coverage: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part = []
        for row in batch.select(["hashes", "places", "words", "width", "names", "plain", "total", "kinds", "fillers"]).to_pylist():
            part.append(covered((row["hashes"], row["places"], row["words"]), (row["width"], row["names"], row["plain"], row["total"], row["kinds"], row["fillers"]), coverage))
        got = pa.RecordBatch.from_arrays([*batch.select(["h1", "h2", "i1", "i2"]).columns, pa.array(part, pa.float64())], names=["h1", "h2", "i1", "i2", "coverage"])
        yield got.filter(pa.array([x is not None for x in part], pa.bool_()))


def _digests(text: str = "text") -> list[F.Column]:
    """128 bits of the text in two numbers."""
    return [F.xxhash64(F.lit(1), F.col(text)), F.xxhash64(F.lit(2), F.col(text))]


def leaking_texts(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """(h1, h2, leaks) of the texts that leak: their digests, and an array of (item_id, coverage)."""
    spark = docs.sparkSession
    i1, i2 = _digests()
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), i1.alias("i1"), i2.alias("i2"), "text").where("text is not null")
    items = durable(named.dropDuplicates(["i1", "i2"]).select("i1", "i2", "text").mapInArrow(lambda b: _items(b, WINDOW), "i1 long, i2 long, width int, names array<long>, plain array<long>, total int, kinds array<int>, fillers array<string>"))
    windows = items.select("i1", "i2", "total", F.explode(F.array_distinct(F.arrays_zip("names", "plain"))).alias("w")).select("i1", "i2", "total", F.col("w.names").alias("name"), F.col("w.plain").alias("other"))
    hashes = windows.select(F.explode(F.array("name", "other")).alias("h")).select(F.shiftrightunsigned("h", 32).alias("prefix")).distinct()
    hashes = durable(hashes)
    blocks = max(1, -(-hashes.count() // block))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # 1 to WINDOW
    h1, h2 = _digests()
    texts = docs.select(h1.alias("h1"), h2.alias("h2"), "text")
    found = None
    for b in range(blocks):
        some = hashes.where(F.pmod("prefix", F.lit(blocks)) == b) if blocks > 1 else hashes
        prefixes = np.sort(some.toPandas()["prefix"].to_numpy(dtype=np.uint32))  # about ``block`` numbers at most
        if not len(prefixes):
            continue
        shared = spark.sparkContext.broadcast(prefixes)
        got = texts.mapInArrow(lambda x, shared=shared: _hits(x, shared.value, widths), "h1 long, h2 long, hashes array<long>, places array<int>, words array<string>").dropDuplicates(["h1", "h2"])
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "h1 long, h2 long, leaks array<struct<item_id:bigint,coverage:double>>")
    if blocks > 1:  # one row a text and block so far
        found = found.groupBy("h1", "h2").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("hashes", "places", "words")])
    found = durable(found)
    # an item's rarest windows among items, as many as no leak can be without
    common = windows.select("i1", "i2", "name").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("i1", "i2").orderBy("n", "name")
    rare = windows.select("i1", "i2", "total", "name").distinct().join(common, "name").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("total") - F.ceil(F.lit(coverage) * F.col("total") - F.lit(1e-9)) + 1)
    keys = windows.join(rare.select("i1", "i2", "name"), ["i1", "i2", "name"]).select("i1", "i2", F.explode(F.array("name", "other")).alias("h")).distinct()
    pairs = found.select("h1", "h2", F.explode(F.array_distinct("hashes")).alias("h")).join(keys, "h").select("h1", "h2", "i1", "i2").distinct()
    rows = pairs.join(found, ["h1", "h2"]).join(items, ["i1", "i2"])
    leaks = rows.mapInArrow(lambda b: _checked(b, coverage), "h1 long, h2 long, i1 long, i2 long, coverage double")
    leaks = leaks.join(named.select("item_id", "i1", "i2"), ["i1", "i2"])
    least = F.array_sort(F.collect_list(F.struct(F.col("item_id").isNull().alias("last"), "item_id", "coverage")))
    return durable(leaks.groupBy("h1", "h2").agg(F.transform(least, lambda x: F.struct(x["item_id"].alias("item_id"), x["coverage"].alias("coverage"))).alias("leaks")))


def _with_texts(docs: DataFrame, texts: DataFrame, how: str) -> DataFrame:
    """docs as one column ``doc``, joined with the leaking texts."""
    h1, h2 = _digests()
    few = texts.count() <= BROADCAST_TEXTS
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), h1.alias("h1"), h2.alias("h2")).join(F.broadcast(texts) if few else texts, ["h1", "h2"], how)


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """docs with the column ``leaks``: array of (item_id, coverage)."""
    texts = leaking_texts(docs, benchmark, coverage, block)
    none = F.expr("cast(array() as array<struct<item_id:bigint,coverage:double>>)")
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c != "leaks"]
    return _with_texts(docs, texts, "left").select(*kept, F.coalesce("leaks", none).alias("leaks"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """docs that leak no item, all columns kept."""
    texts = leaking_texts(docs, benchmark, coverage, block)
    return _with_texts(docs, texts.select("h1", "h2"), "left_anti").select("doc.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, contaminated, the number of items leaked and their ids."""
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"), F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"))
