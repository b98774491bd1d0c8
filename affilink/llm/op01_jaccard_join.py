"""Exact Jaccard join of word n-grams by universe-partition pigeonhole, and its components.

A document's set holds the 64-bit hashes of its distinct word n-grams. Documents of equal sets form a class; the join
runs over classes, so copies are never paired with each other. Sizes fall into bands, each BAND_RATIO wide. Two sets
of sizes r <= s linked at num/den differ in at most H elements, H = (r + s) * (den - num) // (den + num), and s is at
most r * den // num. A band cuts the universe of hashes into ranges, its segments. A segment may be indexed by a hash of
its subset (it then finds pairs that agree in it), or also by those of all subsets short of one element (it then finds
pairs that differ in it by one). The first kind uncovers one unit of difference, the second two; a band's segments hold
H + 1 units for its largest pairs, so by the pigeonhole principle each linked pair meets in a segment. How many segments
are of the second kind is chosen by cost: rows written, and pairs that meet by chance since a small set leaves segments
(nearly) empty. Segments of the first kind that are empty in both sets would make most sets meet, so a band has some spare ones:
where spare segments more than H + 1 are cut, spare + 1 segments at least agree or nearly do, and a set with up to spare empty
ones meets its partners in another. Its empty ones are left out of the index. A set with more of them has all its segments
indexed, and meets others of its like there. A set is indexed in its own band, and in the band below if a smaller partner could be there.

Only one document of a class is indexed. Its keys aren't rows: a task sorts those of its classes, deals them into ranges and
packs each range's keys (as differences) and classes (as numbers) into a blob, a few bytes a key. The task of a range opens its
blobs, one sort finds the keys that several classes share (the buckets), and of buckets with the same classes one stays.
Keys have KEY_BITS bits, more where the corpus has more keys; two that fall together by chance cost a check, no link.

Classes that meet under one key (a bucket) aren't all paired. Each is checked against the bucket's smallest and largest
class, which then leave the bucket, and the links give components. What is left of buckets, where it is of several
components, takes other ends; so small buckets are soon empty. Of the classes that remain after STAR_ROUNDS more such checks, linked pairs of
different components are sought. Their odd sketches (a bit for each hash range, flipped by each element in it) must not differ
in more than H bits, since each element that one set lacks flips one bit. Buckets of up to PAIRED classes go, with sizes and
sketches, to a task that compares all of different components there; only pairs that pass become rows. The classes of larger
buckets are sought by their elements, ordered from rare to common. What stands in a set before its first
element in common with another is missing in that one, so both sets' places of their first common element tell of more
differences than H, or the pair is a candidate. Only places up to H + 1 can matter, a tenth of a set. This and the
sketches are conditions of the join, so that pairs far apart never become rows. Within one element
the classes outside its largest component are paired with all of other components, so a component of very many near
copies is never paired with itself. Pairs are verified by the exact size of the intersection of their sets, so the
components are exactly those of all links. Sizes and sketches come first, then a finer sketch; only the sets of pairs that pass are shuffled.

Words are runs other than U+0009 to U+000D and U+0020, after lower-casing A to Z. With fewer words than n, the whole
sequence is the one element; null, empty or blank texts have an empty set, linked with nothing. A null doc_id counts
as no id (component_id is null where no document of the component has one). Repeated rows and ids are kept, each row
with its own class. An empty table gives no rows. Other columns aren't read. Hashes have 64 bits, classes 64 bits of
a sum and size: among a billion documents two different sets fall together with a probability of about 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erfc, exp, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affilink.llm.components import connected
from affilink.llm.shared import broadcast_if_few, dropped, partitions_for, sliced, table, written
from affilink.llm.subwords import mixed

NGRAM = 3
LEAST_NUM, LEAST_DEN = 90, 100
BAND_RATIO = 1.4
LARGEST_SET = 1 << 34
#: What a pair that meets by chance costs, in rows of the index.
PAIR_COST = 4.0
#: Rounds of checks against a bucket's ends before what is left is paired.
STAR_ROUNDS = 2
#: Classes of a bucket that a task compares directly, and comparisons at once.
PAIRED, COMPARED = 8192, 1 << 20
#: 64-bit words of a set's odd sketch.
SKETCH_WORDS = 8
#: Those of the sketch that pairs which passed the first are held against: the first says little of sets of a thousand elements.
FINE_WORDS = 64
MEMO_WORDS = 200_000
#: Documents whose sets and keys a worker holds at once.
ROWS_AT_ONCE = 512
#: Index keys of a task's blobs, and the bits of a key: KEY_BITS at least, and SPARE_BITS more than count the keys.
BLOB_KEYS = 1 << 20
KEY_BITS, SPARE_BITS = 40, 7
#: Bytes of files whose keys make a range.
RANGE_BYTES = 4 << 20


@dataclass(frozen=True)
class Band:
    number: int
    least: int
    single: int
    double: int
    #: Empty segments of the first kind that a set may have and still be left out of their buckets.
    spare: int = 0

    @property
    def segments(self) -> int:
        return self.single + self.double


def difference(r: int, s: int, num: int, den: int) -> int:
    """The most elements in which linked sets of these sizes differ."""
    return (r + s) * (den - num) // (den + num)


def crowds(classes: DataFrame) -> dict[int, int]:
    """Classes by their size, as powers of BAND_RATIO; at most some hundred."""
    return {r[0]: r[1] for r in classes.filter("size > 0").groupBy(F.floor(F.log("size") / float(np.log(BAND_RATIO))).cast("long")).count().collect()}


def above_poisson(mean: float, k: int) -> float:
    """The probability of more than k by a Poisson distribution; by the normal one where the mean is large."""
    if mean <= 0:
        return 0.0
    if mean > 50:
        return 0.5 * erfc((k + 0.5 - mean) / sqrt(2 * mean))
    return max(0.0, 1 - sum(exp(i * log(mean) - mean - lgamma(i + 1)) for i in range(k + 1)))


def bands(crowd: dict[int, int], num: int = LEAST_NUM, den: int = LEAST_DEN, ratio: float = BAND_RATIO) -> list[Band]:
    """Bands from the smallest size at which linked sets can differ. single + 2 * double = H + 1 + spare, H of a band's largest pair.

    crowd is that of crowds(); it decides costs, not results.
    """
    size = 1
    while size < LARGEST_SET and difference(size, size * den // num, num, den) == 0:
        size += 1
    out = []
    while size < LARGEST_SET:
        above = max(size + 1, int(np.ceil(size * ratio)))
        units = difference(above - 1, (above - 1) * den // num, num, den) + 1
        at = int(np.log(size) / np.log(ratio))
        n_docs = sum(crowd.get(k, 0) for k in range(at - 1, at + 3))

        def empties(double: int, spare: int) -> float:
            """Empty segments of the first kind to be expected in a set of the band's least size."""
            m = units - 2 * double + spare
            return m * (1 - 1 / max(2, m + double)) ** size

        def spared(double: int, margin: int) -> int:
            """So many that few sets have more empty segments."""
            spare = 0
            for _ in range(8):
                empty = empties(double, spare)
                spare = int(np.ceil(empty + margin * np.sqrt(empty)))
                if spare > units - 2 * double:
                    return 0
            return spare

        def cost(option: tuple[int, int]) -> float:
            double, spare = option
            n = units - double + spare
            empty = (1 - 1 / n) ** size if n > 1 else 0.0
            one = size / n * (1 - 1 / n) ** (size - 1) if n > 1 else 0.0
            sparse = above_poisson(empties(double, spare), spare) if spare else 1.0
            chance = min(1.0, (units - 2 * double) * empty**2) * sparse**2 + double * (empty + one) ** 2
            return units - 2 * double + spare + double * (1 + size / n) + PAIR_COST * n_docs * chance

        doubles = range(min(units // 2, 64) + 1)
        double, spare = min([(d, 0) for d in doubles] + [(d, spared(d, margin)) for d in doubles if units > 2 * d for margin in (3, 6)], key=cost)
        out.append(Band(len(out), size, units - 2 * double + spare, double, spare))
        size = above
    return out


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def ngram_set(text: bytes | None, n: int, memo: _Memo) -> np.ndarray:
    """The sorted hashes of a text's distinct word n-grams."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(memo) > MEMO_WORDS:
        memo.clear()
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(n, len(h))
    total = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = mixed(total + h[k : len(h) - width + 1 + k])
    return np.unique(total)


def class_of(s: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    return int(mixed(np.array([mixed(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def keys_of(s: np.ndarray, plan: list[Band], least: np.ndarray, num: int, den: int) -> np.ndarray:
    """The index keys of a set: of its band, and of the band below where a linked smaller set may lie."""
    own = int(np.searchsorted(least, len(s), side="right")) - 1
    if own < 0:
        # so small that only an equal set is linked with it
        return np.zeros(0, dtype=np.int64)
    at = [own]
    if own and -(-len(s) * num // den) < plan[own].least:
        at.append(own - 1)
    elements = mixed(s + np.uint64(0x2545F4914F6CDD1D))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(elements, dtype=np.uint64)])
    out = []
    for b in at:
        band = plan[b]
        width = ((1 << 64) - 1) // band.segments
        cuts = np.arange(1, band.segments, dtype=np.uint64) * np.uint64(width)
        bounds = np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]])
        parts = sums[bounds[1:]] - sums[bounds[:-1]]
        salt = mixed(np.arange(band.segments, dtype=np.uint64) + np.uint64((band.number + 1) << 40))
        empty = np.flatnonzero(bounds[1:] == bounds[:-1])
        empty = empty[empty >= band.double]
        named = mixed(parts ^ salt)
        out.append(np.delete(named, empty) if len(empty) <= band.spare else named)
        for i in range(band.double):
            inside = slice(int(bounds[i]), int(bounds[i + 1]))
            out.append(mixed((parts[i] - elements[inside]) ^ salt[i]))
    return np.concatenate(out).view(np.int64)


def classed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, class_key, text_hash of docs (doc_id, text, ...) and docs' further columns."""
    more = docs.schema.fields[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for batch in sliced(batches, ROWS_AT_ONCE):
            sets = [ngram_set(text.as_py(), n, memo) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), *batch.columns[2:]], ["doc_id", "n_shingles", "class_key", "text_hash", *(f.name for f in more)])

    schema = ", ".join(["doc_id long, n_shingles long, class_key long, text_hash long", *(f"{f.name} {f.dataType.simpleString()}" for f in more)])
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("binary"), F.xxhash64("text").alias("text_hash"), *(f.name for f in more)).mapInArrow(run, schema)


def packed(keys: np.ndarray, classes: np.ndarray) -> bytes:
    """A blob of sorted keys with their classes: their number, the least class, and the bytes of differences by planes."""
    import zstandard

    least = int(classes.min())
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() for x in (np.diff(keys, prepend=np.uint64(0)), (classes - least).view(np.uint64))]
    return np.array([len(keys), least], dtype="<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def opened(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n, least = np.frombuffer(blob, dtype="<i8", count=2).tolist()
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[16:]), dtype=np.uint8).reshape(2, 8, n)
    deltas, classes = (np.ascontiguousarray(p.T).view(np.uint64).reshape(-1) for p in planes)
    return np.cumsum(deltas, dtype=np.uint64), classes.view(np.int64) + least


def blobs(chosen: DataFrame, plan: list[Band], n: int, num: int, den: int, bits: int, ranges: int) -> DataFrame:
    """range and blob of the index keys of chosen (text, class_no)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.array([b.least for b in plan])
        memo = _Memo()
        keys: list[np.ndarray] = []
        classes: list[np.ndarray] = []
        held = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            nonlocal held
            k, c = np.concatenate(keys), np.concatenate(classes)
            order = np.argsort(k)
            k, c = k[order], c[order]
            bounds = np.searchsorted(k * np.uint64(ranges) >> np.uint64(bits), np.arange(ranges + 1))
            for r in np.flatnonzero(np.diff(bounds)).tolist():
                inside = slice(int(bounds[r]), int(bounds[r + 1]))
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([packed(k[inside], c[inside])], pa.binary())], ["range", "blob"])
            keys.clear()
            classes.clear()
            held = 0

        for batch in batches:
            for text, number in zip(batch.column(0), batch.column(1).to_pylist()):
                own = keys_of(ngram_set(text.as_py(), n, memo), plan, least, num, den).view(np.uint64) >> np.uint64(64 - bits)
                keys.append(own)
                classes.append(np.full(len(own), number, dtype=np.int64))
                held += len(own)
                if held >= BLOB_KEYS:
                    yield from emptied()
        if held:
            yield from emptied()

    return chosen.select(chosen["text"].cast("binary"), "class_no").mapInArrow(run, "range int, blob binary")


def shared_keys(keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, ...]:
    """key, class_no, low, high of the classes that share a key, of keys with the same classes once; key tells the classes."""
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])
    keys, classes = keys[new], classes[new]
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    sizes = np.diff(np.append(starts, len(keys)))
    many = sizes > 1
    starts, sizes = starts[many], sizes[many]
    if not len(starts):
        return (np.zeros(0, dtype=np.int64),) * 4
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    classes = classes[at]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    name = mixed(np.add.reduceat(mixed(classes.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), first) + sizes.astype(np.uint64))
    _, one = np.unique(name, return_index=True)
    kept = np.zeros(len(name), dtype=bool)
    kept[one] = True
    low, high = classes[first], classes[first + sizes - 1]
    rows = np.repeat(kept, sizes)
    return np.repeat(name.view(np.int64), sizes)[rows], classes[rows], np.repeat(low, sizes)[rows], np.repeat(high, sizes)[rows]


def bucketed(packed_: DataFrame, ranges: int) -> DataFrame:
    """key, class_key, low, high: the classes (by number) of each bucket, and its smallest and largest."""
    names = ["key", "class_key", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = None, []

        def emptied() -> Iterator[pa.RecordBatch]:
            if parts:
                found = shared_keys(*map(np.concatenate, zip(*parts)))
                parts.clear()
                yield from sliced([pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)], 1 << 16)

        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number != own:
                    yield from emptied()
                    own = number
                parts.append(opened(blob.as_py()))
        yield from emptied()

    dealt = packed_.repartition(ranges, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names)).distinct()


def odd_sketch(s: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    bits = np.bincount((mixed(s + np.uint64(0xA0761D6478BD642F)) >> np.uint64(48)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


_SKETCH = [f"odd{k}" for k in range(SKETCH_WORDS)]


def sets_of(chosen: DataFrame, n: int) -> DataFrame:
    """class_key, size, elements, the odd sketch's words and the finer one of chosen (text, class_no)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for batch in sliced(batches, ROWS_AT_ONCE):
            sets = [ngram_set(text.as_py(), n, memo) for text in batch.column(0)]
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
            sketches = np.array([odd_sketch(s) for s in sets], dtype=np.int64).reshape(-1, SKETCH_WORDS)
            columns = [batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), *(pa.array(np.ascontiguousarray(c)) for c in sketches.T)]
            columns.append(pa.array([odd_sketch(s, FINE_WORDS) for s in sets], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["class_key", "size", "elements", *_SKETCH, "fine"])

    return chosen.select(chosen["text"].cast("binary"), "class_no").mapInArrow(run, "class_key long, size long, elements array<long>, " + ", ".join(f"{c} long" for c in _SKETCH) + ", fine array<long>")


def alike(most: str, x: str, y: str) -> str:
    """Whether odd sketches differ in no more bits than the elements that linked sets may lack."""
    return " + ".join(f"bit_count({x}_{c} ^ {y}_{c})" for c in _SKETCH) + f" <= {most}"


def possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that sizes and sketches, a few bytes a set, don't rule out."""
    side = lambda p: sets.select(F.col("class_key").alias(p), F.col("size").alias(f"{p}_size"), *(F.col(c).alias(f"{p}_{c}") for c in _SKETCH))
    told = pairs.join(side("a"), "a").join(side("b"), "b")
    most = f"(a_size + b_size) * {den - num} div {den + num}"
    return told.filter((F.least("a_size", "b_size") * den >= F.greatest("a_size", "b_size") * num) & F.expr(alike(most, "a", "b"))).select("a", "b")


def held(few: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The pairs (a, b) with both sizes and a column of both sets, as a_ and b_. Only sets that stand in a pair are moved."""

    def side(p: str) -> DataFrame:
        asked = broadcast_if_few(few.select(F.col(p).alias("class_key")).distinct())
        own = sets.select("class_key", "size", column).join(asked, "class_key", "left_semi")
        return own.select(F.col("class_key").alias(p), F.col("size").alias(f"{p}_size"), F.col(column).alias(f"{p}_{column}"))

    return few.join(side("a"), "a").join(side("b"), "b")


def finely(few: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that the finer sketches don't rule out."""
    odd = "aggregate(zip_with(a_fine, b_fine, (x, y) -> bit_count(x ^ y)), 0, (n, k) -> n + k)"
    return held(few, sets, "fine").filter(f"{odd} <= (a_size + b_size) * {den - num} div {den + num}").select("a", "b")


def verified(few: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) with den * intersection >= num * union."""
    shared = F.size(F.array_intersect("a_elements", "b_elements"))
    both = held(few, sets, "elements").select("a", "b", "a_size", "b_size", shared.alias("shared"))
    return both.filter(F.col("shared") * (num + den) >= (F.col("a_size") + F.col("b_size")) * num).select("a", "b")


def close_pairs(classes: np.ndarray, component: np.ndarray, size: np.ndarray, sketch: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a bucket's classes of different components that sizes and sketches (a row a class) don't rule out."""
    pairs = []
    step = max(1, COMPARED // len(classes))
    for k in range(0, len(classes), step):
        here = slice(k, k + step)
        r, s = size[here, None], size[None, k:]
        near = (component[here, None] != component[None, k:]) & (np.minimum(r, s) * den >= np.maximum(r, s) * num)
        x, y = np.nonzero(np.triu(near, 1))
        odd = np.zeros(len(x), dtype=np.int64)
        for word in sketch.T:
            odd += np.bitwise_count(word[here][x] ^ word[k:][y])
        fits = odd <= (size[here][x] + size[k:][y]) * (den - num) // (den + num)
        pairs.append((classes[here][x[fits]], classes[k:][y[fits]]))
    x, y = map(np.concatenate, zip(*pairs))
    return np.minimum(x, y), np.maximum(x, y)


def within(left: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that hold all linked ones of different components within a bucket of left (key, class_key, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def met(rows: np.ndarray) -> pa.RecordBatch:
            bounds = np.flatnonzero(np.diff(rows[0])) + 1
            found = [close_pairs(g[1], g[2], g[3], g[4:].T.view(np.uint64), num, den) for g in np.split(rows, bounds, axis=1)]
            a, b = map(np.concatenate, zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            # the last bucket may go on in the next batch
            begun = int(np.searchsorted(rows[0], rows[0, -1]))
            if begun:
                yield met(rows[:, :begun])
            held = rows[:, begun:]
        if held is not None:
            yield met(held)

    told = left.select("key", "class_key", "component").join(sets.select("class_key", "size", *_SKETCH), "class_key")
    dealt = told.select("key", "class_key", "component", "size", *_SKETCH).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def across(classes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that hold all linked ones of different components among classes (class_key, component)."""
    own = sets.join(classes, "class_key")
    rows = own.select("class_key", F.explode("elements").alias("element"))
    counts = rows.groupBy("element").agg(F.count("*").alias("sets")).filter("sets > 1")
    # elements of one set alone come first and need no row: places of the others count from the end
    order = Window.partitionBy("class_key").orderBy(F.desc("sets"), F.desc("element"))
    rows = rows.join(counts, "element").select("class_key", "element", F.row_number().over(order).alias("back")).join(own.select("class_key", "component", "size"), "class_key")
    # the most elements that a linked set of the largest size leaves out, and one
    reach = F.expr(f"(size + size * {den} div {num}) * {den - num} div {den + num}") + 1
    rows = rows.withColumn("place", F.col("size") + 1 - F.col("back")).filter(F.col("place") <= reach).drop("back")
    held = rows.groupBy("element", "component").agg(F.count("*").alias("n")).groupBy("element").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("components"))
    rows = rows.join(held.filter("components > 1"), "element").join(own.select("class_key", *_SKETCH), "class_key")
    side = lambda p: [F.col("class_key").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("component", "size", "place", *_SKETCH))]
    less = rows.filter("component <> largest").select("element", *side("x"))
    every = rows.select("element", *side("y"))
    most = f"(x_size + y_size) * {den - num} div {den + num}"
    few = F.expr(f"x_place + y_place - 2 <= {most} and {alike(most, 'x', 'y')}")
    near = F.least("x_size", "y_size") * den >= F.greatest("x_size", "y_size") * num
    met = less.join(every, (less.element == every.element) & (F.col("x_component") != F.col("y_component")) & few & near)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def link_components(docs: DataFrame, n: int = NGRAM, num: int = LEAST_NUM, den: int = LEAST_DEN, more: tuple[str, ...] = ()) -> DataFrame:
    """A row for each of docs (doc_id, text): doc_id, n_shingles, component_id, class_key, component, and docs' columns more.

    component is a number that the classes of a component share, with or without ids.
    """
    spark = docs.sparkSession
    index, _ = written(spark, classed(docs.select("doc_id", "text", *more), n), "jaccard-index")
    # one document stands for a class, by its id and text; classes go by numbers from here on
    rows = index.groupBy("class_key", "doc_id", "text_hash").agg(F.max("n_shingles").alias("size"), F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "copies")).alias("first")
    classes = rows.groupBy("class_key").agg(F.max("size").alias("size"), F.min("doc_id").alias("first_id"), first)
    classes, classes_path = written(spark, classes.select("class_key", F.monotonically_increasing_id().alias("class_no"), "size", "first_id", "first.doc_id", "first.text_hash", "first.copies"), "jaccard-reps")
    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), "text", F.xxhash64("text").alias("own_hash"))

    def documents_of(chosen: DataFrame) -> DataFrame:
        """text and class_no of chosen classes, a repeated row once; only such rows are shuffled for it."""
        own = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash"))
        found = lambda some: texts.join(broadcast_if_few(some.select("class_no", "doc_id", "text_hash")), own).select("text", "class_no")
        repeated = chosen.filter("copies > 1")
        if not repeated.limit(1).count():
            return found(chosen)
        return found(chosen.filter("copies = 1")).unionByName(found(repeated).dropDuplicates(["class_no"]))

    plan = bands(crowds(classes), num, den)
    n_keys = classes.agg(F.sum("size")).first()[0] or 1
    bits = min(64, max(KEY_BITS, SPARE_BITS + int(n_keys).bit_length()))
    ranges = partitions_for(docs, RANGE_BYTES)
    bits = min(bits, 64 - ranges.bit_length())
    members, members_path = written(spark, bucketed(blobs(documents_of(classes.filter(F.col("size") >= plan[0].least)), plan, n, num, den, bits, ranges), ranges), "jaccard-buckets")
    paths = [members_path]
    wanted = classes.join(members.select(F.col("class_key").alias("class_no")).distinct(), "class_no", "left_semi")
    sets, sets_path = written(spark, sets_of(documents_of(wanted), n), "jaccard-sets")
    paths.append(sets_path)

    links = None
    labels = None
    left, tried = members, None
    for turn in range(STAR_ROUNDS + 1):
        if turn < STAR_ROUNDS:
            ends = left.select(F.col("class_key").alias("x"), F.explode(F.array("low", "high")).alias("y"))
            pairs = ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        else:
            pairs = within(left.filter(F.col("members") <= PAIRED), sets, num, den)
            large = left.filter(F.col("members") > PAIRED).select("class_key", "component").distinct()
            if large.limit(1).count():
                pairs = pairs.union(across(large, sets, num, den)).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs, pairs_path = written(spark, pairs, "jaccard-pairs")
        paths.append(pairs_path)
        few, few_path = written(spark, possible(pairs, sets, num, den), "jaccard-possible")
        near, near_path = written(spark, finely(few, sets, num, den), "jaccard-near")
        found, found_path = written(spark, verified(near, sets, num, den), "jaccard-links")
        paths += [few_path, near_path, found_path]
        links = found if links is None else links.union(found)
        tried = pairs if tried is None else tried.union(pairs)
        if labels is not None:
            paths.append(labels_path)
        labels, labels_path = connected(spark, links)
        if turn == STAR_ROUNDS:
            break
        # a bucket's ends have met all others of it, so they leave it
        known = left.filter("class_key <> low and class_key <> high").select("key", "class_key").join(labels.withColumnRenamed("node", "class_key"), "class_key", "left").withColumn("component", F.coalesce("component", "class_key"))
        # what is still in several components takes other ends: by a hash that changes with the turn
        rank = F.struct(F.xxhash64("component", F.lit(turn)).alias("h"), F.col("class_key").alias("c"))
        mixed_ = known.groupBy("key").agg(F.min("component").alias("m"), F.max("component").alias("n"), F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.count("*").alias("members")).filter("m <> n")
        left = known.join(mixed_.select("key", F.col("lo.c").alias("low"), F.col("hi.c").alias("high"), "members"), "key")
        left, left_path = written(spark, left, "jaccard-left")
        paths.append(left_path)
        if not left.limit(1).count():
            break
    named = classes.join(labels.select(F.col("node").alias("class_no"), "component"), "class_no", "left")
    named = named.withColumn("component", F.coalesce("component", "class_no"))
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_class, class_path = written(spark, named.join(ids, "component").select("class_key", "component_id", "component"), "jaccard-classes")
    dropped(spark, *paths, labels_path, classes_path)
    out = index.select("doc_id", "n_shingles", "class_key", *more).join(by_class, "class_key")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class_key", "component", *more)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
