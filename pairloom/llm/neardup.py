"""N-gram Jaccard join with parity sketches.

A document's set holds the hashes of its shingles. Two sets with a Jaccard similarity of 3/4 or more differ in at most a seventh of
their summed sizes. A sketch deals the hashes of a set to words and XORs what falls into one: hashes that both sets hold cancel out in
the difference, so the number of differing words (their Hamming distance) is never above the symmetric difference. With more non-empty
words than differences allowed, linked sets agree in a non-empty word (pigeonhole). Sizes form bands; a band fixes the number of words,
and a set near the upper end of its band is also sketched for the next one, so linked sets meet in some band.

Words that only one set holds are dropped early. A set of which too few words are shared drops out as a whole. Of the rest, each set
keeps its least shared words, as many as the pigeonhole needs (a prefix in one order of all words); sets that share one are candidates
and are verified: by bit sketches of the same kind, then on their whole sets. Exact copies are one class from the start. For components,
every class is first compared with a few others of its buckets; after that only candidates of different components are, so a large
group of near copies does not cost all its pairs.

Hashes have 64 bits; equal hashes of different shingles, or a band's words too few for the pigeonhole (beyond 8 deviations), are of
that order and are left to chance.

Defined results: a null, empty or word-less text has an empty set and no links; fewer words than a shingle are one shingle; documents
of equal keys count as one key with the links of all of them; a null key can link others but is no component id. Texts of any length
are taken whole; other columns stay with their rows in first_of_each and are not looked at elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairloom.llm.common import LOWERED, column, mixed, slices, staged, text_bytes, unused, word_hashes, words
from pairloom.llm.components import components

SHINGLE = 5
#: Similarity of linked sets, as a fraction.
OVER, UNDER = 3, 4
#: Bits of the filter that spares most documents from being fetched again; full, it spares none.
FILTER_BITS = 1 << 23
#: Bits of the sketch that tells most pairs apart before their sets are compared.
SKETCH_BITS = 4096
#: Partners that a class is compared with before the rest is searched; this only saves work.
FIRST_PARTNERS = 8
_ODD = np.random.default_rng(5).integers(1, 2**62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words of a sketch for each shingle at the band's upper end, by that end; the first band has a word for every shingle.
_SHARE = {32: None, 64: 2.0, 128: 0.67, 256: 0.5, 512: 0.4}
_LEAST_SHARE = 1 / 3


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, at = text_bytes(texts)
    lowered = LOWERED[data]
    starts, ends, first = words(lowered, at)
    h = word_hashes(lowered, starts, ends)
    rolled = np.zeros(max(len(h) - SHINGLE + 1, 0), np.uint64)
    for j in range(SHINGLE):
        rolled += h[j : j + len(rolled)] * _ODD[j]
    rolled = mixed(rolled)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            s = np.sort(rolled[a : b - SHINGLE + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            sets.append(s[keep])
        else:
            whole = (h[a:b] * _ODD[: b - a]).sum(dtype=np.uint64, keepdims=True)
            sets.append(mixed(whole ^ mixed(np.full(1, b - a, np.uint64))) if b > a else h[:0])
    return sets


def set_class(s: np.ndarray) -> int:
    """A number for all sets equal to this one."""
    again = mixed(s)
    both = np.array([np.bitwise_xor.reduce(again), again.sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)
    return int(mixed(both[:1] * _ODD[2] + mixed(both[1:]))[0].astype(np.int64))


def bands(n: int) -> list[tuple[int, int]]:
    """Upper ends of the bands that a set of n shingles is sketched for, each with the most differences to a partner there."""
    top = 32
    while top < n:
        top *= 2
    most = n * UNDER // OVER
    allowed = lambda partner: (n + partner) * (UNDER - OVER) // (UNDER + OVER)
    return [(top, allowed(min(top, most)))] + ([(top * 2, allowed(most))] if most > top else [])


def sketch(s: np.ndarray, top: int) -> np.ndarray:
    """One number for each non-empty word of the band's sketch: its place and the XOR of what fell into it."""
    share = _SHARE.get(top, _LEAST_SHARE)
    high = s >> np.uint64(32)
    place = high if share is None else (high * np.uint64(int(top * share))) >> np.uint64(32)
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return mixed(np.bitwise_xor.reduceat(s, begin) ^ mixed(place[begin] + (np.uint64(top) << np.uint64(32))))


def unseen(sets: list[np.ndarray], seen: set[int]) -> list[tuple[int, np.ndarray]]:
    """Class and set of those that are not empty and whose class the task meets first; `seen` holds a number per class of one partition."""
    firsts = []
    for s in sets:
        if len(s) and (name := set_class(s)) not in seen:
            seen.add(name)
            firsts.append((name, s))
    return firsts


def bit_sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities: the bit that each hash falls on, flipped for each."""
    odd = np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_link(x: Column, y: Column, n_x: Column, n_y: Column) -> Column:
    """Whether the Hamming distance of two bit sketches, and the sizes, allow the similarity."""
    distance = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, v: total + v)
    return (F.least(n_x, n_y) * UNDER >= F.greatest(n_x, n_y) * OVER) & (distance * (UNDER + OVER) <= (n_x + n_y) * (UNDER - OVER))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(column(id_col).cast("long").alias("key"), column(text_col).alias("text"))


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, n (size of the set), class, and for each of two bands how many words must be shared to have a partner (null: not there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                need: list[list[int | None]] = [[], []]
                for s in sets:
                    for k, row in enumerate(need):
                        inside = bands(len(s))[k : k + 1] if len(s) else []
                        row.append(len(sketch(s, inside[0][0])) - inside[0][1] if inside else None)
                columns = [part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_class(s) for s in sets], pa.int64()), *(pa.array(x, pa.int32()) for x in need)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n", "class", "need_0", "need_1"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "key long, n long, class long, need_0 int, need_1 int")


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word, class, next (whether for the next band): the sketches of all classes. A task sends each class once, however many its copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                found, classes, upper = [np.zeros(0, np.uint64)], [], []
                for name, s in unseen(shingle_sets(part.column("text")), seen):
                    for k, (top, _) in enumerate(bands(len(s))):
                        found.append(sketch(s, top))
                        classes.append(np.full(len(found[-1]), name))
                        upper.append(np.full(len(found[-1]), bool(k)))
                flat = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((classes, np.int64), (upper, bool))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), *map(pa.array, flat)], ["word", "class", "next"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "word long, class long, next boolean")


def buckets(docs: DataFrame, described: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word, class: the words whose classes are candidates of one another."""
    whole = Window.partitionBy("word")
    rows = sketched(docs, id_col, text_col).withColumn("low", F.min("class").over(whole)).withColumn("high", F.max("class").over(whole))
    shared = rows.where(F.col("low") != F.col("high")).select("word", "class", "next").distinct().withColumn("sets", F.count("*").over(whole))
    needs = described.where("n > 0").groupBy("class").agg(F.max("need_0").alias("need_0"), F.max("need_1").alias("need_1"))
    rows = staged(shared).join(needs, "class").withColumn("need", F.when(F.col("next"), F.col("need_1")).otherwise(F.col("need_0")))
    own = Window.partitionBy("class", "next")
    rows = rows.withColumn("all", F.count("*").over(own)).where(F.col("all") >= F.col("need"))
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy("sets", "word"))).where(F.col("rank") <= F.col("all") - F.col("need") + 1)
    rows = rows.select("word", "class").distinct().withColumn("sets", F.count("*").over(whole))
    return staged(rows.where("sets > 1").select("word", "class"))


def _bits(numbers: DataFrame, name: str) -> bytes:
    """A filter of FILTER_BITS bits that holds the numbers' remainders."""
    place = F.pmod(F.col(name), F.lit(FILTER_BITS)) + 1
    rows = numbers.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("v")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in rows:
        out[(r["k"] - 1) * len(r["v"]) : r["k"] * len(r["v"])] = r["v"]
    return bytes(out)


def _held(bits: bytes, numbers: np.ndarray) -> np.ndarray:
    place = numbers.astype(np.int64) % FILTER_BITS
    return (np.frombuffer(bits, np.uint8)[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def fetched(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """class, n, set, bits: the whole sets of the classes and their bit sketches. A task sends each class once."""
    bits = docs.sparkSession.sparkContext.broadcast(_bits(classes, "class"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                firsts = unseen(shingle_sets(part.column("text")), seen)
                sets, names = [s for _, s in firsts], np.array([name for name, _ in firsts], np.int64)
                kept = np.flatnonzero(_held(bits.value, names))
                yield pa.RecordBatch.from_arrays([pa.array(names[kept]), pa.array([len(sets[i]) for i in kept], pa.int64()), pa.array([sets[i].tobytes() for i in kept], pa.binary()), pa.array([bit_sketch(sets[i]) for i in kept], pa.list_(pa.int64()))], ["class", "n", "set", "bits"])

    rows = _texts(docs, id_col, text_col).mapInArrow(run, "class long, n long, set binary, bits array<long>")
    return staged(rows.join(classes, "class", "left_semi").dropDuplicates(["class"]))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, with the sizes of intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            last, left = None, np.zeros(0, np.uint64)
            for a, b, x, y in zip(*(batch.column(c) for c in ("a", "b", "x", "y")), strict=True):
                if a != last:
                    last, left = a, np.frombuffer(x.as_buffer(), np.uint64)
                right = np.frombuffer(y.as_buffer(), np.uint64)
                short, long = (left, right) if len(left) < len(right) else (right, left)
                if len(short) * UNDER < len(long) * OVER:
                    continue
                both = int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())
                union = len(short) + len(long) - both
                if both * UNDER >= union * OVER:
                    for column_, value in zip(out, (a.as_py(), b.as_py(), both, union), strict=True):
                        column_.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "shared", "united"])

    near = pairs.join(_named(sets, "a", n="n_a", bits="bits_a"), "a").join(_named(sets, "b", n="n_b", bits="bits_b"), "b")
    near = staged(near.where(_may_link(F.col("bits_a"), F.col("bits_b"), F.col("n_a"), F.col("n_b"))).select("a", "b"))
    rows = near.join(_named(sets, "a", set="x"), "a").join(_named(sets, "b", set="y"), "b")
    return staged(rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, shared long, united long"))


def _named(sets: DataFrame, key: str, **columns: str) -> DataFrame:
    return sets.select(F.col("class").alias(key), *(F.col(k).alias(v) for k, v in columns.items()))


def similar_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join: described documents (key, n, class), and all linked pairs (a, b, shared, united) of different classes."""
    described = staged(describe(docs, id_col, text_col))
    rows = buckets(docs, described, id_col, text_col)
    other = rows.select("word", F.col("class").alias("b"))
    pairs = rows.withColumnRenamed("class", "a").join(other, "word").where(F.col("a") < F.col("b")).select("a", "b").distinct()
    return described, verified(pairs, fetched(docs, rows.select("class").distinct(), id_col, text_col))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, n, component, class, group: for every document the size of its set and the smallest key that it reaches by links.

    `class` names its set (equal sets have one class) and `group` all that it reaches, also where no key does; null for an empty set.
    """
    described = staged(describe(docs, id_col, text_col))
    rows = buckets(docs, described, id_col, text_col)
    sets = fetched(docs, rows.select("class").distinct(), id_col, text_col)
    # neighbours in a random order of each bucket first: in a large group of near copies this joins most of them
    labeled = rows.withColumn("label", F.col("class"))
    links = None
    for turn in range(2):
        order = Window.partitionBy("word").orderBy(F.xxhash64("class", F.lit(turn)), "class")
        met = labeled.withColumn("b", F.lag("class").over(order)).withColumn("of_b", F.lag("label").over(order)).where(F.col("label") != F.col("of_b"))
        met = met.select(F.col("class").alias("a"), "b").distinct()
        some = Window.partitionBy("a").orderBy(F.xxhash64("b", F.lit(turn)))
        met = met.withColumn("k", F.row_number().over(some)).where(F.col("k") <= FIRST_PARTNERS).select("a", "b")
        found = verified(met, sets).select("a", "b")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        named = rows.join(labels.withColumnRenamed("node", "class"), "class", "left").select("word", "class", F.coalesce("label", "class").alias("label"))
        several = named.groupBy("word").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("word")
        labeled = staged(named.join(several, "word"))
    # then every pair of different components that is left. In a bucket, all but the most frequent component meet the others.
    counts = labeled.groupBy("word", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("word").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    split = staged(labeled.join(main, "word").join(_named(sets, "class", n="n", bits="bits"), "class"))
    minor = split.where(F.col("label") != F.col("main")).select("word", F.col("class").alias("a"), F.col("label").alias("of_a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    other = split.select("word", F.col("class").alias("b"), F.col("label").alias("of_b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"), (F.col("label") == F.col("main")).alias("is_main"))
    near = _may_link(F.col("bits_a"), F.col("bits_b"), F.col("n_a"), F.col("n_b"))
    meet = (minor["word"] == other["word"]) & (F.col("of_a") != F.col("of_b")) & (F.col("is_main") | (F.col("a") < F.col("b"))) & near
    left = minor.join(other, meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = links.unionByName(verified(left, sets).select("a", "b"))
    labels = staged(components(links))
    firsts = described.where("n > 0").groupBy("class").agg(F.min("key").alias("first"))
    named = firsts.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    component = named.groupBy("label").agg(F.min("first").alias("component"))
    found = named.join(component, "label").select("class", "component", F.col("label").alias("group"))
    joined = described.select("key", "n", "class").join(found, "class", "left")
    empty = F.col("n") == 0
    return joined.select("key", "n", F.when(empty, F.col("key")).otherwise(F.col("component")).alias("component"), F.when(~empty, F.col("class")).alias("class"), F.when(~empty, F.col("group")).alias("group"))


def _with_class(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """The rows of docs with the class of their sets, null for an empty one."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([set_class(s) if len(s) else None for s in sets], pa.int64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def first_of_each(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with its columns, of each group of `found`, which near_duplicates(docs) gave; documents without words all stay.

    It is the row of the group's smallest key. Where rows repeat this key, or no row of the group has a key, any one of them stays.
    Rows of one key that are in different groups are looked at apart. A filter of fixed size tells most rows that stay from the rest;
    only the rest is joined. Rows of null or repeated keys go a way of their own, by the class of their sets.
    """
    keys = staged(found.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("component").alias("component")))
    gone = staged(keys.where("key IS NOT NULL AND (rows > 1 OR component <> key)").select("key", "rows"))
    bits = docs.sparkSession.sparkContext.broadcast(_bits(gone, "key"))
    place = docs.columns.index(id_col)

    def part(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(place).cast(pa.int64())
                held = _held(bits.value, pa.compute.fill_null(keys, 0).to_numpy()) & np.asarray(pa.compute.is_valid(keys))
                yield batch.filter(pa.array(held if inside else ~held & np.asarray(pa.compute.is_valid(keys))))

        return run

    doubtful = docs.mapInArrow(part(True), docs.schema)
    kept = docs.mapInArrow(part(False), docs.schema).unionByName(doubtful.join(gone, column(id_col) == gone["key"], "left_anti"))
    if keys.where("rows > 1 OR key IS NULL").first() is None:
        return kept
    several = gone.where("rows > 1")
    odd = docs.where(column(id_col).isNull()).unionByName(docs.join(several, column(id_col) == several["key"], "left_semi"))
    name, of, first = (unused(docs, x) for x in ("set_class", "set_group", "first_key"))
    groups = found.where("class IS NOT NULL").select(F.col("class").alias(name), F.col("group").alias(of)).distinct()
    firsts = found.where("group IS NOT NULL").groupBy(F.col("group").alias(of)).agg(F.min("key").alias(first))
    odd = _with_class(odd, text_col, name)
    met = odd.where(column(name).isNotNull()).join(groups, name).join(firsts, of).where(column(first).eqNullSafe(column(id_col)))
    chosen = met.dropDuplicates([of]).select(*(column(c) for c in docs.columns))
    return kept.unionByName(chosen).unionByName(odd.where(column(name).isNull()).select(*(column(c) for c in docs.columns)))
