"""Near duplicates by ProbMinHash of weighted shingles.

A document is the multiset of its five-word shingles, a shingle's weight is how often it
occurs. Every shingle sends arrivals of a Poisson process of that rate to random
registers; a register keeps the shingle that arrives first, and a document stops when no
arrival can be earlier than its slowest register. Two registers agree with the
probability Jaccard similarity of the documents. Bands of registers give candidates, and
the similarity itself, worked out from the texts, decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dissensus.llm import words as W
from dissensus.llm.components import components
from dissensus.llm.urlfilter import Blocks, possible
from dissensus.session import configure, written

SIMILARITY = 0.8
BANDS = 24
BAND_REGISTERS = 4
# At a similarity of 0.8 no band agrees in 3 of a million pairs: (1 - 0.8 ** 4) ** 24.
REGISTERS = BANDS * BAND_REGISTERS
# Candidates with fewer equal registers are not looked at: five standard deviations
# below what a pair of similarity 0.8 has.
LEAST_EQUAL = int(REGISTERS * SIMILARITY - 5 * (REGISTERS * SIMILARITY * (1 - SIMILARITY)) ** 0.5)
# A member of a bucket is compared with this many central ones and one at random, if
# they are not in one class yet.
CENTRES = 5
# Members of a bucket that are put in order together.
BUCKET_SLICE = 512
# Texts of a crowd that are in one block, and their distinct shingles.
CROWD_BLOCK = 4096
CROWD_SHINGLES = 1 << 21
# Shingles of a crowd's texts that are compared with a text at once.
CROWD_SLICE = 1 << 17


def signatures(rows: np.ndarray, values: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Registers of n documents given as distinct (row, shingle) with weights."""
    first = np.full(n * REGISTERS, np.inf)
    held = np.zeros(n * REGISTERS, dtype=np.uint64)
    time = np.zeros(len(values))
    arrival = 0
    while len(values):
        arrival += 1
        draw = W.mix(values + np.uint64(arrival * int(W.GOLDEN) % 2**64))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights
        at = rows * REGISTERS + ((draw & np.uint64(0x7FF)) * np.uint64(REGISTERS) >> np.uint64(11)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        held[at[won]] = values[won]
        slowest = first.reshape(n, REGISTERS).max(axis=1)
        going = time < slowest[rows]
        rows, values, weights, time = rows[going], values[going], weights[going], time[going]
    return held.reshape(n, REGISTERS)


def band_keys(held: np.ndarray) -> np.ndarray:
    """One number per band, different for each band."""
    parts = held.reshape(len(held), BANDS, BAND_REGISTERS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * W.GOLDEN
    for k in range(BAND_REGISTERS):
        key = W.mix(key ^ parts[:, :, k]) + np.uint64(k)
    return key.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted (shingles, weights): the sum over common shingles i of
    1 / sum over all j of max(a_j / a_i, b_j / b_i)."""
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    # In the order of falling x / y, the first term is the larger one up to i.
    order = np.argsort(-np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0), kind="stable")
    x, y = x[order], y[order]
    upto, after = np.cumsum(x), y.sum() - np.cumsum(y)
    both = (x > 0) & (y > 0)
    return float((1 / (upto[both] / x[both] + after[both] / y[both])).sum())


def weighted_shingles(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, bounds = W.shingles(w)
    return W.counted(found, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, d1, d2, bands, registers`` of rows with a key; all but the key are null for
    texts without words. d1 and d2 tell sequences of words apart."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter("key IS NOT NULL")
    schema = source.select("key").schema.add("d1", "long").add("d2", "long").add("bands", T.ArrayType(T.LongType())).add("registers", "binary")

    def run(batches):
        for batch in batches:
            data, offsets = W.utf8(batch.column("text"))
            for lo, hi in W.chunks(offsets, 1 << 19):
                w = W.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n, count = hi - lo, np.diff(w.bounds)
                held = signatures(*weighted_shingles(w), n)
                none = count == 0
                digests = []
                place = np.arange(len(w.hashes)) - np.repeat(w.bounds[:-1], count)
                for base in (W.BASE, W.GOLDEN):
                    sums = np.zeros(n, dtype=np.uint64)
                    if len(place):
                        terms = W.scattered(W.mix(w.hashes ^ base) * W.powers(int(count.max()), base | np.uint64(1))[place])
                        sums[~none] = np.add.reduceat(terms, w.bounds[:-1][~none])
                    digests.append(pa.array(W.mix(sums + count.astype(np.uint64)).view(np.int64), mask=none))
                short = np.ascontiguousarray((held & np.uint64(0xFFFF)).astype("<u2"))
                bands = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(band_keys(held).ravel())
                )
                registers = pa.array([None if x else row.tobytes() for x, row in zip(none, short)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(lo, n), *digests, bands, registers],
                    names=["key", "d1", "d2", "bands", "registers"],
                )

    return source.mapInArrow(run, schema)


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """Rows ``bucket, node`` of buckets with several members, with their number ``n``."""
    return buckets.join(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bucket")


def centres(shared: DataFrame) -> DataFrame:
    """Rows ``bucket, place, node`` of the CENTRES members of each bucket that are in the
    largest buckets. The original of a group of edited copies shares more buckets with
    them than they do with each other, and is the most similar to each."""
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    order = Window.partitionBy("bucket").orderBy(F.col("weight").desc(), "node")
    placed = shared.select("bucket", "node").join(weight, "node").withColumn("place", F.row_number().over(order))
    # Spark keeps the first rows of a bucket before it moves them.
    return placed.filter(F.col("place") <= CENTRES).select("bucket", "place", "node")


def pairs_of(rows: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` from rows ``node, other``."""
    pairs = rows.filter("node <> other")
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def first_pairs(shared: DataFrame, middle: DataFrame) -> DataFrame:
    """Each node with the first centre of the largest bucket it is in: one pair a node,
    which brings most of a large group of copies together."""
    largest = shared.groupBy("node").agg(F.max(F.struct("n", "bucket"))["bucket"].alias("bucket"))
    return pairs_of(largest.join(middle.filter("place = 1").select("bucket", F.col("node").alias("other")), "bucket"))


def other_pairs(shared: DataFrame, middle: DataFrame, roots: DataFrame) -> DataFrame:
    """In each bucket, a node with the CENTRES and with the node before it in an order
    that differs from bucket to bucket, where they are not in one class yet.

    That is all such pairs of up to CENTRES + 1 members. Larger buckets give pairs in
    proportion to their members; they are put in order in slices.
    """
    rooted = lambda rows: rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    middle = rooted(middle).groupBy("bucket").agg(F.collect_list(F.struct(F.col("node").alias("id"), "root")).alias("middle"))
    rows = rooted(shared).select(
        "bucket", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BUCKET_SLICE)).alias("slice"),
        F.xxhash64("node", "bucket").alias("order"), F.struct(F.col("node").alias("id"), "root").alias("member"),
    )
    before = F.lag("member").over(Window.partitionBy("bucket", "slice").orderBy("order", "member"))
    rows = rows.withColumn("before", before).join(middle, "bucket")
    others = F.array_append("middle", F.col("before"))
    apart = F.filter(others, lambda o: o.isNotNull() & (o["root"] != F.col("member")["root"]))
    found = rows.select(F.col("member")["id"].alias("id"), F.explode(F.transform(apart, lambda o: o["id"])).alias("other"))
    return pairs_of(found.withColumnRenamed("id", "node"))


def crowded(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``bucket, node, root`` of the buckets that ``other_pairs`` does not compare in full
    and that still hold several classes."""
    rows = shared.filter(F.col("n") > CENTRES + 1).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return rows.select("bucket", "node", "root").join(several.select("bucket"), "bucket", "left_semi")


def may_reach(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether texts can have a similarity of SIMILARITY if shares of x and y of their
    weights are in shingles that the other does not hold: the similarity is not above
    1 / (1 / (1 - x) + 1 / (1 - y) - 1)."""
    with np.errstate(divide="ignore"):
        return 1 / (1 - x) + 1 / (1 - y) <= 1 + 1 / SIMILARITY + 1e-9


def contents(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The values of a binary column without nulls one after another, not copied."""
    held = column.combine_chunks()
    _, offsets, data = held.buffers()
    ends = np.frombuffer(offsets, np.int32)[held.offset : held.offset + len(held) + 1]
    return np.frombuffer(data if data is not None else b"", np.uint8)[ends[0] : ends[-1]].view(kind)


def bags(texts: DataFrame) -> DataFrame:
    """``texts`` (``node, text``) as ``node, size, shingles, weights``: the sorted distinct
    shingles of each text and how often they occur, in binary."""
    schema = texts.select("node").schema.add("size", "long").add("shingles", "binary").add("weights", "binary")

    def run(batches):
        for batch in batches:
            data, offsets = W.utf8(batch.column("text"))
            for lo, hi in W.chunks(offsets, 1 << 19):
                at, values, weights = weighted_shingles(W.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                ends = np.searchsorted(at, np.arange(1, hi - lo + 1))
                cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip([0, *ends[:-1]], ends)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(lo, hi - lo), pa.array(np.diff(ends, prepend=0)), cut(values), cut(weights.astype("<u4"))],
                    names=["node", "size", "shingles", "weights"],
                )

    return texts.select("node", "text").mapInArrow(run, schema)


def crowds(rows: DataFrame) -> DataFrame:
    """``node, root, crowd, main`` from crowded rows ``bucket, node, root``: classes that
    share a bucket are in one crowd; ``main`` marks the members of its largest class, if
    that has more than one."""
    hub = rows.groupBy("bucket").agg(F.min("root").alias("hub"))
    ties = rows.select("bucket", "root").distinct().join(hub, "bucket").select("root", "hub").distinct()
    of = components(ties, "root", "hub").select(F.col("node").alias("root"), F.col("root").alias("crowd"))
    members = rows.select("node", "root").distinct().join(of, "root")
    sizes = members.groupBy("crowd", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("crowd").agg(F.max(F.struct("n", "root")).alias("largest"))
    main = (F.col("root") == F.col("largest")["root"]) & (F.col("largest")["n"] > 1)
    return members.join(largest, "crowd").select("node", "root", "crowd", main.alias("main"))


def crowd_links(members: DataFrame, texts: DataFrame, registers: DataFrame) -> DataFrame:
    """Links ``a, b, similarity`` that join the classes of each crowd (``crowds``): any two
    texts of a crowd with a similarity of SIMILARITY end up in one class.

    A crowd's largest class and its other texts are dealt to blocks of bounded numbers and
    sizes. Each block of other texts meets each block of the crowd in one place, where
    texts of different classes are compared and classes are united as links are found.
    A place gives out at most one link less than it has texts. Members of the largest
    class go to as many places as there are blocks of other texts, usually one.
    """
    kind = members.schema["node"].dataType
    held = written(members.join(bags(texts), "node").join(registers, "node"), "crowd-texts")
    need = lambda n, size: F.greatest(F.ceil(n / CROWD_BLOCK), F.ceil(size / CROWD_SHINGLES)).cast("int")
    count = lambda main: [F.count_if(F.col("main") == main), F.coalesce(F.sum(F.when(F.col("main") == main, F.col("size"))), F.lit(0))]
    blocks = held.groupBy("crowd").agg(need(*count(True)).alias("mains"), need(*count(False)).alias("others"))
    # Thin rows find their places; texts follow by their node.
    rows = held.select("node", "crowd", "main").join(blocks, "crowd")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    place = lambda first, second: F.struct(first.alias("first"), second.alias("second"))
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = F.col("block")
    of_main = F.transform(all_of("others"), lambda o: place(o, -1 - block))
    of_other = F.concat(
        F.transform(all_of("others"), lambda o: place(F.least(block, o), F.greatest(block, o))),
        F.transform(all_of("mains"), lambda m: place(block, -1 - m)),
    )
    placed = rows.select("node", "crowd", "block", F.explode(F.when(F.col("main"), of_main).otherwise(of_other)).alias("place"))
    placed = placed.select("node", "crowd", "block", "place.*").join(held.drop("crowd"), "node")
    keys = ["crowd", "first", "second"]
    dealt = placed.repartition(*keys).sortWithinPartitions(*keys, "node")

    def links_in(part: pa.Table) -> pa.RecordBatch:
        """Links within one place, of which a table holds all rows."""
        second = part.column("second")[0].as_py()
        main, block = (part.column(c).to_numpy(zero_copy_only=False) for c in ("main", "block"))
        label = part.column("root").combine_chunks().dictionary_encode().indices.to_numpy().copy()
        marks = contents(part.column("registers"), "<u2").reshape(-1, REGISTERS)
        size = part.column("size").to_numpy()
        ends = np.cumsum(size)
        shingles = contents(part.column("shingles"), "<u8")
        weights = contents(part.column("weights"), "<u4").astype(np.float64)
        total = np.add.reduceat(weights, ends - size)
        bag = lambda i: (shingles[ends[i] - size[i] : ends[i]], weights[ends[i] - size[i] : ends[i]])
        one, two, alike = [], [], []
        first = part.column("first")[0].as_py()
        left = np.flatnonzero(~main & (block == first))
        right = np.flatnonzero(main if second < 0 else block == second)
        for i in left:
            near = right if first != second else right[right > i]
            near = near[label[near] != label[i]]
            near = near[(marks[near] == marks[i]).sum(axis=1) >= LEAST_EQUAL]
            own, own_weights = bag(i)
            cuts = np.flatnonzero(np.diff(np.cumsum(size[near]) // CROWD_SLICE)) + 1
            for some in np.split(near, cuts):
                some = some[label[some] != label[i]]
                if not len(some):
                    continue
                # Weights in common shingles, of both sides.
                flat = np.arange(size[some].sum()) + np.repeat(ends[some] - np.cumsum(size[some]), size[some])
                at = np.minimum(np.searchsorted(own, shingles[flat]), len(own) - 1)
                both = own[at] == shingles[flat]
                begins = np.cumsum(size[some]) - size[some]
                theirs = np.add.reduceat(np.where(both, weights[flat], 0), begins)
                mine = np.add.reduceat(np.where(both, own_weights[at], 0), begins)
                able = may_reach(1 - mine / total[i], 1 - theirs / total[some])
                for j in some[able]:
                    if label[j] == label[i]:
                        continue
                    found = probability_jaccard(bag(i), bag(j))
                    if found >= SIMILARITY:
                        one.append(i)
                        two.append(j)
                        alike.append(found)
                        label[label == label[j]] = label[i]
        nodes = part.column("node").combine_chunks()
        x, y = (nodes.take(pa.array(np.array(at, dtype=np.int64))) for at in (one, two))
        return pa.RecordBatch.from_arrays([x, y, pa.array(alike, pa.float64())], names=["x", "y", "similarity"])

    def run(batches):
        # A place may go on in the next batch; the sizes of blocks bound it.
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            key = [now.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in keys]
            edge = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
            edge = [0, *edge.tolist()]
            for lo, hi in zip(edge, edge[1:]):
                yield links_in(now.slice(lo, hi - lo))
            rest = now.slice(edge[-1])
        if rest is not None:
            yield links_in(rest)

    found = dealt.mapInArrow(run, T.StructType().add("x", kind).add("y", kind).add("similarity", "double"))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with at least LEAST_EQUAL equal registers."""
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("registers").alias(f"of_{name}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("of_a", "of_b")
                )
                yield batch.filter(pa.array((x == y).sum(axis=1) >= LEAST_EQUAL)).select(["a", "b"])

    return joined.mapInArrow(run, pairs.schema)


def texts_of(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text`` of the documents in ``nodes`` (column ``key``). A blocked Bloom filter
    of bounded size keeps most other texts out of the shuffle; the join is exact."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter("key IS NOT NULL")
    return written(possible(rows, Blocks.of(nodes)).join(nodes.hint("merge"), "key", "left_semi"), "texts-of-pairs")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, similarity`` of pairs whose texts have a similarity of SIMILARITY or more."""
    side = lambda name: texts.select(F.col("key").alias(name), F.col("text").alias(f"of_{name}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    schema = pairs.select("a", "b").schema.add("similarity", "double")

    def run(batches):
        kept: dict[object, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def shingles(node, content):
            nonlocal size
            if node not in kept:
                if size > 4_000_000:
                    kept.clear()
                    size = 0
                _, values, weights = weighted_shingles(W.word_hashes([content]))
                kept[node] = values, weights
                size += len(values)
            return kept[node]

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = part.to_pylist()
                alike = np.array(
                    [probability_jaccard(shingles(r["a"], r["of_a"]), shingles(r["b"], r["of_b"])) for r in rows], dtype=np.float64
                )
                out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(alike)], names=["a", "b", "similarity"])
                yield out.filter(pa.array(alike >= SIMILARITY))

    return joined.mapInArrow(run, schema)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key, class_id, node, class_size, n_links``.

    Documents with the same words are one ``node``, the smallest key among them; nodes of
    a similarity of SIMILARITY or more are linked, and linked nodes make up a class, whose
    id is its smallest key. ``n_links`` counts a node's links that were verified: first
    with the centre of its largest bucket, then with members of all its buckets that are
    in other classes. Pairs that are in one class already are not compared.
    Documents without words are alike to none: each is its own class. Rows that repeat a
    key are in one class. A null key is not compared; its class is null, its size 1.
    """
    spark = docs.sparkSession
    configure(spark)
    made = written(sketches(docs, key, text), "sketches")
    full = made.filter("registers IS NOT NULL")
    nodes = full.groupBy("d1", "d2").agg(
        F.min("key").alias("node"), F.first("bands").alias("bands"), F.first("registers").alias("registers")
    )
    nodes = written(nodes, "nodes")
    shared = written(shared_buckets(nodes.select("node", F.explode("bands").alias("bucket"))), "buckets")
    registers = nodes.select("node", "registers")
    texts = texts_of(docs, shared.select(F.col("node").alias("key")).distinct(), key, text)
    middle = written(centres(shared), "centres")
    tried = written(first_pairs(shared, middle), "pairs")
    links = written(verified(likely(tried, registers), texts), "links-to-first")
    more = other_pairs(shared, middle, components(links)).join(tried, ["a", "b"], "left_anti")
    more = written(likely(more, registers), "pairs")
    links = links.unionByName(written(verified(more, texts), "links-to-others"))
    roots = components(links)
    left = written(crowded(shared, roots), "crowded")
    if not left.isEmpty():
        members = written(crowds(left), "crowds")
        rest = written(crowd_links(members, texts.withColumnRenamed("key", "node"), registers), "links-in-crowds")
        if not rest.isEmpty():
            links = links.unionByName(rest)
            roots = components(links)
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    ends = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    placed = (
        full.select("key", "d1", "d2").join(nodes.select("d1", "d2", "node"), ["d1", "d2"])
        .join(roots, "node", "left").join(ends, "node", "left")
        .select("key", F.coalesce("root", "node").alias("class_id"), "node", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    alone = made.filter("registers IS NULL").select("key", F.col("key").alias("class_id"), F.col("key").alias("node"), F.lit(0).cast("long").alias("n_links"))
    every = written(placed.unionByName(alone), "classes")
    sizes = every.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    unknown = docs.filter(F.col(key).isNull()).select(F.col(key).alias("key"))
    nothing = F.lit(None).cast(made.schema["key"].dataType)
    unknown = unknown.select("key", nothing.alias("class_id"), nothing.alias("node"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"))
    return (
        every.join(sizes, "class_id").select("key", "class_id", "node", "n_links", "class_size")
        .unionByName(unknown).withColumnRenamed("key", key)
    )


def marked_key(docs: DataFrame, key: str, text: str) -> Column:
    """A key for each key and text, in the order of the keys: texts that repeat a key are
    told apart by 62 bits of a hash. A null key stays null."""
    mark = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1))
    if isinstance(docs.schema[key].dataType, T.IntegralType):
        return F.col(key).cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + mark.cast("decimal(19,0)")
    return F.concat(F.col(key).cast("string"), F.lit("\0"), F.lpad(mark.cast("string"), 19, "0"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of near duplicates, and the rows with null keys.

    Of a class, the row with the smallest key stays, of rows that repeat this key the one
    with the lowest text (null: empty), of equal rows one. Here a class is made up of
    texts: rows that share a key but not a class do not drop each other. The columns
    of ``docs`` may have any names.
    """
    which = marked_key(docs, key, text)
    rows = docs.select(which.alias("key"), F.col(text).alias("text"))
    found = classes(rows, "key", "text").filter("key IS NOT NULL")
    heads = written(found.filter("key = class_id").select("key").distinct(), "heads")
    # Columns of docs are put away in one struct, where no name can clash.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), which.alias("key"))
    # A head is one key and text: only its own copies share it.
    repeated = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(heads, "key", "left_semi").select("key")
    repeated = written(repeated, "repeated-heads")
    single = held.join(heads.join(repeated, "key", "left_anti"), "key", "left_semi").select("row.*")
    many = held.join(repeated, "key", "left_semi")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.to_json("row")))
    many = many.withColumn("place", place).filter("place = 1").select("row.*")
    return single.unionByName(many).unionByName(docs.filter(F.col(key).isNull()))
