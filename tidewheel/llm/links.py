"""Links between similar sets: signatures dealt out, candidates, sketches, exact comparison, components.

An item is a set known by a 64-bit hash; equal sets have one hash, so copies meet wherever they lie. Its key is the
hash's upper ``KEY_BITS``: signatures carry keys only, and the few items that share a key are told apart when sets are compared.

1. Signatures are dealt to tasks by packed rows. A signature that up to ``SMALL_GROUP`` keys share gives all their pairs.
2. Sketches, small counts of a set's elements, turn away pairs that cannot be similar enough.
3. The keys of a larger group are compared by sketches in blocks of bounded size, and only links that join what was
   apart come out, fewer than there are keys in a block: first in the largest group of each key, then in all groups
   whose keys are not joined by then.
4. What plausible pairs join is a cluster. Whole sets meet once, cluster by cluster, and are compared exactly.

So each link between different items is found if they share a signature, a result is never larger than its input, and
no task holds more of a group than a block; a cluster or group beyond a block is compared by blocks in two rounds
(``joined``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, Scratch, components, map_arrow, partitions

#: Up to so many keys, a group of one signature gives all its pairs.
SMALL_GROUP = 24
#: Signatures that a map task gathers before it deals them out, and pairs that a reduce task gathers.
FLUSH, PAIRS = 400_000, 1_000_000
KEY_BITS = 40
#: Base of the logarithm by which set sizes are told apart.
SIZE_BASE = 1.06
#: Bytes of sketches, and of whole sets' texts, that one task compares.
SKETCH_BLOCK, SET_BLOCK = 1 << 19, 4 << 20
PACKED = "bucket int, data binary"
SKETCHES = "key long, size long, sketch binary"


def key_of(column: str):
    """The key of a hash, as a Spark column."""
    return F.shiftrightunsigned(column, 64 - KEY_BITS)


def size_class(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(np.log(np.maximum(sizes, 1)) / math.log(SIZE_BASE), 255).astype(np.uint8)


class Dealer:
    """Gathers (signature, item, size class) and deals them out as packed arrays: a row a bucket instead of a row a signature.

    Of a signature the lower 32 bits travel, as the upper ones choose the bucket; of an item its key. Signatures that
    agree by chance only make a pair that is compared in vain.
    """

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.n = buckets, [], 0

    def add(self, sigs: np.ndarray, items: np.ndarray, classes: np.ndarray) -> None:
        self.parts.append((sigs, items, classes))
        self.n += len(sigs)

    def full(self) -> bool:
        return self.n >= FLUSH

    def rows(self) -> pa.RecordBatch:
        out: tuple[list, list] = ([], [])
        if self.n:
            sigs, items, classes = (np.concatenate(x) for x in zip(*self.parts))
            self.parts, self.n = [], 0
            at = ((sigs >> U64(32)) * U64(self.buckets) >> U64(32)).astype(np.uint16 if self.buckets <= 1 << 16 else np.int64)
            order = np.argsort(at, kind="stable")
            at, low, keys, classes = at[order], sigs[order].astype("<u4"), items[order].view(np.uint64) >> U64(64 - KEY_BITS), classes[order]
            cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            for a, b in zip(cut, np.append(cut[1:], len(at))):
                out[0].append(int(at[a]))
                out[1].append(low[a:b].tobytes() + keys[a:b].astype("<u4").tobytes() + (keys[a:b] >> U64(32)).astype(np.uint8).tobytes() + classes[a:b].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["bucket", "data"])


def _unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sigs, keys, classes = [], [], []
    for x in rows:
        n = len(x) // 10
        sigs.append(np.frombuffer(x, "<u4", n))
        keys.append(np.frombuffer(x, "<u4", n, 4 * n) | (np.frombuffer(x, np.uint8, n, 8 * n).astype(np.uint64) << U64(32)))
        classes.append(np.frombuffer(x, np.uint8, n, 9 * n))
    return np.concatenate(sigs), np.concatenate(keys), np.concatenate(classes)


def groups_of(sigs: np.ndarray, keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(signatures, keys, classes, first, size): the keys of each signature that two or more have, in order, and where a group begins."""
    ranked = np.sort((sigs.astype(np.uint64) << U64(32)) | np.arange(len(sigs), dtype=np.uint64))
    own, at = ranked >> U64(32), (ranked & U64(0xFFFFFFFF)).astype(np.int64)
    same = own[1:] == own[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    own, at = own[shared], at[shared]
    group = np.cumsum(np.diff(own, prepend=~own[:1]) != 0).astype(np.uint64)
    _, once = np.unique((group << U64(KEY_BITS)) | keys[at], return_index=True)
    group, own, at = group[once], own[once], at[once]
    first = np.flatnonzero(np.diff(group, prepend=~group[:1]) != 0)
    size = np.diff(np.append(first, len(group)))
    return own, keys[at].astype(np.int64), classes[at], first, size


def _pairs_of(keys: np.ndarray, classes: np.ndarray, first: np.ndarray, size: np.ndarray, apart: int) -> Iterator[np.ndarray]:
    """(2, n) arrays of the pairs of small groups whose size classes allow a link."""
    for k in range(2, SMALL_GROUP + 1):
        rows = first[size == k][:, None] + np.arange(k)
        x, y = np.triu_indices(k, 1)
        for a in range(0, len(rows), 1 << 14):
            own, c = keys[rows[a : a + (1 << 14)]], classes[rows[a : a + (1 << 14)]].astype(np.int16)
            ok = np.abs(c[:, x] - c[:, y]) <= apart
            yield np.stack([own[:, x][ok], own[:, y][ok]])


def distinct_pairs(parts: list[np.ndarray]) -> np.ndarray:
    both = np.concatenate(parts, axis=1) if parts else np.empty((2, 0), np.int64)
    both = both[:, np.lexsort(both)]
    return both[:, np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(axis=0)])] if both.shape[1] else both


def candidates(packed: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """(kind, a, b): kind 0 a pair of keys a < b to compare, kind 1 (signature, key) of a group of more than ``SMALL_GROUP``.

    Buckets come one after the other, so a task holds the signatures of one bucket, at 10 bytes each.
    """
    apart = int(math.log(den / num) / math.log(SIZE_BASE)) + 1

    def triples(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count, bucket, rows = 0, None, []

        def large() -> Iterator[pa.RecordBatch]:
            nonlocal count
            own, keys, classes, first, size = groups_of(*_unpacked(rows))
            found = list(_pairs_of(keys, classes, first, size, apart))
            held.extend(found)
            count += sum(x.shape[1] for x in found)
            hot = np.repeat(size > SMALL_GROUP, size)
            if hot.any():
                yield triples(1, (np.int64(bucket) << np.int64(32)) | own[hot].astype(np.int64), keys[hot])

        def both(stop: bool) -> Iterator[pa.RecordBatch]:
            nonlocal count
            if rows:
                yield from large()
            if count >= PAIRS or stop:
                pairs = distinct_pairs(held)
                held.clear()
                count = 0
                yield triples(0, pairs[0], pairs[1])

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != bucket:
                    yield from both(False)
                    bucket, rows = k, []
                rows.append(data)
        yield from both(True)

    dealt = packed.repartition(partitions(packed.sparkSession), "bucket").sortWithinPartitions("bucket")
    return map_arrow(dealt, deal, "kind int, a long, b long")


# ---------------------------------------------------------------- sketches


def sketch(items: np.ndarray) -> np.ndarray:
    """How many items fall into each of some buckets, one for about two items; a count stops at 255."""
    bits = min(max(int(len(items) - 1).bit_length() - 1, 5), 12)
    return np.minimum(np.bincount((items >> U64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """Sketches (the last axis) with fewer buckets."""
    return x if x.shape[-1] == size else np.minimum(x.reshape(*x.shape[:-1], size, -1).sum(axis=-1), 255).astype(np.uint8)


def may_reach(x: np.ndarray, y: np.ndarray, n, m, num: int, den: int) -> np.ndarray:
    """Whether sets of n and m items can be num/den alike: their sketches differ by no more than they may themselves.

    Any of them may be arrays of sketches or sizes. Sets that are so much alike are never turned away.
    """
    apart = np.abs(y.astype(np.int16) - x.astype(np.int16)).sum(axis=-1, dtype=np.int64)
    return (apart * (den + num) <= (den - num) * (n + m)) & (den * np.minimum(n, m) >= num * np.maximum(n, m))


def plausible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sketches allow."""
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("key").alias(side), F.col("size").alias(f"{side}_size"), F.col("sketch").alias(f"{side}_sketch")), side)

    def rough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            kinds: dict[tuple[int, int], list[int]] = {}
            for k, (p, q) in enumerate(zip(x, y)):
                kinds.setdefault((len(p), len(q)), []).append(k)
            ok = np.zeros(len(x), bool)
            for (p, q), rows in kinds.items():
                width = min(p, q)
                left = folded(np.frombuffer(b"".join(x[k] for k in rows), np.uint8).reshape(-1, p), width)
                right = folded(np.frombuffer(b"".join(y[k] for k in rows), np.uint8).reshape(-1, q), width)
                ok[rows] = may_reach(left, right, n[rows], m[rows], num, den)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])

    rows = pairs.select("a", "b", F.col("a_size").alias("n"), F.col("b_size").alias("m"), F.col("a_sketch").alias("x"), F.col("b_sketch").alias("y"))
    return map_arrow(rows, rough, "a long, b long")


# ---------------------------------------------------------------- comparison in blocks

#: like(x, others) tells which of the others of a block are like x; all are numbers of the block's members.
Like = Callable[[int, np.ndarray], np.ndarray]


def connect(labels: np.ndarray, centres: np.ndarray, main: np.ndarray | None, like: Like) -> np.ndarray:
    """Labels after all links between centres and other members of a block have joined them.

    Only members of different labels are compared. A centre that is joined to what main marks is left out; without
    main the largest label counts as such, which is whole if every member is a centre.
    """
    _, own = np.unique(labels, return_inverse=True)
    done = np.zeros(len(own), bool)
    while True:
        sizes = np.bincount(own)
        if (sizes > 0).sum() < 2:
            return own
        todo = centres & ~done & (own != sizes.argmax() if main is None else ~np.isin(own, own[main]))
        if not todo.any():
            return own
        x = int(todo.argmax())
        done[x] = True
        others = np.flatnonzero((own != own[x]) & ~done)
        found = others[like(x, others)] if len(others) else others
        if len(found):
            own[np.isin(own, np.unique(own[found]))] = own[x]


def forest(ids: np.ndarray, labels: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the labels which have become one: of each label its smallest id, with the smallest of all."""
    order = np.lexsort((ids, labels))
    order = order[np.concatenate([[True], labels[order][1:] != labels[order][:-1]])]
    ids, own = ids[order], own[order]
    order = np.lexsort((ids, own))
    ids, own = ids[order], own[order]
    first = np.concatenate([[True], own[1:] != own[:-1]])
    root = ids[np.flatnonzero(first)[np.cumsum(first) - 1]]
    return ids[~first], root[~first]


#: Takes the rows of many blocks, and gives what makes the Like of the block in rows [a, b).
Comparer = Callable[[pa.RecordBatch], Callable[[int, int], Like]]


def compared(rows: DataFrame, comparer: Comparer, gather: int) -> DataFrame:
    """(a, b): the links that join what was apart, by tasks (g, k, j). rows: g, k, j, id, label, centre, main, and the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(stop: bool) -> Iterator[pa.RecordBatch]:
            """Compares the groups that are complete: all but the last one, which goes on in the next batch."""
            table = pa.Table.from_batches(held).combine_chunks().to_batches()
            held.clear()
            if not table:
                return
            table = table[0]
            keys = np.stack([table.column(c).to_numpy() for c in ("g", "k", "j")])
            cut = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            ends = np.append(cut[1:], table.num_rows)
            if not stop:
                held.append(table.slice(cut[-1]))
                cut, ends = cut[:-1], ends[:-1]
            if not len(cut):
                return
            table = table.slice(0, ends[-1])
            like_of = comparer(table)
            ids, labels, centres, main = (table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "centre", "main"))
            found = []
            for a, b in zip(cut, ends):
                if b - a > 1 and (labels[a:b] != labels[a]).any():
                    marked = main[a:b] if main[a:b].any() else None if centres[a:b].all() else main[a:b]
                    own = connect(labels[a:b], centres[a:b], marked, like_of(a, b))
                    found.append(forest(ids[a:b], labels[a:b], own))
            a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size >= gather:
                    yield from settle(False)
                    size = sum(x.nbytes for x in held) // 2  # a long group isn't joined anew with each batch
        if held:
            yield from settle(True)

    dealt = rows.repartition("g", "k", "j").sortWithinPartitions("g", "k", "j", "id")
    return map_arrow(dealt, run, "a long, b long")


def joined(rows: DataFrame, comparer: Comparer, block: int, scratch: Scratch) -> tuple[DataFrame, bool]:
    """(links (a, b), whether each a has its group's only b): they join the ids of each group as all links within it would.

    rows: g, id, label, weight, payload. Links join labels, each through its smallest id.

    A group of up to block of weight meets in one task. A larger one is cut into blocks, which meet with the group's
    smallest id first. Ids that are not joined to the group's largest part by then are few as a rule; cut into blocks
    too, they meet all the others in a second round. Links between two ids of the largest part need not be known.
    """
    spread = rows.groupBy("g").agg(F.ceil(F.sum("weight") / block).cast("int").alias("n"), F.min("id").alias("pivot")).where("n > 1")
    large = scratch.keep(spread, True)
    names = [c for c in rows.columns if c != "weight"]
    zero, yes, no = F.lit(0).alias("j"), F.lit(True).alias("centre"), F.lit(False).alias("main")
    own = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    if large.isEmpty():
        return scratch.keep(compared(rows.select(*names, F.lit(0).alias("k"), zero, yes, no), comparer, block)), True
    split = rows.join(large, "g", "left")
    first = split.select(*names, F.coalesce(own, F.lit(0)).alias("k"), zero, yes, no)
    pivots = split.where("id = pivot").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where(F.col("k") != own)
    found = scratch.keep(compared(first.union(pivots.select(*names, "k", zero, yes, no)), comparer, block))

    old = rows.join(large.select("g"), "g", "left_semi").select("g", "id", "weight", F.col("label").alias("old"))
    # The links join labels: an id takes part in them through the smallest id of its label, in whatever group.
    known = components(found.union(old.groupBy("old").agg(F.min("id").alias("low")).join(old, "old").select(F.col("id").alias("a"), F.col("low").alias("b"))), scratch)
    now = scratch.keep(old.join(known, old.id == known.node, "left").select("g", "id", "weight", F.coalesce("component", "id").alias("now")))
    most = now.groupBy("g", "now").agg(F.count("*").alias("m")).groupBy("g").agg(F.max(F.struct("m", "now")).alias("top"))
    marked = now.join(most, "g").select("g", "id", "weight", "now", (F.col("now") == F.col("top.now")).alias("main"))
    few = marked.where("not main").groupBy("g").agg(F.ceil(F.sum("weight") / block).cast("int").alias("few"))
    if few.isEmpty():
        return found, False
    marked = scratch.keep(marked.join(few, "g").join(large.select("g", "n"), "g"))
    whole = rows.drop("label", "weight").join(marked, ["g", "id"]).withColumnRenamed("now", "label")
    mine, theirs = own, F.pmod(F.hash("id"), F.col("few")).cast("int")
    against = whole.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("few") - 1))).withColumn("k", mine)
    against = against.withColumn("centre", ~F.col("main") & (F.col("j") == theirs))
    asking = whole.where("not main").withColumn("j", theirs).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where(F.col("k") != mine).withColumn("centre", F.lit(True))
    columns = [*names, "k", "j", "centre", "main"]
    more = scratch.keep(compared(against.select(*columns).union(asking.select(*columns)), comparer, block))
    return found.union(more), False


def table_of(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches of one width, one a row."""
    width = min(map(len, sketches))
    return np.stack([folded(x, width) for x in sketches])


def by_sketch(num: int, den: int) -> Comparer:
    """Compares members by size and sketch."""

    def comparer(rows: pa.RecordBatch) -> Callable[[int, int], Like]:
        sizes, sketches = rows.column("size").to_numpy(), [np.frombuffer(x, np.uint8) for x in rows.column("sketch").to_pylist()]

        def like_of(a: int, b: int) -> Like:
            table, n = table_of(sketches[a:b]), sizes[a:b]
            return lambda x, others: may_reach(table[x], table[others], n[x], n[others], num, den)

        return like_of

    return comparer


def by_set(sets_of: Callable[[list[bytes]], list[np.ndarray]], num: int, den: int) -> Comparer:
    """Compares members exactly; sets_of makes sorted distinct 64-bit words of payloads."""

    def comparer(rows: pa.RecordBatch) -> Callable[[int, int], Like]:
        sets = sets_of(rows.column("payload").to_pylist())
        sizes = np.array([len(x) for x in sets], np.int64)

        def like_of(a: int, b: int) -> Like:
            own, n = sets[a:b], sizes[a:b]
            table = table_of([sketch(x) for x in own]) if b - a > 8 else np.zeros((b - a, 1), np.uint8)

            def like(x: int, others: np.ndarray) -> np.ndarray:
                ok = may_reach(table[x], table[others], n[x], n[others], num, den) & (n[x] > 0)
                maybe = np.flatnonzero(ok)
                for k in range(0, len(maybe), 256):
                    some = others[maybe[k : k + 256]]
                    flat = np.concatenate([own[y] for y in some])
                    at = np.searchsorted(own[x], flat)
                    at[at == n[x]] = 0
                    both = np.add.reduceat((own[x][at] == flat).astype(np.int64), np.cumsum(n[some]) - n[some])
                    ok[maybe[k : k + 256]] = den * both >= num * (n[x] + n[some] - both)
                return ok

            return like

        return like_of

    return comparer


# ---------------------------------------------------------------- the whole


def similarity_components(packed: DataFrame, buckets: int, sketches_of: Callable[[DataFrame], DataFrame], payload_of: Callable[[DataFrame], DataFrame], sets_of: Callable[[list[bytes]], list[np.ndarray]], num: int, den: int, scratch: Scratch) -> DataFrame:
    """(id, component) of the items that links of at least num/den join with others; component is the smallest hash among them.

    packed: signatures from ``Dealer``. sketches_of(key) gives SKETCHES of the items with these keys; payload_of(key, g)
    gives (g, id, payload), of which sets_of makes sets.
    """
    found = scratch.keep(candidates(packed, buckets, num, den))
    scratch.sweep()
    pairs, hot = found.where("kind = 0").select("a", "b").distinct(), found.where("kind = 1").select(F.col("a").alias("g"), F.col("b").alias("key"))
    pairs = scratch.keep(pairs, True)
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).union(hot.select("key")).distinct()
    sketches = scratch.keep(sketches_of(keys))
    scratch.sweep()
    near = scratch.keep(plausible(pairs, sketches, num, den), True)
    if not hot.isEmpty():
        compare, weight = by_sketch(num, den), F.length("sketch").cast("long").alias("weight")
        # Each key in its largest group: as most of a cluster's groups hold the same keys, this joins nearly all.
        sizes = hot.groupBy("g").agg(F.count("*").alias("m"))
        largest = hot.join(sizes, "g").groupBy("key").agg(F.max(F.struct("m", "g")).alias("top")).select(F.col("top.g").alias("g"), "key")
        once = scratch.keep(largest.join(sketches, "key").select("g", F.col("key").alias("id"), F.col("key").alias("label"), "size", "sketch", weight), True)
        links = near.union(joined(once, compare, SKETCH_BLOCK, scratch)[0])
        labels = scratch.keep(components(links, scratch), True)
        # One exchange brings a key's label to its places in all groups.
        none = F.lit(None).cast("long")
        places = hot.select("g", "key", none.alias("component")).union(labels.select(none, "node", "component"))
        known = places.select("g", "key", F.coalesce(F.max("component").over(Window.partitionBy("key")), "key").alias("label")).where("g is not null")
        known = scratch.keep(known, True)
        apart = known.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("g")
        rows = known.join(apart, "g", "left_semi").join(sketches, "key").select("g", F.col("key").alias("id"), "label", "size", "sketch", weight)
        rows = scratch.keep(rows, True)
        more = joined(rows, compare, SKETCH_BLOCK, scratch)[0]
        if not more.isEmpty():
            labels = scratch.keep(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch), True)
        scratch.drop(once, known, rows)
    else:
        labels = scratch.keep(components(near, scratch), True)
    scratch.drop(found, pairs, sketches, near)
    items = payload_of(labels.select(F.col("node").alias("key"), F.col("component").alias("g")))
    items = scratch.keep(items.select("g", "id", F.col("id").alias("label"), F.length("payload").cast("long").alias("weight"), "payload"))
    scratch.sweep()
    links, whole = joined(items, by_set(sets_of, num, den), SET_BLOCK, scratch)
    scratch.drop(items)
    if whole:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
    return components(links, scratch).select(F.col("node").alias("id"), "component")
