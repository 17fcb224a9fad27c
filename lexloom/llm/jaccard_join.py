"""N-gram Jaccard join on count-vector trees.

A document is its set of distinct word shingles. Shingle hashes fall into groups; the counts per group are the set's point (of more groups
for larger sets), and for two points the sum of the coordinates' minima is an upper bound of the sets' overlap. Two documents link when overlap / union >= threshold.
Equal sets are one node from the start, named by 64 bits of their digest (two sets with one name would raise an error).

One tree over all points would not prune: independent texts fill every box. So points first meet in buckets by an exact rule (two linked sets
share one of the first n - ceil(t n) + 1 of their shingles in any common order), and every bucket is a packed tree of its own.

1. `survey`: size, digest and fine counts of each set, and the shingles that a task meets repeatedly. The most frequent ones come last in
   the order, which spares buckets of common passages. This only orders the work: any order gives the same links.
2. `buckets`: sorted by Spark and streamed group by group. A bucket of up to LEAF members is a tree of one leaf, whose pairs are all
   counted; a larger one first gives a chain and a star. A pair goes on if it shares enough of the first shingles (`shared_least`).
3. Pairs are tested by summed minima over the fine groups, then verified on the texts' full sets; components are formed.
4. `across`: larger buckets that still hold several components are packed into trees of several levels over all their members, in blocks;
   the members outside the bucket's largest component query them. What passes the bound is verified in the same way. A member with more
   than PARTNERS partners in a cell first gives its best one of each component; its bucket is searched again, for all partners, with the
   components that this gives.
So no link between different components is missed, and no group is expanded into all its pairs.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; a null id links with nothing and keeps a null
component; a row that repeats an id is a document of its own text, so equal rows agree and different texts under one id may lie in different
components. Empty tables give no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, gives_back, release, whole_groups
from .components import components, tasks_for
from .textkit import mix, shingle_sets

LEAF, FANOUT, GROUP_BITS, FINE_BITS = 8, 8, 9, 13
BLOCK, PAIR_BLOCK = 1024, 256  # members of a bucket, and of a family of candidate pairs, in one side of a cell
NAMES = 100_000  # sets or pairs that a task remembers so as not to send them twice; beyond that it begins anew
SLICE = 250_000  # characters of texts worked on at once
PARTNERS = 4  # of a member in a cell, in the first search
FINE_BLOCK, TEXT_BLOCK = 4_000_000, 500_000  # shingles in one side of a cell
HEAVY_LOCAL, HEAVY_TOTAL, HEAVY_MOST, SALT_ROWS = 2, 16, 200_000, 2_000

SURVEY = "doc_id long, text_hash long, n long, sid long, check long, fine binary, shingle long"
FOUND = "kind string, a long, b long, na int, nb int, shared int, early boolean"


def arrays(schema: str, columns: list) -> pa.RecordBatch:
    """A batch of the schema; a None column is all null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    size = next(len(c) for c in columns if c is not None)
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.nulls(size, kinds[t]) if c is None else pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def name_of(own: np.ndarray) -> tuple[int, int]:
    """The set's name and a second half of its digest."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype=np.int64).tolist())


def finely(own: np.ndarray) -> bytes:
    """The counts in 2^FINE_BITS groups of a rising set, as steps from one shingle's group to the next; a byte of 255 adds to the one after it."""
    step = np.diff((own >> np.uint64(64 - FINE_BITS)).astype(np.int64), prepend=0)
    out = np.full(len(own) + int((step // 255).sum()), 255, dtype=np.uint8)
    out[np.cumsum(step // 255 + 1) - 1] = step % 255
    return out.tobytes()


def groups_of(steps: bytes) -> np.ndarray:
    """The fine group of each shingle, rising."""
    x = np.frombuffer(steps, dtype=np.uint8)
    return np.cumsum(x, dtype=np.int64)[x != 255]


def bits_of(n: np.ndarray) -> np.ndarray:
    """log2 of the number of groups in a set's point: about a shingle a group, 128 groups at least and 2^GROUP_BITS at most. Linked sets differ by one at most."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1))), 7, GROUP_BITS).astype(np.int64)


def packed(steps: bytes, n: int) -> bytes:
    """The set's point: its counts in as few bits as they take, 4, 8, 16 or 32 each."""
    bits = int(bits_of(np.array(n)))
    counts = np.bincount(groups_of(steps) >> (FINE_BITS - bits), minlength=1 << bits)
    top = counts.max()
    if top < 16:
        return (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    return counts.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def unpacked(raw: bytes, bits: int) -> np.ndarray:
    size = 1 << bits
    if len(raw) < size:
        half = np.frombuffer(raw, dtype=np.uint8)
        return np.stack([half & 15, half >> 4], axis=1).reshape(-1).astype(np.int32)
    return np.frombuffer(raw, dtype={1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // size]).astype(np.int32)


def needed(n, m, threshold: float):
    """The least overlap of linked sets of n and m shingles."""
    return np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)


def shared_least(n, m, threshold: float):
    """How many of the first n - ceil(t n) + 1 and m - ceil(t m) + 1 shingles linked sets share at least: the rest of a set can't hold more than itself."""
    return np.maximum(1, needed(n, m, threshold) - np.ceil(threshold * np.maximum(n, m) - 1e-9) + 1)


def least_shared(n: Column, m: Column, threshold: float) -> Column:
    """`shared_least` as a column, for n <= m."""
    return F.greatest(F.lit(1), F.ceil(F.lit(threshold / (1 + threshold)) * (n + m) - 1e-9) - F.ceil(F.lit(threshold) * m - 1e-9) + 1)


def survey(docs: DataFrame, words: int) -> DataFrame:
    """Rows of documents, and of shingles that a task met in HEAVY_LOCAL different sets or more (shingle, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def often() -> pa.RecordBatch:
            every = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            every.sort()
            # only what comes again is copied: a value met n times is n - 1 times the same as the one before
            values, n = np.unique(every[1:][every[1:] == every[:-1]], return_counts=True)
            keep = n + 1 >= HEAVY_LOCAL
            return arrays(SURVEY, [None, None, n[keep] + 1, None, None, None, values[keep].view(np.int64)])

        for part in chunks(batches, most=SLICE):
            rows = []
            for doc_id, text_hash, own in zip(part["doc_id"], part["text_hash"], shingle_sets(part["text"], words), strict=True):
                sid, check = name_of(own)
                if sid not in seen:
                    if len(seen) >= NAMES:
                        seen.clear()
                    seen.add(sid)
                    held.append(own)
                    size += len(own)
                rows.append((doc_id, text_hash, len(own), sid, check, finely(own), None))
            yield arrays(SURVEY, list(zip(*rows, strict=True)))
            if size > 2_000_000:
                yield often()
                size = 0
        yield often()

    return docs.mapInArrow(gives_back(run), SURVEY)


def keys(docs: DataFrame, words: int, threshold: float, heavy: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(key, salt, n, sid, early) for the first shingles of each set in the common order: light ones by hash, then heavy ones, the less frequent first.

    `early` marks the first n - ceil(2t/(1+t) n) + 1: of two linked sets, the smaller has a shared shingle there. A key of SALT_ROWS or more has
    salts from 1, others 0. A set's salt is one of two, by the key's last bit: the parts of a hot group overlap, and its sets have the same neighbours in
    the parts of half its keys.
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)  # at most HEAVY_MOST entries
    schema = "key long, salt int, n int, sid long, early boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, ranks, salts = shared.value
        seen: set[int] = set()
        for part in chunks(batches, most=SLICE):
            out = []
            for doc_id, own in zip(part["doc_id"], shingle_sets(part["text"], words), strict=True):
                if doc_id is None or not len(own):
                    continue
                sid, _ = name_of(own)
                if sid in seen:
                    continue
                if len(seen) >= NAMES:
                    seen.clear()
                seen.add(sid)
                n = len(own)
                take = n - int(np.ceil(threshold * n - 1e-9)) + 1
                chosen, salt = own[:take], np.zeros(take, dtype=np.int32)
                if len(often):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    is_heavy = often[at] == own
                    light = own[~is_heavy][:take]
                    at = at[is_heavy]
                    at = at[np.argsort(ranks[at], kind="stable")][: take - len(light)]
                    chosen = np.concatenate([light, often[at]])
                    own_salt = mix((often[at] & np.uint64(1)) ^ np.uint64(sid & 0xFFFFFFFFFFFFFFFF)) % salts[at] + np.uint64(1)
                    salt[len(light) :] = np.where(salts[at] > 1, own_salt, 0)
                early = np.arange(take) < n - int(np.ceil(2 * threshold / (1 + threshold) * n - 1e-9)) + 1
                out.append((chosen, salt, np.full(take, n, dtype=np.int32), np.full(take, sid), early))
            if out:
                k, *rest = (np.concatenate(c) for c in zip(*out, strict=True))
                yield arrays(schema, [k.view(np.int64), *rest])

    return docs.mapInArrow(gives_back(run), schema)


def buckets(threshold: float):
    """Of a partition's rows, sorted by (key, salt, n, sid), by kind: candidate pairs with the number of leaf buckets that they share (a is the smaller set),
    members (a, list b) of larger or salted buckets, and how many of a set's first shingles lie in such (large)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list = []
        large_of: list = []
        held = 0
        lists: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal pairs, large_of, held
            if pairs:
                a, b, na, nb, shared, early = (np.concatenate(c) for c in zip(*pairs, strict=True))
                order = np.lexsort((b, a))
                a, b, na, nb, shared, early = (x[order] for x in (a, b, na, nb, shared, early))
                at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                yield arrays(FOUND, [["pair"] * len(at), a[at], b[at], na[at], nb[at], np.add.reduceat(shared, at), np.logical_or.reduceat(early, at)])
            if large_of:
                own, n = np.unique(np.concatenate(large_of), return_counts=True)
                yield arrays(FOUND, [["large"] * len(own), own, None, None, None, n, None])
            pairs, large_of, held = [], [], 0

        for table, _ in whole_groups(batches, ["key", "salt"]):
            k, salt, n, sid, early = (table.column(x).to_numpy() for x in ("key", "salt", "n", "sid", "early"))
            again = np.concatenate([[False], (k[1:] == k[:-1]) & (salt[1:] == salt[:-1]) & (sid[1:] == sid[:-1])])  # one set from several tasks
            k, salt, n, sid, early = (x[~again] for x in (k, salt, n, sid, early))
            start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (salt[1:] != salt[:-1])]))
            size = np.diff(np.append(start, len(k)))
            keep = np.repeat((size > 1) | (salt[start] > 0), size)
            if not keep.any():
                continue
            k, salt, n, sid, early = (x[keep] for x in (k, salt, n, sid, early))
            start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (salt[1:] != salt[:-1])]))
            size = np.diff(np.append(start, len(k)))
            each = np.repeat(np.arange(len(start)), size)
            place = np.arange(len(k)) - start[each]
            big = (size > LEAF) | (salt[start] > 0)
            large = big[each]
            found = []
            for step in range(1, LEAF):  # all pairs of a leaf, neighbours by size in larger buckets
                i = np.flatnonzero((place >= step) & (~large if step > 1 else True))
                found.append((i - step, i))
            i = np.flatnonzero(large & (place > 0))
            found.append((start[each[i]], i))
            lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
            fit = n[lo] >= threshold * n[hi] - 1e-9
            lo, hi = lo[fit], hi[fit]
            first = early[lo] | (early[hi] & (n[lo] == n[hi]))
            # of two equal sizes, the smaller name comes first, by the sort
            pairs.append((sid[lo], sid[hi], n[lo], n[hi], (~large[lo]).astype(np.int32), first))
            held += len(lo)
            if large.any():
                large_of.append(sid[large])
                held += int(large.sum())
                # buckets of the same members are one list; the parts of a salted one come together under its key
                total = np.add.reduceat(mix(sid.view(np.uint64)), start, dtype=np.uint64)
                named = np.where(salt[start] > 0, k[start], mix(total + size.astype(np.uint64)).view(np.int64))
                new = np.array([bool(b) and (s > 0 or x not in lists) for b, s, x in zip(big, salt[start], named.tolist(), strict=True)])
                lists.update(named[new & (salt[start] == 0)].tolist())
                if len(lists) > NAMES:
                    lists = set()
                own = new[each]
                yield arrays(FOUND, [["member"] * int(own.sum()), sid[own], named[each[own]], n[own], None, None, None])
            if held > 500_000:
                yield from flush()
        yield from flush()

    return run


def check_fine(of: dict[int, bytes], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs' summed minima over the fine groups reach the overlap needed."""
    fine = {d: np.unique(groups_of(x), return_counts=True) for d, x in of.items()}
    n = {d: int(k.sum()) for d, (_, k) in fine.items()}
    row, last, out = np.zeros(1 << FINE_BITS, dtype=np.int64), None, np.zeros(len(a), dtype=bool)
    for i in np.argsort(a, kind="stable").tolist():
        x, y = int(a[i]), int(b[i])
        if x != last:
            row[:] = 0
            row[fine[x][0]] = fine[x][1]
            last = x
        groups, k = fine[y]
        out[i] = np.minimum(row[groups], k).sum() >= needed(n[x], n[y], threshold)
    return out


def check_texts(words: int):
    def check(of: dict[int, bytes], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Which pairs' full sets link."""
        sets: dict[int, np.ndarray] = {}
        held, size = [], 0
        for k, (d, raw) in enumerate(of.items(), 1):
            held.append((d, raw.decode()))
            size += len(raw)
            if size > 2_000_000 or k == len(of):
                sets.update(zip((x for x, _ in held), shingle_sets([x for _, x in held], words), strict=True))
                held, size = [], 0
        out = np.zeros(len(a), dtype=bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            out[i] = common and common >= threshold * (len(sets[x]) + len(sets[y]) - common) - 1e-9
        return out

    return check


def sieved(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key may be wanted: a bitmap of the wanted keys' hashes goes to all tasks, of at most 2^25 bits (fewer rows then move to a join)."""
    bits = min(25, max(16, int(np.ceil(np.log2(64 * wanted.count() + 1)))))
    slot = F.xxhash64(*on).bitwiseAND(F.lit((1 << bits) - 1))
    word, bit = F.shiftright(slot, 6).alias("__word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("__bit")
    words = wanted.select(word, bit).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    return rows.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(words), "__word").where("(shiftright(__bits, __bit) & 1L) = 1").drop("__word", "__bit", "__bits")


def in_cells(pairs: DataFrame, family: DataFrame, payload: DataFrame, most: int, threshold: float, check) -> DataFrame:
    """The pairs (a, b) that `check` keeps, given the payload (doc_id, text_hash, payload) of both.

    A payload travels once for each cell that it has pairs in, not once a pair: a family (node, f, n, doc_id, text_hash) of candidates that hang together is split into
    blocks of about `most` shingles and at most about PAIR_BLOCK sets, and a cell is a pair of blocks.
    """
    blocks = family.groupBy("f").agg(F.ceil(F.greatest(F.sum("n") / most, F.count("*") / PAIR_BLOCK)).cast("long").alias("blocks"))
    tasks = tasks_for(pairs.count())
    nodes = cut(family.join(blocks, "f").select("node", "f", F.pmod(F.xxhash64("node"), "blocks").alias("block")).coalesce(tasks))
    left, right = nodes.select(F.col("node").alias("a"), "f", F.col("block").alias("i")), nodes.select(F.col("node").alias("b"), F.col("block").alias("j"))
    cells = cut(pairs.join(left, "a").join(right, "b").select("f", "i", "j", "a", "b").coalesce(tasks))
    release(nodes)
    wanted = cells.select("f", "i", "j", F.explode(F.array("a", "b")).alias("sid")).distinct()
    own = ["doc_id", "text_hash"]  # rows that repeat them are the same
    held = sieved(payload, family, own).dropDuplicates(own)
    sent = wanted.join(family.select(F.col("node").alias("sid"), *own), "sid").join(held, own).select("f", "i", "j", F.col("sid").alias("a"), F.lit(None).cast("long").alias("b"), "payload")
    rows = sent.unionByName(cells.withColumn("payload", F.lit(None).cast("binary"))).repartition("f", "i", "j").sortWithinPartitions("f", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ["f", "i", "j"]):
            for x, y in zip(cuts, cuts[1:], strict=False):
                own = table.slice(x, y - x)
                pair = own.column("b").is_valid()
                of = own.filter(pc.invert(pair))
                own = own.filter(pair)
                a, b = own.column("a").to_numpy(), own.column("b").to_numpy()
                keep = check(dict(zip(of.column("a").to_pylist(), of.column("payload").to_pylist(), strict=True)), a, b, threshold)
                yield arrays("a long, b long", [a[keep], b[keep]])

    kept = cut(rows.mapInArrow(gives_back(run), "a long, b long"))
    release(cells)
    return kept


def verified(pairs: DataFrame, sets: DataFrame, fine: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets link: those that the fine counts leave are held against the texts."""
    pairs = cut(pairs.select("a", "b"))
    family = cut(components(pairs, "a", "b").join(sets, F.col("node") == F.col("sid")).select("node", F.col("component").alias("f"), "n", "doc_id", "text_hash"))
    # the set's first document stands for it
    close = in_cells(pairs, family, fine.select("doc_id", "text_hash", "payload"), FINE_BLOCK, threshold, check_fine)
    left = cut(family.join(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"))
    whole = texts.select("doc_id", "text_hash", F.col("text").cast("binary").alias("payload"))
    linked = in_cells(close, left, whole, TEXT_BLOCK, threshold, check_texts(words))
    release(pairs, family, close, left)
    return linked


class CountTree:
    """A packed tree over points: leaves of LEAF neighbours by size and shape, inner nodes of FANOUT children; a node has its coordinates' maxima and its range of sizes."""

    def __init__(self, points: np.ndarray, n: np.ndarray):
        widest = points.std(axis=0).argsort()[::-1][:2] if len(points) else [0, 0]
        size = np.floor(np.log2(np.maximum(n, 1)) * 4)
        self.order = np.lexsort((points[:, widest[1]], points[:, widest[0]], size))
        self.points, self.n = points[self.order], n[self.order]
        #: (maxima, least size, most size) of each level's nodes, the leaves first
        self.levels = []
        high, low_n, high_n, each = self.points, self.n, self.n, LEAF
        while len(high) > 1 or not self.levels:
            at = np.arange(0, len(high), each)
            high, low_n, high_n = np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(low_n, at), np.maximum.reduceat(high_n, at)
            self.levels.append((high, low_n, high_n))
            each = FANOUT

    def search(self, point: np.ndarray, n: int, threshold: float) -> np.ndarray:
        """Indexes of the points whose bound with this one reaches the overlap needed."""
        open_nodes = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            high, low_n, high_n = (x[open_nodes] for x in self.levels[k])
            near = (high_n >= threshold * n - 1e-9) & (threshold * low_n <= n + 1e-9)
            near[near] = np.minimum(high[near], point).sum(axis=1) >= needed(np.maximum(low_n[near], np.ceil(threshold * n - 1e-9)), n, threshold)
            each, below = (FANOUT, len(self.levels[k - 1][0])) if k else (LEAF, len(self.points))
            open_nodes = (open_nodes[near][:, None] * each + np.arange(each)).reshape(-1)
            open_nodes = open_nodes[open_nodes < below]
        own = open_nodes[np.minimum(self.points[open_nodes], point).sum(axis=1) >= needed(self.n[open_nodes], n, threshold)]
        return self.order[own]


def viable(threshold: float):
    """Of lists of at most BLOCK members, those that may link across components by their sizes and first shingles in larger buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ["list"]):
            n, large, c = (table.column(x).to_numpy() for x in ("n", "large", "c"))
            keep = np.zeros(len(n), dtype=bool)
            for x, y in zip(cuts, cuts[1:], strict=False):
                a, l, o = n[x:y, None].astype(float), large[x:y, None], c[x:y, None]
                fit = (o != o.T) & (np.minimum(a, a.T) >= threshold * np.maximum(a, a.T) - 1e-9) & (np.minimum(l, l.T) >= shared_least(a, a.T, threshold))
                keep[x:y] = fit.any(axis=1)
            yield from table.filter(pa.array(keep)).to_batches()

    return run


def standing(members: DataFrame, labels: DataFrame, large: DataFrame) -> DataFrame:
    """(list, sid, n, large, c) of the members, with their components."""
    return cut(members.join(large, "sid").join(labels, members["sid"] == labels["node"], "left").select("list", "sid", "n", "large", F.coalesce("component", "sid").alias("c")))


def across(known: DataFrame, fine: DataFrame, sets: DataFrame, threshold: float, first: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a list and pass the bound: outsiders of each list against the trees of all its members.

    In the `first` search, an outsider with more than PARTNERS partners in a cell gives only the best one of each component, and a row names the
    list, which is to be searched again. Pairs that share a leaf bucket are settled before; the others share at most as many first shingles as
    either has in larger buckets.
    """
    mixed = known.groupBy("list").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("list", "size")
    open_lists = known.join(mixed, "list")
    schema = "list long, sid long, n int, large long, c long, size long"
    small = open_lists.where(F.col("size") <= BLOCK).select(*(x.split()[0] for x in schema.split(", "))).repartition("list").sortWithinPartitions("list").mapInArrow(viable(threshold), schema)
    left_in = cut(small.unionByName(open_lists.where(F.col("size") > BLOCK).select(*small.columns)))
    counted = left_in.groupBy("list", "c").agg(F.count("*").alias("k"))
    largest = counted.groupBy("list").agg(F.sum("k").alias("size"), F.max(F.struct("k", "c")).alias("top"))
    largest = largest.select("list", F.col("top.c").alias("main"), F.ceil(F.col("size") / BLOCK).cast("int").alias("rights"), F.ceil((F.col("size") - F.col("top.k")) / BLOCK).cast("int").alias("lefts"))
    own = ["sid", "doc_id", "text_hash"]
    wanted = cut(left_in.select("sid").distinct().join(sets, "sid").select("n", *own))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, n, raw = (c.to_pylist() for c in batch.columns)
            yield arrays("sid long, payload binary", [sid, [packed(x, k) for x, k in zip(raw, n, strict=True)]])

    payload = sieved(fine, wanted, own).join(wanted, own).dropDuplicates(["sid"]).select("sid", "n", "payload").mapInArrow(pack, "sid long, payload binary")
    rows = left_in.join(largest, "list").join(payload, "sid")
    turn = lambda blocks: F.pmod(F.xxhash64("sid"), blocks).cast("int")
    asking = rows.where("c <> main").withColumn("l", turn(F.col("lefts"))).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))).withColumn("asks", F.lit(True))
    holding = rows.withColumn("r", turn(F.col("rights"))).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn("asks", F.lit(False))
    use = ["list", "l", "r", "asks", "sid", "c", "outside", "n", "payload"]
    both = asking.unionByName(holding).withColumn("outside", F.col("c") != F.col("main")).select(*use).repartition("list", "l", "r").sortWithinPartitions("list", "l", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # a pair meets in many lists; a task gives it once, or once in a while
        for table, cuts in whole_groups(batches, ["list", "l", "r"]):
            found: set[tuple[int, int]] = set()
            crowded: set[int] = set()
            for x, y in zip(cuts, cuts[1:], strict=False):
                part = table.slice(x, y - x)
                asks, ids, c, outside, n = (part.column(k).to_numpy() for k in ("asks", "sid", "c", "outside", "n"))
                if asks.all() or not asks.any():
                    continue
                bits = bits_of(n)
                points = [unpacked(raw, g) for raw, g in zip(part.column("payload").to_pylist(), bits.tolist(), strict=True)]
                for g in np.unique(bits).tolist():
                    # points of this many groups among themselves, and with those of twice as many
                    held, asking = (np.flatnonzero(w & ((bits == g) | (bits == g + 1))) for w in (~asks, asks))
                    if not len(held) or not len(asking):
                        continue
                    at = lambda i, g=g, bits=bits, points=points: points[i] if bits[i] == g else points[i].reshape(-1, 2).sum(axis=1, dtype=np.int32)
                    matrix = np.stack([at(i) for i in held.tolist()])
                    tree = CountTree(matrix, n[held])
                    for i in asking.tolist():
                        own = tree.search(at(i), int(n[i]), threshold)
                        hit = held[own]
                        fit = (c[hit] != c[i]) & (~outside[hit] | (ids[hit] > ids[i])) & ((bits[i] == g) | (bits[hit] == g))
                        hit, own = hit[fit], own[fit]
                        if first and len(hit) > PARTNERS:
                            crowded.add(part.column("list")[0].as_py())
                            common = np.minimum(matrix[own], at(i)).sum(axis=1)
                            hit = hit[np.argsort(-common / (n[hit] + n[i] - common), kind="stable")]
                            hit = hit[np.unique(c[hit], return_index=True)[1]]
                        d = int(ids[i])
                        found.update((min(d, o), max(d, o)) for o in ids[hit].tolist())
            found -= seen
            if len(seen) + len(found) > NAMES:
                seen = set()
            seen |= found
            yield arrays(crossing, [*([p[k] for p in found] for k in range(2)), None])
            yield arrays(crossing, [None, None, list(crowded)])

    crossing = "a long, b long, list long"
    out = cut(both.mapInArrow(gives_back(run), crossing).distinct())
    release(left_in, wanted)
    return out


def likely(pairs: DataFrame, large: DataFrame, threshold: float) -> DataFrame:
    """The pairs that share enough of their first shingles: those of leaf buckets are counted, and larger buckets hold at most `large` of either set."""
    need = least_shared(F.least("na", "nb"), F.greatest("na", "nb"), threshold)
    side = lambda s: large.select(F.col("sid").alias(s), F.col("large").alias(f"large_{s}"))
    summed = pairs.groupBy("a", "b").agg(F.min("na").alias("na"), F.min("nb").alias("nb"), F.sum("shared").alias("shared"), F.max("early").alias("early"))
    both = summed.join(side("a"), "a", "left").join(side("b"), "b", "left")
    common = F.least(F.coalesce("large_a", F.lit(0)), F.coalesce("large_b", F.lit(0)))
    return both.where((F.col("early") | (common > 0)) & (F.col("shared") + common >= need)).select("a", "b")


def heavy_shingles(surveyed: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent shingles, rising, their ranks by frequency and their numbers of salts."""
    counted = surveyed.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_TOTAL)
    often = counted.orderBy(F.col("n").desc(), "shingle").limit(HEAVY_MOST).toArrow()
    values, n = often.column("shingle").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(values)
    return values[order], np.log2(n[order]).astype(np.int8), (n[order] // SALT_ROWS + 1).astype(np.uint64)


def link(docs: DataFrame, words: int = 5, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash: Spark's xxhash64 of the text) for every row of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    surveyed = cut(survey(texts, words))
    rows = surveyed.where("shingle IS NULL").select("doc_id", "text_hash", "n", "sid")
    named = surveyed.where("shingle IS NULL AND doc_id IS NOT NULL AND n > 0")
    own = named.groupBy("sid").agg(F.min("n").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi"), F.min(F.struct("doc_id", "text_hash")).alias("of"))
    sets = cut(own.select("sid", "n", "of.doc_id", "of.text_hash", (F.col("lo") != F.col("hi")).alias("clash")))
    if sets.where("clash").limit(1).count():
        raise RuntimeError("two sets of shingles have one name")
    fine = named.select("sid", "doc_id", "text_hash", F.col("fine").alias("payload"))
    placed = keys(texts, words, threshold, heavy_shingles(surveyed)).repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "sid")
    found = cut(placed.mapInArrow(gives_back(buckets(threshold)), FOUND))
    large = cut(found.where("kind = 'large'").groupBy(F.col("a").alias("sid")).agg(F.sum("shared").alias("large")))
    members = found.where("kind = 'member'").select(F.col("b").alias("list"), F.col("a").alias("sid"), F.col("na").alias("n")).distinct()
    links = verified(likely(found.where("kind = 'pair'"), large, threshold), sets, fine, texts, words, threshold)
    labels = components(links, "a", "b")
    known = standing(members, labels, large)
    between = across(known, fine, sets, threshold, True)
    links = links.unionByName(verified(between.where("list IS NULL"), sets, fine, texts, words, threshold))
    labels = components(links, "a", "b")
    release(known)
    crowded = between.where("list IS NOT NULL").select("list")
    if crowded.limit(1).count():
        known = standing(members.join(crowded, "list", "left_semi"), labels, large)
        rest = across(known, fine, sets, threshold, False)
        more = verified(rest, sets, fine, texts, words, threshold)
        if more.limit(1).count():
            labels = components(links.unionByName(more), "a", "b")
        release(known, rest, more)
    release(found, large, between)
    whole = sets.join(labels, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("component", "sid").alias("c"), F.col("doc_id").alias("least"))
    first = whole.groupBy("c").agg(F.min("least").alias("component_id"))
    of_set = whole.join(first, "c").select("sid", "component_id")
    linked = rows.where("doc_id IS NOT NULL AND n > 0").join(of_set, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_hash")
    alone = rows.where("doc_id IS NULL OR n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash")
    return linked.unionByName(alone)
