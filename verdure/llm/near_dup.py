"""MinHash near-duplicate components with odd-sketch candidate verification.

A document's set holds its distinct word shingles (``textnum.shingles``).
Documents are linked when ``100 * intersection >= percent * union``; the
result is the connected component of every document.

1. Every text becomes, in Arrow batches, a set key and ``BANDS * ROWS`` MinHash
   samples folded into band keys.
2. Equal sets collapse into one class, a node of its own number, so a group of
   thousands of copies costs one row from here on.
3. Classes that share a band key are candidates.  They alone get an odd sketch
   of ``SAMPLES`` MinHash samples: each (slot, sample) pair toggles one bit, so
   the population count of the XOR of two sketches estimates how many samples
   differ and thereby the similarity, precisely where it is high.
4. Hub rounds: each class is held against one hub of its buckets at most, first
   the bucket's smallest class, then a member of the bucket's largest component,
   another one each round.  Candidates whose sizes rule a link out, or whose
   sketches differ by five deviations more than expected at the threshold, are
   dismissed; others are confirmed on the full sets.  Verified links are joined
   into components.  A round that joins an eighth of the classes outside their
   bucket's largest component is followed by another one.
5. What hub rounds leave is settled exactly.  In every bucket that spans several
   components, the classes outside the largest one are compared by sketch with
   all members, in blocks of bounded size; no pair leaves a block, only a
   spanning forest of the candidates.  The forest's trees are clusters that hold
   every candidate pair.  Then each class's set moves to its cluster (to as many
   blocks as the weight of the classes outside the cluster's largest component
   asks for), where intersections are counted through an index of the block's
   shingles and the links that join components come out.

Components are found by distributed minimum-label propagation with hooking of
roots and pointer jumping, in rounds until no label moves.  Every round is
written to the shared checkpoint folder.

Edge cases: a null or empty text, or one without words, has an empty set and
is linked with nothing, whatever its id.  Rows without an id take no part:
their component is null and they are kept.  Repeated rows share a set and so a
component; an id that stands at several rows links all their sets.  An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure.llm import common, textnum

BANDS, ROWS, SAMPLES, SKETCH_WORDS = 40, 5, 1024, 32
BLOCK, WEIGHT = 4096, 1 << 20  # classes of a block of sketches, shingles of a block of sets
_seeds = np.random.default_rng(7)
_MUL = (_seeds.integers(1, 2**32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _seeds.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_SLOT = textnum.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))


def samples(shingles: np.ndarray, n: int) -> np.ndarray:
    """One minimum for each of n hash functions over the whole set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    least, step = np.full(n, 2**32 - 1, np.uint32), max(64, 131_072 // n)
    for at in range(0, x.shape[1], step):
        part = _MUL[:n] * x[:, at : at + step]
        part += _ADD[:n]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_keys(shingles: np.ndarray) -> np.ndarray:
    least = samples(shingles, BANDS * ROWS).astype(np.uint64) ^ _SLOT[: BANDS * ROWS]
    return textnum.windows(least, ROWS)[::ROWS].view(np.int64)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the (slot, sample) pairs that fall on each bit."""
    bits = 64 * SKETCH_WORDS
    spots = textnum.mix(samples(shingles, SAMPLES).astype(np.uint64) ^ _SLOT) % np.uint64(bits)
    odd = (np.bincount(spots.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def largest_difference(percent: int) -> int:
    """Bits by which sketches of linked sets differ at most: five deviations over the mean at the threshold."""
    k, n, j = SAMPLES, 64 * SKETCH_WORDS, percent / 100
    delta = 2 * k * (1 - j)
    mean = n / 2 * (1 - (1 - 2 / n) ** delta)
    toggles = n * (n - 1) / 4 * (1 - 4 / n) ** delta + n / 4 - n * n / 4 * (1 - 2 / n) ** (2 * delta)
    spread = math.sqrt(4 * k * j * (1 - j) * (1 - 2 / n) ** (2 * delta) + max(0.0, toggles))
    return min(n, math.ceil(mean + 5 * spread))


def _sign(k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        schema = pa.schema([("id", pa.int64()), ("own", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.string()), ("bands", pa.list_(pa.int64()))])

        def rows():
            for part in parts:
                for i, own, text in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    found = textnum.shingles(text.encode("utf-8", "replace"), k)
                    if len(found):
                        key = hashlib.md5(found.tobytes(), usedforsecurity=False).hexdigest()
                        yield {"id": i, "own": own, "n_shingles": len(found), "set_key": key, "bands": band_keys(found)}
                    else:
                        yield {"id": i, "own": own, "n_shingles": 0, "set_key": None, "bands": None}

        yield from common.batches(schema, rows(), 8 << 20, lambda _: 400)

    return run


def _sketch(k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64())), ("set", pa.binary())])

        def rows():
            for part in parts:
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = textnum.shingles(text.encode("utf-8", "replace"), k)
                    yield {"id": i, "n": len(found), "sketch": odd_sketch(found), "set": found.tobytes()}

        yield from common.batches(schema, rows(), 8 << 20, lambda r: 300 + len(r["set"]))

    return run


def _linked(both: np.ndarray, x: int, y: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (x + y - both)


def _verify(percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple[int, int]] = []
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            for n, (i, j) in enumerate(zip(a, b, strict=True)):
                p, q = (np.frombuffer(part.column(c)[n].as_buffer(), np.uint64) for c in (2, 3))
                both = len(np.intersect1d(p, q, assume_unique=True))
                if _linked(both, len(p), len(q), percent):
                    out.append((i, j))
            yield _edges(out)

    return run


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([j for _, j in out], pa.int64())], names=["a", "b"])


def _by_place(act):
    """Applies act(table) to every place; its rows arrive whole and in order."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole():
            t, held[:] = pa.Table.from_batches(held), []
            return _edges(act(t)) if len(t) > 1 else _edges([])

        for batch in parts:
            key = batch.column("place").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if held and i < j and held[0].column("place")[0].as_py() != key[i]:
                    yield whole()
                if i < j:
                    held.append(batch.slice(i, j - i))
        if held:
            yield whole()

    return run


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows to hold against each other: all, or those of the first block against those of the second."""
    side = t.column("side").to_numpy()
    return (np.arange(len(t)),) * 2 if t.column("same")[0].as_py() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))


def _join(root: np.ndarray, x: int, near: np.ndarray, ids: np.ndarray, out: list[tuple[int, int]]) -> None:
    """Puts the roots of near under that of x, one edge for each root that differs."""
    roots, first = np.unique(root[near], return_index=True)
    for r, y in zip(roots.tolist(), near[first].tolist(), strict=True):
        if r != root[x]:
            out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
            root[root == r] = root[x]


def candidate_forest(most: int, percent: int):
    """A spanning forest of the pairs of different components that pass the sizes and sketches."""

    def act(t: pa.Table) -> list[tuple[int, int]]:
        ids, labels, sizes = (t.column(n).to_numpy() for n in ("id", "label", "n"))
        sketches = t.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_WORDS)  # bitwise_count takes the absolute value of signed numbers
        left, right = _sides(t)
        root, out = np.arange(len(ids)), []
        for at in range(0, len(left), 128):
            own = left[at : at + 128]
            x, y = sizes[own][:, None], sizes[right][None, :]
            ok = (labels[own][:, None] != labels[right][None, :]) & (root[own][:, None] != root[right][None, :]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
            i, j = np.nonzero(ok)
            bits = np.zeros(len(i), np.int64)
            for cut in range(0, len(i), 16_384):
                part = slice(cut, cut + 16_384)
                bits[part] = np.bitwise_count(sketches[own[i[part]]] ^ sketches[right[j[part]]]).sum(1)
            i, j = i[bits <= most], j[bits <= most]
            for p in np.unique(i).tolist():
                _join(root, int(own[p]), right[j[i == p]], ids, out)
        return out

    return act


def exact_links(percent: int):
    """Links that join components: every pair of different ones is counted exactly, unless other links join them first."""

    def act(t: pa.Table) -> list[tuple[int, int]]:
        ids = t.column("id").to_numpy()
        root = np.unique(t.column("label").to_numpy(), return_inverse=True)[1].copy()
        column = t.column("set").combine_chunks()
        flat = np.frombuffer(column.buffers()[2], np.uint64) if column.offset == 0 else np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in column])
        sizes = pc.binary_length(column).to_numpy() // 8
        flat = flat[: int(sizes.sum())]
        begin = np.cumsum(sizes) - sizes
        which = np.unique(flat, return_inverse=True)[1]
        times = np.bincount(which)
        holder = np.repeat(np.arange(len(ids)), sizes)[np.argsort(which, kind="stable")]
        first = np.cumsum(times) - times
        left, right = _sides(t)
        out: list[tuple[int, int]] = []

        def hold(x: int, others: np.ndarray) -> None:
            others = others[root[others] != root[x]]
            if not len(others):
                return
            own = which[begin[x] : begin[x] + sizes[x]]
            n = times[own]
            spots = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            both = np.bincount(holder[spots], minlength=len(ids))[others]
            near = others[_linked(both, int(sizes[x]), sizes[others], percent)]
            if len(near):
                _join(root, x, near, ids, out)

        for y in right[:: max(1, len(right) // 8)].tolist():  # some hubs first, which spare most of the rest
            hold(y, left)
        for x in left.tolist():
            hold(x, right)
        return out

    return act


def components(spark: SparkSession, edges: DataFrame, at: str) -> DataFrame:
    """(id, label): the smallest id reachable from each end of the edges (a, b)."""
    both = common.table(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{at}/edges")
    labels = common.table(spark, both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label"), F.lit(True).alias("moved")), f"{at}/0")
    n, moved = 0, True
    while moved:  # labels only fall, so this ends; when none moves, both ends of every edge agree
        n += 1
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        # the smaller label goes to the node and to the root of the label that it replaces
        sent = step.union(step.where("mid < old").select(F.col("old").alias("id"), F.lit(None).cast("long").alias("old"), "mid"))
        step = sent.groupBy("id").agg(F.max("old").alias("old"), F.min("mid").alias("mid"))
        jump = step.join(labels.select(F.col("id").alias("mid"), F.col("label").alias("far")), "mid")
        labels = common.table(spark, jump.select("id", F.col("far").alias("label"), (F.col("far") < F.col("old")).alias("moved")), f"{at}/{n}")
        moved = not labels.where("moved").isEmpty()
        common.remove(spark, f"{at}/{n - 1}")
    return labels.select("id", "label")


def _places(rows: DataFrame, group: str, few: Column, many: Column) -> DataFrame:
    """Deals the rows of each group to blocks: the ``odd`` ones (outside the group's largest component) meet each other and all the rest.

    few, many: the numbers of blocks of the odd rows and of the others.
    """
    hashed = F.xxhash64("id")
    block = F.pmod(hashed, F.when(F.col("odd"), few).otherwise(many)).cast("int")
    rows = rows.withColumns({"few": few, "many": many, "block": block})
    up = lambda n: F.sequence(F.lit(0), n - 1)
    among = F.transform(up(F.col("few")), lambda j: F.struct(F.xxhash64(group, F.lit(0), F.least("block", j), F.greatest("block", j)).alias("place"), (F.col("block") > j).cast("int").alias("side"), (F.col("block") == j).alias("same")))
    down = F.transform(up(F.col("many")), lambda j: F.struct(F.xxhash64(group, F.lit(1), "block", j).alias("place"), F.lit(0).alias("side"), F.lit(False).alias("same")))
    against = F.transform(up(F.col("few")), lambda j: F.struct(F.xxhash64(group, F.lit(1), j, "block").alias("place"), F.lit(1).alias("side"), F.lit(False).alias("same")))
    return rows.withColumn("to", F.explode(F.when(F.col("odd"), F.concat(among, down)).otherwise(against))).select("to.place", "to.side", "to.same", *(c for c in rows.columns if c not in ("few", "many", "block", "odd", group)))


def _dealt(rows: DataFrame, act) -> DataFrame:
    return rows.repartition("place").sortWithinPartitions("place").mapInArrow(common.lean(_by_place(act)), "a long, b long")


class _Search:
    """The links between the classes of one table; every intermediate table is below ``at``."""

    def __init__(self, spark: SparkSession, at: str, k: int, percent: int):
        self.spark, self.at, self.k, self.percent, self.most = spark, at, k, percent, largest_difference(percent)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return common.table(self.spark, df, f"{self.at}/{name}")

    def drop(self, *names: str) -> None:
        for n in names:
            common.remove(self.spark, f"{self.at}/{n}")

    def passing(self, pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and sketches do not rule out."""
        x, y = (self.sets.select(F.col("id").alias(n), F.col("n").alias(f"{n}_n"), F.col("sketch").alias(f"{n}_s")) for n in "ab")
        differ = sum((F.bit_count(F.col("a_s")[i].bitwiseXOR(F.col("b_s")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
        both = pairs.join(y, "b").join(x, "a").where(100 * F.least("a_n", "b_n") >= self.percent * F.greatest("a_n", "b_n"))
        return both.where(differ <= self.most).select("a", "b")

    def confirmed(self, pairs: DataFrame, n: int) -> DataFrame:
        pairs = self.table(self.passing(pairs), f"pairs{n}")
        x, y = (self.sets.select(F.col("id").alias(i), F.col("set").alias(f"{i}_t")) for i in "ab")
        both = pairs.join(y, "b").join(x, "a").select("a", "b", "a_t", "b_t")
        links = self.table(both.mapInArrow(common.lean(_verify(self.percent)), "a long, b long"), f"links{n}")
        self.drop(f"pairs{n}")
        return links

    def opened(self, members: DataFrame, labels: DataFrame, n: int) -> DataFrame:
        """The members of buckets that span several components: their labels, whether they are outside the largest one, a hub in it, and the sizes of both parts."""
        own = members.join(labels, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))
        per = own.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", F.lit(n)).alias("h"), "id")).alias("hub"))
        top = per.groupBy("bucket").agg(F.max(F.struct("n", "label", "hub.id")).alias("top"), F.sum("n").alias("size"), F.count("*").alias("parts")).where("parts > 1")
        top = top.select("bucket", F.col("top.label").alias("main"), F.col("top.id").alias("hub"), F.col("top.n").alias("rest"), (F.col("size") - F.col("top.n")).alias("outside"))
        top = self.table(top, f"top{n}")  # the join then reads plain shuffles, which adaptive execution can split at a hot bucket
        out = self.table(own.join(top, "bucket").withColumn("odd", F.col("label") != F.col("main")).drop("main"), f"open{n}")
        self.drop(f"top{n}")
        return out

    def hub_pairs(self, odd: DataFrame) -> DataFrame:
        """Each class with the hub of most of its buckets."""
        shared = odd.groupBy("id", "hub").agg(F.count("*").alias("bands"))
        best = shared.groupBy("id").agg(F.max(F.struct("bands", (-F.col("hub")).alias("hub"))).alias("best")).select("id", (-F.col("best.hub")).alias("hub"))
        return best.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))

    def rest(self, opened: DataFrame, labels: DataFrame) -> DataFrame:
        """All links between different components of open buckets, as far as they join components."""
        rows = opened.join(self.sets.select("id", "n", "sketch"), "id").select("bucket", "id", "label", "n", "sketch", "odd", "rest", "outside")
        blocks = lambda c, size: F.ceil(F.col(c) / size).cast("int")
        dealt = _places(rows, "bucket", blocks("outside", BLOCK), blocks("rest", BLOCK)).drop("rest", "outside")
        forest = self.table(_dealt(dealt, candidate_forest(self.most, self.percent)), "forest")
        if forest.isEmpty():
            return forest
        trees = components(self.spark, forest, f"{self.at}/trees")
        own = trees.withColumnRenamed("label", "tree").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")).join(self.sets.select("id", "n"), "id")
        own = self.table(own, "clusters")
        per = own.groupBy("tree", "label").agg(F.sum("n").alias("n"))
        top = per.groupBy("tree").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
        top = self.table(top.select("tree", F.col("top.label").alias("main"), F.col("top.n").alias("rest"), (F.col("all") - F.col("top.n")).alias("outside")), "treetops")
        rows = own.drop("n").join(top, "tree").withColumn("odd", F.col("label") != F.col("main")).drop("main").where("outside > 0")
        dealt = _places(rows.join(self.sets.select("id", "set"), "id"), "tree", blocks("outside", WEIGHT), blocks("rest", WEIGHT)).drop("rest", "outside")
        return self.table(_dealt(dealt, exact_links(self.percent)), "links")

    def labels(self, reps: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
        """(id, label) of the classes that are linked. reps: (id, bands); texts: (id, text) of given ids; known: links from elsewhere."""
        bands = reps.select("id", F.posexplode("bands").alias("band", "value")).select("id", F.xxhash64("band", "value").alias("bucket"))
        buckets = self.table(bands.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1").drop("size"), "buckets")
        members = self.table(bands.join(buckets, "bucket").select("bucket", "hub", "id"), "members")
        # the full texts move once, and only those of candidates
        candidates = self.table(members.select("id").distinct(), "candidates")
        self.sets = self.table(texts(candidates).mapInArrow(common.lean(_sketch(self.k)), "id long, n long, sketch array<long>, set binary"), "sets")
        n, links = 0, known.union(self.confirmed(self.hub_pairs(members.where("id <> hub")), 0))
        labels = components(self.spark, links, f"{self.at}/cc0")
        while True:
            n += 1
            opened = self.opened(members, labels, n)
            odd = opened.where("odd").select("id").distinct().count()
            if not odd:
                break
            found = self.confirmed(self.hub_pairs(opened.where("odd")), n)
            joined = found.count()
            if joined:
                links = links.union(found)
                labels = components(self.spark, links, f"{self.at}/cc{n}")
            if 8 * joined < odd:
                found = self.rest(self.opened(opened.select("bucket", "id"), labels, n + 1), labels)
                if not found.isEmpty():
                    labels = components(self.spark, links.union(found), f"{self.at}/cc{n + 1}")
                break
            members = opened.select("bucket", "id")
        return labels


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame, str]:
    """The signed rows (id, own, n_shingles, set_key), and per set key the component's first row (component, winner)."""
    spark = docs.sparkSession
    at = common.shared_dir(spark, "near-dup")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text")).select("id", F.xxhash64("text").alias("own"), "text")
    signed = common.table(spark, plain.mapInArrow(common.lean(_sign(k)), "id long, own long, n_shingles long, set_key string, bands array<long>"), f"{at}/signed")
    full = signed.where("set_key is not null and id is not null")
    classes = full.groupBy("set_key").agg(F.min(F.struct("id", "own")).alias("first"))
    # numbers of rows as they are written: nodes stay apart where one id has several sets
    classes = common.table(spark, classes.select("set_key", F.col("first.id").alias("rep"), F.col("first.own").alias("rep_own"), F.monotonically_increasing_id().alias("node")), f"{at}/classes")
    reps = full.join(classes, "set_key").where("id = rep and own = rep_own").select(F.col("node").alias("id"), "bands").dropDuplicates(["id"])
    reps = common.table(spark, reps, f"{at}/reps")

    def texts(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids.withColumnRenamed("id", "node"), "node").select("node", F.col("rep").alias("id"), F.col("rep_own").alias("own"))
        return plain.join(wanted, ["id", "own"]).dropDuplicates(["id", "own"]).select(F.col("node").alias("id"), "text")

    known = spark.createDataFrame([], "a long, b long")
    if by_id:  # the sets of an id that stands at several rows
        several = full.groupBy("id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x < y").select("id")
        nodes = full.select("id", "set_key").join(several, "id").join(classes.select("set_key", "node"), "set_key").select("id", "node").distinct()
        nodes = common.table(spark, nodes, f"{at}/several")
        known = nodes.join(nodes.groupBy("id").agg(F.min("node").alias("a")), "id").where("a < node").select("a", F.col("node").alias("b"))
    labels = _Search(spark, f"{at}/search", k, percent).labels(reps, texts, known)
    linked = labels.join(classes.select(F.col("node").alias("id"), "rep", "rep_own"), "id")
    least = linked.groupBy("label").agg(F.min(F.struct("rep", "rep_own")).alias("least"))
    linked = linked.join(least, "label").select(F.col("id").alias("node"), "least")
    named = classes.join(linked, "node", "left").select("set_key", F.coalesce("least.rep", "rep").alias("component"), F.coalesce("least.rep_own", "rep_own").alias("winner"))
    named = common.table(spark, named, f"{at}/named")
    for x in ("search", "several", "reps", "classes"):
        common.remove(spark, f"{at}/{x}")
    return signed.select("id", "own", "n_shingles", "set_key"), named, at


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept."""
    signed, named, _ = _classes(docs, id_col, text_col, k, percent, by_id=True)
    out = signed.join(named, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Of each component of texts the row with the smallest id (then hash of its text), with all its columns.

    Here an id is a name only: of an id with two texts that are not alike, both
    stay.  Rows without an id stay, and so do texts without words; of rows with
    the same id and text, one stays.
    """
    signed, named, _ = _classes(docs, id_col, text_col, k, percent, by_id=False)
    rows = signed.where("id is not null").join(named, "set_key", "left")
    first = rows.where("set_key is null or (id = component and own = winner)").select(F.col("id").alias("__id"), F.col("own").alias("__own")).distinct()
    rows = docs.where(F.col(id_col).isNotNull()).withColumns({"__id": F.col(id_col).cast("long"), "__own": F.xxhash64(common.text_of(text_col))})
    one = rows.join(first, ["__id", "__own"], "left_semi").dropDuplicates(["__id", "__own"]).drop("__id", "__own")
    return one.unionByName(docs.where(F.col(id_col).isNull()))
