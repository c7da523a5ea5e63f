"""Near duplicates by a chosen-path similarity join on word shingles, and their connected components.

Documents with the same shingle set become one representative. Independent trees branch the representatives by
minwise tokens: the root of a tree takes BRANCHES coordinates of the signature, and a node goes on with
BRANCHES more, picked by its path, for as long as it holds more than SMALL documents, DEPTH levels at most. Documents
of a small node are compared exhaustively by their sketches. Documents of a large root first meet the root's hub, the
document that most others in its block of bounded size resemble, and what is confirmed joins most of thousands of near
copies. A large node branches on if a branch leaves less than 1 / (2 * BRANCHES) of its pairs together, so that each level makes
fewer rows than the one before. Branching can't part documents that are more alike, such as near copies, or pages of one template that are
not quite similar enough. Where such a node, or one that is still large at the last level, is of one component already, no pair in it can
change the result. Where all but SMALL of its documents are, it is compared exhaustively: it is dealt into blocks, and the
few others meet every block. Of the rest, all documents are joined by the prefix filter on their full shingle sets, rare
shingles first, so that any two that are similar enough share a shingle of their prefixes and are compared there.

A sketch has a byte for each of BINS ranges of the hash: of the smallest hash there, or 0. Equal bytes among the ranges
that either set reaches estimate the similarity; pairs more than 3.5 standard deviations under 0.8 are not confirmed.

Nodes don't emit all their pairs. After the hubs, in the first tree and again in
all trees, the hubs of each neighbourhood meet the documents that resemble them, of every other component the one most
like; then come all pairs that are left in small nodes, each in the first node that both its documents are in, then those in blocks, and last those
of the prefix join. In each round the pairs are confirmed on the full shingle sets of the texts, and only pairs from different components are looked at in
the next. A pair whose ends are already joined by confirmed links can't change the result.

A pair of similarity 0.8 meets in a node of a tree with probability 0.93 or more, in one of TREES with 0.99997; in a small
node, in a node that is compared at once and in the prefix join, every pair that meets is compared.

Nothing of this is gathered on the driver; every loop cuts its lineage with a checkpoint.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; with fewer words than
a shingle takes the whole sequence is the only shingle; a null id is linked with nothing and has a null component;
rows that repeat an id are one document; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspan.llm.common import LOWER, UPPER, by_batch, durable, release

TREES, BRANCHES, DEPTH, SMALL, BLOCK = 4, 2, 3, 64, 256
#: Coordinates of a signature; the first TREES * BRANCHES are for the roots.
COORDS = 48
#: Bytes of a sketch, and how many standard deviations under the wanted similarity a pair may seem.
BINS, DEVIATIONS = 384, 3.5
HUBS = 1
#: Pairs of one hub that are confirmed in one place; a hub with more has as many places as that takes.
MEMBERS = 64
#: Documents of one shingle that the prefix join compares in one place; more are dealt into pairs of blocks of this size.
TILE = 1024
#: Ids up to this number are broadcast to filter the texts (some MB), more are joined.
BROADCAST_IDS = 200_000
#: Buckets in which the prefix join counts shingles (2 MB on the driver, at any size of the data), and how many are summed in one place.
#: Any one order of the shingles is right; with large data, buckets still tell the very common ones, which matter.
BUCKETS, PART = 2**18, 2**12
#: Links up to this number are joined to components in one task (some 10 MB).
FEW_EDGES = 100_000

_AS_PY = methodcaller("as_py")
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MIX = np.random.default_rng(20240229)
_A = _MIX.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _MIX.integers(0, 2**63, COORDS, dtype=np.uint64)


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word):
        import xxhash

        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    if not text:
        return np.empty(0, np.uint64)
    found = text.encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, n)
    width = min(n, words)
    out = np.full(n - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    best = np.full(COORDS, 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 4096):
            part = ((s[k : k + 4096, None] * _A + _B) >> np.uint64(32)).astype(np.uint32)
            np.minimum(best, part.min(axis=0), out=best)
    return best.view(np.int32)


_EDGES = np.arange(BINS, dtype=np.uint64) * np.uint64(2**64 // BINS)


def bins(s: np.ndarray) -> bytes:
    """The sketch of a sorted set."""
    at = np.searchsorted(s, _EDGES)
    end = np.append(at[1:], len(s))
    first = s[np.minimum(at, len(s) - 1)] % np.uint64(255) + np.uint64(1)
    return np.where(at < end, first, 0).astype(np.uint8).tobytes()


def _likely(equal: np.ndarray, neither: np.ndarray, percent: int) -> np.ndarray:
    """Whether so many equal bytes of two sketches, those that are 0 in both included, let the pair be similar enough.

    The m ranges in use are a sample, without replacement, of the union, whose size they tell; one is allowed for rounding.
    """
    m, p = BINS - neither, percent / 100
    unseen = 1 - m / BINS / -np.log(np.clip(neither / BINS, 1e-9, 1 - 1e-9))
    return equal - neither >= p * m - DEVIATIONS * np.sqrt(p * (1 - p) * m * np.clip(unseen, 0, 1)) - 1


def sketch(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, digest (of the whole set), sig, bins."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        n, digest, sig, parts = [], [], [], []
        for text in map(_AS_PY, batch.column(1)):  # one at a time: a batch of texts is large
            s = shingles(text, words)
            n.append(len(s))
            digest.append(hashlib.md5(s.tobytes(), usedforsecurity=False).digest() if len(s) else None)
            sig.append(signature(s) if len(s) else None)
            parts.append(bins(s) if len(s) else None)
        return {"id": batch.column(0), "n": n, "digest": digest, "sig": sig, "bins": parts}

    return by_batch(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), "id long, n long, digest binary, sig array<int>, bins binary", run)


def _node(tree: Column, *path: Column) -> Column:
    """The name of a node; its last four bits are its tree."""
    return F.shiftleft(F.xxhash64(*path), 4).bitwiseOR(tree.cast("long"))


def _tree(key: str) -> Column:
    return F.col(key).bitwiseAND(F.lit(15))


def _roots(reps: DataFrame) -> DataFrame:
    """key, rep: the roots that each document is in."""
    roots = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(t * BRANCHES + j).alias("c")) for t in range(TREES) for j in range(BRANCHES)))
    return reps.select("rep", F.explode(F.transform(roots, lambda x: _node(x["t"], x["c"], F.get("sig", x["c"])))).alias("key"))


def _branched(large: DataFrame, reps: DataFrame) -> DataFrame:
    """key, rep: the children of nodes (key, rep)."""
    first = TREES * BRANCHES
    steps = F.transform(F.array(*map(F.lit, range(BRANCHES))), lambda j: F.struct(j.alias("j"), (F.pmod(F.xxhash64("key", j), F.lit(COORDS - first)) + first).cast("int").alias("c")))
    return large.select("key", "rep").join(reps.select("rep", "sig"), "rep").select("rep", F.explode(F.transform(steps, lambda x: _node(_tree("key"), F.col("key"), x["j"], x["c"], F.get("sig", x["c"])))).alias("key"))


def _spread(large: DataFrame, reps: DataFrame) -> DataFrame:
    """Large nodes (key, rep, n) with ``alike``: the share of their pairs that their first branch would leave together."""
    first = TREES * BRANCHES
    step = F.get("sig", (F.pmod(F.xxhash64("key", F.lit(0)), F.lit(COORDS - first)) + first).cast("int"))
    groups = large.join(reps.select("rep", "sig"), "rep").groupBy("key", step.alias("step")).agg(F.count(F.lit(1)).alias("m"))
    alike = groups.groupBy("key").agg(((F.sum(F.col("m") * F.col("m")) - F.sum("m")) / (F.sum("m") * (F.sum("m") - 1))).alias("alike"))
    return large.join(alike, "key")


def _dealt(large: DataFrame) -> DataFrame:
    """node, key, rep: the documents of large nodes (key, rep, n), each in a block of about BLOCK."""
    block = _node(_tree("key"), F.col("key"), F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("n") / BLOCK)))
    return large.select(F.col("key").alias("node"), block.alias("key"), "rep")


def _settled(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the links found so far make of large nodes that don't branch (key, rep, n, label): the blocks (key, rep) of those in which one component
    holds all but SMALL documents, and the nodes (key, rep, n) that hold more of others. Nodes of one component are in neither."""
    groups = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    top = groups.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top")).select("key", F.col("top.c").alias("c"), F.col("top.label").alias("most"))
    rows = durable(large.join(top, "key").where("n > c").withColumn("others", F.col("n") - F.col("c")))
    few = rows.where(F.col("others") <= SMALL).withColumn("blocks", F.ceil(F.col("c") / (BLOCK - SMALL)))
    # the few others meet every block, so that each of them meets all documents of the node
    places = F.when(F.col("label") == F.col("most"), F.array(F.pmod(F.xxhash64("rep", "key"), F.col("blocks")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    blocks = few.select("rep", "key", F.explode(places).alias("block")).select(_node(_tree("key"), F.col("key"), F.col("block")).alias("key"), "rep")
    return blocks, rows.where(F.col("others") > SMALL).select("key", "rep", "n")


def _propose(nodes: DataFrame, what: str, percent: int) -> DataFrame:
    """What nodes propose. ``hubs``: each node's hub a, and in b the sixths of the node that resemble it; ``stars``: pairs (a, b)
    of a hub b and a document of its neighbourhood, one of each label; ``all``: all pairs, but for those that meet in an
    earlier node as well. Pairs are of different labels."""

    def judge(key: int, rep: np.ndarray, label: np.ndarray, sets: np.ndarray, earlier: list, out: list) -> None:
        void, rows = np.packbits(sets == 0, axis=1), range(0, len(rep), 16)
        equal = np.concatenate([(sets[k : k + 16, None] == sets[None]).sum(axis=2, dtype=np.int32) for k in rows])
        neither = np.concatenate([np.bitwise_count(void[k : k + 16, None] & void[None]).sum(axis=2, dtype=np.int32) for k in rows])
        near = _likely(equal, neither, percent)
        # coarse degrees: among near copies of each other, nodes then agree on the smallest ids as hubs, so that
        # the pairs of all nodes are few; the middle of a star still stands out
        degree = near.sum(axis=1) * 6 // len(rep)
        if what == "hubs":
            top = int(np.lexsort((rep, -degree))[0])
            out.append((key, rep[top], int(degree[top])))
            return
        apart = near & (label[:, None] != label[None, :])
        if not apart.any():
            return
        if what in ("all", "blocks"):
            before = [set(e) for e in earlier]
            for x, y in zip(*np.nonzero(np.triu(apart, 1)), strict=True):
                if before[x].isdisjoint(before[y]):
                    out.append((key, max(rep[x], rep[y]), min(rep[x], rep[y])))
            return
        # documents of the hub's own component are covered too, so that a component doesn't send each of its documents
        todo = apart.any(axis=1)
        for x in np.lexsort((rep, -degree)):
            if todo[x]:
                met = np.flatnonzero(apart[x])
                alike = (equal[x, met] - neither[x, met]) / (BINS - neither[x, met])
                met = met[np.lexsort((rep[met], -alike))]
                for y in met[np.unique(label[met], return_index=True)[1]]:
                    out.append((key, rep[y], rep[x]))
                todo[x] = False
                todo &= ~near[x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            keys = rest.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield pairs(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and len(rest):
            yield pairs(rest)

    def pairs(t: pa.Table) -> pa.RecordBatch:
        keys, rep, label = (t.column(c).to_numpy() for c in ("key", "rep", "label"))
        sets = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
        earlier = t.column("earlier").to_pylist()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
        out: list = []
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                judge(keys[a], rep[a:b], label[a:b], sets[a:b], earlier[a:b], out)
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in cols], names=["key", "a", "b"])

    if what == "all":  # a document is in TREES * BRANCHES ** (DEPTH + 1) nodes at most
        mine = F.collect_list("key").over(Window.partitionBy("rep"))
        nodes = nodes.withColumn("mine", mine).withColumn("earlier", F.filter("mine", lambda k: k < F.col("key")))
    else:
        nodes = nodes.withColumn("earlier", F.array().cast("array<long>"))
    parted = nodes.select("key", "rep", "label", "bins", "earlier").repartition("key").sortWithinPartitions("key", "rep")
    return parted.mapInArrow(run, "key long, a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    degree = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("salts"))
    dealt = pairs.join(degree, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    ids = durable(_merged(dealt.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = durable(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(wanted, "id", "left_semi"))
    members = dealt.join(texts, dealt["a"] == texts["id"]).select("b", "salt", "a", F.lit(1).alias("role"), "text")
    hubs = dealt.select("b", "salt").distinct()
    hubs = hubs.join(texts, hubs["b"] == texts["id"]).select("b", "salt", F.col("b").alias("a"), F.lit(0).alias("role"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, []
        for batch in batches:
            a_out, b_out = [], []
            for b, salt, a, role, text in zip(*(map(_AS_PY, c) for c in batch.columns), strict=True):
                s = shingles(text, words)
                if role == 0:
                    sets = [*sets, s] if at == (b, salt) else [s]
                    at = (b, salt)
                elif at == (b, salt):
                    for hub in sets:
                        both = len(np.intersect1d(hub, s, assume_unique=True))
                        if 100 * both >= percent * (len(hub) + len(s) - both):
                            a_out.append(a)
                            b_out.append(b)
                            break
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    both = members.unionByName(hubs).repartition("b", "salt").sortWithinPartitions("b", "salt", "role", "a")
    return both.select("b", "salt", "a", "role", "text").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id of each component. Up to FEW_EDGES edges are joined in one task, more by alternating large and small stars."""
    e = durable(_merged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    if e.count() <= FEW_EDGES:
        return durable(e.coalesce(1).mapInArrow(_in_one_task, "id long, label long"))
    e, state = e.distinct(), None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
        release(e)
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = durable(e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct())
    return durable(e.select(F.col("u").alias("id"), F.col("v").alias("label")))


def _merged(df: DataFrame) -> DataFrame:
    """``df``, of few and short rows, in no more partitions than there are cores."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label of the ids that edges (u, v) join with a smaller one."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            u, v = top(u), top(v)
            above[max(u, v)] = min(u, v)
    found = [(x, t) for x in above if (t := top(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], names=["id", "label"])


def _seem_alike(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, of_a, of_b) whose sketches let them be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("of_a", "of_b"))
            near = _likely((x == y).sum(axis=1), ((x == 0) & (y == 0)).sum(axis=1), percent)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _with_hubs(large: DataFrame, hubs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the documents of the large nodes with those hubs b of their nodes that they resemble."""
    hubs = large.select("node", "key").distinct().join(hubs, "key").groupBy("node").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("b")).alias("b"), "a"))), 1, HUBS).alias("hubs"))
    hubs = hubs.select("node", F.explode("hubs").alias("hub")).select("node", F.col("hub.a").alias("b"))
    met = large.select("node", F.col("rep").alias("a")).join(hubs, "node").where("a <> b").select("a", "b").distinct()
    met = met.join(reps.select(F.col("rep").alias("a"), F.col("bins").alias("of_a")), "a").join(reps.select(F.col("rep").alias("b"), F.col("bins").alias("of_b")), "b")
    return _seem_alike(met, percent)


def _often(texts: DataFrame, words: int) -> np.ndarray:
    """How often shingles occur, by BUCKETS ranges of their hash: rows of a partition are summed before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in map(_AS_PY, batch.column(1)):
                total += np.bincount(_bucket(shingles(text, words)), minlength=BUCKETS)
        yield of(total)

    def of(total: np.ndarray) -> pa.RecordBatch:
        parts = [(k // PART, np.flatnonzero(x), x[x > 0]) for k in range(0, BUCKETS, PART) if (x := total[k : k + PART]).any()]
        cols = list(zip(*parts, strict=True)) or [(), (), ()]
        kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True)], names=["part", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[np.asarray(at) + part * PART] += n
        yield of(total)

    kind = "part int, at array<int>, n array<long>"
    total = np.zeros(BUCKETS, np.int64)
    for row in texts.mapInArrow(count, kind).repartition(BUCKETS // PART, "part").mapInArrow(add, kind).collect():
        total[np.asarray(row.at) + row.part * PART] = row.n
    return total


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _prefixes(docs: DataFrame, ids: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """rep, n, token, at: the shingles in the prefixes of the documents ``ids``, by their place in one order of all shingles: those of rare buckets first."""
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).join(ids, "rep", "left_semi")
    texts = durable(texts.dropDuplicates(["rep"]))
    often = docs.sparkSession.sparkContext.broadcast(_often(texts, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, text in zip(batch.column(0).to_pylist(), map(_AS_PY, batch.column(1)), strict=True):
                s = shingles(text, words)
                n = len(s)
                # the larger of two sets shares percent of its own size at least
                first = np.lexsort((s, often.value[_bucket(s)]))[: n + 1 - -(-percent * n // 100)] if n else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(first), rep, np.int64), np.full(len(first), n, np.int64), s[first].view(np.int64), np.arange(len(first)))], names=["rep", "n", "token", "at"])

    return durable(texts.mapInArrow(run, "rep long, n long, token long, at long"))


def _by_prefix(prefixes: DataFrame, labels: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that share a shingle of their prefixes and can be similar enough."""
    rows = prefixes.join(labels.toDF("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = rows.groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token", "docs")
    rows = rows.join(mixed, "token").withColumn("blocks", F.ceil(F.col("docs") / TILE)).withColumn("block", F.pmod(F.xxhash64("rep", "token"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = rows.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "at", "label").join(reps.select("rep", "bins"), "rep")

    def judge(t: pa.Table) -> Iterator[pa.RecordBatch]:
        block, rep, n, at, label = (t.column(c).to_numpy() for c in ("block", "rep", "n", "at", "label"))
        apart = t.column("i")[0] != t.column("j")[0]
        sets = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
        # the smaller of two sets is met in a shorter prefix
        for x in range(0, len(rep), 256):
            few = np.arange(x, min(x + 256, len(rep)))
            few = few[at[few] <= n[few] - -(-2 * percent * n[few] // (100 + percent))]
            p, q = few[:, None], np.arange(len(rep))[None]
            fits = (label[p] != label[q]) & ((n[p] < n[q]) | ((n[p] == n[q]) & (rep[p] < rep[q]))) & (100 * n[p] >= percent * n[q])
            # where two sets meet first, what comes after must be enough
            fits &= (100 + percent) * np.minimum(n[p] - at[p], n[q] - at[q]) >= percent * (n[p] + n[q])
            if apart:
                fits &= block[p] != block[q]
            u, v = np.nonzero(fits)
            u = few[u]
            for k in range(0, len(u), 8192):
                a, b = u[k : k + 8192], v[k : k + 8192]
                s, r = sets[a], sets[b]
                near = _likely((s == r).sum(axis=1), ((s == 0) & (r == 0)).sum(axis=1), percent)
                a, b = rep[a[near]], rep[b[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            cuts = _cuts(rest)
            for a, b in zip(cuts, cuts[1:-1], strict=False):
                yield from judge(rest.slice(a, b - a))
            rest = rest.slice(cuts[-2])
        if rest is not None and len(rest):
            yield from judge(rest)

    parted = tiles.select("token", "i", "j", "block", "rep", "n", F.col("at").cast("long").alias("at"), "label", "bins").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "rep")
    return parted.mapInArrow(run, "a long, b long")


def _cuts(t: pa.Table) -> list[int]:
    """Where the tiles of a table begin, and its end."""
    keys = np.stack([t.column(c).to_numpy() for c in ("token", "i", "j")])
    return [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(t)]


class _Links:
    """The links confirmed so far, and the components that they make."""

    def __init__(self, docs: DataFrame, reps: DataFrame, words: int, percent: int, id_col: str, text_col: str):
        self.docs, self.reps, self.rule = docs, reps, (words, percent, id_col, text_col)
        none = docs.sparkSession.range(0)  # createDataFrame would start Python workers of another kind on the executors
        self.found = self.tried = none.select(F.col("id").alias("a"), F.col("id").alias("b"))
        self.labels = none.select("id", F.col("id").alias("label"))

    def labelled(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` with the label of each rep."""
        return nodes.join(self.labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))

    def add(self, pairs: DataFrame) -> None:
        """Confirm those of ``pairs`` that were not tried before."""
        pairs = pairs.select("a", "b").where("a <> b").dropDuplicates(["a", "b"])
        tried = self.tried.toDF("x", "y")
        pairs = durable(_merged(pairs.join(tried, (F.greatest("a", "b") == tried["x"]) & (F.least("a", "b") == tried["y"]), "left_anti")))
        if pairs.isEmpty():
            return
        self.found = durable(_merged(self.found.union(confirm(pairs, self.docs, *self.rule))))
        self.tried = durable(_merged(self.tried.union(pairs.select(F.greatest("a", "b"), F.least("a", "b")))))
        self.labels = components(self.found)
        release(self.labels)


def links(docs: DataFrame, reps: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, label of the representatives that are linked with another."""
    known = _Links(docs, reps, words, percent, id_col, text_col)
    rows, small, stuck = _roots(reps), [], []
    for level in range(DEPTH + 1):
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = durable(rows.join(sizes, "key").select("key", "rep", "n"))
        small.append(rows.where(F.col("n") <= SMALL).select("key", "rep"))
        large = rows.where(F.col("n") > SMALL)
        if large.isEmpty():
            break
        if level == 0:
            dealt = durable(_dealt(large))
            hubs = _propose(known.labelled(dealt.select("key", "rep")).join(reps.select("rep", "bins"), "rep"), "hubs", percent)
            known.add(_with_hubs(dealt, hubs, reps, percent))
        if level == DEPTH:
            stuck.append(large)
            break
        large = durable(_spread(large, reps))
        parts = F.col("alike") < 1 / (2 * BRANCHES)
        stuck.append(large.where(~parts).select("key", "rep", "n"))
        rows = _branched(large.where(parts), reps)
    blocks, alike = _settled(known.labelled(reduce(DataFrame.unionByName, stuck))) if stuck else (None, None)
    width = reps.rdd.getNumPartitions()
    with_bins = lambda parts: durable(reduce(DataFrame.unionByName, parts).coalesce(width).join(reps.select("rep", "bins"), "rep").select("key", "rep", "bins"))
    nodes = with_bins(small)
    rest = None if blocks is None else with_bins([blocks])
    propose = lambda df, what: _propose(known.labelled(df), what, percent).select("a", "b")
    known.add(propose(nodes.where(_tree("key") == 0), "stars"))
    known.add(propose(nodes if rest is None else nodes.unionByName(rest), "stars"))
    known.add(propose(nodes, "all") if rest is None else propose(nodes, "all").union(propose(rest, "blocks")))
    ids = None if alike is None else durable(alike.select("rep").distinct())
    if ids is not None and not ids.isEmpty():
        known.add(_by_prefix(_prefixes(docs, ids, words, percent, id_col, text_col), known.labels, reps, percent))
    return known.labels


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept."""
    rows = durable(sketch(docs, words, id_col, text_col))
    reps = rows.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("bins").alias("bins"))
    reps = durable(reps)
    labels = links(docs, reps.select("rep", "sig", "bins"), words, percent, id_col, text_col)
    named = reps.join(labels, reps["rep"] == labels["id"], "left").select("digest", F.coalesce("label", "rep").alias("label"))
    out = rows.drop("sig", "bins").join(named, "digest", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("label", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component; every column as it was."""
    gone = near_dedup(docs, words, percent, id_col, text_col).where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
