"""Near-duplicate detection by a chosen-path set similarity join.

Every document is a set of word shingles, sketched by ``SKETCH`` minwise
tokens.  A tree branches a node's documents by the tokens at coordinates that
the node's path chooses, so that similar documents keep meeting and others part:

* the root takes two branchings at once, which leaves unlike documents alone,
* a node of at most ``LEAF`` documents and ``TOKENS`` shingles is compared exhaustively,
* a larger one is branched again, into one or two children of each document,
* ``TREES`` independent trees bring the recall to the target: two documents of
  similarity 0.8 pass the root with probability 0.64 and then meet with 0.62 at
  any depth, so all trees miss 1 in 2000 at most, and 1 in 10**7 where nodes are small.

A node is solved in two steps, neither of which returns pairs:

1. Sketches.  A document stays in its node if its sketch is like that of
   another one there which lies in another component.
2. Sets.  The full shingle sets of those that stay are compared, all with all,
   in one task, which unites components as it goes and returns only the links
   that united two.  So a node of n documents gives n - 1 rows at most, however
   many of its pairs are similar, and none is left out.

The first trees unite nearly everything; in the others a node whose documents
all lie in one component is dropped before its sketches are moved.  Before a
large node is branched it is dealt at random into cells of ``LEAF`` documents
and solved by cell, so that a group of any size of like documents becomes one
component by linear work.  If then at most half a leaf of its documents lie
outside its largest component, they go to each of that component's cells, which
compares all pairs that are left; only other large nodes are branched.  Equal
sets are folded before all this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow import slices, utf8
from larkspur.llm.bytehash import U64, mix, shingle_set
from larkspur.llm.components import components
from larkspur.llm.skew import join_groups
from larkspur.llm.workspace import Scratch, broadcast_if, own

SKETCH = 128
TREES = 16
#: Trees whose links are found before the others are looked at.
EARLY = 3
LEAF = 2048
#: Most shingles of a cell: its sets take 8 bytes each in the task that compares them.
TOKENS = 4_000_000
#: Levels of branching after which a node that is still large is compared in pairs of blocks.
DEPTH = 40
#: Coordinates that must agree for a pair's full sets to be compared: 5 sigma below 0.8 * 128.
AGREE = 80
#: Cells up to this many documents are compared in one go for all cells of a batch.
SMALL = 12
#: Most rows of a table of ids that is broadcast (16 bytes each).
BROADCAST_ROWS = 500_000
_rng = np.random.Generator(np.random.PCG64(20240607))
_MUL = _rng.integers(0, 1 << 63, SKETCH, np.uint64) * U64(2) + U64(1)
_ADD = _rng.integers(0, 1 << 63, SKETCH, np.uint64)


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """32 bits of the least permuted token, by coordinate."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, U64)
    for start in range(0, len(tokens), 4096):
        part = tokens[start : start + 4096]
        np.minimum(least, ((part[None, :] ^ _ADD[:, None]) * _MUL[:, None]).min(axis=1), out=least)
    return (mix(least) >> U64(32)).astype("<u4")


def _signatures(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digest, sketch = [], [], []
            for text in utf8(batch["text"]):
                s = shingle_set(text, shingle)
                n.append(len(s))
                digest.append(np.array([s.sum(dtype=U64), mix(s ^ U64(0x5DEECE66D)).sum(dtype=U64)], U64).tobytes())
                sketch.append(_sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"]
            )

    return run


def _sets(shingle: int):
    """The full shingle sets, as sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, shingle).tobytes() for t in utf8(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sets, pa.binary())], ["rep", "set"])

    return run


def _small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        yield x.assign(small=[np.frombuffer(s, "<u4").astype(np.uint8).tobytes() for s in x["sketch"]])


_NODES = "node long, rep long, w long, early boolean"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SKETCH)


def _node_batch(node: np.ndarray, rep: pa.Array, w: pa.Array, early: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), rep, w, pa.array(np.full(len(node), early))], ["node", "rep", "w", "early"])


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two coordinates for each tree's root."""
    for batch in batches:
        s = _matrix(batch["sketch"])
        for t in range(TREES):
            at = t * SKETCH // TREES
            node = mix(mix(s[:, at].astype(U64) + U64((t + 1) << 40)) + s[:, at + 1].astype(U64))
            yield _node_batch(node, batch["rep"], batch["w"], t < EARLY)


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of a node chooses the coordinates by which it branches, and whether once or twice."""
    for batch in batches:
        s, node = _matrix(batch["sketch"]), batch["node"].to_numpy().view(U64)
        for b in range(2):
            mine = np.flatnonzero((mix(node) & U64(1)) == U64(0)) if b else np.arange(len(node))
            at = (mix(node[mine] + U64(b + 1)) % U64(SKETCH)).astype(np.int64)
            child = mix(mix(node[mine] ^ U64(b + 1)) + s[mine, at].astype(U64))
            yield _node_batch(child, batch["rep"].take(pa.array(mine)), batch["w"].take(pa.array(mine)), True)


def _by_cell(batches: Iterator[pa.RecordBatch], binary: str, rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows sorted by (node, cell), in runs of whole cells: node, cell, rep, comp, and the values of ``binary``."""
    held = None
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            b = whole.slice(start, rows)
            new = (*(b[c].to_numpy(zero_copy_only=False) for c in ("node", "cell", "rep", "comp")), np.array(b[binary].to_pylist(), object))
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            node, cell = held[:2]
            cut = int(np.flatnonzero((node == node[-1]) & (cell == cell[-1]))[0])  # the last cell may go on
            if cut:
                yield tuple(x[:cut] for x in held)
                held = tuple(x[cut:] for x in held)
    if held is not None:
        yield held


def _edges_of(node: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Where cells begin, and the end of the last one."""
    new = (np.diff(node) != 0) | (np.diff(cell) != 0)
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(node)]])


def _resembling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: members of a cell whose sketch is like that of one in another component."""
    for node, cell, rep, comp, data in _by_cell(batches, "small", 4096):
        s = np.frombuffer(b"".join(data), np.uint8).reshape(-1, SKETCH)
        bounds = _edges_of(node, cell)
        sizes = np.diff(bounds)
        stays = np.zeros(len(node), bool)
        which, tiny = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes <= SMALL, sizes)
        for d in range(1, SMALL):
            i = np.flatnonzero(tiny[d:] & (which[d:] == which[:-d]) & (comp[d:] != comp[:-d]))
            if not len(i):
                continue
            i = i[(s[i] == s[i + d]).sum(axis=1) >= AGREE]
            stays[i] = stays[i + d] = True
        for k in np.flatnonzero(sizes > SMALL):
            a, b = bounds[k], bounds[k + 1]
            x, c = np.ascontiguousarray(s[a:b].T), comp[a:b]
            for at in range(0, b - a, 128):
                alike = np.zeros((min(128, b - a - at), b - a), np.uint8)
                for row in x:
                    alike += row[at : at + 128, None] == row[None, :]
                hit = (alike >= AGREE) & (c[at : at + 128, None] != c[None, :])
                stays[a + at : a + at + len(hit)] |= hit.any(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(x[stays]) for x in (node, cell, rep, comp)], ["node", "cell", "rep", "comp"])


def unite(comp: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Which components similar sets connect: each that is united with a lesser one, and the least of them."""
    kinds, root = np.unique(comp, return_inverse=True)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    tokens, flat = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes)
    mark, least = np.zeros(len(tokens), bool), np.arange(len(kinds))
    of = root.copy()
    for i in range(len(sets)):
        other = np.flatnonzero((root != root[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
        if not len(other):
            continue
        own = flat[ends[i] - sizes[i] : ends[i]]
        mark[own] = True
        n = sizes[other]
        at = np.repeat(ends[other] - np.cumsum(n), n) + np.arange(int(n.sum()))
        common = np.add.reduceat(mark[flat[at]], np.cumsum(n) - n, dtype=np.int64)
        mark[own] = False
        for j in other[100 * common >= percent * (n + sizes[i] - common)]:
            if root[j] != root[i]:
                a, b = sorted((root[i], root[j]))
                root[root == b] = a
    least[of] = root
    return [(int(kinds[k]), int(kinds[r])) for k, r in enumerate(least) if k != r]


def _uniting(percent: int):
    """Step 2: compares the full sets of a cell's members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, cell, _, comp, data in _by_cell(batches, "set", 64):
            bounds, links = _edges_of(node, cell), []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1:
                    links += unite(comp[a:b], [np.frombuffer(x, U64) for x in data[a:b]], percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


class _Join:
    """The tables of one run, and the components so far (node, component)."""

    def __init__(self, source: DataFrame, reps: DataFrame, shingle: int, percent: int, total: int, scratch: Scratch):
        self.source, self.reps, self.shingle, self.percent, self.total, self.scratch = source, reps, shingle, percent, total, scratch
        self.comps: DataFrame | None = None

    def mixed(self, members: DataFrame) -> DataFrame:
        """Members, with their component, of the nodes that have more than one."""
        if self.comps is None:
            return members.withColumn("comp", F.col("rep"))
        known = self.comps.withColumnRenamed("node", "rep")
        labelled = self.scratch.stage(members.join(known, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component"))
        nodes = labelled.groupBy("node").agg(F.min("comp").alias("c"), F.max("comp").alias("d"), F.first("n").alias("n")).filter("c <> d").select("node", "n")
        nodes = self.scratch.stage(nodes)
        out = self.scratch.stage(join_groups(labelled.drop("n"), nodes, ["node"], "n", self.total))
        self.scratch.drop(labelled, nodes)
        return out

    def solve(self, cells: DataFrame) -> None:
        """cells: node, cell, rep, comp.  Adds the links that unite what is similar in each cell."""
        keys = ["node", "cell"]
        sketched = cells.join(self.reps.select("rep", "small"), "rep").select(*keys, "rep", "comp", "small")
        kept = self.scratch.stage(sketched.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_resembling, "node long, cell long, rep long, comp long"))
        ids = kept.select(F.col("rep").alias("doc_id")).distinct()
        ids = F.broadcast(ids) if kept.count() <= BROADCAST_ROWS else ids
        sets = self.source.join(ids, "doc_id", "left_semi").mapInArrow(_sets(self.shingle), "rep long, set binary")
        full = kept.join(sets.filter(F.octet_length("set") > 0), "rep").select(*keys, "rep", "comp", "set")
        found = self.scratch.stage(full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_uniting(self.percent), "a long, b long"))
        if found.limit(1).count():
            self.add(found)
        self.scratch.drop(kept, found)

    def add(self, links: DataFrame) -> None:
        before = self.comps
        if before is not None:
            links = links.unionByName(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.comps = components(links, self.scratch)
        if before is not None:
            self.scratch.drop(before)

    def dealt(self, members: DataFrame) -> DataFrame:
        """Members by cell: a small node is one, a large one is dealt at random."""
        return self.mixed(members).withColumn("cell", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("cells")))

    def blocks(self, members: DataFrame) -> DataFrame:
        """Each pair of a large node's cells of half the size together as a cell."""
        dealt = members.withColumn("count", 2 * F.col("cells")).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("count")))
        both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
        return both.withColumn("cell", F.least("block", "other") * F.col("count") + F.greatest("block", "other"))

    def level(self, nodes: DataFrame, last: bool) -> DataFrame | None:
        """Solves the nodes; returns the members of those that are still large and mixed."""
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n"), F.sum("w").alias("tokens")).filter("n > 1")
        sizes = self.scratch.stage(sizes.select("node", "n", F.greatest(F.ceil(F.col("n") / LEAF), F.ceil(F.col("tokens") / TOKENS)).alias("cells")))
        members = self.scratch.stage(join_groups(nodes, sizes, ["node"], "n", self.total))
        for early in (True, False):
            part = members.filter(F.col("early") == early)
            if part.limit(1).count():
                self.solve(self.dealt(part))
        self.scratch.drop(sizes)
        large = members.filter("cells > 1")
        if not large.limit(1).count():
            return None
        left = self.mixed(large)
        if not left.limit(1).count():
            return None
        if last:
            self.solve(self.blocks(left))
            return None
        parts = left.groupBy("node", "comp").agg(F.count("*").alias("c"), F.sum("w").alias("t"))
        most = F.struct("c", "comp")
        few = (F.sum("c") - F.max("c") <= LEAF // 2) & (F.sum("t") - F.max_by("t", most) <= TOKENS // 2)
        tops = self.scratch.stage(parts.groupBy("node").agg(F.max_by("comp", most).alias("top"), few.alias("few"), F.sum("c").alias("n")))
        marked = self.scratch.stage(join_groups(left.drop("n"), tops, ["node"], "n", self.total))
        self.scratch.drop(left, tops)
        self.finish(marked.filter("few"))
        left = marked.filter("not few")
        return left if left.limit(1).count() else None

    def finish(self, members: DataFrame) -> None:
        """Compares all other members of a node with all of its largest component (top), which is dealt into cells."""
        if members.limit(1).count():
            count = 2 * F.col("cells")
            top = members.filter("comp = top").withColumn("cell", F.pmod(F.xxhash64("rep", F.lit(2)), count))
            rest = members.filter("comp <> top").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
            self.solve(top.unionByName(rest))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, as a written table.

    Documents are linked when 100 * intersection >= percent * union of their
    sets of ``shingle``-word shingles (a shorter text: its whole sequence as
    one).  component_id is the least doc_id in reach.  Texts without words are
    linked with nothing.  Rows that repeat a doc_id are one node, with the
    links of all of them.  A null doc_id is never linked; its component_id is
    null, and it is kept.  An empty table gives an empty result.  Other
    columns are ignored.  Shingles are compared by hashes of 64 bits, equal
    sets folded by hashes of 128.
    """
    source = docs.select("doc_id", "text")
    with Scratch(docs.sparkSession) as scratch:
        signed = scratch.stage(source.mapInArrow(_signatures(shingle), "doc_id long, n_shingles long, digest binary, sketch binary"))
        usable = signed.filter("sketch is not null and doc_id is not null")
        total = max(signed.count(), 1)
        classes = scratch.stage(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")))
        first = usable.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
        reps = first.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("w"), "sketch")
        reps = scratch.stage(reps.mapInPandas(_small, "rep long, w long, sketch binary, small binary"))  # an id with several texts has as many rows
        join = _Join(source, reps, shingle, percent, total, scratch)
        left = reps.select("rep", "w", "sketch").mapInArrow(_roots, _NODES)
        for depth in range(DEPTH):
            nodes = scratch.stage(left)
            left = join.level(nodes, depth == DEPTH - 1)
            scratch.drop(nodes)
            if left is None:
                break
            left = left.select("node", "rep").distinct().join(reps.select("rep", "w", "sketch"), "rep").mapInArrow(_children, _NODES).distinct()
        repeated = scratch.stage(usable.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
        if repeated.limit(1).count():  # an id with several texts is one node of all their classes
            join.add(usable.join(repeated, "doc_id").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
        known = classes.select("digest", F.col("rep").alias("comp"), "size")
        if join.comps is not None:
            known = classes.join(join.comps, classes["rep"] == join.comps["node"], "left").select("digest", F.coalesce("component", "rep").alias("comp"), "size")
        joined = join_groups(usable.select("doc_id", "n_shingles", "digest"), scratch.stage(known), ["digest"], "size", total)
        placed = joined.select("doc_id", "n_shingles", F.col("comp").alias("component_id"))
        rest = signed.filter("sketch is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return scratch.keep(scratch.stage(placed.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the least of their component, with all their columns.

    Rows without doc_id stay; rows that repeat the doc_id of a kept row stay with it.
    """
    with Scratch(docs.sparkSession) as scratch:
        judged = near_duplicates(docs, shingle, percent)
        gone = scratch.keep(scratch.stage(judged.filter("not kept").select("doc_id").distinct()))
    return docs.join(broadcast_if(gone, BROADCAST_ROWS), "doc_id", "left_anti").select(*(own(docs, c) for c in docs.columns))
