"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints that differ in 3 bits at most agree on one of 4 blocks of 16, so
each is filed under 4 masked bit patterns (the roots), which Spark deals out.
A pattern shared by more than ``CROWDED`` fingerprints is replaced by 4 longer
ones in the same way: of the bits that are left, one of 4 parts must agree.

Below a root the fingerprints are sorted by Gray rank, so that neighbours
share many bits.  Sixteen neighbours make a node that holds the bits they all
have (a mask and a pattern), and so on up to the root; a child keeps only the
bits its parent doesn't hold.  A search goes down from the root, adds up the
differences on the way and prunes a whole node when they exceed 3.  It also
accepts a whole node when the bits that are open cannot exceed 3, and skips
one whose fingerprints are all linked with the query already.  Each root gives
a spanning forest, at most as many links as it has fingerprints, so a group
of copies or near copies never becomes all its pairs, and no link between
components is lost.

Equal fingerprints are one node.  Null texts and texts without words have the
fingerprint 0 and link like any other.  A null id never names a component
unless all ids of it are null.  Repeated rows stay; an empty table gives an
empty table; columns that are not named are not read.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.shared import by_batches, chunks_of, stored

DISTANCE = 3
SHINGLE = 3
SEED = 42
FANOUT = 16
#: A root with more fingerprints than this is split by longer patterns.
CROWDED = 50_000
#: Pairs of a query and a node that a task holds at once, about.
FRONTIER = 2_000_000

BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def signed(value):
    """A 64-bit pattern as the long that Spark holds."""
    return value - (1 << 64) if value >> 63 else value


def fingerprint(data, size=SHINGLE):
    """SimHash of a text given as UTF-8: a bit is set if it is in over half of the shingles' hashes."""
    words = data.lower().split() if data else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())]
    columns = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    bits = 0
    for i in range(8):
        ones = np.bincount(columns[:, i], minlength=256) @ BYTE_BITS
        for j in np.flatnonzero(2 * ones > len(hashes)).tolist():
            bits |= 1 << (8 * i + j)
    return bits


def fingerprints(docs, text="text", keep=("doc_id",)):
    """The columns ``keep`` and ``fp``, the fingerprint of the whole text as a long."""
    keep = list(keep)

    def run(batches):
        for batch in batches:
            prints = [signed(fingerprint(data)) for _, chunk in chunks_of(batch, len(keep)) for data in chunk]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(prints, pa.int64())], names=[*keep, "fp"])

    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = docs.select(*keep).schema.add("fp", "long")
    return by_batches(rows, run, schema)


def parts(free):
    """Splits bit numbers into 4 masks, as even as can be."""
    cut = [len(free) * i // (DISTANCE + 1) for i in range(DISTANCE + 2)]
    return [sum(1 << b for b in free[i:j]) for i, j in zip(cut, cut[1:])]


def masks(levels):
    """Masks of the roots, and for each mask that may be crowded the 4 longer ones that replace it."""
    first = parts(list(range(64)))
    longer, now = {}, first
    for _ in range(levels):
        for mask in now:
            longer[mask] = [mask | m for m in parts([b for b in range(64) if not mask >> b & 1])]
        now = [m for mask in now for m in longer[mask]]
    return first, longer


def gray_rank(values):
    """The place of each bit pattern in the Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        values = values ^ (values >> np.uint64(shift))
    return values


class Forest:
    """All roots of one task, each with its tree of shared bit patterns over Gray-sorted fingerprints."""

    def __init__(self, roots, values, fanout=FANOUT):
        order = np.lexsort((gray_rank(values), roots))
        self.values, self.leaf_root = values[order], roots[order]
        n = len(values)
        full = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
        # a level: root, mask, pattern, first child, one past the last, first and one past the last leaf
        at = np.arange(n)
        level = {"root": self.leaf_root, "mask": full, "bits": self.values, "first": at, "stop": at + 1, "leaf": at, "end": at + 1}
        self.levels = [level]
        while (level["root"][1:] == level["root"][:-1]).any():
            level = self.above(level, fanout)
            self.levels.append(level)
        self.levels.reverse()
        for upper, lower in zip(self.levels, self.levels[1:]):
            # a child keeps the bits that its parent doesn't hold
            parent = np.repeat(np.arange(len(upper["root"])), upper["stop"] - upper["first"])
            lower["rest"] = lower["mask"] & ~upper["mask"][parent]
        self.levels[0]["rest"] = self.levels[0]["mask"]

    @staticmethod
    def above(level, fanout):
        new = np.flatnonzero(np.r_[True, level["root"][1:] != level["root"][:-1]])
        sizes = np.diff(np.r_[new, len(level["root"])])
        place = np.arange(len(level["root"])) - np.repeat(new, sizes)
        first = np.flatnonzero(place % fanout == 0)
        stop = np.r_[first[1:], len(place)]
        both = np.bitwise_and.reduceat(level["bits"], first)
        some = np.bitwise_or.reduceat(level["bits"], first)
        mask = np.bitwise_and.reduceat(level["mask"], first) & ~(both ^ some)
        return {"root": level["root"][first], "mask": mask, "bits": both & mask, "first": first, "stop": stop,
                "leaf": level["leaf"][first], "end": level["end"][stop - 1]}

    def joined(self, distance=DISTANCE):
        """For every leaf the first leaf of its tree that links within ``distance`` reach."""
        label = np.arange(len(self.values))
        sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, self.leaf_root[1:] != self.leaf_root[:-1]]), len(label)])
        cost = np.cumsum(np.repeat(sizes, sizes))
        start = 0
        top = np.repeat(np.arange(len(sizes)), sizes)  # the topmost level has one node a root
        while start < len(label):
            stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + FRONTIER)))
            self.search(np.arange(start, stop), top[start:stop], label, distance)
            start = stop
        return label

    def search(self, query, node, label, distance):
        spent = np.zeros(len(query), np.int64)
        for depth, level in enumerate(self.levels):
            spent = spent + np.bitwise_count((self.values[query] ^ level["bits"][node]) & level["rest"][node])
            # whole groups beyond the distance, or wholly before the query, are pruned
            near = (spent <= distance) & (level["end"][node] > query + 1)
            # a group that is one component with the query already has nothing to add
            low, high = self.spread(label, level)
            near &= ~((low[node] == high[node]) & (low[node] == label[query]))
            query, node, spent = query[near], node[near], spent[near]
            taken = spent + 64 - np.bitwise_count(level["mask"][node]) <= distance
            if taken.any():  # every bit pattern below is near enough
                self.link(label, *self.leaves(level, query[taken], node[taken]))
            if depth + 1 == len(self.levels):
                break
            query, node, spent = query[~taken], node[~taken], spent[~taken]
            many = level["stop"][node] - level["first"][node]
            query, spent = np.repeat(query, many), np.repeat(spent, many)
            node = np.repeat(level["first"][node] - np.cumsum(many) + many, many) + np.arange(len(query))

    @staticmethod
    def spread(label, level):
        return np.minimum.reduceat(label, level["leaf"]), np.maximum.reduceat(label, level["leaf"])

    @staticmethod
    def leaves(level, query, node):
        # the first leaf stands for the node; its other leaves are near it or reached by the query as well
        many = level["end"][node] - level["leaf"][node]
        leaf = np.repeat(level["leaf"][node] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(query, many), leaf

    @staticmethod
    def link(label, a, b):
        """Joins the components of a and b; labels stay flat, each the least leaf of its component."""
        while True:
            one, other = label[a], label[b]
            differ = one != other
            if not differ.any():
                return
            a, b, one, other = a[differ], b[differ], one[differ], other[differ]
            np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
            while True:
                further = label[label]
                if (further == label).all():
                    break
                label[:] = further


def links(prints, crowded=CROWDED):
    """Links (a, b) between different fingerprints of ``fp``; their components are those of all pairs within 3 bits."""
    first, longer = masks(2)

    def filed(df, mask_of):
        return df.select("fp", F.explode(mask_of).alias("mask")).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))

    def array(values):
        return F.array(*[F.lit(signed(m)) for m in values])

    rows = filed(prints.select("fp"), array(first))
    for _ in range(2):
        # stored, so that the rows of a crowded root can be split where these are joined
        full = rows.groupBy("mask", "bits").count().where(F.col("count") > crowded).select("mask", "bits", F.lit(True).alias("full"))
        full = stored(full, "crowded")
        rows = rows.join(full, ["mask", "bits"], "left")
        known = F.create_map(*[x for mask, more in longer.items() for x in (F.lit(signed(mask)), array(more))])
        rows = filed(rows, F.when(F.col("full") & F.col("mask").isin([signed(m) for m in longer]), known[F.col("mask")])
                     .otherwise(F.array("mask")))

    def run(batches):
        held = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for b in batches if b.num_rows]
        if not held:
            return
        mask, bits, fp = (np.concatenate(x) for x in zip(*held))
        del held
        # roots by number; those with one fingerprint have nothing to link
        order = np.lexsort((bits, mask))
        new = np.r_[True, (mask[order][1:] != mask[order][:-1]) | (bits[order][1:] != bits[order][:-1])]
        root = np.cumsum(new) - 1
        shared = np.bincount(root)[root] > 1
        if not shared.any():
            return
        forest = Forest(root[shared], fp[order][shared].view(np.uint64))
        label = forest.joined()
        at = np.flatnonzero(label != np.arange(len(label)))
        values = forest.values.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(values[label[at]]), pa.array(values[at])], names=["a", "b"])

    # no number: adaptive execution chooses it by size; a root stays within one task
    return rows.select("mask", "bits", "fp").repartition("mask", "bits").mapInArrow(run, "a long, b long")


def near_duplicates(docs, text="text", doc="doc_id", keep=(), crowded=CROWDED):
    """(doc, *keep, fp, component, component_id) for every row.

    ``component`` is the least fingerprint and ``component_id`` the least id
    that links of 3 bits or fewer reach.
    """
    columns = [doc, *keep]
    prints = stored(fingerprints(docs, text, columns), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min(doc).alias("least")), "classes")
    found = components(links(classes, crowded))
    grouped = classes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    names = stored(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "names")
    of_print = grouped.join(names, "component").select("fp", "component", "component_id")
    return prints.join(of_print, "fp").select(*columns, "fp", "component", "component_id")


def one_of_each(docs, text="text", doc="doc_id", crowded=CROWDED):
    """One row of each component of near duplicates, with all its columns: the one with the least id, then text hash."""
    key = F.xxhash64(F.col(text).cast("string"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc).alias("doc"), key.alias("key"))
    found = near_duplicates(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), key.alias("key")), "text", "doc", ["key"], crowded)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "key")).alias("first")).select(
        F.col("first.doc").alias("d"), F.col("first.key").alias("k"))
    stay = rows.join(first, F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi")
    # rows with one id and one text are one row
    return stay.groupBy("doc", "key").agg(F.first("row").alias("row")).select("row.*")
