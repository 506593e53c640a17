"""SimHash near-dedup by a binary trie self-join.

Fingerprints are computed in Arrow batches; only distinct ones are joined. The trie is cut at its top: for every choice
of blocks that two fingerprints within the budget must share, the fingerprints are dealt by those blocks' bits, so each
pair within the budget meets below at least one such subtrie root. A subtrie with more than ``TILE`` fingerprints is dealt
further into chunks, and each pair of chunks is a task's work of its own. Below the root, node pairs are traversed
together: differing bits add up, and a pair of nodes is pruned when they exceed the budget, or when all that lies below
both is known to be linked already. What leaves a task is a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm import textops
from strata.llm.components import components
from strata.llm.sketch import Bloom
from strata.llm.storage import materialise
from strata.llm.textops import unused

BUDGET = 3
#: Fingerprints in one side of a task's join; a subtrie beyond it is dealt to pairs of chunks.
TILE = 8192
#: Node pairs that are traversed at once, and rows that a task gathers before it joins what it has.
FRONTIER = 1 << 17
FLUSH = 1 << 18
#: Up to so many fingerprints for each key of a cut before the next cut, with more bits and copies, is taken.
PER_KEY = 4096
#: Shingles that are hashed and counted at once, also those of one very long text.
SLICE = 1 << 15


def simhash_batch(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """64-bit fingerprints of a string column."""
    data, offsets = textops.text_bytes(column)
    rows = len(column)
    data = textops.LOWER[data]
    start, end, row = textops.words(data, offsets, textops.NOT_SPACE)
    out = np.zeros(rows, np.uint64)
    if not len(start):
        return out
    keep = textops.NOT_SPACE[data]
    spaced = end[end < len(data)]
    spaced = spaced[~keep[spaced]]
    keep[spaced] = True
    data[spaced] = 0x20
    at = np.cumsum(keep, dtype=np.int64)
    start, end = at[start] - 1, at[end - 1]
    data = data[keep]
    del keep, at

    bounds = textops.group_starts(row, rows)
    count = np.diff(bounds)
    each = np.maximum(count - shingle + 1, np.minimum(count, 1))  # shingles of a row
    first = np.cumsum(each) - each
    filled = np.flatnonzero(each)
    votes = np.zeros((rows, 64), np.int64)
    for lo in range(0, int(each.sum()), SLICE):
        k = np.arange(lo, min(lo + SLICE, int(each.sum())))
        owner = filled[np.searchsorted(first[filled], k, "right") - 1]
        head = k - first[owner] + bounds[owner]
        tail = np.minimum(head + shingle, bounds[owner + 1]) - 1
        base = start[head[0]]
        h = textops.xxh64(data[base : end[tail].max()], start[head] - base, end[tail] - start[head])
        new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes[owner[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    majority = votes[filled] * 2 > each[filled, None]
    out[filled] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, carry: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, fp) for every row; ``carry``: names and SQL of strings that go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches, "text"):
            fp = simhash_batch(batch.column("text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], [*batch.schema.names[:-1], "fp"])

    more = [F.expr(sql).alias(c) for c, sql in (carry or {}).items()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + "".join(f"{c} string, " for c in carry or {}) + "fp long")


# ---------------------------------------------------------------------------------------------- the trie self-join


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least index of each linked set) after linking a[i] with b[i]."""
    label = _roots(label)
    while True:
        x, y = label[a], label[b]
        live = x != y
        if not live.any():
            return label
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        label = _roots(label)


def join_subtries(fp: np.ndarray, roots: np.ndarray, depth: int, budget: int, label: np.ndarray) -> np.ndarray:
    """Link all pairs below pairs of subtrie roots that differ in ``budget`` bits at most.

    fp: fingerprints whose leading ``depth`` bits are the root's, ascending within each root. roots: rows (from, to,
    from, to) of index ranges; a root paired with itself has both ranges equal. label: links so far, by index.
    """
    n = len(fp)
    ones: dict[int, np.ndarray] = {}

    def split(d: int) -> np.ndarray:
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((fp >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)])
        return ones[d]

    stack = [(depth, part, np.zeros(len(part), np.int8)) for part in np.array_split(roots, max(1, len(roots) // FRONTIER + 1)) if len(part)]
    changes = np.zeros(n + 1, np.int64)
    while stack:
        d, node, cost = stack.pop()
        al, ah, bl, bh = node.T
        changes[1:n] = np.cumsum(label[1:] != label[:-1]) if n > 1 else 0
        flat = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (label[al] == label[bl])
        node, cost = node[~flat], cost[~flat]
        al, ah, bl, bh = node.T
        work = (ah - al) * (bh - bl)
        leaf = (work <= 64) | (d == 64)
        if leaf.any():
            l, w = node[leaf], work[leaf]
            for part in np.array_split(np.arange(len(l)), int(w.sum()) // (1 << 20) + 1):
                if not len(part):
                    continue
                own = np.repeat(part, w[part])
                k = np.arange(len(own)) - np.repeat(np.cumsum(w[part]) - w[part], w[part])
                wide = l[own, 3] - l[own, 2]
                x, y = l[own, 0] + k // wide, l[own, 2] + k % wide
                near = (np.bitwise_count(fp[x] ^ fp[y]) <= budget) & (x != y) & (label[x] != label[y])
                if near.any():
                    label = union(label, x[near], y[near])
        node, cost = node[~leaf], cost[~leaf]
        if not len(node):
            continue
        al, ah, bl, bh = node.T
        c = split(d)
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        same = (al == bl) & (ah == bh)
        kids = [
            (np.stack([al, am, bl, bm], 1), cost, np.ones(len(al), bool)),
            (np.stack([am, ah, bm, bh], 1), cost, np.ones(len(al), bool)),
            (np.stack([al, am, bm, bh], 1), cost + 1, np.ones(len(al), bool)),
            (np.stack([am, ah, bl, bm], 1), cost + 1, ~same),
        ]
        node = np.concatenate([k[0][k[2]] for k in kids])
        cost = np.concatenate([k[1][k[2]] for k in kids])
        fit = (cost <= budget) & (node[:, 1] > node[:, 0]) & (node[:, 3] > node[:, 2])
        node, cost = node[fit], cost[fit]
        # Pairs of a node with itself come off the stack first: what they link prunes the others.
        order = np.argsort(node[:, 0] == node[:, 2], kind="stable")
        for part in np.array_split(order, len(order) // FRONTIER + 1):
            if len(part):
                stack.append((d + 1, node[part], cost[part]))
    return _roots(label)


def _cut(n: int, budget: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Widths of the blocks, and the choices of blocks of which every pair within the budget shares one."""
    for blocks in range(budget + 1, 64):
        widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
        choices = list(combinations(range(blocks), blocks - budget))
        bits = min(sum(widths[i] for i in c) for c in choices)
        if n <= PER_KEY << bits or blocks >= budget + 3:
            return widths, choices
    raise AssertionError


def _permuted(fp: np.ndarray, widths: list[int], choice: tuple[int, ...]) -> np.ndarray:
    """The bits of the chosen blocks first, then the others."""
    begins = np.cumsum([0, *widths])
    out, used = np.zeros_like(fp), 0
    for i in [*choice, *(j for j in range(len(widths)) if j not in choice)]:
        w = widths[i]
        block = (fp >> np.uint64(64 - begins[i] - w)) & np.uint64((1 << w) - 1)
        used += w
        out |= block << np.uint64(64 - used)
    return out


def _key(widths: list[int], choice: tuple[int, ...]) -> Column:
    begins = [sum(widths[:i]) for i in range(len(widths) + 1)]
    out = F.lit(0).cast("long")
    for i in choice:
        part = F.shiftrightunsigned("fp", 64 - begins[i] - widths[i]).bitwiseAND(F.lit((1 << widths[i]) - 1).cast("long"))
        out = F.shiftleft(out, widths[i]).bitwiseOR(part)
    return out


def near_links(distinct: DataFrame, n: int, budget: int = BUDGET, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect the ``n`` distinct fingerprints (column fp) of every group within the budget."""
    widths, choices = _cut(n, budget)
    keys = F.array(*[F.struct(F.lit(i).alias("c"), _key(widths, ch).alias("k")) for i, ch in enumerate(choices)])
    dealt = distinct.select("fp", F.explode(keys).alias("x")).select("fp", "x.c", "x.k")
    # Subtries too large for one task: how many chunks each gets. At most choices * n / tile rows, small against n.
    large = dealt.groupBy("c", "k").count().where(F.col("count") > tile)
    large = large.select("c", "k", F.ceil(F.col("count") / tile).cast("int").alias("m"))
    dealt = dealt.join(large, ["c", "k"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("m") - 1),
        lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")),
    )
    dealt = dealt.withColumn("mine", mine).withColumn("t", F.explode(others))
    dealt = dealt.select("c", "k", "t.i", "t.j", (F.col("mine") == F.col("t.i")).alias("first"), "fp")
    tiled = dealt.repartition("c", "k", "i", "j").sortWithinPartitions("c", "k", "i", "j")

    def link(c: np.ndarray, key: np.ndarray, first: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """Links of whole tiles; key numbers the tiles."""
        label = np.arange(len(fp))
        names, back = np.unique(fp, return_inverse=True)
        joined = np.arange(len(names))
        for i, choice in enumerate(choices):
            at = np.flatnonzero(c == i)
            if not len(at):
                continue
            turned = _permuted(fp[at], widths, choice)
            order = np.lexsort((turned, ~first[at], key[at]))
            at, turned = at[order], turned[order]
            tile_no, side = key[at], first[at]
            cut = np.flatnonzero(np.r_[True, (tile_no[1:] != tile_no[:-1]) | (side[1:] != side[:-1])])
            lo, hi = cut, np.r_[cut[1:], len(at)]
            # A tile of two chunks has two ranges next to each other; a tile of one chunk has one.
            two = np.r_[tile_no[lo[1:]] == tile_no[lo[:-1]], False] if len(lo) > 1 else np.zeros(len(lo), bool)
            second = np.r_[False, two[:-1]]
            nxt = np.minimum(np.arange(len(lo)) + two, len(lo) - 1)
            pairs = np.stack([lo, hi, lo[nxt], hi[nxt]], 1)[~second]
            depth = sum(widths[b] for b in choice)
            label = join_subtries(turned, pairs, depth, budget, np.arange(len(at)))
            joined = union(joined, back[at], back[at[label]])
        far = np.flatnonzero(joined != np.arange(len(names)))
        a, b = names[far].view(np.int64), names[joined[far]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("c", "k", "i", "j", "first", "fp")]
            held.append(cols)
            rows += batch.num_rows
            if rows >= FLUSH:
                c, k, i, j, first, fp = (np.concatenate(x) for x in zip(*held))
                new = np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
                last = np.flatnonzero(new)[-1]  # this tile may go on in the next batch
                if last:
                    yield link(c[:last], np.cumsum(new)[:last], first[:last], fp[:last].view(np.uint64))
                held = [[x[last:] for x in (c, k, i, j, first, fp)]]
                rows = len(c) - last
        if held:
            c, k, i, j, first, fp = (np.concatenate(x) for x in zip(*held))
            new = np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            yield link(c, np.cumsum(new), first, fp.view(np.uint64))

    return tiled.mapInArrow(run, "a long, b long")


def _rooted(base: DataFrame, budget: int, tile: int) -> DataFrame:
    """(fp, least, n, root) for every different fingerprint of ``base``: its least doc_id, its rows, the least linked one."""
    distinct = materialise(base.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    linked = components(near_links(distinct.select("fp"), distinct.count(), budget, tile))
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left")
    return materialise(rooted.select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted")


def simhash_components(docs: DataFrame, shingle: int = 3, budget: int = BUDGET, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``.

    Texts are lower-cased (A-Z), cut into words [^\\x20\\x09-\\x0D]+ and ``shingle``-word shingles, repeats included; a
    shorter text is one shingle, a text without words (null too) has fingerprint zero and is linked like any other.
    component_id: the smallest doc_id that links of ``budget`` or fewer differing bits reach (null if the component has
    only null ids). Repeated rows each come out; an empty table gives no rows; other columns are ignored.
    """
    base = materialise(fingerprints(docs, shingle), "fingerprints")
    rooted = _rooted(base, budget, tile)
    # A written table: a large component's rows are then a join's alone, which adaptive execution may split.
    heads = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "heads")
    named = rooted.join(heads, "root").select("fp", "component_id")
    out = base.join(named, "fp")  # rows of one frequent fingerprint are split by the adaptive join: each has one partner
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` that stay when of each component one row does, with the columns of ``docs``.

    It is that of the smallest doc_id (null after all others), of several texts under that doc_id the one of the least
    MD5, of rows that repeat both the one with the least checksum of all columns. So rows that share a doc_id are judged
    each by its own text, reruns agree, and null and empty texts are a group like any other. An empty table gives no
    rows. Rows that a filter of bounded size knows as no one's copy stay without a shuffle.
    """
    base = materialise(fingerprints(docs, shingle, {"t": "md5(coalesce(cast(text as string), ''))"}), "fingerprints")
    rooted = _rooted(base, budget, TILE)
    crowds = materialise(rooted.groupBy("root").agg(F.sum("n").alias("rows")).where("rows > 1"), "crowds")
    crowded = base.join(rooted.join(crowds, "root").select("fp", "root"), "fp")
    texts = materialise(crowded.groupBy("root", "doc_id", "t").agg(F.count(F.lit(1)).alias("n")), "copies")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t")
    first = materialise(texts.groupBy("root").agg(F.min(place).alias("first")), "first")
    judged = texts.join(first, "root").select(
        F.xxhash64("doc_id", "t").alias("h"), "doc_id", "t", (place == F.col("first")).alias("stays"), "n"
    )
    judged = materialise(judged.where("n > 1 or not stays"), "judged")
    passes = docs.sparkSession.sparkContext.broadcast(Bloom.of(judged, "h"))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(passes.value.has(h.to_numpy(np.int64)))

    key, text, stays = unused(docs.columns, "doc_id", "text", "stays")
    keyed = docs.withColumns({key: F.col("doc_id").cast("long"), text: F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    near = maybe(F.xxhash64(F.col(key), F.col(text)))
    other = keyed.where(near).join(judged, F.col(key).eqNullSafe(judged["doc_id"]) & (F.col(text) == judged["t"]), "left")
    other = other.where(judged["stays"].isNull() | judged["stays"]).select(*[keyed[f"`{c}`"] for c in keyed.columns], judged["stays"].alias(stays))
    names = [F.col(f"`{c}`") for c in docs.columns]
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    once = other.where(F.col(stays)).groupBy(key, text).agg(F.min_by(F.struct(*names), order).alias(stays))
    once = once.select(*[F.col(stays)[c].alias(c) for c in docs.columns])
    return keyed.where(~near).select(*names).unionByName(other.where(F.col(stays).isNull()).select(*names)).unionByName(once)
