"""Suffix-array dedup: every byte covered by a string of ``width`` bytes that starts anywhere else goes.

Each string of ``width`` bytes (a window) is known by its anchor, the least hash of the short grams inside it: equal windows
have equal anchors, wherever they stand. Consecutive windows of one anchor make a segment, a few hundred bytes long.

1. Segments of all texts, as (anchor, digest of the segment, digest of the text, place), are counted: an anchor seen once,
   at one place, holds nothing twice; a segment seen twice is repeated as a whole. Neither needs its text again.
2. What is left are anchors that different segments share. Two of them share a window only if they agree in the bytes before
   the anchor or in those behind it; the others go by short hashes of both.
3. One copy of each remaining segment, cut from one copy of a text, goes to a shard by its anchor; a shard's suffix array is
   induced, and permuted common prefixes of ``width`` or more mark the repeated windows.
4. Segments of an anchor that more than ``MOST_SEGMENTS`` share (a passage inside thousands of texts) are dealt on: windows
   that have equal anchors in both halves, then in all quarters, and so on down to windows of equal grams, are segments
   again, which take the same steps. So each shard stays small, and suffix arrays decide there, too.
5. The marked windows go back to the texts by segment and then by text.

Segments and texts are compared by digests of 128 bits. Copies count in every step but are carried once; lost tasks are
computed again from written tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import textops
from strata.llm.sketch import Bloom
from strata.llm.storage import materialise
from strata.llm.suffixes import permuted_prefixes, suffix_array

WIDTH = 400
#: Bytes of a gram: 8 or 16.
GRAM = 16
#: Windows in a segment, at most: longer runs of one anchor (periodic text) are cut.
LONGEST = 512
#: Different segments of one anchor that go to one shard, and segment bytes that one suffix array holds, about.
MOST_SEGMENTS = 2000
SHARD_BYTES = 2 << 20
_P1, _P2, _P3 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SEGMENTS = "h long, d binary, t binary, s int, n int, z boolean, l int, r int"


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - w + 1
    return np.minimum(back[:m], ahead[w - 1 : w - 1 + m])


def levels(width: int, gram: int) -> list[list[tuple[int, int]]]:
    """Blocks (offset, length) of a window whose anchors name it: the window, its halves, and so on; last its grams."""
    out, n = [], 1
    while width // n >= 2 * gram:
        out.append([(i * (width // n), width // n) for i in range(n)])
        n *= 2
    return [*out, [(min(i, width - gram), gram) for i in range(0, width, gram)]]


def segments(data: np.ndarray, offsets: np.ndarray, width: int, gram: int, blocks: list[tuple[int, int]]):
    """(row, start, windows, key, twice, place) of every segment; start and place are places in ``data``.

    key: the anchors of the blocks, hashed together. twice: the first block's anchor stands at several places of the
    segment, so that windows of one segment may be equal, and equal windows of two may have different places. place: one
    place where it stands.
    """
    n, none = len(data), np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none.view(np.uint64), none.astype(bool), none
    pad = np.concatenate([data, np.zeros(24, np.uint8)])
    u64 = np.ndarray((n + 16,), "<u8", pad, strides=(1,))
    with np.errstate(over="ignore"):
        x = u64[: n - gram + 1] * _P1
        x ^= x >> np.uint64(29)
        if gram == 16:
            x += u64[8 : n - gram + 9] * _P2
        x ^= x >> np.uint64(32)
        x *= _P3
        x ^= x >> np.uint64(31)
        # The low bits of a gram's hash give way to its place: the least one then says where it stands.
        bits = np.uint64(width.bit_length())
        places = np.uint64((1 << width.bit_length()) - 1)
        x &= ~places
        x |= np.arange(len(x), dtype=np.uint64) & places
        m, least, key = n - width + 1, None, None
        by_length: dict[int, np.ndarray] = {}
        for offset, length in blocks:
            if length not in by_length:
                by_length[length] = _sliding_min(x, length - gram + 1)
            anchor = by_length[length][offset : offset + m]
            least = anchor if least is None else least
            key = anchor >> bits if key is None else (key ^ (key >> np.uint64(29))) * _P2 + (anchor >> bits)
    anchor = least >> bits
    begin, stop = offsets[:-1], offsets[1:] - width + 1
    filled = np.flatnonzero(stop > begin)
    edge = np.zeros(m + 1, np.int8)
    edge[begin[filled]] += 1
    edge[stop[filled]] -= 1
    inside = np.cumsum(edge[:m]).astype(bool)
    first = np.empty(m, bool)
    first[0] = True
    first[1:] = key[1:] != key[:-1]
    first[begin[filled]] = True
    start = np.flatnonzero(first & inside)
    row = np.searchsorted(offsets, start, "right") - 1
    count = np.minimum(np.r_[start[1:], m], stop[row]) - start
    pieces = -(-count // LONGEST)
    own = np.repeat(np.arange(len(start)), pieces)
    k = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = start[own] + k * LONGEST
    count = np.minimum(count[own] - k * LONGEST, LONGEST)
    last = start + count - 1
    place = last + ((least[last] & places).astype(np.int64) - last & int(places))
    # Of places whose hashes are equal the least one by ``bits`` was taken, which is not the same one in equal windows. So
    # look for the anchor before and behind its place, in the first blocks of all windows of the segment.
    twice = np.zeros(len(start), bool)
    stop = last + blocks[0][1] - gram + 1
    x >>= bits
    for lo, hi in ((start, place), (place + 1, stop)):
        some = np.flatnonzero(hi > lo)
        if len(some):
            inner = np.minimum.reduceat(x, np.stack([lo[some], np.minimum(hi[some], len(x) - 1)], 1).ravel())[::2]
            inner = np.where(hi[some] == len(x), np.minimum(inner, x[-1]), inner)
            twice[some] |= inner == anchor[last[some]]
    return row[own], start, count, key[start], twice, place


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digests of slices."""
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
    return np.array([digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())], np.uint64)


def _wide_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """128-bit digests of slices."""
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    return pa.array([digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())], pa.binary())


def _beside(data: np.ndarray, start: np.ndarray, end: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """31-bit hashes of slices, -1 where they are not ``ok``."""
    out = np.full(len(start), -1, np.int32)
    out[ok] = (_digests(data, start[ok], end[ok]) >> np.uint64(33)).astype(np.int32)
    return out


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.r_[False, mark, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _marks_of(mark: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """For each slice of ``mark``: its runs as pairs of 32-bit integers; null if there is none."""
    out: list[bytes | None] = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        lo, hi = _runs(mark[a:b])
        out.append(np.stack([lo, hi], 1).astype("<i4").tobytes() if len(lo) else None)
    return out


def repeated_windows(texts: list[bytes], width: int) -> list[bytes | None]:
    """For each text: the runs of windows that stand elsewhere in these texts, too."""
    size = np.array([len(t) for t in texts], np.int64)
    bounds = np.r_[0, np.cumsum(size + 1)]
    joined = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int64) + 1
    joined[bounds[1:] - 1] = 0  # ends of texts; no byte is like them
    sa = suffix_array(joined, 257)
    prefix, phi = permuted_prefixes(joined, sa)
    left = np.repeat(bounds[1:] - 1, size + 1) - np.arange(len(joined))  # bytes up to the end of the text
    near = np.flatnonzero((np.minimum(prefix, left) >= width) & (phi >= 0))
    mark = np.zeros(len(joined), bool)
    mark[near] = True
    mark[phi[near]] = True  # it shares its first ``width`` bytes with the other, so they lie inside its own text
    return _marks_of(mark, bounds)


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str], most: int, size: int):
    """Whole lists of rows with about ``most`` bytes of column ``size``, never parting equal values of the first column."""
    held, total = [], 0
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in columns)):
            if total >= most and held[-1][0] != r[0]:
                yield held
                held, total = [], 0
            held.append(r)
            total += len(r[size])
    if held:
        yield held


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")


def _scan(rows: DataFrame, width: int, gram: int, level: int) -> DataFrame:
    """Segments (with c: how often they stand there) of the rows (t, text): what they are named by, and where they stand."""
    blocks, named = levels(width, gram)[level], "t" in rows.columns
    before = (width - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches, "text"):
            data, offsets = textops.text_bytes(batch.column("text"))
            row, start, count, key, twice, place = segments(data, offsets, width, gram, blocks)
            end = start + count - 1 + width
            if named:
                text = batch.column("t")
            else:
                view = memoryview(np.ascontiguousarray(data))
                text = pa.array([hashlib.md5(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())
            # A shared window holds its anchor and all bytes of one of these two sides of it. Copies of a segment have equal
            # sides: those with two places for its anchor have none.
            sided = ~twice if not level else np.zeros(len(start), bool)
            left = _beside(data, place - before, place, sided & (place - before >= start))
            right = _beside(data, place, place + width - before, sided & (place + width - before <= end))
            cols = [pa.array(key.view(np.int64)), _wide_digests(data, start, end), text.take(pa.array(row))]
            cols += [pa.array((start - offsets[row]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(twice), pa.array(left), pa.array(right)]
            yield pa.RecordBatch.from_arrays(cols, ["h", "d", "t", "s", "n", "z", "l", "r"])

    found = rows.mapInArrow(run, _SEGMENTS)
    return materialise(found.groupBy("h", "d", "t", "s", "n", "z", "l", "r").agg(F.count(F.lit(1)).alias("c")), "segments")


def _one_of_each(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(t, text): one copy of each text of ``docs`` whose digest t is in ``wanted``."""
    keys = materialise(wanted.select("t", F.xxhash64("t").alias("k")), "wanted")
    passes = docs.sparkSession.sparkContext.broadcast(Bloom.of(keys, "k"))

    @F.pandas_udf("boolean")
    def maybe(k: pd.Series) -> pd.Series:
        return pd.Series(passes.value.has(k.to_numpy(np.int64)))

    rows = docs.select(F.unhex(F.md5("text")).alias("t"), "text").where(maybe(F.xxhash64("t")))
    rows = rows.groupBy("t").agg(F.first("text").cast("binary").alias("text"))
    return materialise(rows.join(keys.select("t"), "t", "left_semi"), "texts")


def _spans(found: DataFrame, texts: Callable[[DataFrame], DataFrame], width: int, gram: int, most: int, level: int) -> tuple[DataFrame, DataFrame]:
    """(t, spans) for texts with repeated windows, and the texts that were looked at.

    found: all segments. texts: gives (t, text) for digests of texts. spans: places of segments and the runs of their
    windows that are repeated (null: all).
    """
    by_segment = materialise(found.groupBy("h", "d", "z", "l", "r").agg(F.sum("c").alias("c")), "kinds")
    by_anchor = by_segment.groupBy("h").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"), F.max("z").alias("self"))
    by_anchor = materialise(by_anchor.where("total > 1 or self"), "anchors")  # tables of their own: skewed joins may be split
    again = materialise(by_segment.join(by_anchor, "h").withColumn("mixed", F.col("self") | (F.col("kinds") > 1)), "again")
    mixed = again.where("mixed")
    if not level:
        sides = [mixed.where(f"not self and {c} >= 0").groupBy("h", F.col(c).alias("v"), F.lit(c).alias("side")).agg(F.count(F.lit(1)).alias("k")) for c in "lr"]
        sides = materialise(sides[0].unionByName(sides[1]).where("k > 1").select("h", "v", "side"), "sides")
        for c in "lr":
            side = sides.where(F.col("side") == c).select("h", F.col("v").alias(c), F.lit(True).alias(f"same_{c}"))
            mixed = mixed.join(side, ["h", c], "left")
        mixed = mixed.where("self or same_l or same_r")
    mixed = materialise(mixed.select("h", "d", "c"), "mixed")
    hot = materialise(mixed.groupBy("h").count().where(F.col("count") > most).select("h"), "hot")

    whole = again.where("c > 1 and not mixed").select("h", "d", F.lit(True).alias("whole"), F.lit(False).alias("dealt"))
    kinds = whole.unionByName(mixed.select("h", "d", (F.col("c") > 1).alias("whole"), F.lit(True).alias("dealt")))
    rest = again.where("c > 1 and mixed").select("h", "d", F.lit(True).alias("whole"), F.lit(False).alias("dealt")) if not level else None
    if rest is not None:  # stand twice, but share no part with the other segments of their anchor
        kinds = kinds.unionByName(rest.join(mixed.select("h", "d"), ["h", "d"], "left_anti"))
    places = materialise(found.select("h", "d", "t", "s", "n").join(kinds, ["h", "d"]), "places")
    pool = texts(places.select("t").distinct())

    one = places.where("dealt").groupBy("h", "d").agg(F.min(F.struct("t", "s", "n")).alias("x"))
    one = one.groupBy("x.t").agg(F.collect_list(F.struct("h", "d", "x.s", "x.n")).alias("x"))  # at most the segments of a text

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, x in zip(batch.column("text"), batch.column("x").to_pylist()):
                text = text.as_py()
                cols = [[y["h"] for y in x], [y["d"] for y in x], [text[y["s"] : y["s"] + y["n"] - 1 + width] for y in x]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary()))], ["h", "d", "text"])

    shipped = materialise(one.join(pool, "t").select("text", "x").mapInArrow(ship, "h long, d binary, text binary"), "shipped")
    deeper = level + 1 < len(levels(width, gram)) and hot.limit(1).count() > 0
    cold = shipped.join(hot, "h", "left_anti") if deeper else shipped
    shards = max(1, -(-(cold.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches, ["h", "d", "text"], SHARD_BYTES, 2):
            runs = repeated_windows([r[2] for r in rows], width)
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.binary()), pa.array(runs, pa.binary())], ["d", "runs"])

    dealt = cold.repartition(min(shards, 20_000), "h").sortWithinPartitions("h")
    marked = dealt.mapInArrow(induce, "d binary, runs binary").where("runs is not null")
    if deeper:
        rows = materialise(shipped.join(hot, "h", "left_semi").select(F.col("d").alias("t"), "text"), "dealt")
        below, _ = _spans(_scan(rows, width, gram, level + 1), lambda wanted: rows, width, gram, most, level + 1)

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                runs = [np.array(_windows(x), "<i4").tobytes() for x in batch.column("spans").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(runs, pa.binary())], ["d", "runs"])

        marked = marked.unionByName(below.mapInArrow(name, "d binary, runs binary"))
    # A segment's digest is that of all its bytes, so it has one anchor. Segments that stand twice are repeated as a whole.
    marked = materialise(marked, "marked")
    hits = places.join(marked, "d", "left").where("whole or runs is not null")
    runs = F.when(~F.col("whole"), F.col("runs"))
    return hits.groupBy("t").agg(F.collect_list(F.struct("s", "n", runs.alias("runs"))).alias("spans")), pool


def _windows(spans: list[dict]) -> list[tuple[int, int]]:
    """Runs of repeated windows, by their places in the text."""
    out = []
    for x in spans:
        runs = [(0, x["n"])] if x["runs"] is None else np.frombuffer(x["runs"], "<i4").reshape(-1, 2).tolist()
        out += [(x["s"] + a, x["s"] + b) for a, b in runs]
    return sorted(out)


def _removed(n: int, spans: list[dict], width: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that repeated windows cover."""
    edge = np.zeros(n + 1, np.int64)
    for a, b in _windows(spans):
        edge[a] += 1
        edge[b - 1 + width] -= 1
    lo, hi = _runs(np.cumsum(edge[:n]) > 0)
    return list(zip(lo.tolist(), hi.tolist()))


def drop_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most: int = MOST_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept for every row of ``docs``.

    kept (binary, null if it is the whole text) is what remains. Texts are UTF-8 bytes, null is empty. Strings are judged
    on the input: copies all lose what they share, the first one too, so of a text that stands twice (repeated rows
    included) nothing of ``width`` bytes or more stays. Shorter texts stay. Null doc_ids are judged like any other; an
    empty table gives no rows; columns other than doc_id and text are ignored.
    """
    texts = _texts(docs)
    found = _scan(texts.select("text"), width, gram, 0)
    spans, pool = _spans(found, lambda wanted: _one_of_each(texts, wanted), width, gram, most, 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, count, sha, kept = [], [], [], []
            for text, x in zip(batch.column("text"), batch.column("spans").to_pylist()):
                text = text.as_py()
                gone = _removed(len(text), x, width)
                edges = [0, *(e for g in gone for e in g), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                removed.append(sum(b - a for a, b in gone))
                count.append(len(gone))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            cols = [batch.column("t"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["t", "n_removed", "n_spans", "rest", "kept"])

    # Each different text is cut once; its copies (a third of all rows, maybe) meet the result in a join that may be split.
    cuts = pool.join(spans, "t").select("t", "text", "spans")
    cuts = materialise(cuts.mapInArrow(cut, "t binary, n_removed long, n_spans long, rest string, kept binary"), "cuts")
    rows = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("full"), F.unhex(F.md5("text")).alias("t"))
    none = F.lit(0).cast("long")
    return rows.join(cuts, "t", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("rest", "full").alias("kept_sha256"),
        "kept",
    )
