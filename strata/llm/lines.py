"""Line dedup by a segment-partition edit join.

A line is cut into one segment more than the edits that it may differ by, so that a line within that distance holds one of
its segments unchanged, near the same place. Each line files its segments under (length, number, content) and probes,
for each length that a partner may have, the few substrings that multi-match-aware selection leaves. Lines that meet
are verified by banded bit-parallel edit distance, many pairs at once.

1. One scan hashes all segments and substrings and keeps, for each hash, whether different lines meet there.
2. A second scan lets through what meets: those lines, once each, and their hashes.
3. Meeting lines are joined by hash. A hash under which more than ``TILE`` lines meet is dealt to pairs of chunks; what
   leaves a task is a spanning forest of its links and how many links each line has, never all pairs. Two lines that
   meet under several hashes are counted under the least of them.
4. Linked lines are classes; the first line of a class stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import textops
from strata.llm.components import components
from strata.llm.repeats import _wide_digests
from strata.llm.simhash import union
from strata.llm.sketch import Bloom
from strata.llm.storage import materialise

#: Two lines are linked at so many edits of bytes, but at one at most for each FIFTH bytes of the longer: similarity 0.8
#: in lines below 15 bytes, and more in longer ones, where most near-equal lines stay unlinked (README).
EDITS, FIFTH = 2, 5
#: Lines of a hash that one task compares with each other.
TILE = 512
#: Text bytes of meeting lines that a task holds at once.
HOLD_BYTES = 16 << 20
_POWER = 0x5851F42D4C957F2D
_MIX = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def limit(length: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """Edits that a line of this length and a shorter one may differ by."""
    return np.minimum(edits, length // FIFTH)


def _cuts(length: np.ndarray, edits: int) -> np.ndarray:
    """Segments of a line: one more than the edits to any partner that is not shorter."""
    out = np.zeros_like(length)
    for more in range(edits + 1):
        t = limit(length + more, edits)
        out = np.maximum(out, np.where(t >= more, t, 0))
    return out + 1


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        with np.errstate(over="ignore"):
            for i, x in enumerate((_POWER, pow(_POWER, -1, 1 << 64))):
                steps = np.full(n + 1, np.uint64(x))
                steps[0] = 1
                _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def line_keys(data: np.ndarray, start: np.ndarray, size: np.ndarray, edits: int = EDITS):
    """(line, key, filed) of all segments and substrings; filed: the line's own segments, which are probes as well."""
    power, inverse = _power(len(data))
    lines, keys, filed = [], [], []
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * power[: len(data)], out=total[1:])
        own_limit = limit(size, edits)
        for shorter in range(edits + 1):
            length = size - shorter
            cuts = _cuts(np.maximum(length, 0), edits)
            for k in range(2, edits + 2):
                at = np.flatnonzero((cuts == k) & (length >= k) & (own_limit >= shorter))
                if not len(at):
                    continue
                short = length[at] // k
                plain = k - length[at] % k  # so many segments are short, the others one longer
                for i in range(k):
                    place = i * short + np.maximum(i - plain, 0)
                    width = short + (i >= plain)
                    for shift in range(max(-i, shorter - (k - 1 - i)), min(i, shorter + (k - 1 - i)) + 1):
                        p = place + shift
                        ok = (p >= 0) & (p + width <= size[at])
                        s = start[at[ok]] + p[ok]
                        h = (total[s + width[ok]] - total[s]) * inverse[s]
                        h ^= (length[at[ok]].astype(np.uint64) * np.uint64(8) + np.uint64(i)) * _MIX
                        h ^= h >> np.uint64(32)
                        h *= _MIX
                        h ^= h >> np.uint64(29)
                        lines.append(at[ok])
                        keys.append(h)
                        filed.append(np.full(len(s), shorter == 0 and shift == 0))
    if not lines:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return np.concatenate(lines), np.concatenate(keys), np.concatenate(filed)


def split_lines(column: pa.Array):
    """(data, row, number, start, size) of every line that holds more than white space."""
    data, offsets = textops.text_bytes(column)
    if not len(data):
        return data, *(np.zeros(0, np.int64) for _ in range(4))
    feed = np.flatnonzero(data == 0x0A)
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    row_of_feed = np.searchsorted(offsets, feed, "right") - 1
    last = feed + 1 == offsets[row_of_feed + 1]  # nothing follows in this text
    start = np.sort(np.r_[filled, (feed + 1)[~last]])
    row = np.searchsorted(offsets, start, "right") - 1
    begins = np.searchsorted(row, np.arange(len(column)))
    number = np.arange(len(start)) - begins[row]
    cut = np.searchsorted(feed, start)
    end = np.minimum(np.r_[feed, len(data)][cut], offsets[row + 1])
    solid = np.r_[0, np.cumsum(textops.NOT_SPACE[data])]
    full = solid[end] > solid[start]
    return data, row[full], number[full], start[full], (end - start)[full]


# ------------------------------------------------------------------------------------------------ edit distance


def _strip(data: np.ndarray, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray):
    """The pairs without what they share at the front and at the back."""
    a, la, b, lb = (x.copy() for x in (a, la, b, lb))
    for back in (False, True):
        for step in (32, 8, 1):
            live = np.flatnonzero(np.minimum(la, lb) >= step)
            k = np.arange(step)
            while len(live):
                i = a[live] + (la[live] - step if back else 0)
                j = b[live] + (lb[live] - step if back else 0)
                same = (data[i[:, None] + k] == data[j[:, None] + k]).all(axis=1)
                live = live[same]
                if not back:
                    a[live] += step
                    b[live] += step
                la[live] -= step
                lb[live] -= step
                live = live[np.minimum(la[live], lb[live]) >= step]
    return a, la, b, lb


def within(data: np.ndarray, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Is the edit distance of data[a : a + la] and data[b : b + lb] at most ``most`` (0 to 6)? Pair by pair.

    The band of the matrix, ``most`` diagonals to either side, is one bit vector of vertical differences that slides
    down with the columns (Hyyroe, 2003). A pair is given up as soon as no path can come back under the limit.
    """
    a, la, b, lb = _strip(data, a, la, b, lb)
    swap = la < lb
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    la, lb = np.where(swap, lb, la), np.where(swap, la, lb)
    out = (la - lb <= most) & ((lb > 0) | (la <= most))
    live = np.flatnonzero(out & (lb > 0))
    if not len(live):
        return out
    # Rows are the longer string, columns the other one. Bit i of a column's vectors: row (column + i - t).
    t = int(most[live].max())
    full = np.int64((1 << (2 * t + 1)) - 1)
    a, la, b, lb, cap = a[live], la[live], b[live], lb[live], most[live]
    up = np.full(len(live), full ^ ((1 << t) - 1))  # rows from 1 on differ by one from those above
    down = np.zeros(len(live), np.int64)
    score = np.full(len(live), t)  # at the lower edge of the band: row t of column 0
    column = 0
    index = live
    while len(index):
        symbol = data[b + column]
        equal = np.zeros(len(index), np.int64)
        for i in range(2 * t + 1):
            r = column + i - t
            if r >= 0:
                ok = r < la
                equal |= (ok & (data[a + np.minimum(r, la - 1)] == symbol)).astype(np.int64) << i
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        rise = down | (full & ~(diagonal | up))
        fall = up & diagonal
        # The edge moves along its diagonal.
        score = score + (1 - ((diagonal >> (2 * t)) & 1))
        slid = diagonal >> 1
        up = (fall | (full & ~(slid | rise))) & full
        down = slid & rise
        column += 1
        last = la - column + t  # bit of the last row in this column; in the slid window its neighbours stand one lower
        ended = np.flatnonzero(lb == column)
        if len(ended):
            distance = score[ended].copy()
            for i in range(t + 1, 2 * t + 1):
                climb = ((up[ended] >> (i - 1)) & 1) - ((down[ended] >> (i - 1)) & 1)
                distance -= np.where(i > last[ended], climb, 0)
            out[index[ended]] = distance <= cap[ended]
        # Values never fall along a diagonal, and neighbours differ by one at most.
        end_bit = la - lb + t
        hopeless = (score - (2 * t - end_bit) > cap) & (lb > column)
        out[index[hopeless]] = False
        stay = (lb > column) & ~hopeless
        if not stay.all():
            index, a, la, b, lb, cap, up, down, score = (x[stay] for x in (index, a, la, b, lb, cap, up, down, score))
    return out


def least_shared_keys(data: np.ndarray, start: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, edits: int) -> np.ndarray:
    """For pairs of lines (x not longer than y): the least key that one files and the other has, of equal length either way."""
    named, at = np.unique(np.r_[x, y], return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    size = size[named]
    begin = np.cumsum(size) - size
    whole = data[np.repeat(start[named] - begin, size) + np.arange(size.sum())]  # these lines alone, next to each other
    line, key, filed = line_keys(whole, begin, size, edits)
    code = lambda n, k: (k ^ (n.astype(np.uint64) + np.uint64(1)) * _MIX) * _MIX
    out = np.full(len(x), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        held = np.sort(code(line, key))
        order = np.flatnonzero(filed)[np.argsort(line[filed], kind="stable")]
        line, key = line[order], key[order]
        for p, q, which in ((a, b, np.arange(len(a))), (b, a, np.flatnonzero(size[a] == size[b]))):
            p, q = p[which], q[which]
            first, n = np.searchsorted(line, p), np.searchsorted(line, p, "right") - np.searchsorted(line, p)
            pair = np.repeat(np.arange(len(p)), n)
            k = key[first[pair] + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)]
            wanted = code(q[pair], k)
            there = held[np.minimum(np.searchsorted(held, wanted), len(held) - 1)] == wanted
            np.minimum.at(out, which[pair[there]], k[there])
    return out


# ------------------------------------------------------------------------------------------------- the join


def _batches(docs: DataFrame):
    return docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")


def _names(column: pa.Array) -> np.ndarray:
    """Digests of 128 bits as byte strings that NumPy compares and sorts."""
    return np.ascontiguousarray(textops.text_bytes(column)[0]).view("S16")


def _column(names: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(names), [None, pa.py_buffer(names.tobytes())]).cast(pa.binary())


def _distinct(column: pa.Array):
    """(data, start, size, digest) of the different lines of a batch."""
    data, _, _, start, size = split_lines(column)
    digest = _names(_wide_digests(data, start, start + size))
    digest, first = np.unique(digest, return_index=True)
    return data, start[first], size[first], digest


def meeting_keys(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(key): hashes under which a line is filed that another one probes.

    Of all lines of a batch under one key, two stand for the rest, by 63 bits of their digests: they tell whether there are
    different ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches, "text"):
            data, start, size, digest = _distinct(batch.column("text"))
            line, key, filed = line_keys(data, start, size, edits)
            mark = (digest.view(np.uint64)[::2][line] & ~np.uint64(1)) | filed
            order = np.lexsort((mark, key))
            key, mark = key[order], mark[order]
            new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            tail = np.r_[head[1:], len(key)] - 1
            mark[head] |= np.bitwise_or.reduceat(mark & np.uint64(1), head) if len(head) else mark[head]
            keep = np.unique(np.r_[head, tail])
            yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(mark[keep].view(np.int64))], ["key", "mark"])

    rows = _batches(docs).mapInArrow(run, "key long, mark long").repartition("key")
    line = F.shiftrightunsigned("mark", 1)
    met = rows.groupBy("key").agg(F.min(line).alias("lo"), F.max(line).alias("hi"), F.bit_or(F.col("mark").bitwiseAND(F.lit(1))).alias("f"))
    return met.where("lo <> hi and f = 1").select("key")


def line_links(rows: DataFrame, texts: DataFrame, edits: int = EDITS, tile: int = TILE) -> DataFrame:
    """(a, b, n) from (key, d, filed) and (d, text): links that connect all lines within the limit of each other, directly
    or through others (n is null), and, where b is null, n links of line a: their sum is its degree."""
    large = rows.groupBy("key").count().where(F.col("count") > tile)
    large = large.select("key", F.ceil(F.col("count") / tile).cast("int").alias("m"))
    dealt = rows.join(large, "key", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("d"), F.col("m")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    dealt = dealt.withColumn("t", F.explode(pairs)).select("key", "t.i", "t.j", (F.col("mine") == F.col("t.i")).alias("first"), "d", "filed")
    dealt = dealt.join(texts, "d").select("key", "i", "j", "first", "d", "filed", "text")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def link(held: list[pa.RecordBatch], upto: int) -> tuple[pa.RecordBatch, pa.Table]:
        table = pa.Table.from_batches(held).combine_chunks()
        part, rest = table.slice(0, upto), table.slice(upto)
        batch = part.to_batches()[0]
        key, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
        first, filed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "filed"))
        data, offsets = textops.text_bytes(batch.column("text"))
        size = np.diff(offsets)
        group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        bounds = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
        left, right, held_pairs = [], [], 0
        names, one, name = np.unique(_names(batch.column("d")), return_index=True, return_inverse=True)
        label, degree = np.arange(len(names)), np.zeros(len(names), np.int64)

        def flush() -> None:
            nonlocal label
            x, y = np.concatenate(left), np.concatenate(right)
            left.clear(), right.clear()
            near = within(data, offsets[x], size[x], offsets[y], size[y], limit(size[y], edits))
            x, y = x[near], y[near]
            if len(x):
                label = union(label, name[x], name[y])
                once = key[x].view(np.uint64) == least_shared_keys(data, offsets[:-1], size, one[name[x]], one[name[y]], edits)
                np.add.at(degree, name[np.r_[x[once], y[once]]], 1)

        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            at = np.arange(lo, hi)
            for x in at[filed[lo:hi]].tolist():  # a filed line against all that probe: those of the other chunk, or of both
                y = at if i[x] == j[x] else at[first[lo:hi] != first[x]]
                more = size[y] - size[x]
                y = y[(name[y] != name[x]) & (more >= 0) & (more <= limit(size[y], edits)) & ((more > 0) | (name[y] > name[x]) | ~filed[y])]
                if len(y):
                    left.append(np.full(len(y), x))
                    right.append(y)
                    held_pairs += len(y)
                if held_pairs > 200_000:
                    flush()
                    held_pairs = 0
        if left:
            flush()
        far, linked = np.flatnonzero(label != np.arange(len(names))), np.flatnonzero(degree)
        digests, counted = _column(names), np.arange(len(far) + len(linked)) >= len(far)
        a = digests.take(pa.array(np.r_[far, linked]))
        b = digests.take(pa.array(np.r_[label[far], linked], mask=counted))
        n = pa.array(np.r_[np.zeros(len(far), np.int64), degree[linked]], mask=~counted)
        return pa.RecordBatch.from_arrays([a, b, n], ["a", "b", "n"]), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            total += batch.column("text").nbytes
            if total >= HOLD_BYTES:
                table = pa.Table.from_batches(held)
                key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
                new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
                if len(new):  # the last tile may go on in the next batch
                    out, rest = link(held, int(new[-1]))
                    yield out
                    held = rest.combine_chunks().to_batches()
                total = sum(b.column("text").nbytes for b in held) if len(new) else 0
        if held:
            n = sum(b.num_rows for b in held)
            yield link(held, n)[0]

    return dealt.mapInArrow(run, "a binary, b binary, n long")


def line_classes(docs: DataFrame, edits: int = EDITS, tile: int = TILE) -> DataFrame:
    """doc_id, line_no, n_bytes, class_doc_id, class_line_no, n_links, kept for every line with more than white space.

    Lines end at line feeds and are compared as UTF-8 bytes, unchanged. Two different lines are linked when their edit
    distance is at most ``edits`` and at most a FIFTH of the longer: lines below five bytes link with their like only,
    and long lines that differ in a whole word do not link. Equal lines and linked lines, directly or through others, are a class, named by its
    first line (doc_id, then line_no; null doc_ids last), which is kept. Lines are equal when their digests of 128 bits
    are. n_links: different lines that the line is linked to. line_no counts all lines of the text from 0. Null and empty texts have no lines; lines of rows that
    repeat a doc_id with equal text are kept or dropped together; an empty table gives no rows; columns other than
    doc_id and text are ignored.
    """
    meet = materialise(meeting_keys(docs, edits), "meeting")
    passes = docs.sparkSession.sparkContext.broadcast(Bloom.of(meet, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "line_no", "n_bytes", "d", "key", "filed", "text"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary()]

        def rows(n: int, **cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in zip(names, types)], names)

        for batch in textops.pieces(batches, "text"):
            data, row, number, start, size = split_lines(batch.column("text"))
            digest = _names(_wide_digests(data, start, start + size))
            ids = batch.column("doc_id").take(pa.array(row))
            yield rows(len(row), doc_id=ids, line_no=number, n_bytes=size, d=_column(digest))
            digest, first = np.unique(digest, return_index=True)
            start, size = start[first], size[first]
            line, key, filed = line_keys(data, start, size, edits)
            at = np.flatnonzero(passes.value.has(key))
            yield rows(len(at), d=_column(digest[line[at]]), key=key[at].view(np.int64), filed=filed[at])
            named, raw = np.unique(line[at]), data.tobytes()
            texts = [raw[a:b] for a, b in zip(start[named].tolist(), (start[named] + size[named]).tolist())]
            yield rows(len(named), d=_column(digest[named]), text=texts)

    schema = "doc_id long, line_no long, n_bytes long, d binary, key long, filed boolean, text binary"
    seen = materialise(_batches(docs).mapInArrow(run, schema), "lines")
    lines = seen.where("line_no is not null").select("doc_id", "line_no", "n_bytes", "d")
    rows = seen.where("key is not null").groupBy("key", "d").agg(F.max("filed").alias("filed")).join(meet, "key")
    rows = materialise(rows, "probes")
    wanted = rows.select("d").distinct()
    texts = seen.where("text is not null").join(wanted, "d", "left_semi").groupBy("d").agg(F.first("text").alias("text"))
    links = materialise(line_links(rows, texts, edits, tile), "links")

    degree = links.where("n is not null").groupBy(F.col("a").alias("d")).agg(F.sum("n").alias("n_links"))
    rooted = components(links.where("n is null").select("a", "b")).select(F.col("node").alias("d"), "root")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "line_no")
    first = lines.groupBy("d").agg(F.min(place).alias("first"))
    named = first.join(degree, "d", "left").join(rooted, "d", "left").withColumn("root", F.coalesce("root", "d"))
    # Only linked lines meet others in their class.
    linked = materialise(named.where("n_links is not null"), "classes")
    heads = linked.groupBy("root").agg(F.min("first").alias("head"))
    linked = linked.join(heads, "root").select("d", "n_links", F.col("head").alias("first"))
    alone = named.where("n_links is null").select("d", F.lit(0).cast("long").alias("n_links"), "first")
    out = lines.join(linked.unionByName(alone), "d")
    return out.select(
        "doc_id",
        "line_no",
        "n_bytes",
        F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.line_no").alias("class_line_no"),
        "n_links",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))).alias("kept"),
    )
