"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of 13 consecutive words of benchmark items (a shorter item is one window). Words are the symbols:
a block is two words. A table of blocks says how far a search may shift when it reads that block; blocks that occur in no
pattern shift by the whole window but one word. Where the shift is zero, the hash of the window's last words selects the
patterns to compare, and words are compared byte by byte. All documents of a batch are searched in lockstep.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import textops
from strata.llm.storage import materialise
from strata.llm.textops import unused

WINDOW = 13
#: Benchmark text bytes whose tables are sent to the tasks at once; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 8 << 20
#: Blocks that are searched in one stage; then what was found is written, and their tables are let go.
PASS_BLOCKS = 4
#: Words of a document that one cursor searches.
LANE = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (a * _MIX ^ (b >> np.uint64(7))) * _MIX + b


class Patterns:
    """Wu-Manber tables for all patterns of one length of ``words``: word lists with the items they come from."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.words = list(patterns)
        self.items = [sorted(patterns[w]) for w in self.words]
        self.m = len(self.words[0])
        flat = b"".join(w for p in self.words for w in p)
        lens = np.array([len(w) for p in self.words for w in p], np.int64)
        ids = textops.xxh64(np.frombuffer(flat, np.uint8), np.cumsum(lens) - lens, lens).reshape(-1, self.m)
        self.block = min(2, self.m)
        ends = range(self.block - 1, self.m)
        keys = np.concatenate([self._blocks(ids, e) for e in ends])
        shift = np.concatenate([np.full(len(ids), self.m - 1 - e, np.int64) for e in ends])
        order = np.lexsort((shift, keys))
        keys, shift = keys[order], shift[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        self.keys, self.shift = keys[first], shift[first]
        self.longest_shift = self.m - self.block + 1
        # A pattern's bucket is the hash of its last block; first words sort inside a bucket.
        tail = self._blocks(ids, self.m - 1)
        by = np.argsort(tail, kind="stable")
        self.tail, self.by, self.ids = tail[by], by, ids[by]

    def _blocks(self, ids: np.ndarray, end: int) -> np.ndarray:
        return _pair(ids[:, end - 1], ids[:, end]) if self.block == 2 else ids[:, end].copy()

    def search(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray, text) -> tuple[np.ndarray, np.ndarray]:
        """Where patterns occur: (index of the first word, pattern).

        word: hashes of all words; lanes [lo, hi) start an occurrence in ``lo`` at the earliest and end before ``hi``.
        text(i): bytes of word i.
        """
        m, cursor = self.m, lo + self.m - 1
        found_at, found = [], []
        live = np.flatnonzero(cursor < hi)
        while len(live):
            at = cursor[live]
            block = _pair(word[at - 1], word[at]) if self.block == 2 else word[at]
            slot = np.minimum(np.searchsorted(self.keys, block), len(self.keys) - 1)
            shift = np.where(self.keys[slot] == block, self.shift[slot], self.longest_shift)
            zero = shift == 0
            if zero.any():
                here, b = at[zero], block[zero]
                left, right = np.searchsorted(self.tail, b, "left"), np.searchsorted(self.tail, b, "right")
                count = right - left
                own = np.repeat(np.arange(len(here)), count)
                pat = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + left[own]
                begin = here[own] - m + 1
                for i in range(m):  # prefix words first: most candidates end there
                    same = self.ids[pat, i] == word[begin + i]
                    begin, pat = begin[same], pat[same]
                for s, p in zip(begin.tolist(), self.by[pat].tolist()):
                    if all(text(s + i) == w for i, w in enumerate(self.words[p])):
                        found_at.append(s)
                        found.append(p)
            cursor[live] = at + np.maximum(shift, 1)
            live = live[cursor[live] < hi[live]]
        return np.array(found_at, np.int64), np.array(found, np.int64)


def _windows(items: list[tuple[str | None, str | None]], window: int) -> list[Patterns]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item_id, text in items:
        data, offsets = textops.text_bytes(pa.array([text], pa.string()))
        data = textops.LOWER[data]
        start, end, _ = textops.words(data, offsets, textops.ALNUM)
        seq = [data[s:e].tobytes() for s, e in zip(start, end)]
        size = min(window, len(seq))
        for i in range(len(seq) - size + 1 if size else 0):
            owners = by_length.setdefault(size, {}).setdefault(tuple(seq[i : i + size]), set())
            if item_id is not None:
                owners.add(item_id)
    return [Patterns(p) for p in by_length.values()]


def _search_batch(column: pa.Array, patterns: list[Patterns], spans: list[bytes], items: list[list[str]]):
    """Number of words, hit words (first, end by row, as bytes) and items of each row, with what was found before."""
    data, offsets = textops.text_bytes(column)
    rows = len(column)
    data = textops.LOWER[data]
    start, end, row = textops.words(data, offsets, textops.ALNUM)
    word = textops.xxh64(data, start, end - start)
    bounds = textops.group_starts(row, rows)
    n = np.diff(bounds)
    hits: dict[int, list[tuple[int, int]]] = {}
    sets: dict[int, set[str]] = {}

    def text(i: int) -> bytes:
        return data[start[i] : end[i]].tobytes()

    for p in patterns:
        lanes = -(-n // LANE)
        own = np.repeat(np.arange(rows), lanes)
        lo = bounds[own] + (np.arange(len(own)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        hi = np.minimum(lo + LANE + p.m - 1, bounds[own + 1])
        for s, k in zip(*p.search(word, lo, hi, text)):
            r = int(row[s])
            hits.setdefault(r, []).append((int(s - bounds[r]), int(s - bounds[r]) + p.m))
            sets.setdefault(r, set()).update(p.items[k])
    for r, new in hits.items():
        old = np.frombuffer(spans[r], np.int64).reshape(-1, 2)
        both = sorted({*map(tuple, old.tolist()), *new})
        merged = [list(both[0])]
        for a, b in both[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        spans[r] = np.array(merged, np.int64).tobytes()
        items[r] = sorted({*items[r], *sets[r]})
    return n, spans, items


_FOUND = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Columns ``keep`` (all) of ``docs`` with n_words, n_hit, n_items, items_sha256, contaminated.

    A word of a document is hit if it lies in any occurrence of a window of any item; contaminated: n_hit > 0 and
    20 * n_hit >= n_words. items: ids of items with windows that occur, as strings, sorted by code point, joined by
    commas; an item without id hits words but is not listed. Items of the same id are one item. Null or empty texts have
    no words and no windows. Columns of ``docs`` with the new columns' names are replaced. Repeated rows are judged each;
    an empty table gives no rows, an empty benchmark no hits.

    The benchmark is cut into blocks of about ``block_bytes``, whose tables are built once and broadcast; the documents
    pass through one search for each block, without a shuffle. After each ``PASS_BLOCKS`` blocks they are written with
    what was found, so no stage holds the tables of more than that.
    """
    spark = docs.sparkSession
    bench = benchmark.selectExpr("cast(item_id as string) item_id", "cast(text as string) text")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    bench = bench.withColumn("_block", F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)))
    keep = [c for c in keep or docs.columns if c not in _FOUND]
    carried = [f for f in docs.schema.fields if f.name in {*keep, "text"}]
    spans_name, items_name = unused(docs.columns, "spans", "items")
    out = docs.select(*[F.col(f"`{f.name}`") for f in carried])
    out = out.withColumns({spans_name: F.lit(b""), items_name: F.array().cast("array<string>")})
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried if f.name in keep)
    last_schema = f"{ddl}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def searcher(shared, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in textops.pieces(batches, "text"):
                column = dict(zip(batch.schema.names, batch.columns))
                n, spans, items = _search_batch(column["text"], shared.value, column[spans_name].to_pylist(), column[items_name].to_pylist())
                if last:
                    hit = np.array([int((x[:, 1] - x[:, 0]).sum()) for x in (np.frombuffer(s, np.int64).reshape(-1, 2) for s in spans)], np.int64)
                    sha = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
                    column = {c: v for c, v in column.items() if c in keep} | {
                        "n_words": pa.array(n, pa.int64()),
                        "n_hit": pa.array(hit),
                        "n_items": pa.array([len(i) for i in items], pa.int64()),
                        "items_sha256": pa.array(sha),
                        "contaminated": pa.array((hit > 0) & (20 * hit >= n)),
                    }
                else:
                    column |= {spans_name: pa.array(spans, pa.binary()), items_name: pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(column.values()), list(column))

        return run

    for b in range(blocks):
        rows = [tuple(r) for r in bench.where(F.col("_block") == b).select("item_id", "text").collect()]
        last = b == blocks - 1
        patterns = spark.sparkContext.broadcast(_windows(rows, window))
        out = out.mapInArrow(searcher(patterns, last), last_schema if last else out.schema)
        if not last and (b + 1) % PASS_BLOCKS == 0:
            out = materialise(out, "spans")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``."""
    names = {c: f"_clash_{i}" for i, c in enumerate(docs.columns) if c in _FOUND}  # columns of these names stay what they were
    found = find_benchmark(docs.withColumnsRenamed(names), benchmark).where("not contaminated")
    return found.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


ORACLE_SQL = r"""
with
w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
p as (
  select distinct item_id, least(13, len(ws)) as m, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') as win
  from (select item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as i from b where len(ws) > 0)),
g as (
  select doc_id, i, m, array_to_string(ws[i : i + m - 1], ' ') as win
  from (select doc_id, ws, m, unnest(range(1, greatest(len(ws) - m + 2, 1))) as i from w, (select distinct m from p))),
o as (select g.doc_id, g.i, g.m, p.item_id from g join p on g.m = p.m and g.win = p.win),
h as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + m)) as k from o) group by doc_id),
t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from o group by doc_id)
select w.doc_id, cast(coalesce(len(ws), 0) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(ws), 0) as contaminated
from w left join h using (doc_id) left join t using (doc_id)
"""
