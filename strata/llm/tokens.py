"""Token-ID output: seekable zstandard files of little-endian unsigned 32-bit ids.

A file holds the documents of one range of doc_ids in ascending order: one independent zstandard frame for each document,
then, in skippable frames that any zstandard reader passes over, the doc_ids, and last the seek table of the public
"zstd seekable format" (compressed size, decompressed size and checksum for each frame, a footer with its magic number).
A reader fetches the footer and the table, and then decompresses just the frames of the documents that it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import textops
from strata.llm.ranks import running_total
from strata.llm.storage import materialise, scratch

SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
END_ID = 2
#: Text bytes that go to one file, about.
FILE_BYTES = 32 << 20
#: Ranges of documents, at most, and rows that are sampled for the bounds of each: so many pairs reach the driver.
MOST_RANGES, PER_RANGE = 20_000, 100
#: Pieces of text whose ids a worker keeps, and characters of each, at most.
CACHE, CACHED_LENGTH = 600_000, 64
#: Bytes of text that are encoded at a time.
BATCH_BYTES = 4 << 20


def _pairs(*ranges: tuple[int, int]) -> np.ndarray:
    """A truth table of pairs of bytes (the first one times 256), true in these inclusive ranges."""
    out = np.zeros(1 << 16, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Where a piece may begin: at blanks and line feeds, and at full stops and commas behind a letter.
_BLANK, _POINT = textops.table_of((0x20, 0x20), (0x0A, 0x0A)), textops.table_of((0x2C, 0x2C), (0x2E, 0x2E))
_MAY_BEGIN = _BLANK | _POINT
#: By the last two bytes: may a text end with white space here (more pairs than there are), with a Latin letter (fewer)?
_SPACE_BEFORE = _pairs((0xC285, 0xC285), (0xC2A0, 0xC2A0), (0x9A80, 0x9A80), (0x8080, 0x808A), (0x80A8, 0x80A9), (0x80AF, 0x80AF), (0x819F, 0x819F))
_SPACE_BEFORE |= np.tile(textops.table_of((0x09, 0x0D), (0x1C, 0x20)), 256)
_LETTER_BEFORE = _pairs((0xC380, 0xC396), (0xC398, 0xC3B6), (0xC3B8, 0xC3BF), *((x + 0x80, x + 0xBF) for x in range(0xC400, 0xC900, 256)))
_LETTER_BEFORE |= np.tile(textops.table_of((0x41, 0x5A), (0x61, 0x7A)), 256)


class Encoder:
    """Byte-level BPE ids of whole texts, each different piece of text encoded once.

    No match of the pre-tokenizer runs on from a non-blank to a blank, or from a letter to a full stop or comma, and none
    looks behind itself. So a text may be cut there, and the ids of its parts joined.
    """

    _of: dict[str, Encoder] = {}

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.cache: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Does the token open with a blank?
        self.opens = np.zeros(max(names.values()) + 1, bool)
        self.opens[[i for name, i in names.items() if name[0] == "\u0120"]] = True

    @classmethod
    def of(cls, tokenizer_file: str) -> Encoder:
        """One for each worker process, which keeps what it has encoded from task to task."""
        if tokenizer_file not in cls._of:
            cls._of[tokenizer_file] = cls(tokenizer_file)
        return cls._of[tokenizer_file]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of pieces that open with a blank and have no other: encoded as one text, cut where tokens open."""
        out = []
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.opens[ids]) * 4
            raw = ids.tobytes()
            assert len(cuts) == len(part)
            out += [raw[a:b] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(raw)])]
        return out

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces."""
        cache = self.cache
        out = [cache.get(p) for p in pieces]
        new = [i for i, x in enumerate(out) if x is None]
        words = [i for i in new if (p := pieces[i])[0] == " " and p.rfind(" ") == 0 and not p[-1].isspace()]
        rest = sorted(set(new).difference(words))
        for some, ids in ((words, self._words([pieces[i] for i in words])), (rest, self._ids([pieces[i] for i in rest]))):
            for i, x in zip(some, ids):
                out[i] = x
        for i in new:
            if len(cache) >= CACHE:
                break
            if len(pieces[i]) <= CACHED_LENGTH:
                cache[pieces[i]] = out[i]
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        data, offsets = textops.text_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        if not len(data):
            return [b""] * len(texts)
        at = np.flatnonzero(_MAY_BEGIN[data])
        before = data[at - 2].astype(np.uint16) << 8 | data[at - 1]  # ahead of a text's first bytes: other texts, no matter
        at = at[np.where(_BLANK[data[at]], ~_SPACE_BEFORE[before], _LETTER_BEFORE[before])]
        begins = np.zeros(len(data) + 1, bool)
        begins[at] = True
        begins[offsets] = True
        begins[-1] = True
        begin = np.flatnonzero(begins)
        pieces = pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin), pa.py_buffer(data)).dictionary_encode()
        ids = pa.array(self._look_up(pieces.dictionary.to_pylist()), pa.large_binary()).take(pieces.indices)
        _, ends, joined = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[ids.offset : ids.offset + len(ids) + 1][np.searchsorted(begin, offsets)].tolist()
        view = memoryview(joined)
        return [bytes(view[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def pack(frames: Iterable[tuple[int | None, bytes, int, int]]) -> Iterator[bytes]:
    """The bytes of a file, in parts, for (doc_id, frame, decompressed size, checksum) in the order of the file."""
    ids, table = [], []
    for doc_id, frame, size, check in frames:
        ids.append(-(1 << 63) if doc_id is None else doc_id)
        table.append(struct.pack("<III", len(frame), size, check))
        yield frame
    body = np.array(ids, "<i8").tobytes()
    yield struct.pack("<II", SKIPPABLE_IDS, len(body)) + body
    body = struct.pack("<III", 8 + len(body), 0, 0)
    table.append(body)  # the id list is a frame of the table as well: no content
    body = b"".join(table) + struct.pack("<IBI", len(table), 0x80, SEEKABLE)
    yield struct.pack("<II", SKIPPABLE_TABLE, len(body)) + body


class TokenFile:
    """Random access to one file; ``source`` is an open, seekable binary file of ``size`` bytes."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        body = self._at(size - 9 - 12 * n, 12 * n)
        head = struct.unpack("<II", self._at(size - 17 - 12 * n, 8))
        if head != (SKIPPABLE_TABLE, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(body, "<u4").reshape(-1, 3)
        self.begin = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        ids = self._at(int(self.begin[n - 1]), int(self.table[n - 1, 0]))
        self.doc_ids = np.frombuffer(ids[8:], "<i8")
        #: Ids of each document.
        self.counts = self.table[: n - 1, 1].astype(np.int64) // 4

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def _decode(self, i: int, frame: bytes) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(frame, max_output_size=int(self.table[i, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.table[i, 2]):
            raise ValueError(f"frame {i} does not have its checksum")
        return np.frombuffer(raw, "<u4")

    def read(self, i: int) -> np.ndarray:
        """Ids of the i-th document; no other frame is read."""
        return self._decode(i, self._at(int(self.begin[i]), int(self.table[i, 0])))

    def read_id(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document of this doc_id."""
        return [self.read(int(i)) for i in np.flatnonzero(self.doc_ids == doc_id)]

    def __iter__(self) -> Iterator[np.ndarray]:
        for i in range(len(self.doc_ids)):
            yield self.read(i)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, out: str, tokenizer_file: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every document's ids, each ended by ``end_id``, to files below the URI ``out``; returns their manifest.

    Manifest (a written table): part and file (ascending with doc_id), path, n_docs, n_tokens. Null texts are empty (the
    end id alone), null doc_ids come first; rows of one doc_id stand by the hash of their text, so the order does not
    depend on how the input was dealt. An empty table gives no file. Other columns are ignored. A task that runs again
    writes the same files again under names of its own and puts them in place by renaming.

    Documents are dealt to ranges of (doc_id, hash of the text), whose bounds come from a sample of bounded size; a range is
    cut into files by bytes. So many rows of one doc_id, or without one, are spread over ranges and files like any others.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text").withColumn("x", F.xxhash64("text"))
    size, n = rows.agg(F.sum(F.octet_length("text") + 16), F.count(F.lit(1))).first()
    parts = min(MOST_RANGES, max(1, -(-(size or 0) // file_bytes)))
    least = -(1 << 63)
    cuts = np.zeros((0, 2), np.int64)
    if parts > 1:
        keys = rows.select(F.coalesce("doc_id", F.lit(least)).alias("d"), "x")
        share = min(1.0, PER_RANGE * parts / n)
        keys = (keys.sample(share, 7) if share < 1 else keys).toPandas().to_numpy(np.int64)
        keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
        cuts = keys[np.arange(1, parts) * len(keys) // parts] if len(keys) else cuts

    def part_of(d: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many cuts stand before or at each (d, x)."""
        both = np.r_[cuts, np.stack([d, x], 1)]
        order = np.lexsort((np.arange(len(both)) >= len(cuts), both[:, 1], both[:, 0]))
        out = np.empty(len(both), np.int32)
        out[order] = np.cumsum(order < len(cuts))
        return out[len(cuts) :]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = Encoder.of(tokenizer_file), zstandard.ZstdCompressor(level=3, write_checksum=False)
        end = struct.pack("<I", end_id)
        for batch in textops.pieces(batches, "text", BATCH_BYTES):
            ids = batch.column("doc_id")
            part = part_of(pc.fill_null(ids, least).to_numpy(), batch.column("x").to_numpy())
            raw = [x + end for x in encoder.encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part),
                    ids,
                    batch.column("x"),
                    pa.array([len(x) for x in raw], pa.int64()),
                    pa.array([xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in raw], pa.int64()),
                    pa.array([press.compress(x) for x in raw], pa.binary()),
                ],
                ["part", "doc_id", "x", "size", "checksum", "frame"],
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(out)
        files.create_dir(root, recursive=True)

        def frames() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "size", "checksum", "frame")))

        def close(part: int, file: int, held: list[tuple]) -> tuple:
            path = f"part-{part:06d}-{file:06d}.tok.zst"
            temporary = f"{root}/.{path}-{uuid.uuid4().hex}"
            with files.open_output_stream(temporary) as f:
                for piece in pack((d, frame, size, check) for _, d, size, check, frame in held):
                    f.write(piece)
            files.move(temporary, f"{root}/{path}")
            return part, file, path, len(held), sum(h[2] for h in held) // 4

        made, held, total, file = [], [], 0, 0
        for row in frames():
            # Ids take about as many bytes as their text, so a range of about the right size is one file.
            if held and (row[0] != held[0][0] or total >= 2 * file_bytes):
                made.append(close(held[0][0], file, held))
                file = file + 1 if row[0] == held[0][0] else 0
                held, total = [], 0
            held.append(row)
            total += row[2]
        if held:
            made.append(close(held[0][0], file, held))
        if made:
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], ["part", "file", "path", "n_docs", "n_tokens"])

    coded = rows.mapInArrow(encode, "part int, doc_id long, x long, size long, checksum long, frame binary")
    ordered = coded.repartition(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "x", "size", "checksum")
    manifest = ordered.mapInArrow(write, "part int, file int, path string, n_docs long, n_tokens long")
    return materialise(manifest, "manifest")


def read_tokens(spark: SparkSession, out: str, manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents (only ``doc_ids``, if given) as the files have them.

    start: ids of all documents before, by the files' tables of counts. Frames of other documents are not read.
    """
    # The running total of the files' ids: over the ranges, of which there are few, and then inside each.
    files = running_total(manifest.withColumn("all", F.lit(0)), "all", "part", ["file"], F.col("n_tokens"), "before")
    wanted = None if doc_ids is None else np.array(sorted(doc_ids), np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(out)
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                name = f"{root}/{path}"
                with store.open_input_file(name) as f:
                    t = TokenFile(f, f.size())
                    start = before + np.cumsum(t.counts) - t.counts
                    pick = range(len(t.doc_ids)) if wanted is None else np.flatnonzero(np.isin(t.doc_ids, wanted)).tolist()
                    pick = np.array(pick, np.int64)
                    ids = [None if d == -(1 << 63) else d for d in t.doc_ids[pick].tolist()]
                    crc = [zlib.crc32(t.read(int(i)).tobytes()) for i in pick]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(start[pick]), pa.array(t.counts[pick]), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    n = manifest.count()
    return files.select("path", F.col("before").cast("long")).repartition(max(1, min(n, MOST_RANGES)), "path").mapInArrow(read, schema)


def encode_and_read_back(docs: DataFrame, tokenizer_file: str, out: str | None = None) -> DataFrame:
    """Write ``docs`` as token files (below ``out``, else in the shared folder) and return what they hold."""
    out = out or scratch(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, out, write_tokens(docs, out, tokenizer_file))
