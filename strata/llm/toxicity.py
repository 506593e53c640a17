"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary labelled texts, are interpolated with the same backoff: words by the number
of different words that they follow anywhere in the corpus, labelled or not. Counts are of different contexts, as
Kneser and Ney have it, so a passage that is copied a thousand times counts once. Words are cut into
pieces of ``PIECE`` characters, so that the forms of a rare expression share the counts of their stem, and where text
has no spaces each character is a word; every piece counts as a word. A text's evidence is the log-likelihood ratio of
all its words, normalised by their number, and that of its ``MOST`` most telling ones, so that an insult is not diluted
by the length of the text around it. A logistic curve of both, fitted on labelled rows that neither model has seen,
turns them into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import textops
from strata.llm.storage import materialise

#: Labelled rows that the models and the curve are fitted on, at most; those of the least hashes are taken.
MAX_MODEL_ROWS, MAX_CURVE_ROWS = 20_000, 10_000
#: Discount of context counts: words and word pairs in fewer contexts fall back altogether.
DISCOUNT = 8.0
#: Of corpus_contexts: most words that are told apart, and pairs of words that a task gathers before it sends them.
WORDS, HOLD_PAIRS = 1 << 22, 1 << 22
#: Text bytes whose pairs are counted in one group, about; there are 1024 groups at least.
GROUP_BYTES = 64 << 20
#: Characters of a word that share their counts with other words; the next ones are a word again.
PIECE = 6
MOST = 3
#: Log-odds of a text to be toxic where labels of one class, or both, are missing to fit them on.
PRIOR = -1.0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, and whether it goes on the one before without a gap.

    Runs of letters, digits and two-byte characters are cut after every ``PIECE`` characters. Characters of three bytes
    and more (of text without spaces nearly all) and those with lead byte C2 (no-break space, quotation marks) are words
    of their own. So every byte of a run is in one word.
    """
    start, end, row = textops.words(data, offsets, textops.ALNUM)
    if not len(start):
        return start, end, row, np.zeros(0, bool)
    alone = np.flatnonzero((data == 0xC2) | (data >= 0xE0))
    if len(alone):
        after = alone + 2 + (data[alone] >= 0xE0) + (data[alone] >= 0xF0)
        after = after[after < len(data)]
        fresh = np.union1d(start, np.r_[alone, after[textops.ALNUM[data[after]]]])
        run = np.searchsorted(start, fresh, "right") - 1
        start, end, row = fresh, np.minimum(np.r_[fresh[1:], len(data)], end[run]), row[run]
    long = np.flatnonzero(end - start > PIECE)
    high = np.r_[0, np.cumsum(data >= 0x80, dtype=np.int32)]
    mixed = high[end[long]] > high[start[long]]
    tails, owners = [], []
    for at, step in ((long[~mixed], PIECE), (long[mixed], 1)):
        n = (end[at] - start[at] - 1) // step  # places after the first, of pieces or of bytes
        owner = np.repeat(at, n)
        place = start[owner] + step * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + 1)
        if step == 1:
            lead = (data[place] & 0xC0) != 0x80
            owner, place = owner[lead], place[lead]
            number = np.arange(len(owner)) - np.searchsorted(owner, owner) + 1
            owner, place = owner[number % PIECE == 0], place[number % PIECE == 0]
        tails.append(place)
        owners.append(owner)
    whole = np.concatenate([start, *tails])
    order = np.argsort(whole, kind="stable")
    owner = np.concatenate([np.arange(len(start)), *owners])[order]
    whole = whole[order]
    return whole, np.minimum(np.r_[whole[1:], len(data)], end[owner]), row[owner], order >= len(start)


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (never 0) and where each row's words begin."""
    data, offsets = textops.text_bytes(column)
    data = textops.LOWER[data]
    start, end, row, tail = _words(data, offsets)
    h = textops.xxh64(data, start, end - start)
    h[tail] ^= _MIX  # the end of a word is not the word that is spelt like it
    return h | np.uint64(1), textops.group_starts(row, len(column))


def _before(word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The word before each, 0 at the start of a text."""
    out = np.zeros_like(word)
    out[1:] = word[:-1]
    out[bounds[:-1][bounds[:-1] < len(word)]] = 0
    return out


def _pair(b: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (b * _MIX ^ (b >> np.uint64(29))) * _MIX + w


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of ``values`` for sorted ``keys``; zeros where there is none."""
    if not len(keys):
        return np.zeros((len(wanted), *values.shape[1:]))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    out = values[at].copy()
    out[keys[at] != wanted] = 0
    return out


@dataclass
class Model:
    """Everything by class (0 ordinary, 1 toxic). Sorted 64-bit keys; only counts above the discount are here."""

    words: np.ndarray
    counts: np.ndarray  # contexts of a word, less the discount, over all: its own share in each class; then the shared share
    backoff: np.ndarray  # what is left to the shared distribution
    pairs: np.ndarray
    pair_counts: np.ndarray
    heads: np.ndarray
    head_counts: np.ndarray  # contexts after a word by class, then how much of them the pairs have kept

    def ratios(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio, toxic over ordinary, of every word after the one before."""
        own = _find(self.words, self.counts, word)
        shared = np.where(own[:, 2] > 0, own[:, 2], 1.0)  # a word without counts of its own: the shared share cancels out
        head = _find(self.heads, self.head_counts, before)
        pair = _find(self.pairs, self.pair_counts, _pair(before, word))
        log = []
        for c in (0, 1):
            p = own[:, c] + self.backoff[c] * shared
            n = np.maximum(head[:, c], 1.0)
            log.append(np.log(pair[:, c] / n + (1.0 - head[:, 2 + c] / n) * p))
        return log[1] - log[0]

    def evidence(self, column: pa.Array, most: int = MOST) -> np.ndarray:
        """For every text: the mean ratio of its ``most`` most telling words (or of all, if fewer), and of all its words."""
        word, bounds = _hashes(column)
        out = np.zeros((len(column), 2))
        if not len(word):
            return out
        ratio = self.ratios(word, _before(word, bounds))
        n = np.diff(bounds)
        row = np.repeat(np.arange(len(column)), n)
        out[:, 1] = np.bincount(row, ratio, len(column)) / np.maximum(n, 1)
        ratio = ratio[np.lexsort((-ratio, row))]  # each text's words, the most telling first
        first = bounds[:-1]
        for i in range(most):
            has = n > i
            out[has, 0] += ratio[first[has] + i] / np.minimum(n[has], most)
        return out


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes for the columns of ``x`` and intercept of a logistic curve, with a weak pull towards slopes 1 and even odds; Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    goal = np.r_[np.ones(x.shape[1] - 1), 0.0]
    a = goal.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        g = x.T @ (p - y) + 0.01 * (a - goal)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(a))
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        a = a - step
        if np.abs(step).max() < 1e-9:
            break
    return a


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")


def _fold():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def _groups(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where, along ``order``, one of the keys changes."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _distinct(held: list[np.ndarray]) -> np.ndarray:
    """The different keys in ``held``, sorted; the list is emptied, so that they are in memory once."""
    keys = np.concatenate(held)
    held.clear()
    keys.sort()
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _packed(keys: np.ndarray, more: int) -> pa.RecordBatch:
    """Rows (part, keys) of different sorted keys of pairs: 10 + ``more`` bits of part, 22 of word, 32 - ``more`` of hash.

    Words are sent as differences, byte by byte of their places: nearly all are 0 and vanish in compression.
    """
    part = (keys >> np.uint64(54 - more)).astype(np.int32)
    head = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(keys) else np.zeros(0, np.int64)
    word = (keys >> np.uint64(32 - more)).astype(np.uint32) & np.uint32(WORDS - 1)
    step = np.diff(word, prepend=np.uint32(0))
    step[head] = word[head]
    step, low = step.view(np.uint8).reshape(-1, 4), (keys & np.uint64((1 << (32 - more)) - 1)).astype(np.uint32)
    rows = [step[a:b].T.tobytes() + low[a:b].tobytes() for a, b in zip(head.tolist(), [*head[1:].tolist(), len(keys)])]
    return pa.RecordBatch.from_arrays([pa.array(part[head]), pa.array(rows, pa.binary())], ["part", "keys"])


def _unpacked(row: bytes) -> np.ndarray:
    n = len(row) // 8
    step = np.ascontiguousarray(np.frombuffer(row, np.uint8, 4 * n).reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(step.astype(np.uint64)) << np.uint64(32) | np.frombuffer(row, np.uint32, n, 4 * n).astype(np.uint64)


def corpus_contexts(texts: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """How many different words each of ``words`` (sorted hashes) follows in the corpus, and that of all words together.

    The start of a text is a word like any other. Different pairs of words are told apart by 42 bits of hash for each of
    ``words``, and for each of 1024 classes of the other ones. They are dealt by hash, so a common word is counted in
    many tasks, to groups whose number follows the corpus, so that none outgrows a task.
    """
    if len(words) + 1024 > WORDS:
        raise ValueError(f"{len(words)} words of labelled texts")
    known = texts.sparkSession.sparkContext.broadcast(words)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    more = min(20, max(0, (size // (GROUP_BYTES << 10)).bit_length()))

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = _distinct(held)
        cuts = np.searchsorted(keys >> np.uint64(54), np.arange(0, 1025, 128))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield _packed(keys[lo:hi], more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in textops.pieces(batches, "text"):
            word, bounds = _hashes(batch.column("text"))
            before = _before(word, bounds)
            at = np.searchsorted(known.value, word)
            found = np.zeros(len(word), bool)
            if len(known.value):
                found = known.value[np.minimum(at, len(known.value) - 1)] == word
            with np.errstate(over="ignore"):
                at = np.where(found, at, len(known.value) + ((word * _MIX) >> np.uint64(54)).astype(np.int64)).astype(np.uint64)
            h = _pair(before, word)
            part, low = np.uint64(54 - more), np.uint64((1 << (32 - more)) - 1)
            held.append(np.unique(h >> part << part | at << np.uint64(32 - more) | h >> np.uint64(22) & low))
            total += len(held[-1])
            del word, before, found, at, h
            if total >= HOLD_PAIRS:
                yield from send(held)
                total = 0
        if total:
            yield from send(held)

    def count(table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([_unpacked(x.as_buffer()) for x in table.column("keys")]))
        at, n = np.unique(keys >> np.uint64(32), return_counts=True)
        return pa.table({"i": pa.array(at.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    seen = texts.select("text").mapInArrow(run, "part int, keys binary").groupBy("part").applyInArrow(count, "i long, n long")
    # Bounded: the words of the labelled sample and 1024 classes.
    seen = seen.groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(words) + 1024, np.int64)
    out[seen["i"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)
    return out[: len(words)], int(out.sum())


def _contexts(key: np.ndarray, context: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different (key, context) stands first, and the texts of the key, each at one of its contexts."""
    order = np.lexsort((context, text, key))
    counted = np.zeros(len(key), np.int64)
    counted[order[_groups(order, key, text)]] = 1
    order = np.lexsort((context, key))
    head = _groups(order, key, context)
    return order[head], np.add.reduceat(counted[order], head) if len(head) else head


def class_counts(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(y, w, c) and (y, b, w, k): the contexts of words, and of pairs of words, in texts of class y.

    A context is another word before, in another text: the fewer of the two count, so that neither a copied passage nor
    a text that repeats one word counts more than once. A batch of texts sends one row for each pair and word before it (32 bits of
    its hash).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches, "text"):
            word, bounds = _hashes(batch.column("text"))
            before = _before(word, bounds)
            two = _before(before, bounds)
            n = np.diff(bounds)
            y = np.repeat(batch.column("y").to_numpy(), n)
            row = np.repeat(np.arange(len(n)), n)
            none = np.zeros_like(word)
            for pairs, b, context in ((False, none, none), (True, before, two)):
                at, texts = _contexts(_pair(b, word) * np.uint64(2) + y.astype(np.uint64), context, row)
                cols = [pa.array(np.full(len(at), pairs)), pa.array(y[at], pa.int32())]
                cols += [pa.array(x[at].view(np.int64)) for x in (b, word)]
                cols += [pa.array((context[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(texts)]
                yield pa.RecordBatch.from_arrays(cols, ["pairs", "y", "b", "w", "context", "texts"])

    seen = labelled.select("y", "text").mapInArrow(run, "pairs boolean, y int, b long, w long, context int, texts long")
    seen = seen.groupBy("pairs", "y", "b", "w", "context").agg(F.sum("texts").alias("texts"))
    seen = seen.groupBy("pairs", "y", "b", "w").agg(F.count(F.lit(1)).alias("m"), F.sum("texts").alias("texts"))
    seen = materialise(seen.withColumn("n", F.least("m", "texts")), "contexts")
    pairs = seen.where("pairs").select("y", "b", "w", F.col("n").alias("k"))
    # The words before a word are the pairs that it ends.
    words = seen.groupBy("y", "w").agg(F.count_if("pairs").alias("c"), F.sum(F.when(~F.col("pairs"), F.col("texts"))).alias("texts"))
    return materialise(words.select("y", "w", F.least("c", "texts").alias("c")), "words"), pairs


def _by_class(pdf, key: np.ndarray, value: str) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(key, return_inverse=True)
    out = np.zeros((len(keys), 2))
    out[at, pdf["y"].to_numpy()] = pdf[value].to_numpy()
    return keys, out


def fit(docs: DataFrame, labels: DataFrame, discount: float = DISCOUNT) -> tuple[Model, np.ndarray]:
    """The models and the curve (slopes, intercept), from rows whose fold (crc32 of the doc_id as text, mod 5) is not 0."""
    spark = docs.sparkSession
    texts = _texts(docs)
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(F.max(F.col("toxic").cast("int")).alias("y")).where("y in (0, 1)").withColumn("fold", _fold())
    least = marked.orderBy(F.xxhash64("doc_id"), "doc_id")
    model_rows = least.where("fold in (1, 2, 3)").limit(MAX_MODEL_ROWS)
    curve_rows = least.where("fold = 4").limit(MAX_CURVE_ROWS)
    # Bounded: MAX_MODEL_ROWS + MAX_CURVE_ROWS rows of two integers.
    chosen = texts.join(F.broadcast(model_rows.unionByName(curve_rows)), "doc_id")
    chosen = materialise(chosen.select("doc_id", "y", "fold", "text"), "labelled")

    uni, counts = class_counts(chosen.where("fold <> 4"))
    kept = lambda c: F.greatest(F.col(c) - discount, F.lit(0.0))
    sums = {r.y: r for r in uni.groupBy("y").agg(F.sum("c").alias("n"), F.sum(kept("c")).alias("kept")).collect()}
    # What is gathered here grows with the bounded sample, not with the corpus.
    uni = uni.where(F.col("c") > discount).withColumn("v", kept("c")).toPandas()
    pairs = counts.where(F.col("k") > discount).withColumn("v", kept("k")).toPandas()
    heads = counts.groupBy("y", "b").agg(F.sum("k").alias("n"), F.sum(kept("k")).alias("kept")).where("kept > 0").toPandas()
    u64 = lambda s: s.to_numpy().astype(np.int64).view(np.uint64)

    words, own = _by_class(uni, u64(uni["w"]), "v")
    n = np.array([max(1, sums[c].n) if c in sums else 1 for c in (0, 1)], float)
    backoff = np.array([1 - sums[c].kept / n[c] if c in sums else 1.0 for c in (0, 1)])
    vocabulary = np.union1d(words, u64(pairs["w"]))
    shared, everything = corpus_contexts(texts, vocabulary)
    table = np.zeros((len(vocabulary), 3))
    table[np.searchsorted(vocabulary, words), :2] = own / n
    table[:, 2] = shared / max(everything, 1)
    pair_keys, pair_counts = _by_class(pairs, _pair(u64(pairs["b"]), u64(pairs["w"])), "v")
    head_keys, head_n = _by_class(heads, u64(heads["b"]), "n")
    _, head_kept = _by_class(heads, u64(heads["b"]), "kept")
    model = Model(vocabulary, table, backoff, pair_keys, pair_counts, head_keys, np.hstack([head_n, head_kept]))

    shared_model = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches, "text"):
            x = shared_model.value.evidence(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("y")], ["most", "all", "y"])

    seen = chosen.where("fold = 4").select("text", "y").mapInArrow(measure, "most double, all double, y int").toPandas()
    if len(sums) < 2 or seen["y"].nunique() < 2:
        return model, np.array([1.0, 1.0, PRIOR] if len(sums) == 2 else [0.0, 0.0, PRIOR])
    return model, fit_curve(seen[["most", "all"]].to_numpy(float), seen["y"].to_numpy().astype(float))


def score_documents(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (doc_id) of ``docs`` with held_out, score, predicted.

    score: 0 to 1, from the text alone; predicted: 1 from 0.5 on. held_out: the fold of the doc_id is 0 (its label is
    not read). Null and empty texts have no evidence either way, and the score of that. Of several labels of a document
    the largest holds; null labels and labels other than 0 and 1 are not read. Without labels of both classes for the
    models every text has the score of ``PRIOR``, which is below 0.5; without those for the curve it has slopes 1 and
    that intercept. A null doc_id is scored, in the fold of the empty text. Columns of ``docs`` with the new columns'
    names are replaced; repeated rows are scored each.
    """
    new = ("held_out", "score", "predicted")
    keep = [c for c in keep or ["doc_id"] if c not in new]
    model, curve = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = [f for f in docs.schema.fields if f.name in {*keep, "text"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches, "text"):
            x = shared.value.evidence(batch.column("text"))
            score = 1 / (1 + np.exp(-np.clip(x @ curve[:-1] + curve[-1], -30, 30)))
            column = {c: v for c, v in zip(batch.schema.names, batch.columns) if c in {*keep, "held_out"}}
            column |= {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}
            yield pa.RecordBatch.from_arrays(list(column.values()), list(column))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried if f.name in keep)
    rows = docs.select(*[F.col(f"`{f.name}`") for f in carried], (_fold() == 0).alias("held_out"))
    return rows.mapInArrow(run, f"{ddl}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with the columns of ``docs``."""
    names = {c: f"_clash_{i}" for i, c in enumerate(docs.columns) if c in ("held_out", "score", "predicted")}
    renamed = docs.withColumnsRenamed(names)
    scored = score_documents(renamed, labels, keep=renamed.columns).where("predicted = 0")
    return scored.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])
