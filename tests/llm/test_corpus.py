"""Token files, toxicity, sharding, decontamination, mixing, URL rules and the pipeline."""

import io
import math
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from strata.llm import decontam, mixing, sharding, textops, tokens, toxicity, urls

SCHEMA = "doc_id long, text string, source string"
ROWS = [
    (0, None, "a"),
    (1, "", None),
    (2, "Hello world, hello  world\n\nagain", "a"),
    (2, "Hello world, hello  world\n\nagain", "a"),
    (3, "x " * 3000 + "end", "b"),
    (4, "naïve café\tok", "b"),
    (None, "no id here", "c"),
    *[(10 + i, " ".join(f"w{j % (i + 2)}" for j in range(5 * i)), "abc"[i % 3]) for i in range(30)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_token_files_round_trip(spark, docs, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    out = f"file://{tmp_path}/tok"
    manifest = tokens.write_tokens(docs, out, path, file_bytes=4000)
    got = [tuple(r) for r in tokens.read_tokens(spark, out, manifest).collect()]
    want = {}
    for d, t, _ in ROWS:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert len(got) == len(ROWS)
    total = 0
    for d, start, n, crc in sorted(got, key=lambda r: r[1]):
        assert start == total and (n, crc) in want[d]
        total += n
    ordered = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert ordered == sorted(ordered, key=lambda d: (d is not None, d or 0))
    some = tokens.read_tokens(spark, out, manifest, [4, 11]).collect()
    assert sorted(r.doc_id for r in some) == [4, 11]
    assert tokens.encode_and_read_back(docs.limit(0), path).collect() == []


def test_ids_equal_the_tokenizer_s():
    """Odd blanks, control characters, added tokens, several scripts, and long texts."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, rng = Tokenizer.from_file(path), np.random.default_rng(11)
    parts = ["a", "The", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "\0", "é", "今日", "привет", "'s", ".", ",", "!?", "12", "<|endoftext|>", "\u200d", "🙂", "word", "\x1f"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(3000)] + ["word, and more. " * 20_000, "x" * 50_000]
    got = tokens.Encoder(path).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_are_encoded_once():
    """Texts with any white space are cut, so that the tokenizer sees what is new in them and no more."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    class Counting:
        seen = 0

        def encode_batch_fast(self, texts, **options):
            self.seen += sum(map(len, texts))
            return plain.encode_batch_fast(texts, **options)

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, encoder = Tokenizer.from_file(path), tokens.Encoder(path)
    encoder.tokenizer = counting = Counting()
    texts = [f"  word{i % 7},  and\t\tmore.\n\nEach\u00a0time. \n" * 50 for i in range(100)]
    got = encoder.encode(texts) + encoder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == 2 * [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert counting.seen < 1000


def test_rows_without_ids_fill_many_files(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(None, f"text number {i} " * 40) for i in range(60)] + [(7, "the same " * 60)] * 20, "doc_id long, text string")
    out = f"file://{tmp_path}/tok"
    manifest = tokens.write_tokens(df, out, public_tokenizers.path("byte_bpe_50k.json"), file_bytes=4000)
    assert manifest.count() > 8
    got = sorted(tokens.read_tokens(spark, out, manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])][:-1].tolist()
    assert [r.doc_id for r in got] == [None] * 60 + [7] * 20


def test_damaged_frames_are_noticed():
    body = b"".join(tokens.pack([(7, __import__("zstandard").compress(b"\1\0\0\0"), 4, 12345)]))
    with pytest.raises(ValueError):
        tokens.TokenFile(io.BytesIO(body), len(body)).read(0)


def test_shards(docs):
    def jump(key, n):
        key, b, j = key % (1 << 64), -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    got = sharding.shard_documents(docs, 7).collect()
    assert len(got) == len(ROWS)
    slots = {}
    for r in got:
        key = -1 if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard, r.law) == (jump(key, 7), jump(key, 8), "key")
        assert r.grown_shard in (r.shard, 7)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def in_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    got = con.sql(sql)
    return got.columns, [tuple(None if v != v else v for v in r) for r in got.fetchall()]


def test_decontamination(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(f"w{j % 5}" for j in range(20))), (2, "CAFÉ ok"), (3, "no id"), (4, ""), (5, None), (6, "Hello, world! Hello")], "item_id long, text string")
    named = docs.where("doc_id is not null and doc_id <> 2")
    columns, want = in_duckdb(decontam.ORACLE_SQL, documents=named.select("doc_id", "text"), benchmark=bench)
    monkeypatch.setattr(decontam, "PASS_BLOCKS", 2)
    for block in (8 << 20, 20):  # one block, and a block for nearly every item
        got = decontam.find_benchmark(named, bench, keep=["doc_id"], block_bytes=block).select(*columns).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    clash = docs.withColumnRenamed("source", "n_hit")
    assert decontam.decontaminate(clash, bench).columns == ["doc_id", "text", "n_hit"]
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(ROWS)
    twice = docs.selectExpr("*", "1 _spans", "2 _items", "3 __spans").where("doc_id is not null")
    long = spark.createDataFrame([(99, "filler words here " * 40_000 + " ".join(f"w{j % 5}" for j in range(20)), "s", 1, 2, 3)], twice.schema)
    got = {r.doc_id: r for r in decontam.find_benchmark(twice.unionByName(long), bench).collect()}
    assert (got[99].n_words, got[99].n_hit, got[99]._spans, got[99].contaminated) == (120_020, 20, 1, False)
    assert decontam.decontaminate(twice, bench).columns == twice.columns
    assert decontam.find_benchmark(docs.limit(0), bench).collect() == []


def test_mixing(docs):
    once = docs.where("doc_id is null or doc_id <> 2")
    columns, want = in_duckdb(mixing.ORACLE_SQL, documents=once.where("doc_id is not null"))
    got = mixing.mix(once.where("doc_id is not null")).select(*columns).collect()
    plain = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert [r[:6] for r in plain(tuple(-1.0 if v is None else v for v in r) for r in got)] == [r[:6] for r in plain(tuple(-1.0 if v is None else v for v in r) for r in want)]
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 3 * r.size for r in rows)
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    applied = mixing.apply_mix(docs.withColumnRenamed("source", "source"))
    assert applied.columns == docs.columns
    assert applied.count() == sum(-(-r.taken // r.size) for r in rows if r.size)


def test_url_rules(spark):
    pages = [(1, "http://A.Example.ORG/es/x?q"), (2, "https://example.org/en/12"), (3, "http://x.com/de/"), (4, "http://notexample.org/es/"), (5, None), (6, "org/"), (7, "http://com/fr/y#z"), (8, "http://org"), (9, "")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    columns, want = in_duckdb(urls.ORACLE_SQL, pages=df)
    assert sorted(map(str, map(tuple, urls.judge_urls(df).select(*columns).collect()))) == sorted(map(str, want))
    index = urls.RuleIndex([urls.Rule("*.net", "/a*z", "block"), urls.Rule("b.net", "/", "allow")])
    assert index.match("x.net", "/a-long-z").verdict == "block" and index.match("b.net", "/q").verdict == "allow" and index.match("c.com", "/") is None


def test_toxicity_on_held_out_rows(spark):
    base = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = {r.doc_id: r for r in toxicity.score_documents(d, labels).collect()}
    marked = [(r.toxic, rows[r.doc_id].score) for r in labels.collect() if rows[r.doc_id].held_out]
    toxic, clean = ([s for t, s in marked if t == k] for k in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc > 0.9 and sum(s >= 0.5 for s in clean) < 0.02 * len(clean)


def test_toxicity_counts_have_no_ceiling(spark, monkeypatch):
    texts = [f"a{i} b{i % 400} same pair a{i}" for i in range(700)] * 2 + ["same pair"]
    df = spark.createDataFrame([(1, t) for t in texts], "y int, text string").repartition(3)
    word = lambda w: int(toxicity._hashes(pa.array([w]))[0].view(np.int64)[0])
    some = np.unique(np.array([word(w) for w in ("same", "pair", "a7", "b7")], np.int64).view(np.uint64))
    contexts, everything = toxicity.corpus_contexts(df, some)
    contexts = dict(zip(some.view(np.int64).tolist(), contexts.tolist()))
    assert [contexts[word(w)] for w in ("same", "pair", "a7", "b7")] == [401, 1, 2, 2]
    assert everything == len({p for t in texts for p in zip(["", *t.split()], t.split())})
    assert toxicity.corpus_contexts(df, some[:0])[1] == everything
    monkeypatch.setattr(toxicity, "GROUP_BYTES", 2)  # many more groups
    assert [x.tolist() if isinstance(x, np.ndarray) else x for x in toxicity.corpus_contexts(df, some)] == [list(contexts.values()), everything]
    words, pairs = toxicity.class_counts(df)
    assert {r.w: r.c for r in words.collect()}[word("same")] == 401
    assert [r.k for r in pairs.where(f"b = {word('same')} and w = {word('pair')}").collect()] == [401]


def test_toxicity_reads_every_byte(spark):
    def cut(text):
        data, offsets = textops.text_bytes(pa.array([text]))
        return [data[a:b].tobytes().decode() for a, b, *_ in zip(*toxicity._words(data, offsets))]

    assert cut("naïve, приветствие\u00a0x今日は。ok 7") == ["naïve", "привет", "ствие", "\u00a0", "x", "今", "日", "は", "。", "ok", "7"]
    rng = np.random.default_rng(3)
    some = lambda n: "".join(chr(0x4E00 + i) for i in rng.integers(0, 60, n))
    rows = [(i, "今日" + some(8) + ("馬鹿" if i % 2 else "天気") + some(8)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).where("held_out").collect()
    assert len(got) > 50 and all(r.predicted == r.doc_id % 2 for r in got)


def test_toxicity_weighs_all_words():
    words = np.array(["bad", "fine", "good"])
    keys = toxicity._hashes(pa.array([" ".join(words)]))[0]
    share = np.array([[0.01, 0.09, 0.05], [0.05, 0.05, 0.05], [0.09, 0.01, 0.05]])
    order, none = np.argsort(keys), np.zeros(0, np.uint64)
    model = toxicity.Model(keys[order], share[order], np.ones(2), none, np.zeros((0, 2)), none, np.zeros((0, 4)))
    got = model.evidence(pa.array(["bad bad bad", "bad bad bad good good good", "bad", None]))
    r = dict(zip(words, np.log((share[:, 1] + 0.05) / (share[:, 0] + 0.05))))
    assert np.allclose(got, [[r["bad"]] * 2, [r["bad"], (r["bad"] + r["good"]) / 2], [r["bad"]] * 2, [0, 0]])


def test_toxicity_without_labels_or_texts(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(ROWS) and len({r.score for r in got}) == 1
    assert toxicity.score_documents(docs.limit(0), labels).collect() == []


def test_toxicity_keeps_rows_without_labels_of_both_classes(spark, docs):
    for toxic in ([], [0], [1]):
        marked = [(d, t) for d in range(10, 40) for t in toxic]
        labels = spark.createDataFrame(marked, "doc_id long, toxic int")
        assert toxicity.drop_toxic(docs, labels).count() == len(ROWS)


def test_pipeline_against_brute_force(spark, tmp_path):
    """All rows of run() on a small corpus: planted toxic words, near copies, a benchmark passage, nulls."""
    from test_dedup import fingerprint

    rng = np.random.default_rng(4)
    some = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 400, n))
    rows = [(i, some(40) + (" vile scum dirt vile scum" if i % 3 == 0 else "") + some(10), "en", "abc"[i % 3]) for i in range(240)]
    passage = " ".join(f"q{i}" for i in range(15))
    rows += [(1000 + i, rows[3 * i + 1][1], "en", "a") for i in range(5)] + [(2000 + i, some(20) + f" {passage} " + some(20), "en", "b") for i in range(4)]
    rows += [(3000, None, "en", "a"), (3001, "", "en", None), (3002, some(30), "en", None)]
    docs = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(d, 0, int(d % 3 == 0)) for d, *_ in rows[:240]]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [r for r in rows if "scum" not in (r[1] or "")]
    prints = [fingerprint(r[1]) for r in left]
    group = list(range(len(left)))
    for _ in left:
        group = [min(group[j] for j in range(len(left)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(left))]
    best = {}
    for i, r in enumerate(left):
        place = (r[0] is None, r[0] or 0)
        if group[i] not in best or place < best[group[i]][0]:
            best[group[i]] = (place, r)
    left = [r for _, r in best.values() if passage not in (r[1] or "")]
    frame = spark.createDataFrame([(d, t, s) for d, t, _, s in left], "doc_id long, text string, source string")
    columns, mixed = in_duckdb(mixing.ORACLE_SQL, documents=frame)
    d, size, taken = (columns.index(c) for c in ("doc_id", "size", "taken"))
    want = {r[d]: -(-r[taken] // r[size]) for r in mixed if r[taken]}
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    counts = {}
    for r in got:
        assert r.shard == sharding.jump_hash(np.array([r.doc_id]), 40)[0]
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    empty = f"{tmp_path}/none"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{empty}").collect() == []


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    counts = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        counts.append(len(ids))
        before = spark.createDataFrame(out.collect(), out.schema)
    assert counts == sorted(counts, reverse=True) and counts[2] > 0.7 * docs.count()
    assert {"doc_id", "shard", "slot", "grown_shard"} <= set(before.columns)


def plain_kneser_ney(docs, labels, discount):
    """Evidence (three most telling words, all words) of every text by counting in dictionaries, and the rows of the curve."""

    def tokens_of(text):
        out = []
        for run in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or "")):
            for part in re.findall(r"[\x80-\xbfࠀ-\U0010ffff]|[^\x80-\xbfࠀ-\U0010ffff]+", run):
                out += [(part[i : i + 6], i > 0) for i in range(0, len(part), 6)]
        return out

    words = {d: tokens_of(t) for d, t in docs}
    fold = {d: zlib.crc32(str(d).encode()) % 5 for d, _ in docs}
    around = {d: [(w, ws[i - 1] if i else None, ws[i - 2] if i > 1 else None) for i, w in enumerate(ws)] for d, ws in words.items()}
    after = defaultdict(set)
    for seen in around.values():
        for w, b, _ in seen:
            after[w].add(b)
    everything = sum(map(len, after.values()))
    single, double = [], []
    for y in (0, 1):
        contexts, texts = defaultdict(set), defaultdict(set)
        for d in (d for d in words if labels.get(d) == y and fold[d] in (1, 2, 3)):
            for w, b, two in around[d]:
                for key, context in ((w, b), ((b, w), two)):
                    contexts[len(key) == 2 and isinstance(key[1], tuple), key].add(context)
                    texts[len(key) == 2 and isinstance(key[1], tuple), key].add(d)
        count = {k: min(len(v), len(texts[k])) for k, v in contexts.items()}
        single.append({k: n for (pair, k), n in count.items() if not pair})
        double.append({k: n for (pair, k), n in count.items() if pair})

    def likelihood(y, w, b):
        n = sum(single[y].values())
        p = max(single[y].get(w, 0) - discount, 0) / n
        p += (1 - sum(max(c - discount, 0) for c in single[y].values()) / n) * len(after[w]) / everything
        mine = heads[y].get(b)
        if not mine:
            return p
        left = 1 - sum(max(c - discount, 0) for c in mine.values()) / sum(mine.values())
        return max(mine.get(w, 0) - discount, 0) / sum(mine.values()) + left * p

    heads = [defaultdict(dict), defaultdict(dict)]
    for y in (0, 1):
        for (b, w), n in double[y].items():
            heads[y][b][w] = n
    known, x = {}, {}
    for d, seen in around.items():
        ratios = []
        for w, b, _ in seen:
            if (w, b) not in known:
                known[w, b] = math.log(likelihood(1, w, b)) - math.log(likelihood(0, w, b))
            ratios.append(known[w, b])
        best = sorted(ratios)[-3:]
        x[d] = [sum(best) / len(best), sum(ratios) / len(ratios)] if ratios else [0.0, 0.0]
    pairs_kept = sum(n > discount for y in (0, 1) for n in double[y].values())
    return x, [d for d in words if fold[d] == 4 and labels.get(d) in (0, 1)], pairs_kept


def test_toxicity_against_plain_kneser_ney(spark):
    rng = np.random.default_rng(5)
    common = [f"{a}{b}" for a in ("ka", "lo", "mi", "été", "при") for b in ("re", "sunder", "t", "vastly-un", "9")]
    bad = ["grumblethorpe", "snark", "фубля", "恶言", "«vile»"]
    docs, labels = [(0, None), (1, ""), (2, "..."), (3, "snark " * 500), (4, "never seen words here")], {3: 1}
    for d in range(10, 500):
        toxic = d % 4 == 0
        text = [str(w) for w in rng.choice(common, rng.integers(1, 40), p=np.arange(25, 0, -1) / 325)]
        for _ in range(3 * toxic):
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = ["you", str(rng.choice(bad))]
        docs.append((d, " ".join(text).capitalize()))
        if d % 9:
            labels[d] = int(toxic) if d % 31 else 1 - int(toxic)
    x, curve_rows, pairs_kept = plain_kneser_ney(docs, labels, toxicity.DISCOUNT)
    assert pairs_kept > 10
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([*labels.items(), (4, None), (999, 1)], "doc_id long, toxic int")
    model, curve = toxicity.fit(df, marks)
    got = model.evidence(pa.array([t for _, t in docs]))
    assert np.allclose(got, [x[d] for d, _ in docs], rtol=0, atol=1e-9)
    # The curve is where the penalised likelihood of the rows that no model has seen is flat.
    rows = np.array([[*x[d], 1.0] for d in curve_rows])
    error = 1 / (1 + np.exp(-rows @ curve)) - np.array([labels[d] for d in curve_rows])
    assert np.abs(rows.T @ error + 0.01 * (curve - [1, 1, 0])).max() < 1e-6
    scored = {r.doc_id: r for r in toxicity.score_documents(df, marks).collect()}
    assert len(scored) == len(docs)
    for d, _ in docs:
        want = 1 / (1 + math.exp(-float(np.array([*x[d], 1.0]) @ curve)))
        assert scored[d].score == pytest.approx(want, abs=1e-6)
        assert (scored[d].predicted, scored[d].held_out) == (int(scored[d].score >= 0.5), zlib.crc32(str(d).encode()) % 5 == 0)
