"""Repeated strings, near-equal lines, equal texts and fingerprints against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from strata.llm import exact, lines, repeats, simhash, suffixes

SCHEMA = "doc_id long, text string"
EDGES = [(1, None), (2, ""), (3, "a" * 100), (3, "a" * 100), (None, "some text without an id"), (4, "xy" * 70), (5, " \n\t"), (6, "é" * 9)]


def words(rng, n):
    return " ".join(rng.choice(["ab", "é", "xyz", "foo", "q", "zz9", "lorem", "ip"]) for _ in range(n))


def documents(seed=3):
    rng = random.Random(seed)
    shared = [words(rng, 14) for _ in range(5)]
    rows = list(EDGES)
    for i in range(60):
        text = words(rng, rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            text += rng.choice(shared) + words(rng, rng.randint(0, 8))
        rows.append((10 + i, text))
    rows += [(200 + i, rows[20 + i][1]) for i in range(5)]
    return rows + [(300 + i, (rows[30 + i][1] or "").replace("a", "b", 2)) for i in range(5)]


def test_suffix_arrays_and_prefixes(monkeypatch):
    rng = random.Random(1)
    for _ in range(500):
        monkeypatch.setattr(suffixes, "LEAST_PER_BUCKET", rng.choice([0, 1, 64]))
        n, k = rng.randint(1, 50), rng.choice([1, 2, 3, 5])
        text = np.array([rng.randrange(k) for _ in range(n)])
        as_list, sa = text.tolist(), suffixes.suffix_array(text, k)
        assert sa.tolist() == sorted(range(n), key=lambda i: as_list[i:])
        prefix, phi = suffixes.permuted_prefixes(text, sa)
        for i, j in enumerate(phi.tolist()):
            c = 0
            while j >= 0 and max(i, j) + c < n and as_list[i + c] == as_list[j + c]:
                c += 1
            assert prefix[i] == c


def without_repeats(rows, width):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + width] for _, t in texts for i in range(len(t) - width + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "gram", "most"), [(24, 8, 2000), (24, 8, 3), (40, 16, 3), (70, 8, 2)])
def test_repeated_strings(spark, width, gram, most):
    rows = documents()
    got = repeats.drop_repeats(spark.createDataFrame(rows, SCHEMA), width, gram, most)
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == without_repeats(rows, width)


def test_repeated_strings_at_full_width(spark):
    """Production width: a passage that many texts share, one with a counter inside, equal texts, a text full of itself."""
    rng = random.Random(8)
    passage, other = words(rng, 220), words(rng, 200)
    rows = [(i, words(rng, rng.randint(0, 60)) + passage[rng.randint(0, 40) :] + words(rng, rng.randint(0, 60))) for i in range(40)]
    rows += [(100 + i, f"{other[:300]} page {i} {other[300:]}") for i in range(40)]
    rows += [(200 + i, "the same text " * 40) for i in range(30)] + [(300, "ab" * 700), (301, None), (302, ""), (303, "é" * 300), (None, passage), (None, "x")]
    rows += [(400 + i, words(rng, 120)) for i in range(20)] + [(500, words(rng, 20_000) + passage)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").repartition(5)
    for most in (repeats.MOST_SEGMENTS, 12):
        got = repeats.drop_repeats(df, most=most).collect()
        assert sorted([tuple(r)[:5] for r in got], key=str) == without_repeats(rows, 400)


def test_strings_whose_parts_repeat(spark):
    """Passages in which a phrase stands twice, in two texts and in copies of texts: the anchor is at either of its places."""
    rng, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyz"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for width, gram, phrase in ((24, 8, 10), (400, 16, 120)):
        rows = []
        for i in range(150):
            part = some(phrase)
            passage = some(rng.randint(0, 2)) + part + some(rng.randint(0, phrase // 5)) + part + some(width - 2 * phrase)
            rows += [(2 * i + k, some(rng.randint(0, 2 * width)) + passage + some(rng.randint(0, width))) for k in (0, 1)]
        rows += [(1000 + i, rows[5 * i][1]) for i in range(50)]
        got = repeats.drop_repeats(spark.createDataFrame(rows, SCHEMA), width, gram).collect()
        assert sorted([tuple(r)[:5] for r in got], key=str) == without_repeats(rows, width)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rng = random.Random(2)
    pairs = []
    for _ in range(3000):
        a = [rng.randrange(3) for _ in range(rng.randint(0, 14))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randint(0, 2)):
            b.insert(rng.randint(0, len(b)), rng.randrange(3))
        pairs.append((bytes(a), bytes(b), rng.randint(0, 4)))
    data = np.frombuffer(b"".join(a + b for a, b, _ in pairs), np.uint8)
    la, lb = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    at = np.r_[0, np.cumsum(la + lb)][:-1]
    got = lines.within(data, at, la, at + la, lb, np.array([m for *_, m in pairs]))
    assert got.tolist() == [distance(a, b) <= m for a, b, m in pairs]


def line_classes(rows):
    found = [(d, i, x) for d, t in rows for i, x in enumerate((t or "").encode().split(b"\n")) if x.strip(b" \t\n\r\x0b\x0c")]
    kinds, degree = sorted({x for *_, x in found}), defaultdict(int)
    parent = {x: x for x in kinds}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(kinds):
        for y in kinds[i + 1 :]:
            most = min(2, max(len(x), len(y)) // 5)
            if abs(len(x) - len(y)) <= most and distance(x, y) <= most:
                degree[x] += 1
                degree[y] += 1
                parent[root(x)] = root(y)
    first = {}
    for d, i, x in found:
        place = (d is None, d or 0, i)
        first[root(x)] = min(first.get(root(x), place), place)
    out = []
    for d, i, x in found:
        z, fd, fi = first[root(x)]
        fd = None if z else fd
        out.append((d, i, len(x), fd, fi, degree[x], (d, i) == (fd, fi)))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [512, 3])
def test_near_equal_lines(spark, tile):
    rng = random.Random(2)
    base = [words(rng, rng.randint(1, 7)) for _ in range(40)]

    def edited(x):
        for _ in range(rng.randint(0, 3)):
            p = rng.randint(0, len(x))
            x = rng.choice([x[:p] + "k" + x[p:], x[:p] + x[p + 1 :], x[:p] + "w" + x[p + 1 :]])
        return x

    rows = [*EDGES, (7, base[0] + "\n"), (8, "\n\nabc\nabd\n")]
    rows += [(10 + i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randint(0, 5)))) for i in range(50)]
    got = lines.line_classes(spark.createDataFrame(rows, SCHEMA), 2, tile)
    assert sorted(map(tuple, got.collect()), key=str) == line_classes(rows)


def test_many_forms_of_a_line(spark):
    """A template with a counter: the links are counted, and a forest of them leaves the tasks."""
    rows = [(i, f"page {i:04d} of the collected works of nobody in particular\n" + "x" * 20_000) for i in range(700)]
    kinds, degree = [t.split("\n")[0] for _, t in rows], Counter()
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if sum(x != y for x, y in zip(a[5:9], b[5:9])) <= 2 or distance(a[5:9], b[5:9]) <= 2:
                degree[a] += 1
                degree[b] += 1
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    got = lines.line_classes(df, 2, 100).where("line_no = 0").collect()
    assert {r.doc_id: r.n_links for r in got} == {i: degree[k] for (i, _), k in zip(rows, kinds)}
    assert {(r.class_doc_id, r.class_line_no) for r in got} == {(0, 0)} and [r.doc_id for r in got if r.kept] == [0]


def fingerprint(text):
    found = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    rows = [r for r in documents(5) if r[0] is not None]
    rows = list(dict(rows).items())
    prints = {d: fingerprint(t) for d, t in rows}
    component = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and component[a] > component[b]:
                    component[a], changed = component[b], True
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()}
    assert got == {d: (f"{prints[d]:016x}", component[d]) for d in prints}
    stay = simhash.keep_one(df.selectExpr("*", "1 h", "2 c"))
    assert stay.columns == ["doc_id", "text", "h", "c"]
    assert sorted(r.doc_id for r in stay.collect()) == sorted(d for d in prints if component[d] == d)


def test_one_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(1, "a b c d"), (1, "quite another text under this id"), (2, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, "x y z")]
    rows += [(5, None), (4, ""), (6, "x y z w v u"), (6, "x y z w v u"), (7, long), (8, long + " tail"), (9, None)]
    df = spark.createDataFrame([(d, t, i % 2, "k") for i, (d, t) in enumerate(rows)], "doc_id long, text string, _key int, _doc_id string")
    kinds = defaultdict(list)
    for d, t in rows:
        kinds[fingerprint(t)].append((d is None, d or 0, hashlib.md5((t or "").encode()).hexdigest(), d, t))
    prints = list(kinds)
    for a in prints:
        for b in prints:
            if a != b and kinds[a] and (a ^ b).bit_count() <= 3:
                kinds[b] += kinds[a]
                kinds[a] = []
    want = sorted((min(k)[3:] for k in kinds.values() if k), key=str)
    for _ in range(2):
        stay = simhash.keep_one(df.repartition(3))
        assert stay.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in stay.collect()), key=str) == want


def test_fingerprints_of_long_texts(monkeypatch):
    texts = [words(random.Random(i), n) for i, n in enumerate((0, 1, 2, 3, 50, 400, 5))] + [None, "A\tb \n c"]
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.simhash_batch(pa.array(texts, pa.string())).tolist() == [fingerprint(t) for t in texts]


def test_equal_texts(spark):
    rows = [r for r in documents() if r[0] is not None and r != (3, "a" * 100)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = df.toPandas()
    con = duckdb.connect()
    con.sql("create or replace temp view documents as select * from got")
    want = sorted(con.sql(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({exact.ORACLE_SQL})").fetchall())
    assert sorted(tuple(r) for r in exact.exact_dedup(df, 0.05).collect()) == want
    twice = exact.exact_dedup(spark.createDataFrame(EDGES, SCHEMA)).collect()
    assert len(twice) == len(EDGES) and sum(r.kept for r in twice if r.doc_id == 3) == 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    for f in (repeats.drop_repeats, lines.line_classes, simhash.simhash_components, simhash.keep_one, exact.exact_dedup):
        assert f(df).collect() == []
