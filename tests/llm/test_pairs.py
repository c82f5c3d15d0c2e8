"""Near-duplicates, embeddings, components and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from briefwerk.llm import common, decontaminate, embeddings, jaccard
from briefwerk.llm.components import components

from .data import docs, rows_of, words

WORD = re.compile(common.WORD)


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def sets(text, size=5):
    w = split(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def reach(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_hashed_words_agree_with_the_pattern():
    rng = random.Random(3)
    texts = ["", None, "A b", "héllo WORLD 12_x"]
    texts += ["".join(rng.choice("aBé _,\n9ß") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["x" * 200_000]
    data, offsets = common.texts(pa.record_batch({"text": pa.array(texts)}))
    for step in (1 << 17, 37):
        h, first, start, end = common.hashed_words(data, offsets, step)
        seen = {}
        for i, t in enumerate(texts):
            found = split(t)
            assert len(found) == first[i + 1] - first[i]
            for k, w in enumerate(found):
                assert seen.setdefault(w, int(h[first[i] + k])) == int(h[first[i] + k])
                at = first[i] + k
                assert bytes(data[start[at] : end[at]]).decode().lower() == w.lower()
        assert len(set(seen.values())) == len(seen)


def test_pieces_and_groups_keep_rows():
    batch = pa.record_batch({"text": pa.array(["a" * k for k in range(40)]), "k": pa.array([k // 7 for k in range(40)])})
    assert sum(p.num_rows for p in common.pieces(batch, limit=50)) == 40
    groups = list(common.whole_groups((batch.slice(k, 3) for k in range(0, 40, 3)), ["k"]))
    assert sum(g.num_rows for g in groups) == 40
    ends = [set(g.column("k").to_pylist()) for g in groups]
    assert all(not (a & b) for k, a in enumerate(ends) for b in ends[k + 1 :])


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 30)] + [(7, 7)] + [(500, 501), (501, 500)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = dict(rows_of(components(spark.createDataFrame(links, "a bigint, b bigint")), "node", "component"))
    want = reach(600, links)
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_near(rows, threshold=0.8):
    s = [sets(t) for _, t, _, _ in rows]
    links = [
        (a, b) for a in range(len(rows)) for b in range(a) if s[a] and s[b] and 10 * len(s[a] & s[b]) >= 8 * len(s[a] | s[b])
    ]
    label = reach(len(rows), links)
    count = [sum(k in pair for pair in links) for k in range(len(rows))]
    ids = {c: min((rows[k][0] for k in range(len(rows)) if label[k] == c and rows[k][0] is not None), default=None) for c in set(label)}
    return [(rows[k][0], ids[label[k]], count[k]) for k in range(len(rows))]


def brute_classes(rows, threshold=0.8):
    """(smallest id of its class, number of its class) of every row."""
    s = [sets(t) for _, t, _, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if s[a] and s[b] and 10 * len(s[a] & s[b]) >= 8 * len(s[a] | s[b])]
    label = reach(len(rows), links)
    ids = {c: min((rows[k][0] for k in range(len(rows)) if label[k] == c and rows[k][0] is not None), default=None) for c in set(label)}
    return [(ids[label[k]], label[k]) for k in range(len(rows))]


def near_rows():
    rng = random.Random(11)
    rows = []
    base = words(rng, 120)
    for k in range(60):  # a large group of near copies
        w = base.split()
        w[rng.randrange(len(w))] = f"x{k}"
        rows.append((1000 + k, " ".join(w), "en", "a"))
    passage = words(rng, 60)
    for k in range(20):  # a passage that many share
        rows.append((2000 + k, f"{words(rng, 40)} {passage} {words(rng, 40)}", "en", "b"))
    for k in range(30):  # pairs around the threshold
        w = words(rng, 150).split()
        rows.append((3000 + 2 * k, " ".join(w), "en", "a"))
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"y{k}"
        rows.append((3001 + 2 * k, " ".join(w), "en", "a"))
    rows += [(1, None, None, None), (2, "", "en", None), (3, "!!! ...", "en", "a"), (4, "one two", "en", "a"), (5, "One, TWO!", "de", "b")]
    rows += [(6, base, "en", "a")] * 3 + [(None, base, "en", "a"), (None, "lonely text without an id here", "en", "a")]
    rows += [(7, words(rng, 20_000, 9000), "en", "a")]
    return rows


@pytest.mark.parametrize("tiles", [{}, {"bucket_rows": 8, "tile_rows": 8, "tile_shingles": 2000}])
def test_near_duplicates_equal_brute_force(spark, tiles):
    rows = near_rows()
    found = jaccard.near_duplicates(docs(spark, rows), **tiles)
    want = sorted(brute_near(rows), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert rows_of(found, "doc_id", "class_id", "n_links") == want


def test_near_duplicates_keep_one_of_each_group(spark):
    rows = near_rows()
    kept = jaccard.deduplicated(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    # one row of each class, repeated rows and rows without an id included; of a class, one with the smallest id
    want = Counter(key for key, _ in {(c, n) for c, n in brute_classes(rows)})
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == want
    assert jaccard.deduplicated(docs(spark, [])).count() == 0


def test_pruning_bound_keeps_what_may_reach_the_threshold():
    least = jaccard.least_matches(96, 0.8, 1e-8)
    assert len(least) == 6 and least == sorted(least)
    assert least[0] < 16 * 0.8 and least[-1] < 96 * 0.8


def brute_vectors(rows, cosine=0.98):
    links = []
    for a in range(len(rows)):
        for b in range(a):
            (_, x, la), (_, y, lb) = rows[a], rows[b]
            if la is None or la != lb or x is None or y is None or len(x) != len(y):
                continue
            if any(v is None or not np.isfinite(v) for v in x + y):
                continue
            x, y = np.array(x, dtype=float), np.array(y, dtype=float)
            if x.any() and y.any() and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links.append((a, b))
    label = reach(len(rows), links)
    ids = {c: min(rows[k][0] for k in range(len(rows)) if label[k] == c) for c in set(label)}
    return [(rows[k][0], sum(k in pair for pair in links), ids[label[k]]) for k in range(len(rows))]


@pytest.mark.parametrize("tiles", [{}, {"cell_rows": 16, "tile_rows": 16}])
@pytest.mark.parametrize("dims", [64, 5])
def test_near_vectors_equal_brute_force(spark, dims, tiles):
    rng = np.random.default_rng(dims)
    rows = []
    for g in range(6):
        centre = rng.standard_normal(dims)
        for _ in range(25):
            v = centre + rng.standard_normal(dims) * (0.02 + 0.05 * g)
            rows.append([float(np.float32(x)) for x in v])
    rows += [rows[0], [2 * x for x in rows[0]], rows[0], [0.0] * dims, [1.0] * (dims - 1), [float("nan")] * dims, [float("inf")] * dims]
    rows = [(10 * k, v, k % 2) for k, v in enumerate(rows)]
    rows += [(5, None, 1), (15, rows[0][1], None), (25, [None] * dims, 1), (35, [], 0), (45, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id bigint, embedding array<float>, label int, rep bigint, cell string")
    found = embeddings.near_vectors(df, **tiles)
    assert rows_of(found, "vec_id", "n_links", "component_id") == sorted(brute_vectors(rows), key=lambda r: tuple((False, str(v)) for v in r))
    assert found.where("kept <> (vec_id = component_id)").count() == 0
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_many_labels_and_dimensions_stay_apart(spark):
    rng = np.random.default_rng(1)
    rows = []
    for label, dims in ((0, 128), (1, 64), (2, 64), (1, 128), (-1, 192), (0, 64)):
        centre = rng.standard_normal(dims)
        rows += [([float(x) for x in centre + rng.standard_normal(dims) * 0.05], label) for _ in range(12)]
    rows = [(k, v, label) for k, (v, label) in enumerate(rows)]
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    assert rows_of(found, "vec_id", "n_links", "component_id") == sorted(brute_vectors(rows), key=lambda r: tuple((False, str(v)) for v in r))


def test_rows_without_an_id_are_kept_if_nothing_they_link_with_has_one(spark):
    rows = [(None, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (4, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (None, None, 0)]
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert rows_of(found, "vec_id", "component_id", "kept") == [(4, 4, True), (None, 4, False), *[(None, None, True)] * 3]


def test_rotation_is_orthogonal():
    q = embeddings.rotation(12)
    assert np.allclose(q @ q.T, np.eye(12))


def test_suffix_order_is_the_sorted_one():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 400):
        symbols = rng.integers(1, 4, n)
        at = np.unique(np.r_[rng.integers(0, n, max(1, n // 30)), n - 1])
        symbols[at] = 0
        order = decontaminate.suffix_order(symbols, at)
        rank = {p: k for k, p in enumerate(at)}
        key = lambda p: tuple((0, rank[q]) if q in rank else (1, symbols[q]) for q in range(p, n))  # noqa: E731, B023
        assert list(order) == sorted(range(n), key=key)


def test_wavelet_ranks():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 37, 1000)
    bits, ranks, zeros = decontaminate.wavelet(values, 6)
    index = object.__new__(decontaminate.Index)
    index.levels, index.zeros = [decontaminate.Bits(a, b) for a, b in zip(bits, ranks, strict=True)], zeros
    at, symbol = rng.integers(0, 1001, 300), rng.integers(0, 37, 300)
    assert list(index.rank(symbol, at)) == [int((values[:i] == c).sum()) for i, c in zip(at, symbol, strict=True)]


def brute_contamination(rows, items, window=10):
    windows = set()
    for i, t in items:
        w = split(t)
        if i is not None and w:
            n = min(window, len(w))
            windows |= {(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1)}
    out = []
    for doc_id, t, *_ in rows:
        w, hit, names = split(t), set(), set()
        for i, phrase in windows:
            for k in range(len(w) - len(phrase) + 1):
                if tuple(w[k : k + len(phrase)]) == phrase:
                    hit |= set(range(k, k + len(phrase)))
                    names.add(str(i))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), digest, bool(hit)))
    return out


@pytest.mark.parametrize("shard_words", [1 << 20, 64])
def test_contamination_equals_brute_force(spark, monkeypatch, shard_words):
    rng = random.Random(8)
    items = [(k, words(rng, rng.randrange(10, 40), 60)) for k in range(25)]
    items += [(100, "Short item, here"), (101, None), (102, ""), (103, items[0][1].upper()), (104, items[1][1]), (104, items[1][1]), (None, "w1 w2")]
    rows = [(k, words(rng, rng.randrange(0, 60), 60), "en", "a") for k in range(40)]
    for k in range(30):
        some = rng.choice(items[:25])[1].split()
        cut = rng.randrange(len(some))
        rows.append((100 + k, f"{words(rng, 30)} {' '.join(some[cut:])} {words(rng, 5)} {' '.join(some[:12])}", "en", "a"))
    rows += [(900, None, None, None), (901, "", "en", "a"), (902, "a SHORT item here", "en", "b"), (None, items[2][1], "en", "a")]
    rows += [(903, items[3][1], "en", "a")] * 2 + [(904, " ".join(t for _, t in items[:25]) * 3, "en", "a")]
    benchmark = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, doc_id bigint")
    monkeypatch.setattr(decontaminate, "build_index", lambda d, w, _, build=decontaminate.build_index: build(d, w, shard_words))
    hits = decontaminate.phrase_hits
    monkeypatch.setattr(decontaminate, "phrase_hits", lambda i, p, w, b: hits(i, p, w, 150 if shard_words == 64 else b))
    monkeypatch.setattr(decontaminate, "table", lambda _s, _d, name: docs(spark, rows) if name == "documents" else benchmark)
    got = rows_of(decontaminate.op8_decontaminate(spark, ""), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute_contamination(rows, items), key=lambda r: tuple((v is None, str(v)) for v in r))
    clean = decontaminate.decontaminated(docs(spark, rows), benchmark)
    assert clean.columns == docs(spark, rows).columns
    want = [r[0] for r in brute_contamination(rows, items) if not r[5]]
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == sorted(want)


def test_contamination_of_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    some = docs(spark, [(1, "x a b c y", "en", "a")])
    assert decontaminate.contaminated_spans(docs(spark, []), benchmark).count() == 0
    (row,) = decontaminate.contaminated_spans(some, benchmark.limit(0)).collect()
    assert row.spans == [] and row.n_words == 5
    (row,) = decontaminate.contaminated_spans(some, benchmark).collect()
    assert [tuple(s) for s in row.spans] == [(1, 4)]
