"""Merkle manifest, byte-level BPE and alignment against brute force and against the tokenizers' own libraries."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from briefwerk.llm import alignment, bytebpe, manifest

from .data import docs

# ---------------------------------------------------------------- op 11


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, text, lang, source, n_chars = row
    fields = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: x[:3])
        trees[lang] = levels_of([x[2] for x in by_lang[lang]])
    upper = levels_of([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (_, _, leaf, row) in enumerate(by_lang[lang]):
            path = [(level, i >> h) for h, level in enumerate(trees[lang][:-1])] + [(level, k >> h) for h, level in enumerate(upper[:-1])]
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node, found = leaf_of(row, 1) if changed else leaf, []
            for level, at in path:
                other = level[at ^ 1] if at ^ 1 < len(level) else None
                found += [other] if other else []
                node = sha("".join(([other, node] if at & 1 else [node, other]) if other else [node]))
            root = upper[-1][0]
            out.append((row[0], leaf, trees[lang][-1][0], root, sha("".join(found)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_manifest_equals_level_by_level_hashing(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.randrange(10**9), f"text {k} é", rng.choice(["de", "de", "de", "en", "Ж"]), rng.choice(["a", None]), k) for k in range(70)]
    rows += [(None, "", None, None, None), (None, "x", "de", "s", 2**63 - 1), (5, None, "einer", "s", 3), (6, "y" * 100_000, "it", "s", 4)]
    rows += [(9, "twice", "en", "s", 5)] * 3 + [(9, "other", "en", "s", 5), (-3, "minus", "en", "s", None)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, tree int, root string")
    got = sorted((tuple(r) for r in manifest.verified(frame, bits).collect()), key=str)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_nothing(spark):
    assert manifest.verified(docs(spark, []).limit(0)).count() == 0


def test_places_in_the_log_are_those_of_the_builder():
    for n in range(1, 140):
        nodes = [hashlib.sha256(b"%d" % k).digest() for k in range(n)]
        log, level, h = manifest.grow(nodes, manifest.height(n)), nodes, 0
        while True:
            places = manifest.position(n, h, np.arange(len(level)))
            assert [log[p] for p in places] == level
            if len(level) == 1:
                assert len(log) == places[0] + 1
                break
            level = [manifest.digest(*level[k : k + 2]) for k in range(0, len(level), 2)]
            h += 1


# ---------------------------------------------------------------- op 12

BITS = ["a", "b", "Ab", "é", " ", "  ", "\n", "\t", " ", "　", "'", "'s", "'re", "'ll", "'v", "'d", "'S", "1", "23", "½", "!", "...", "日本", "語"]
BITS += ["😀", "\x85", "\x1c", "​", "́", "_", "-", "'t", "re", "²", "<|endoftext|>", "\0", "{}", "Straße", "zz" * 30]


@pytest.fixture(scope="module")
def own():
    with open(public_tokenizers.path(bytebpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(rows, step=bytebpe.SLICE):
    raw = [r.encode() for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    got = [[] for _ in rows]
    for first, ids, ends in bytebpe.encode_texts(bytebpe.load(bytebpe.RANKS), np.frombuffer(b"".join(raw), np.uint8), offsets, step):
        begin = 0
        for k, end in enumerate(ends.tolist(), first):
            got[k] += ids[begin:end].tolist()
            begin = end
    return got


def test_ids_equal_the_library_whatever_the_slices(own):
    rng = random.Random(12)
    for _ in range(150):
        rows = ["".join(rng.choice(BITS) for _ in range(rng.randrange(0, 40))) for _ in range(20)] + ["", ""]
        rng.shuffle(rows)
        assert encode(rows, rng.choice([13, 40, 10**6])) == [own.encode_ordinary(r) for r in rows]


def test_classes_equal_the_library_on_code_points_of_all_planes(own):
    points = [*range(0x3100), *range(0xA000, 0xAC00), *range(0xF900, 0x10400), *range(0x1D000, 0x1FA00), *range(0x2F800, 0x2FA20)]
    points = [c for c in points if not 0xD800 <= c < 0xE000]
    rows = [f"a{chr(c)}1{chr(c)}.{chr(c)} {chr(c)}" for c in points]
    assert encode(rows) == [own.encode_ordinary(r) for r in rows]


def test_scan_equals_stepping_through():
    rng = np.random.default_rng(3)
    # letters of a contraction follow it, as they do in texts
    symbols = rng.integers(0, 8, 5000).astype(np.uint8)
    symbols[np.isin(symbols, [bytebpe.QUOTE1, bytebpe.QUOTE2])] = bytebpe.OTH
    for at in range(0, 4990, 50):
        symbols[at : at + 3] = bytebpe.QUOTE2, bytebpe.LET, bytebpe.LET
    state, want = bytebpe._END, []
    for s in symbols.tolist():
        state = bytebpe._step(state, s)[0]
        want.append(state)
    for block in (2, 7, 512, 10_000):
        assert bytebpe.states(symbols, bytebpe._END, block).tolist() == want


def test_tables_of_ids_and_back(spark, own):
    rows = [(1, "Hello wörld's  end", "de", "s"), (1, None, "de", "s"), (None, "", "de", "s"), (2, "語" * 3000, "de", "s"), (3, "<|endoftext|>", "de", "s")]
    frame = docs(spark, rows)
    tokens = bytebpe.encoded(frame)
    for r in tokens.collect():
        text = next(t or "" for i, t, *_ in rows if i == r.doc_id and own.encode_ordinary(t or "") == list(r.ids))
        lengths = [len(own.decode_single_token_bytes(k)) for k in r.ids]
        assert list(r.ends) == np.cumsum(lengths).tolist() and sum(lengths) == len(text.encode())
    back = sorted(bytes(r.bytes).decode() for r in bytebpe.decoded(tokens).collect())
    assert back == sorted(t or "" for _, t, *_ in rows)
    want = []
    for i, t, *_ in rows:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in bytebpe.digests(frame).collect()), key=str) == sorted(want, key=str)
    assert bytebpe.digests(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- op 13


def bytes_of_entry(entry: str) -> bytes:
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return bytes(hidden[ord(c) - 256] if ord(c) >= 256 else ord(c) for c in entry)


def plain_alignment(rows):
    left = Tokenizer.from_file(public_tokenizers.path(alignment.TOKENIZER))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.PIECES))

    def spans(tokens):
        ends = np.cumsum([len(x) for _, x in tokens]).tolist()
        return [(k, e - len(x), e) for (k, x), e in zip(tokens, ends)]

    found = []
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        a = [(k, bytes_of_entry(left.id_to_token(k))) for k in left.encode(" " + (text or ""), add_special_tokens=False).ids]
        pieces = [(k, right.id_to_piece(k)) for k in right.encode(text or "")]
        b = [(k, bytes([int(p[3:-1], 16)]) if right.is_byte(k) else p.replace("▁", " ").encode()) for k, p in pieces]
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            found.append((i, 0, 0, [], []))
            continue
        a, b = spans(a), spans(b)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [
            ",".join(str(k) for k, _, e in a if s < e <= t) + "|" + ",".join(str(k) for k, _, e in b if s < e <= t)
            for s, t in zip([0, *ends], ends)
        ]
        found.append((i, len(a), len(b), groups, [(p, q) for p, x, y in a for q, u, v in b if x < v and u < y]))
    counts = Counter(pair for *_, links in found for pair in set(links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return sorted(
        (
            (i, a, b, len(g), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links))
            + (hashlib.sha256(";".join(g).encode()).hexdigest() if a else "",)
            for i, a, b, g, links in found
        ),
        key=str,
    )


def alignment_rows():
    rng = random.Random(13)
    bits = ["the", "of", "Haus", "straße", "語", "日本", "😀", " ", "  ", "\n", "\t"]
    odd = ["▁", "<unk>", "<0x41>", "<s>", "<|endoftext|>", "'s", "\0", "　", "x" * 70, "\x1c", "é"]
    rows = []
    for k in range(60):
        n = rng.choice([0, 1, 3, 20, 60])
        rows.append((k, "".join(rng.choice(odd if rng.random() < 0.03 else bits) + rng.choice(["", " "]) for _ in range(n))))
    rows += [(None, "hello there")] * 2 + [(7, None), (7, " "), (8, " a "), (9, "a" * 300), (10, " " * 100), (11, "日本語" * 60)]
    return rows


@pytest.mark.parametrize("bounds", [{}, {"size": 48, "slice_size": 300, "fan": 2}, {"size": 7, "fan": 3}])
def test_alignment_equals_brute_force_whatever_the_ranges(spark, bounds):
    rows = alignment_rows()
    frame = docs(spark, [(i, t, "de", "s") for i, t in rows])
    got = sorted((tuple(r) for r in alignment.alignments(frame, **bounds).collect()), key=str)
    assert got == plain_alignment(rows)


def test_fragments_compose_in_any_order():
    rng = random.Random(14)
    for _ in range(400):
        text = " " + "".join(rng.choice(["a", " ", "b ", "\n", "é", "  "]) for _ in range(rng.randrange(1, 30)))
        cuts = sorted({0, len(text), *(rng.randrange(len(text)) for _ in range(6))})
        closed, held = [], []
        for a, b in zip(cuts, cuts[1:]):
            x, done = alignment.fragment(text[a:b], len(text[:a].encode()))
            held.append(x)
            closed += done
        while len(held) > 1:
            k = rng.randrange(len(held) - 1)
            x, done = alignment.compose(held[k], held[k + 1])
            held[k : k + 2] = [x]
            closed += done
        closed += alignment.finish(held[0], len(text.encode()))
        assert [u for _, some in sorted(closed) for u in some] == re.split(r"(?<=\S)(?= )", text)


def test_alignment_of_nothing(spark):
    assert alignment.alignments(docs(spark, []).limit(0)).count() == 0
