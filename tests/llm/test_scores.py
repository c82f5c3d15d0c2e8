"""Scores of the classifiers against plain versions in Python, on fixed models."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import zstandard

from briefwerk.llm import language, quality, toxicity

M64 = (1 << 64) - 1
TEXTS = ["", None, "x", "Ein Satz, mit Wörtern und 12 Zahlen.", "the same the same the same", "ñandú!  ... ÄÖÜ\n\tß", "İstanbul ſ", "語" * 40]


def words(rng, n):
    return " ".join(rng.choice(["haus", "Baum", "été", "x1", "--", "the", "Ж"]) + rng.choice(["", "en", "S", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return TEXTS + [words(rng, rng.randrange(1, 60)) for _ in range(30)]


def test_language_scores_equal_plain_counting(texts):
    rng = np.random.default_rng(1)
    names, of = ["aa", "bb", "cc"], np.array([0, 0, 1, 2, 2])
    centroids = np.abs(rng.standard_normal((5, language.PLACES))).astype(np.float32)
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    idf = (1 + rng.random(language.PLACES)).astype(np.float32)
    found = language.Model(names, centroids, of, np.array([0.1, 0.2, 0.3]), idf).predict(texts)
    for k, text in enumerate(texts):
        runs = []  # letters, and one blank for every run of other characters
        for c in f" {text.lower()} " if text else "":
            if c.isalpha():
                runs.append(ord(c))
            elif not runs or runs[-1] != 32:
                runs.append(32)
        counts = Counter()
        for n in (1, 2, 3):
            for at in range(len(runs) - n + 1):
                h = runs[at]
                for c in runs[at + 1 : at + n]:
                    h = (h * 0x9E3779B97F4A7C15 + c) & M64
                x = ((h + n) & M64) ^ (h >> 31)
                counts[((x * 0xD6E8FEB86659FD93) & M64) >> (64 - language.BITS)] += 1
        if not text or not any(c.isalpha() for c in text.lower()):
            assert (found[0][k], found[1][k]) == ("und", 0.0)
            continue
        vector = {p: math.sqrt(n) * float(idf[p]) for p, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * float(c[p]) for p, v in vector.items()) / norm for c in centroids]
        best = [max(x for x, o in zip(cosines, of) if o == m) for m in range(3)]
        top = max(range(3), key=lambda m: best[m])
        assert found[0][k] == names[top]
        assert found[1][k] == pytest.approx(1 / sum(math.exp(language.SHARPNESS * (b - best[top])) for b in best), rel=1e-2)
        assert found[2][k] == pytest.approx(best[top], abs=1e-5)


def test_toxicity_scores_equal_plain_sums(texts):
    weights = np.random.default_rng(2).standard_normal(toxicity.PLACES) * 0.05
    got = toxicity.Model(weights, -0.3).score(texts)
    for k, text in enumerate(texts):
        codes = [ord(c) if c.isalnum() else 32 for c in (f" {text.lower()} " if text else "")]
        places = set()
        for n in toxicity.ORDERS:
            for at in range(len(codes) - n + 1):
                h = codes[at]
                for c in codes[at + 1 : at + n]:
                    h = (h * 0x9E3779B97F4A7C15 + c) & M64
                x = h ^ (h >> 29)
                places.add(((x * 0xBF58476D1CE4E5B9) & M64) >> (64 - toxicity.PLACES_BITS))
        margin = -0.3 + sum(float(w) for p in places if abs(w := np.float32(weights[p])) > 1e-3)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-4)


def test_quality_scores_equal_plain_compression(texts):
    rng = random.Random(6)
    good, bad = (words(rng, 3000).encode() for _ in range(2))
    model = quality.Model(good, bad, 64)
    model.weights = np.array([0.2, 1.5, -0.7])
    raw = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = model.score(model.features(np.frombuffer(b"".join(raw), np.uint8), offsets))

    def size(part, dictionary=None):
        more = {"dict_data": zstandard.ZstdCompressionDict(dictionary), "write_content_size": False, "write_dict_id": False} if dictionary else {}
        return len(zstandard.ZstdCompressor(level=3 if dictionary else 1, write_checksum=False, **more).compress(part))

    for k, r in enumerate(raw):
        difference, ratio = 0.0, 1.0
        if r:
            parts = [r[at : at + 64] for at in range(0, len(r), 64)]
            g, b = (sum(size(p, d) for p in parts) for d in (good, bad))
            difference, ratio = (b - g) / (b + g), min(1.0, size(r) / len(r))
        margin = 0.2 + 1.5 * 10 * difference - 0.7 * ratio
        assert got[k] == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-9)
