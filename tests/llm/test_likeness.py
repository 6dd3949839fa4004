"""Operator 7: the likeness of single documents against the exact cosine of their runs."""

import collections
import math

import numpy as np

from feedlens.llm import fingerprints


def runs(text):
    out = collections.Counter()
    for line in text.split("\n"):
        w = line.split()
        out.update(zip(w, w[1:]) if len(w) > 1 else w)
    return out


def cosine(a, b):
    a, b = runs(a), runs(b)
    return sum(n * b[k] for k, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def test_error_of_single_documents(spark, make):
    rng = np.random.default_rng(7)
    texts = ["\n".join(" ".join(f"w{x}" for x in rng.integers(0, 5000, 50)) for _ in range(4)) for _ in range(400)]
    got = sorted(fingerprints.fingerprints(spark, make(list(enumerate(texts)))).collect())
    edited, following = [], []
    for r, text, after in zip(got, texts, texts[1:] + texts[:1]):
        k = len(text) // 4
        edited.append(r.near_edited - cosine(text, text[:len(text) - k] + after[:k]))
        following.append(r.near_next - cosine(text, after))
    rms = lambda x: math.sqrt(np.mean(np.square(x)))
    print("rms error", rms(edited), rms(following))
    # Negative estimates are 0, so the error of unrelated texts is 1 / sqrt(2 * lanes): 0.0625 for 128.
    assert rms(following) < 0.075 and rms(edited) < 0.06
    assert max(map(abs, edited + following)) < 0.4
