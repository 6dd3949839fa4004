"""T8 summaries and T5 text vectors against plain models."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedlens.functions.summary import summary
from feedlens.functions.text import STOP_WORDS
from feedlens.operators import retrieval as RT


def clean(text):
    return "".join(c for c in text.replace("\n", " ") if c.isalpha() or c in " _").lower()


def plain_summary(context, n=2, overlap=0.5):
    if context is None:
        return None
    cut = [s.strip(" ") for s in re.findall(r"[^.!?\n]+[.!?]*", context) if s.strip(" ")]
    words = [[w for w in clean(s).split(" ") if w and w not in STOP_WORDS] for s in cut]
    centroid = Counter(w for ws in words for w in ws)
    score = [sum(centroid[w] for w in ws) / math.sqrt(sum(c * c for c in Counter(ws).values())) if ws else 0.0 for ws in words]
    taken = []
    for i in sorted(range(len(cut)), key=lambda i: (-score[i], i)):
        alike = lambda j: len(set(words[i]) & set(words[j])) / len(set(words[i]) | set(words[j])) if words[i] or words[j] else 0.0  # noqa: E731, B023
        if len(taken) < n and all(alike(j) < overlap for j in taken):
            taken.append(i)
    return " ".join(cut[i] for i in taken) or context


def test_summary_equals_the_plain_one(spark):
    rng = random.Random(4)
    vocabulary = ["fast", "slow", "shop", "price", "the", "and", "Good", "bad!", "help?", "x.", "return\n", "", "service", "été", "1"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 40))) for _ in range(150)]
    texts += [None, "", " \n ", "...", "the and of", "One sentence only", "Good shop. Good shop! Good shop?", "a b c\nd e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for n, overlap in ((2, 0.5), (1, 0.5), (5, 0.2)):
        got = {r.i: r.s for r in df.select("i", summary(F.col("t"), n, overlap).alias("s")).collect()}
        assert [got[i] for i in range(len(texts))] == [plain_summary(t, n, overlap) for t in texts]


def test_summary_leaves_repetitions_out(spark):
    text = "Delivery was late again. Delivery was late again today! The price is fair.\nDelivery late."
    out = spark.range(1).select(summary(F.lit(text)).alias("s")).first().s
    assert out.startswith("Delivery") and out.endswith("The price is fair.") and out.count("elivery") == 1


def test_answers_take_any_summariser(spark):
    companies = spark.createDataFrame([("c",)], "company string")
    topics = spark.createDataFrame([("t",)], "topic string")
    context = spark.createDataFrame([("c", "neutral", "reddit", "t", "A b. C d.")], "company string, sentiment string, source string, topic string, context string")
    rows = RT.answers(companies, context, topics, summarize=F.upper).collect()
    assert sorted({r.answer for r in rows}) == ["A B. C D.", RT.NO_REVIEWS] and len(rows) == 9


def plain_vector(text, df, n):
    v = [0] * 64
    for w in clean(text or "").split(" "):
        if w:
            digits = hashlib.md5(w.encode()).hexdigest()
            weight = round(1e4 * (1 + math.log((1 + n) / (1 + df.get(w, 0)))))
            v[int(digits[:8], 16) % 64] += weight if digits[8] < "8" else -weight
    length = math.sqrt(sum(x * x for x in v))
    return [x / length if length else 0.0 for x in v]


def test_vectors_equal_plain_sums(spark):
    texts = ["good good shop", "bad shop", "", None, "Good, SHOP!", "été 12 x", "word " * 300, "unique"]
    df = Counter(w for t in texts for w in set(clean(t or "").split(" ")) - {""})
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, chunk string")
    weights = RT.word_weights(rows)
    asked = rows.unionByName(spark.createDataFrame([(100, "unseen words only"), (101, "shop unseen")], "id int, chunk string"))
    got = {r.id: r.embedding for r in RT.embed_text(asked, weights).collect()}
    for i, t in [*enumerate(texts), (100, "unseen words only"), (101, "shop unseen")]:
        assert got[i] == pytest.approx(plain_vector(t, df, len(texts)), abs=1e-12)
    assert got[0] != got[1] and all(abs(sum(x * x for x in v) - 1) < 1e-9 for i, v in got.items() if i not in (2, 3))


def test_empty_corpus(spark):
    rows = spark.createDataFrame([], "id int, chunk string")
    assert RT.embed_text(rows, RT.word_weights(rows)).count() == 0
    assert [(r.word, r.weight) for r in RT.word_weights(rows).collect()] == [(None, 10_000)]
