"""Operator 4: every occurrence of a word draws its own merges."""

import numpy as np
import pytest

from feedlens.llm import pieces, queries

PIECES = queries.tokenizer_path("piece_bpe_32k.model")


def plain(p, word, key):
    """Merge by a plain loop: of all neighbours that make a piece and are not skipped the best, the leftmost of equals."""
    sym = p.symbols(word)
    while True:
        offers = []
        for i, (a, b) in enumerate(zip(sym, sym[1:])):
            rank = p.rank.get(a + b)
            at = sum(map(len, sym[:i]))
            if rank is not None:
                x = (key + rank[1] * 0x9E3779B1 + at * 0x85EBCA77) % 2**32
                x = (x ^ x >> 15) * 0x2C1B3C6D % 2**32
                if x ^ x >> 13 >= int(0.1 * 2**32):
                    offers.append((rank[0], i))
        if not offers:
            return p.ids_of(sym)
        _, i = min(offers)
        sym[i:i + 2] = [sym[i] + sym[i + 1]]


def keys_of(p, text, n):
    import xxhash

    base = xxhash.xxh64_intdigest(text.encode(), p.seed)
    for i in range(n):
        x = (i + base) * 0x9E3779B97F4A7C15 % 2**64
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64
        yield x >> 32


@pytest.mark.parametrize("limit", [300_000, 1])
def test_encoding_equals_a_plain_merge_loop(monkeypatch, limit):
    monkeypatch.setattr(pieces.Pieces, "LIMIT", limit)  # 1: nothing stays remembered
    p, rng = pieces.Pieces(PIECES), np.random.default_rng(1)
    words = ["internationalisation", "unbelievable", "the", "of", "a", "\u2581", "né", "x" * 60, "repeatedly" * 6, "naïveté"]
    words += ["".join(rng.choice(list("abcdeirstné"), int(rng.integers(1, 30)))) for _ in range(60)]
    for k in range(30):
        some = rng.choice(words, 80).tolist()
        text = " ".join(some)
        want = [plain(p, " " + w, key) for w, key in zip(some, keys_of(p, text, len(some)))]
        assert p.encode(text) == b"".join(want)


def test_a_frequent_word_has_more_segmentations_the_more_it_occurs():
    p = pieces.Pieces(PIECES)
    whole = pieces.Pieces(PIECES, dropout=0.0).encode("internationalisation")
    for k in range(40):
        text = "internationalisation " * 100 + str(k)
        assert p.decode(np.frombuffer(p.encode(text), "<u4").tolist()) == text
    found, wait = set(), [p.known[" internationalisation"]]
    while wait:
        node = wait.pop()
        found.add(node.ids)
        wait += node.children.values()
    assert len(found) > 20 and whole in found


def test_remembered_ids_are_those_of_the_occurrences_own_key(monkeypatch):
    node, made = pieces.Pieces.node, []
    monkeypatch.setattr(pieces.Pieces, "node", lambda s, w, k: made.append((w, k)) or node(s, w, k))
    p, fresh = pieces.Pieces(PIECES), pieces.Pieces(PIECES)
    text = "some words repeat and some words do not, repeatedly international words " * 30 + "\u2581 literal"
    first = p.encode(text)
    n = len(made)
    assert p.encode(text) == first and len(made) == n  # all remembered
    monkeypatch.setattr(fresh, "LIMIT", 0)             # a cache that is cleared at every word
    assert fresh.encode(text) == first


def test_a_merge_is_skipped_at_the_rate_of_dropout():
    p = pieces.Pieces(PIECES)
    single = next(w for w in (" of", " in", " on") if p.root(w).n in (2, 3))
    whole = pieces.Pieces(PIECES, dropout=0.0).encode(single[1:])
    ids = p.encode((single[1:] + " ") * 20000)
    n = np.frombuffer(ids, "<u4").tolist().count(int(np.frombuffer(whole, "<u4")[0]))
    assert 0.7 < n / 20000 < 0.95
