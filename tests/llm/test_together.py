"""Operator 4: the words of many texts are merged together, with the ids that each would have by itself."""

import numpy as np

from feedlens.llm import pieces
from tests.llm.test_dropout import PIECES, keys_of, plain


def test_many_texts_together_have_the_ids_of_a_plain_merge_loop(monkeypatch):
    rng = np.random.default_rng(7)
    words = ["internationalisation", "the", "of", "né", "x" * 60, "y" * 300, "repeatedly" * 6, "\u2581", "a\u2581b", "\U0001f600z", "tab\tnew\nline", "\ue000\ue001"]
    words += ["".join(rng.choice(list("abcdeirstné"), int(rng.integers(1, 30)))) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 60).tolist()) for _ in range(40)]
    want = [[plain(p, " " + w, key) for w, key in zip(t.split(" "), keys_of(p, t, 60))] for p in [pieces.Pieces(PIECES)] for t in texts]
    for cells, limit in ((400_000, 300_000), (50, 1)):
        monkeypatch.setattr(pieces.Pieces, "CELLS", cells)
        monkeypatch.setattr(pieces.Pieces, "LIMIT", limit)
        p = pieces.Pieces(PIECES)
        for again in range(2):
            ids, ends = p.encode_all(texts)
            assert [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])] == [b"".join(w) for w in want]


def test_odd_texts_together_are_those_alone():
    texts = ["", " ", "  a  b ", "\u2581", "\ud800 q", "", "x" * 5000, "a " * 3000, "no \x00 zero"]
    p, one = pieces.Pieces(PIECES), pieces.Pieces(PIECES)
    ids, ends = p.encode_all(texts)
    assert [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])] == [one.encode(t) for t in texts]
    assert [len(x) for x in p.encode_all(["", ""])] == [0, 3] and [len(x) for x in p.encode_all([])] == [0, 1]


def test_rare_words_grow_no_trees(spark, make, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(rng.choice(list("abcdeirst"), 12)) for _ in range(200)) for _ in range(5)]
    p, made = pieces.Pieces(PIECES), []
    for name in ("node", "merged"):
        monkeypatch.setattr(pieces.Pieces, name, lambda *x: made.append(x))
    p.encode_all(texts)
    assert not made
    monkeypatch.undo()
    monkeypatch.setattr(pieces, "TEXT_BYTES", 3000)  # a text or so at a time
    rows = [(i, t) for i, t in enumerate([*texts, None, "", *texts])]
    got = {r.doc_id: list(r.ids) for r in pieces.encode(spark, make(rows), PIECES).collect()}
    assert got == {i: np.frombuffer(p.encode(t or ""), "<u4").tolist() for i, t in rows}


def test_a_first_text_of_one_very_long_word():
    p = pieces.Pieces(PIECES)
    assert p.encode_all(["x" * 5000])[0].tobytes() == pieces.Pieces(PIECES).encode("x" * 5000)
