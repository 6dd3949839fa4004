"""Fill-in-middle: against a plain model on strings, and both ways."""

import hashlib
import random
import re

import pytest

from feedlens.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def model(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts():
    rng = random.Random(3)
    words = ["a", "<P", "P>", "<", ">", "<S", "S>", "<M", "ü", "😀", "\x00", " ", "\x0b", "  ", "\n", " ", "word", "<M>", "\x1c"]
    return ["", " ", "x", "x ", " x", *("".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(400))]


def test_rows_equal_the_model_and_are_restored():
    forms = set()
    for i, text in enumerate(odd_texts()):
        *got, output = fill_middle.cut_row(i, text.encode(), 42, 50, 80)
        assert (*got, output.decode()) == model(i, text)
        assert fill_middle.original(output, got[1]) == text.encode()
        forms.add(got[1])
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [1, 2, 7])
def test_blocks_of_any_size_give_the_same(monkeypatch, block):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    test_rows_equal_the_model_and_are_restored()


def test_three_reversals_exchange_blocks(monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", 4)
    for split in range(12):
        buf = bytearray(b"0123456789ab")
        fill_middle.exchange(buf, 1, max(1, split), 11)
        assert buf == b"0" + b"123456789a"[max(0, split - 1):] + b"123456789a"[:max(0, split - 1)] + b"b"


def test_odd_rows_on_spark(spark, odd, empty):
    out = fill_middle.restore(spark, fill_middle.transform(spark, odd))
    rows = out.collect()
    want = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(((r.doc_id, r.restored) for r in rows), key=str) == sorted(((i, t or "") for i, t in want), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows), key=str) == sorted(
        ((i, *model(i, t)) for i, t in want), key=str)
    assert fill_middle.digests(spark, empty).count() == 0


def test_very_long_text(spark, make):
    text = "wörd \t" * 600_000
    for i in range(1, 40):
        if model(i, "a")[1] != "plain":
            break
    r = fill_middle.digests(spark, make([(i, text)])).first()
    want = model(i, text)
    assert (r.n, r.form, r.prefix_chars, r.middle_chars) == want[:4]
    assert r.output_sha256 == hashlib.sha256(want[4].encode()).hexdigest()
    assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
