"""Stages of the pipeline decide by row: repeated and null doc_ids with texts of their own."""

from feedlens.llm import exact_dedup, jaccard_join, windows


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def text(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


def test_exact_stage_drops_rows_not_ids(spark, make):
    df = make([(None, "A"), (None, "unique"), (1, "a"), (5, "one"), (5, "b"), (7, "B"), (8, "c"), (8, "C"), (None, "d"), (None, "d")])
    out = exact_dedup.keep_last(spark, df)
    got = kept(out)
    assert out.columns == df.columns and len(got) == 6
    assert {(i, t.lower()) for i, t in got} == {(None, "unique"), (1, "a"), (5, "one"), (7, "b"), (8, "c"), (None, "d")}


def test_near_stage_drops_rows_not_ids(spark, make):
    a, b, c = text("a", 80), text("b", 80), text("c", 80)
    df = make([(3, a), (5, a + " tail"), (5, "unique"), (6, b), (6, b + " tail"), (None, b), (None, c), (None, c + " tail"), (None, "no id")])
    got = kept(jaccard_join.keep_first(spark, df))
    assert len(got) == 5 and {(i, t[:2]) for i, t in got} == {(3, "a0"), (5, "un"), (6, "b0"), (None, "c0"), (None, "no")}


def test_passages_are_cut_from_their_own_rows(spark, make):
    shared = text("s", 60)
    rows = [(1, shared), (2, text("x", 70) + " " + shared), (2, text("y", 10)), (2, text("z", 90)), (None, text("n", 9) + " " + shared)]
    got = kept(windows.without_repeats(spark, make(rows)))
    want = [(1, shared), (2, text("x", 70) + " "), (2, text("y", 10)), (2, text("z", 90)), (None, text("n", 9) + " ")]
    assert got == sorted(want, key=str)
