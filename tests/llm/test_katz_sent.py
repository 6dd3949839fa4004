"""What op5's workers send: bounded batches, and events as one row for each pair of ranges."""

import pytest

from feedlens.llm import katz

SMALL = "/root/testdata/sf0.001/documents.parquet"


@pytest.mark.parametrize("sent", [2_000, 4_000_000])
def test_events_are_a_row_for_each_pair_of_ranges_whatever_the_blocks(spark, monkeypatch, sent):
    found, write = [], katz._Tables.write

    def counting(self, df, name, by, buckets):
        out = write(self, df, name, by, buckets)
        if name == "scores":
            found.append(out.where("kind = 'u'").count())
        return out

    monkeypatch.setattr(katz._Tables, "write", counting)
    monkeypatch.setattr(katz, "SENT_BYTES", sent)
    scores = []
    before = spark.conf.get(katz._BATCH_BYTES, None)
    for block in (2_000, 4_500_000):
        monkeypatch.setattr(katz, "BLOCK", block)
        rows = katz.score(spark, spark.read.parquet(SMALL)).collect()
        scores.append({r.doc_id: (r.n_tokens, r.n_known, pytest.approx(r.base_score, rel=1e-9), pytest.approx(r.score, rel=1e-9)) for r in rows})
    assert scores[0] == {k: tuple(getattr(v, "expected", v) for v in x) for k, x in scores[1].items()}
    assert found[0] == found[1] > 0
    assert spark.conf.get(katz._BATCH_BYTES, None) == before
