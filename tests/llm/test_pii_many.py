import helpers as H

from keyfold.llm import pii


def test_very_many_matches_in_one_text(spark):
    text = " ".join(f"{100 + k % 800}-{200 + k % 700}-{1000 + k % 8999} a{k}@b.co é 1.2.3.{k % 300}" for k in range(1000))
    got = pii.pii_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = H.pii(text)
    assert [got[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
    assert got.base_sha256 == H.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
