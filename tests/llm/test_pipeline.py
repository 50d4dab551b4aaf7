import helpers as H
import pytest

import corpus_pipeline
from keyfold.llm import toxicity

D = "/root/testdata/sf0.001"


def ids(df):
    return {r.doc_id for r in df.collect()}


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def near(rows):
    return {c for _, c in H.components(rows, 80, 5).values()}


def through(spark, docs, d):
    """(name, what goes in, what comes out) of every stage."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, d).cache()
        out.append((name, docs, after))
        docs = after
    return out


def held(spark, stages, d):
    """Every stage against a plain version on its own input."""
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
    _, before, after = stages[0]
    assert ids(after) == ids(toxicity.toxicity(before, spark.read.parquet(f"{d}/labels.parquet")).filter("predicted = 0"))
    _, before, after = stages[1]
    assert ids(after) == near(texts(before))
    _, before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert ids(after) == {i for i, x in H.contamination(texts(before), items).items() if not x[-1]}
    _, before, after = stages[3]
    now = dict(texts(after))
    for i, text in texts(before):
        assert text is None and now[i] is None or not any(text[a:b] in now[i] and b - a > 8 for _, a, b in H.pii(text)) and (H.pii(text) or now[i] == text)
    _, before, after = stages[4]
    assert after.filter("not same").isEmpty() and after.count() == before.count()


@pytest.fixture(scope="module")
def stages(spark):
    return through(spark, spark.read.parquet(f"{D}/documents.parquet"), D)


def test_stages_on_their_own_input(spark, stages):
    assert [n for n, _, _ in stages] == ["toxicity", "jaccard_join", "decontamination", "pii", "sentencepiece"]
    held(spark, stages, D)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, D).exceptAll(stages[-1][2].select("doc_id", "n_tokens", "ids", "decoded_sha256", "same")).isEmpty()


def tables(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_odd_documents(spark, tmp_path):
    """Null and empty texts, ties, repeated rows, a long text, clashing and dotted names."""
    have = spark.read.parquet(f"{D}/documents.parquet")
    item = spark.read.parquet(f"{D}/benchmark.parquet").first().text
    copy = have.filter("length(text) > 400").orderBy("doc_id").first()
    rows = [(900, None), (901, ""), (902, " \n"), (903, copy.text), (904, item), (905, "x " * 60_000 + "write a.b@c.de"), (906, "one two"), (907, "one two"), (copy.doc_id, copy.text)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    docs = have.limit(60).unionByName(have.filter(have.doc_id == copy.doc_id)).unionByName(odd).selectExpr("*", "1 h", "2 k", "3 score", "4 `a.b`", "'y' row")
    got = through(spark, spark.read.parquet(tables(spark, tmp_path, docs) + "/documents.parquet"), str(tmp_path))
    held(spark, got, str(tmp_path))
    left = [r.doc_id for r in got[1][2].collect()]
    assert {900, 901, 902, 905, 906} <= set(left) and not {903, 907} & set(left) and left.count(copy.doc_id) >= 2
    assert 904 not in ids(got[2][2])


def test_no_documents(spark, tmp_path):
    d = tables(spark, tmp_path, spark.read.parquet(f"{D}/documents.parquet").limit(0))
    assert corpus_pipeline.run(spark, d).count() == 0


@pytest.mark.parametrize("n_words,changed", [(50, 1), (225, 4)])
def test_changed_words_link(spark, n_words, changed):
    base = [f"w{k}" for k in range(n_words)]
    other = [f"new{k}" if (k + 10) % (n_words // changed) == 0 else w for k, w in enumerate(base)]
    far = [f"new{k}" if k % 12 == 0 else w for k, w in enumerate(base)]
    rows = [(k, " ".join(w)) for k, w in enumerate((base, other, far))]
    assert sum(a != b for a, b in zip(base, other, strict=True)) == changed
    kept = corpus_pipeline.jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), D)
    assert ids(kept) == near(rows) == {0, 2}
