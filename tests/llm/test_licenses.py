import textwrap

from keyfold.llm import licenses

ONE = {label: text for label, text in reversed(licenses.TEMPLATES)}
FULL = {label: max((t for k, t in licenses.TEMPLATES if k == label), key=len) for label, _ in licenses.TEMPLATES}


def labels(spark, texts):
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(r.labels, r.score) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_wrapped_notices(spark):
    names = ["bsd", "mit", "bsd", "mit", "apache"]
    texts = [ONE["bsd"], ONE["mit"], FULL["bsd"], FULL["mit"], FULL["apache"]]
    plain = [textwrap.fill(t, 70) for t in texts]
    marked = [textwrap.indent(textwrap.fill(t, 40), "   # ") for t in texts]
    inside = [f"{'word ' * 3000}\n{t}\n{'word ' * 3000}" for t in plain]
    torn = ["\n".join(f"{w} {'x ' * 60}" for w in t.split()) for t in texts[:2]]
    got = labels(spark, plain + marked + inside + torn)
    assert [x for x, _ in got] == names * 3 + ["", ""]
    assert all(0.85 <= score <= 1 for _, score in got[:15])


def test_templates_against_each_other(spark):
    texts = [f"Note.\n{t}." for _, t in licenses.TEMPLATES]
    got = labels(spark, texts)
    assert [x for x, _ in got] == [{"lgpl": "gpl,lgpl", "agpl": "agpl,gpl"}.get(k, k) for k, _ in licenses.TEMPLATES] and {s for _, s in got} == {1.0}
    other = ["Licensed under the Educational Community License, Version 2.0", "Licensed under CC BY-XX 4.0", "Licensed under\nCC BY-XX"]
    assert labels(spark, other) == [("", 0.0), ("cc-by", 1.0), ("", 0.0)]


def test_one_word_of_a_long_notice_may_differ(spark):
    assert [x for x, _ in labels(spark, [ONE["bsd"].replace("Redistribution", "Distribution"), ONE["mit"].replace("hereby ", "")])] == ["bsd", "mit"]


def test_rows_with_one_id_or_none(spark):
    rows = [(1, "plain words only"), (1, ONE["bsd"]), (None, "nothing"), (None, ONE["mpl"]), (None, ONE["mpl"]), (2, None)]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.labels, r.score) for r in got) == [(0, "", 0.0), (0, "mpl", 1.0), (0, "mpl", 1.0), (1, "", 0.0), (1, "bsd", 1.0), (2, "", 0.0)]
