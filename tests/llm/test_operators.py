import hashlib
import zlib

import pytest
import helpers as H

from keyfold.llm import decontaminate, jaccard, licenses, pieces, pii, queries, repetition, substrings, token_counts, toxicity

LONG = " ".join(f"w{k % 997}x{k}" for k in range(6000))
#: Two words that any polynomial modulo 2^64 over their bytes takes for one.
A, B = "a", "b"
for _ in range(10):
    A, B = A + B, B + A
RUN = [f"w{k}" for k in range(30)]
ODD = [
    (10**6, None), (10**6 + 1, ""), (10**6 + 2, " \t\n"), (10**6 + 3, "one"), (10**6 + 4, "one two"), (10**6 + 5, "one two"), (10**6 + 6, LONG), (10**6 + 7, LONG + " end"), (10**6 + 8, "é ß 漢字 \U0001f600 " * 40),
    (10**6 + 9, "MIT License, apache LICENSE; General Public License"), (10**6 + 10, A), (10**6 + 11, B), (10**6 + 12, f"{A} " + " ".join(f"v{k}" for k in range(19))), (10**6 + 13, f"{B} " + " ".join(f"v{k}" for k in range(19)) + " e"),
    (10**6 + 14, f"{A} p q {B} p q " + " ".join(RUN[:29]) + " w29w0 " + " ".join(RUN[1:])),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Whole small documents besides odd ones, with columns whose names clash with the operators' own."""
    have = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return have.unionByName(spark.createDataFrame(ODD, have.schema)).selectExpr("doc_id", "text", "doc_id n", "1 score", "'x' label", "2 p", "3 h", "'y' marks", "4 id", "5 `a.b`", "6 k", "7 row", "8 w").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select(df.columns[0], *columns).collect()}


def test_jaccard(docs, rows):
    counted = []
    assert by_id(jaccard.jaccard_components(docs, counted=counted), "n_shingles", "component_id") == H.components(rows)
    assert len(counted) == 6 and counted[0] >= counted[1] >= counted[2] and counted[3] >= counted[4] >= counted[5]


def test_jaccard_near_copies(spark, monkeypatch):
    """Near copies, shared and missing ids, hot buckets, string ids."""
    monkeypatch.setattr(jaccard, "HOT", 3)
    base = [f"t{k}" for k in range(120)]
    near = [(f"{k:03}", " ".join(w if j != 3 * k else "new" for j, w in enumerate(base))) for k in range(25)] + [(f"{90 + k:03}", " ".join(base)) for k in range(4)]
    df = spark.createDataFrame([*near, ("shared", "a b c d e"), ("shared", "f g h i j"), ("shared", "f g h i j"), (None, "f g h i j"), (None, "k l m n o"), (None, None)], "doc_id string, text string").selectExpr("doc_id", "text", "1 `a.b`", "2 n")
    want = H.components(near)
    got = jaccard.jaccard_components(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id in want} == want
    assert sorted((r.doc_id or "", r.component_id or "", r.n_shingles) for r in got if r.doc_id not in want) == [("", "", 0), ("", "", 3), ("", "shared", 3), *[("shared", "shared", 3)] * 3]
    left = jaccard.drop_linked(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or "", r.text or "") for r in left.collect()) == sorted([("", ""), ("", "k l m n o"), ("shared", "a b c d e"), *[("shared", "f g h i j")] * 2, *((c, dict(near)[c]) for c in {c for _, c in want.values()})])


def test_a_bucket_of_documents_that_do_not_link(spark):
    """Each document takes one of two variants at 40 places; all tokens are common, and hardly any two documents link."""
    rows = [(k, " ".join(f"s{j}{'xy'[zlib.crc32(b'%d-%d' % (k, j)) >> 7 & 1]} a{j} b{j} c{j}" for j in range(40))) for k in range(400)]
    counted = []
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), counted=counted)
    assert by_id(got, "n_shingles", "component_id") == H.components(rows)


@pytest.mark.parametrize("fit", [4000, 2, 1])
def test_substrings(docs, rows, fit):
    assert by_id(substrings.substring_dedup(docs, fit=fit), "n_words", "n_removed", "kept_sha256") == H.substrings(rows)


@pytest.mark.parametrize("fit", [4000, 1])
def test_substrings_inside_one_text(spark, fit):
    part = " ".join(f"a{k}" for k in range(25))
    given = [("1", f"{part} b {part}"), ("2", part), ("3", f"x {part} y"), ("4", "same " * 60)]
    df = spark.createDataFrame([*given, (None, part), ("5", f"{part} z"), ("5", f"{part} zz"), ("5", f"{part} zz")], "doc_id string, text string")
    got = substrings.substring_dedup(df, fit=fit, with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got if r.doc_id and r.doc_id < "5"} == H.substrings(given)
    assert [r.kept for r in got if r.doc_id is None] == [part]
    assert sorted(r.kept for r in got if r.doc_id == "5") == ["z", "zz", "zz"]


def test_contamination(spark, docs, rows):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()] + [(501, "One"), (502, ""), (503, None), (504, "apache license"), *((1000 + k, "TWO") for k in range(1000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench)
    want = H.contamination(rows, items)
    assert by_id(got, *got.columns[1:]) == want
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(i for i, x in want.items() if not x[-1])


def test_contamination_of_rows_with_one_id(spark):
    item = " ".join(f"i{k}" for k in range(20))
    df = spark.createDataFrame([("x", item), ("x", "clean words"), ("x", item), (None, item), (None, None), ("y", "w " * 100_000 + item)], "doc_id string, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None)], "item_id long, text string")
    got = sorted((r.doc_id or "", r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(df, bench).collect())
    assert got == [("", 0, 0, False), ("", 20, 20, True), ("x", 2, 0, False), ("x", 20, 20, True), ("x", 20, 20, True), ("y", 100_020, 20, False)]
    assert sorted((r.doc_id or "", len(r.text or "")) for r in decontaminate.drop_contaminated(df, bench).collect()) == [("", 0), ("x", 11), ("y", 200_000 + len(item))]
    assert decontaminate.contamination(df, bench.limit(0)).filter("contaminated or n_items > 0").count() == 0


def test_pii(spark, docs, rows):
    odd = [(1, "a@b.co_m@x.y.z a@b josé@mail.example.com @x.y"), (2, "1.2.3.4.5.6.7.8 0300.1.1.1 00255.1.2.3 999.1.1.1"), (3, "4111 1111-1111 1111, 4111111111111111 4111111111111111 5 \U0001f600 4111111111111111"), (4, "+1 23 +1 234 567 890 (12) ++4 912345678- +1(((9"), (5, "1 " * 20000), (6, "7" * 9000 + "@" + "a" * 9000 + ".b")]
    for df, given in ((docs, rows), (spark.createDataFrame(odd, "doc_id long, text string"), odd)):
        got = {r.doc_id: r for r in pii.pii_report(df).collect()}
        for i, text in given:
            spans = H.pii(text)
            assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
            assert got[i].base_sha256 == H.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
            assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(got[i].spans.split(",")) | {""}


def test_trees_decide_about_proposals(spark):
    """Local numbers after a cue that full numbers have are taken; the same digits after other words are not, though they pass every check."""
    rows = []
    for k in range(400):
        n = f"({200 + k % 700}) {100 + k % 900}-{1000 + k}"
        rows.append((k, f"please call +1 {n} today" if k % 4 < 2 else f"please call {n} today" if k % 4 == 2 else f"your order {n.replace('(', '').replace(')', '')} is here"))
    rows += [(1000 + k, f"order 4{k:015} done") for k in range(300)]
    scanned = pii._scanned(pii.texts(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id").cache()
    codes = set(pii.accepted_codes(scanned))
    got = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    valid, rejected = 0, 0
    for r in scanned.collect():
        base = H.pii(dict(rows)[r.doc_id])
        more = [(m.kind, m.start, m.stop) for m in r.more if m.code in codes and not any(m.kind == k and a < m.stop and m.start < b for k, a, b in base)]
        assert got[r.doc_id] == ",".join(f"{k}:{a}:{b}" for k, a, b in sorted({*base, *more}, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2])))
        ours = {(m.kind, m.start, m.stop) for m in r.more if not m.met and m.kind == "phone"}
        valid, rejected = valid + len(ours), rejected + len(ours - set(more))
    assert all("phone" in got[k] for k in range(400) if k % 4 < 3)
    assert not any("phone" in got[k] for k in range(400) if k % 4 == 3)
    assert (valid, rejected) == (200, 100)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail é me.x@y.org, now", "x"), (2, None, "y"), (3, "+1 234 567 8901", "z")], "doc_id long, text string, `a.spans` string")
    got = pii.redact(df)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} == {(1, "mail é [EMAIL], now", "x"), (2, None, "y"), (3, "[PHONE]", "z")}


def test_toxicity(spark, docs, empty):
    d = "/root/testdata/sf0.1"
    scored, labels = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")), spark.read.parquet(f"{d}/labels.parquet")
    held = scored.filter("held_out").join(labels, "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in held)
    assert hits >= 0.7 * sum(r.toxic for r in held) and hits >= 0.9 * sum(r.predicted for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored.select("doc_id", "held_out").collect())
    assert scored.filter("score < 0 or score > 1 or (score >= 0.3) <> (predicted = 1)").isEmpty()
    assert toxicity.toxicity(docs, labels.limit(0)).filter("predicted = 1").isEmpty()
    left = toxicity.drop_toxic(docs, labels.limit(0))
    assert left.columns == docs.columns and left.exceptAll(docs).isEmpty()


def test_ftrl_one_coordinate_at_a_time():
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    examples = [(np.unique(rng.integers(0, 40, 6)).astype(np.uint32), int(rng.integers(0, 2))) for _ in range(300)]
    model = toxicity.Ftrl(l1=0.5)
    z, n = {}, {}

    def weight(i):
        least = 0.0 if i == toxicity.BUCKETS else 0.5
        if abs(z.get(i, 0.0)) <= least:
            return 0.0
        return -(z[i] - math.copysign(least, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for cells, label in examples:
        model.learn(cells, label)
        at = [*cells.tolist(), toxicity.BUCKETS]
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in at:
            old = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * w[i]
            n[i] = old + g * g
    every = np.array([*range(40), toxicity.BUCKETS])
    assert np.allclose(model.weights(every), [weight(i) for i in every.tolist()])
    assert 0 < np.count_nonzero(model.weights(every)) < len(every)


def test_repetition(docs, rows):
    got = by_id(repetition.repetition_rules(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "dup_line_chars", "line_chars", "dup_chars_5", "dup_chars_7", "dup_chars_10", "kept")
    assert {i: x[:6] for i, x in got.items()} == {i: H.repetition(t) for i, t in rows}
    for i, t in rows:
        dup, chars, inside = H.repeated_chars(t, (5, 7, 10))
        assert got[i][6:11] == (dup, chars, *inside)
        assert got[i][11] == (not got[i][5] and 100 * dup <= 30 * chars and all(100 * x <= limit * got[i][1] for x, limit in zip(inside, (30, 26, 20), strict=True)))


def test_pieces(docs, rows, empty):
    path = queries.vocabulary("piece_bpe_32k.model")
    assert pieces.parity(docs, path).filter("not same").isEmpty()
    got = pieces.round_trip(docs, path)
    assert got.filter("not same").isEmpty() and got.count() == len(rows)
    assert {r.doc_id: r.decoded_sha256 for r in got.collect()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows}
    back = by_id(pieces.decode(pieces.encode(docs, path), path), "text")
    assert back == {i: (t or "",) for i, t in rows}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(docs, rows, name, spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary(name)
    t = Tokenizer.from_file(path)
    odd = [(-1, "漢字，" * 5000), (-2, "line\n" * 3000), (-3, "a_,b" * 2000 + "<|endoftext|> x <|endoftext|>"), (-4, "don't,won't'll" * 300), (-5, "é́,x" * 900)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    want = {i: (len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 512) for i, x in rows + odd}
    assert by_id(token_counts.token_counts(df, path), "n_bytes", "n_tokens", "over_limit") == want


def test_texts_are_not_cut_where_that_changes_counts(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    t.add_tokens([AddedToken("[gap]", lstrip=True, rstrip=True)])
    t.save(str(tmp_path / "t.json"))
    counter, text = token_counts.Counter(str(tmp_path / "t.json")), "one [gap] two , three"
    assert counter.cut(text) == [text] and counter([text]) == [len(t.encode(text, add_special_tokens=False))]


def test_licenses(docs, rows):
    got = by_id(licenses.license_scan(docs), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert {i: x[:5] for i, x in got.items()} == {i: H.licenses(t) for i, t in rows}
    rules = licenses.template_rules()
    for i, t in rows:
        found, best = H.template_labels(t, rules, licenses.alike(rules))
        base = {x for x in got[i][4].split(",") if x}
        assert got[i][5:] == (",".join(sorted(base | found)), 1.0 if got[i][1] else best)


def test_empty_tables(spark, empty):
    """Nothing in, nothing out, for tables with clashing names."""
    bench, labels = spark.createDataFrame([(1, "one")], "item_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    path = queries.vocabulary("piece_bpe_32k.model")
    for out in (
        toxicity.toxicity(empty, labels), pii.pii_report(empty), pii.redact(empty), repetition.repetition_rules(empty), pieces.round_trip(empty, path), token_counts.token_counts(empty, queries.vocabulary("byte_bpe_50k.json")),
        substrings.substring_dedup(empty), decontaminate.contamination(empty, bench), jaccard.jaccard_components(empty), licenses.license_scan(empty),
    ):
        assert out.count() == 0


def test_ids_of_other_types_and_repeated_rows(spark):
    given = [("x", "one two three"), ("x", "four"), ("x", "four"), (None, "five"), (None, None), ("y", "")]
    df = spark.createDataFrame(given, "doc_id string, text string")
    path = queries.vocabulary("piece_bpe_32k.model")
    want = sorted((i or "", len(H.words(t))) for i, t in given)
    for out, column in ((repetition.repetition_rules(df), "n_words"), (licenses.license_scan(df), "n_words"), (substrings.substring_dedup(df), "n_words")):
        assert sorted((r.doc_id or "", r[column]) for r in out.collect()) == want
    ids = sorted(i or "" for i, _ in given)
    labels = spark.createDataFrame([("x", 1)], "doc_id string, toxic int")
    for out in (toxicity.toxicity(df, labels), pii.pii_report(df), pieces.round_trip(df, path), pieces.decode(pieces.encode(df, path), path), token_counts.token_counts(df, queries.vocabulary("byte_bpe_50k.json"))):
        assert sorted(r.doc_id or "" for r in out.collect()) == ids
    whole = repetition.repetition_rules(df.selectExpr("cast(length(text) as int) doc_id", "text"))
    assert whole.schema["doc_id"].dataType.simpleString() == "int" and whole.count() == len(given)
