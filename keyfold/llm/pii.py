"""Personal data: base rules, loose generators and boosted trees; DataFrame, SQL and Spark ML only.

Base spans are found by four patterns and kept if they pass their check (octets, Luhn, number of
digits). Looser generators propose more spans, which may overlap. Each proposal is described by its
format (kind, digits, separators) and its context (the characters beside it, a cue word before it, the
start of a line); every description takes one of a fixed number of values. What makes a base span one, the check and the
leading plus sign, is held back from the descriptions, so trees can't learn it by heart.

Gradient-boosted trees learn from the counts of descriptions over the whole corpus which proposals are
confirmed, that is meet a base span of their kind. The rest are unlabelled, not wrong: confirmation is
seen for only a share of the true spans. The trees learn on the even half of the documents. On the odd
half an isotonic regression makes their scores the probability of being confirmed, and the mean of that
over confirmed proposals, by kind, is the share of true spans that are confirmed at all; the quotient of
the two is the probability of being personal data. Proposals that no base span of their kind meets
are added from ``threshold`` on. Base spans always stay.

Texts are scanned once: base spans and proposals are written to the shared folder, learnt from and
selected from there. Positions count code points, ends are exclusive. Null texts are empty. Where nothing
is confirmed, or everything, nothing is learnt and base spans are all. Rows are judged one by one, so
ids may be null, shared or of any type, repeated rows get equal results, and other columns may have any
name. Equal scores are accepted or rejected together. An empty table gives an empty result. Every
pattern starts only where a run starts, so long runs are read once and long texts are whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.frames import quoted, texts, written

KINDS = ("email", "ip", "card", "phone")
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns; possessive where nothing can be given back.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Patterns of high recall, by kind.
LOOSE = {
    "email": r"(?<![^\s<>()\[\],;:\x22'])[^\s@<>()\[\],;:\x22']{1,64}@[^\s@<>()\[\],;:\x22']++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9])(?:00[0-9]{2}[ -]?[0-9]{6,12}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
}
#: What a text must hold to be searched by a pattern.
_BASE_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
_LOOSE_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{4}[ -]?[0-9]{4}", "phone": r"[0-9]{3}[ .)-]|00[0-9]{2}"}
#: Words that tell what a number after them is.
CUES = (
    "tel|telephone|phone|call|fax|mobile|cell|whatsapp|sms",
    "card|visa|mastercard|amex|credit|debit|payment",
    "ip|addr|address|host|server|ping|client",
    "mail|email|e-mail|contact|write",
    "order|invoice|id|ref|reference|isbn|issn|no|number|version|serial|sku|ticket|case|build|part",
)
BEFORE = 24
#: Matches of a text that are added up together, so that work does not grow with their square.
STEP = 128
THRESHOLD = 0.5
TREES, DEPTH = 10, 4
#: What describes a proposal, and how many values each has.
FEATURES = {"kind": 4, "digits": 21, "gaps": 5, "before": 6, "after": 6, "cue": len(CUES) + 1, "line": 2}

_SPAN = "struct<start:int,stop:int,value:string,before:string,after:string>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _valid(kind: str, value: Column) -> Column:
    """The check of a base span."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _found(text: Column, pattern: str, hint: str) -> Column:
    """All matches, leftmost and not overlapping, as an array of spans: what lies between them gives the places."""

    def place(got: Column, gaps: Column) -> Column:
        within = lambda head: F.sequence(head, F.least(head + STEP - 1, F.size(got) - 1))
        whole = lambda head: F.aggregate(within(head), F.lit(0), lambda n, k: n + F.length(F.get(gaps, k)) + F.length(F.get(got, k)))
        ahead = lambda acc, head: F.struct((acc["n"] + whole(head)).alias("n"), F.concat(acc["at"], F.array(acc["n"])).alias("at"))

        def step(acc: Column, k: Column) -> Column:
            start = (acc["stop"] + F.length(F.get(gaps, k))).cast("int")
            value = F.get(got, k)
            stop = (start + F.length(value)).cast("int")
            span = F.struct(start.alias("start"), stop.alias("stop"), value.alias("value"), F.right(F.get(gaps, k), F.lit(BEFORE)).alias("before"), F.left(F.get(gaps, k + 1), F.lit(1)).alias("after"))
            return F.struct(stop.alias("stop"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        def block(head: Column, at: Column) -> Column:
            zero = F.struct(at.alias("stop"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
            return F.aggregate(within(head), zero, step, lambda acc: acc["spans"])

        heads = F.sequence(F.lit(0), F.size(got) - 1, F.lit(STEP))
        starts = F.aggregate(heads, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")), ahead, lambda acc: acc["at"])
        return _bound(starts, lambda at: F.flatten(F.transform(heads, lambda head, j: block(head, F.get(at, j)))))

    none = F.array().cast(f"array<{_SPAN}>")
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = _bound(got, lambda g: F.when(F.size(g) > 0, _bound(F.split(text, pattern, -1), lambda s: place(g, s))).otherwise(none))
    return F.when(text.rlike(hint), spans).otherwise(none)


def _side(char: Column) -> Column:
    """Class of the character beside a span: end of line or text, white space or plus sign, letter, digit, quote or bracket, other."""
    return (
        F.when(char.isin("", "\n"), 0).when(char.rlike(r"[\s+]"), 1).when(char.rlike(r"\p{L}"), 2).when(char.rlike("[0-9]"), 3)
        .when(char.rlike(r"[\x22'()\[\]{}<>]"), 4).otherwise(5)
    )


def _code(kind: str, span: Column) -> Column:
    """The description of a proposal as one number; FEATURES has the meaning of its places."""
    value, before = span["value"], span["before"]
    inner = F.regexp_replace(value, r"[0-9+@\p{L}]", "")
    gaps = F.when(inner == "", 0).when(inner.rlike("^ +$"), 1).when(inner.rlike("^-+$"), 2).when(inner.rlike(r"^\.+$"), 3).otherwise(4)
    cue = F.lit(0)
    for k, words in reversed(list(enumerate(CUES, 1))):
        cue = F.when(before.rlike(rf"(?i)\b(?:{words})\b"), k).otherwise(cue)
    digits = F.least(F.length(F.regexp_replace(value, "[^0-9]", "")), F.lit(FEATURES["digits"] - 1))
    line = F.rtrim(F.substring_index(before, "\n", -1)) == ""
    number = F.lit(0)
    for part, size in zip((F.lit(KINDS.index(kind)), digits, gaps, _side(F.right(before, F.lit(1))), _side(span["after"]), cue, line.cast("int")), FEATURES.values(), strict=True):
        number = number * size + part
    return number.cast("int")


def _meets(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["stop"]) & (span["start"] < o["stop"]))


def _scanned(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, half, base spans by kind (b_<kind>) and proposals: (kind, start, stop, code, met), met by a base span or not."""
    text = F.col("text")

    def checked(kind: str) -> Column:
        return F.filter(_found(text, BASE[kind], _BASE_HINT[kind]), lambda s: _valid(kind, s["value"]))

    def proposed(kind: str) -> Column:
        row = lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), _code(kind, s).alias("code"), _meets(s, F.col(f"b_{kind}")).alias("met"))
        return F.transform(_found(text, LOOSE[kind], _LOOSE_HINT[kind]), row)

    slim = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    base = docs.select(*keys, "text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half"), *(slim(checked(k)).alias(f"b_{k}") for k in KINDS))
    kept = [k for k in keys if k != "text"]
    return base.select(*kept, *(["text"] if "text" in keys else []), "half", *(f"b_{k}" for k in KINDS), F.concat(*map(proposed, KINDS)).alias("more"))


def accepted_codes(scanned: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH) -> list[int]:
    """Descriptions of proposals to be added."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    p = scanned.select("half", F.explode("more").alias("m")).select("half", "m.code", "m.met")
    number = lambda half, met: F.count(F.when((F.col("half") == half) & (F.col("met") == met), 1))
    counts = written(p.groupBy("code").agg(number(0, False).alias("n0"), number(0, True).alias("n1"), number(1, False).alias("t0"), number(1, True).alias("t1")))
    total = counts.agg(*(F.sum(F.col(c)).alias(c) for c in ("n0", "n1", "t0", "t1"))).first()
    if not (total.n0 and total.n1 and total.t0 and total.t1):
        return []
    table, rest = counts.coalesce(1), F.col("code")  # at most one row a description
    for name, size in reversed(FEATURES.items()):
        table, rest = table.withColumn(name, (rest % size).cast("int")), F.floor(rest / size)
    inputs = ["digits", "line"]
    for name in ("kind", "gaps", "before", "after", "cue"):
        for k in range(FEATURES[name]):
            table = table.withColumn(f"{name}_{k}", (F.col(name) == k).cast("double"))
            inputs.append(f"{name}_{k}")
    table = VectorAssembler(inputCols=inputs, outputCol="features").transform(table).select("code", "kind", "features", "n0", "n1", "t0", "t1")

    def weighted(frame: DataFrame, no: str, yes: str, column: str) -> DataFrame:
        rows = F.explode(F.array(*(F.struct(F.lit(label).alias("label"), F.col(c).cast("double").alias("weight")) for label, c in ((0.0, no), (1.0, yes)))))
        return frame.select(column, rows.alias("r")).select(column, "r.*").filter("weight > 0")

    model = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=32, seed=7).fit(weighted(table, "n0", "n1", "features"))
    scored = written(model.transform(table).select("code", "kind", "t0", "t1", F.get(vector_to_array("probability"), F.lit(1)).alias("score")))
    calibrated = IsotonicRegression(labelCol="label", featuresCol="score", weightCol="weight", predictionCol="confirmed").fit(weighted(scored, "t0", "t1", "score")).transform(scored)
    share = calibrated.groupBy("kind").agg((F.sum(F.col("confirmed") * F.col("t1")) / F.sum("t1")).alias("share"))
    rows = calibrated.join(share, "kind").filter((F.col("share") > 0) & (F.col("confirmed") >= threshold * F.col("share"))).select("code").collect()  # at most one a description
    return sorted(r.code for r in rows)


def _selected(scanned: DataFrame, threshold: float) -> DataFrame:
    """scanned with base and spans: arrays of (kind, start, stop), by kind and start."""
    codes = accepted_codes(scanned, threshold)
    plain = lambda k: F.transform(f"b_{k}", lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))

    def added(kind: str) -> Column:
        mine = F.filter("more", lambda m: (m["kind"] == kind) & ~m["met"] & m["code"].isin(codes or [-1]))
        return F.transform(mine, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["stop"].alias("stop")))

    return scanned.withColumns({"base": F.concat(*map(plain, KINDS)), "spans": F.concat(*(F.array_sort(F.array_distinct(F.concat(plain(k), added(k)))) for k in KINDS))})


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def pii_report(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row a document; counts are of base spans."""
    found = _selected(written(_scanned(texts(docs, id_col, text_col), "doc_id")), threshold)
    return found.select("doc_id", *(F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first names the gap."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(by_place, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with redacted texts; null texts stay null, other columns as they are."""
    rest = [c for c in docs.columns if c != text_col]
    held = docs.select(F.coalesce(quoted(text_col), F.lit("")).alias("text"), quoted(text_col).isNull().alias("none"), F.struct(*(quoted(c).alias(f"c{k}") for k, c in enumerate(rest)), F.lit(0).alias("z")).alias("rest"))
    found = _selected(written(_scanned(held, "text", "none", "rest")), threshold)
    new = F.when(F.col("none"), F.lit(None).cast("string")).otherwise(redacted(F.col("text"), F.col("spans")))
    return found.select(*(new.alias(c) if c == text_col else F.col("rest")[f"c{rest.index(c)}"].alias(c) for c in docs.columns))
