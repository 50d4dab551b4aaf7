"""Registered queries of the training-data operators, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyfold.llm.decontaminate import contamination
from keyfold.llm.jaccard import PERCENT, SHINGLE, jaccard_components
from keyfold.llm.licenses import PHRASES, alike, license_scan, template_rules
from keyfold.llm.pieces import round_trip
from keyfold.llm.pii import pii_report
from keyfold.llm.repetition import LINE_LIMIT, MIN_WORDS, NGRAM_LIMITS, repetition_rules
from keyfold.llm.substrings import substring_dedup
from keyfold.llm.token_counts import token_counts
from keyfold.llm.toxicity import toxicity
from keyfold.llm.warc import archived


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark, d):
    return toxicity(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op2_pii(spark, d):
    return pii_report(_table(spark, d, "documents"))


def op3_repetition(spark, d):
    return repetition_rules(_table(spark, d, "documents"))


def op4_sentencepiece(spark, d):
    return round_trip(_table(spark, d, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_token_counts(spark, d):
    return token_counts(_table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_substring_dedup(spark, d):
    return substring_dedup(_table(spark, d, "documents"))


def op7_decontamination(spark, d):
    return contamination(_table(spark, d, "documents"), _table(spark, d, "benchmark"))


def op8_jaccard(spark, d):
    return jaccard_components(_table(spark, d, "documents"))


def op9_license_scan(spark, d):
    return license_scan(_table(spark, d, "documents"))


def op10_warc(spark, d):
    return archived(_table(spark, d, "pages"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_repetition": op3_repetition,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_token_counts": op5_token_counts,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_jaccard": op8_jaccard,
    "op9_license_scan": op9_license_scan,
    "op10_warc": op10_warc,
}

# -- The same in DuckDB's SQL. Toxicity, boosted trees and tokenizers can't be said in it; tests hold them against plain versions. --

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED, _ALNUM = r"'[^\x20\x09-\x0D]+'", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _words_sql(table: str, key: str, text: str, pattern: str) -> str:
    """(key, w, i): the words of each text, from 1."""
    return f"select {key}, unnest(ws) w, generate_subscripts(ws, 1) i from (select {key}, regexp_extract_all({text}, {pattern}) ws from {table})"


def _gram_sql(n: int) -> str:
    """n words from here on, null where there are fewer; o: the window over a text's words."""
    if n == 1:
        return "w"
    return f"case when lead(w, {n - 1}) over o is not null then concat_ws(' ', w, " + ", ".join(f"lead(w, {k}) over o" for k in range(1, n)) + ") end"


def _repetition_sql() -> str:
    sizes = list(NGRAM_LIMITS)
    grams = ", ".join(f"{_gram_sql(n)} g{n}" for n in (3, *sizes))
    hits = "g3 is not null and count(*) over (partition by doc_id, g3) > 1 h3, " + ", ".join(f"g{n} is not null and row_number() over (partition by doc_id, g{n} order by i) > 1 h{n}" for n in sizes)
    covers = ", ".join(f"bool_or(h{n}) over (partition by doc_id order by i rows between {n - 1} preceding and current row) c{n}" for n in (3, *sizes))
    sums = ", ".join(f"coalesce(sum(length(w)) filter (c{n}), 0)::bigint dup_chars_{n}" for n in sizes)
    kept = " and ".join([f"100 * dup_line_chars <= {LINE_LIMIT} * line_chars", *(f"100 * dup_chars_{n} <= {limit} * word_chars" for n, limit in NGRAM_LIMITS.items())])
    return rf"""with w as ({_words_sql("documents", "doc_id", "coalesce(text, '')", _SPACED)}),
 g as (select *, {grams} from w window o as (partition by doc_id order by i)),
 h as (select *, {hits} from g), c as (select *, {covers} from h),
 a as (select doc_id, count(*) n_words, sum(length(w))::bigint word_chars, count(*) filter (c3) n_repeat_words, {sums} from c group by doc_id),
 l as (select doc_id, unnest(ls) l, generate_subscripts(ls, 1) k from (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents)),
 r as (select *, row_number() over (partition by doc_id, l order by k) > 1 dup from l where regexp_matches(l, '[^\x20\x09-\x0D]')),
 b as (select doc_id, count(*) filter (dup) n_dup_lines, coalesce(sum(length(l)) filter (dup), 0)::bigint dup_line_chars, sum(length(l))::bigint line_chars from r group by doc_id),
 z as (select d.doc_id, {", ".join(f"coalesce({x}, 0)::bigint {x}" for x in ("n_words", "word_chars", "n_repeat_words", "n_dup_lines", "dup_line_chars", "line_chars", *(f"dup_chars_{n}" for n in sizes)))},
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint n_symbols from documents d left join a on a.doc_id = d.doc_id left join b on b.doc_id = d.doc_id),
 f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words base_failed from z)
 select *, not base_failed and {kept} kept from f"""


def _substrings_sql(window: int = 20) -> str:
    return f"""with w as ({_words_sql("documents", "doc_id", "coalesce(text, '')", _SPACED)}),
 g as (select *, {_gram_sql(window)} g from w window o as (partition by doc_id order by i)),
 h as (select *, g is not null and row_number() over (partition by g order by doc_id, i) > 1 later from g),
 c as (select *, bool_or(later) over (partition by doc_id order by i rows between {window - 1} preceding and current row) gone from h),
 a as (select doc_id, count(*) n_words, count(*) filter (gone) n_removed, string_agg(w, ' ' order by i) filter (not gone) kept from c group by doc_id)
 select d.doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from documents d left join a on a.doc_id = d.doc_id"""


def _contamination_sql(window: int = 13) -> str:
    met = " union all ".join(f"select doc_id, i, {n} len, item_id from g join win on win.len = {n} and win.win = g.g{n}" for n in range(1, window + 1))
    return f"""with iw as ({_words_sql("benchmark", "item_id", _LOWER, _ALNUM)}),
 ig as (select item_id, i, count(*) over (partition by item_id) n, string_agg(w, ' ') over (partition by item_id order by i rows between current row and {window - 1} following) g from iw),
 win as (select distinct item_id, least(n, {window}) len, g win from ig where i <= greatest(n - {window - 1}, 1)),
 w as ({_words_sql("documents", "doc_id", _LOWER, _ALNUM)}),
 g as (select *, {", ".join(f"{_gram_sql(n)} g{n}" for n in range(1, window + 1))} from w window o as (partition by doc_id order by i)),
 hit as ({met}),
 reach as (select doc_id, i, max(i + len - 1) e from hit group by all),
 inside as (select w.doc_id, max(e) over (partition by w.doc_id order by w.i) >= w.i is_hit from w left join reach on reach.doc_id = w.doc_id and reach.i = w.i),
 a as (select doc_id, count(*) n_words, count(*) filter (is_hit) n_hit from inside group by doc_id),
 b as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) ids from (select distinct doc_id, item_id from hit) group by doc_id),
 z as (select d.doc_id, coalesce(n_words, 0) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256 from documents d left join a on a.doc_id = d.doc_id left join b on b.doc_id = d.doc_id)
 select *, n_hit > 0 and 20 * n_hit >= n_words contaminated from z"""


def _jaccard_sql(n: int = SHINGLE, percent: int = PERCENT) -> str:
    return f"""with recursive w as ({_words_sql("documents", "doc_id", _LOWER, _SPACED)}),
 g as (select doc_id, i, count(*) over (partition by doc_id) k, string_agg(w, ' ') over (partition by doc_id order by i rows between current row and {n - 1} following) g from w),
 s as (select distinct doc_id, g from g where i <= greatest(k - {n - 1}, 1)),
 m as (select doc_id, count(*) n from s group by doc_id),
 p as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
 e as (select p.a, p.b from p join m x on x.doc_id = p.a join m y on y.doc_id = p.b where 100 * k >= {percent} * (x.n + y.n - k)),
 r as (select doc_id, doc_id c from documents union select r.doc_id, e.b from r join e on e.a = r.c),
 f as (select doc_id, min(c) component_id from r group by doc_id)
 select f.doc_id, coalesce(m.n, 0) n_shingles, component_id from f left join m on m.doc_id = f.doc_id"""


def _rows_sql(rows) -> str:
    return "values " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _licenses_sql() -> str:
    rules = template_rules()
    phrase = " union all ".join(f"select doc_id, i - 1 i, '{label}' label from g where g{len(p.split())} = '{p}'" for p, label in PHRASES.items())
    return f"""with tr(t, label, m, need, block) as ({_rows_sql((t, label, len(ws), need, block) for t, label, ws, need, block in rules)}),
 tw(t, w) as ({_rows_sql((t, w) for t, _, ws, *_ in rules for w in ws)}), rivals(t, u) as ({_rows_sql(alike(rules))}),
 w as ({_words_sql("documents", "doc_id", _LOWER, _ALNUM)}),
 g as (select *, {_gram_sql(2)} g2, {_gram_sql(3)} g3 from w window o as (partition by doc_id order by i)),
 places as ({phrase}),
 b as (select doc_id, count(*) n_base, min(i) first_word, max(i) last_word, list(distinct label) base from places group by doc_id),
 occ as (select doc_id, t, i, block, lag(i) over (partition by doc_id, t, w.w order by i) p from w join tw on tw.w = w.w join tr using (t)),
 ev as (select doc_id, t, greatest(coalesce(p + 1, i - block + 1), i - block + 1) pt, 1 d from occ union all select doc_id, t, i + 1, -1 from occ),
 st as (select doc_id, t, pt, sum(d) d from ev group by all),
 ov as (select doc_id, t, max(o) o from (select *, sum(d) over (partition by doc_id, t order by pt) o from st) group by all),
 f as (select doc_id, t, label, m, (o / m)::double c from ov join tr using (t) where o >= need),
 beaten as (select distinct a.doc_id, a.t from f a join rivals using (t) join f x on x.doc_id = a.doc_id and x.t = rivals.u where (x.c, x.m) > (a.c, a.m)),
 own as (select doc_id, list(distinct label) own, max(c) best from (select * from f anti join beaten using (doc_id, t)) group by doc_id),
 n as (select doc_id, count(*) n_words from w group by doc_id)
 select d.doc_id, coalesce(n_words, 0) n_words, coalesce(n_base, 0) n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(array_to_string(list_sort(base), ','), '') base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(base, own))), ','), '') labels,
  case when n_base > 0 then 1.0::double else coalesce(best, 0.0)::double end score
  from documents d left join n on n.doc_id = d.doc_id left join b on b.doc_id = d.doc_id left join own on own.doc_id = d.doc_id"""


_WARC_SQL = """with p as (select page_id, coalesce(html, '') t from pages),
 f as (select *, min(page_id) over (partition by t) lead, sha1(t) s from p),
 c as (select s, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(s, 5 * (k // 4) + 1, 5))::ubigint >> (15 - 5 * (k % 4))) & 31))::int, 1), '' order by k) payload_digest
  from (select distinct s from f), (select unnest(range(32)) k) group by s)
 select page_id, strlen(t)::bigint payload_bytes, payload_digest, case when page_id = lead then 'response' else 'revisit' end record_type, case when page_id <> lead then lead end refers_to, true intact
 from f join c using (s)"""

ORACLE_SQL = {
    "op3_repetition": _repetition_sql(),
    "op6_substring_dedup": _substrings_sql(),
    "op7_decontamination": _contamination_sql(),
    "op8_jaccard": _jaccard_sql(),
    "op9_license_scan": _licenses_sql(),
    "op10_warc": _WARC_SQL,
}
