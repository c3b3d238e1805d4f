"""Registered queries of the operators, each over its whole table, and SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strayline.llm.chat_format import format_conversations, read_back
from strayline.llm.common import table
from strayline.llm.decontaminate import overlaps
from strayline.llm.fill_middle import fill_in_middle, store_frames, with_digests
from strayline.llm.html_main import extract
from strayline.llm.line_dedup import LINE_WIDTH, line_classes
from strayline.llm.line_rules import BOILERPLATE, clean_lines
from strayline.llm.masked_lm import score
from strayline.llm.mixing import mix
from strayline.llm.quality_gam import score_quality
from strayline.llm.resample import importance
from strayline.llm.simhash import near_duplicates
from strayline.llm.spans import remove_repeats
from strayline.llm.toxicity import score_toxicity


def q_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose repeated runs, what is left of them, and who has the runs first."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.where("removed > 0").select("doc_id", "kept_doc_ids", "removed", "text")


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def q_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def q_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def q_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that is not blank and the line that its class keeps."""
    return line_classes(table(spark, sf_dir, "documents"), width=LINE_WIDTH).select(
        "doc_id", "line_no", "kept_doc_id", "kept_line_no"
    )


def q_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def q_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def q_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def q_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(fill_in_middle(store_frames(table(spark, sf_dir, "documents"))))


SAID = "</s>[INST] ok [/INST]"


def q_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations and one of control strings alone, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], turns.schema)
    return read_back(format_conversations(turns.union(own)))


QUERIES = {
    "op1_spans": q_spans,
    "op2_toxicity": q_toxicity,
    "op3_masked_lm": q_masked_lm,
    "op4_mixing": q_mixing,
    "op5_html": q_html,
    "op6_quality_gam": q_quality,
    "op7_line_dedup": q_line_dedup,
    "op8_decontamination": q_decontamination,
    "op9_simhash": q_simhash,
    "op10_line_rules": q_line_rules,
    "op11_resample": q_resample,
    "op12_fill_middle": q_fill_middle,
    "op13_chat_format": q_chat_format,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _first_digits(text: str, group: int = 0) -> str:
    return f"('0x' || substr(sha256({text}), {8 * group + 1}, 8))::bigint"


_RESAMPLE = rf"""with recursive bits as (select i, i::bigint as c, 0 as k from range(256) r(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crc as (select list(c order by i) as t from bits where k = 8),
texts as (select row_number() over () as nr, doc_id, text, true as own from documents
  union all select -row_number() over (), item_id, text, false from benchmark),
words as (select nr, own, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from texts),
seen as (select w, count(*) filter (own) as s, count(*) filter (not own) as t from words group by w),
hexed as (select w, s, t, hex(encode(w)) as h from seen),
hashed as (select w, s, hexed.t, xor(list_reduce(list_prepend(4294967295::bigint,
  list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
  lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket from hexed, crc),
counts as (select bucket, sum(s)::double as s, sum(t)::double as t from hashed group by bucket),
gains as (select bucket, floor(1000 * ln((t + 1) * ((select sum(s) from counts) + 10000)
  / ((s + 1) * ((select sum(t) from counts) + 10000))))::bigint as gain from counts),
weights as (select nr, count(*) as n, sum(gain)::bigint as weight
  from words join hashed using (w) join gains using (bucket) where own group by nr),
scored as (select nr, doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln(({_first_digits("'2024:' || doc_id")} + 0.5::double) / 4294967296)))::bigint as score
  from (select * from texts where own) left join weights using (nr)),
ranked as (select nr, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= 20)
select doc_id, n_features, weight, score,
  case when rank <= (select count(*) * 10 // 100 from ranked) then rank end as rank
from scored left join ranked using (nr)"""

_H = [_first_digits("'1:' || doc_id", i) for i in range(4)]
_FILL_MIDDLE = rf"""with units as (select doc_id, coalesce(text, '') as text,
  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u from documents),
cuts as (select *, len(u) as n, least({_H[0]} % (len(u) + 1), {_H[1]} % (len(u) + 1)) as a,
  greatest({_H[0]} % (len(u) + 1), {_H[1]} % (len(u) + 1)) as b,
  case when text = '' or text like '%<P>%' or text like '%<S>%' or text like '%<M>%' or {_H[2]} % 100 >= 90
    then 'plain' when {_H[3]} % 100 < 20 then 'spm' else 'psm' end as form from units),
parts as (select doc_id, text, n, form, array_to_string(u[1:a], '') as p,
  array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from cuts)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars,
  case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256 from parts"""


def _escaped(text: str) -> str:
    pairs = [("\\", "\\\\"), *[(c, f"{c[0]}\\{c[1:]}") for c in ("<s>", "</s>", "[INST]", "[/INST]")]]
    for plain, escaped in pairs:
        text = f"replace({text}, '{plain}', '{escaped}')"
    return text


_CHAT = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, unnest([0, 1]), unnest(['user', 'assistant']), '{SAID}')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length({_escaped("role")}) + length({_escaped("text")}) + length('<s>[INST][/INST]</s>'))::bigint as formatted_chars
from t group by conv_id"""

_WORD = r"[^\x20\x09-\x0D]+"
_PHRASES = " or ".join(f"contains(lower(line), '{phrase}')" for phrase in BOILERPLATE)
_LINE_RULES = rf"""with docs as (select row_number() over () as nr, doc_id, coalesce(text, '') as text from documents),
split as (select nr, regexp_extract_all(text, '{_WORD}') as ws, string_split(text, chr(10)) as ls from docs),
words as (select nr, unnest(ws) as w, generate_subscripts(ws, 1) as i from split),
windows as (select nr, i, w as a, lead(w, 1) over o as b, lead(w, 2) over o as c from words window o as (partition by nr order by i)),
again as (select nr, i, count(*) over (partition by nr, a, b, c) as n from windows where c is not null),
covered as (select distinct nr, unnest([i, i + 1, i + 2]) as i from again where n > 1),
repeats as (select nr, count(*) as n_repeat_words from covered group by nr),
counts as (select nr, count(*) as n_words, sum(length(w))::bigint as word_chars from words group by nr),
lines as (select nr, line, len(regexp_extract_all(line, '{_WORD}')) as n from (select nr, unnest(ls) as line from split)),
ruled as (select nr, line, n, len(regexp_extract_all(line, '[#*$%&|<>]')) * 5 >= n
  or (upper(line) = line and lower(line) <> line and n > 1)
  or (len(regexp_extract_all(line, '[|»›·•]|\s(?:>|/|::)\s')) >= 2 and len(regexp_extract_all(line, '[|»›·•]|\s(?:>|/|::)\s')) * 5 > n)
  or {_PHRASES}
  or (n < 5 and not regexp_matches(line, '[.!?…:;,。！？]["''”’»)\]]*[\x20\x09-\x0D]*$')) as failed
  from lines where n > 0),
judged as (select nr, count(*) - count(distinct line) as n_dup_lines,
  coalesce(sum(n) filter (not failed), 0) as n_left from ruled group by nr),
base as (select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_left, 0) as n_left
  from docs left join counts using (nr) left join judged using (nr) left join repeats using (nr)),
failing as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 100 * n_left >= 50 * n_words as kept from failing"""

ORACLE: dict[str, str] = {
    "op10_line_rules": _LINE_RULES,
    "op11_resample": _RESAMPLE,
    "op12_fill_middle": _FILL_MIDDLE,
    "op13_chat_format": _CHAT,
}
