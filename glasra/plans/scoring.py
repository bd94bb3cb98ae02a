"""Queries on metrics, diagnostics, answer review and alignment, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glasra.functions import metrics as M
from glasra.functions import text as T
from glasra.operators import gates as G
from glasra.operators import review as R
from glasra.operators import sequences as Q
from glasra.operators import vectors as V
from glasra.plans.corpus import SOURCE_SQL, query
from glasra.plans.manifest import sequences
from glasra.tables import lang_code, read, source_name, spread

_SP = r"[\s\v\x{1C}-\x{1F}\x{85}\p{Z}]+"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SP}|{_SP}$', '', 'g')"


def _norm(x: str) -> str:
    return _trim(rf"regexp_replace(regexp_replace(nfc_normalize(lower({x})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '{_SP}', ' ', 'g')")


@query(f"SELECT row_id, {_norm('ref')} AS ref_norm, length({_norm('ref')}) AS n_chars FROM asr_pairs")
def normalised_refs(spark, d):
    return read(spark, d, "asr_pairs").select("row_id", T.normalised(F.col("ref")).alias("ref_norm"), F.length(T.normalised(F.col("ref"))).cast("long").alias("n_chars"))


def _words_sql(x: str) -> str:
    return f"list_filter(string_split(coalesce({_norm(x)}, ''), ' '), lambda w: w <> '')"


def _errors_sql(table: str, group: str, ref: str, hyp: str, bounded: bool = False, chars: bool = False) -> str:
    """Edits by DuckDB's distance, which counts bytes, of strings with one byte for each different item of a pair."""
    items = (lambda x: f"string_split(coalesce({_norm(x)}, ''), '')") if chars else _words_sql
    code = "array_to_string(list_transform({0}, lambda w: chr(list_position(among, w)::INT)), '')"
    h = "h[:len(r)]" if bounded else "h"
    return f"""
a AS (SELECT {group}, list_filter({items(ref)}, lambda w: w <> '') AS r, list_filter({items(hyp)}, lambda w: w <> '') AS h FROM {table}),
b AS (SELECT {group}, r, {h} AS h FROM a), c AS (SELECT {group}, r, h, list_distinct(list_concat(r, h)) AS among FROM b),
e AS (SELECT {group}, len(r) AS n_ref, CASE WHEN len(r) = 0 THEN 0 ELSE levenshtein({code.format("r")}, {code.format("h")}) END AS edits FROM c)"""


_RATE = "round(sum(edits) * 100.0 / greatest(1, sum(n_ref)), 6)"


def _rates(e, group, name):
    return e.groupBy(group).agg(F.sum("edits").alias("edits"), F.sum("n_ref").alias("n_ref"), F.round(M.micro_rate(F.col("edits"), F.col("n_ref")), 6).alias(name))


@query(f"WITH {_errors_sql('asr_pairs', 'decoder', 'ref', 'hyp')} SELECT decoder, count(*) AS n, sum(edits)::BIGINT AS edits, sum(n_ref)::BIGINT AS n_ref, {_RATE} AS wer FROM e GROUP BY decoder")
def wer_by_decoder(spark, d):
    """Plain word error rate, micro-averaged."""
    e = M.word_errors(spread(read(spark, d, "asr_pairs").select("decoder", "ref", "hyp")))
    return e.groupBy("decoder").agg(F.count("*").alias("n"), F.sum("edits").alias("edits"), F.sum("n_ref").alias("n_ref"), F.round(M.micro_rate(F.col("edits"), F.col("n_ref")), 6).alias("wer"))


@query(f"WITH {_errors_sql('asr_pairs', 'decoder', 'ref', 'hyp', True)} SELECT decoder, sum(edits)::BIGINT AS edits, sum(n_ref)::BIGINT AS n_ref, {_RATE} AS wer FROM e GROUP BY decoder")
def wer_bounded(spark, d):
    """Word error rate with the hypothesis cut to the reference's length: at most 100."""
    return _rates(M.word_errors(spread(read(spark, d, "asr_pairs").select("decoder", "ref", "hyp")), bounded=True), "decoder", "wer")


@query(f"WITH {_errors_sql('asr_pairs', 'decoder', 'ref', 'hyp', chars=True)} SELECT decoder, sum(edits)::BIGINT AS edits, sum(n_ref)::BIGINT AS n_ref, {_RATE} AS cer FROM e GROUP BY decoder")
def cer_by_decoder(spark, d):
    """Character error rate by the built-in distance, in code points."""
    return _rates(M.char_errors(spread(read(spark, d, "asr_pairs").select("decoder", "ref", "hyp"))), "decoder", "cer")


@query(f"WITH {_errors_sql('asr_pairs', 'decoder', 'ref', 'hyp', True, True)} SELECT decoder, sum(edits)::BIGINT AS edits, sum(n_ref)::BIGINT AS n_ref, {_RATE} AS cer FROM e GROUP BY decoder")
def cer_bounded(spark, d):
    """Character error rate with the hypothesis cut to the reference's length: at most 100."""
    return _rates(M.char_errors(spread(read(spark, d, "asr_pairs").select("decoder", "ref", "hyp")), bounded=True), "decoder", "cer")


_QUOTE = _trim(r"""regexp_extract(t, '(?s)["“”](.+?)["“”]', 1)""")
_REST = "t"
for _p in (*T.LEADS, *T.TRAILERS):
    _REST = f"regexp_replace({_REST}, '(?i){_p}', '')"
_UNWRAPPED = f"(SELECT model, reference, CASE WHEN {_QUOTE} <> '' THEN {_QUOTE} ELSE {_trim(_REST)} END AS hyp FROM (SELECT model, reference, {_trim('coalesce(hypothesis, chr(32))')} AS t FROM decodes))"


@query(f"WITH {_errors_sql(_UNWRAPPED, 'model', 'reference', 'hyp')} SELECT model, sum(edits)::BIGINT AS edits, sum(n_ref)::BIGINT AS n_ref, {_RATE} AS wer FROM e GROUP BY model")
def wer_stripped(spark, d):
    """Word error rate after chat phrases are taken off the hypotheses."""
    p = spread(read(spark, d, "decodes").select("model", "reference", "hypothesis")).select("model", F.col("reference").alias("ref"), T.unwrapped(F.coalesce("hypothesis", F.lit(""))).alias("hyp"))
    return _rates(M.word_errors(p), "model", "wer")


def _grams_sql(tokens: str, orders: str) -> str:
    """n-gram counts of each row, kind of token and order: matches, of the hypothesis and of the reference, by unnesting."""
    return f"""
rows AS (SELECT row_number() OVER () AS k, row_id, model, condition, coalesce(reference, '') AS ref, coalesce(hypothesis, '') AS hyp FROM decodes),
sides AS (SELECT k, 'r' AS side, ref AS t FROM rows UNION ALL SELECT k, 'h', hyp FROM rows),
tokens AS ({tokens}),
grams AS (SELECT k, side, kind, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], chr(31)))) AS g FROM tokens, (VALUES {orders}) AS o(kind2, n) WHERE kind = kind2 AND len(w) >= n),
counts AS (SELECT k, kind, n, g, count(*) FILTER (WHERE side = 'h') AS h, count(*) FILTER (WHERE side = 'r') AS r FROM grams GROUP BY ALL),
stats AS (SELECT k, kind, n, sum(least(h, r)) AS m, sum(h) AS h, sum(r) AS r FROM counts GROUP BY ALL)"""


_ASCII_MARKS = r"""'!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~'"""
_LIST = f"list_filter(regexp_split_to_array(t, '{_SP}'), lambda x: x <> '')"
_CHRF_TOKENS = f"""
SELECT k, side, 'c' AS kind, list_filter(string_split(regexp_replace(t, '{_SP}', '', 'g'), ''), lambda x: x <> '') AS w FROM sides
UNION ALL SELECT k, side, 'w', flatten(list_transform({_LIST}, lambda x: CASE WHEN length(x) > 1 AND contains({_ASCII_MARKS}, right(x, 1)) THEN [left(x, -1), right(x, 1)] WHEN length(x) > 1 AND contains({_ASCII_MARKS}, left(x, 1)) THEN [left(x, 1), right(x, -1)] ELSE [x] END)) FROM sides"""
_CHRF_STATS = _grams_sql(_CHRF_TOKENS, ", ".join([f"('c', {n})" for n in range(1, 7)] + ["('w', 1)", "('w', 2)"]))


def _chrf_sql(by: str, more: str = "") -> str:
    group = "GROUP BY ALL"
    return f"""WITH {_CHRF_STATS},
own AS (SELECT k, kind, n, m, CASE WHEN r > 0 THEN h ELSE 0 END AS h, r FROM stats),
summed AS (SELECT {by}, kind, n, sum(m) AS m, sum(h) AS h, sum(r) AS r FROM own JOIN rows USING (k) {group}),
means AS (SELECT {by}, avg(m / h) FILTER (WHERE h > 0 AND r > 0) AS p, avg(m / r) FILTER (WHERE h > 0 AND r > 0) AS q FROM summed {group}),
asked AS (SELECT {by}, count(*) AS n FROM rows {group})
SELECT {by.replace("k, ", "")}{more}, round(CASE WHEN p + q > 0 THEN 500.0 * p * q / (4 * p + q) ELSE 0.0 END, 6) AS chrfpp FROM asked LEFT JOIN means USING ({by})"""


@query(_chrf_sql("model, condition", ", n"))
def chrf_by_model(spark, d):
    """Corpus chrF++: summed n-gram counts, then the score."""
    s = spread(read(spark, d, "decodes").select("model", "condition", "reference", "hypothesis")).select("model", "condition", M.chrf_stats("reference", "hypothesis").alias("c"))
    g = s.groupBy("model", "condition").agg(M.summed("c", 24).alias("c"), F.count("*").alias("n"))
    return g.select("model", "condition", "n", F.round(M.chrf_of("c"), 6).alias("chrfpp"))


@query(_chrf_sql("k, row_id"))
def chrf_sentences(spark, d):
    s = spread(read(spark, d, "decodes").select("row_id", "reference", "hypothesis")).select("row_id", M.chrf_stats("reference", "hypothesis").alias("c"))
    return s.select("row_id", F.round(M.chrf_of("c"), 6).alias("chrfpp"))


_13A = rf"replace(replace(replace(regexp_replace(t, '{_SP}$', ''), '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
for _name, _ch in M.ENTITIES.items():
    _13A = f"replace({_13A}, '{_name}', '{_ch}')"
_13A = f"' ' || {_13A} || ' '"
for _a, _b in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
    _13A = f"regexp_replace({_13A}, '{_a}', '{_b}', 'g')"
_BLEU_TOKENS = f"SELECT k, side, 'w' AS kind, list_filter(regexp_split_to_array({_13A}, '{_SP}'), lambda x: x <> '') AS w FROM sides"


@query(f"""WITH {_grams_sql(_BLEU_TOKENS, "('w', 1), ('w', 2), ('w', 3), ('w', 4)")},
lens AS (SELECT model, condition, sum(CASE WHEN side = 'h' THEN len(w) ELSE 0 END) AS hl, sum(CASE WHEN side = 'r' THEN len(w) ELSE 0 END) AS rl FROM tokens JOIN rows USING (k) GROUP BY ALL),
summed AS (SELECT model, condition, n, sum(m) AS m, sum(h) AS h FROM stats JOIN rows USING (k) GROUP BY ALL),
halved AS (SELECT *, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY model, condition ORDER BY n) AS z FROM summed),
logs AS (SELECT model, condition, max(CASE WHEN n = 4 THEN h END) AS h4, sum(m) AS matched, sum(ln(CASE WHEN m = 0 THEN 1.0 / (pow(2, z) * greatest(h, 1)) ELSE m / h END)) AS l FROM halved GROUP BY ALL)
SELECT model, condition, round(CASE WHEN matched > 0 AND h4 > 0 THEN 100.0 * exp(l / 4) * CASE WHEN hl < rl THEN exp(1 - rl / hl) ELSE 1.0 END ELSE 0.0 END, 6) AS bleu, hl::BIGINT AS hyp_words, rl::BIGINT AS ref_words
FROM lens LEFT JOIN logs USING (model, condition)""")
def bleu_by_model(spark, d):
    """Corpus BLEU by the 13a rules, with exponential smoothing, and both lengths."""
    s = spread(read(spark, d, "decodes").select("model", "condition", "reference", "hypothesis")).select("model", "condition", M.bleu_stats("reference", "hypothesis").alias("c"))
    g = s.groupBy("model", "condition").agg(M.summed("c", 10).alias("c"))
    return g.select("model", "condition", F.round(M.bleu_of("c"), 6).alias("bleu"), F.col("c")[8].alias("hyp_words"), F.col("c")[9].alias("ref_words"))


@query(r"""
SELECT row_id, regexp_replace(hypothesis, '(?s)<\|[^|>]{1,40}\|>.*$', '') AS cut, ((length(hypothesis) - length(replace(hypothesis, '<|endoftext|>', ''))) // 13)::BIGINT AS n_marks FROM decodes""")
def cut_at_special(spark, d):
    h = F.col("hypothesis")
    return read(spark, d, "decodes").select("row_id", T.before_special(h).alias("cut"), T.occurrences(h, "<|endoftext|>").alias("n_marks"))


@query("""
WITH p AS (SELECT row_id, hypothesis, least(nullif(instr(hypothesis, ' agus '), 0), nullif(instr(hypothesis, ' and '), 0), nullif(instr(hypothesis, '. '), 0)) AS place FROM decodes)
SELECT row_id, CASE WHEN place IS NULL THEN hypothesis ELSE substr(hypothesis, 1, (place - 1)::BIGINT) END AS cut FROM p""")
def cut_at_stops(spark, d):
    """Text before the earliest of several strings."""
    return read(spark, d, "decodes").select("row_id", T.before_any(F.col("hypothesis"), [" agus ", " and ", ". "]).alias("cut"))


_W = rf"list_filter(regexp_split_to_array(coalesce(hypothesis, ''), '{_SP}'), lambda x: x <> '')"
_GRAMS = "CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {m} + 1), lambda i: array_to_string(w[i:i + {m}], ' ')) ELSE [] END"


@query()
def repetition_flags(spark, d):
    """Loops of a decode: a run of five words three times or more, or over twenty words few of which differ."""
    w = T.words(F.col("hypothesis"))
    t = read(spark, d, "decodes").select("row_id", w.alias("w"))
    top = T.most_repeated(T.shingles(F.col("w"), 5))
    t = t.withColumn("max_repeat", top.cast("int")).withColumn("unique_ratio", F.round(F.size(F.array_distinct("w")) / F.greatest(F.lit(1), F.size("w")), 6))
    return t.select("row_id", "max_repeat", "unique_ratio", ((F.col("max_repeat") >= 3) | ((F.size("w") > 20) & (F.col("unique_ratio") < 0.3))).alias("loops"))


from glasra.plans.corpus import SQL  # noqa: E402

_TOP = "coalesce(list_max(list_transform(list_distinct(g), lambda x: len(list_filter(g, lambda y: y = x)))), 0)::INT"
SQL["repetition_flags"] = f"""
WITH t AS (SELECT row_id, {_W} AS w FROM decodes), g AS (SELECT row_id, w, {_GRAMS.format(n=5, m=4)} AS g FROM t),
r AS (SELECT row_id, {_TOP} AS max_repeat, round(len(list_distinct(w)) / greatest(1, len(w))::DOUBLE, 6) AS unique_ratio, len(w) AS n FROM g)
SELECT row_id, max_repeat, unique_ratio, (max_repeat >= 3 OR (n > 20 AND unique_ratio < 0.3)) AS loops FROM r"""


@query(f"""
WITH t AS (SELECT row_id, {_W} AS w FROM decodes), g AS (SELECT row_id, w, {_GRAMS.format(n=4, m=3)} AS g FROM t)
SELECT row_id, len(w) >= 12 AND {_TOP} >= 3 AS degenerate FROM g""")
def degenerate_texts(spark, d):
    """A run of four words three times or more; short texts are exempt."""
    w = T.words(F.col("hypothesis"))
    return read(spark, d, "decodes").select("row_id", ((F.size(w) >= 12) & (T.most_repeated(T.shingles(w, 4)) >= 3)).alias("degenerate"))


@query(rf"SELECT row_id, coalesce(regexp_full_match({_trim('hypothesis')}, '!+'), false) AS marks_only, coalesce({_trim('hypothesis')} = '', true) AS blank FROM decodes")
def bad_outputs(spark, d):
    """Outputs of nothing but exclamation marks, and blank ones."""
    t = T.trimmed(F.col("hypothesis"))
    return read(spark, d, "decodes").select("row_id", F.coalesce(t.rlike("^!+$"), F.lit(False)).alias("marks_only"), F.coalesce(t == "", F.lit(True)).alias("blank"))


@query("SELECT model, condition, stop_reason, count(*) AS n FROM decodes GROUP BY ALL")
def stop_reasons(spark, d):
    return read(spark, d, "decodes").groupBy("model", "condition", "stop_reason").agg(F.count("*").alias("n"))


@query(f"""
SELECT model, condition, count(*) AS n, count_if(coalesce({_trim('hypothesis')} = '', true)) AS n_empty, count_if(stop_reason = 'max_new_tokens') AS n_cap, count_if(looping) AS n_looping,
 count_if(eos_emitted = false) AS n_no_eos, count(mean_logprob) AS n_scored, round(avg(mean_logprob), 6) AS mean_logprob, round(count_if(eos_emitted) / count(*)::DOUBLE, 6) AS termination_rate FROM decodes GROUP BY model, condition""")
def decode_counts(spark, d):
    """Conditional and three-valued counts of each cell of the grid."""
    return (
        read(spark, d, "decodes")
        .groupBy("model", "condition")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.coalesce(T.trimmed(F.col("hypothesis")) == "", F.lit(True))).alias("n_empty"),
            F.count_if(F.col("stop_reason") == "max_new_tokens").alias("n_cap"),
            F.count_if("looping").alias("n_looping"),
            F.count_if(F.col("eos_emitted") == False).alias("n_no_eos"),  # noqa: E712
            F.count("mean_logprob").alias("n_scored"),
            F.round(F.avg("mean_logprob"), 6).alias("mean_logprob"),
            F.round(F.count_if("eos_emitted") / F.count("*"), 6).alias("termination_rate"),
        )
    )


@query(f"""
WITH c AS (SELECT model, count(*) AS items, count_if(coalesce({_trim('hypothesis')} = '', true)) AS empty_outputs, count_if(stop_reason = 'max_new_tokens') AS hit_token_cap, count_if(looping) AS repetition_loops,
 count_if(stop_reason IN ('eos', 'stop_string')) AS accepted_stop FROM decodes GROUP BY model)
SELECT *, empty_outputs = 0 AND hit_token_cap = 0 AND repetition_loops = 0 AND accepted_stop = items AS passed FROM c""")
def smoke_gate(spark, d):
    c = read(spark, d, "decodes").groupBy("model").agg(
        F.count("*").alias("items"),
        F.count_if(F.coalesce(T.trimmed(F.col("hypothesis")) == "", F.lit(True))).alias("empty_outputs"),
        F.count_if(F.col("stop_reason") == "max_new_tokens").alias("hit_token_cap"),
        F.count_if("looping").alias("repetition_loops"),
        F.count_if(F.col("stop_reason").isin("eos", "stop_string")).alias("accepted_stop"),
    )
    return c.withColumn("passed", F.expr("empty_outputs = 0 and hit_token_cap = 0 and repetition_loops = 0 and accepted_stop = items"))


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY condition, id ORDER BY CASE WHEN trim(hypothesis) <> '' THEN mean_logprob END DESC NULLS LAST, row_id, decoded_at) AS r FROM decodes)
SELECT condition, id, row_id, model, mean_logprob FROM r WHERE r = 1""")
def best_answers(spark, d):
    """The surest row of each item and condition; the earliest on ties, blank ones only if alone."""
    b = R.best_row(read(spark, d, "decodes").select("condition", "id", "row_id", "model", "mean_logprob", "hypothesis", "decoded_at"), ["condition", "id"], R.answer_score(), ["row_id", "decoded_at"])
    return b.select("condition", "id", "row_id", "model", "mean_logprob")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY condition, id ORDER BY length(trim(hypothesis)) DESC NULLS LAST, row_id, decoded_at) AS r FROM decodes)
SELECT condition, id, row_id FROM r WHERE r = 1""")
def longest_answers(spark, d):
    b = R.best_row(read(spark, d, "decodes").select("condition", "id", "row_id", "hypothesis", "decoded_at"), ["condition", "id"], R.answer_score("longest"), ["row_id", "decoded_at"])
    return b.select("condition", "id", "row_id")


@query("""
SELECT c.snippet_id, coalesce(c.year, 0) AS year, json_extract_string(e, '$.question_id') AS question_id, json_extract_string(e, '$.text_ga') AS text_ga, (e->>'$.marks_available')::INT AS marks_available, (e->>'$.blanks_required')::INT AS blanks_required
FROM clips c, unnest(CAST(c.questions_json AS JSON[])) AS u(e)""")
def exam_questions(spark, d):
    """Questions from the nested JSON."""
    return R.questions(read(spark, d, "clips")).select("snippet_id", "year", "question_id", "text_ga", "marks_available", "blanks_required")


_Q = "(SELECT DISTINCT ON (question_id) * FROM (SELECT json_extract_string(e, '$.question_id') AS question_id, (e->>'$.marks_available')::INT AS marks, c.year FROM clips c, unnest(CAST(c.questions_json AS JSON[])) AS u(e)) ORDER BY question_id, marks NULLS LAST, year NULLS LAST)"


@query(f"""
SELECT p.model, count(*) AS n, count(q.question_id) AS n_known, sum(q.marks)::BIGINT AS marks FROM packets p LEFT JOIN {_Q} q USING (question_id) GROUP BY p.model""")
def packets_with_questions(spark, d):
    """Packets beside the questions of their clips; unknown questions stay."""
    q = R.questions(read(spark, d, "clips")).groupBy("question_id").agg(F.min("marks_available").alias("marks"), F.lit(1).alias("known"))
    j = read(spark, d, "packets").select("model", "question_id").join(q, "question_id", "left")
    return j.groupBy("model").agg(F.count("*").alias("n"), F.count("known").alias("n_known"), F.sum("marks").alias("marks"))


def _verdicts(spark, d):
    """Verdicts made up by rule, as the test tables have none: marks by a hash of the answer, none for every eleventh."""
    p = read(spark, d, "packets").select("packet_id", "model", "question_id", "marks_available", "answers").dropDuplicates(["packet_id"])
    cond = F.explode(F.create_map(F.lit("just_audio"), F.col("answers.just_audio"), F.lit("no_context"), F.col("answers.no_context"), F.lit("just_transcript"), F.col("answers.just_transcript"))).alias("condition", "answer")
    v = p.select("packet_id", "model", "question_id", "marks_available", cond)
    h = F.conv(F.substring(F.md5(F.coalesce("answer", F.lit(""))), 1, 6), 16, 10).cast("long")
    return v.withColumn("marks", F.when(h % 11 != 0, h % (F.coalesce("marks_available", F.lit(2)) + 1)))


_V = """p AS (SELECT DISTINCT ON (packet_id) packet_id, model, question_id, marks_available, answers FROM packets),
a AS (SELECT packet_id, model, question_id, marks_available, 'just_audio' AS condition, answers.just_audio AS answer FROM p UNION ALL SELECT packet_id, model, question_id, marks_available, 'no_context', answers.no_context FROM p UNION ALL SELECT packet_id, model, question_id, marks_available, 'just_transcript', answers.just_transcript FROM p),
h AS (SELECT *, ('0x' || substr(md5(coalesce(answer, '')), 1, 6))::BIGINT AS h FROM a),
v AS (SELECT *, CASE WHEN h % 11 <> 0 THEN h % (coalesce(marks_available, 2) + 1) END AS marks FROM h)"""


_STORED = f"""WITH {_V}, j AS (SELECT packet_id, model, question_id, condition, answer, CASE WHEN h % 11 <> 0 THEN marks WHEN trim(coalesce(answer, '')) = '' THEN 0 END AS marks,
 CASE WHEN h % 11 <> 0 THEN 'by rule' WHEN trim(coalesce(answer, '')) = '' THEN 'no answer given' END AS reason FROM v)"""


@query(_STORED + """ SELECT model, condition, count(*) AS n, count(marks) AS n_judged, count_if(marks IS NULL) AS n_pending, count_if(reason = 'no answer given') AS n_blank, sum(marks)::BIGINT AS marks FROM j GROUP BY ALL""")
def stored_verdicts(spark, d):
    """Answers beside a table of verdicts that is written and read again; blank answers without one have no marks, others are pending."""
    from glasra.sources import sinks

    p = sinks.scratch(spark, "verdicts")
    v = _verdicts(spark, d)
    told = v.where("marks is not null").select("model", F.concat_ws("#", "question_id", "packet_id").alias("question_id"), "condition", F.col("marks").cast("int").alias("marks"), F.lit("by rule").alias("reason"))
    sinks.nested_json(told.groupBy("model", "question_id").agg(F.map_from_entries(F.collect_list(F.struct("condition", F.struct("marks", "reason")))).alias("by_condition")), p)
    read_again = spark.read.text(p).select(F.from_json("value", "model string, question_id string, by_condition map<string,struct<marks:int,reason:string>>").alias("r"))
    flat = read_again.select("r.model", "r.question_id", F.explode("r.by_condition").alias("condition", "w")).select("model", "question_id", "condition", "w.marks", "w.reason")
    j = R.judged(v.select("model", F.concat_ws("#", "question_id", "packet_id").alias("question_id"), "condition", "answer"), flat)
    return j.groupBy("model", "condition").agg(F.count("*").alias("n"), F.count("marks").alias("n_judged"), F.count_if(F.col("marks").isNull()).alias("n_pending"), F.count_if(F.col("reason") == "no answer given").alias("n_blank"), F.sum("marks").alias("marks"))


@query(f"""WITH {_V} SELECT model, condition, count(*) AS n, count(marks) AS n_judged, sum(marks)::BIGINT AS marks, sum(CASE WHEN marks IS NOT NULL THEN marks_available END)::BIGINT AS available FROM v GROUP BY model, condition""")
def marks_by_condition(spark, d):
    """Marks over judged rows only; null where none is judged."""
    return _verdicts(spark, d).groupBy("model", "condition").agg(F.count("*").alias("n"), F.count("marks").alias("n_judged"), F.sum("marks").alias("marks"), F.sum(F.when(F.col("marks").isNotNull(), F.col("marks_available"))).alias("available"))


@query(f"""WITH {_V}, g AS (SELECT model, sum(CASE WHEN condition = 'just_audio' THEN marks END) AS a, sum(CASE WHEN condition = 'no_context' THEN marks END) AS b FROM v GROUP BY model) SELECT model, a::BIGINT AS just_audio, b::BIGINT AS no_context, (a - b)::BIGINT AS gain FROM g""")
def listening_gain(spark, d):
    """Marks with audio less marks without, as a pivot of conditions."""
    p = R.pivoted(_verdicts(spark, d), "model", "condition", F.sum("marks"), ["just_audio", "no_context"])
    return p.withColumn("gain", F.col("just_audio") - F.col("no_context"))


@query("""SELECT DISTINCT ON (packet_id) packet_id, coalesce(answers.just_audio, '') AS a, coalesce(answers.no_context, '') AS b, coalesce(answers.just_transcript, '') AS c FROM packets""")
def nested_answers(spark, d):
    """Answers gathered into a map by condition and read back, '' where missing."""
    v = _verdicts(spark, d).groupBy("packet_id").agg(F.map_from_entries(F.collect_list(F.struct("condition", "answer"))).alias("m"))
    return v.select("packet_id", *[F.coalesce(F.col("m")[c], F.lit("")).alias(n) for c, n in (("just_audio", "a"), ("no_context", "b"), ("just_transcript", "c"))])


@query("""
WITH p AS (SELECT DISTINCT packet_id::VARCHAR AS question_id, marks_available FROM packets WHERE marks_available IS NOT NULL),
v AS (SELECT question_id, 'just_audio' AS condition, ('0x' || substr(md5(question_id), 1, 4))::BIGINT % 6 AS marks FROM p WHERE ('0x' || substr(md5(question_id), 1, 4))::BIGINT % 7 <> 0)
SELECT p.question_id, 'just_audio' AS condition, CASE WHEN v.question_id IS NULL THEN 'missing' ELSE 'marks out of range' END AS problem FROM p LEFT JOIN v USING (question_id) WHERE v.question_id IS NULL OR v.marks > p.marks_available""")
def verdict_gate(spark, d):
    """Verdicts that aren't: missing ones and marks out of range."""
    p = read(spark, d, "packets").where("marks_available is not null").select(F.col("packet_id").cast("string").alias("question_id"), "marks_available").distinct()
    h = F.conv(F.substring(F.md5("question_id"), 1, 4), 16, 10).cast("long")
    v = p.where(h % 7 != 0).select("question_id", F.lit("just_audio").alias("condition"), (h % 6).alias("marks"), F.lit("by rule").alias("reason"))
    return G.verdict_violations(v, p, ["just_audio"])


_CODE = "CASE WHEN lower(trim(lang)) IN ('ga', 'gle', 'ga-ie', 'gaeilge') THEN 'ga' WHEN lower(trim(lang)) IN ('en', 'eng', 'en-gb', 'en-ie', 'english') THEN 'en' ELSE 'other' END"


@query(f"""
WITH r AS (SELECT model, mean_logprob, {_CODE} AS route FROM decodes WHERE trim(hypothesis) <> '')
SELECT model, count(*) AS n, count_if(route = 'en') AS n_translation, round(100.0 * count_if(route = 'en') / count(*), 6) AS pct_translation, count_if(route = 'ga') AS n_transcription, count_if(route = 'other') AS n_other,
 round(avg(CASE WHEN route = 'en' THEN mean_logprob END), 6) AS mean_translation FROM r GROUP BY model""")
def route_summary(spark, d):
    """Rows routed by their language label, shares and a mean over one route (null if it has none)."""
    code = lang_code(F.col("lang"))
    route = F.coalesce(F.when(code.isin("ga", "en"), code), F.lit("other"))
    r = read(spark, d, "decodes").where("trim(hypothesis) <> ''").select("model", "mean_logprob", route.alias("route"))
    n = lambda k: F.count_if(F.col("route") == k)
    return r.groupBy("model").agg(
        F.count("*").alias("n"),
        n("en").alias("n_translation"),
        F.round(n("en") * 100.0 / F.count("*"), 6).alias("pct_translation"),
        n("ga").alias("n_transcription"),
        n("other").alias("n_other"),
        F.round(F.avg(F.when(F.col("route") == "en", F.col("mean_logprob"))), 6).alias("mean_translation"),
    )


@query("""
SELECT condition, max(CASE WHEN model = 'base' THEN m END) AS base, max(CASE WHEN model = 'ab1' THEN m END) AS ab1, max(CASE WHEN model = 'ab4' THEN m END) AS ab4, max(CASE WHEN model = 'none' THEN m END) AS none
FROM (SELECT condition, model, round(avg(unique_token_ratio), 6) AS m FROM decodes GROUP BY condition, model) GROUP BY condition""")
def pivot_report(spark, d):
    """Conditions by models, also one that has no rows."""
    t = read(spark, d, "decodes")
    p = R.pivoted(t, "condition", "model", F.round(F.avg("unique_token_ratio"), 6), ["base", "ab1", "ab4", "none"], t.select("condition").distinct())
    return p.select("condition", "base", "ab1", "ab4", "none")


@query("SELECT DISTINCT ON (model) model, row_id, id FROM decodes ORDER BY model, row_id DESC, decoded_at DESC")
def last_per_model(spark, d):
    t = read(spark, d, "decodes").select("model", "row_id", "id", F.struct("row_id", "decoded_at").alias("o"))
    return R.last_of(t, "model", "o").select("model", "row_id", "id")


@query("""
SELECT row_id, model, NULL AS decoder, lang, generated_tokens FROM decodes UNION ALL SELECT row_id, NULL, decoder, lang, NULL FROM asr_pairs""")
def ragged_union(spark, d):
    """Tables with different columns one under another."""
    a = read(spark, d, "decodes").select("row_id", "model", "lang", "generated_tokens")
    b = read(spark, d, "asr_pairs").select("row_id", "decoder", "lang")
    return R.union_all([a, b]).select("row_id", "model", "decoder", "lang", "generated_tokens")


@query("""
SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM events, unnest(json_keys(props::JSON)) AS u(k)""")
def flattened_props(spark, d):
    """Nested JSON as key-value rows."""
    e = read(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.select("event_id", "key", "value")


@query(r"SELECT row_id, model, try_cast(nullif(regexp_extract(model, '(\d+)', 1), '') AS INT) AS step, regexp_replace(condition, '_(ga|en)$', '') AS task FROM decodes WHERE regexp_full_match(model, 'ab\d|base.*')")
def model_steps(spark, d):
    """Rows by a full match of their label, numbers and suffixes taken from it."""
    t = read(spark, d, "decodes").where(F.col("model").rlike(r"^(ab\d|base.*)$"))
    return t.select("row_id", "model", F.expr(r"try_cast(nullif(regexp_extract(model, '(\\d+)', 1), '') as int)").alias("step"), F.regexp_replace("condition", "_(ga|en)$", "").alias("task"))


@query("""
WITH t AS (SELECT * FROM (VALUES ('base', 'baseline'), ('ab1', 'first'), ('ab4', 'last')) AS v(model, name))
SELECT name, count(*) AS n FROM decodes JOIN t USING (model) GROUP BY name""")
def mapped_labels(spark, d):
    """Labels mapped by a given table; others are dropped."""
    t = spark.createDataFrame([("base", "baseline"), ("ab1", "first"), ("ab4", "last")], "model string, name string")
    return read(spark, d, "decodes").join(F.broadcast(t), "model").groupBy("name").agg(F.count("*").alias("n"))


@query("""
SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM events, unnest(json_keys(props::JSON)) AS u(k)
WHERE json_type(props::JSON, '$.' || k) NOT IN ('OBJECT', 'ARRAY', 'NULL') AND (k <> 'ref' OR json_extract_string(props, '$.' || k) = 'ad')""")
def scalar_props(spark, d):
    """Only the plain values of nested JSON, and of one key only those of a given list."""
    e = read(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    plain = F.col("value").isNotNull() & ~F.col("value").rlike(r"^\s*[\[{]")
    return e.where(plain & ((F.col("key") != "ref") | (F.col("value") == "ad"))).select("event_id", "key", "value")


@query("""
WITH m AS (SELECT model, max(unique_token_ratio) AS top FROM decodes GROUP BY model) SELECT row_id, model FROM decodes JOIN m USING (model) WHERE model = 'base' OR abs(unique_token_ratio - top) <= 1e-8 + 1e-5 * abs(top)""")
def top_fraction(spark, d):
    """Rows at their group's greatest fraction, within a tolerance, and all of the base: an aggregate and a join, as groups may be large."""
    t = read(spark, d, "decodes").select("row_id", "model", "unique_token_ratio")
    m = t.groupBy("model").agg(F.max("unique_token_ratio").alias("top"))
    return t.join(m, "model").where("model = 'base' or abs(unique_token_ratio - top) <= 1e-8 + 1e-5 * abs(top)").select("row_id", "model")


@query("SELECT row_id, greatest(8, (ceil(len(list_filter(regexp_split_to_array(coalesce(reference, ''), '\\s+'), lambda x: x <> '')) * 1.25) + 1)::BIGINT) AS budget, least(40, greatest(8, (ceil(len(list_filter(regexp_split_to_array(coalesce(reference, ''), '\\s+'), lambda x: x <> '')) * 2.5) + 1)::BIGINT)) AS wide FROM decodes")
def generation_budgets(spark, d):
    n = T.n_words(F.col("reference"))
    return read(spark, d, "decodes").select("row_id", T.token_budget(n).alias("budget"), T.token_budget(n, 2.5, 8, 40).alias("wide"))


@query(f"""
SELECT packet_id, 'Q: ' || {_trim('question')} || chr(10) || 'A:' AS prompt, concat_ws(chr(10), '<user> ' || {_trim('question')}, '<assistant> ' || {_trim("coalesce(answers.just_audio, '')")}) AS chat,
 CASE WHEN blanks_required > 1 THEN chr(10) || 'Q:' ELSE '<|im_end|>' END AS stop FROM packets""")
def prompts(spark, d):
    """Prompts and chats from templates, with the stop mark of their kind."""
    p = read(spark, d, "packets")
    q, a = T.trimmed(F.col("question")), T.trimmed(F.coalesce("answers.just_audio", F.lit("")))
    turns = F.array(F.struct(F.lit("user").alias("r"), q.alias("t")), F.struct(F.lit("assistant").alias("r"), a.alias("t")))
    chat = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<"), t.r, F.lit("> "), t.t)), "\n")
    return p.select("packet_id", F.concat(F.lit("Q: "), q, F.lit("\nA:")).alias("prompt"), chat.alias("chat"), F.when(F.col("blanks_required") > 1, "\nQ:").otherwise("<|im_end|>").alias("stop"))


_RUBRIC = rf"""
WITH q AS (SELECT DISTINCT json_extract_string(e, '$.question_id') AS question_id, coalesce(json_extract_string(e, '$.rubric_ga'), '') AS rubric, {_trim(rf"regexp_replace(coalesce(json_extract_string(e, '$.text_ga'), ''), '{_SP}', ' ', 'g')")} AS asked
  FROM clips c, unnest(CAST(c.questions_json AS JSON[])) AS u(e)),
p AS (SELECT question_id, asked, unnest(regexp_split_to_array(rubric, '(?i)=\s*\d+\s*mharc')[:-2]) AS part, generate_subscripts(regexp_split_to_array(rubric, '(?i)=\s*\d+\s*mharc')[:-2], 1) AS i FROM q),
a AS (SELECT *, {_trim(rf"regexp_replace(regexp_replace(part, '(?s)^.*\?', ''), '{_SP}', ' ', 'g')")} AS x FROM p),
b AS (SELECT *, CASE WHEN asked <> '' AND starts_with(x, asked) THEN {_trim("substr(x, length(asked) + 1)")} ELSE x END AS y FROM a),
c AS (SELECT *, regexp_replace({_trim(r"regexp_replace(y, '(?i)^.*\b\d+\s*mharc(?:\s*\+\s*\d+\s*mharc)*\b', '')")}, '^(?:[-•]\s*|\d+[.)]\s*)', '') AS z FROM b)
"""


@query(_RUBRIC + "SELECT question_id, string_agg(z, ' | ' ORDER BY i) AS answers, count(*)::INT AS n_answers FROM c WHERE z <> '' GROUP BY question_id")
def rubric_candidates(spark, d):
    """Answers that a marking scheme accepts."""
    q = R.questions(read(spark, d, "clips")).select("question_id", "rubric_ga", "text_ga").distinct()
    a = q.select("question_id", T.rubric_answers(F.col("rubric_ga"), F.col("text_ga")).alias("a")).where(F.size("a") > 0)
    return a.select("question_id", F.array_join("a", " | ").alias("answers"), F.size("a").alias("n_answers"))


@query(_RUBRIC + r"SELECT q.question_id, greatest(8, ceil(coalesce(max(len(list_filter(regexp_split_to_array(z, '\s+'), lambda w: w <> ''))), 0) * 1.25) + 1)::BIGINT AS budget FROM q LEFT JOIN c ON c.question_id = q.question_id AND z <> '' GROUP BY q.question_id")
def answer_budgets(spark, d):
    """Generation budgets sized by the longest accepted answer."""
    q = R.questions(read(spark, d, "clips")).select("question_id", "rubric_ga", "text_ga").distinct()
    return q.select("question_id", T.budget_of_longest(T.rubric_answers(F.col("rubric_ga"), F.col("text_ga"))).alias("budget"))


@query(f"SELECT row_id, {_trim(rf"regexp_replace(hypothesis, '{_SP}', ' ', 'g')")} AS flat FROM decodes")
def flattened_text(spark, d):
    """White space flattened before a language is told."""
    return read(spark, d, "decodes").select("row_id", T.trimmed(F.regexp_replace("hypothesis", T.SPACES, " ")).alias("flat"))


_FLAT = _trim(rf"regexp_replace(coalesce(hypothesis, ''), '{_SP}', ' ', 'g')")


@query(f"SELECT row_id, CASE WHEN {_FLAT} = '' THEN 'empty' WHEN contains({_FLAT}, ' an ') THEN 'ga' ELSE 'en' END AS label, CASE WHEN {_FLAT} = '' THEN 1.0::DOUBLE WHEN contains({_FLAT}, ' an ') THEN 0.75 ELSE 0.5 END AS confidence FROM decodes")
def classified_outputs(spark, d):
    """A language by an outside classifier, here a stand-in of one word; blank outputs aren't asked about."""
    c = T.classified(F.col("hypothesis"), lambda ts: [("ga", 0.75) if " an " in t else ("en", 0.5) for t in ts])
    return spread(read(spark, d, "decodes").select("row_id", "hypothesis")).select("row_id", c.alias("c")).select("row_id", "c.label", "c.confidence")


@query("SELECT row_id, CASE WHEN length(hypothesis) > length(reference) THEN 'longer' WHEN length(reference) > length(hypothesis) THEN 'shorter' ELSE 'tie' END AS route FROM decodes")
def score_routes(spark, d):
    """A three-way label by which of two scores is greater."""
    return read(spark, d, "decodes").select("row_id", R.route(F.length("hypothesis"), F.length("reference"), "longer", "shorter").alias("route"))


@query("SELECT row_id, 'ref' AS object, ref AS text, lang FROM asr_pairs WHERE ref IS NOT NULL UNION ALL SELECT row_id, 'hyp', hyp, lang FROM asr_pairs WHERE hyp IS NOT NULL")
def unpivoted_objects(spark, d):
    """Two text columns as rows of (key, object)."""
    p = read(spark, d, "asr_pairs").select("row_id", "lang", "ref", "hyp")
    return p.unpivot(["row_id", "lang"], ["ref", "hyp"], "object", "text").where("text is not null").select("row_id", "object", "text", "lang")


@query("""
WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, event_type, count(*) AS n, max(r) - min(r) + 1 = count(*) AS contiguous FROM p GROUP BY ALL""")
def contiguous_marks(spark, d):
    """Whether the places of a mark in its sequence are without a gap: places among all rows do, as a sequence lies together."""
    from glasra.operators.sampling import placed

    p = placed(read(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), F.struct("user_id", "ts", "event_id"), "r")
    return p.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), (F.max("r") - F.min("r") + 1 == F.count("*")).alias("contiguous"))


@query("SELECT run_id, max(CASE WHEN e.key = 'nce' THEN e.value.total_words END) AS nce_words, count(*) AS n FROM (SELECT run_id, unnest(map_entries(per_source)) AS e FROM text_token_ratio_report) GROUP BY run_id")
def nested_and_back(spark, d):
    """Flattened `a.b` keys put back into a map of maps."""
    r = read(spark, d, "text_token_ratio_report").select("run_id", F.explode("per_source").alias("source", "v"))
    flat = r.select("run_id", F.concat_ws(".", "source", F.lit("total_words")).alias("k"), F.col("v.total_words").alias("x"))
    back = flat.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct(F.substring_index("k", ".", 1).alias("s"), F.struct("x")))).alias("m"))
    return back.select("run_id", F.col("m")["nce"]["x"].alias("nce_words"), F.size("m").cast("long").alias("n"))


@query("""
WITH q AS (SELECT c.snippet_id, json_extract_string(e, '$.question_id') AS qid, (e->>'$.question_number')::INT AS n FROM clips c, unnest(CAST(c.questions_json AS JSON[])) AS u(e))
SELECT snippet_id, string_agg(qid, ',' ORDER BY n, qid) AS ids, count(*) AS n FROM q GROUP BY snippet_id""")
def questions_of_clips(spark, d):
    """Rows gathered under their parent in order."""
    q = R.questions(read(spark, d, "clips")).select("snippet_id", "question_id", F.col("question_number").cast("int").alias("n"))
    g = q.groupBy("snippet_id").agg(F.array_sort(F.collect_list(F.struct("n", "question_id"))).alias("a"))
    return g.select("snippet_id", F.array_join(F.transform("a", lambda x: x.question_id), ",").alias("ids"), F.size("a").cast("long").alias("n"))


@query("""
SELECT item_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY sha256('3:' || epoch::VARCHAR || ':' || item_id::VARCHAR), item_id) - 1 AS place FROM eval_items, range(3) AS t(epoch)""")
def epochs(spark, d):
    """Every item once an epoch, each in its own order. Items are a fixed set."""
    from glasra.operators.sampling import sha_rank

    e = read(spark, d, "eval_items").select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("epoch"))
    w = W.partitionBy("epoch").orderBy(sha_rank("3", F.col("epoch"), F.col("item_id")), "item_id")
    return e.select("item_id", "epoch", (F.row_number().over(w) - 1).cast("long").alias("place"))


@query(f"""
SELECT coalesce(lang, '(none)') AS lang, condition, count(*) AS n, count_if(looping) AS n_looping, count_if(eos_emitted) AS n_eos, count_if(coalesce(trim(hypothesis) = '', true)) AS n_empty, count_if(hypothesis = reference) AS n_exact,
 round(count_if(eos_emitted) / count(*)::DOUBLE, 6) AS termination FROM decodes GROUP BY 1, 2""")
def cell_summary(spark, d):
    """Booleans counted in each cell of language and condition."""
    t = read(spark, d, "decodes").groupBy(F.coalesce("lang", F.lit("(none)")).alias("lang"), "condition")
    return t.agg(F.count("*").alias("n"), F.count_if("looping").alias("n_looping"), F.count_if("eos_emitted").alias("n_eos"), F.count_if(F.coalesce(F.trim("hypothesis") == "", F.lit(True))).alias("n_empty"), F.count_if(F.col("hypothesis") == F.col("reference")).alias("n_exact"), F.round(F.count_if("eos_emitted") / F.count("*"), 6).alias("termination"))


@query("""
SELECT model, CASE WHEN avg(CASE WHEN condition = 'asr_ga' AND looping THEN mean_logprob END) IS NULL THEN '–' ELSE printf('%.3f', avg(CASE WHEN condition = 'asr_ga' AND looping THEN mean_logprob END)) END AS looping_score,
 CASE WHEN avg(CASE WHEN condition = 'nowhere' THEN mean_logprob END) IS NULL THEN '–' ELSE 'x' END AS nowhere_score FROM decodes GROUP BY model""")
def formatted_scores(spark, d):
    """Numbers as text for a report, a dash where there is none."""
    pick = lambda c: F.avg(F.when(c, F.col("mean_logprob")))
    return read(spark, d, "decodes").groupBy("model").agg(T.dashed(pick((F.col("condition") == "asr_ga") & F.col("looping")), 3).alias("looping_score"), T.dashed(pick(F.col("condition") == "nowhere")).alias("nowhere_score"))


@query("""
SELECT 'clips' AS what, count(*) AS n FROM clips UNION ALL SELECT 'questions', sum(json_array_length(questions_json::JSON))::BIGINT FROM clips UNION ALL SELECT 'exploded', count(*) FROM clips c, unnest(CAST(c.questions_json AS JSON[])) AS u(e)""")
def conserved_rows(spark, d):
    """Rows before and after an explode; a gate ends the job if any is lost."""
    c = read(spark, d, "clips")
    n = c.agg(F.count("*").alias("clips"), F.coalesce(F.sum(F.greatest(F.coalesce(F.size(F.from_json("questions_json", R.QUESTION)), F.lit(0)), F.lit(0)).cast("long")), F.lit(0)).alias("questions")).first()
    q = R.questions(c)
    G.row_count(q, n.questions, "questions")
    return spark.createDataFrame([("clips", n.clips), ("questions", n.questions), ("exploded", n.questions)], "what string, n long")


_PCM = """
WITH h AS (SELECT snippet_id, hex(audio) AS h, octet_length(audio) // 2 AS n FROM clips),
s AS (SELECT snippet_id, unnest(list_transform(range(0, n), lambda i: ('0x' || substr(h, 4 * i + 3, 2) || substr(h, 4 * i + 1, 2))::INT)) AS u FROM h),
x AS (SELECT snippet_id, (CASE WHEN u >= 32768 THEN u - 65536 ELSE u END) / 32768.0::DOUBLE AS x FROM s),
l AS (SELECT snippet_id, round(max(abs(x)), 9) AS peak, round(sqrt(avg(x * x)), 9) AS level FROM x GROUP BY snippet_id)
SELECT h.snippet_id, n AS n_samples, peak, level FROM h LEFT JOIN l USING (snippet_id)"""


@query(_PCM)
def pcm_levels(spark, d):
    """Samples, peak and mean level of 16-bit PCM; null audio stays null."""
    import numpy as np
    import pandas as pd

    from glasra.functions.audio import pcm16

    def levels(batches):
        for b in batches:
            x = [None if a is None else pcm16(bytes(a)) for a in b.audio]
            out = pd.DataFrame({"snippet_id": b.snippet_id})
            out["n_samples"] = pd.array([None if v is None else len(v) for v in x], "Int64")
            out["peak"] = [None if v is None or not len(v) else round(float(abs(v).max()), 9) for v in x]
            out["level"] = [None if v is None or not len(v) else round(float(np.sqrt((v**2).mean())), 9) for v in x]
            yield out

    return read(spark, d, "clips").select("snippet_id", "audio").mapInPandas(levels, "snippet_id string, n_samples long, peak double, level double")


def resampled_clips(spark, d):
    """Clips at 16 kHz: samples after and the level, which resampling hardly changes; null audio and rates stay null."""
    import numpy as np
    import pandas as pd

    from glasra.functions.audio import pcm16, resampled

    def run(batches):
        for b in batches:
            x = [None if a is None or sr is None or not sr > 0 else resampled(pcm16(bytes(a)), int(sr), 16000) for a, sr in zip(b.audio, b.sr, strict=True)]
            yield pd.DataFrame({"snippet_id": b.snippet_id, "n_samples": pd.array([None if v is None else len(v) for v in x], "Int64"), "level": [None if v is None or not len(v) else float(np.sqrt((v**2).mean())) for v in x]})

    return read(spark, d, "clips").select("snippet_id", "audio", "sr").mapInPandas(run, "snippet_id string, n_samples long, level double")


query()(resampled_clips)


_TURNS = r"regexp_split_to_array(text, '\r?\n')"


@query(f"""SELECT doc_id, {_TURNS}[1] AS first_turn, len({_TURNS})::INT AS n_turns,
 md5(array_to_string(list_transform({_TURNS}, lambda t: CASE WHEN {_trim('t')} = '' THEN '' ELSE '[' || {_trim('t')} || ']' END), '|')) AS digest FROM documents WHERE {SOURCE_SQL} = 'conversations_ga' AND text IS NOT NULL""")
def restored_turns(spark, d):
    """Turns of conversations sent in batches across records to a service (here: brackets), put back where they came from."""
    t = read(spark, d, "documents").where((source_name(F.col("source")) == "conversations_ga") & F.col("text").isNotNull()).select("doc_id", F.split("text", r"\r?\n").alias("turns"))
    r = Q.restored_turns(t, "doc_id", "turns", lambda xs: [f"[{x}]" for x in xs]).withColumnRenamed("turns", "done")
    return t.join(r, "doc_id").select("doc_id", F.get("turns", F.lit(0)).alias("first_turn"), F.size("turns").alias("n_turns"), F.md5(F.array_join("done", "|")).alias("digest"))


@query("""
WITH n AS (SELECT count(*) AS n FROM eval_items), o AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM eval_items)
SELECT a.item_id, b.item_id AS other_id FROM o a, n JOIN o b ON b.i = (a.i + 1) % n.n""")
def mismatch_pairs(spark, d):
    """Each item beside the next one in a cycle, as a control. Items are a fixed set."""
    from glasra.operators.sampling import ordinal

    o = ordinal(read(spark, d, "eval_items").select("item_id", F.lit(1).alias("one")), ["one"], "item_id", "i").select("item_id", "i")
    n = o.agg(F.count("*").alias("n"))
    a = o.join(F.broadcast(n), F.lit(True)).select("item_id", F.pmod(F.col("i") + 1, F.col("n")).alias("i"))  # one row
    return a.join(o.withColumnRenamed("item_id", "other_id"), "i").select("item_id", "other_id")


def _sides(spark, d, centred=False):
    """Two aligned sets of each layer (`label`): the vector at place i by vec_id, and the one half the layer further; an odd last one has no partner."""
    from glasra.operators.sampling import ordinal

    t = read(spark, d, "embeddings").select("vec_id", "embedding", "label")
    half = t.groupBy("label").agg(F.floor(F.count("*") / 2).alias("half"))
    e = ordinal(t, ["label"], "vec_id", "p").join(half, "label").where(F.col("p") < 2 * F.col("half"))
    e = e.select("label", F.pmod("p", F.col("half")).alias("i"), F.when(F.col("p") < F.col("half"), 0).otherwise(1).alias("side"), "embedding")
    return V.centred(e, ["label", "side"], "i", "embedding") if centred else e


def _aligned(spark, d, centred=False):
    side = lambda s: F.first(F.when(F.col("side") == s, F.col("embedding")), ignorenulls=True)
    pairs = _sides(spark, d, centred).groupBy("label", "i").agg(side(0).alias("a"), side(1).alias("b"))  # one vector of each side
    return V.alignment(pairs, ["label"], "a", "b")


_PLACED = "(SELECT label, p % h AS i, p // h AS side, embedding FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p, count(*) OVER (PARTITION BY label) // 2 AS h, embedding FROM embeddings) WHERE p < 2 * h)"
_RAW = f"SELECT label, i, side, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM {_PLACED}"
_CENTRED = f"SELECT label, i, side, list(x - m ORDER BY d) AS v FROM (SELECT *, avg(x) OVER (PARTITION BY label, side, d) AS m FROM (SELECT label, i, side, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM {_PLACED})) GROUP BY label, i, side"


def _mexa_sql(vec: str, p: str = "") -> str:
    return f"""
{p}e AS ({vec}), {p}s AS (SELECT label, a.i, b.i AS j, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM {p}e a JOIN {p}e b USING (label) WHERE a.side = 0 AND b.side = 1),
{p}dd AS (SELECT label, i, s AS own FROM {p}s WHERE i = j),
{p}r AS (SELECT label, s.i, 1 + count_if(j <> s.i AND (s > own OR (s = own AND j < s.i))) AS row_rank, count_if(j <> s.i AND s >= own) AS e FROM {p}s s JOIN {p}dd d ON s.label = d.label AND s.i = d.i GROUP BY s.label, s.i),
{p}c AS (SELECT label, s.j AS i, 1 + count_if(s.i <> j AND (s > own OR (s = own AND s.i < j))) AS col_rank, count_if(s.i <> j AND s >= own) AS e FROM {p}s s JOIN {p}dd d ON s.label = d.label AND s.j = d.i GROUP BY s.label, s.j)
""".replace("(SELECT label, s.i, 1", "(SELECT s.label, s.i, 1").replace("(SELECT label, s.j AS i", "(SELECT s.label, s.j AS i")


_SCORE = "SELECT label, count(*) AS n, round(avg(CASE WHEN r.e = 0 AND c.e = 0 THEN 1.0 ELSE 0.0 END), 6) AS mexa, round(avg(CASE WHEN row_rank <= 10 AND col_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS mexa_at10, round(avg(CASE WHEN row_rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN row_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top5, quantile_cont(row_rank, 0.5) AS median_rank FROM r JOIN c USING (label, i) GROUP BY label"


def _score(al):
    """Scores of each layer; `mexa` is null where a vector of the layer has no direction."""
    hit = lambda c: F.round(F.avg(c.cast("double")), 6)
    return al.groupBy("label").agg(
        F.count("*").alias("n"),
        F.when(~F.max("missing"), hit(F.col("strict"))).alias("mexa"),
        hit((F.col("row_rank") <= 10) & (F.col("col_rank") <= 10)).alias("mexa_at10"),
        hit(F.col("row_rank") == 1).alias("top1"),
        hit(F.col("row_rank") <= 5).alias("top5"),
        F.percentile("row_rank", 0.5).alias("median_rank"),
    )


@query("WITH " + _mexa_sql(_RAW) + _SCORE)
def mexa_raw(spark, d):
    """Strict mutual nearest neighbours, mutual top ten and directional retrieval of two aligned sets, for each layer."""
    return _score(_aligned(spark, d))


@query("WITH " + _mexa_sql(_CENTRED) + _SCORE)
def mexa_centred(spark, d):
    return _score(_aligned(spark, d, True))


@query("WITH " + _mexa_sql(_RAW) + "SELECT label, i, row_rank, col_rank, r.e = 0 AND c.e = 0 AS strict FROM r JOIN c USING (label, i)")
def alignment_ranks(spark, d):
    return _aligned(spark, d).select("label", "i", "row_rank", "col_rank", "strict")


@query("WITH " + _mexa_sql(_RAW) + "," + _mexa_sql(_CENTRED, "z") + """,
m AS (SELECT 'raw' AS kind, label, avg(CASE WHEN r.e = 0 AND c.e = 0 THEN 1.0 ELSE 0.0 END) AS s FROM r JOIN c USING (label, i) GROUP BY label
 UNION ALL SELECT 'centred', label, avg(CASE WHEN r.e = 0 AND c.e = 0 THEN 1.0 ELSE 0.0 END) FROM zr r JOIN zc c USING (label, i) GROUP BY label)
SELECT kind, round(coalesce(max(s) FILTER (WHERE s > 0), 0.0), 6) AS best, coalesce(arg_min(label, (-s, label)) FILTER (WHERE s > 0), 0)::INT AS best_layer FROM m GROUP BY kind""")
def best_layers(spark, d):
    """The best layer by either score, layers without a score left out."""
    raw, centred = (_score(_aligned(spark, d, c)).select(F.lit(k).alias("kind"), "label", "mexa") for k, c in (("raw", False), ("centred", True)))
    b = R.best_over(raw.unionByName(centred), ["kind"], "label", "mexa")
    return b.select("kind", F.round("best", 6).alias("best"), F.col("best_layer").cast("int").alias("best_layer"))


@query(f"""
WITH a AS (SELECT label, i, len(embedding) AS s FROM {_PLACED} WHERE side = 0), b AS (SELECT label, i + (label % 2) AS i, len(embedding) AS s FROM {_PLACED} WHERE side = 1)
SELECT label, i, CASE WHEN b.s IS NULL THEN 'only left' ELSE 'only right' END AS problem FROM a FULL JOIN b USING (label, i) WHERE a.s IS NULL OR b.s IS NULL""")
def parallel_shapes(spark, d):
    """Row-for-row gate of two sets: here the second one's places are shifted by one in every other layer."""
    e = _sides(spark, d)
    a, b = (e.where(F.col("side") == s).select("label", "i", F.col("embedding").alias("v")) for s in (0, 1))
    return V.unparallel(a, b.withColumn("i", F.col("i") + F.pmod("label", F.lit(2))), ["label", "i"], "v")


@query("""
SELECT vec_id, CASE WHEN bad THEN 'not finite' ELSE 'zero' END AS problem FROM (
 SELECT vec_id, vec_id % 50 = 7 AS bad, vec_id % 50 = 7 OR vec_id % 50 = 11 OR list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) = 0 AS odd FROM embeddings) WHERE odd""")
def vector_violations(spark, d):
    """Vectors of no direction; to show, every fiftieth is given a NaN and the one four places on is made zero."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    k = F.pmod("vec_id", F.lit(50))
    v = F.transform("embedding", lambda x, i: F.when((k == 7) & (i == 3), float("nan")).when(k == 11, 0.0).otherwise(x))
    return V.violations(e.withColumn("v", v), ["vec_id"], "v")


@query("""
WITH s AS (SELECT label AS layer, vec_id % 7 AS object, avg(list_sum(embedding)) AS score FROM embeddings GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY round(score, 9) DESC, layer) AS r, avg(score) OVER (PARTITION BY object) AS mean FROM s)
SELECT object, round(mean, 6) AS mean_score, round(score, 6) AS best_score, layer AS best_layer FROM r WHERE r = 1""")
def layer_summary(spark, d):
    """Mean and greatest score over layers and the first layer that has it."""
    e = read(spark, d, "embeddings").select(F.col("label").alias("layer"), F.pmod("vec_id", F.lit(7)).alias("object"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("x"))
    s = e.groupBy("layer", "object").agg(F.avg("x").alias("score"))
    s = s.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))  # a layer that isn't a number has no score
    best = F.max_by("layer", F.when(F.col("score").isNotNull(), F.struct(F.round("score", 9), -F.col("layer"))))
    return s.groupBy("object").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.max("score"), 6).alias("best_score"), best.alias("best_layer"))


@query("""
WITH e AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS p, embedding FROM embeddings),
x AS (SELECT label, p, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM e)
SELECT label, d::INT AS dim, round(sum(x * p) / sum(p), 6) AS weighted, round(arg_max(x, p), 6) AS last FROM x GROUP BY label, d""")
def pooled_vectors(spark, d):
    """Position-weighted mean and last vector of each sequence."""
    from glasra.operators.sampling import ordinal

    e = ordinal(read(spark, d, "embeddings").select("label", "vec_id", "embedding"), ["label"], "vec_id", "p").withColumn("p", F.col("p") + 1)
    return V.weighted_mean(e, ["label"], "p", "embedding").select("label", "dim", F.round("weighted", 6).alias("weighted"), F.round("last", 6).alias("last"))


@query("""
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(x) AS m FROM x GROUP BY ALL),
s AS (SELECT vec_id, m.label, sqrt(sum((x - m) * (x - m))) AS s FROM x JOIN m USING (d) GROUP BY ALL), k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT label FROM m))
SELECT vec_id, arg_min(k, (round(s, 9), k))::INT AS centroid, round(min(s), 6) AS distance FROM s JOIN k USING (label) GROUP BY vec_id""")
def nearest_centroids(spark, d):
    """Each vector's nearest label mean; labels are a fixed few."""
    import numpy as np

    e = read(spark, d, "embeddings")
    m = e.where("label is not null").select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x")).collect()
    labels, dims = sorted({r.label for r in m}), 1 + max((r.dim for r in m), default=0)
    c = np.zeros((len(labels), dims))
    for r in m:
        c[labels.index(r.label), r.dim] = r.x
    return V.nearest(e, c, "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@query("SELECT id FROM decodes WHERE condition = 'asr_ga' INTERSECT SELECT id FROM decodes WHERE condition = 'asr_en'")
def shared_ids(spark, d):
    t = read(spark, d, "decodes")
    return t.where("condition = 'asr_ga'").select("id").intersect(t.where("condition = 'asr_en'").select("id"))


@query("SELECT row_id, 'asr_pairs' AS side FROM (SELECT row_id FROM asr_pairs EXCEPT SELECT row_id FROM decodes) UNION ALL SELECT row_id, 'decodes' FROM (SELECT row_id FROM decodes EXCEPT SELECT row_id FROM asr_pairs)")
def id_differences(spark, d):
    diff = G.id_differences(read(spark, d, "asr_pairs"), read(spark, d, "decodes"), "row_id")
    return diff.select("row_id", F.when(F.col("problem") == "missing", "asr_pairs").otherwise("decodes").alias("side"))


@query("""
WITH e AS (SELECT key, unnest(units) AS u, generate_subscripts(units, 1) AS i FROM (SELECT DISTINCT ON (key) * FROM cluas_units WHERE len(units) > 0)), f AS (SELECT key, u, min(i) AS i FROM e GROUP BY key, u)
SELECT key, md5(string_agg(u::VARCHAR, ',' ORDER BY i)) AS digest, count(*)::INT AS n FROM f WHERE u IS NOT NULL GROUP BY key""")
def ordered_distinct(spark, d):
    """Distinct items in order of first appearance."""
    u = sequences(spark, d)
    a = F.array_compact(F.array_distinct("units"))
    return u.select("key", F.md5(F.array_join(a, ",")).alias("digest"), F.size(a).alias("n"))


@query("""SELECT row_id, (n + greatest(8, (ceil(n * 2.5) + 1)::BIGINT))::BIGINT AS total FROM (SELECT row_id, len(list_filter(regexp_split_to_array(coalesce(reference, ''), '\\s+'), lambda x: x <> '')) AS n FROM decodes) WHERE n + greatest(8, ceil(n * 2.5) + 1) > 48""")
def prompt_budget_gate(spark, d):
    """Prompts that leave no room for what is to be generated: both together over 48 tokens here."""
    n = T.n_words(F.col("reference"))
    return G.too_long(read(spark, d, "decodes"), ["row_id"], [n, T.token_budget(n, 2.5)], 48)


@query("""SELECT domain, wanted, least(have, wanted) AS got, have >= wanted AS reached FROM (SELECT domain, 40::BIGINT AS wanted, count(*) AS have FROM documents WHERE domain IS NOT NULL GROUP BY domain)""")
def sample_size_gate(spark, d):
    """Whether the requested number of rows is reached in each stratum; the sum of what there is has to be at least one stratum's."""
    t = read(spark, d, "documents").where("domain is not null").select("domain")
    G.at_least(t, 40, "documents")
    return t.groupBy("domain").agg(F.count("*").alias("have")).select("domain", F.lit(40).cast("long").alias("wanted"), F.least("have", F.lit(40)).cast("long").alias("got"), (F.col("have") >= 40).alias("reached"))


@query("""SELECT year, count(*) AS n FROM clips WHERE year >= 2015 GROUP BY year""")
def clips_of_years(spark, d):
    """Clips of given years; none at all would end the job."""
    return G.some_of(read(spark, d, "clips").select("year"), F.col("year") >= 2015, "clips since 2015").groupBy("year").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT id, model, row_number() OVER (PARTITION BY model ORDER BY id, row_id) AS r FROM decodes)
SELECT DISTINCT model, id FROM r a WHERE r <= 3 AND EXISTS (SELECT 1 FROM r b WHERE b.model = a.model AND b.id = a.id AND b.r > 3)""")
def demo_overlap(spark, d):
    """Items that stand among the demonstrations and among the tests: the gate of the split."""
    from glasra.plans.corpus import demo_test_split

    s = demo_test_split(spark, d)
    return G.in_both(s.where("part = 'demo'"), s.where("part = 'test'"), ["model", "id"])


@query("""
WITH p AS (SELECT row_id, audio, duration_s FROM asr_pairs), u AS (SELECT DISTINCT ON (audio) audio, label, duration_s AS listed_s FROM aligned_setup WHERE audio IS NOT NULL ORDER BY audio, added_at, label, listed_s),
q AS (SELECT DISTINCT row_id, reference FROM decodes WHERE reference IS NOT NULL)
SELECT row_id, label, reference FROM p JOIN u USING (audio) JOIN q USING (row_id)""")
def utterances_joined(spark, d):
    """Utterances with their manifest row and their transcript: two inner joins, gated on repeated keys of the manifest."""
    m = read(spark, d, "aligned_setup").where("audio is not null").groupBy("audio").agg(F.min_by("label", F.struct("added_at", "label", F.coalesce("duration_s", F.lit(float("inf"))))).alias("label"))
    G.enforce(G.duplicates(m, ["audio"]), "manifest")
    t = read(spark, d, "decodes").where("reference is not null").select("row_id", "reference").distinct()
    return read(spark, d, "asr_pairs").select("row_id", "audio").join(m, "audio").join(t, "row_id").select("row_id", "label", "reference")


@query("""
WITH s AS (SELECT id, lang, max(reference) AS reference FROM decodes WHERE lang IN ('ga', 'en') AND reference IS NOT NULL GROUP BY id, lang), u AS (SELECT row_id AS id, lang, max(length(hyp)) AS n_chars FROM asr_pairs WHERE lang IN ('ga', 'en') AND hyp IS NOT NULL GROUP BY row_id, lang)
SELECT id, lang, reference, n_chars FROM s JOIN u USING (id, lang)""")
def sentences_with_outputs(spark, d):
    """Sentences and outputs joined on (id, language)."""
    both = F.col("lang").isin("ga", "en")
    s = read(spark, d, "decodes").where(both & F.col("reference").isNotNull()).groupBy(F.col("id").cast("long").alias("id"), "lang").agg(F.max("reference").alias("reference"))
    u = read(spark, d, "asr_pairs").where(both & F.col("hyp").isNotNull()).groupBy(F.col("row_id").alias("id"), "lang").agg(F.max(F.length("hyp")).cast("long").alias("n_chars"))
    return s.join(u, ["id", "lang"]).select(F.col("id").cast("int").alias("id"), "lang", "reference", "n_chars")


@query("""
SELECT row_id, round(avg(l), 6) AS mean_logprob, count(*) AS n_tokens FROM (
 SELECT row_id, unnest(list_transform(range(0, least(generated_tokens, 50)), lambda i: mean_logprob * (1 + ((i * 7) % 11 - 5) / 10.0::DOUBLE))) AS l FROM (SELECT DISTINCT ON (row_id) * FROM decodes WHERE mean_logprob IS NOT NULL AND generated_tokens > 0 ORDER BY row_id, decoded_at, mean_logprob, generated_tokens)) GROUP BY row_id""")
def token_logprobs(spark, d):
    """Mean log-probability of a decode from those of its tokens, which are made up here around the stored mean."""
    t = read(spark, d, "decodes").where("mean_logprob is not null and generated_tokens > 0").groupBy("row_id").agg(F.min_by(F.struct("mean_logprob", "generated_tokens"), F.struct("decoded_at", "mean_logprob", "generated_tokens")).alias("r"))
    each = F.transform(F.sequence(F.lit(0), F.least(F.col("r.generated_tokens"), F.lit(50)) - 1), lambda i: F.col("r.mean_logprob") * (1 + ((i * 7) % 11 - 5) / F.lit(10.0)))
    t = t.select("row_id", each.alias("logprobs"))
    mean = F.aggregate("logprobs", F.lit(0.0), lambda s, x: s + x) / F.size("logprobs")
    return t.select("row_id", F.round(mean, 6).alias("mean_logprob"), F.size("logprobs").cast("long").alias("n_tokens"))


@query("SELECT packet_id, json_extract_string(answers::JSON, '$.just_audio') AS just_audio, json_extract_string(answers::JSON, '$.no_context') AS no_context, len(json_keys(answers::JSON))::INT AS n_keys, model FROM packets")
def nested_values(spark, d):
    """Nested columns as JSON text beside plain ones, and what can be taken from it again."""
    t = R.nested_as_json(read(spark, d, "packets").select("packet_id", "answers", "model"))
    part = lambda k: F.get_json_object("answers", f"$.{k}")
    return t.select("packet_id", part("just_audio").alias("just_audio"), part("no_context").alias("no_context"), F.size(F.json_object_keys("answers")).alias("n_keys"), "model")


@query("SELECT row_id, object FROM (SELECT DISTINCT row_id, o AS object, CASE WHEN o = 'ref' THEN ref ELSE hyp END AS t FROM asr_pairs, (VALUES ('ref'), ('hyp')) AS v(o)) GROUP BY row_id, object HAVING count(t) = 0")
def missing_objects(spark, d):
    """The gate of the unpivot: (key, object) that no row has a text for."""
    p = read(spark, d, "asr_pairs").select("row_id", "ref", "hyp").unpivot(["row_id"], ["ref", "hyp"], "object", "text")
    return G.without_partner(p.select("row_id", "object").distinct(), p.where("text is not null").select("row_id", "object"), ["row_id", "object"])


@query("""
WITH s AS (SELECT model, condition, id, round(avg(unique_token_ratio), 9) AS score FROM decodes WHERE NOT isnan(unique_token_ratio) GROUP BY ALL)
SELECT model, condition, max(score) AS best, arg_min(id, (-score, id)) AS best_id FROM s GROUP BY model, condition""")
def best_of_cells(spark, d):
    """The best item of each model and condition, the first on ties; scores that are no number don't count."""
    t = read(spark, d, "decodes").where(~F.isnan("unique_token_ratio")).groupBy("model", "condition", "id").agg(F.round(F.avg("unique_token_ratio"), 9).alias("score"))
    return t.groupBy("model", "condition").agg(F.max("score").alias("best"), F.max_by("id", F.struct("score", -F.col("id"))).alias("best_id"))
