"""Queries of filters, text functions, rubrics and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import rubrics as R
from textloom.functions import text as T
from textloom.functions.metrics import repeats_itself
from textloom.operators.report import at_least, most_common
from textloom.plans.registry import Tables, query
from textloom.session import spread

_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _words(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, '[^{_WS[1:-1]}]+')), 0)"


def _any(x: str, bank: tuple[str, ...]) -> str:
    return "coalesce(" + " OR ".join(f"contains(lower({x}), '{w.replace(chr(39), chr(39) * 2)}')" for w in bank) + ", false)"


def _count(x: str, bank: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(lower({x}), '{w}')::int" for w in bank) + ")"


def _stops(x: str, chars: str) -> str:
    return f"len(regexp_replace({x}, '[^{chars}]', '', 'g'))"


@query(f"SELECT caption_id, length({_strip('blv_description')}) AS stripped FROM all_captions WHERE length({_strip('blv_description')}) > 30")
def o_flt_1(t: Tables) -> DataFrame:
    s = T.py_strip("blv_description")
    return t.all_captions.where(F.length(s) > 30).select("caption_id", F.length(s).alias("stripped"))


@query(f"SELECT doc_id FROM documents WHERE {_strip('text')} <> ''")
def o_flt_2(t: Tables) -> DataFrame:
    return t.documents.where(T.py_strip("text") != "").select("doc_id")


@query(f"SELECT caption_id, coalesce(length({_strip('blv_description')}) >= 30 AND {_any('blv_description', R.VALID_SPATIAL)}, false) AS valid_chosen, coalesce(length({_strip('original_caption')}) >= 3 AND NOT (starts_with({_strip('original_caption')}, 'c0') AND length({_strip('original_caption')}) < 10), false) AS valid_rejected FROM all_captions")
def o_flt_3_4(t: Tables) -> DataFrame:
    return t.all_captions.select("caption_id", R.valid_chosen("blv_description").alias("valid_chosen"), R.valid_rejected("original_caption").alias("valid_rejected"))


@query(f"SELECT caption_id, CASE WHEN {_words('blv_description')} < 15 THEN '{R.TOO_SHORT}' WHEN {_words('blv_description')} > 300 THEN '{R.TOO_LONG}' END AS flag FROM all_captions")
def o_flt_9(t: Tables) -> DataFrame:
    return t.all_captions.select("caption_id", R.length_flag("blv_description").alias("flag"))


@query(f"SELECT output_id, generated = '' OR starts_with(generated, '[') AS bracket, starts_with(generated, '[ERROR') AS error, {_strip('generated')} = '' AS blank, coalesce(reference = '' OR generated = '', true) AS missing FROM sft_patch_v2_outputs")
def o_flt_11(t: Tables) -> DataFrame:
    g = F.col("generated")
    return t.sft_patch_v2_outputs.select("output_id", ((g == "") | g.startswith("[")).alias("bracket"), g.startswith("[ERROR").alias("error"), (T.py_strip(g) == "").alias("blank"), F.coalesce((F.col("reference") == "") | (g == ""), F.lit(True)).alias("missing"))


@query("SELECT caption_id, coalesce(nullif(blv_description, ''), original_caption) AS caption, coalesce(rag_context, '') AS context, lower(dataset) AS dataset, regexp_replace(" + _strip("video_id") + ", '\\.0$', '') AS video FROM all_captions")
def o_prj_1_2(t: Tables) -> DataFrame:
    return t.all_captions.select("caption_id", T.falsy("blv_description", "original_caption").alias("caption"), F.coalesce("rag_context", F.lit("")).alias("context"), F.lower("dataset").alias("dataset"), T.video_id("video_id").alias("video"))


@query("SELECT caption_id, len(keyframe_paths[1:4]) AS first4, keyframe_paths[1] AS head, left(blv_description, 120) AS preview FROM all_captions")
def o_prj_6_7(t: Tables) -> DataFrame:
    return t.all_captions.select("caption_id", F.when(F.col("keyframe_paths").isNotNull(), F.size(F.slice("keyframe_paths", 1, 4))).cast("bigint").alias("first4"), F.try_element_at("keyframe_paths", F.lit(1)).alias("head"), F.substring("blv_description", 1, 120).alias("preview"))


@query(f"SELECT doc_id, {_words('text')} AS words, {_stops('text', '.')} AS stops, {_stops('text', '.!?')} AS ends, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: {_strip('s')} <> '')) AS sentences, len(list_filter(string_split(text, '.'), lambda s: length({_strip('s')}) > 10)) AS parts FROM documents")
def o_txt_1_2_3(t: Tables) -> DataFrame:
    c = F.col("text")
    size = lambda a: F.when(c.isNotNull(), F.size(a)).cast("bigint")
    return t.documents.select("doc_id", T.word_count("text").cast("bigint").alias("words"), F.regexp_count(c, F.lit(r"\.")).cast("bigint").alias("stops"), F.regexp_count(c, F.lit("[.!?]")).cast("bigint").alias("ends"), size(T.regex_sentences("text")).alias("sentences"), size(T.sentences("text", 10)).alias("parts"))


@query(f"SELECT doc_id, {_strip(chr(39) + chr(39) + ' || string_split(text, ' + chr(39) + 'Assistant:' + chr(39) + ')[-1]')} AS answer, string_split(text, '.')[1] AS first_sentence FROM documents")
def o_txt_4_5(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.after_last("text", "Assistant:").alias("answer"), T.first_sentence("text").alias("first_sentence"))


_NORMAL = _strip(f"regexp_replace({_strip('lower(text)')}, '[^\\p{{L}}\\p{{N}}_{_WS[1:-1]}]', '', 'g')")


@query(f"SELECT doc_id, {_NORMAL} AS normal FROM documents")
def o_txt_7(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.normalized_answer("text").alias("normal"))


@query(
    "SELECT condition, count(*) AS n, "
    + ", ".join(f"round(avg(({_any('generated', bank)})::int), 6) AS {name}" for name, bank in (R.CONTEXT_BANKS | R.NAVIGATION_BANKS).items())
    + " FROM sft_patch_v2_outputs GROUP BY condition"
)
def o_kw_1_2_3(t: Tables) -> DataFrame:
    dims = {name: T.has_any("generated", bank) for name, bank in (R.CONTEXT_BANKS | R.NAVIGATION_BANKS).items()}
    return t.sft_patch_v2_outputs.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(v), 6).alias(k) for k, v in dims.items()])


@query(
    "SELECT lower(dataset) AS dataset, count(*) AS n, "
    + ", ".join(f"round(100 * avg(coalesce(regexp_matches(blv_description, '(?i)(?:{'|'.join(p)})'), false)::int), 1) AS {name}" for name, p in R.COVERAGE.items())
    + " FROM all_captions GROUP BY 1"
)
def o_kw_4(t: Tables) -> DataFrame:
    return spread(t.all_captions.select("dataset", "blv_description")).groupBy(F.lower("dataset").alias("dataset")).agg(F.count(F.lit(1)).alias("n"), *[F.round(100 * F.avg(hit.cast("int")), 1).alias(name) for name, hit in R.coverage("blv_description").items()])


@query(f"SELECT condition, round(avg(coalesce(contains(upper(generated), 'CAUTION'), false)::int), 6) AS caution, round(avg(len(regexp_extract_all(generated, '(?i)\\b(left|right|center|ahead|behind)\\b'))), 6) AS directions, round(avg(regexp_matches(generated, '(?i)[0-9]+(\\.[0-9]+)?[\\t\\n\\x0B\\f\\r ]*meter')::int), 6) AS distances, round(avg(len(list_filter(regexp_split_to_array(generated, '[.!?]+'), lambda s: {_strip('s')} <> ''))), 6) AS sentences FROM sft_patch_v2_outputs GROUP BY condition")
def o_kw_5(t: Tables) -> DataFrame:
    g = F.col("generated")
    return t.sft_patch_v2_outputs.groupBy("condition").agg(F.round(F.avg(F.coalesce(F.contains(F.upper(g), F.lit("CAUTION")), F.lit(False)).cast("int")), 6).alias("caution"), F.round(F.avg(F.regexp_count(g, F.lit(r"(?i)\b(left|right|center|ahead|behind)\b"))), 6).alias("directions"), F.round(F.avg(g.rlike(r"(?i)\d+(\.\d+)?\s*meter").cast("int")), 6).alias("distances"), F.round(F.avg(F.when(g.isNotNull(), F.size(T.regex_sentences(g)))), 6).alias("sentences"))


def _score_1(x: str) -> str:
    return f"(CASE WHEN {_any(x, R.ROOMS_1)} THEN 20 ELSE 0 END + least(20, 5 * {_count(x, R.SPATIAL_1)}) + CASE WHEN regexp_matches(lower({x}), '[0-9]+[\\t\\n\\x0B\\f\\r ]*(meter|feet|foot|cm|step)') THEN 20 WHEN {_any(x, R.HEIGHTS_1)} THEN 10 ELSE 0 END + CASE WHEN {_any(x, R.HAZARDS_1)} THEN 20 ELSE 0 END + CASE WHEN {_stops(x, '.')} BETWEEN 2 AND 4 AND {_words(x)} <= 80 THEN 20 ELSE 0 END)"


@query(f"SELECT caption_id, {_score_1('blv_description')} AS score FROM all_captions WHERE blv_description IS NOT NULL")
def o_kw_6(t: Tables) -> DataFrame:
    return t.all_captions.where("blv_description is not null").select("caption_id", R.curation_score_1("blv_description").alias("score"))


@query(f"SELECT caption_id, (CASE WHEN {_any('blv_description', R.ROOMS_2)} THEN 20 ELSE 0 END + least(20, 4 * {_count('blv_description', R.SPATIAL_2)}) + CASE WHEN regexp_matches(lower(blv_description), '[0-9]+[\\t\\n\\x0B\\f\\r ]*(meter|feet|foot|inch|cm|step)') THEN 20 WHEN {_any('blv_description', R.HEIGHTS_2)} THEN 10 ELSE 0 END + CASE WHEN {_any('blv_description', R.HAZARDS_2)} THEN 20 ELSE 0 END + CASE WHEN {_stops('blv_description', '.!?')} BETWEEN 2 AND 5 AND {_words('blv_description')} <= 100 THEN 20 WHEN {_stops('blv_description', '.!?')} <= 8 AND {_words('blv_description')} <= 160 THEN 10 ELSE 0 END) AS score FROM all_captions WHERE blv_description IS NOT NULL")
def o_kw_7(t: Tables) -> DataFrame:
    return t.all_captions.where("blv_description is not null").select("caption_id", R.curation_score_2("blv_description").alias("score"))


@query(f"SELECT ge_90, ge_80, ge_70, ge_60, ge_50, least, most FROM (SELECT {', '.join(f'count(*) FILTER (s >= {k}) AS ge_{k}' for k in (90, 80, 70, 60, 50))}, min(s) AS least, max(s) AS most FROM (SELECT {_score_1('blv_description')} AS s FROM all_captions WHERE blv_description IS NOT NULL))")
def o_agg_10(t: Tables) -> DataFrame:
    return at_least(o_kw_6(t), "score")


_R_GEN = "coalesce(generated, '')"
_R_REF = "coalesce(reference, '')"
_R_PARTS = f"len(list_filter(string_split({_R_GEN}, '.'), lambda s: {_strip('s')} <> ''))"


@query(f"""SELECT output_id, round(CASE WHEN contains(upper({_R_REF}), 'CAUTION') AND contains(upper({_R_GEN}), 'CAUTION') THEN 0.4 WHEN contains(upper({_R_REF}), 'CAUTION') THEN -0.3 WHEN contains(upper({_R_GEN}), 'CAUTION') THEN -0.1 ELSE 0 END
 + least(0.08 * {_count(_R_GEN, R.REWARD_DIRECTIONS)}, 0.24) + CASE WHEN regexp_matches(lower({_R_GEN}), '[0-9]+(\\.[0-9]+)?[\\t\\n\\x0B\\f\\r ]*(meter|metre)') THEN 0.2 ELSE 0 END
 + CASE WHEN {_R_PARTS} BETWEEN 2 AND 4 THEN 0.16 WHEN {_R_PARTS} > 6 THEN -0.1 ELSE 0 END - CASE WHEN {_any(_R_GEN, R.REWARD_PHRASES)} THEN 0.2 ELSE 0 END
 + CASE WHEN {_any(f"string_split({_R_GEN}, '.')[1]", R.REWARD_PLACES)} THEN 0.1 ELSE 0 END, 4)::double AS reward FROM sft_patch_v2_outputs""")
def o_kw_8(t: Tables) -> DataFrame:
    return t.sft_patch_v2_outputs.select("output_id", F.round(R.reward("generated", "reference"), 4).alias("reward"))


_HITS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(blv_description), '{w}') THEN '{w}' END" for w in R.INVENTED) + "], lambda x: x IS NOT NULL)"
_RULES = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(blv_description), '{p}') THEN '{m}' END" for p, m in R.GUIDELINES) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT caption_id, array_to_string({_HITS}, '|') AS invented, array_to_string({_RULES}, '|') AS violations FROM all_captions WHERE blv_description IS NOT NULL")
def o_kw_9_10(t: Tables) -> DataFrame:
    rules = F.array_compact(F.array(*[F.when(F.lower("blv_description").rlike(p), m) for p, m in R.GUIDELINES]))
    return t.all_captions.where("blv_description is not null").select("caption_id", F.array_join(T.hits("blv_description", R.INVENTED), "|").alias("invented"), F.array_join(rules, "|").alias("violations"))


def flagged(t: Tables) -> DataFrame:
    scored = spread(t.all_captions.where("blv_description is not null").select("caption_id", "blv_description")).withColumn("blv_score", R.curation_score_1("blv_description"))
    return scored.withColumn("flags", R.flags("blv_description", "blv_score", repeated=repeats_itself(T.sentences("blv_description", 10))))


@query()
def o_flg_1(t: Tables) -> DataFrame:
    return flagged(t).select("caption_id", "blv_score", F.array_join("flags", "|").alias("flags"), (F.size("flags") == 0).alias("is_clean"))


@query()
def o_kw_11(t: Tables) -> DataFrame:
    return spread(t.all_captions.where("blv_description is not null").select("caption_id", "blv_description")).select("caption_id", repeats_itself(T.sentences("blv_description", 10)).alias("repeats"))


@query()
def o_agg_9(t: Tables) -> DataFrame:
    return most_common(flagged(t), "flags", "caption_id")


@query(f"""WITH s AS (SELECT caption_id, list_filter([CASE WHEN {_words('blv_description')} < 15 THEN '{R.TOO_SHORT}' WHEN {_words('blv_description')} > 300 THEN '{R.TOO_LONG}' END] || [CASE WHEN {_score_1('blv_description')} < 40 THEN 'Low BLV score: ' || {_score_1('blv_description')} END] || [CASE WHEN len({_HITS}) > 0 THEN 'Hallucination phrases: ' || array_to_string({_HITS}, ', ') END] || {_RULES}, lambda x: x IS NOT NULL) AS flags FROM all_captions WHERE blv_description IS NOT NULL)
SELECT count(*) AS total, count(*) FILTER (len(flags) = 0) AS kept, count(*) FILTER (len(flags) > 0) AS rejected, round(100.0 * count(*) FILTER (len(flags) = 0) / count(*), 4) AS kept_pct FROM s""")
def o_agg_1(t: Tables) -> DataFrame:
    df = t.all_captions.where("blv_description is not null").withColumn("s", R.curation_score_1("blv_description"))
    clean = F.size(R.flags("blv_description", "s")) == 0
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(clean).alias("kept"), F.count_if(~clean).alias("rejected"), F.round(100.0 * F.count_if(clean) / F.count(F.lit(1)), 4).alias("kept_pct"))


@query("SELECT caption_id FROM all_captions WHERE keyframe_paths IS NOT NULL")
def o_flt_6(t: Tables) -> DataFrame:
    """Records that have the key."""
    return t.all_captions.where("keyframe_paths is not null").select("caption_id")


# Ids that are left out, and ids that alone are kept, as static sets.
LEFT_OUT, KEPT = (1, 5, 25, 125), (2, 3, 5, 7, 11)


@query(f"SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey NOT IN {LEFT_OUT} AND n_nationkey IN {KEPT}")
def o_flt_13(t: Tables) -> DataFrame:
    return t.customer.where(~F.col("c_custkey").isin(*LEFT_OUT)).join(t.nation.where(F.col("n_nationkey").isin(*KEPT)), F.expr("c_nationkey = n_nationkey")).select("c_custkey")


@query(f"SELECT caption_id, {_strip('original_caption')} AS reasoning, {_strip('blv_description')} AS whole FROM all_captions WHERE original_caption IS NOT NULL AND blv_description IS NOT NULL AND NOT contains(original_caption, '<') AND NOT contains(blv_description, '<')")
def o_txt_6(t: Tables) -> DataFrame:
    """What stands in a tag, over lines; without the tag the whole text."""
    rows = t.all_captions.where("original_caption is not null and blv_description is not null and not contains(original_caption, '<') and not contains(blv_description, '<')")
    tagged = rows.withColumn("x", F.concat(F.lit("<reasoning>\n"), "original_caption", F.lit(" </reasoning>"), "blv_description"))
    return tagged.select("caption_id", T.tagged("x", "reasoning").alias("reasoning"), T.tagged("blv_description", "description", whole=True).alias("whole"))


@query("SELECT output_id, 'Reference: ' || coalesce(reference, '') || chr(10) || 'Answer ' || output_id || ': ' || coalesce(generated, '') || ' {end}' AS prompt FROM sft_patch_v2_outputs")
def o_txt_9(t: Tables) -> DataFrame:
    prompt = T.template("Reference: {reference}\nAnswer {n}: {generated} ", reference="reference", n="output_id", generated="generated")
    return t.sft_patch_v2_outputs.select("output_id", F.concat(prompt, F.lit("{end}")).alias("prompt"))


_FENCED = "chr(96) || chr(96) || chr(96)"


@query(f"SELECT rec_id, {_strip('scores')} AS body FROM sft_patch_v2_judge_scores WHERE scores IS NOT NULL AND NOT contains(scores, {_FENCED})")
def o_txt_11(t: Tables) -> DataFrame:
    """A fenced JSON block and a bare one give the same text."""
    rows = t.sft_patch_v2_judge_scores.where("scores is not null and not contains(scores, '```')")
    fenced = F.when(F.col("rec_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), "scores", F.lit("\n``` done"))).otherwise(F.col("scores"))
    return rows.select("rec_id", T.unfenced(fenced).alias("body"))


@query("SELECT train_id, 'v' || printf('%09d', train_id) || '_kf' || printf('%02d', train_id % 300) AS name FROM balanced_train")
def o_txt_12(t: Tables) -> DataFrame:
    return t.balanced_train.select("train_id", F.concat(F.lit("v"), T.zero_padded("train_id", 9), F.lit("_kf"), T.zero_padded(F.col("train_id") % 300, 2)).alias("name"))


@query("SELECT rec_id, CASE WHEN starts_with(ltrim(overall), '[') THEN json_extract_string(overall, '$[0]') ELSE overall END AS value FROM gt_scores_c WHERE overall IS NOT NULL AND json_valid(overall)")
def o_arr_8(t: Tables) -> DataFrame:
    """The first element where a field holds a list, else the scalar."""
    return t.gt_scores_c.where("overall is not null and try_parse_json(overall) is not null").select("rec_id", T.first_or_scalar("overall").alias("value"))


_BANKS, _GEN = (R.CONTEXT_BANKS, R.NAVIGATION_BANKS), "generated"
_MEANS = [f"({' + '.join(f'({_any(_GEN, bank)})::int' for bank in banks.values())}) / {float(len(banks))}" for banks in _BANKS]


@query(f"SELECT condition, round(avg({_MEANS[0]}), 6) AS blv_mean, round(avg({_MEANS[1]}), 6) AS nav_mean FROM sft_patch_v2_outputs GROUP BY condition")
def o_kw_3(t: Tables) -> DataFrame:
    """The means of the presence scores of each text, averaged by condition."""
    blv, nav = (R.presence("generated", banks)["mean"] for banks in _BANKS)
    return t.sft_patch_v2_outputs.groupBy("condition").agg(F.round(F.avg(blv), 6).alias("blv_mean"), F.round(F.avg(nav), 6).alias("nav_mean"))


@query("SELECT event_id, CASE WHEN value >= 90 THEN 'high' WHEN value >= 50 THEN 'mid' ELSE 'low' END AS band, CASE WHEN value / 10 < 1 THEN 'overfit' WHEN value / 10 BETWEEN 2 AND 4 THEN 'go' WHEN value / 10 > 4 AND value / 10 <= 8 THEN 'weak' WHEN value / 10 > 8 THEN 'stop' END AS verdict FROM events")
def o_kw_14_15(t: Tables) -> DataFrame:
    return t.events.select("event_id", R.band("value").alias("band"), R.loss_verdict(F.col("value") / 10).alias("verdict"))


@query(
    "SELECT lower(dataset) AS dataset, count(*) AS n, "
    + ", ".join(f"count(*) FILTER (coalesce(regexp_matches(blv_description, '(?i)(?:{'|'.join(p)})'), false)) AS n_{name}, round(100 * avg(coalesce(regexp_matches(blv_description, '(?i)(?:{'|'.join(p)})'), false)::int), 1) AS pct_{name}" for name, p in R.COVERAGE.items())
    + " FROM all_captions GROUP BY 1"
)
def o_agg_11(t: Tables) -> DataFrame:
    """Coverage by metric: raw counts and percentages."""
    hits = R.coverage("blv_description")
    return t.all_captions.groupBy(F.lower("dataset").alias("dataset")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(h).alias(f"n_{k}") for k, h in hits.items()], *[F.round(100 * F.avg(h.cast("int")), 1).alias(f"pct_{k}") for k, h in hits.items()])


@query(f"""WITH s AS (SELECT caption_id, {_score_1('blv_description')} AS score, list_filter([CASE WHEN {_words('blv_description')} < 15 THEN '{R.TOO_SHORT}' WHEN {_words('blv_description')} > 300 THEN '{R.TOO_LONG}' END] || [CASE WHEN {_score_1('blv_description')} < 40 THEN 'Low BLV score: ' || {_score_1('blv_description')} END] || [CASE WHEN len({_HITS}) > 0 THEN 'Hallucination phrases: ' || array_to_string({_HITS}, ', ') END] || {_RULES}, lambda x: x IS NOT NULL) AS flags FROM all_captions WHERE blv_description IS NOT NULL)
SELECT caption_id, score AS blv_score, array_to_string(flags, '|') AS flags, len(flags) = 0 AS is_clean FROM s""")
def o_flg_1_sql(t: Tables) -> DataFrame:
    """The checks of o_flg_1 that SQL can express, without that of repeated sentences; the helper column is dropped."""
    rows = t.all_captions.where("blv_description is not null").withColumn("blv_score", R.curation_score_1("blv_description"))
    out = rows.withColumn("_f", R.flags("blv_description", "blv_score"))
    return out.select("caption_id", "blv_score", F.array_join("_f", "|").alias("flags"), (F.size("_f") == 0).alias("is_clean"))
