"""Queries of text metrics, judge scores, report tables, ordered analytics and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import metrics as M
from textloom.functions import text as T
from textloom.operators import judge as J
from textloom.operators import report as R
from textloom.operators import windows as W
from textloom.plans.registry import Tables, query
from textloom.session import spread, step_path
from textloom.streaming import incremental as I

_TOK = "list_filter(regexp_split_to_array({}, '[\\t\\n\\x0B\\f\\r \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda x: x <> '')"


def _grams(col: str, n: int) -> str:
    return f"CASE WHEN len({col}) >= {n} THEN list_transform(range(1, len({col}) - {n - 2}), lambda i: array_to_string({col}[i:i + {n - 1}], ' ')) ELSE [] END"


def _outputs(t: Tables) -> DataFrame:
    return spread(t.sft_patch_v2_outputs.select("output_id", "condition", "video_id", "reference", "generated").where("reference <> '' and generated <> '' and not startswith(generated, '[')"))


_OUTPUTS = "SELECT * FROM sft_patch_v2_outputs WHERE reference <> '' AND generated <> '' AND NOT starts_with(generated, '[')"
_ROWS = f"o AS (SELECT condition, output_id, {_TOK.format('lower(generated)')} AS h, {_TOK.format('lower(reference)')} AS r FROM ({_OUTPUTS}))"


def _counted(rows: str) -> str:
    return (
        f"WITH {rows}, e AS ("
        + " UNION ALL ".join(f"SELECT condition, output_id, {n} AS n, unnest({_grams(c, n)}) AS gram, {int(c == 'h')} AS ours, {int(c == 'r')} AS theirs FROM o" for n in range(1, 5) for c in "hr")
        + "), c AS (SELECT condition, output_id, n, gram, sum(ours) AS ours, sum(theirs) AS theirs FROM e GROUP BY ALL), s AS (SELECT condition, n, sum(least(ours, theirs)) AS correct, sum(ours) AS guess, sum(theirs) AS reference FROM c GROUP BY ALL)"
    )


_COUNTED = _counted(_ROWS)


@query(_COUNTED + " SELECT condition, n, correct::bigint AS correct, guess::bigint AS guess, reference::bigint AS reference FROM s")
def o_agg_13(t: Tables) -> DataFrame:
    return M.ngram_matches(_outputs(t), "generated", "reference", group=("condition",))


_WIDE = ", w AS (SELECT condition, " + ", ".join(f"max({c}) FILTER (n = {n})::double AS {c}{n}" for n in range(1, 5) for c in ("correct", "guess")) + ", max(reference) FILTER (n = 1)::double AS ref FROM s GROUP BY condition), b AS (SELECT *, CASE WHEN guess1 > ref THEN 1.0 ELSE exp(1 - ref / guess1) END AS bp FROM w)"


@query(_COUNTED + _WIDE + " SELECT condition, round(100 * bp * correct1 / guess1, 6) AS bleu1, round(100 * bp * pow(correct1 / guess1 * correct2 / guess2 * correct3 / guess3 * correct4 / guess4, 0.25), 6) AS bleu4 FROM b")
def o_met_1(t: Tables) -> DataFrame:
    out = M.bleu(o_agg_13(t), ("condition",))
    return out.select("condition", F.round("bleu1", 6).alias("bleu1"), F.round("bleu4", 6).alias("bleu4"))


_SMOOTH = " SELECT condition, round(100 * bp * p1, 6) AS bleu1, round(100 * bp * pow(p1 * p2 * p3 * p4, 0.25), 6) AS bleu4 FROM (SELECT condition, bp, " + ", ".join(
    f"CASE WHEN correct{n} > 0 THEN correct{n} / guess{n} ELSE pow(2, -(" + " + ".join(f"(correct{k} = 0)::int" for k in range(1, n + 1)) + f")) / guess{n} END AS p{n}" for n in range(1, 5)
) + " FROM b)"
_STEPS_13A = (("<skipped>", ""), ("-\\n", ""), ("\\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("^|$", " "), (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), ("([0-9])(-)", r"\1 \2 "))


def _sql_13a(c: str) -> str:
    for pattern, into in _STEPS_13A:
        c = f"regexp_replace({c}, '{pattern}', '{into}', 'g')"
    return c


_ROWS_13A = f"o AS (SELECT condition, output_id, {_TOK.format(_sql_13a('generated'))} AS h, {_TOK.format(_sql_13a('reference'))} AS r FROM ({_OUTPUTS}))"


@query(_counted(_ROWS_13A) + _WIDE + _SMOOTH)
def o_met_1a(t: Tables) -> DataFrame:
    """Corpus BLEU on 13a tokens with exponential smoothing."""
    out = M.bleu(M.ngram_matches(_outputs(t), "generated", "reference", ("condition",), "13a"), ("condition",), "exp")
    return out.select("condition", F.round("bleu1", 6).alias("bleu1"), F.round("bleu4", 6).alias("bleu4"))


@query(_COUNTED + _WIDE + _SMOOTH)
def o_met_1b(t: Tables) -> DataFrame:
    """Corpus BLEU on lower-case white-space tokens with smoothing method 3."""
    out = M.bleu(o_agg_13(t), ("condition",), "exp")
    return out.select("condition", F.round("bleu1", 6).alias("bleu1"), F.round("bleu4", 6).alias("bleu4"))


@query(
    f"WITH {_ROWS}, e AS (" + " UNION ALL ".join(f"SELECT output_id, {n} AS n, unnest({_grams(c, n)}) AS gram, {int(c == 'h')} AS ours, {int(c == 'r')} AS theirs FROM o" for n in range(1, 5) for c in "hr") + """),
c AS (SELECT output_id, n, gram, sum(ours) AS ours, sum(theirs) AS theirs FROM e GROUP BY ALL), d AS (SELECT gram, n, count(*) AS df FROM c WHERE theirs > 0 GROUP BY gram, n),
x AS (SELECT c.*, ln((SELECT count(*) FROM o)) - ln(greatest(coalesce(df, 1), 1)) AS idf FROM c LEFT JOIN d USING (gram, n)),
p AS (SELECT output_id, n, sum(least(ours * idf, theirs * idf) * theirs * idf) AS dot, sqrt(sum(pow(ours * idf, 2))) AS h, sqrt(sum(pow(theirs * idf, 2))) AS r, sum(ours - theirs) AS longer FROM x GROUP BY ALL),
s AS (SELECT output_id, sum(CASE WHEN h * r > 0 THEN dot / (h * r) ELSE 0 END) / 4 * exp(-pow(coalesce(max(longer) FILTER (n = 2), 0), 2) / 72) * 10 AS cider FROM p GROUP BY output_id)
SELECT output_id, round(coalesce(cider, 0), 5) AS cider FROM o LEFT JOIN s USING (output_id)"""
)
def o_met_4b(t: Tables) -> DataFrame:
    return M.cider(_outputs(t), "output_id", "generated", "reference").withColumn("cider", F.round("cider", 5))


@query()
def o_met_2(t: Tables) -> DataFrame:
    return _outputs(t).select("output_id", F.round(M.rouge_l("reference", "generated"), 6).alias("rouge_l"), F.round(M.rouge_l("reference", "generated", 1.2), 6).alias("rouge_l_beta"))


@query()
def o_met_3(t: Tables) -> DataFrame:
    return _outputs(t).select("output_id", F.round(M.meteor("reference", "generated"), 6).alias("meteor"), F.round(M.meteor("reference", "generated", lower=False), 6).alias("meteor_cased"))


@query(f"""WITH {_ROWS}, e AS (SELECT output_id, unnest({_grams('h', 4)}) AS gram, 1 AS ours, 0 AS theirs FROM o UNION ALL SELECT output_id, unnest({_grams('r', 4)}), 0, 1 FROM o),
c AS (SELECT output_id, gram, sum(ours) AS ours, sum(theirs) AS theirs FROM e GROUP BY ALL), d AS (SELECT gram, count(*) AS df FROM c WHERE theirs > 0 GROUP BY gram),
x AS (SELECT c.*, ln(((SELECT count(*) FROM o) + 1) / (coalesce(df, 0) + 1)) AS idf FROM c LEFT JOIN d USING (gram)),
s AS (SELECT output_id, sum(ours * theirs * idf * idf) AS dot, sum(pow(ours * idf, 2)) AS hh, sum(pow(theirs * idf, 2)) AS rr FROM x GROUP BY output_id)
SELECT output_id, round(coalesce(CASE WHEN hh * rr > 0 THEN dot / sqrt(hh * rr) END, 0), 6) AS cosine FROM o LEFT JOIN s USING (output_id)""")
def o_met_4(t: Tables) -> DataFrame:
    return M.tfidf_cosine(_outputs(t), "output_id", "generated", "reference").withColumn("cosine", F.round("cosine", 6))


_ASCII = "regexp_replace(coalesce({}, ''), '[^\\x00-\\x7F]', '?', 'g')"
_P, _G = (f"trim(regexp_replace(lower({_ASCII.format(c)}), '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g'))" for c in ("generated", "reference"))


@query(f"SELECT output_id, round(CASE WHEN g = '' THEN (p = '')::int::double WHEN nl > 0.5 THEN 0 ELSE 1 - nl END, 6) AS anls FROM (SELECT output_id, p, g, levenshtein(p, g) / greatest(length(p), length(g), 1) AS nl FROM (SELECT output_id, {_P} AS p, {_G} AS g FROM sft_patch_v2_outputs))")
def o_met_6(t: Tables) -> DataFrame:
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x00-\x7F]", "?")
    return t.sft_patch_v2_outputs.select("output_id", F.round(M.anls(plain("generated"), plain("reference")), 6).alias("anls"))


_WSC = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIPPED = lambda x: f"regexp_replace({x}, '^{_WSC}+|{_WSC}+$', '', 'g')"
_NORMAL = lambda x: _STRIPPED(f"regexp_replace({_STRIPPED(f'lower({x})')}, '[^\\p{{L}}\\p{{N}}_{_WSC[1:-1]}]', '', 'g')")
_TRUTHS = "SELECT video_id, list(DISTINCT reference) FILTER (reference IS NOT NULL) AS truths FROM sft_patch_v2_outputs GROUP BY video_id"


@query(f"SELECT output_id, round(least(1.0, len(list_filter(coalesce(truths, []), lambda t: {_NORMAL('t')} = {_NORMAL('generated')})) / 3), 6)::double AS accuracy FROM sft_patch_v2_outputs JOIN ({_TRUTHS}) USING (video_id) WHERE generated IS NOT NULL")
def o_met_8(t: Tables) -> DataFrame:
    """Answers: the generated texts of a video against all references of it."""
    rows = t.sft_patch_v2_outputs.select("output_id", "video_id", "reference", "generated")
    return M.vqa_accuracies(rows, "video_id", "generated", "reference").select("output_id", F.round("accuracy", 6).alias("accuracy"))


@query(f"SELECT output_id, round(max(CASE WHEN g = '' THEN (p = '')::int::double WHEN nl > 0.5 THEN 0 ELSE 1 - nl END), 6) AS anls FROM (SELECT output_id, p, g, levenshtein(p, g) / greatest(length(p), length(g), 1) AS nl FROM (SELECT output_id, {_P} AS p, unnest([{_G}, trim(lower(condition))]) AS g FROM sft_patch_v2_outputs)) GROUP BY output_id")
def o_met_7(t: Tables) -> DataFrame:
    """The best of several truths: the reference, and the name of the condition."""
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x00-\x7F]", "?")
    rows = t.sft_patch_v2_outputs.select("output_id", plain("generated").alias("p"), F.array(plain("reference"), F.col("condition")).alias("truths"))
    return rows.select("output_id", F.round(M.best_anls("p", "truths"), 6).alias("anls"))


@query()
def o_met_9(t: Tables) -> DataFrame:
    return _outputs(t).groupBy("condition").agg(F.round(100 * F.avg(M.wer("reference", "generated")), 4).alias("wer"))


_NUM = "trunc(try_cast(json_extract_string({0}, '$.{1}') AS double))::int"
_DIM = {d: "greatest(1, least(10, " + _NUM.format("scores", d) + "))" for d in J.DIMS}
_ALL = " AND ".join(f"try_cast(json_extract_string(scores, '$.{d}') AS double) IS NOT NULL" for d in J.DIMS)


@query(f"SELECT rec_id, {', '.join(f'CASE WHEN {_ALL} THEN {x} ELSE 0 END AS {d}' for d, x in _DIM.items())}, NOT coalesce({_ALL}, false) AS failed FROM sft_patch_v2_judge_scores")
def o_jsn_3_4_5_6(t: Tables) -> DataFrame:
    return J.scores(t.sft_patch_v2_judge_scores.select("rec_id", "scores"), "scores", nested=True).select("rec_id", *J.DIMS, "failed")


@query(f"SELECT count(*) AS all_rows, count(*) FILTER ({_ALL}) AS kept, count(*) FILTER (NOT coalesce({_ALL}, false)) AS failures, round(avg(CASE WHEN {_ALL} THEN {_DIM['clarity']} ELSE 0 END), 6) AS zero_filled, round(avg(CASE WHEN {_ALL} THEN {_DIM['clarity']} END), 6) AS skipped FROM sft_patch_v2_judge_scores")
def o_jsn_6(t: Tables) -> DataFrame:
    """The three policies for failed answers side by side."""
    rows = t.sft_patch_v2_judge_scores.select("rec_id", "scores")
    zero, skip, count = (J.scores(rows, "scores", on_error=p, nested=True) for p in ("zero", "skip", "count"))
    one = zero.agg(F.count(F.lit(1)).alias("all_rows"), F.round(F.avg("clarity"), 6).alias("zero_filled"))
    two = skip.agg(F.count(F.lit(1)).alias("kept"), F.round(F.avg("clarity"), 6).alias("skipped"))
    return one.join(two).join(count.agg(F.count_if("failed").alias("failures"))).select("all_rows", "kept", "failures", "zero_filled", "skipped")


@query(f"SELECT count(*) AS n, round(avg(clarity), 6) AS clarity FROM (SELECT {', '.join(f'CASE WHEN {_ALL} THEN {x} ELSE 0 END AS {d}' for d, x in _DIM.items())} FROM sft_patch_v2_judge_scores) WHERE " + " OR ".join(f"{d} > 0" for d in J.DIMS))
def o_flt_12(t: Tables) -> DataFrame:
    rows = J.without_failures(J.scores(t.sft_patch_v2_judge_scores, "scores", nested=True))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("clarity"), 6).alias("clarity"))


@query("SELECT rec_id FROM sft_patch_v2_judge_scores WHERE json_type(scores, '$.accuracy') IN ('BIGINT', 'UBIGINT', 'DOUBLE')")
def o_flt_14(t: Tables) -> DataFrame:
    """A type guard: records whose accuracy is a number, not a text that looks like one."""
    return t.sft_patch_v2_judge_scores.where(J.is_number("scores", "accuracy")).select("rec_id")


@query("SELECT doc_id, regexp_extract(text, '(?s)\\{[^}]+\\}') AS first, regexp_extract(text, '(?s)\\{.*\\}') AS outermost FROM documents WHERE contains(text, '{') AND contains(text, '}')")
def o_jsn_1_2(t: Tables) -> DataFrame:
    return t.documents.where("contains(text, '{') and contains(text, '}')").select("doc_id", F.coalesce(T.first_object("text"), F.lit("")).alias("first"), F.coalesce(T.outer_object("text"), F.lit("")).alias("outermost"))


_SCORED = f"(SELECT run_name, {', '.join(f'{x} AS {d}' for d, x in _DIM.items())} FROM sft_patch_v2_judge_scores)"


def _scored(t: Tables) -> DataFrame:
    m = t.sft_patch_v2_judge_scores.withColumn("_m", F.from_json("scores", "map<string,string>"))
    return m.select("run_name", *[J.clamped(J.as_int(F.try_element_at("_m", F.lit(d)))).alias(d) for d in dict.fromkeys((*J.DIMS, *J.NAVIGATION_DIMS["c"]))])


@query(f"SELECT run_name, count(*) AS n, {', '.join(f'round(avg({d}), 6) AS {d}' for d in J.DIMS)} FROM {_SCORED} GROUP BY run_name")
def o_agg_2_3(t: Tables) -> DataFrame:
    m = R.means(_scored(t), list(J.DIMS), "run_name")
    return m.select("run_name", "n", *[F.round(d, 6).alias(d) for d in J.DIMS])


@query(f"SELECT run_name, count(*) AS n, {', '.join(f'round(avg(coalesce({d}, 0)), 6) AS {d}' for d in J.DIMS)} FROM {_SCORED} GROUP BY run_name")
def o_agg_4_5(t: Tables) -> DataFrame:
    m = R.means(_scored(t), list(J.DIMS), "run_name", missing_as_zero=True)
    return m.select("run_name", "n", *[F.round(d, 6).alias(d) for d in J.DIMS])


@query(f"SELECT run_name, round(avg(({' + '.join(J.CONTEXT_DIMS)}) / 4), 6) AS mcf, round(avg(({' + '.join(J.NAVIGATION_DIMS['a'])}) / 4), 6) AS naf_a, round(avg(({' + '.join(J.NAVIGATION_DIMS['b'])}) / 4), 6) AS naf_b, round(avg(({' + '.join(f'greatest(1, least(10, ' + _NUM.format('scores', d) + '))' for d in J.NAVIGATION_DIMS['c'])}) / 4), 6) AS naf_c FROM sft_patch_v2_judge_scores, LATERAL (SELECT {', '.join(f'{x} AS {d}' for d, x in _DIM.items())}) GROUP BY run_name")
def o_agg_6_7(t: Tables) -> DataFrame:
    comp = {"mcf": J.CONTEXT_DIMS, "naf_a": J.NAVIGATION_DIMS["a"], "naf_b": J.NAVIGATION_DIMS["b"], "naf_c": J.NAVIGATION_DIMS["c"]}
    return _scored(t).groupBy("run_name").agg(*[F.round(F.avg(R.composite(list(d))), 6).alias(k) for k, d in comp.items()])


@query("SELECT lower(dataset) AS dataset, count(*) AS n FROM all_captions GROUP BY 1")
def o_agg_8(t: Tables) -> DataFrame:
    return t.all_captions.groupBy(F.lower("dataset").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(1000.0 / avg(value), 6) AS fps FROM events GROUP BY event_type")
def o_agg_12(t: Tables) -> DataFrame:
    r = R.latency(t.events, "value", "event_type")
    return r.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean_ms", "p95_ms", "fps")])


_COND = ["base", "sft_v2", "grpo", "sft_patch_v2"]
_LONG = "SELECT condition, round(avg(length(generated)), 6) AS chars, round(avg(length(reference)), 6) AS reference_chars, round(avg((generated IS NULL)::int), 6) AS missing FROM sft_patch_v2_outputs GROUP BY condition"


def _long(t: Tables) -> DataFrame:
    m = t.sft_patch_v2_outputs.groupBy("condition").agg(F.round(F.avg(F.length("generated")), 6).alias("chars"), F.round(F.avg(F.length("reference")), 6).alias("reference_chars"), F.round(F.avg(F.col("generated").isNull().cast("int")), 6).alias("missing"))
    return R.long_form(m, ["condition"], ["chars", "reference_chars", "missing"])


_UNPIVOT = " UNION ALL ".join(f"SELECT condition, '{m}' AS metric, {m} AS value FROM m" for m in ("chars", "reference_chars", "missing"))


@query(f"WITH m AS ({_LONG}), l AS ({_UNPIVOT}) SELECT metric, {', '.join(f'max(value) FILTER (condition = {chr(39)}{c}{chr(39)}) AS {c}' for c in _COND)}, round(max(value) FILTER (condition = 'sft_patch_v2') - max(value) FILTER (condition = 'base'), 6) AS delta FROM l GROUP BY metric")
def o_agg_14(t: Tables) -> DataFrame:
    return R.pivot_with_delta(_long(t), "condition", _COND).withColumn("delta", F.round("delta", 6))


@query(f"WITH m AS ({_LONG}), l AS ({_UNPIVOT}) SELECT condition, metric, value, value = max(value) OVER (PARTITION BY metric) AS best FROM l")
def o_agg_15(t: Tables) -> DataFrame:
    return R.mark_best(_long(t))


# The ranges in which averages of the judge's dims should lie.
RANGES = {"spatial_orientation": (2.9, 3.6), "social_interaction": (3.2, 3.3), "action_events": (1.9, 2.6), "ambience": (3.5, 4.9), "descriptiveness": (2.8, 3.6), "objectivity": (4.9, 5.2), "accuracy": (3.0, 3.5), "clarity": (3.1, 3.9)}


@query("WITH a AS (" + " UNION ALL ".join(f"SELECT '{d}' AS metric, round(avg({d}), 6) AS value, {low} AS low, {high} AS high FROM {_SCORED}" for d, (low, high) in RANGES.items()) + ") SELECT metric, low::double AS low, high::double AS high, value, CASE WHEN value IS NULL THEN 'MISSING' WHEN value BETWEEN low AND high THEN 'OK' ELSE 'OUT OF RANGE' END AS status FROM a")
def o_agg_16(t: Tables) -> DataFrame:
    avg = _scored(t).agg(*[F.round(F.avg(d), 6).alias(d) for d in RANGES]).unpivot([], list(RANGES), "metric", "value")
    bounds = t.spark.createDataFrame([(d, low, high) for d, (low, high) in RANGES.items()], "metric string, low double, high double")
    return R.in_range(avg, bounds).select("metric", "low", "high", "value", "status")


@query("SELECT user_id, list(event_type ORDER BY event_type) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def o_agg_18(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id")
def o_agg_19(t: Tables) -> DataFrame:
    return R.latest(t.events, "user_id", "event_id", "value")


@query("SELECT DISTINCT unnest(json_keys(scores)) AS key FROM sft_patch_v2_judge_scores WHERE json_valid(scores)")
def o_agg_20(t: Tables) -> DataFrame:
    return t.sft_patch_v2_judge_scores.select(F.explode(F.map_keys(F.from_json("scores", "map<string,string>"))).alias("key")).distinct()


@query("SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, prev), lambda z: abs(z[1]::double - z[2]::double))) / len(embedding), 6) AS diff, round(1 - list_inner_product(embedding::double[], prev::double[]) / sqrt(list_inner_product(embedding::double[], embedding::double[]) * list_inner_product(prev::double[], prev::double[])), 6) AS cosine FROM (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings)")
def o_win_1_2(t: Tables) -> DataFrame:
    a = W.lag_difference(t.embeddings, "label", "vec_id", "embedding")
    b = W.lag_difference(a.withColumnRenamed("diff", "d"), "label", "vec_id", "embedding", "cosine")
    return b.select("vec_id", F.round("d", 6).alias("diff"), F.round("diff", 6).alias("cosine"))


@query("""WITH d AS (SELECT user_id, event_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS diff FROM events),
r AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, i = 1 ORDER BY diff DESC NULLS LAST, event_id) AS j FROM r)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rank FROM k WHERE n <= 4 OR i = 1 OR j <= 3""")
def o_win_3_5(t: Tables) -> DataFrame:
    d = t.events.select("user_id", "event_id", F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))).alias("diff"))
    return W.keyframes(d, "user_id", "event_id").select("user_id", "event_id", "rank")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i % greatest(1, n // 64) = 0")
def o_win_4(t: Tables) -> DataFrame:
    return W.subsampled(t.events.select("user_id", "event_id"), "user_id", "event_id")


@query("""WITH p AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
w AS (SELECT *, least(50, greatest(n // 2, 1)) AS w FROM p), o AS (SELECT *, unnest(range(-(w // 2), (w - 1) // 2 + 1)) AS k FROM w),
m AS (SELECT *, CASE WHEN i + k < 0 THEN -1 - (i + k) WHEN i + k >= n THEN 2 * n - 1 - (i + k) ELSE i + k END AS j FROM o),
a AS (SELECT m.user_id, m.event_id, round(avg(p.value) + 1e-9, 6) AS smooth FROM m JOIN p ON p.user_id = m.user_id AND p.i = m.j GROUP BY ALL)
SELECT e.user_id, e.event_id, smooth FROM events e LEFT JOIN a USING (user_id, event_id)""")
def o_win_6(t: Tables) -> DataFrame:
    return W.moving_average(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", "event_id", F.round(F.col("smooth") + 1e-9, 6).alias("smooth"))


@query("""WITH RECURSIVE d AS (SELECT user_id, ts::date AS day, round(avg(value), 6) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts::date) AS i FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY user_id, ts::date),
f AS (SELECT user_id, 0 AS i, '-infinity'::double AS best, 0 AS streak, NULL::date AS stop FROM (SELECT DISTINCT user_id FROM d)
UNION ALL SELECT f.user_id, d.i, CASE WHEN stop IS NOT NULL OR v <= best + 1 THEN best ELSE v END, CASE WHEN stop IS NOT NULL THEN streak WHEN v <= best + 1 THEN streak + 1 ELSE 0 END,
CASE WHEN stop IS NOT NULL THEN stop WHEN v <= best + 1 AND streak + 1 >= 3 THEN day END FROM f JOIN d ON d.user_id = f.user_id AND d.i = f.i + 1)
SELECT user_id, best, streak, stop FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def o_win_7_str_3(t: Tables) -> DataFrame:
    daily = t.events.where("value is not null and ts is not null").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("value"))
    return W.plateau(daily, "user_id", "day", "value")


@query("SELECT user_id, min(event_id) FILTER (value < 5 AND value <> 0) AS stop FROM events GROUP BY user_id")
def o_win_8(t: Tables) -> DataFrame:
    return W.first_below(t.events, "user_id", "event_id", "value", 5)


@query("SELECT user_id, event_id, min(value) OVER w AS best, coalesce(value < min(value) OVER p, value IS NOT NULL AND min(value) OVER p IS NULL) AS is_best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def o_win_9(t: Tables) -> DataFrame:
    return W.best_so_far(t.events, "user_id", "event_id", "value").select("user_id", "event_id", "best", "is_best")


@query("SELECT ts::date AS epoch, round(avg(value), 6) AS loss FROM events GROUP BY 1")
def o_win_10(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date("ts").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))


@query("SELECT output_id FROM sft_patch_v2_outputs WHERE output_id NOT IN (SELECT min(output_id) FROM sft_patch_v2_outputs GROUP BY video_id)")
def o_str_1(t: Tables) -> DataFrame:
    done = t.sft_patch_v2_outputs.groupBy("video_id").agg(F.min("output_id").alias("output_id"))
    return I.remaining(t.sft_patch_v2_outputs, done, "output_id").select("output_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def x_6_tumbling(t: Tables) -> DataFrame:
    return I.tumbling(t.events, "ts", "1 hour", "event_type", value="value").withColumn("total", F.round("total", 4))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def x_6_sessions(t: Tables) -> DataFrame:
    return I.sessions(t.events, "ts", "30 minutes", "user_id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS as_of FROM events")
def x_7(t: Tables) -> DataFrame:
    rows = t.events.withColumn("at", F.struct("ts", "event_id"))
    return W.as_of(rows, "user_id", "at", "value", F.col("event_type") == "purchase").select("event_id", "as_of")


@query("SELECT r_name, n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def x_1(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.expr("l_orderkey = o_orderkey")).join(t.customer, F.expr("o_custkey = c_custkey")).join(t.nation, F.expr("c_nationkey = n_nationkey")).join(t.region, F.expr("n_regionkey = r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def x_2(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS q, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice)")
def x_3(t: Tables) -> DataFrame:
    w, v = Window.partitionBy("o_custkey").orderBy("o_totalprice"), Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return t.orders.select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(v).alias("q"), F.first("o_orderkey").over(v).alias("f"))


@query("SELECT video_id FROM balanced_train INTERSECT SELECT video_id FROM balanced_eval")
def x_4(t: Tables) -> DataFrame:
    return t.balanced_train.select("video_id").intersect(t.balanced_eval.select("video_id"))


@query()
def x_5(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", F.lit(0.5)).alias("median"))


@query("SELECT date_trunc('month', ts)::date AS month, count(*) AS n, max(date_diff('day', DATE '2024-01-01', ts::date)) AS last_day FROM events GROUP BY 1")
def x_9(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.max(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))).alias("last_day"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ()) UNION ALL SELECT l_returnflag, l_linestatus, NULL, sum(l_linenumber)::bigint FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def x_2_sets(t: Tables) -> DataFrame:
    """Grouping sets, and a rollup."""
    a, b, c = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    sets = t.lineitem.groupingSets([[a, b], [c], []], a, b, c).agg(F.count(F.lit(1)).alias("n"))
    roll = t.lineitem.rollup(a, b).agg(F.sum("l_linenumber").cast("bigint").alias("n"))
    return sets.unionByName(roll.select("l_returnflag", "l_linestatus", F.lit(None).cast("int").alias("l_linenumber"), "n"))


@query("SELECT event_id, count(*) OVER w AS near, min(value) OVER w AS least FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts)::bigint RANGE BETWEEN 3600 PRECEDING AND 1800 FOLLOWING)")
def x_3_range(t: Tables) -> DataFrame:
    """A frame by time, not by rows."""
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-3600, 1800)
    return t.events.where("ts is not null").withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)).select("event_id", F.count(F.lit(1)).over(w).alias("near"), F.min("value").over(w).alias("least"))


@query("SELECT user_id, event_type FROM events EXCEPT ALL SELECT DISTINCT user_id, event_type FROM events")
def x_4_all(t: Tables) -> DataFrame:
    """A difference that counts repeats."""
    rows = t.events.select("user_id", "event_type")
    return rows.exceptAll(rows.distinct())


@query("SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 30 MINUTE, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 30 MINUTE]) AS w, ts FROM events WHERE ts IS NOT NULL) WHERE w <= ts AND ts < w + INTERVAL 1 HOUR GROUP BY ALL")
def x_6_sliding(t: Tables) -> DataFrame:
    return I.sliding(t.events.where("ts is not null"), "ts", "1 hour", "30 minutes", "event_type")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def x_6_stream(t: Tables) -> DataFrame:
    """A stream with a watermark, run until what is there is read; windows that a later row would be too late for stand in
    the sink, the last ones in its state, so all are closed by one row far ahead."""
    folder = step_path(t.spark, "stream")
    rows = t.events.where("ts is not null").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows.write.parquet(f"{folder}/in/a")
    source = lambda: t.spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")

    def run() -> None:
        windows = I.sliding(source(), "ts", "1 day", "1 day", "event_type", late="400 days")
        windows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()

    run()
    rows.limit(1).select((F.max("ts").over(Window.partitionBy()) + F.expr("interval 5000 days")).alias("ts"), F.lit("end").alias("event_type")).write.parquet(f"{folder}/in/b")
    run()
    return t.spark.read.parquet(f"{folder}/out").where("event_type <> 'end'").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
