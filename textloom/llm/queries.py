"""The queries of the problems on training text, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.answers import defective_pairs
from textloom.llm.cross_split import cross_split_overlaps, cross_split_pairs, overlap_report
from textloom.llm.cuts import cut_texts, truncation_by_source
from textloom.llm.encoding import decode_ids, encode_texts
from textloom.llm.leakage import leaked_items
from textloom.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from textloom.llm.personal import personal_details, redacted_texts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The texts that may be cut, by table, and the other texts whose sentences tell how sentences end."""
    outputs, captions = _table(spark, sf_dir, "sft_patch_v2_outputs"), _table(spark, sf_dir, "ten_video_eval")
    rows = outputs.select(F.concat_ws(":", F.lit("sft_patch_v2_outputs"), "output_id").alias("id"), F.col("run_file").alias("source"), F.col("generated").alias("text")).unionByName(
        captions.select(F.concat_ws(":", F.lit("ten_video_eval"), "row_id").alias("id"), F.col("run_file").alias("source"), F.col("caption").alias("text"))
    )
    return rows, outputs.select(F.col("reference").alias("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs, captions = _table(spark, sf_dir, "sft_patch_v2_outputs"), _table(spark, sf_dir, "ten_video_eval")
    others = outputs.select(F.col("reference").alias("text")).unionByName(captions.select(F.col("caption").alias("text")))
    return defective_pairs(outputs, others, "output_id", "reference", "generated", "run_file")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_texts(*_answers(spark, sf_dir)).where("cut").select(F.split("id", ":").alias("id")).distinct()
    return cut.select(F.col("id")[0].alias("table_name"), F.col("id")[1].cast("long").alias("row_key"))


def p2_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_by_source(cut_texts(*_answers(spark, sf_dir))).withColumnRenamed("source", "run_file")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split_pairs(_table(spark, sf_dir, "balanced_eval"), _table(spark, sf_dir, "balanced_train"))


def p4_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    evals = _table(spark, sf_dir, "balanced_eval")
    return overlap_report(evals, cross_split_overlaps(evals, _table(spark, sf_dir, "balanced_train")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicate_pairs(_table(spark, sf_dir, "all_captions"), "caption_id", "blv_description")
    return pairs.withColumnsRenamed({"a": "caption_id_a", "b": "caption_id_b"})


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups themselves, a row per caption: for groups whose pairs are too many to be wanted."""
    groups = near_duplicate_groups(_table(spark, sf_dir, "all_captions"), "caption_id", "blv_description").distinct()
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return groups.join(sizes, "component").select(F.col("id").alias("caption_id"), "component", "size")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_ids(p6_ids(spark, sf_dir), "doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items")).select("item_id", "doc_id")


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_details(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "name_list"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_texts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "name_list"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_sources, p4_found, p4_overlaps, p5_found, p5_groups, p6_ids, p6_decoded, p7_found, p7_spans, p8_found, p8_redacted)}


_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


def _runs(name: str, table: str, ident: str, text: str, least: int = 12) -> str:
    """A CTE of the distinct three-word runs of each text of enough words, and one of their numbers."""
    return (
        f"w{name} AS (SELECT {ident} AS id, {_WORDS.format(text)} AS w FROM {table} WHERE {text} IS NOT NULL), "
        f"{name} AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM w{name} WHERE len(w) >= {least}), "
        f"n{name} AS (SELECT id, count(*) AS n FROM {name} GROUP BY id)"
    )


#: Canonical video ids, step by step as in cross_split.canonical_video_id, without lookarounds.
def _video(raw: str) -> str:
    x = f"upper(regexp_replace(translate({raw}, '０１２３４５６７８９', '0123456789'), '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200B}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}\"''`<>\\[\\](){{}}#]+', '', 'g'))".replace("{{", "{").replace("}}", "}")
    x = f"regexp_replace(regexp_replace({x}, '[?&].*$', ''), '^.*[/\\\\]', '')"
    x = f"regexp_replace({x}, '^(?:VIDEO|VID|CLIP|ID)[_:=\\-]*((?:[A-Z][A-Z0-9]{{4}}|\\d{{10}})(?:[^A-Z0-9].*)?)$', '\\1')".replace("{{", "{").replace("}}", "}")
    x = f"regexp_replace({x}, '[_\\-](?:KF|KEYFRAME|FRAME|F)_?\\d+.*$', '')"
    x = f"regexp_replace({x}, '(?:\\.(?:MP4|AVI|MKV|MOV|WEBM|M4V|MPG|MPEG|JPG|JPEG|PNG|JSON|GIF|WAV|TXT))+$', '')"
    plain = f"regexp_replace(regexp_replace({x}, '\\.0*$', ''), '(\\d)[,._\\-]', '\\1', 'g')"
    return f"coalesce(nullif(regexp_extract({plain}, '^(?:[A-Z][A-Z0-9]{{4}}|[0-9]{{10}})$'), ''), CASE WHEN regexp_matches({x}, '^\\d(?:\\.\\d+)?E\\+?0?9$') THEN try_cast(try_cast({x} AS double) AS decimal(20, 0))::varchar END)".replace("{{", "{").replace("}}", "}")


_P4 = f"""WITH {_runs("e", "balanced_eval", "eval_id", "blv_description")}, {_runs("t", "balanced_train", "train_id", "blv_description")},
c AS (SELECT e.id AS a, t.id AS b, count(*) AS c FROM e JOIN t USING (run) GROUP BY ALL),
x AS (SELECT a, b FROM c JOIN ne ON ne.id = a JOIN nt ON nt.id = b WHERE 2 * c >= ne.n + nt.n - c),
v AS (SELECT eval_id AS a, train_id AS b FROM (SELECT eval_id, {_video("video_id")} AS v FROM balanced_eval) JOIN (SELECT train_id, {_video("video_id")} AS v FROM balanced_train) USING (v))
SELECT a AS eval_id, b AS train_id FROM x UNION SELECT a, b FROM v"""

_P5_GROUPS = f"""WITH RECURSIVE {_runs("e", "all_captions", "caption_id", "blv_description")},
s AS (SELECT id, md5(string_agg(run, '|' ORDER BY run)) AS class FROM e GROUP BY id), k AS (SELECT class, min(id) AS rep FROM s GROUP BY class),
f AS (SELECT e.*, n FROM e JOIN ne USING (id) JOIN k ON rep = id),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS c, any_value(x.n) AS n, any_value(y.n) AS m FROM f x JOIN f y ON x.run = y.run AND x.id < y.id AND 2 * x.n >= y.n AND 2 * y.n >= x.n GROUP BY x.id, y.id),
l AS (SELECT a, b FROM c WHERE 2 * c >= n + m - c), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS a, rep AS b FROM k UNION SELECT r.a, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.b),
g AS (SELECT s.id, component FROM s JOIN k USING (class) JOIN (SELECT a, min(b) AS component FROM r GROUP BY a) ON a = rep)"""
_P5 = f"{_P5_GROUPS} SELECT x.id AS caption_id_a, y.id AS caption_id_b FROM g x JOIN g y ON x.component = y.component AND x.id < y.id"

_P7 = f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text <> ''), i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items WHERE text <> ''),
i4 AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) AS run FROM i WHERE len(w) >= 4), n4 AS (SELECT item_id, count(*) AS n FROM i4 GROUP BY item_id),
i10 AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS run FROM i WHERE len(w) >= 10),
d4 AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) AS run FROM d WHERE len(w) >= 4),
d10 AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS run FROM d WHERE len(w) >= 10)
SELECT item_id, doc_id FROM (SELECT item_id, doc_id, count(*) AS c FROM i4 JOIN d4 USING (run) GROUP BY ALL) JOIN n4 USING (item_id) WHERE 2 * c >= n UNION SELECT item_id, doc_id FROM i10 JOIN d10 USING (run)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _P4,
        "p5_found": _P5,
        "p5_groups": f"{_P5_GROUPS} SELECT id AS caption_id, component, size FROM (SELECT DISTINCT id, component, count(*) OVER (PARTITION BY component) AS size FROM g) WHERE size > 1",
        "p7_found": _P7,
        # What comes back from the ids is the text itself; null texts come back empty.
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
