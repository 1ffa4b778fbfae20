"""Problem 3: fields that come, go, change name or type from file to file of a run.

A catalogue of column lifespans: each file's fields and types are taken from its records (its footer, so to speak),
islands of consecutive files per run, field and type give the starts and endings, and what starts where something ends
is a change of type or, if the values of shared videos agree, of name. The renames make the alias table from which the
casts of one consistent table are generated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import cut_lineage

#: The type of a field before any file with a majority type.
UNKNOWN = "unknown"
#: Rows of fields that come and go (some 60 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 200_000
RUN = ("run_name", "file_no", "file_name")


def _json_type(schema: str) -> Column:
    s = F.col(schema)
    return (
        F.when(s == "BIGINT", "integer")
        .when(s.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "decimal")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
    )


def exploded_fields(df: DataFrame, payload: str) -> DataFrame:
    """(run_name, file_no, file_name, video_id, first, field, type, value): a row for each own field of each record.

    Null, malformed and other than object payloads, and records of which the only field is `error`, are left out;
    a record repeated within its file counts once. The type of null is null. first marks one row of each record; a record
    without fields has one row with a null field. Whole numbers beyond 64 bits count as decimals.
    """
    kept = df.select(*RUN, "video_id", F.col(payload).alias("raw")).where("file_name is not null and raw is not null").distinct()
    parsed = kept.select(*RUN, "video_id", "raw", F.try_parse_json("raw").alias("v")).where("schema_of_variant(v) like 'OBJECT%' and schema_of_variant(v) not like 'OBJECT<error: %' or schema_of_variant(v) like 'OBJECT<error: %, %: %'").drop("v")
    rows = df.sparkSession.sql(
        "SELECT run_name, file_no, file_name, video_id, coalesce(pos, 0) = 0 AS first, key AS field, schema_of_variant(value) AS kind, to_json(value) AS value FROM {parsed}, LATERAL variant_explode_outer(try_parse_json(raw))",
        parsed=parsed,
    )
    return rows.withColumn("type", _json_type("kind")).withColumn("value", F.when(F.col("type").isNotNull(), F.col("value"))).drop("kind")


def field_catalogue(fields: DataFrame) -> DataFrame:
    """(run_name, file_name, place, last, field, type) of the fields that a file has.

    place counts the files of the run that have records, last is their number. A type that no majority of the values
    has is that of the file before. One aggregation of the fields; the windows after it are over rows a file and field.
    """
    kinds = ("integer", "decimal", "string", "boolean", "object", "array")
    per = fields.groupBy(*RUN, "field").agg(F.count(F.lit(1)).alias("carried"), F.count("type").alias("valued"), F.count_if("first").alias("firsts"), *[F.count_if(F.col("type") == k).alias(k) for k in kinds])
    run = Window.partitionBy("run_name")
    per = per.withColumn("place", F.dense_rank().over(run.orderBy("file_no", "file_name"))).withColumn("last", F.max("place").over(run))
    per = per.withColumn("records", F.sum("firsts").over(Window.partitionBy("run_name", "place")))
    kind = F.coalesce(*[F.when(2 * F.col(k) > F.col("valued"), F.lit(k)) for k in kinds])
    had = per.where((2 * F.col("carried") > F.col("records")) & F.col("field").isNotNull()).select("run_name", "file_name", "place", "last", "field", kind.alias("type"))
    before = Window.partitionBy("run_name", "field").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return had.withColumn("type", F.coalesce(F.last("type", ignorenulls=True).over(before), F.lit(UNKNOWN)))


def lifespans(catalogue: DataFrame) -> DataFrame:
    """(run_name, field, type, first, final, last): the islands of consecutive files in which a field has one type."""
    own = Window.partitionBy("run_name", "field").orderBy("place")
    new = (F.col("place") - F.lag("place", 1, -1).over(own) != 1) | (F.col("type") != F.lag("type", 1, "").over(own))
    island = F.sum("new").over(own)
    return catalogue.withColumn("new", new.cast("int")).withColumn("island", island).groupBy("run_name", "field", "island").agg(F.first("type").alias("type"), F.min("place").alias("first"), F.max("place").alias("final"), F.max("last").alias("last")).drop("island")


def _renames(fields: DataFrame, events: DataFrame) -> DataFrame:
    """(run_name, place, old, new): renames of events(run_name, place, file_name, before, field, old_type, new_type).

    A pair is one if at least one video has values of both fields and all such videos have equal ones. Of the pairs of
    one file those with the most videos are taken first, then by name, each field once, until no pair is left.
    """
    gone = events.where("new_type is null").select("run_name", "place", "file_name", "before", F.col("field").alias("old"), F.col("old_type").alias("type"))
    come = events.where("old_type is null").select("run_name", "place", F.col("field").alias("new"), F.col("new_type").alias("type"))
    maybe = cut_lineage(gone.join(come, ["run_name", "place", "type"]).drop("type"))
    sides = [
        maybe.select("run_name", "place", "old", "new", F.col("before").alias("file_name"), F.col("old").alias("field"), F.lit("was").alias("side")),
        maybe.select("run_name", "place", "old", "new", "file_name", F.col("new").alias("field"), F.lit("is").alias("side")),
    ]
    both = sides[0].unionByName(sides[1])
    # names repeat so much that the table of fields looks far smaller on disk than it is: it is never the side that is broadcast
    both = F.broadcast(both) if maybe.limit(BROADCAST_ROWS // 2 + 1).count() <= BROADCAST_ROWS // 2 else both.hint("merge")
    values = fields.where("value is not null").join(both, ["run_name", "file_name", "field"])
    per = values.groupBy("run_name", "place", "old", "new", "video_id").agg(*[F.collect_set(F.when(F.col("side") == side, F.col("value"))).alias(side) for side in ("was", "is")])
    shared = per.where((F.size("was") > 0) & (F.size("is") > 0)).groupBy("run_name", "place", "old", "new").agg(F.count(F.lit(1)).alias("videos"), F.count_if(F.arrays_overlap("was", "is")).alias("same")).where("same = videos")
    pairs = shared.groupBy("run_name", "place").agg(F.array_sort(F.collect_list(F.struct((-F.col("videos")).alias("order"), "old", "new"))).alias("pairs"))
    none = F.array().cast("array<struct<old:string,new:string>>")
    taken = F.aggregate("pairs", none, lambda done, p: F.when(F.exists(done, lambda d: (d["old"] == p["old"]) | (d["new"] == p["new"])), done).otherwise(F.concat(done, F.array(F.struct(p["old"].alias("old"), p["new"].alias("new"))))))
    return pairs.select("run_name", "place", F.explode(taken).alias("p")).select("run_name", "place", "p.old", "p.new")


def schema_changes(df: DataFrame, payload: str) -> DataFrame:
    """(file_name, change, field, new_field): what changed from each file of a run to the next.

    A rename needs a field that goes, one of the same type that comes, and at least one shared video, all shared videos
    with values in both having equal ones; of several such pairs each field is in one, see _renames. Null run names are a
    run; files without any record are passed over; no rows give no changes.
    """
    return changes_by_run(df, payload).select("file_name", "change", "field", "new_field")


def changes_by_run(df: DataFrame, payload: str) -> DataFrame:
    """schema_changes with run_name."""
    fields = cut_lineage(exploded_fields(df.fillna({"run_name": ""}), payload))
    catalogue = cut_lineage(field_catalogue(fields))
    spans = lifespans(catalogue)
    starts = spans.where("first > 1").select("run_name", F.col("first").alias("place"), "field", F.col("type").alias("new_type"), F.lit(None).cast("string").alias("old_type"))
    ends = spans.where("final < last").select("run_name", (F.col("final") + 1).alias("place"), "field", F.lit(None).cast("string").alias("new_type"), F.col("type").alias("old_type"))
    both = starts.unionByName(ends).groupBy("run_name", "place", "field").agg(F.max("new_type").alias("new_type"), F.max("old_type").alias("old_type"))
    order = Window.partitionBy("run_name").orderBy("file_no", "file_name")
    files = fields.select(*RUN).distinct().withColumns({"place": F.row_number().over(order), "before": F.lag("file_name").over(order)}).drop("file_no")
    events = cut_lineage(both.join(files.hint("merge"), ["run_name", "place"]))
    renamed = cut_lineage(_renames(fields, events))
    known = f"new_type is not null and old_type is not null and new_type <> '{UNKNOWN}' and old_type <> '{UNKNOWN}'"
    named = events.join(renamed.select("run_name", "place", F.col("old").alias("field"), "new"), ["run_name", "place", "field"], "left")
    named = named.join(renamed.select("run_name", "place", F.col("new").alias("field"), F.lit(True).alias("taken")), ["run_name", "place", "field"], "left")
    change = F.when(F.expr(known), "retyped").when(F.col("new_type").isNull() & F.col("new").isNotNull(), "renamed").when(F.col("new_type").isNull(), "removed").when(F.col("old_type").isNull() & F.col("taken").isNull(), "added")
    return named.select("run_name", "file_name", change.alias("change"), "field", F.when(change == "renamed", F.col("new")).otherwise("").alias("new_field")).where("change is not null")


def alias_table(changes: DataFrame, df: DataFrame, payload: str) -> dict[str, str]:
    """The one name of every field that was renamed: of the names tied by renames the one renamed most often, then by name.

    Names are tied within a run, and over runs, only as long as no record of df carries two of them: what one record holds
    side by side are different fields. The distinct renames and the pairs of renamed fields that stand together are
    collected; both are bounded by the square of the number of field names, not by records.
    """
    pairs = sorted({(r["field"], r["new_field"]) for r in changes.where("change = 'renamed'").select("field", "new_field").distinct().collect()})
    names = sorted({x for p in pairs for x in p})
    if not names:
        return {}
    held = F.array_sort(F.array_intersect(F.json_object_keys(payload), F.array(*map(F.lit, names))))
    beside = df.select(held.alias("k")).where("size(k) > 1").distinct().select(F.explode(F.flatten(F.transform("k", lambda x: F.transform(F.filter("k", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    apart = {frozenset((r["a"], r["b"])) for r in beside.select("p.*").distinct().collect()}
    group = {x: {x} for x in names}
    for a, b in pairs:
        one, two = group[a], group[b]
        if one is not two and not any(frozenset((x, y)) in apart for x in one for y in two):
            one |= two
            for x in two:
                group[x] = one
    olds = [a for a, _ in pairs]
    return {x: min(group[x], key=lambda n: (-olds.count(n), n)) for x in names}


def consistent_table(df: DataFrame, payload: str, changes: DataFrame, reserved: list[str] | None = None) -> DataFrame:
    """One row per record with a column for each field under its one name, cast to its one type.

    A field whose values are numbers, also as texts, first elements of arrays or `score` members of objects, in more than
    half of its records is DOUBLE; others are STRING. Where a record has several names of one field, the first by name
    that is not null counts. Error and malformed records have nulls throughout. Own columns of df keep their names;
    a field named like one of these, of `reserved` or of another field, in any case, gets the suffix _field.
    """
    alias = alias_table(changes, df, payload)
    keys = df.select(F.col(payload).alias("raw")).where("schema_of_variant(try_parse_json(raw)) like 'OBJECT%'")
    fields = df.sparkSession.sql("SELECT key, count(*) AS n, count_if(try_cast(coalesce(try_variant_get(value, '$', 'string'), '') AS double) IS NOT NULL OR try_variant_get(value, '$[0]', 'double') IS NOT NULL OR try_variant_get(value, '$.score', 'double') IS NOT NULL) AS numbers FROM {keys}, LATERAL variant_explode(try_parse_json(raw)) WHERE key <> 'error' GROUP BY key", keys=keys).collect()
    names: dict[str, list] = {}
    for row in sorted(fields, key=lambda r: r["key"]):
        names.setdefault(alias.get(row["key"], row["key"]), []).append(row)
    out = df.withColumn("_v", F.try_parse_json(payload))
    made, used = [], {c.lower() for c in (*df.columns, *(reserved or ()))}
    for name, rows in sorted(names.items()):
        numeric = 2 * sum(r["numbers"] for r in rows) > sum(r["n"] for r in rows)
        parts = []
        for r in rows:
            at = "$['" + r["key"].replace("\\", "\\\\").replace("'", "\\'") + "']"
            if numeric:
                parts += [F.try_variant_get("_v", at, "string").try_cast("double"), F.try_variant_get("_v", at + "[0]", "double"), F.try_variant_get("_v", at + ".score", "double")]
            else:
                parts.append(F.try_variant_get("_v", at, "string"))
        while name.lower() in used:
            name += "_field"
        used.add(name.lower())
        made.append(F.coalesce(*parts).alias(name))
    return out.select(*[F.col(c) for c in df.columns if c != payload], *made)
