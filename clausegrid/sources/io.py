"""Sources, sinks and idempotent writes.

Writers never overwrite the path being read: results go to a new path (or a new version
folder) and the caller switches readers over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from clausegrid import constants as K
from clausegrid.functions import ordered
from clausegrid.functions.text import col

PAGE_SCHEMA = "dv_id long, page_number int, text string, ocr_derived boolean, ocr_confidence double"
BRIEF_SCHEMA = ("struct<interpretation: array<struct<text: string, field_ids: array<string>, self_confidence: double>>, "
                "open_questions: array<struct<question: string, field_ids: array<string>>>>")


# ------------------------------------------------------------------ files, pages, tables

def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Raw files with content and length."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
            .load(path).select("path", "content", "length"))


def file_extension(filename: Column | str, mime: Column | str) -> Column:
    """Lower-cased extension of the name, else by MIME type."""
    name = col(filename)
    return (F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1)))
            .when(col(mime) == "application/pdf", "pdf").when(col(mime) == "text/plain", "txt").otherwise("bin"))


def ingest_documents(files: DataFrame, declared: DataFrame, key: str = "dv_id", max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Check uploaded bytes against their declaration; refusals carry a reason. `max_bytes`: refuse larger files.

    `files`: key, content, length. `declared`: key, filename, mime_type, sha256.
    """
    seen = files.select(key, "length", F.sha2("content", 256).alias("actual_sha256"))
    joined = declared.join(seen, key, "left")
    reason = (
        F.when(F.col("length").isNull(), "missing content")
        .when(F.col("length") <= 0, "empty file")
        .when(F.lit(max_bytes is not None) & (F.col("length") > (max_bytes or 0)), f"file larger than {max_bytes} bytes")
        .when(F.col("actual_sha256") != F.lower("sha256"), "hash mismatch"))
    checked = joined.withColumns({"extension": file_extension("filename", "mime_type"), "reason": reason})
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Parsed pages with a fixed schema, from Parquet, ORC, JSON or CSV."""
    reader = spark.read.schema(PAGE_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(fmt).load(path)


def read_table(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None,
               predicate: Column | str | None = None, jdbc: dict | None = None) -> DataFrame:
    """Scan one entity. Columns and predicate reach the Parquet or JDBC source.

    `jdbc` holds the connection options; give partitionColumn, lowerBound, upperBound and
    numPartitions there so that the read is spread over tasks.
    """
    df = (spark.read.format("jdbc").options(dbtable=name, **jdbc).load() if jdbc
          else spark.read.parquet(f"{root}/{name}" if "." in name else f"{root}/{name}.parquet"))
    if predicate is not None:
        df = df.filter(predicate)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("workspace_id",), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


# ------------------------------------------------------------------ idempotent updates

def upsert(base: DataFrame, updates: DataFrame, key: Sequence[str], mode: str = "update",
           columns: Sequence[str] | None = None, order_by: Sequence[str] = (), keep: Column | None = None) -> DataFrame:
    """Keyed upsert. `ignore` keeps existing rows; `update` overwrites `columns` (all but the
    key by default). Of several updates with one key the last by `order_by` counts (for
    `ignore` the first). `keep` names existing rows that must not be overwritten."""
    cols = base.columns
    order = list(order_by) or [c for c in updates.columns if c not in key]
    if mode == "ignore":
        fresh = ordered.earliest(updates, key, order).select(*cols)
        return ordered.stack(base, fresh.join(base.select(*key), list(key), "left_anti"))
    changed = list(columns) if columns else [c for c in cols if c not in key]
    last = ordered.latest(updates, key, order).select(*cols)
    old = base.select(*key, F.struct(*cols).alias("o"), (keep if keep is not None else F.lit(False)).alias("kept"))
    new = last.select(*key, F.struct(*cols).alias("n"))
    both = old.join(new, list(key), "full_outer")
    has_old, has_new = F.col("o").isNotNull(), F.col("n").isNotNull()

    def value(c: str) -> Column:
        if c in key:
            return F.coalesce(f"o.{c}", f"n.{c}")
        take = has_new & (~has_old | (F.lit(c in changed) & ~F.coalesce("kept", F.lit(False))))
        return F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*[value(c).alias(c) for c in cols])


def replace_slice(base: DataFrame, new: DataFrame, slice_keys: Sequence[str], replaceable: Column) -> DataFrame:
    """A re-run replaces only its own earlier output: rows of the slices in `new` that are
    `replaceable` go, everything else stays, then the new rows are added."""
    touched = new.select(*slice_keys).distinct().withColumn("__touched", F.lit(True))
    kept = base.join(touched, list(slice_keys), "left").filter(F.col("__touched").isNull() | ~F.coalesce(replaceable, F.lit(False)))
    return ordered.stack(kept.drop("__touched").select(*base.columns), new.select(*base.columns))


def snapshot_diff(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Row-level change between two keyed snapshots: created, removed, changed or unchanged."""
    def digest(df: DataFrame) -> Column:
        values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in sorted(df.columns) if c != key]
        return F.sha2(F.concat_ws("\u0001", *values), 256)

    n = new.select(F.col(key), digest(new).alias("n"))
    o = old.select(F.col(key), digest(old).alias("o"))
    state = (F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "removed")
             .when(F.col("o") != F.col("n"), "changed").otherwise("unchanged"))
    return n.join(o, key, "full_outer").select(key, state.alias("state"))


def sync_counts(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows created and rows already present at the sink."""
    diff = snapshot_diff(new, old, key)
    return diff.agg(
        F.count_if(F.col("state") == "created").alias("created_rows"),
        F.count_if(F.col("state").isin("changed", "unchanged")).alias("updated_rows"),
        F.count_if(F.col("state") == "changed").alias("changed_rows"),
        F.count_if(F.col("state") == "removed").alias("removed_rows"))


# ------------------------------------------------------------------ briefs and audit rows

def write_briefs(briefs: DataFrame, path: str) -> None:
    """One JSON document per version, partitioned by workspace."""
    briefs.select("workspace_id", "dv_id", F.to_json("brief").alias("brief")).write.mode("append").partitionBy("workspace_id").parquet(path)


def parse_briefs(raw: DataFrame, versions: DataFrame) -> DataFrame:
    """The brief of every version, empty lists where none is stored."""
    parsed = raw.select("dv_id", F.from_json("brief", BRIEF_SCHEMA).alias("b"))
    empty_i = F.from_json(F.lit('{"interpretation": [], "open_questions": []}'), BRIEF_SCHEMA)
    return versions.join(parsed, "dv_id", "left").select(
        *versions.columns, F.coalesce("b.interpretation", empty_i["interpretation"]).alias("interpretation"),
        F.coalesce("b.open_questions", empty_i["open_questions"]).alias("open_questions"))


def read_briefs(spark: SparkSession, path: str, versions: DataFrame) -> DataFrame:
    return parse_briefs(spark.read.parquet(path), versions)


def content_hash(df: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns])), 256)


def audit_rows(before: DataFrame, after: DataFrame, key: str, actor: Column, action: str) -> DataFrame:
    """One audit record per row that was created, changed or removed, with both hashes."""
    b = before.select(F.col(key), content_hash(before).alias("before_hash"))
    a = after.select(F.col(key), content_hash(after).alias("after_hash"))
    return (b.join(a, key, "full_outer").filter(~F.col("before_hash").eqNullSafe(F.col("after_hash")))
            .select(F.col(key).cast("string").alias("resource_id"), actor.alias("actor"), F.lit(action).alias("action"), "before_hash", "after_hash"))


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


# ------------------------------------------------------------------ candidate intake

_EVIDENCE = ("array<struct<page: int, section_ref: string, section_title: string, char_start: int, char_end: int, quoted_text: string>>")
CANDIDATE_SCHEMAS = {
    "classify": "doc_type string, counterparty_guess string, language string, is_amendment boolean, confidence double, suspicious_content boolean",
    "field": ("field_key string, label string, status string, value_text string, value_normalized string, extraction_kind string, "
              f"evidence {_EVIDENCE}, searched_sections array<string>, self_confidence double, notes string"),
    "obligation": ("title string, obligor string, obligee string, description string, due_rule string, "
                   "due_rule_detail struct<anchor: string, anchor_value: string, offset_days: int, calendar: string, recurrence: string>, "
                   f"anchor_known boolean, grace_period_days int, priority string, extraction_kind string, evidence {_EVIDENCE}, self_confidence double"),
    "flag": ("flag_type string, playbook_rule_id string, category string, title string, explanation string, expected_text string, found_text string, "
             "severity string, recommended_step string, suggested_reviewer_role string, extraction_kind string, "
             f"evidence {_EVIDENCE}, self_confidence double"),
    "change": ("change_type string, impact_category string, is_material boolean, clause_ref string, before_text string, after_text string, "
               f"business_impact string, risk_delta string, suggested_reviewer_role string, evidence {_EVIDENCE}, self_confidence double"),
    "answer": "answer_kind string, claims array<struct<text: string, evidence_ids: array<string>, kind: string>>, follow_up_question string, self_confidence double",
    "brief": ("interpretation array<struct<text: string, field_ids: array<string>, self_confidence: double>>, "
              "open_questions array<struct<question: string, field_ids: array<string>>>, suspicious_content boolean"),
}
# --- fixed values: allowed values of candidate fields
_ROLES6 = ["legal", "finance", "security", "privacy", "procurement", "business"]
CANDIDATE_ENUMS = {
    "classify": {"doc_type": ["msa", "nda", "sow", "order_form", "lease", "employment", "amendment", "other"]},
    "field": {"status": ["found", "not_found", "conflicting"], "extraction_kind": K.KINDS},
    "obligation": {"due_rule": K.DUE_RULES, "due_rule_detail.calendar": ["calendar", "business"], "priority": K.SEVERITIES, "extraction_kind": K.KINDS},
    "flag": {"flag_type": ["missing_clause", "ambiguous", "one_sided", "non_standard", "contradiction", "uncapped_liability", "short_notice"],
             "category": _ROLES6, "severity": K.SEVERITIES, "suggested_reviewer_role": _ROLES6, "extraction_kind": K.KINDS},
    "change": {"change_type": ["added", "removed", "modified", "moved"],
               "impact_category": ["money", "dates", "renewal", "liability", "indemnity", "data_use", "sla", "termination", "obligations", "cosmetic"],
               "risk_delta": ["increased", "decreased", "unchanged"]},
    "answer": {"answer_kind": ["grounded", "refusal_silent", "refusal_conflict", "refusal_out_of_scope", "refusal_permission"]},
    "brief": {},
}
CANDIDATE_REQUIRED = {
    "classify": ["language", "is_amendment", "confidence", "suspicious_content"],
    "field": ["field_key", "label", "evidence", "searched_sections", "self_confidence"],
    "obligation": ["title", "obligor", "obligee", "due_rule_detail.anchor", "anchor_known", "grace_period_days", "evidence", "self_confidence"],
    "flag": ["title", "explanation", "recommended_step", "evidence", "self_confidence"],
    "change": ["is_material", "business_impact", "suggested_reviewer_role", "evidence", "self_confidence"],
    "answer": ["claims", "self_confidence"],
    "brief": ["interpretation", "open_questions", "suspicious_content"],
}
_UNIT_RANGE = {"classify": "confidence", "brief": None}


def parse_candidates(raw: DataFrame, kind: str, json_col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Parse JSON rows against the schema of their kind; split valid rows from invalid ones.

    Invalid rows keep their payload and list every rule they break.
    """
    schema = t.StructType.fromDDL(CANDIDATE_SCHEMAS[kind]).add("_corrupt_record", t.StringType())
    doc = F.from_json(json_col, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # a generator keeps the optimizer from parsing the document again for every field used below
    parsed = raw.withColumn("c", F.explode(F.array(doc)))
    broken = F.col("c").isNull() | F.col("c._corrupt_record").isNotNull()
    problems = [F.when(broken, F.lit("malformed"))]
    for name in CANDIDATE_REQUIRED[kind]:
        problems.append(F.when(~broken & F.col(f"c.{name}").isNull(), F.lit(f"missing {name}")))
    for name, allowed in CANDIDATE_ENUMS[kind].items():
        problems.append(F.when(~broken & ~F.coalesce(F.col(f"c.{name}").isin(*allowed), F.lit(False)), F.lit(f"bad {name}")))
    share = _UNIT_RANGE.get(kind, "self_confidence")
    if share:
        problems.append(F.when(~broken & ~F.col(f"c.{share}").between(0, 1), F.lit(f"range {share}")))
    if kind == "obligation":
        problems.append(F.when(~broken & (F.col("c.grace_period_days") < 0), F.lit("range grace_period_days")))
    if _EVIDENCE in CANDIDATE_SCHEMAS[kind]:
        bad = F.exists("c.evidence", lambda e: (
            e["page"].isNull() | (e["page"] < 1) | e["char_start"].isNull() | (e["char_start"] < 0)
            | e["char_end"].isNull() | (e["char_end"] < 0) | e["quoted_text"].isNull() | (e["quoted_text"] == "")))
        problems.append(F.when(~broken & bad, F.lit("bad evidence")))
    checked = parsed.withColumn("problems", F.array_compact(F.array(*problems)))
    valid = checked.filter(F.size("problems") == 0).select(*[c for c in raw.columns if c != json_col], "c.*").drop("_corrupt_record")
    invalid = checked.filter(F.size("problems") > 0).drop("c")
    return valid, invalid
