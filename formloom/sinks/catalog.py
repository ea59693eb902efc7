"""The corpus and form catalogs as tables of the session's catalog: created once, bucketed by what they are looked up by, with views,
checked values and numbered migrations."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; as many tasks as read it at a time are useful.
BUCKETS = 32
#: Tables of each migration: columns, and the column that they are bucketed and sorted by.
CORPUS = {
    "hwpx_documents": ("document_id STRING, source_path STRING, source_kind STRING, file_size BIGINT, mtime DOUBLE, detected_type STRING, sha256 STRING, inventory_status STRING, first_seen_at TIMESTAMP, last_checked_at TIMESTAMP, last_audited_at TIMESTAMP, notes STRING", "document_id"),
    "document_classifications": ("classification_id STRING, document_id STRING, classifier_version STRING, document_type STRING, confidence DOUBLE, evidence_json STRING, classified_at TIMESTAMP", "document_id"),
    "label_occurrences": ("occurrence_id STRING, document_id STRING, raw_label STRING, label_text STRING, normalized_label STRING, semantic_type STRING, section_index INT, table_id STRING, row_index INT, col_index INT, cell_index INT, cell_key STRING, paragraph_key STRING, neighbor_text STRING, right_neighbor_empty INT, occurrence_context_json STRING, confidence DOUBLE, source STRING, detected_at TIMESTAMP, audited_at TIMESTAMP", "normalized_label"),
    "human_label_decisions": ("decision_id STRING, normalized_label STRING, semantic_type STRING, decision_status STRING, decided_by STRING, reason STRING, decided_at TIMESTAMP, notes STRING", "normalized_label"),
    "label_promotion_candidates": ("candidate_id STRING, normalized_label STRING, proposed_semantic STRING, occurrence_count BIGINT, document_count BIGINT, evidence_score DOUBLE, status STRING, conflict_count BIGINT, evidence_json STRING, approved_at TIMESTAMP, promotion_version STRING", "normalized_label"),
    "label_dictionary_versions": ("version STRING, built_at TIMESTAMP, entry_count BIGINT, source_corpus_sha STRING, approved_by STRING, notes STRING", "version"),
    "label_dictionary_entries": ("entry_id STRING, version STRING, normalized_label STRING, semantic_type STRING, source_evidence_json STRING, added_at TIMESTAMP", "version"),
    "accuracy_audits": ("audit_id STRING, dictionary_version STRING, classifier_version STRING, audit_at TIMESTAMP, sample_size BIGINT, precision DOUBLE, recall DOUBLE, f1 DOUBLE, notes STRING", "audit_id"),
}
REVIEW = {
    "fill_review_learning_signals": ("signal_id STRING, document_type STRING, signal_type STRING, normalized_label STRING, reusable INT, created_at TIMESTAMP", "document_type"),
    "fill_review_writer_operation_logs": ("operation_id STRING, session_id STRING, operation_type STRING, operation_status STRING, blocked_reason STRING, created_at TIMESTAMP", "session_id"),
    "fill_review_decision_logs": ("decision_id STRING, session_id STRING, normalized_label STRING, decision STRING, created_at TIMESTAMP", "normalized_label"),
    "xml_deep_analyzer_need_flags": ("flag_id STRING, document_id STRING, reason STRING, severity STRING, resolved INT, created_at TIMESTAMP", "document_id"),
}
FORMS = {
    "forms": ("form_id BIGINT, form_type STRING, statute_no STRING, name STRING, sha256 STRING, size_bytes BIGINT, table_count BIGINT, cell_count BIGINT, field_count BIGINT, fingerprint STRING, source_path STRING, status STRING", "form_type"),
    "fields": ("form_id BIGINT, label STRING", "label"),
}
CORPUS_VIEWS = {
    "labels_by_frequency": "SELECT normalized_label, count(*) AS occurrence_count, count(DISTINCT document_id) AS document_count FROM {db}.label_occurrences GROUP BY normalized_label",
    "pending_promotion_candidates": "SELECT * FROM {db}.label_promotion_candidates WHERE status = 'PENDING'",
    "classification_disagreements": "SELECT a.document_id, a.classifier_version AS version_a, b.classifier_version AS version_b, a.document_type AS type_a, b.document_type AS type_b FROM {db}.document_classifications a JOIN {db}.document_classifications b ON a.document_id = b.document_id AND a.classifier_version < b.classifier_version AND a.document_type <> b.document_type",
    "dictionary_version_summary": "SELECT v.version, v.entry_count, v.built_at, count(e.entry_id) AS actual_entry_count FROM {db}.label_dictionary_versions v LEFT JOIN {db}.label_dictionary_entries e ON e.version = v.version GROUP BY v.version, v.entry_count, v.built_at",
}
REVIEW_VIEWS = {
    "reusable_learning_signals": "SELECT * FROM {db}.fill_review_learning_signals WHERE reusable = 1",
    "failed_writer_patterns": "SELECT * FROM {db}.fill_review_writer_operation_logs WHERE operation_status = 'BLOCKED'",
    "xml_deep_analyzer_backlog": "SELECT * FROM {db}.xml_deep_analyzer_need_flags WHERE resolved = 0",
    "decision_summary_by_label": "SELECT normalized_label, decision, count(*) AS decisions FROM {db}.fill_review_decision_logs GROUP BY normalized_label, decision",
    "learning_signal_summary_by_doc_type": "SELECT document_type, signal_type, count(*) AS signals, sum(reusable) AS reusable FROM {db}.fill_review_learning_signals GROUP BY document_type, signal_type",
}
#: What columns may say, tables' own first.
SEMANTICS = "PROJECT_NAME CONTRACT_AMOUNT START_DATE END_DATE COMPANY_NAME BUSINESS_REGISTRATION_NUMBER REPRESENTATIVE_NAME SITE_MANAGER_NAME ADDRESS PHONE ATTACHMENT_DOCUMENT STAMP_OR_SEAL FREE_TEXT CHECKBOX YES_NO INSPECTION_ITEM MATERIAL_NAME QUANTITY"
ALLOWED = {
    "hwpx_documents.source_kind": "collected repo_sample deliverable unknown", "document_classifications.document_type": "fillable_form reference_table empty_template unknown broken non_hwpx",
    "human_label_decisions.semantic_type": f"{SEMANTICS} UNKNOWN", "human_label_decisions.decision_status": "APPROVED REJECTED HELD", "label_dictionary_entries.semantic_type": SEMANTICS,
    "label_promotion_candidates.status": "PENDING APPROVED REJECTED HELD BLOCKED_CONFLICT BLOCKED_LOW_EVIDENCE", "fill_review_writer_operation_logs.operation_status": "CREATED BLOCKED APPLIED SKIPPED",
}
SHARES = ("document_classifications.confidence", "accuracy_audits.precision", "accuracy_audits.recall", "accuracy_audits.f1")
REQUIRED = ("document_id", "normalized_label", "version")
MIGRATIONS = {1: (CORPUS, CORPUS_VIEWS), 2: (REVIEW, REVIEW_VIEWS), 3: (FORMS, {})}


def checksum(number: int) -> str:
    """SHA-256 of what a migration says, so that a changed one is noticed."""
    return hashlib.sha256(repr(MIGRATIONS[number]).encode()).hexdigest()


def migrate(spark: SparkSession, db: str, location: str | None = None, buckets: int = BUCKETS) -> list[int]:
    """Brings a database up to the last migration and returns the numbers of those that it applied: none if it was there already.

    Tables are Parquet, bucketed and sorted by the column that they are looked up by, so joins on it need no exchange. A migration
    whose checksum differs from the one applied under its number is an error. What stands there is never dropped or written anew.
    """
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}{at}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.schema_versions (version INT, checksum STRING, applied_at TIMESTAMP) USING parquet")
    done = {r.version: r.checksum for r in spark.table(f"{db}.schema_versions").collect()}  # a row for each migration
    applied = []
    for number, (tables, views) in MIGRATIONS.items():
        if done.get(number, checksum(number)) != checksum(number):
            raise ValueError(f"migration {number} isn't the one that was applied")
        if number in done:
            continue
        for name, (columns, key) in tables.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.{name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS")
        for name, body in views.items():
            spark.sql(f"CREATE OR REPLACE VIEW {db}.{name} AS {body.format(db=db)}")
        spark.createDataFrame([(number, checksum(number))], "version int, checksum string").withColumn("applied_at", F.current_timestamp()).coalesce(1).write.insertInto(f"{db}.schema_versions")
        applied.append(number)
    return applied


def missing(spark: SparkSession, db: str) -> list[str]:
    """Names of tables, views and columns (table.column) that the last migration asks for and the database lacks."""
    out = []
    for tables, views in MIGRATIONS.values():
        for name in [*tables, *views]:
            if not spark.catalog.tableExists(f"{db}.{name}"):
                out.append(name)
            elif name in tables:
                have = {c.lower() for c in spark.table(f"{db}.{name}").columns}
                out += [f"{name}.{c.split()[0]}" for c in tables[name][0].split(", ") if c.split()[0] not in have]
    return sorted(out)


def violations(rows: DataFrame, name: str) -> DataFrame:
    """rows with `violation`, those alone that a table refuses: a value that isn't allowed, a share outside 0 to 1, no key."""
    rules = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(v.split()), F.lit(f"{c} not allowed")) for t, c, v in ((*k.split("."), v) for k, v in ALLOWED.items()) if t == name and c in rows.columns]
    rules += [F.when((F.col(c) < 0) | (F.col(c) > 1), F.lit(f"{c} outside 0 to 1")) for t, c in (k.split(".") for k in SHARES) if t == name and c in rows.columns]
    key = next(t[name][1] for t, _ in MIGRATIONS.values() if name in t)
    rules += [F.when(F.col(key).isNull(), F.lit(f"{key} is missing"))] if key in REQUIRED and key in rows.columns else []
    return rows.withColumn("violation", reduce(lambda a, b: F.coalesce(a, b), rules, F.lit(None).cast("string"))).where("violation IS NOT NULL")


def put(spark: SparkSession, db: str, name: str, rows: DataFrame) -> None:
    """Appends rows to a table; columns that they lack are null, others are an error. If a row breaks a rule nothing is written."""
    table = spark.table(f"{db}.{name}")
    if extra := sorted({c.lower() for c in rows.columns} - {c.lower() for c in table.columns}):
        raise ValueError(f"{name} has no {', '.join(extra)}")
    bad = violations(rows, name).head(1)
    if bad:
        raise ValueError(f"{name}: {bad[0].violation}; nothing was written")
    have = {c.lower() for c in rows.columns}
    whole = rows.select(*((F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema))
    key = next(t[name][1] for t, _ in MIGRATIONS.values() if name in t)
    count = spark.sql(f"DESCRIBE EXTENDED {db}.{name}").where("col_name = 'Num Buckets'").first()
    whole.repartition(int(count.data_type), key).write.insertInto(f"{db}.{name}")  # each bucket is one file of each load
