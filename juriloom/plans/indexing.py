"""Incremental indexing: what a scan changes, what must be extracted and indexed again, coverage, and table writes."""

from __future__ import annotations

import os
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.extract import HEADER_END
from ..storage import written

REVISION = 4


def upsert(state: DataFrame, found: DataFrame, scanned: list[str] | None = None, limited: bool = False, key: str = "id") -> DataFrame:
    """The state after a scan: found values over old ones. present is set anew only for scanned sources (all if None), and
    not at all if the scan was limited."""
    fresh = found.withColumn("__f", F.lit(True))
    old = state.withColumn("__s", F.lit(True))
    both = old.alias("o").join(fresh.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    columns = list(dict.fromkeys([*state.columns, *found.columns]))

    def value(c: str) -> Column:
        parts = [F.col(f"n.{c}")] * (c in found.columns) + [F.col(f"o.{c}")] * (c in state.columns)
        return F.coalesce(*parts)

    seen = F.coalesce(F.col("__f"), F.lit(False))
    was = F.coalesce(F.col("o.present"), F.lit(True)) if "present" in state.columns else F.lit(True)
    inside = F.lit(True) if scanned is None else value("source").isin(scanned)
    present = F.when(seen, True).otherwise(was) if limited else F.when(seen, True).when(inside, False).otherwise(was)
    return both.select(*[value(c).alias(c) for c in columns if c != "present"], present.alias("present"))


def eligible(sources: list[str] | None = None, review: bool = False) -> Column:
    """Present (unless said otherwise), no duplicate, of the sources, reviewed ones only if wanted."""
    ok = F.coalesce(F.col("present"), F.lit(True)) & (F.coalesce(F.col("duplicate_of"), F.lit("")) == "")
    if sources is not None:
        ok = ok & F.col("source").isin(sources)
    return ok if review else ok & ~F.coalesce(F.col("requires_review"), F.lit(False))


def ocr_attempted() -> Column:
    return F.coalesce(F.col("ocr_attempted"), F.lit(False)) | (F.coalesce(F.size("ocr_pages"), F.lit(0)) > 0) | F.coalesce(F.exists("warnings", lambda w: w.startswith("OCR ")), F.lit(False))


def ocr_pending() -> Column:
    short = F.col("status").isin("needs_ocr", "insufficient_text") | (F.coalesce(F.size("empty_pages"), F.lit(0)) > 0)
    return (F.lower("extension") == ".pdf") & ~ocr_attempted() & F.coalesce(short, F.lit(False))


def preparation(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """docs with action: extract (new or changed file), refresh (metadata changed), skip; beyond the limit, which header
    refreshes use up first, wait. docs has size_bytes, mtime_ns, metadata_hash and what was prepared of them."""
    changed = ~F.col("size_bytes").eqNullSafe(F.col("prepared_size")) | ~F.col("mtime_ns").eqNullSafe(F.col("prepared_mtime_ns"))
    action = F.when(changed | F.col("extracted_path").isNull(), "extract").when(~F.col("metadata_hash").eqNullSafe(F.col("prepared_metadata_hash")), "refresh").otherwise("skip")
    rows = docs.withColumn("action", action)
    if limit is None:
        return rows
    todo = rows.filter("action != 'skip'").orderBy(F.desc("action"), "ord").limit(limit).select("id", F.lit(True).alias("__go"))
    return rows.join(todo, "id", "left").withColumn("action", F.when((F.col("action") != "skip") & F.col("__go").isNull(), "wait").otherwise(F.col("action"))).drop("__go")


def index_actions(docs: DataFrame, index: DataFrame, revision: int = REVISION) -> DataFrame:
    """(id, action): delete what the index holds of absent and duplicate documents, reindex where text, revision or note
    changed, repair the state where the index already holds the text. index: id, indexed_hash."""
    gone = index.select("id").join(docs.filter(eligible(review=True)).select("id"), "id", "left_anti").select("id", F.lit("delete").alias("action"))
    rows = docs.filter(eligible(review=True) & (F.col("status") == "ready")).join(index.select("id", "indexed_hash"), "id", "left")
    holds = F.col("indexed_hash").eqNullSafe(F.col("extracted_sha256")) & F.col("indexed_hash").isNotNull()
    same = F.col("local_indexed_content_hash").eqNullSafe(F.col("extracted_sha256")) & (F.col("local_index_revision") == revision) & F.col("local_indexed_superseded_note").eqNullSafe(F.col("superseded_note"))
    action = F.when(holds & same, "skip").when(holds & (F.col("local_index_revision") == revision), "repair").otherwise("reindex")
    return gone.unionByName(rows.select("id", action.alias("action")))


def replace_documents(table: DataFrame, fresh: DataFrame, removed: DataFrame, key: str = "document_id") -> DataFrame:
    """A chunk table after documents are replaced or removed; each document's rows change together."""
    touched = fresh.select(key).unionByName(removed.select(key)).distinct()
    return table.join(touched, key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def write_buckets(chunks: DataFrame, path: str, buckets: int = 64, key: str = "document_id") -> None:
    """Write chunk rows by document bucket; with dynamic overwrite only the buckets at hand are replaced."""
    rows = chunks.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def coverage(docs: DataFrame, index: DataFrame) -> DataFrame:
    """One row of counts, and the share of eligible documents whose current text the index holds, in percent."""
    rows = docs.join(index.select("id", "indexed_hash"), "id", "left")
    here = F.coalesce(F.col("present"), F.lit(True))
    single = F.coalesce(F.col("duplicate_of"), F.lit("")) == ""
    ready = F.col("status") == "ready"
    want = here & single & ready
    held = want & F.col("indexed_hash").isNotNull() & (F.col("indexed_hash") == F.col("extracted_sha256"))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = rows.agg(
        F.count(F.lit(1)).alias("documents_total"),
        n(here).alias("documents_present"),
        n(~here).alias("documents_absent"),
        n(~single).alias("documents_duplicate"),
        n(here & ready).alias("documents_ready"),
        n(here & (F.col("status") == "needs_ocr")).alias("documents_needing_ocr"),
        n(here & (F.col("status") == "insufficient_text")).alias("documents_insufficient"),
        n(here & (F.col("status") == "error")).alias("documents_failed"),
        n(here & F.coalesce(F.col("superseded_note") != "", F.lit(False))).alias("documents_superseded"),
        n(want).alias("eligible_documents"),
        n(held).alias("covered_documents"),
        F.coalesce(F.sum(F.when(here, F.col("size_bytes"))), F.lit(0)).cast("bigint").alias("bytes_present"),
    )
    share = F.when(F.col("eligible_documents") > 0, F.round(100.0 * F.col("covered_documents") / F.col("eligible_documents"), 2)).otherwise(F.lit(0.0))
    return counts.withColumn("coverage_percent", share)


def summary(docs: DataFrame, index: DataFrame, chunks: DataFrame, graph_stats: DataFrame | None = None, revision: int = REVISION) -> DataFrame:
    """One row: the counts of the present records by state and by what the local and the remote index hold of them, in the
    names of a status report. docs: id, source, present, status, requires_review, duplicate_of, extension, ocr_attempted,
    ocr_pages, warnings, empty_pages, extracted_sha256, sha256, local_index_revision, remote_file_id, remote_hash; index: id,
    indexed_hash; chunks: document_id."""
    rows = docs.filter(F.coalesce("present", F.lit(True))).join(index.select("id", "indexed_hash"), "id", "left")
    review = F.coalesce("requires_review", F.lit(False))
    copy = F.coalesce("duplicate_of", F.lit("")) != ""
    remote = F.coalesce("remote_file_id", F.lit("")) != ""
    current = F.coalesce(F.col("local_index_revision") == revision, F.lit(False))
    wanted = F.coalesce(F.nullif("extracted_sha256", F.lit("")), F.nullif("sha256", F.lit("")))
    is_in = lambda *s: F.coalesce(F.col("status").isin(*s), F.lit(False))
    eligible_ = ~copy & is_in("ready") & (~review | remote | current)
    local = eligible_ & F.coalesce(F.col("indexed_hash") == wanted, F.lit(False)) & current
    far = eligible_ & remote & F.coalesce(F.col("remote_hash") == wanted, F.lit(False))
    n = F.count_if
    counts = rows.agg(
        F.count(F.lit(1)).alias("discovered"),
        n(is_in("ready", "needs_ocr", "insufficient_text")).alias("prepared"),
        n(is_in("ready")).alias("ready"),
        n(is_in("needs_ocr")).alias("needs_ocr"),
        n(~review & ocr_pending()).alias("ocr_pending"),
        n(review & ocr_pending()).alias("ocr_pending_review_required"),
        n(~review & ocr_attempted() & is_in("needs_ocr", "insufficient_text")).alias("ocr_attempted_unresolved"),
        n(is_in("insufficient_text")).alias("insufficient_text"),
        n(review).alias("review_required"),
        n(is_in("error")).alias("errors"),
        n(far).alias("indexed"),
        n(local).alias("locally_indexed"),
        n(eligible_).alias("eligible"),
        n(local).alias("local_covered"),
        (n(eligible_) - n(local)).alias("local_missing"),
        n(far).alias("remote_covered"),
        (n(eligible_) - n(far)).alias("remote_missing"),
        n(copy).alias("duplicates"),
    )
    share = lambda c: F.when(F.col("eligible") > 0, F.round(100.0 * F.col(c) / F.col("eligible"), 2)).otherwise(F.lit(0.0))
    counts = counts.withColumns({"local_coverage_percent": share("local_covered"), "remote_coverage_percent": share("remote_covered")})
    by_source = rows.groupBy(F.coalesce("source", F.lit("unknown")).alias("s")).agg(F.count(F.lit(1)).alias("c")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "c")))).alias("by_source"))
    held = chunks.agg(F.count_distinct("document_id").alias("local_index_documents"), F.count(F.lit(1)).alias("local_chunks"))
    out = counts.crossJoin(by_source).crossJoin(held)  # one row each
    return out if graph_stats is None else out.crossJoin(graph_stats)


def metadata_hash(header: Column) -> Column:
    """The fingerprint of what a catalogue says of a document, as its header line has it."""
    return F.sha2(header, 256)


def prepare(docs: DataFrame, extracted: DataFrame, header: Column, limit: int | None = None) -> DataFrame:
    """docs after a preparation: what changed is taken from extracted (id, text, status, character_count, page_count), of what only
    changed in its metadata the header (as extract.header() makes it) is replaced and the body stays, the rest is as it was. docs: preparation()'s columns
    and text, status, character_count, page_count, prepared_size, prepared_mtime_ns, prepared_metadata_hash."""
    marked = preparation(docs.withColumn("metadata_hash", metadata_hash(header)), limit).withColumn("__header", header)
    fresh = extracted.select("id", *(F.col(c).alias(f"__{c}") for c in ("text", "status", "character_count", "page_count")))
    rows = marked.join(fresh, "id", "left")
    got, again = (F.col("action") == "extract") & F.col("__status").isNotNull(), F.col("action") == "refresh"
    body = lambda t: F.when(F.instr(t, HEADER_END) > 0, F.substring(t, F.instr(t, HEADER_END) + len(HEADER_END), F.length(t))).otherwise(t)
    text = F.when(got, F.concat("__header", F.lit("\n"), "__text")).when(again, F.concat("__header", body(F.col("text")))).otherwise(F.col("text"))
    done = got | again
    changes = {c: F.when(got, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("status", "character_count", "page_count")}
    changes |= {"text": text, "prepared_metadata_hash": F.when(done, F.col("metadata_hash")).otherwise(F.col("prepared_metadata_hash"))}
    changes |= {f"prepared_{a}": F.when(got, F.col(b)).otherwise(F.col(f"prepared_{a}")) for a, b in (("size", "size_bytes"), ("mtime_ns", "mtime_ns"))}
    changes |= {"extracted_path": F.when(got, F.coalesce("extracted_path", F.col("id").cast("string"))).otherwise(F.col("extracted_path")), "extracted_sha256": F.when(done, F.sha2(text, 256)).otherwise(F.col("extracted_sha256"))}
    return rows.withColumns(changes).drop("__header", *fresh.columns[1:])


def apply_index(docs: DataFrame, index: DataFrame, chunks: DataFrame, segment: Callable[[DataFrame], DataFrame], revision: int = REVISION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, index, chunks) after the index_actions(): documents to delete lose their chunks, those to reindex get new ones from
    segment(document_id, text), the state of those to repair is set right. Each document's rows change together."""
    todo = written(index_actions(docs, index, revision), "index-actions")
    changed = docs.join(todo.filter("action = 'reindex'").select("id"), "id", "left_semi")
    gone = todo.filter("action = 'delete'").select(F.col("id").alias("document_id"))
    fresh = segment(changed.select(F.col("id").alias("document_id"), "text"))
    held = index.join(todo.filter("action in ('delete', 'reindex')").select("id"), "id", "left_anti").unionByName(changed.select("id", F.col("extracted_sha256").alias("indexed_hash")))
    set_right = F.col("action").isin("reindex", "repair")
    rows = docs.join(todo, "id", "left")
    state = {"local_indexed_content_hash": "extracted_sha256", "local_indexed_superseded_note": "superseded_note"}
    rows = rows.withColumns({a: F.when(set_right, F.col(b)).otherwise(F.col(a)) for a, b in state.items()} | {"local_index_revision": F.when(set_right, revision).otherwise(F.col("local_index_revision"))})
    touched = gone.unionByName(changed.select(F.col("id").alias("document_id")))
    return rows.drop("action"), held, replace_documents(chunks, fresh, touched)


def content_hashes(index: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(id, indexed_hash) of what the index really holds; nothing where there is none."""
    return index.select("id", "indexed_hash") if index is not None else spark.createDataFrame([], "id string, indexed_hash string")


def merge_mirrors(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs with duplicate_of set by a plan (canonical, duplicate), and mirrors of the canonical copies: distinct addresses."""
    marks = plan.select(F.col("duplicate").alias("id"), F.col("canonical").alias("__c"))
    other = docs.select(F.col("id").alias("duplicate"), F.struct("source", "source_label", "source_url").alias("m"))
    gathered = plan.join(other, "duplicate").filter("m.source_url != ''").groupBy(F.col("canonical").alias("id"), F.col("m.source_url").alias("u")).agg(F.min("m").alias("m")).groupBy("id").agg(F.array_sort(F.collect_list("m")).alias("mirrors"))
    rows = docs.join(marks, "id", "left").join(gathered, "id", "left")
    return rows.withColumn("duplicate_of", F.coalesce("__c", "duplicate_of")).drop("__c")


def latest(versions: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The last version of each record of an append-only state table."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return versions.withColumn("__r", newest).filter("__r = 1").drop("__r")


@contextmanager
def single_writer(path: str):
    """An exclusive lock file of the driver; a second writer fails at once."""
    handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    try:
        os.write(handle, str(os.getpid()).encode())
        yield
    finally:
        os.close(handle)
        os.unlink(path)
