"""File scans and catalogues: which documents there are, and what the catalogues say of them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import document_id, file_key, first_value, title_from_stem
from ..functions.vocabulary import OBSOLETE_MARK

# The names that catalogues use for what a document record holds, by preference.
TITLE_FIELDS = ["full_name", "title", "name", "document_title"]
CATEGORY_FIELDS = ["category", "type", "document_type"]
DATE_FIELDS = ["date_publication", "published_date", "date", "publication_date"]
URL_FIELDS = ["source_url", "url", "pdf_url", "link"]
FILE_FIELDS = ["pdf_filename", "filename", "local_path", "relative_path", "file"]


@dataclass(frozen=True)
class Source:
    id: str
    label: str
    paths: list[str]
    catalogs: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=lambda: [".pdf", ".docx", ".xlsx", ".txt", ".md", ".csv"])
    review_extensions: list[str] = field(default_factory=list)
    review_all: bool = False
    excluded: list[str] = field(default_factory=list)
    superseded: dict[str, str] = field(default_factory=dict)
    title_overrides: dict[str, str] = field(default_factory=dict)
    enabled: bool = True


def read_sources(text: str) -> list[Source]:
    """Sources of a configuration, JSON text {"sources": [...]}, in order."""
    names = {"excluded_filenames": "excluded", "superseded_filenames": "superseded"}
    known = set(Source.__dataclass_fields__)
    rows = [{names.get(k, k): v for k, v in s.items()} for s in json.loads(text)["sources"]]
    return [Source(**{"label": r["id"]} | {k: v for k, v in r.items() if k in known}) for r in rows]


def read_catalog(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV catalogue, all columns text, a byte-order mark off the first name."""
    df = spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def catalog_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of several catalogues, one after the other, with ord: the place of the catalogue, then that of the row. Each is
    read as UTF-8 if it is that, else as Windows-1252; columns that one lacks are null; catalogues that are not there are
    passed over."""
    out = None
    for place, path in enumerate(paths):
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            continue
        valid = spark.read.format("binaryFile").load(path).agg(F.bool_and(F.expr("is_valid_utf8(cast(content as string))"))).first()[0]
        rows = read_catalog(spark, path, "UTF-8" if valid else "ISO-8859-1")
        if not valid:
            # Windows-1252 is that but for the characters where the other has control codes.
            pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
            old, new = ("".join(x) for x in zip(*(p for p in pairs if p[1]), strict=True))
            rows = rows.select(*[F.translate(c, old, new).alias(c.translate(str.maketrans(old, new))) for c in rows.columns])
        rows = rows.withColumn("ord", F.lit(place << 40) + F.monotonically_increasing_id())
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "filename string, ord long")


def list_files(spark: SparkSession, path: str, source: Source | None = None) -> DataFrame:
    """(path, modificationTime, length, requires_review) of the files below a path that have one of the source's extensions
    (all without a source); contents are not read. Hidden files and temporary ones of office programs are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    if source is None:
        return files
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    known = [e.lower() for e in (*source.extensions, *source.review_extensions)]
    review = F.lit(source.review_all) | extension.isin([e.lower() for e in source.review_extensions])
    return files.filter(extension.isin(known) & ~name.startswith("~$") & ~name.startswith(".")).withColumn("requires_review", review)


def _fields(df: DataFrame, names: list[str]) -> Column:
    have = [F.col(n) for n in names if n in df.columns]
    return first_value(*have) if have else F.lit("")


def catalog_entries(catalog: DataFrame, ord: str = "ord") -> DataFrame:
    """(file_key, cat_title, category, published_date, source_url): the first catalogue row of each file name."""
    rows = catalog.select(file_key(_fields(catalog, FILE_FIELDS)).alias("file_key"), _fields(catalog, TITLE_FIELDS).alias("cat_title"), _fields(catalog, CATEGORY_FIELDS).alias("cat_category"), _fields(catalog, DATE_FIELDS).alias("published_date"), _fields(catalog, URL_FIELDS).alias("source_url"), F.col(ord).alias("__o"))
    rows = rows.filter("file_key != ''")
    columns = ["cat_title", "cat_category", "published_date", "source_url"]
    return rows.groupBy("file_key").agg(F.min_by(F.struct(*columns), "__o").alias("e")).select("file_key", "e.*")


def catalog_files(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Catalogue-driven resolution: of each row's candidate paths, in order, the first that exists; each path once.
    candidates: row_ord, paths (array); files: path."""
    rows = candidates.select("row_ord", F.posexplode("paths").alias("k", "path")).join(files.select("path"), "path", "left_semi")
    first = rows.groupBy("row_ord").agg(F.min_by("path", "k").alias("path"))
    return first.groupBy(F.lower("path").alias("path_key")).agg(F.min_by("path", "row_ord").alias("path"), F.min("row_ord").alias("row_ord"))


def discover(files: DataFrame, entries: DataFrame, overrides: DataFrame | None = None, superseded: DataFrame | None = None, excluded: list[str] | None = None) -> DataFrame:
    """Document records of files (source, relative_path, size_bytes, mtime_ns, requires_review): each path once, catalogue
    values where there are any, titles overridden and marked obsolete by file name, category from the first folder."""
    rows = files.withColumn("filename", F.element_at(F.split("relative_path", "/"), -1)).withColumn("file_key", file_key("relative_path"))
    if excluded:
        rows = rows.filter(~F.col("file_key").isin([e.lower() for e in excluded]))
    rows = rows.withColumn("__path", F.lower("relative_path"))
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("source", "__path").orderBy("relative_path"))).filter("__r = 1").drop("__r", "__path")
    rows = rows.join(entries, "file_key", "left")
    for table, name in ((overrides, "override"), (superseded, "note")):
        rows = rows.join(table.select(F.lower("filename").alias("file_key"), F.col(name)), "file_key", "left") if table is not None else rows.withColumn(name, F.lit(None).cast("string"))
    title = first_value(F.col("override"), F.col("cat_title"), title_from_stem("filename"))
    title = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(f"{OBSOLETE_MARK}] "), title)).otherwise(title)
    folder = F.when(F.col("relative_path").contains("/"), F.element_at(F.split("relative_path", "/"), 1)).otherwise("")
    return rows.select(
        document_id(F.concat_ws("/", "source", "relative_path")).alias("id"),
        "source",
        title.alias("title"),
        first_value(F.col("cat_category"), folder).alias("category"),
        F.coalesce("published_date", F.lit("")).alias("published_date"),
        F.coalesce("source_url", F.lit("")).alias("source_url"),
        F.coalesce("note", F.lit("")).alias("superseded_note"),
        "relative_path",
        "filename",
        F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1)).alias("extension"),
        "requires_review",
        "size_bytes",
        "mtime_ns",
    )


def source_summary(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of each configured source, none counted as 0."""
    counts = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sources.join(counts, sources["id"] == counts["source"], "left").select("id", F.coalesce("n", F.lit(0)).alias("document_count"))


def check_manifest(manifest: DataFrame) -> DataFrame:
    """The rows of a manifest that break a rule, with the rule: base names ending in .pdf, https addresses, 64 hexadecimal
    digits of SHA-256, file names and hashes unique."""
    once = lambda c: F.count(F.lit(1)).over(Window.partitionBy(F.lower(c))) == 1
    rules = [
        ("filename", ~F.col("filename").rlike(r"^[^/\\]+\.[pP][dD][fF]$") | F.col("filename").isNull()),
        ("title", F.coalesce(F.trim("title"), F.lit("")) == ""),
        ("source_url", ~F.coalesce("source_url", F.lit("")).rlike("^https://[^/]+/")),
        ("sha256", ~F.coalesce("sha256", F.lit("")).rlike("^[0-9a-fA-F]{64}$")),
        ("duplicate filename", ~once("filename")),
        ("duplicate sha256", ~once("sha256")),
    ]
    rows = manifest.select("*", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules])).alias("broken"))
    return rows.filter(F.size("broken") > 0)


MANIFEST_FIELDS = {"filename": ["pdf_filename", "filename"], "title": ["full_name", "title"], "source_url": ["source_url", "url"], "sha256": ["sha256"]}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(filename, title, source_url, sha256) of a manifest. One that breaks a rule of check_manifest(), lacks a column or has no rows
    is refused as a whole."""
    rows = read_catalog(spark, path)
    lacking = [name for name, names in MANIFEST_FIELDS.items() if not set(names) & set(rows.columns)]
    if lacking:
        raise ValueError(f"the manifest {path} has no column for {', '.join(lacking)}")
    rows = rows.select(*[_fields(rows, names).alias(name) for name, names in MANIFEST_FIELDS.items()]).withColumn("sha256", F.lower("sha256"))
    broken = check_manifest(rows).select("filename", "broken").limit(10).collect()
    if broken:
        raise ValueError("; ".join(f"{r['filename']}: {', '.join(r['broken'])}" for r in broken))
    if rows.isEmpty():
        raise ValueError(f"the manifest {path} has no documents")
    return rows


def record_targets(state: DataFrame, root: str) -> DataFrame:
    """(id, path): the paths, without . and .. and doubled slashes, under which a record's file is known."""
    joined = F.when(F.coalesce("relative_path", F.lit("")) != "", F.concat_ws("/", F.lit(root.rstrip("/")), "relative_path"))
    paths = F.array_compact(F.array(F.nullif("absolute_path", F.lit("")), joined))
    clean = lambda p: F.regexp_replace(F.regexp_replace(p, r"/(?:\./|/)+", "/"), r"/[^/]+/\.\.(?=/)", "")
    return state.select("id", F.explode(F.array_distinct(F.transform(paths, clean))).alias("path"))


def sync_state(exists: Column, valid: Column, mode: Column) -> Column:
    """What a synchronization run does with a manifest row, by mode (check, dry-run, sync)."""
    return F.when(exists & valid, "verified").when(mode == "check", F.when(exists, "invalid").otherwise("missing")).when(mode == "dry-run", F.when(exists, "would-replace").otherwise("would-download")).otherwise("downloaded")


def valid_pdf(content: Column, sha256: Column) -> Column:
    return (F.substring(content, 1, 5) == F.lit(b"%PDF-")) & (F.sha2(content, 256) == F.lower(sha256))


def sha_conflicts(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """Manifest rows whose contents are known under another path. manifest: sha256, target; state: sha256, path."""
    known = state.select(F.lower("sha256").alias("sha256"), "path")
    return manifest.withColumn("sha256", F.lower("sha256")).join(known, "sha256").filter("path != target")
