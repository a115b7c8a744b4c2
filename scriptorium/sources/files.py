"""Readers and writers: file indexes, texts, quality lists, registers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = "id title mimeType fileExtension createdTime modifiedTime viewUrl owner parentId parent_path text_file read_status read_error"
FILE_RECORD = T.StructType([T.StructField(n, T.StringType()) for n in _STRINGS.split()])
for _name, _type in (("fileSize", T.LongType()), ("text_chars", T.LongType()), ("is_folder", T.BooleanType()), ("study_order", T.IntegerType())):
    FILE_RECORD = FILE_RECORD.add(_name, _type)


def read_file_index(spark: SparkSession, *folders: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) records of JSON-lines folders; earlier folders win, then file and content order; records without id all stay."""
    schema = T.StructType([*FILE_RECORD.fields, T.StructField("_bad", T.StringType())])
    parts = None
    for i, folder in enumerate(folders):
        record = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")
        part = spark.read.text(folder).select(record, F.col("_metadata.file_name").alias("_file")).select("r.*", "_file").withColumn("_priority", F.lit(i))
        parts = part if parts is None else parts.unionByName(part)
    bad = parts.where("_bad IS NOT NULL").select("_file", "_bad")
    ok = parts.where("_bad IS NULL").drop("_bad").withColumn("_pos", F.monotonically_increasing_id())
    w = Window.partitionBy("id").orderBy("_priority", "_file", "_pos")
    first = ok.where("id IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.unionByName(ok.where("id IS NULL")).drop("_priority", "_file", "_pos"), bad


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text): one row for each file, the id is the file's stem."""
    return spark.read.text(folder, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("id"), F.col("value").alias("text"))


def attach_text(files: DataFrame, repaired: DataFrame, raw: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Adds text to files(id, text_file): repaired(id, text) before the file that text_file names in named(text_file, text), before raw(id, text), else empty.

    An empty text that is there counts; a null one doesn't. Ids and names are unique in the tables of texts.
    """
    a, b = repaired.select("id", F.col("text").alias("_a")), raw.select("id", F.col("text").alias("_b"))
    out = files.join(a, "id", "left").join(b, "id", "left")
    if named is None:
        out = out.withColumn("_c", F.lit(None).cast("string"))
    else:
        out = out.join(named.select("text_file", F.col("text").alias("_c")), "text_file", "left")
    return out.select(*[c for c in files.columns if c != "text"], F.coalesce("_a", "_c", "_b", F.lit("")).alias("text"))


def enrich(files: DataFrame, meta: DataFrame, folders: DataFrame, repaired: DataFrame, raw: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """An index with what other tables know: fields that are null are filled from meta(id, ...), folder ids become titles, and texts are attached.

    Columns of meta that files lacks are added. Ids are unique in meta, which may lack some; a null id is enriched by nothing.
    """
    new = [c for c in meta.columns if c != "id"]
    known = meta.select("id", *[F.col(c).alias(f"_m_{c}") for c in new])
    both = files.join(known, "id", "left")
    filled = both.select(*[F.coalesce(c, f"_m_{c}").alias(c) if c in new else F.col(c) for c in files.columns], *[F.col(f"_m_{c}").alias(c) for c in new if c not in files.columns])
    return attach_text(resolve_paths(filled, folders), repaired, raw, named)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, extension, size, modified) of all files below root; contents are not read. Empty files are not listed, as by all file sources."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def resolve_paths(files: DataFrame, folders: DataFrame) -> DataFrame:
    """parent_path becomes the folder's title from folders(id, title) where it is empty or an id."""
    f = folders.select(F.col("id").alias("_id"), F.col("title").alias("_title"))
    key = F.when((F.coalesce("parent_path", F.lit("")) == "") | (F.col("parent_path") == F.col("parentId")), F.col("parentId")).otherwise(F.col("parent_path"))
    return files.withColumn("_key", key).join(f, F.col("_key") == F.col("_id"), "left").withColumn("parent_path", F.coalesce("_title", "parent_path")).drop("_key", "_id", "_title")


_MAPS, _LISTS = ("parties", "other_actors", "courts"), {"company_patterns": "company", "deed_numbers_known": "deed"}
CASE_CONFIG = (
    "case struct<number:string,other_numbers:array<string>,title:string,case_folder_name:string>, deed_numbers_known array<string>, company_patterns array<string>, " + ", ".join(f"{k} map<string,array<string>>" for k in _MAPS)
)
LEXICON = "kind string, label string, pattern string, ord int"


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(kind, label, pattern, ord) from a case configuration in JSON.

    Kinds: parties, other_actors and courts (labels with patterns), company and deed (patterns, which are their own labels), case
    (the case's number, then its other numbers), title and folder. `ord` is the place in the file. A file that is no JSON, and
    kinds that it lacks, give no rows.
    """
    conf = spark.read.text(path, wholetext=True).select(F.from_json("value", CASE_CONFIG).alias("c"))
    case, none = F.col("c.case"), F.array().cast("array<string>")
    entry = lambda kind, label, pattern, i: F.struct(F.lit(kind).alias("kind"), label.alias("label"), pattern.alias("pattern"), i.cast("int").alias("ord"))
    rows = [_labelled(kind, entry) for kind in _MAPS]
    plain = [(kind, F.col(f"c.{field}")) for field, kind in _LISTS.items()]
    plain += [("case", F.when(case["number"].isNotNull(), F.concat(F.array(case["number"]), F.coalesce(case["other_numbers"], none)))), ("title", F.array(case["title"])), ("folder", F.array(case["case_folder_name"]))]
    rows += [_listed(kind, values, entry) for kind, values in plain]
    every = F.flatten(F.array(*[F.coalesce(r, F.array().cast("array<struct<kind:string,label:string,pattern:string,ord:int>>")) for r in rows]))
    return conf.select(F.explode(every).alias("r")).select("r.*").where("pattern IS NOT NULL")


def _labelled(kind: str, entry) -> Column:
    return F.flatten(F.transform(F.map_entries(F.col(f"c.{kind}")), lambda e, i: F.transform(e["value"], lambda p: entry(kind, e["key"], p, i))))


def _listed(kind: str, values: Column, entry) -> Column:
    return F.transform(values, lambda p, i: entry(kind, p, p, i))


def load_lexicons(spark: SparkSession, paths: Sequence[str], defaults: DataFrame | None = None) -> DataFrame:
    """The lexicon (kind, label, pattern, ord) of a case: defaults, but for the kinds that the configuration has.

    Of several paths the first one that exists and holds a JSON object counts. A kind that is present there replaces the default
    rows of that kind, even by none (an empty list); kinds that it lacks keep theirs.
    """
    defaults = spark.createDataFrame([], LEXICON) if defaults is None else defaults.select("kind", "label", "pattern", F.col("ord").cast("int").alias("ord"))
    names = {**{k: k for k in _MAPS}, **_LISTS}
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            continue
        conf = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$").rlike(r"^\s*\{").alias("good"), F.from_json("value", CASE_CONFIG).alias("c"))
        here = conf.select("good", *[F.col(f"c.{f}").isNotNull().alias(kind) for f, kind in names.items()], F.col("c.case.number").isNotNull().alias("case"), F.col("c.case.title").isNotNull().alias("title"), F.col("c.case.case_folder_name").isNotNull().alias("folder")).first()
        if here is None or not here.good:
            continue
        present = [k for k, v in here.asDict().items() if v and k != "good"]
        return defaults.where(~F.col("kind").isin(present)).unionByName(read_lexicon(spark, path))
    return defaults


#: What a quality list's header names hold, by field.
QC_HEADERS = {"title": "الملف", "status": "الحالة", "reversed_lines": "معكوس", "words": "كلمات"}


def read_qc(spark: SparkSession, path: str, headers: dict[str, str] = QC_HEADERS) -> DataFrame:
    """(title, status, reversed_lines, words) of quality lists in CSV, whose columns are found by parts of their names.

    The first column whose name holds a field's part is it, wherever it stands; a field without a column is null (0 for
    reversed_lines, which keeps its digits alone). Titles are trimmed, rows without one left out; of equal titles the last row counts.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    column = lambda part: next((F.col(f"`{c}`") for c in raw.columns if part in c), F.lit(None).cast("string"))
    rows = raw.withColumn("_row", F.monotonically_increasing_id()).select("_row", *[column(part).alias(name) for name, part in headers.items()]).where("title IS NOT NULL")
    digits = F.coalesce(F.expr("try_cast(regexp_replace(reversed_lines, '[^0-9]', '') AS int)"), F.lit(0))
    rows = rows.select("_row", F.trim("title").alias("title"), "status", digits.alias("reversed_lines"), "words")
    last = rows.groupBy("title").agg(F.max_by(F.struct("status", "reversed_lines", "words"), "_row").alias("r"))
    return last.select("title", "r.*")


def write_register(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Every register row says that it was made by a script and needs a reader."""
    out = df.withColumns({"made_by": F.lit("script"), "needs_review": F.lit(True)})
    (out.write.mode("overwrite").option("header", True).csv(path) if fmt == "csv" else out.write.mode("overwrite").format(fmt).save(path))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents from JSON lines; the schema is given, so that nothing is read to guess it."""
    return spark.read.schema(schema).json(path)


def write_documents(docs: DataFrame, path: str, fmt: str = "parquet") -> None:
    docs.write.mode("overwrite").format(fmt).save(path)


def write_audit_json(files: DataFrame, path: str, aggregates: dict[str, DataFrame] | None = None, **meta: str) -> None:
    """JSON lines of each file's audit (path/files), of each aggregate under its name, and one row that says how they were made (path/meta)."""
    for name, df in {"files": files, **(aggregates or {})}.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    files.sparkSession.createDataFrame([{"made_by": "script", "needs_review": "true", **meta}]).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
