"""Sources by type. A source makes canonical documents; pulling over a network is left to connectors outside the engine."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.references import image_references, resolved_images
from ..functions.text import strip
from ..operators.canonical import canonical_documents
from .schema import CALENDAR, CANONICAL, RAW_COMMENTS, RAW_ITEM, TABLES

log = logging.getLogger(__name__)


class Source(Protocol):
    def canonicalize(self, spark: SparkSession) -> DataFrame: ...


_TYPES: dict[str, Callable[[Mapping], Source]] = {}


def register_source(name: str):
    def add(make):
        _TYPES[name] = make
        return make

    return add


def build_sources(configs: Sequence[Mapping]) -> list[Source]:
    """The enabled ones; a type that isn't known is left out with a warning."""
    out = []
    for c in configs:
        if not c.get("enabled", True):
            continue
        if c["type"] not in _TYPES:
            log.warning("no source of type %s", c["type"])
            continue
        out.append(_TYPES[c["type"]](c))
    return out


def conformed(df: DataFrame) -> DataFrame:
    """Any documents with all canonical columns, in order; what is missing is null. A column ``ingest_order`` stays as well."""
    order = [F.col("ingest_order").cast("bigint").alias("ingest_order")] if "ingest_order" in df.columns else []
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CANONICAL], *order)


#: Documents of one source that have an order of their own.
_OWN_ORDER = 1 << 40


def collect(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """The documents of all sources, with column ingest_order: by source as they are named, then by the order that a source
    gives its documents. A source that isn't implemented is left out with a warning.
    """
    parts = []
    for i, s in enumerate(sources):
        try:
            docs = conformed(s.canonicalize(spark))
        except NotImplementedError as e:
            log.warning("%s: %s", type(s).__name__, e)
            continue
        own = F.coalesce("ingest_order", F.lit(_OWN_ORDER - 1)) if "ingest_order" in docs.columns else F.lit(_OWN_ORDER - 1)
        parts.append(docs.withColumn("ingest_order", F.lit(i * _OWN_ORDER).cast("bigint") + F.least(own, F.lit(_OWN_ORDER - 1))))
    return reduce(DataFrame.unionByName, parts, conformed(spark.createDataFrame([], "source_id string, ingest_order bigint")))


def _stem(path):
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


@register_source("issues")
class IssueSource:
    """Raw issues and change requests: a JSON file each under issues/ and prs/, a list of comments under comments/."""

    def __init__(self, config: Mapping):
        self.path, self.repo, self.component = config["path"], config["repo"], config["component"]
        self.specs = config.get("components", {})

    def canonicalize(self, spark: SparkSession) -> DataFrame:
        read = lambda kind, schema: spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(f"{self.path}/{kind}")
        raw = read("issues", RAW_ITEM).withColumn("is_pr", F.col("pull_request").isNotNull()).unionByName(read("prs", RAW_ITEM).withColumn("is_pr", F.lit(True)))
        items = raw.select("number", "title", "body", F.filter("labels.name", lambda x: F.coalesce(x, F.lit("")) != "").alias("labels"), "state", "created_at", "updated_at", "closed_at", "html_url", "is_pr", F.col("pull_request.merged").alias("merged"), F.col("pull_request.merged_at").alias("merged_at"))
        comments = read("comments", RAW_COMMENTS).select(_stem(F.input_file_name()).try_cast("bigint").alias("number"), F.monotonically_increasing_id().alias("position"), F.col("user.login").alias("login"), "created_at", "body")
        return canonical_documents(items, comments, self.repo, self.component, self.specs)


@register_source("markdown")
class MarkdownSource:
    """Markdown files; the title is the first heading, else the file's name. Images are listed, not fetched.

    ``assets`` maps local references to stored copies: the body points to those, other local images count as missing.
    """

    def __init__(self, config: Mapping):
        self.path, self.component, self.assets = config["path"], config.get("component", "doc"), config.get("assets", {})

    def canonicalize(self, spark: SparkSession) -> DataFrame:
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown}").text(self.path, wholetext=True)
        name = _stem(F.input_file_name())
        known = F.create_map(*[F.lit(x) for pair in self.assets.items() for x in pair]).cast("map<string,string>") if self.assets else F.create_map().cast("map<string,string>")
        heading = F.nullif(strip(F.regexp_extract(F.col("value"), r"(?:^|\n)#[ \t]+([^\n]+)", 1)), F.lit(""))
        return files.select(
            F.lit("doc").alias("source_type"), F.concat(F.lit("markdown:"), name).alias("source_id"), F.input_file_name().alias("url"), F.coalesce(heading, name).alias("title"), resolved_images(F.col("value"), known).alias("body"), F.lit("open").alias("status"),
            F.lit(self.component).alias("component"), F.lit("unverified").alias("verification"), F.create_map(F.lit("images"), F.to_json(image_references(F.col("value")))).alias("extra"),
        )


def markdown_table(rows):
    """A Markdown table of array<array<string>>: the first row is the head, short rows are filled up, cells are one line."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    lines = F.transform(rows, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")).otherwise("")


@register_source("parsed_tables")
class ParsedTables:
    """Manuals that a parser outside the engine turned into tables: a document each, its tables as Markdown."""

    def __init__(self, config: Mapping):
        self.path, self.component = config["path"], config.get("component", "doc")

    def canonicalize(self, spark: SparkSession) -> DataFrame:
        files = spark.read.schema(TABLES).option("multiLine", True).option("pathGlobFilter", "*.tables.json").json(self.path)
        tables = F.array_join(F.transform(F.coalesce("tables", F.array().cast(files.schema["tables"].dataType)), lambda t: markdown_table(t["rows"])), "\n\n")
        # the text layer, by pages or sections, comes before the tables; encrypted files and those without either are left out
        sections = F.array_join(F.transform("sections", lambda x: F.concat_ws("\n\n", F.when(F.coalesce(x["title"], F.lit("")) != "", F.concat(F.lit("## "), x["title"])), x["text"])), "\n\n")
        body = F.concat_ws("\n\n", F.nullif(strip(F.coalesce("text", F.lit(""))), F.lit("")), F.nullif(sections, F.lit("")), F.nullif(tables, F.lit("")))
        return files.where(~F.coalesce("encrypted", F.lit(False))).withColumn("body", body).where("body <> ''").select(
            F.lit("doc_pdf").alias("source_type"), F.concat(F.lit("tables:"), "source").alias("source_id"), F.col("source").alias("title"), "body",
            F.lit("open").alias("status"), F.lit(self.component).alias("component"), F.lit("expert").alias("verification"),
        )


@register_source("excel")
class ExcelSource:
    """Named, but not supported."""

    def __init__(self, config: Mapping):
        self.path = config.get("path")

    def canonicalize(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError("sheets are not supported")


def calendars(spark: SparkSession, path: str) -> DataFrame:
    """repo, tag, date, kind, prerelease of all calendar files: with a list of releases, or (the older form) tags with their
    dates. A broken file, or an entry without a tag or a readable date, is left out.
    """
    texts = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    new = texts.select(F.from_json("v", CALENDAR).alias("c")).where("c.releases is not null").select("c.repo", F.explode("c.releases").alias("r")).select("repo", "r.tag", "r.date", "r.kind", "r.prerelease")
    flat = texts.select(F.from_json("v", "map<string,string>").alias("m")).where(F.col("m").isNotNull() & ~F.map_contains_key("m", "releases"))
    old = flat.select(F.try_element_at("m", F.lit("repo")).alias("repo"), F.explode("m").alias("tag", "date")).where("tag not in ('repo', 'generated_at')")
    rows = new.unionByName(old.select("repo", "tag", "date", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("boolean").alias("prerelease")))
    return rows.select("repo", "tag", F.try_to_timestamp("date").alias("date"), "kind", "prerelease").where("date is not null and coalesce(tag, '') <> ''")


def releases(raw: DataFrame) -> DataFrame:
    """tag, date, prerelease, kind of raw releases (tag_name, published_at, prerelease, draft), newest first; drafts are left out."""
    from ..functions.versions import version_kind

    rows = raw.where("not coalesce(draft, false) and tag_name is not null")
    return rows.select(F.col("tag_name").alias("tag"), F.try_to_timestamp("published_at").alias("date"), F.coalesce("prerelease", F.lit(False)).alias("prerelease"), version_kind(F.col("tag_name")).alias("kind")).orderBy(F.desc_nulls_last("date"), "tag")


def calendar_of(repo: str, rows: DataFrame) -> DataFrame:
    """One row as a calendar file has it: repo and the list of releases, newest first."""
    each = F.struct(F.col("date").alias("d"), "tag", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), "prerelease", "kind")
    listed = F.reverse(F.array_sort(F.collect_list(each)))
    return rows.agg(F.transform(listed, lambda r: F.struct(r["tag"].alias("tag"), r["date"].alias("date"), r["prerelease"].alias("prerelease"), r["kind"].alias("kind"))).alias("releases")).select(F.lit(repo).alias("repo"), "releases")


def companion_matrix(spark: SparkSession, path: str, components: Sequence[str]) -> DataFrame:
    """row_id, the components' versions, notes and source of a matrix file: a list of rows, or an object with one. A broken file has none."""
    row = "array<map<string,string>>"
    texts = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    rows = texts.select(F.coalesce(F.from_json("v", f"struct<rows:{row}>")["rows"], F.from_json("v", row)).alias("rows")).select(F.posexplode("rows").alias("row_id", "r"))
    return rows.select("row_id", *[F.try_element_at("r", F.lit(c)).alias(c) for c in (*components, "notes", "source")])


def symbol_tables(spark: SparkSession, path: str) -> DataFrame:
    """key, name, kind, weight, versions of saved symbol tables; a broken file has none."""
    shape = "struct<symbols:array<struct<name:string,kind:string,weight:double,versions:array<string>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape)["symbols"]).alias("s")).select("s.*").where("name is not null")
    return rows.select(F.lower("name").alias("key"), "name", F.coalesce("kind", F.lit("kernel")).alias("kind"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("versions", F.array().cast("array<string>")).alias("versions")).dropDuplicates(["key"])


def write_symbol_table(table: DataFrame, path: str) -> None:
    """A symbol table as one JSON object, heaviest first; a table is bounded by the source trees."""
    one = F.struct((-F.col("weight")).alias("o"), "key", F.struct("name", "kind", "weight", "versions").alias("s"))
    whole = table.agg(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["s"]).alias("symbols"))
    whole.select(F.to_json(F.struct("symbols")).alias("value")).write.mode("overwrite").text(path)


def signal_words(spark: SparkSession, path: str) -> DataFrame:
    """word, count, docs, idf, score of saved signal words, highest score first; a broken file has none."""
    shape = "struct<words:array<struct<word:string,count:bigint,docs:bigint,idf:double,score:double>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape)["words"]).alias("w")).select("w.*")
    return rows.where("word is not null").orderBy(F.desc("score"), "word")


def zipped_sources(spark: SparkSession, path: str) -> DataFrame:
    """version, path, content of zipped source trees, one file for each version; a single folder at the top is left out.

    An archive is opened in the task that reads it, member by member, and never unpacked to disk.
    """
    import io
    import zipfile

    def run(frames):
        import pandas as pd

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                members = [m for m in archive.namelist() if not m.endswith("/")]
                tops = {m.partition("/")[0] for m in members}
                cut = len(next(iter(tops))) + 1 if len(tops) == 1 and all("/" in m for m in members) else 0
                version = name.rpartition("/")[2].removesuffix(".zip")
                for m in members:
                    yield pd.DataFrame({"version": [version], "path": [m[cut:]], "content": [archive.read(m).decode("utf-8", "replace")]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "version string, path string, content string")


def in_repository(sources: DataFrame, repo: str, version: str | None = None, path: str | None = None) -> DataFrame:
    """Source files of one repository, version and path; names that don't exist give no rows, other repositories never show."""
    rows = sources.where(F.col("repo") == repo)
    for column, value in (("version", version), ("path", path)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def has_version(sources: DataFrame, repo: str, version: str) -> bool:
    return not in_repository(sources, repo, version).isEmpty()


@register_source("images")
class ImageSource:
    """Images that a recogniser outside the engine has read: JSON lines (path, text, confidence) beside the image files.

    Equal images are one document, by their hash, whichever of their names was read. Those in ``done`` (sha) were taken in before and are left out. Only the
    signatures of a text are kept; an image without any makes no document.
    """

    def __init__(self, config: Mapping):
        self.path, self.results, self.component, self.done = config["path"], config["results"], config.get("component", "doc"), config.get("done")

    def canonicalize(self, spark: SparkSession) -> DataFrame:
        from ..functions.signatures import extract_signatures

        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,webp,gif}").option("recursiveFileLookup", True).load(self.path)
        base = self.path.rstrip("/").rpartition("/")[2]
        named = files.select(F.sha2("content", 256).alias("sha"), F.regexp_extract("path", rf"^.*?/{re.escape(base)}/(.+)$", 1).alias("place"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
        if self.done is not None:
            named = named.join(self.done.select("sha"), "sha", "left_anti")
        read = spark.read.schema("path string, text string, lines array<struct<text:string,confidence:double>>").json(self.results)
        told = read.select(F.regexp_replace("path", r"^\./", "").alias("key"), F.coalesce("text", F.array_join("lines.text", "\n")).alias("text"), mean_confidence(F.col("lines")).alias("confidence"))
        # a name with its folder means that file; a bare one means files of that name in any folder
        whole = named.join(told, F.col("place") == F.col("key"))
        bare = named.join(told.where(~F.contains("key", F.lit("/"))), F.col("file") == F.col("key")).where("place <> key")
        # of equal images whatever was recognised under any of their names counts: the one with most, then the least name
        body = F.array_join(F.transform(extract_signatures(F.col("text")), lambda s: s["text"]), "\n")
        every = whole.unionByName(bare).withColumn("body", body).where("body <> ''")
        kept = every.groupBy("sha").agg(F.min("file").alias("file"), F.max_by(F.struct("body", "confidence"), F.struct(F.length("body"), "confidence", "body")).alias("best")).select("sha", "file", "best.*")
        return kept.select(
            F.lit("doc_image").alias("source_type"), F.concat(F.lit("image:"), "sha").alias("source_id"), F.col("file").alias("title"), "body", F.lit("open").alias("status"), F.lit(self.component).alias("component"),
            F.lit("unverified").alias("verification"), F.create_map(F.lit("sha"), F.col("sha"), F.lit("confidence"), F.col("confidence").cast("string")).alias("extra"),
        )


def mean_confidence(lines):
    """The mean of recognised lines' confidence; 0 without lines."""
    known = F.filter(F.transform(lines, lambda x: x["confidence"]), lambda c: c.isNotNull())
    return F.when(F.size(F.coalesce(known, F.array().cast("array<double>"))) > 0, F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known)).otherwise(F.lit(0.0))


def copied_assets(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Copies binary files (path, content) under their asset names into ``folder``; what is there already stays as it is.

    Returns path, sha, name and whether the file was copied now. Files are written by the tasks that hold them.
    """
    from ..operators.stored import stored

    folder = folder.rstrip("/")
    there = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name")) if exists(spark, folder) else spark.createDataFrame([], "name string")
    names = stored(asset_names(files).join(there.withColumn("held", F.lit(True)), "name", "left").withColumn("copied", F.col("held").isNull()).select("path", "sha", "name", "copied"), "assets")

    def run(frames):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for frame in frames:
            system.create_dir(base)
            for name, content in zip(frame["name"], frame["content"], strict=True):
                with system.open_output_stream(f"{base}/{name}") as f:
                    f.write(content)
            yield frame[["name"]]

    new = names.where("copied").groupBy("name").agg(F.min("path").alias("path")).join(files.select("path", "content"), "path")
    new.select("name", "content").mapInPandas(run, "name string").count()
    return names


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def demo_items(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A small corpus to try the engine on: raw items and comments, as ``canonical_documents`` takes them."""
    day = lambda n: f"2024-0{n}-01T00:00:00Z"
    items = [
        (1, "[Bug]: engine runs out of memory", "Engine version: 0.5.1\nRuntimeError: out of memory in npuScatter", ["bug"], "closed", day(1), day(2), day(2), None, False, False, None),
        (2, "[Bug]: timeout after restart", "Engine 0.5.2 hangs: timeout or trap error, retCode=507014", [], "open", day(2), day(2), None, None, False, False, None),
        (3, "[Feature]: larger pages", "Please add larger pages", ["v0.6.0"], "open", day(3), day(3), None, None, False, False, None),
        (4, "[Doc]: settings", "HCCL_BUFFSIZE is not described", [], "closed", day(3), day(4), day(4), None, False, False, None),
        (5, "[Bug]: wrong result", "enable_fast_path gives wrong results since 0.5.4", [], "open", day(4), day(4), None, None, False, False, None),
        (6, "Fix memory of scatter", "Fixes #1", [], "closed", day(2), day(2), day(2), None, True, True, day(2)),
    ]
    shape = "number bigint, title string, body string, labels array<string>, state string, created_at string, updated_at string, closed_at string, html_url string, is_pr boolean, merged boolean, merged_at string"
    comments = [(1, 1, "ann", day(1), "same here"), (1, 2, "ben", day(2), "fixed by #6"), (2, 1, "ann", day(3), "any news?")]
    return spark.createDataFrame(items, shape), spark.createDataFrame(comments, "number bigint, position bigint, login string, created_at string, body string")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """version, path, content of unpacked source trees, one folder for each version."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    rest = F.regexp_extract(F.input_file_name(), r"/" + path.rstrip("/").rpartition("/")[2] + r"/(.+)$", 1)
    return files.select(F.substring_index(rest, "/", 1).alias("version"), F.regexp_replace(rest, "^[^/]*/", "").alias("path"), F.col("value").alias("content"))


def asset_names(files: DataFrame) -> DataFrame:
    """path, sha, name of binary files (path, content): equal files are one; another file of a taken name gets its hash."""
    from pyspark.sql import Window

    hashed = files.select("path", F.sha2("content", 256).alias("sha"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    first = F.first("sha").over(Window.partitionBy("file").orderBy("path"))
    own = F.concat(F.regexp_extract("file", r"^(.*?)(\.[^.]*)?$", 1), F.lit("."), F.substring("sha", 1, 12), F.regexp_extract("file", r"(\.[^.]*)?$", 1))
    return hashed.withColumn("name", F.when(F.col("sha") == first, F.col("file")).otherwise(own)).select("path", "sha", "name")
