"""Solutions, projects and documents as tables, and the guards on their paths."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions import names

PROJECT_SCHEMA = (
    "_Sdk string, PropertyGroup array<struct<TargetFramework:string,TargetFrameworks:string,TargetFrameworkVersion:string,"
    "OutputType:string,AssemblyName:string>>, "
    "ItemGroup array<struct<PackageReference:array<struct<_Include:string,_Version:string>>,ProjectReference:array<struct<_Include:string>>>>"
)
#: Device names that Windows reserves.
DEVICES = ("CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)))
EXTENSIONS = {"project": (".csproj",), "solution": (".sln", ".slnx"), "source": (".cs", ".vb", ".fs")}


class PathError(ValueError):
    """A path that may not be read."""


@dataclass(frozen=True)
class Options:
    """What the loaders may be told: the folder that must hold all paths."""

    base: str | None = None


def has_traversal(path: str) -> bool:
    return ".." in path or any(len(x) > 255 for x in re.split(r"[\\/]", path))


def checked_path(path: str | None, kind: str, options: Options | None = None) -> Path:
    """The full path of an existing file of a kind, or :class:`PathError`."""
    if path is None or not path.strip():
        raise PathError("the path is empty")
    if has_traversal(path):
        raise PathError("the path leaves its folder")
    full = Path(path).resolve()
    if full.stem.upper() in DEVICES:
        raise PathError("the path names a device")
    if options and options.base and not full.is_relative_to(Path(options.base).resolve()):
        raise PathError("the path lies outside the base folder")
    if full.suffix.lower() not in EXTENSIONS[kind]:
        raise PathError(f"not a {kind}: {full.suffix}")
    if not full.exists():
        raise PathError("no such file")
    return full


def _normal(path):
    return F.replace(path, F.lit("\\"), F.lit("/"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of files, without a byte-order mark."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("text"))


def solution_projects(files: DataFrame) -> DataFrame:
    """``(solution, project, path)`` of the ``.sln`` and ``.slnx`` texts in ``files`` (path, text)."""
    old = F.regexp_extract_all("text", F.lit(r'(?m)^Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]*\.(?:cs|vb|fs)proj)"'), F.lit(1))
    new = F.regexp_extract_all("text", F.lit(r'<Project\s[^>]*Path="([^"]*)"'), F.lit(1))
    listed = F.when(F.col("path").endswith(".slnx"), new).otherwise(old)
    rows = files.select(F.col("path").alias("solution"), F.explode(listed).alias("p")).select("solution", _normal(F.col("p")).alias("path"))
    return rows.select("solution", names.file_stem(F.col("path")).alias("project"), "path")


def _parsed(files: DataFrame) -> DataFrame:
    # Projects of the old format have a namespace, which from_xml takes as part of no name.
    text = F.regexp_replace("text", r'\sxmlns="[^"]*"', "")
    return files.select("path", names.file_stem(F.col("path")).alias("project"), F.from_xml(text, PROJECT_SCHEMA, {"mode": "PERMISSIVE"}).alias("x"))


def projects(files: DataFrame) -> DataFrame:
    """``(project, path, assembly, tfm, output_type)``; the first target framework, else Unknown."""
    rows = _parsed(files)
    first = lambda f: F.get(F.filter(F.transform("x.PropertyGroup", lambda g: g[f]), lambda v: v.isNotNull()), F.lit(0))
    several = F.get(F.split(first("TargetFrameworks"), ";"), F.lit(0))
    old = F.concat(F.lit("net"), F.replace(F.regexp_extract(first("TargetFrameworkVersion"), r"^v(.+)$", 1), F.lit("."), F.lit("")))
    return rows.select(
        "project", "path", F.coalesce(first("AssemblyName"), "project").alias("assembly"),
        F.coalesce(first("TargetFramework"), several, old, F.lit("Unknown")).alias("tfm"),
        F.coalesce(first("OutputType"), F.lit("Library")).alias("output_type"),
    )


def project_refs(files: DataFrame) -> DataFrame:
    """``(src, dst)``: the project src refers to the project dst."""
    rows = _parsed(files).select("project", F.explode("x.ItemGroup").alias("g"))
    rows = rows.select(F.col("project").alias("src"), F.explode("g.ProjectReference").alias("r"))
    return rows.select("src", names.file_stem(_normal(F.col("r._Include"))).alias("dst")).dropna().distinct()


def package_refs(files: DataFrame) -> DataFrame:
    """``(project, name, version)``, the first version of a name in a project."""
    rows = _parsed(files).select("project", F.posexplode("x.ItemGroup").alias("i", "g"))
    rows = rows.select("project", "i", F.posexplode("g.PackageReference").alias("j", "r"))
    rows = rows.select("project", F.col("r._Include").alias("name"), F.col("r._Version").alias("version"), "i", "j")
    return rows.filter("name is not null").groupBy("project", "name").agg(F.min_by("version", F.struct("i", "j")).alias("version"))


def documents(spark: SparkSession, path: str, glob: str = "*.cs", project_files: DataFrame | None = None) -> DataFrame:
    """``(doc_id, project, path, content, n_lines, size, mtime)`` of the sources below a folder.

    Each file gets its owning project among ``project_files`` (see :func:`owning`); its id is the
    SHA-256 of its path. A leading byte-order mark is dropped.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    content = F.regexp_replace("value", "^\\x{FEFF}", "")
    rows = rows.select(
        F.sha2(F.col("_metadata.file_path").cast("binary"), 256).alias("doc_id"), F.col("_metadata.file_path").alias("path"),
        content.alias("content"), F.size(F.split(content, "\n")).alias("n_lines"),
        F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"),
    )
    if project_files is None:
        found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csproj").text(path, wholetext=True)
        project_files = found.select(F.col("_metadata.file_path").alias("path"))
    return owning(rows, project_files).select("doc_id", "project", "path", "content", "n_lines", "size", "mtime")


def owning(files: DataFrame, project_files: DataFrame) -> DataFrame:
    """``files`` (path, ...) with ``project``: that of the nearest folder on the path with a project file.

    Of several project files in a folder the first in order of path counts; without any, the project is
    null. Every folder on the path is looked up, so it is an equi-join.
    """
    folder = lambda c: F.regexp_extract(c, r"^(.*)[/\\\\][^/\\\\]*$", 1)
    known = project_files.select("path").groupBy(folder(F.col("path")).alias("folder")).agg(F.min("path").alias("file"))
    known = known.select("folder", names.file_stem(F.col("file")).alias("found"))
    parts = F.split(folder(F.col("path")), "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder")).distinct()
    best = above.join(known, "folder").groupBy("path").agg(F.max_by("found", F.length("folder")).alias("project"))
    return files.join(best, "path", "left")


def changed(documents_: DataFrame, known: DataFrame) -> DataFrame:
    """Documents that ``known`` (path, mtime) lacks or has with an older time."""
    latest = known.groupBy("path").agg(F.max("mtime").alias("seen"))
    return documents_.join(latest, "path", "left").filter("seen is null or mtime > seen").drop("seen")
