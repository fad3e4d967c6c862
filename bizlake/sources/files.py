"""Finding files, choosing snapshots, hashing files, unpacking archives."""

from __future__ import annotations

import hashlib
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: members an archive is unpacked for
WANTED_MEMBERS = ["project", "organization", "euroscivoc"]
CHUNK = 4 << 20


def list_files(spark: SparkSession, folder: str | list[str], pattern: str = "*", content: bool = False) -> DataFrame:
    """Files of a folder tree, or of a list of paths: path, name, size_bytes, modified, and the content if asked for."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select(
            "path",
            F.element_at(F.split("path", "/"), -1).alias("name"),
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("modified"),
            *(["content"] if content else []),
        )
    )


def _best(dated: DataFrame, found: list[str], age) -> DataFrame:
    """The row of the greatest age; equal ages are settled by the other columns."""
    best = dated.agg(F.max_by(F.struct(*found), F.struct(age.alias("age"), *found)).alias("best"))
    return best.filter("best is not null").select("best.*")


def latest_monthly(files: DataFrame, pattern: str, year: int, month: int) -> DataFrame:
    """The newest monthly file not after (year, month), or the newest of all.

    ``pattern`` captures the month, then the year, from the file name.  One
    row: the columns of ``files`` and snapshot (``MM_YYYY``); no row when
    nothing matches.
    """
    mm = F.regexp_extract("name", pattern, 1)
    yyyy = F.regexp_extract("name", pattern, 2)
    number = yyyy.cast("int") * 12 + mm.cast("int")
    dated = files.filter(F.col("name").rlike(f"^{pattern}")).withColumn("snapshot", F.concat_ws("_", mm, yyyy))
    age = F.struct((number <= year * 12 + month).alias("due"), number.alias("at"))
    return _best(dated, [*files.columns, "snapshot"], age)


def latest_yearly(files: DataFrame, pattern: str, year: int) -> DataFrame:
    """The newest yearly file not after ``year``, with its year; no row when none is due."""
    yyyy = F.regexp_extract("name", pattern, 1).cast("int")
    dated = files.filter(F.col("name").rlike(f"^{pattern}")).withColumn("year", yyyy)
    return _best(dated.filter(F.col("year") <= year), [*files.columns, "year"], F.col("year"))


def latest_modified(files: DataFrame) -> DataFrame:
    """The file changed last; equal times are settled by name."""
    return files.agg(
        F.max_by(F.struct(*files.columns), F.struct("modified", "name")).alias("best")
    ).filter("best is not null").select("best.*")


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
    return fs, inner


def digest(content: Column) -> dict[str, Column]:
    """SHA-256 and MD5 of a text or binary column."""
    return {"sha256": F.sha2(content, 256), "md5": F.md5(content)}


def _direct(path: str) -> tuple[pafs.FileSystem, str]:
    """As :func:`_open`; a listed local path is taken as it is, with blanks and percent signs."""
    return (pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else _open(path)


def streamable(path: str, size: int) -> bool:
    """Whether a listed file can be read in pieces, which Spark's readers of whole files do not."""
    try:
        fs, inner = _direct(path)
        return fs.get_file_info(inner).size == size
    except (pa.ArrowException, OSError):
        return False


def _digest_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, inner = _direct(path)
            sha256 = hashlib.sha256()
            with fs.open_input_file(inner) as source:
                while chunk := source.read(CHUNK):
                    sha256.update(chunk)
            yield pa.RecordBatch.from_pydict({"path": [path], "sha256": [sha256.hexdigest()]})


def stream_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256) of files, each read by a task of its own that holds one chunk of it."""
    listed = spark.createDataFrame([(path,) for path in paths], "path string")
    # from one partition rows are dealt evenly
    return listed.coalesce(1).repartition(max(len(paths), 1)).mapInArrow(_digest_files, "path string, sha256 string")


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder tree with their digests; a file above the reader's limit stops the job."""
    listed = list_files(spark, folder, pattern, content=True)
    return listed.withColumns(digest(F.col("content"))).drop("content")


def _extended(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + more


def _list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for path in batch["path"]:
            fs, inner = _open(path)
            try:
                with fs.open_input_file(inner) as raw, zipfile.ZipFile(raw) as archive:
                    found += [(path, m.filename, m.file_size) for m in archive.infolist()]
            except (zipfile.BadZipFile, pa.ArrowInvalid):
                found.append((path, None, None))
        members = pd.DataFrame(found, columns=["path", "member", "size_bytes"])
        yield members.astype({"size_bytes": "Int64"})


def archive_members(files: DataFrame) -> DataFrame:
    """Members of zip archives; a broken archive gives one row with a null member."""
    return files.select("path").repartition("path").mapInPandas(
        _list_members, "path string, member string, size_bytes long"
    )


def wanted_members(members: DataFrame, words: list[str] = WANTED_MEMBERS) -> DataFrame:
    """Members whose name holds one of the words, in any case."""
    return members.filter(F.lower("member").rlike("|".join(words)))


def unpack_members(members: DataFrame, target: str) -> DataFrame:
    """Unpack members below ``target``, one task per member; adds ``unpacked`` (the path).

    Members go to a folder named as their archive; archives of the same name are
    told apart by a digest of their paths.  A member whose name leads out of its
    folder stops the job.  A member appears under its name only when complete, so
    a repeated task replaces it with the same content.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            written = []
            for path, member, shared in zip(batch["path"], batch["member"], batch["_shared"]):
                if member.startswith(("/", "\\")) or ".." in member.replace("\\", "/").split("/"):
                    raise ValueError(f"{path}: member {member!r} would be written outside its folder")
                fs, inner = _open(path)
                stem = inner.rsplit("/", 1)[-1].removesuffix(".zip")
                if shared:
                    stem = f"{stem}-{hashlib.sha256(path.encode()).hexdigest()[:16]}"
                goal = f"{target}/{stem}/{member}"
                out_fs, out_path = _open(goal)
                out_fs.create_dir(out_path.rsplit("/", 1)[0], recursive=True)
                part = f"{out_path}.{uuid.uuid4().hex}.part"
                with (
                    fs.open_input_file(inner) as raw,
                    zipfile.ZipFile(raw) as archive,
                    archive.open(member) as source,
                    out_fs.open_output_stream(part) as sink,
                ):
                    while chunk := source.read(CHUNK):
                        sink.write(chunk)
                out_fs.move(part, out_path)
                written.append(goal)
            yield batch.drop(columns=["_name", "_shared"]).assign(unpacked=written)

    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.zip$", "").alias("_name")
    names = members.select("path", name).distinct().groupBy("_name").agg((F.count("*") > 1).alias("_shared"))
    named = members.select("*", name).join(names, "_name").select(*members.columns, "_name", "_shared")
    spread = named.repartition("path", "member")
    return spread.mapInPandas(unpack, _extended(members, "unpacked string"))
