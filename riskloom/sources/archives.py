"""Zip archives as repositories: one archive row becomes one row per member."""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import fixed as K
from riskloom.functions.workers import by_value
from riskloom.plans.staging import stage

MEMBERS = "repo_id string, member string, path string, size bigint, content binary, error string"
_SCHEMA = pa.schema(
    [("repo_id", pa.string()), ("member", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())]
)


def _batch(*row) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, row, strict=True))], schema=_SCHEMA)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each archive, one batch per member; an archive that is none, or has an unsafe
    name, yields only its error.  The names are listed before any member is read, so the paths
    below the root are known then."""
    for batch in batches:
        for repo, content, looks_right in zip(batch.column("repo_id").to_pylist(), batch.column("content"), batch.column("is_zip").to_pylist(), strict=True):
            if not looks_right:
                yield _batch(repo, None, None, None, None, "not a zip archive")
                continue
            try:
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    unsafe = [n for n in archive.namelist() if n.startswith("/") or ".." in n.split("/")]
                    if unsafe:
                        yield _batch(repo, unsafe[0], None, None, None, "unsafe member name")
                        continue
                    files = [i for i in archive.infolist() if not i.is_dir()]
                    # as in the unpacked folder: exactly one folder at the top is the root, whatever files lie beside it
                    tops = {i.filename.partition("/")[0] for i in files if "/" in i.filename}
                    root = f"{min(tops)}/" if len(tops) == 1 else ""
                    for info in files:
                        if info.filename.startswith(root):
                            yield _batch(repo, info.filename, info.filename.removeprefix(root), info.file_size, archive.read(info), None)
            except Exception as exc:  # whatever a broken archive makes the reader raise
                yield _batch(repo, None, None, None, None, f"unreadable archive: {exc}")


def is_zip(content) -> F.Column:
    """The first four bytes are those of a zip archive."""
    return F.coalesce(F.hex(F.substring(content, 1, 4)) == K.ZIP_MAGIC_HEX, F.lit(False))


def expand_archives(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, rejected) of archives given as (repo_id, content).

    A single top folder becomes the root of its repository.  Rejected archives carry the reason,
    and give no files, even if some members could be read before one could not.  Each archive is
    opened once, and its members are written; nothing joins or shuffles them.
    """
    by_value(sys.modules[__name__], K)
    told = archives.select("repo_id", "content", is_zip(F.col("content")).alias("is_zip"))
    members = stage(told.mapInArrow(_members, MEMBERS), "members")
    rejected = members.filter("error IS NOT NULL").select("repo_id", "member", "error")
    # few archives are rejected and one row stands for each, so Spark sends these to the members
    files = members.filter("error IS NULL").join(rejected.select("repo_id").distinct(), "repo_id", "left_anti")
    return files.select("repo_id", "path", "size", "content"), rejected
