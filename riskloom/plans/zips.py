"""Archives made of the given documents: some with one root, some with several, some unsafe or no archives."""

from __future__ import annotations

import io
import sys
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.workers import by_value

#: Documents to an archive.
SIZE = 40


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    number = int(rows["archive"].iloc[0])
    if number % 7 == 5:
        return pd.DataFrame({"repo_id": [f"z{number}"], "content": [b"no archive"]})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            folder = "top/src" if number % 2 == 0 else "ab"[doc_id % 2]
            z.writestr(f"{folder}/d{doc_id}.txt", text)
        if number % 2:
            z.writestr("c/info.txt", "info")
        if number % 7 == 3:
            z.writestr("../evil.txt", "x")
    return pd.DataFrame({"repo_id": [f"z{number}"], "content": [out.getvalue()]})


def document_archives(documents: DataFrame) -> DataFrame:
    """(repo_id, content): documents zipped, ``SIZE`` neighbours by doc_id to an archive."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("doc_id") / SIZE).alias("archive"))
    return rows.groupBy("archive").applyInPandas(_packed, "repo_id string, content binary")


by_value(sys.modules[__name__])
