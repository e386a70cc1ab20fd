"""Zip archives as collections: every member is a frame source."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions.text import natural_key
from frameloom.operators.spread import number_rows
from frameloom.sources.batches import typed


def members(archives: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """Members of each archive with their bytes; folders are skipped, a bad archive is an error row."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, "member", "content", "status", "error"]
        for batch in batches:
            for row in batch.itertuples(index=False):
                own, data = row[:-1], bytes(row[-1] or b"")
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as archive:
                        for info in archive.infolist():
                            if not info.is_dir():
                                yield pd.DataFrame(
                                    [(*own, info.filename, archive.read(info), "ok", None)], columns=names
                                )
                except (zipfile.BadZipFile, OSError) as problem:
                    yield pd.DataFrame([(*own, None, None, "error", str(problem))], columns=names)

    schema = f"{typed(archives, keys)}, member string, content binary, status string, error string"
    return archives.select(*keys, content).mapInPandas(run, schema)


def ordered_members(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members numbered from 0 in natural order inside each archive."""
    keyed = found.where(F.col("status") == "ok").withColumn("_key", natural_key("member"))
    return number_rows(keyed, keys, ["_key", "member"]).drop("_key", "status", "error")


def zip_bytes(named: Sequence[tuple[str, bytes]]) -> bytes:
    """A zip file of named members."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in named:
            archive.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()
