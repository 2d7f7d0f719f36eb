"""Sinks: append what is not stored yet, upsert by key, import and export rules and terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.relational import unseen


def new_rows(rows: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows to append: keys that are not stored, each once."""
    return unseen(rows.dropDuplicates(list(key)), stored, key)


def append_unseen(rows: DataFrame, path: str, key: Sequence[str]) -> None:
    """Append to a parquet folder the rows whose key it lacks. One writer at a time."""
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
    new_rows(rows, stored, key).write.mode("append").parquet(path)


def upserted(stored: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table after an upsert: new rows, and stored ones whose key they lack."""
    return unseen(stored, rows, key).unionByName(rows.dropDuplicates(list(key)), allowMissingColumns=True)


def import_plan(stored: DataFrame, rows: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Each incoming key with what an import does to it: created, updated or skipped (no change)."""
    old = stored.select(F.col(key), F.struct(*values).alias("_old"))
    new = rows.dropDuplicates([key]).select(F.col(key), F.struct(*values).alias("_new"))
    action = F.when(F.col("_old").isNull(), "created").when(F.col("_old").eqNullSafe(F.col("_new")), "skipped").otherwise("updated")
    return new.join(old, key, "left").select(key, action.alias("action"))


def export(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Write rows as JSON lines or CSV with a header, arrays joined by a vertical bar in the latter."""
    if kind == "json":
        rows.write.json(path)
    elif kind == "csv":
        flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
        rows.select(*flat).write.option("header", "true").option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown kind: {kind}")


def topic_files(sections: DataFrame, doc_id: str = "doc_id", kind: str = "md") -> DataFrame:
    """(path, content) of one file for each section (doc_id, ord, level, title, content), as Markdown, CSV lines or DITA topics."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    name = F.concat(F.lit("t"), F.col(doc_id).cast("string"), F.lit("_"), F.col("ord").cast("string"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    paragraphs = F.array_join(F.transform(F.filter(F.split("content", r"\n+"), lambda p: F.trim(p) != ""), lambda p: F.concat(F.lit("<p>"), escaped(F.trim(p)), F.lit("</p>"))), "")
    forms = {
        "md": F.concat(F.repeat(F.lit("#"), F.greatest("level", F.lit(1))), F.lit(" "), "title", F.lit("\n\n"), "content", F.lit("\n")),
        "csv": F.concat_ws(",", F.col(doc_id).cast("string"), F.col("ord").cast("string"), quoted(F.col("title")), quoted(F.col("content"))),
        "dita": F.concat(F.lit('<topic id="'), name, F.lit('"><title>'), escaped(F.col("title")), F.lit("</title><body>"), paragraphs, F.lit("</body></topic>")),
    }
    if kind not in forms:
        raise ValueError(f"unknown kind: {kind}")
    return sections.select(F.concat(name, F.lit(f".{kind}")).alias("path"), forms[kind].alias("content"))


def write_archives(files: DataFrame, path: str, key: str = "archive") -> None:
    """A row for each archive (archive, content as a zip of its files (archive, path, content)), written as Parquet.

    An archive is as large as one document's files; these meet in one task.
    """
    import io
    import zipfile

    import pandas as pd

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(group["path"], group["content"], strict=True)):
                z.writestr(zipfile.ZipInfo(name), content or "")
        return pd.DataFrame({key: [group[key].iloc[0]], "content": [out.getvalue()]})

    files.groupBy(key).applyInPandas(packed, f"{key} {files.schema[key].dataType.simpleString()}, content binary").write.parquet(path)
