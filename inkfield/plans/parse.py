"""The document plan: blocks in, one result row a document out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.functions.text import mask_number
from inkfield.options import Options
from inkfield.plans.certificate import read_document
from inkfield.schema import FIELDS, RAW, RESULT


def parse_nested(documents: DataFrame, options: Options | None = None) -> DataFrame:
    """Results of documents (doc_id, n_pages, blocks), one row each: a map, without any shuffle or state.

    The same for a batch and for a stream. What one document's reading raises is that document's failure: INTERNAL_ERROR, and
    in `cause`, which no envelope shows, what was raised. With include_raw come the blocks read, confidences rounded to four
    digits, and the pages if the documents have a column `pages`, rotations rounded to two.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    options = options or Options()
    schema = f"{RESULT}, {RAW}" if options.include_raw else RESULT
    target = to_arrow_schema(documents.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    told = read_document(row["blocks"] or [], row["n_pages"] or 0, options)
                except Exception as raised:
                    told = {"success": False, "document_type": "UNKNOWN", "error": "INTERNAL_ERROR", "warnings": [], "cause": f"{type(raised).__name__}: {raised}"}
                if options.include_raw:
                    told["raw_blocks"] = [b | {"confidence": None if b["confidence"] is None else round(b["confidence"], 4)} for b in row["blocks"] or []]
                    told["raw_pages"] = [p | {"applied_rotation": round(p["applied_rotation"] or 0.0, 2)} for p in row.get("pages") or []]
                out.append(told | {"doc_id": row["doc_id"]})
            yield pa.RecordBatch.from_pylist(out, schema=target)

    names = ["doc_id", "n_pages", "blocks"] + (["pages"] if options.include_raw and "pages" in documents.columns else [])
    return documents.select(*names).mapInArrow(run, schema)


def log_lines(results: DataFrame) -> DataFrame:
    """What may be logged of each result: no text, and of numbers the last four digits only."""
    codes = F.array_join(F.transform("warnings", lambda w: w["code"]), ",")
    masked = [F.coalesce(mask_number(F.col(f"data.{f}")), F.lit("<none>")).alias(f"masked_{f}") for f in ("vkn", "tckn")]
    return results.select("doc_id", "success", "document_type", "error", F.coalesce("confidence.overall", F.lit(0.0)).alias("overall"), codes.alias("warnings"), *masked)


def observed(results: DataFrame, observation) -> DataFrame:
    """The results; once they are computed the observation has counts of documents, failures, raised errors and warnings."""
    return results.observe(
        observation,
        F.count(F.lit(1)).alias("documents"),
        F.count_if(~F.col("success")).alias("failures"),
        F.count_if(F.col("error") == "INTERNAL_ERROR").alias("raised"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"),
    )


def summary(results: DataFrame) -> DataFrame:
    """doc_id, n_found, n_fields, other_code: fields that have a value, and whether the code was written in another way than it is given."""
    found = sum((F.when(F.col(f"data.{f}").isNotNull(), 1).otherwise(0) for f in FIELDS), F.lit(0))
    other = F.coalesce(F.col("data.anaFaaliyetKoduRaw") != F.col("data.anaFaaliyetKodu"), F.lit(False))
    return results.select("doc_id", found.cast("long").alias("n_found"), F.lit(len(FIELDS)).cast("long").alias("n_fields"), other.alias("other_code"))


def nest(blocks: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_pages, blocks in wire order. The plan's only exchange, by document."""
    row = F.struct("block_idx", "page", "text", "confidence", "x1", "y1", "x2", "y2")
    return blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"), F.sort_array(F.collect_list(row)).alias("blocks"))


def parse_blocks(blocks: DataFrame, options: Options | None = None) -> DataFrame:
    return parse_nested(nest(blocks), options)


def envelope(results: DataFrame) -> DataFrame:
    """doc_id, json: members of data and validation stay as null, other nulls are left out."""
    full = F.to_json(F.struct("data", "validation"), {"ignoreNullFields": "false"})
    rest = F.to_json(F.struct("success", F.col("document_type").alias("documentType"), "confidence", "warnings", "error"))
    return results.select("doc_id", F.concat(F.regexp_replace(rest, r"\}$", ""), F.lit(","), F.regexp_replace(full, r"^\{", "")).alias("json"))
