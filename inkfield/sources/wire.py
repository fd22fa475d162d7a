"""Recognition replies as blocks, and uploads by their first bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfield.functions.geometry import clamp, extent
from inkfield.functions.text import is_blank
from inkfield.schema import WIRE

# First bytes of the known kinds, in the order they are tried, and their media types.
MAGIC = (("Pdf", "25504446", "application/pdf"), ("Png", "89504E470D0A1A0A", "image/png"), ("Jpeg", "FFD8FF", "image/jpeg"))


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """Recognition replies, a JSON document a line. What does not parse has a null success."""
    return spark.read.schema(WIRE + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def reply_error(replies: DataFrame) -> Column:
    """OCR_FAILED for a reply that does not parse or did not succeed."""
    bad = F.col("_corrupt").isNotNull() if "_corrupt" in replies.columns else F.lit(False)
    return F.when(bad | ~F.coalesce(F.col("success"), F.lit(False)), "OCR_FAILED")


def read_bodies(answers: DataFrame) -> DataFrame:
    """Replies of an HTTP service (doc_id, status, body; status null if there was no answer) with a column error.

    No answer and 503 are OCR_SERVICE_UNAVAILABLE, 408 and 504 OCR_SERVICE_TIMEOUT, another status that is no success the code that
    the body tells, or OCR_FAILED. A success whose body does not read, or tells of a failure, is OCR_FAILED too.
    """
    fields = WIRE.removeprefix("doc_id string, ")
    # A body that does not read has _corrupt; one of another shape is a failure without a code.
    read = F.from_json("body", f"{fields}, error struct<code:string,message:string>, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = answers.withColumn("r", read)
    sound = F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    status = F.col("status")
    error = (
        F.when(status.isNull() | (status == 503), "OCR_SERVICE_UNAVAILABLE")
        .when(status.isin(408, 504), "OCR_SERVICE_TIMEOUT")
        .when(~status.between(200, 299), F.coalesce(F.when(sound, F.col("r.error.code")), F.lit("OCR_FAILED")))
        .when(~sound | ~F.coalesce(F.col("r.success"), F.lit(False)), "OCR_FAILED")
    )
    names = [f.split()[0] for f in fields.split(", ")]
    return rows.select("doc_id", error.alias("error"), *[F.when(error.isNull(), F.col(f"r.{n}")).alias(n) for n in names])


def model_blocks(texts: Column, scores: Column, polygons: Column, detected: Column) -> Column:
    """Blocks of the wire form from a model's lists, in the order of top and left edge.

    The recognised polygons count, or if there are none the detected ones. A text that is null or blank, or has no polygon, is left out; a
    missing score is 0, others go to between 0 and 1. Coordinates are rounded half to even.
    """
    chosen = F.when(F.coalesce(F.size(polygons), F.lit(0)) > 0, polygons).otherwise(detected)
    whole = lambda v: F.bround(v).cast("double")

    def block(text, n):
        polygon = F.get(chosen, n)
        xs, ys = F.transform(polygon, lambda p: F.get(p, F.lit(0))), F.transform(polygon, lambda p: F.get(p, F.lit(1)))
        box = F.struct(whole(F.array_min(xs)).alias("x1"), whole(F.array_min(ys)).alias("y1"), whole(F.array_max(xs)).alias("x2"), whole(F.array_max(ys)).alias("y2"))
        return F.struct(box["y1"].alias("top"), box["x1"].alias("left"), n.alias("n"), text.alias("text"), clamp(F.coalesce(F.get(scores, n), F.lit(0.0))).alias("confidence"), box.alias("box"), F.transform(polygon, lambda p: F.transform(p, whole)).alias("polygon"))

    made = F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), block), lambda b: ~is_blank(b["text"]) & F.coalesce(F.size(b["polygon"]) > 0, F.lit(False)))
    return F.transform(F.array_sort(made), lambda b: F.struct(b["text"].alias("text"), b["confidence"].alias("confidence"), b["box"].alias("box"), b["polygon"].alias("polygon")))


def wire_blocks(replies: DataFrame) -> DataFrame:
    """doc_id, page, block_idx, text, confidence, x1, y1, x2, y2 of all blocks that have text and a place.

    A missing box is the extent of the polygon. Confidences go to between 0 and 1. block_idx counts kept
    blocks from 0 over all pages of a document, in their order.
    """
    pages = replies.select("doc_id", F.posexplode("pages").alias("p_at", "p"))
    rows = pages.select("doc_id", "p_at", F.col("p.page").alias("page"), F.posexplode("p.blocks").alias("b_at", "b"))
    rows = rows.withColumn("box", F.coalesce("b.box", extent(F.col("b.polygon")))).where(~is_blank(F.col("b.text")) & F.col("box").isNotNull())
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("p_at", "b_at")) - 1
    return rows.select("doc_id", "page", index.alias("block_idx"), F.col("b.text").alias("text"), clamp(F.col("b.confidence")).alias("confidence"), "box.x1", "box.y1", "box.x2", "box.y2")


def nested_blocks(replies: DataFrame) -> DataFrame:
    """doc_id, n_pages, blocks, pages of each reply, in one row and without a shuffle: the form streams use."""
    pages = F.transform(
        "pages",
        lambda p: F.transform(p["blocks"], lambda b: F.struct(p["page"].alias("page"), b["text"].alias("text"), clamp(b["confidence"]).alias("confidence"), F.coalesce(b["box"], extent(b["polygon"])).alias("box"))),
    )
    kept = F.filter(F.flatten(pages), lambda b: ~is_blank(b["text"]) & b["box"].isNotNull())
    numbered = F.transform(kept, lambda b, n: F.struct(b["page"].alias("page"), n.alias("block_idx"), b["text"].alias("text"), b["confidence"].alias("confidence"), b["box"]["x1"].alias("x1"), b["box"]["y1"].alias("y1"), b["box"]["x2"].alias("x2"), b["box"]["y2"].alias("y2")))
    sizes = F.transform("pages", lambda p: F.struct(*[p[n].alias(n) for n in ("page", "width", "height", "applied_rotation")]))
    return replies.select("doc_id", F.size("pages").alias("n_pages"), numbered.alias("blocks"), sizes.alias("pages"))


def kind_of(content: Column) -> Column:
    found = F
    for kind, magic, _ in MAGIC:
        found = found.when(F.hex(F.substring(content, 1, len(magic) // 2)) == magic, kind)
    return found


def upload_kind(content: Column, length: Column, most: int) -> Column:
    """struct<kind, media_type, error>: empty, then too large, then the first bytes."""
    kind = kind_of(content)
    media = F
    for name, _, media_type in MAGIC:
        media = media.when(kind == name, media_type)
    error = F.when(length == 0, "EMPTY_FILE").when(length > most, "FILE_TOO_LARGE").when(kind.isNull(), "UNSUPPORTED_FILE_TYPE")
    return F.struct(F.when(error.isNull(), kind).alias("kind"), F.when(error.isNull(), media).alias("media_type"), error.alias("error"))


def read_uploads(spark: SparkSession, path: str, most: int) -> DataFrame:
    """Files with their kind or error; contents stay a binary column. What is too large is not read: the source gets the bound on its length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    refused = files.where(F.col("length") > most).select("path", "modificationTime", "length").withColumn("content", F.lit(None).cast("binary"))
    every = files.where(F.col("length") <= most).unionByName(refused)
    return every.withColumn("upload", upload_kind(F.col("content"), F.col("length"), most))


def recognise(uploads: DataFrame, engine: Callable[[], Callable[[bytes, str], list[dict]]]) -> DataFrame:
    """Runs a recognition engine over accepted uploads; a reply for each file.

    engine is called once a task and returns a function of (content, kind) to pages of blocks. What it raises becomes
    the row's failure and never ends the job.
    """

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        ready = engine()
        for frame in frames:
            out = []
            for path, content, kind in zip(frame.path, frame.content, frame.kind, strict=True):
                try:
                    out.append((path, True, 0, "engine", ready(bytes(content), kind)))
                except Exception:
                    out.append((path, False, 0, "engine", []))
            yield pd.DataFrame(out, columns=["doc_id", "success", "duration_ms", "engine", "pages"])

    return uploads.where("upload.error is null").select("path", "content", F.col("upload.kind").alias("kind")).mapInPandas(run, WIRE)
