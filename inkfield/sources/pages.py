"""Uploads as page images: a document opens as a row of pages, an image as one.

What opens PDF files and photographs is a library of the user's choice, given as a function; PNG is read here. Pages are
rendered one at a time, as many as are allowed and never at more pixels than are allowed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.functions.images import ImageRefused, decode_png, exif_orientation, guard_pixels, prepare, upright
from inkfield.options import ImageOptions
from inkfield.sources.wire import model_blocks

LISTS = "doc_id string, page int, width int, height int, applied_rotation double, texts array<string>, scores array<double>, polygons array<array<array<double>>>, detected array<array<array<double>>>, error string"
POINTS = 72.0  # of a PDF to the inch
PAGES = "doc_id string, page int, n_pages int, width int, height int, applied_rotation double, pixels binary, error string"


def render_scale(width: Column, height: Column, dpi: int, most_pixels: int) -> Column:
    """Pixels to the point for a page of so many points; less than the resolution asks for where that gives too many pixels."""
    asked = F.lit(dpi / POINTS)
    return F.when(width * asked * (height * asked) <= most_pixels, asked).otherwise(F.sqrt(F.lit(float(most_pixels)) / (width * height)))


def scale_of(width: float, height: float, options: ImageOptions) -> float:
    asked = options.dpi / POINTS
    return asked if (width * asked) * (height * asked) <= options.max_pixels else (options.max_pixels / (width * height)) ** 0.5


def page_images(uploads: DataFrame, open_pdf: Callable | None = None, open_photo: Callable | None = None, options: ImageOptions | None = None) -> DataFrame:
    """A row for each page of accepted uploads (path, content, upload.kind), prepared for recognition; or a row with an error.

    open_pdf(bytes) gives a sequence of pages with width and height in points and render(scale), which returns an
    array (height, width, 3 or 4; red first). open_photo(bytes) gives such an array. What cannot be opened, has no page or too many
    pixels is one row with the error and no page; it never ends the job.
    """
    options = options or ImageOptions()

    def images(content: bytes, kind: str) -> Iterator[tuple[int, int, np.ndarray]]:
        if kind == "Png":
            yield 1, 1, decode_png(content, options.max_pixels)
        elif kind == "Jpeg" and open_photo:
            found = blue_first(open_photo(content))
            guard_pixels(found.shape[1], found.shape[0], options.max_pixels)
            yield 1, 1, upright(found, exif_orientation(content))
        elif kind == "Pdf" and open_pdf:
            pages = open_pdf(content)
            if not len(pages):
                raise ImageRefused("INVALID_PDF", "no page")
            for n in range(min(len(pages), options.max_pages)):
                yield n + 1, len(pages), blue_first(pages[n].render(scale_of(pages[n].width, pages[n].height, options)))
        else:
            raise ImageRefused("UNSUPPORTED_MEDIA_TYPE", f"nothing opens {kind}")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        columns = [c.split()[0] for c in PAGES.split(", ")]
        for frame in frames:
            for path, content, kind in zip(frame.path, frame.content, frame.kind, strict=True):
                try:
                    for page, total, image in images(bytes(content), kind):
                        image, turned = prepare(image, options)
                        yield pd.DataFrame([(path, page, total, image.shape[1], image.shape[0], turned, image.tobytes(), None)], columns=columns)
                except Exception as failed:
                    code = failed.code if isinstance(failed, ImageRefused) else "INVALID_PDF" if kind == "Pdf" else "INVALID_IMAGE"
                    yield pd.DataFrame([(path, None, None, None, None, None, None, code)], columns=columns).astype(object)

    return uploads.where("upload.error is null").select("path", "content", F.col("upload.kind").alias("kind")).mapInPandas(run, PAGES)


def recognise_pages(images: DataFrame, engine: Callable[[], Callable[[np.ndarray], dict]], warm_up: np.ndarray | None = None) -> DataFrame:
    """What a model makes of each page of page_images(): lists of texts, scores and polygons, or an error.

    engine is called once a task and returns a function of an image to a dict with rec_texts, rec_scores, rec_polys and
    dt_polys, any of which may be missing; tasks run beside each other as the cluster has room. warm_up is an image that it is given
    first, once a task. What it raises is the failure of that page; if it cannot be built or warmed up, of every page of the task.
    """

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        columns, ready = [c.split()[0] for c in LISTS.split(", ")], None
        try:
            ready = engine()
            if warm_up is not None:
                ready(warm_up)
        except Exception:
            ready = None
        for frame in frames:
            for row in frame.itertuples(index=False):
                head = (row.doc_id, row.page, row.width, row.height, row.applied_rotation)
                try:
                    if row.error:
                        raise ImageRefused(row.error, "no image")
                    if ready is None:
                        raise ImageRefused("OCR_SERVICE_UNAVAILABLE", "no engine")
                    told = ready(np.frombuffer(row.pixels, np.uint8).reshape(int(row.height), int(row.width), 3)) or {}
                    polygons = [[None if p is None else np.asarray(p, np.float64).reshape(-1, 2).tolist() for p in listed(told.get(k))] for k in ("rec_polys", "dt_polys")]
                    texts = [None if t is None else str(t) for t in listed(told.get("rec_texts"))]
                    out = (*head, texts, [float(x) for x in listed(told.get("rec_scores"))], *polygons, None)
                except Exception as failed:
                    out = (row.doc_id, None, None, None, None, None, None, None, None, failed.code if isinstance(failed, ImageRefused) else "OCR_FAILED")
                yield pd.DataFrame([out], columns=columns, dtype=object)

    return images.mapInPandas(run, LISTS)


def listed(values) -> list:
    return [] if values is None else list(values)


def replies_of(pages: DataFrame) -> DataFrame:
    """Recognised pages as replies in the wire form, a row for each document, with the least of its errors; one failed page fails it."""
    blocks = model_blocks(F.col("texts"), F.col("scores"), F.col("polygons"), F.col("detected"))
    page = F.when(F.col("error").isNull(), F.struct("page", "width", "height", "applied_rotation", blocks.alias("blocks")))
    told = pages.groupBy("doc_id").agg(F.min("error").alias("error"), F.sort_array(F.collect_list(page)).alias("pages"))
    return told.select("doc_id", F.col("error").isNull().alias("success"), F.lit(0).alias("duration_ms"), F.lit("engine").alias("engine"), "pages", "error")


def blue_first(image: np.ndarray) -> np.ndarray:
    image = np.asarray(image, np.uint8)
    return np.ascontiguousarray(np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image[..., 2::-1])
