import struct
import zlib

import numpy as np
import pytest

from inkfield.functions import images as im
from inkfield.options import ImageOptions, Options, from_environment
from inkfield.sources.pages import page_images, scale_of
from inkfield.sources.wire import read_uploads


def png(image, kind=2, filters=(0, 1, 2, 3, 4)):
    """A PNG of an array (height, width, channels), its lines predicted by the filters in turn."""
    height, width, channels = image.shape
    lines, above = b"", np.zeros(width * channels, np.int64)
    for y in range(height):
        now, f = image[y].ravel().astype(np.int64), filters[y % len(filters)]
        left = np.concatenate((np.zeros(channels, np.int64), now[:-channels]))
        corner = np.concatenate((np.zeros(channels, np.int64), above[:-channels]))
        guess = left + above - corner
        paeth = np.choose(np.argmin([abs(guess - left), abs(guess - above), abs(guess - corner)], axis=0), [left, above, corner])
        lines += bytes([f]) + ((now - [0, left, above, (left + above) // 2, paeth][f]) % 256).astype(np.uint8).tobytes()
        above = now

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def noise(*shape):
    return np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)


def page(height=400, width=500):
    """Lines of text, as bars on white."""
    out = np.full((height, width, 3), 255, np.uint8)
    for y in range(40, height - 40, 30):
        out[y : y + 8, 60 : width - 60] = 0
    return out


def test_png():
    for kind, channels in ((2, 3), (6, 4), (0, 1), (4, 2)):
        image = noise(11, 7, channels)
        got = im.decode_png(png(image, kind), 1000)
        want = np.repeat(image[..., :1], 3, axis=2) if channels < 3 else image[..., 2::-1]
        assert (got == want).all()
    for raw, code in ((png(noise(40, 40, 3)), "IMAGE_TOO_LARGE"), (b"\x89PNG\r\n\x1a\n", "INVALID_IMAGE"), (png(noise(9, 9, 3))[:60], "INVALID_IMAGE"), (b"x", "INVALID_IMAGE")):
        with pytest.raises(im.ImageRefused) as refused:
            im.decode_png(raw, 1000)
        assert refused.value.code == code


def test_orientations():
    image = np.arange(6, dtype=np.uint8).reshape(2, 3)
    want = {1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]], 9: [[0, 1, 2], [3, 4, 5]]}
    assert {k: im.upright(image, k).tolist() for k in want} == want
    for order, mark in (("<", b"II"), (">", b"MM")):
        tiff = mark + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 2) + struct.pack(order + "HHIHH", 0x0100, 3, 1, 9, 0) + struct.pack(order + "HHIHH", 0x0112, 3, 1, 6, 0)
        body = b"Exif\0\0" + tiff
        assert im.exif_orientation(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body) == 6
    assert im.exif_orientation(b"\xff\xd8\xff\xd9") == im.exif_orientation(b"") == 1


def test_sizes():
    assert im.limited_size(3200, 1000, 1600) == (1600, 500) and im.limited_size(100, 50, 1600) == (100, 50) and im.limited_size(9, 9, 0) == (9, 9) and im.limited_size(5000, 1, 1600) == (1600, 1)
    image = noise(60, 90, 3)
    assert (im.shrunk(image, 20, 30) == np.rint(image.reshape(20, 3, 30, 3, 3).mean((1, 3)))).all()
    assert abs(im.shrunk(image, 17, 41).mean() - image.mean()) < 2 and im.limit_size(image, 100) is image
    assert scale_of(595, 842, ImageOptions()) == 220 / 72 and scale_of(5000, 5000, ImageOptions()) == pytest.approx((40e6 / 25e6) ** 0.5)


def test_ink_parts_dark_from_light():
    gray = np.concatenate((np.full(300, 30), np.full(700, 220))).astype(np.uint8).reshape(10, 100)
    assert (im.ink(gray) == np.where(gray == 30, 255, 0)).all()


@pytest.mark.parametrize("angle", [-5.0, -1.3, 0.0, 2.4, 6.5])
def test_skew_is_found_and_undone(angle):
    turned = im.rotate(page(), angle)
    assert im.estimate_skew(turned) == pytest.approx(-angle, abs=0.25)
    image, by = im.prepare(turned, ImageOptions(contrast=False))
    assert (by == 0.0) == (abs(angle) < 0.3) and abs(im.estimate_skew(image)) <= 0.25


def test_turning_keeps_all_of_the_page():
    image = page()
    assert im.rotate(image, 0.0) is image and im.rotate(image, 90.0).shape == (500, 400, 3)
    assert (im.rotate(im.rotate(image, 90.0), -90.0)[2:-2, 2:-2] == image[2:-2, 2:-2]).mean() > 0.95


def test_contrast_threshold_and_grey():
    dull = (100 + page() // 10).astype(np.uint8)
    got = im.normalize_contrast(dull)
    assert got.shape == dull.shape and np.ptp(im.grey(got).astype(int)) > np.ptp(im.grey(dull).astype(int))
    red = np.zeros((64, 64, 3), np.uint8)
    red[..., 2] = np.arange(64) * 2 + 60
    assert (im.normalize_contrast(red)[..., :2] == 0).all()
    shaded = (page().astype(float) * np.linspace(0.4, 1, 500)[None, :, None]).astype(np.uint8)
    assert (im.local_threshold(shaded)[20:-20, 80:-80] == np.where(page()[20:-20, 80:-80] == 0, 0, 255)).mean() > 0.97
    assert im.grey_levels(np.array([[[10, 20, 30]]], np.uint8)).tolist() == [[[22, 22, 22]]]
    both = ImageOptions(deskew=False, contrast=False, threshold=True, grayscale=True)
    assert (im.prepare(dull, both)[0] == im.local_threshold(dull)).all()


def test_pages_of_uploads(spark, tmp_path):
    class Page:
        def __init__(self, width, height):
            self.width, self.height = width, height

        def render(self, scale):
            return np.full((round(self.height * scale), round(self.width * scale), 4), 200, np.uint8)

    def open_pdf(content):
        if content.endswith(b"broken"):
            raise ValueError("broken")
        return [Page(36, 72)] * int(content[5:])

    for name, raw in (("a.pdf", b"%PDF-7"), ("b.pdf", b"%PDF-broken"), ("c.pdf", b"%PDF-0"), ("d.png", png(noise(30, 20, 3))), ("e.png", png(noise(9, 9, 3))[:50]), ("f.jpg", b"\xff\xd8\xff\xe0"), ("g.txt", b"none")):
        (tmp_path / name).write_bytes(raw)
    options = ImageOptions(max_pages=3, dpi=72, deskew=False, contrast=False)
    got = page_images(read_uploads(spark, str(tmp_path), 1 << 20), open_pdf, None, options).collect()
    told = sorted((r.doc_id[-5:], r.page or 0, r.n_pages, r.width, r.height, r.error) for r in got)
    assert told == [("a.pdf", 1, 7, 36, 72, None), ("a.pdf", 2, 7, 36, 72, None), ("a.pdf", 3, 7, 36, 72, None), ("b.pdf", 0, None, None, None, "INVALID_PDF"), ("c.pdf", 0, None, None, None, "INVALID_PDF"), ("d.png", 1, 1, 20, 30, None), ("e.png", 0, None, None, None, "INVALID_IMAGE"), ("f.jpg", 0, None, None, None, "UNSUPPORTED_MEDIA_TYPE")]
    pixels = next(bytes(r.pixels) for r in got if r.doc_id.endswith("d.png"))
    assert (np.frombuffer(pixels, np.uint8).reshape(30, 20, 3) == noise(30, 20, 3)[..., ::-1]).all()


def test_from_uploads_to_results(spark, tmp_path):
    import datetime as dt

    from inkfield.plans.parse import parse_nested
    from inkfield.sources.pages import recognise_pages, replies_of
    from inkfield.sources.wire import nested_blocks

    for name, raw in (("good.png", png(noise(40, 60, 3))), ("odd.png", png(noise(30, 30, 3))), ("broken.png", png(noise(9, 9, 3))[:50])):
        (tmp_path / name).write_bytes(raw)

    def engine():
        warm = []

        def read(image):
            if not warm:
                warm.append(image.shape)
                return {}
            if image.shape[1] == 30:
                raise RuntimeError("odd")
            box = lambda x, y: [[x, y], [x + 300, y], [x + 300, y + 40], [x, y + 40]]
            return {"rec_texts": ["7319052840", "VERGİ KİMLİK NUMARASI", "VERGİ LEVHASI", " "], "rec_scores": [0.9, 1.0000001], "rec_polys": np.array([box(150, 166.4), box(100, 99.6), box(480, 10)])}

        return read

    options = ImageOptions(deskew=False, contrast=False)
    images = page_images(read_uploads(spark, str(tmp_path), 1 << 20), options=options)
    replies = replies_of(recognise_pages(images, engine, np.zeros((8, 8, 3), np.uint8)))
    got = {r.doc_id.rpartition("/")[2]: r for r in replies.collect()}
    assert {k: (r.success, r.error) for k, r in got.items()} == {"good.png": (True, None), "odd.png": (False, "OCR_FAILED"), "broken.png": (False, "INVALID_IMAGE")}
    assert [(b.text, b.confidence, b.box.y1) for b in got["good.png"].pages[0].blocks] == [("VERGİ LEVHASI", 0.0, 10.0), ("VERGİ KİMLİK NUMARASI", 1.0, 100.0), ("7319052840", 0.9, 166.0)]
    told = parse_nested(nested_blocks(replies.where("success")), Options(today=dt.date(2026, 1, 1))).first()
    assert told.success and told.data.vkn == "7319052840"
    unbuilt = recognise_pages(images, lambda: 1 / 0)
    assert {r.error for r in unbuilt.collect()} == {"OCR_SERVICE_UNAVAILABLE", "INVALID_IMAGE"}


def test_options_from_the_environment():
    said = {"OCR_MAX_PAGES": " 9 ", "OCR_DESKEW": "Off", "OCR_THRESHOLD": " YES ", "OCR_DPI": "many", "OCR_MOST_SKEW": "", "OTHER": "1"}
    got = from_environment(ImageOptions, "OCR_", said)
    assert (got.max_pages, got.deskew, got.threshold, got.dpi, got.most_skew) == (9, False, True, 220, 8.0)
    assert from_environment(Options, "P_", {"P_TODAY": "2026-01-01", "P_INCLUDE_RAW": "on"}).include_raw
    for wrong in ({"min_document_score": 1.5}, {"max_upload_bytes": 0}, {"max_address_lines": -1}):
        with pytest.raises(ValueError):
            Options(**wrong)
    with pytest.raises(ValueError):
        ImageOptions(dpi=0)
