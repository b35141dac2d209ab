import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from samphire.functions import images
from samphire.plans.job import COMPLETED, FAILED, JobRequest, JobRunner
from samphire.sources import scan, sinks


def png(pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def textured(seed, side=64):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 255, (8, 8, 3)), np.ones((side // 8, side // 8, 1))).astype(np.uint8)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "data"
    (root / "sub dir").mkdir(parents=True)
    (root / "a.png").write_bytes(png(np.full((1, 1, 3), 9, np.uint8)))
    (root / "b.png").write_bytes(png(np.full((3, 2, 3), 9, np.uint8)))
    for name, body in {"a.booru.txt": "tag_one, tag two", "a.caption.txt": "  short\ncaption ", "a.style.txt": " painterly ", "b.tags.txt": "legacy_tag_source", "b.caption.txt": " \n", "b.txt": "fallback caption"}.items():
        (root / name).write_text(body)
    return root


def test_scan(spark, folder, tmp_path):
    rows = scan.image_records(spark, str(folder)).orderBy("relative_image_path").collect()
    assert [(r.relative_image_path, r.width, r.height) for r in rows] == [("a.png", 1, 1), ("b.png", 2, 3)]
    assert tuple(rows[0].caption_sources) == ("tag_one, tag two", "short caption", "painterly")
    assert tuple(rows[1].caption_sources) == ("legacy_tag_source", "fallback caption", None)
    assert (len(rows[0].hashes.md5), len(rows[0].hashes.sha256)) == (32, 64) and not rows[1].caption_presence.has_style_tags
    records = scan.image_records(spark, str(folder))
    assert scan.summarize(records).first().asDict() == {"total_images": 2, "with_booru_tags": 2, "with_short_caption": 2, "with_style_tags": 1, "total_pixels": 7, "by_extension": {".png": 2}}
    sinks.write_json_lines(records, str(tmp_path / "out"), ["relative_image_path"])
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["relativeImagePath"] for x in lines] == ["a.png", "b.png"] and lines[1]["captionSources"]["styleTags"] is None


def test_scan_errors(spark, folder, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan.image_records(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        scan.image_records(spark, " ")
    (folder / "c.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="Unsupported image format"):
        scan.image_records(spark, str(folder)).collect()


def test_text_marks_and_names(spark, folder):
    (folder / "sub dir" / "x+y é.PNG").write_bytes(png(np.full((2, 2, 3), 1, np.uint8)))
    (folder / "50%41 [x].png").write_bytes(png(np.full((2, 2, 3), 1, np.uint8)))
    (folder / "sub dir" / "x+y é.txt").write_bytes("﻿wide".encode("utf-16-le"))
    rows = {r.relative_image_path: r for r in scan.image_records(spark, str(folder)).collect()}
    assert "50%41 [x].png" in rows
    assert rows["sub dir/x+y é.PNG"].caption_sources.short_caption == "wide"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (b"\xff\xfe" + "né😀".encode("utf-16-le"), "né😀"),
        (b"\xfe\xff" + "né😀".encode("utf-16-be") + b"\x41", "né😀\ufffd"),
        (b"\xff\xfe" + b"\x3d\xd8a\x00\x00\xdcb\x00", "\ufffda\ufffdb"),
        (b"\xff\xfe\x00\x00" + "a😀".encode("utf-32-le"), "a😀"),
        (b"\x00\x00\xfe\xff" + "a😀".encode("utf-32-be") + b"\x00\x11\x00\x00\x00\x00\xd8\x00\x01", "a😀\ufffd\ufffd\ufffd"),
        (b"\xef\xbb\xbfx\xffy", "x\ufffdy"),
        (b"", ""),
    ],
)
def test_text_of_any_mark(spark, raw, want):
    frame = spark.createDataFrame([(bytearray(raw),)], "c binary")
    assert frame.select(scan.decode_text(F.col("c")).alias("t")).first().t == want


def tiff(order, width, height, kind):
    entry = lambda tag, value: struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
    body = b"padding!" + struct.pack(order + "H", 3) + entry(254, 0) + entry(256, width) + entry(257, height) + b"\0\0\0\0"
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 16) + body


def jpeg(width, height, marker=0xC2):
    segment = lambda kind, data: b"\xff" + bytes([kind]) + struct.pack(">H", len(data) + 2) + data
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + b"x" * 300) + segment(0xE2, b"\xff\xc0" * 20) + b"\xff" + segment(0xDB, b"q" * 65) + segment(0xC4, b"h" * 30) + segment(marker, struct.pack(">BHHB", 8, height, width, 4) + b"c" * 12) + b"\xff\xda"


def test_sizes_from_headers(spark):
    files = [(jpeg(640, 480), (640, 480)), (jpeg(5, 70, 0xC0), (5, 70)), (jpeg(5, 70, 0xC4), None), (tiff("<", 300, 20, 3), (300, 20)), (tiff(">", 70000, 20, 4), (70000, 20)), (tiff(">", 9, 20, 3), (9, 20)), (b"GIF89a\x05\x00\x06\x00", (5, 6)), (b"\xff\xd8", None), (b"", None)]
    frame = spark.createDataFrame([(i, bytearray(raw)) for i, (raw, _) in enumerate(files)], "i int, c binary")
    found = {r.i: r.d for r in frame.select("i", scan.dimensions(F.col("c")).alias("d")).collect()}
    assert [found[i] and tuple(found[i]) for i in range(len(files))] == [want for _, want in files]


def test_lists_of_files(spark, folder, monkeypatch):
    monkeypatch.chdir(folder)
    paths = [str(folder / "a.png"), "b.png", "./b.png", " ", None, "sub dir/../a.png"]
    assert scan.listed_files(spark, paths) == [str(folder / "a.png"), str(folder / "b.png")]
    assert scan.listed_files(spark, [None, "\t"]) == []
    with pytest.raises(FileNotFoundError):
        scan.listed_files(spark, ["none.png"])
    (folder / "x[1].png").write_bytes((folder / "a.png").read_bytes())
    prints = images.listed_fingerprints(spark, ["a.png", "b.png", "x[1].png", "a.png"])
    assert prints.count() == 3 == prints.where("phash IS NOT NULL").count() and prints.select("sha256").distinct().count() == 2


def test_hash_kernel():
    luma = np.random.default_rng(1).integers(0, 255, (32, 32)).astype(float)
    c = np.zeros((8, 8))
    for v in range(8):
        for u in range(8):
            x = np.arange(32)
            scale = (np.sqrt(1 / 32) if u == 0 else np.sqrt(2 / 32)) * (np.sqrt(1 / 32) if v == 0 else np.sqrt(2 / 32))
            c[v, u] = scale * (luma * np.cos((2 * x[None, :] + 1) * u * np.pi / 64) * np.cos((2 * x[:, None] + 1) * v * np.pi / 64)).sum()
    flat = c.ravel()
    want = sum(1 << i for i in range(1, 64) if flat[i] > np.median(flat[1:]))
    assert images.hash_bits(luma) & (2**64 - 1) == want and bin(want).count("1") == 31
    near = np.clip(luma + 3, 0, 255)
    assert bin((images.hash_bits(luma) ^ images.hash_bits(near)) & (2**64 - 1)).count("1") <= 8


def test_job(spark, folder, tmp_path):
    for name, seed in (("t1.png", 1), ("t2.png", 2)):
        (folder / name).write_bytes(png(textured(seed)))
    (folder / "t1_copy.png").write_bytes(png(textured(1)))
    shifted = textured(1)
    shifted[:2, :2] ^= 3
    (folder / "t1_near.png").write_bytes(png(shifted))
    rules = tmp_path / "rules.json"
    rules.write_text('{"rules":[{"id":"r","severity":"Info","conditions":[{"signal":"sampleCount","operator":"GreaterThan","value":1}]}]}')
    seen = []
    status = JobRunner(spark, lambda s: seen.append((s.stage, s.percent))).run(JobRequest(str(folder), str(tmp_path / "out"), str(rules)))
    assert status.state == COMPLETED and status.percent == 100 and not status.is_cancelable and len(seen) > 5
    made = status.outputs["artifacts"]
    assert json.loads((tmp_path / "out/recommendations.json").read_text())["matches"][0]["ruleId"] == "r"
    metrics = json.loads((tmp_path / "out/metrics.json").read_text("utf-8-sig"))
    assert metrics["sampleCount"] == 6 and metrics["nearDuplicateRateHook"]["rate"] > 0
    groups = [json.loads(x) for p in (tmp_path / "out/duplicates/exact_groups").glob("part-*") for x in p.read_text().splitlines()]
    assert any({p.rsplit("/", 1)[1] for p in g["paths"]} == {"t1.png", "t1_copy.png"} for g in groups)
    log = (tmp_path / "out/job.log").read_text()
    assert "[Information]" in log and "Completed" in log
    assert set(made) >= {"dataset_jsonl", "summary_index", "metrics_json", "metrics_markdown", "recommendations_json", "duplicates_json"}


def test_job_cancel_and_failure(spark, folder, tmp_path):
    runner = JobRunner(spark)
    runner.progress = lambda s: runner.cancel() if s.stage == "validate" else None
    assert runner.run(JobRequest(str(folder), str(tmp_path / "out"))).state == "Canceled"
    assert not runner.cancel()
    runner = JobRunner(spark)
    with pytest.raises(FileNotFoundError):
        runner.run(JobRequest(str(tmp_path / "none"), str(tmp_path / "out")))
    assert runner.status.state == FAILED and runner.status.error == "FileNotFoundError"
