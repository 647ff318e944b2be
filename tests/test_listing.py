"""Listing and claims as tables, on mounted folders and by URIs that only Spark opens."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.errors import SecurityError
from plumbline.session import AuditSession
from plumbline.sources import demo, paths, yolo
from plumbline.sources.listing import Folder, ancestors, listing, normal, parent, stem, suffix


@pytest.fixture
def tree(tmp_path):
    r = random.Random(1)
    for n in range(120):
        rel = "/".join(r.choice(["a", "b", "c d", "é"]) for _ in range(r.randrange(5)))
        (tmp_path / "set" / rel).mkdir(parents=True, exist_ok=True)
        (tmp_path / "set" / rel / f"{n}.txt").write_bytes(b"x" * (n % 7))
    (tmp_path / "out.txt").write_text("out")
    (tmp_path / "set" / "leads_out").symlink_to(tmp_path / "out.txt")
    (tmp_path / "set" / "leads_in").symlink_to(tmp_path / "set" / "0.txt")
    (tmp_path / "set" / "linked").symlink_to(tmp_path / "set" / "a")
    (tmp_path / "set" / "dead").symlink_to(tmp_path / "set" / "nothing")
    return tmp_path / "set"


def walked(root) -> set[tuple]:
    out = set()
    for top, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if not os.path.islink(os.path.join(top, d))]
        out |= {(os.path.relpath(os.path.join(top, n), root), os.path.getsize(os.path.join(top, n)), os.stat(os.path.join(top, n)).st_mtime_ns) for n in names if os.path.isfile(os.path.join(top, n))}
    return out


@pytest.fixture
def uri(spark, tmp_path):
    """A scheme that Arrow doesn't know: only Spark's own file systems open it."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.lists.link./in", f"file://{tmp_path}")
    conf.set("fs.viewfs.impl.disable.cache", "true")
    return "viewfs://lists/in"


def test_all_files_are_listed(spark, tree):
    got = {tuple(r) for r in listing(Folder(spark, tree)).collect()}
    inside = {x for x in walked(tree) if x[0] not in ("leads_out", "leads_in", "linked")}
    assert {x for x in got if not x[0].startswith(("lead", "dead"))} == inside
    assert {x[0] for x in got if x[0].startswith(("lead", "dead"))} == {"leads_in", "dead"} and [x[1:] for x in got if x[0] == "dead"] == [(None, None)]


def test_a_uri_is_listed_alike(spark, tree, uri):
    for name in ("leads_out", "leads_in", "linked", "dead"):
        (tree / name).unlink()
    there, here = Folder(spark, f"{uri}/set"), Folder(spark, tree)
    assert {tuple(r)[:2] for r in listing(there).collect()} == {tuple(r)[:2] for r in listing(here).collect()} == {x[:2] for x in walked(tree)}
    assert there.is_dir("a") and there.is_file("0.txt") is here.is_file("0.txt") and there.dirs("") == here.dirs("") and there.place("a", "..") == ""
    assert there.place("", "../x") is None and there.place("", "/etc") is None and there.place("", f"{uri}/set/a") == "a"


def test_an_audit_of_a_uri_finds_what_one_of_its_path_finds(spark, tmp_path, uri):
    demo.generate(tmp_path / "demo")
    tables = []
    for root in (f"{uri}/demo", str(tmp_path / "demo")):
        a = AuditSession(spark).run(root)
        tables.append([sorted(map(str, a[t].select(*c).collect())) for t, c in (("images", ["path", "split", "status", "sha256", "phash", "label_status", "tags"]), ("issues", ["code", "label_path", "line"]), ("findings", ["id", "severity", "affected_count"]))])
        tables[-1].append(a.meta["splits"])
    assert tables[0] == tables[1] and len(tables[0][0]) > 50


def test_lists_name_files_by_folder_root_and_whole_path(spark, tmp_path, uri):
    for n in range(9):
        for d in ("images", "lists/images"):
            (tmp_path / "set" / d).mkdir(parents=True, exist_ok=True)
            (tmp_path / "set" / d / f"{n}.png").write_bytes(b"x")
    lines = ["./../images/0.png", "images/1.png", "  images/2.png\t", f"{tmp_path}/set/images/3.png", "../../set/images/4.png", f"{uri}/set/images/5.png", "../images/../images/./6.png", "images/none.png", "", "images/1.png", "/etc/passwd"]
    (tmp_path / "set" / "lists" / "train.txt").write_text("\r\n".join(lines))
    (tmp_path / "set" / "lists" / "val.txt").write_text("../images/0.png\n../images/7.png")
    (tmp_path / "set" / "data.yaml").write_text("names: [a]\ntrain: lists/train.txt\nval: [lists/val.txt, lists/images]\n")
    own = {r.path: r.split for r in yolo.discover(spark, tmp_path / "set").files.collect()}
    want = {"images/0.png": "train", "lists/images/1.png": "train", "lists/images/2.png": "train", "images/3.png": "train", "images/6.png": "train", "images/7.png": "val"} | {f"lists/images/{n}.png": "val" for n in (0, 3, 4, 5, 6, 7, 8)}
    assert own == want
    by_uri = {r.path: r.split for r in yolo.discover(spark, f"{uri}/set").files.collect()}
    assert by_uri == {k: v for k, v in want.items() if k != "images/3.png"} | {"images/5.png": "train"}


@pytest.mark.parametrize(("path", "out"), [("a/b.jpg", "a/b.txt"), ("images/x/y.tar.gz", "labels/x/y.tar.txt"), ("images/IMAGES/a.png", "images/labels/a.txt"), ("images", "images.txt"), ("a/images/.png", "a/labels/.png.txt"), ("images/a..jpg", "labels/a..txt"), ("images/noext", "labels/noext.txt")])
def test_label_paths(spark, path, out):
    assert spark.createDataFrame([(path,)], "p string").select(yolo.label_path(F.col("p"))).first()[0] == out


def test_paths_as_columns(spark):
    r = random.Random(3)
    made = ["/".join(r.choice(["a", "b", ".", "..", "", ".x", "x.y", "..z.q"]) for _ in range(r.randrange(1, 7))) for _ in range(400)]
    rows = spark.createDataFrame([(m,) for m in made], "p string").select("p", normal(F.col("p")), parent(F.col("p")), suffix(F.col("p")), stem(F.col("p")), ancestors(F.col("p"))).collect()
    for p, n, up, end, start, above in rows:
        out: list | None = []
        for s in p.split("/"):
            out = out if s in ("", ".") else None if out is None or (s == ".." and not out) else out[:-1] if s == ".." else [*out, s]
            if out is None:
                break
        assert n == (None if out is None else "/".join(out)), p
        assert (up, os.path.splitext(os.path.basename(p))) == (re.sub("/?[^/]*$", "", p), (start, end)), p
        assert above == ["/".join(p.split("/")[:k]) for k in range(p.count("/") + 1)]


def test_uris_are_held_against_allowed_ones():
    assert paths.dataset_path("s3://b/set", ["s3://b"]) == "s3://b/set" == paths.dataset_path("s3://b/set")
    for bad in ("s3://c/set", "s3://b/../c"):
        with pytest.raises(SecurityError):
            paths.dataset_path(bad, ["s3://b"])
