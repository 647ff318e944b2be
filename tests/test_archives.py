"""Archives that are unpacked by tasks, and those that stop it."""

from __future__ import annotations

import random
import zipfile

import pytest

from plumbline.errors import SecurityError
from plumbline.sources import archives
from plumbline.sources.paths import ZipLimits


def packed(path, members: dict[str, bytes], kind: int = zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", kind) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return path


@pytest.mark.parametrize("kind", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_members_come_out_as_they_went_in(spark, tmp_path, kind):
    r = random.Random(kind)
    members = {f"set/images/{n % 3}/é {n}.bin": r.randbytes(r.choice([0, 1, 500, 3_000_000 if n < 2 else 40])) for n in range(60)} | {"set/labels/a.txt": b"0 0 0 1 1", "set/zeros.bin": bytes(300_000), "set/empty/": b""}
    root = archives.extract(spark, packed(tmp_path / "a.zip", members, kind), tmp_path / "out", ZipLimits(ratio=2000))
    assert root == tmp_path / "out" / "set"
    assert {p.relative_to(tmp_path / "out").as_posix(): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {n: d for n, d in members.items() if not n.endswith("/")}
    assert archives.extract(spark, packed(tmp_path / "none.zip", {}), tmp_path / "none") == tmp_path / "none"


@pytest.mark.parametrize("name", ["../x", "/x", "C:x", "a/../../x", "a\\..\\..\\x"])
def test_hostile_archives(spark, tmp_path, name):
    with pytest.raises(SecurityError):
        archives.extract(spark, packed(tmp_path / "h.zip", {name: b"x"}), tmp_path / "out")
    assert not (tmp_path / "out").exists()


def test_archives_over_limits(spark, tmp_path):
    (tmp_path / "n.zip").write_text("no")
    two = packed(tmp_path / "t.zip", {"a": b"x" * 900, "b": b"y" * 900}, zipfile.ZIP_STORED)
    link = zipfile.ZipInfo("l")
    link.external_attr = 0o120777 << 16
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z:
        z.writestr(link, "/etc/passwd")
    for path, limits in ((tmp_path / "n.zip", None), (packed(tmp_path / "b.zip", {"a": bytes(5_000_000)}), None), (two, ZipLimits(files=1)), (two, ZipLimits(member_bytes=899)), (two, ZipLimits(total_bytes=1799)), (tmp_path / "l.zip", None)):
        with pytest.raises(SecurityError):
            archives.extract(spark, path, tmp_path / "out", limits)
        assert not (tmp_path / "out").exists()


def test_members_that_are_not_what_the_list_says(spark, tmp_path):
    """The list is changed to claim less than is packed, or another checksum: tasks find it, and what came out is removed."""
    data = bytes(1000) + b"end" * 200
    for field in ("size", "crc", "place"):
        path = packed(tmp_path / f"{field}.zip", {"ok": b"fine", "bad": data})
        raw = bytearray(path.read_bytes())
        at = raw.rindex(b"PK\x01\x02")
        where, value = {"size": (at + 24, 900), "crc": (at + 16, 7), "place": (at + 42, 3)}[field]
        raw[where : where + 4] = value.to_bytes(4, "little")
        path.write_bytes(raw)
        with pytest.raises(SecurityError):
            archives.extract(spark, path, tmp_path / "out")
        assert not (tmp_path / "out").exists()
