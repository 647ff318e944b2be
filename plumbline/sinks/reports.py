"""Reports of an audit: CSV and JSON of whole tables, written by Spark and streamed; HTML and PDF of bounded parts by the driver."""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.errors import ConfigError
from plumbline.functions.columns import guarded
from plumbline.session import Audit
from plumbline.sinks import parts

FORMATS = ("json", "csv", "html", "pdf")
CSV_KINDS = ("images", "findings", "issues", "duplicates")
BARS, GROUPS, PDF_FINDINGS, PDF_EXAMPLES = 14, 12, 25, 3


def file_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "_", name) or "report"


def csv_rows(audit: Audit, kind: str) -> DataFrame:
    """The rows of a CSV report, texts guarded against being taken for formulas."""
    if kind == "images":
        names = audit["boxes"].join(audit["classes"].select("class_id", "name"), "class_id").groupBy(F.col("image_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ";").alias("classes"))
        two = lambda c: F.round(c, 2).alias(c)
        df = audit["images"].join(names, "id", "left").select(
            "id", "path", "split", "status", "error", "file_size", "format", "width", "height", "aspect_ratio", "channels", "is_grayscale", two("blur_score"), two("brightness"), two("contrast"),
            "sha256", "phash", "dhash", "label_path", "label_status", "n_boxes", F.col("invalid_lines").alias("invalid_annotation_count"), F.coalesce("classes", F.lit("")).alias("classes"), F.array_join("tags", ";").alias("tags"),
        ).orderBy("path")
    elif kind == "findings":
        df = audit["findings"].select("id", "severity", "category", "title", "affected_count", "rate", "recommendation", F.array_join("examples", ";").alias("examples"))
    elif kind == "issues":
        df = audit["issues"].orderBy("seq").select("code", "level", "message", "label_path", "image_path", "split", "line", "raw")
    elif kind == "duplicates":
        df = audit["dup_members"].join(audit["dup_groups"].select("group_id", "size", "max_distance"), "group_id").select("group_id", "kind", "scope", "size", "max_distance", "split", "path", "sha256").orderBy("group_id", "split", "path")
    else:
        raise ConfigError(f"CSV kinds are {', '.join(CSV_KINDS)}")
    return df.select(*[guarded(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_csv(audit: Audit, kind: str, path: str) -> None:
    """A folder of CSV files; ``stream_csv`` gives one text."""
    csv_rows(audit, kind).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def stream_csv(audit: Audit, kind: str) -> Iterator[bytes]:
    """One CSV text, in chunks."""
    df = csv_rows(audit, kind)
    yield (",".join(df.columns) + "\n").encode()
    yield from parts.stream(df.select(parts.csv_line(df).alias("value")))


def stream_json(audit: Audit, include_images: bool = False) -> Iterator[bytes]:
    """One JSON text, in chunks: the summary and the whole tables, those of images, their boxes and findings only if asked for."""
    skip = set() if include_images else {"images", "boxes", "affected"}
    yield b'{"audit": ' + json.dumps(audit.meta, ensure_ascii=False).encode()
    for name, df in audit.tables.items():
        if name not in skip:
            yield b",\n" + json.dumps(name).encode() + b": [\n"
            yield from parts.joined(parts.stream(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))), b",\n")
            yield b"\n]"
    yield b"}\n"


def to_csv(audit: Audit, kind: str) -> str:
    """One CSV text as a whole."""
    return b"".join(stream_csv(audit, kind)).decode()


def to_json(audit: Audit, include_images: bool = False) -> str:
    """One JSON text as a whole."""
    return b"".join(stream_json(audit, include_images)).decode()


def svg_bars(rows: list[tuple[str, float]], width: int = 480) -> str:
    """Horizontal bars of the first rows; labels are cut to 18 characters."""
    rows = rows[:BARS]
    top = max([v for _, v in rows], default=0) or 1
    bars = []
    for n, (label, v) in enumerate(rows):
        y, w = 22 * n, (width - 220) * v / top
        bars.append(f'<text x="0" y="{y + 14}">{html.escape(str(label)[:18])}</text><rect x="150" y="{y + 3}" width="{w:.1f}" height="14" rx="2" fill="#4a6fa5"/><text x="{155 + w:.1f}" y="{y + 14}">{v:g}</text>')
    return f'<svg role="img" viewBox="0 0 {width} {22 * len(rows)}" width="{width}" font-size="12" font-family="sans-serif">{"".join(bars)}</svg>'


def svg_ring(score: float | None) -> str:
    """A ring filled to the score."""
    share = (score or 0) / 100
    colour = "#2e7d32" if share >= 0.8 else "#9e9d24" if share >= 0.6 else "#ef6c00" if share >= 0.4 else "#c62828"
    full = 2 * 3.14159265 * 42
    text = "n/a" if score is None else f"{score:g}"
    return f'<svg viewBox="0 0 100 100" width="120"><circle cx="50" cy="50" r="42" fill="none" stroke="#ddd" stroke-width="10"/><circle cx="50" cy="50" r="42" fill="none" stroke="{colour}" stroke-width="10" stroke-dasharray="{full * share:.1f} {full:.1f}" transform="rotate(-90 50 50)"/><text x="50" y="57" text-anchor="middle" font-size="22">{text}</text></svg>'


def _table(names: list[str], rows: list) -> str:
    cell = lambda x: html.escape("" if x is None else f"{x:.4g}" if isinstance(x, float) else ", ".join(map(str, x)) if isinstance(x, (list, tuple)) else str(x))
    head = "".join(f"<th>{cell(n)}</th>" for n in names)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{''.join('<tr>' + ''.join(f'<td>{cell(x)}</td>' for x in r) + '</tr>' for r in rows)}</tbody></table>"


def _parts(audit: Audit) -> list[tuple[str, list[str], list]]:
    """(title, columns, rows) of the parts that a report shows; each is bounded."""
    shown = [
        ("Components", audit["health_components"].orderBy("place").select("key", "metric", "score", "weight", "applicable"), 8),
        ("Findings", audit["findings"].orderBy("place", F.desc("affected_count"), "id").select("severity", "title", "affected_count", "recommendation", F.slice("examples", 1, PDF_EXAMPLES).alias("examples")), 100),
        ("Splits", audit["splits"], 20),
        ("Classes", audit["classes"].orderBy(F.desc("count"), "class_id").select("class_id", "name", "count", "images", "share"), 50),
        ("Issues", audit["issues"].groupBy("code", "level").count().orderBy(F.desc("count"), "code"), 20),
        ("Leakage", audit["leakage_pairs"].select("a", "b", "exact_groups", "perceptual_groups", "images_a", "images_b"), 20),
        ("Duplicates", audit["dup_groups"].orderBy(F.desc("size"), "group_id").select("group_id", "kind", "scope", "size", "first_path"), GROUPS),
    ]
    return [(title, df.columns, [tuple(r) for r in df.limit(most).collect()]) for title, df, most in shown]


def to_html(audit: Audit) -> str:
    """A page on its own, without scripts."""
    o = audit["health_overall"].first()
    m = audit.meta
    bins = {}
    for r in audit["histograms"].orderBy("histogram", "bin").collect():  # some fifty rows
        bins.setdefault(r.histogram, []).append((r.label, r["count"]))
    body = "".join(f"<h2>{t}</h2>{_table(c, r)}" for t, c, r in _parts(audit)) + "<h2>Histograms</h2>" + "".join(f"<h3>{html.escape(k)}</h3>{svg_bars(v)}" for k, v in bins.items())
    style = "body{font:14px sans-serif;margin:2em auto;max-width:1000px}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:3px 8px;text-align:left}"
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(m["dataset"])}</title><style>{style}</style></head><body><h1>{html.escape(m["dataset"])}</h1><p>{html.escape(m["created_at"])}, {html.escape(m["mode"])}, grade {o.grade or "n/a"}</p>{svg_ring(o.overall)}{body}</body></html>'


def _pdf(pages: list[list[str]]) -> bytes:
    """A PDF of pages of text lines; characters outside of Windows-1252 become question marks."""
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    add(b"<< /Type /Catalog /Pages 2 0 R >>")
    add(b"")
    font = add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
    kids = []
    for lines in pages:
        text = b"BT /F1 9 Tf 12 TL 40 800 Td " + b" ".join(b"(" + re.sub(rb"([\\()])", rb"\\\1", x.encode("cp1252", "replace")) + b") Tj T*" for x in lines) + b" ET"
        packed = zlib.compress(text)
        stream = add(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed))
        kids.append(add(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents %d 0 R /Resources << /Font << /F1 %d 0 R >> >> >>" % (stream, font)))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def to_pdf(audit: Audit) -> bytes:
    o, m = audit["health_overall"].first(), audit.meta
    lines = [m["dataset"], f"{m['created_at']}, {m['mode']}", f"Score {'n/a' if o.overall is None else o.overall}, grade {o.grade or 'n/a'}", ""]
    for title, names, rows in _parts(audit):
        lines += [title, " | ".join(names)] + [" | ".join("" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x) for x in r)[:120] for r in (rows[:PDF_FINDINGS] if title == "Findings" else rows)] + [""]
    return _pdf([lines[n : n + 62] for n in range(0, len(lines), 62)])


def stream(audit: Audit, fmt: str, csv_kind: str = "images", include_images: bool = False) -> tuple[str, Iterator[bytes]]:
    """(file name, chunks) of a report; HTML and PDF are bounded and come whole."""
    base = file_name(f"{audit.meta['dataset']}-{audit.id}")
    if fmt == "json":
        return f"{base}.json", stream_json(audit, include_images)
    if fmt == "csv":
        if csv_kind not in CSV_KINDS:
            raise ConfigError(f"CSV kinds are {', '.join(CSV_KINDS)}")
        return f"{base}-{csv_kind}.csv", stream_csv(audit, csv_kind)
    if fmt == "html":
        return f"{base}.html", iter([to_html(audit).encode()])
    if fmt == "pdf":
        return f"{base}.pdf", iter([to_pdf(audit)])
    raise ConfigError(f"formats are {', '.join(FORMATS)}")


def generate(audit: Audit, fmt: str, csv_kind: str = "images", include_images: bool = False) -> tuple[str, bytes]:
    """(file name, content) of a report as a whole."""
    name, chunks = stream(audit, fmt, csv_kind, include_images)
    return name, b"".join(chunks)


def write(audit: Audit, folder: str | Path, formats: list[str] | None = None) -> list[Path]:
    """All reports, with a CSV file for each kind, into a folder."""
    out = []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for fmt in formats or FORMATS:
        for kind in CSV_KINDS if fmt == "csv" else ("images",):
            name, chunks = stream(audit, fmt, kind)
            with (path := Path(folder, name)).open("wb") as f:
                f.writelines(chunks)
            out.append(path)
    return out
