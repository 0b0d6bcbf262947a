"""Archives as tables: members of tar, zip and gzip files, counts of diagram marks, media keyed by their hash."""

from __future__ import annotations

import gzip
import io
import posixpath
import tarfile
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most members of an archive, bytes of a member, bytes of an archive's members; beginning of an SVG file that tells it.
MEMBERS, MEMBER_BYTES, ALL_BYTES, SVG_HEAD = 20_000, 64 << 20, 512 << 20, 1 << 20


def safe(name: str) -> bool:
    """A relative name that stays inside the folder it is put in."""
    return bool(name) and not name.startswith(("/", "\\")) and "\\" not in name and ":" not in name.split("/")[0] and ".." not in posixpath.normpath(name).split("/")


def members(data: bytes):
    """(name, bytes) of each file: tar first, then zip, then gzip, else the bytes themselves. What breaks a limit is an error."""

    def limited(found):
        total = 0
        for n, (name, size, read) in enumerate(found):
            total += size
            if n >= MEMBERS or size > MEMBER_BYTES or total > ALL_BYTES:
                raise ValueError("archive too large")
            if safe(name):
                yield name, read()

    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tar:
            yield from limited((m.name, m.size, lambda m=m: tar.extractfile(m).read()) for m in tar if m.isfile())
        return
    except (tarfile.TarError, zlib.error, EOFError, OSError):
        pass
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            yield from limited((i.filename, i.file_size, lambda i=i: z.read(i)) for i in z.infolist() if not i.is_dir())
        return
    if data[:2] == b"\x1f\x8b":
        with gzip.open(io.BytesIO(data)) as f:
            raw = f.read(MEMBER_BYTES + 1)
        if len(raw) > MEMBER_BYTES:
            raise ValueError("archive too large")
        yield "main", raw
        return
    yield "main", data


def extract(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, member, data, error): a row for each file of each archive; one with `error` for an archive that can't be read."""

    def run(batches):
        for b in batches:
            for p, c in zip(*[b.column(i).to_pylist() for i in (0, 1)], strict=True):
                try:
                    for name, data in members(c or b""):
                        yield batch([p], [name], [data], [None])
                except (ValueError, RuntimeError, OSError, zlib.error, EOFError, zipfile.BadZipFile) as e:
                    yield batch([p], [None], [None], [f"{type(e).__name__}: {e}"])

    def batch(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], ["path", "member", "data", "error"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, "path string, member string, data binary, error string")


def probe(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Per archive: files and bytes read, files with TikZ marks, files with SVG marks; nothing is kept."""
    m = extract(files, path, content)
    suffix = F.lower(F.regexp_extract("member", r"\.([A-Za-z0-9]+)$", 1))
    text = F.decode("data", "ISO-8859-1")
    tikz = suffix.isin("tex", "tikz", "pgf", "sty") & text.rlike(r"\\begin\s*\{tikzpicture\}|\\tikz\b")
    svg = (suffix == "svg") & F.decode(F.substring("data", 1, SVG_HEAD), "ISO-8859-1").rlike(r"(?i)<svg[\s>]")
    return m.groupBy("path").agg(F.count("member").alias("files"), F.sum(F.length("data")).cast("long").alias("bytes"), F.count_if(tikz).alias("tikz_files"), F.count_if(svg).alias("svg_files"), F.max("error").alias("error"))


def media(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, sha256, member, data) of a deck's embedded media; of equal ones the first by name."""
    m = extract(files, path, content).filter(F.col("member").rlike("^ppt/media/"))
    return m.withColumn("sha256", F.sha2("data", 256)).groupBy("path", "sha256").agg(F.min_by(F.struct("member", "data"), "member").alias("r")).select("path", "sha256", "r.*")


def find_source(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted (path, source_filename, sha256): the member of that name with that hash, else any PDF with it; equal bytes count once."""
    m = extract(archives).filter("data IS NOT NULL").withColumn("h", F.sha2("data", 256))
    hit = wanted.join(m, "path").filter(F.col("h") == F.col("sha256"))
    rank = F.when(F.col("member") == F.col("source_filename"), 0).when(F.lower("member").endswith(".pdf"), 1)
    best = hit.withColumn("rank", rank).filter("rank IS NOT NULL").groupBy("path", "source_filename", "sha256").agg(F.min_by(F.struct("member", "data"), F.struct("rank", "member")).alias("r"))
    missing = F.raise_error(F.concat(F.lit("no such source in "), "path")).cast("string")
    out = wanted.join(best, ["path", "source_filename", "sha256"], "left")
    return out.select("path", "source_filename", "sha256", F.coalesce("r.member", missing).alias("member"), "r.data")


