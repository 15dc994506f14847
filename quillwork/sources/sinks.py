"""Deterministic outputs through Spark's file systems: canonical lines, CSV and JSON with fixed bytes, releases, archives."""

from __future__ import annotations

import functools
import gzip
import hashlib
import json
import math
import shutil
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions.hashing import canonical, canonical_json

MANIFEST, SEAL = "manifest.json", "manifest.sha256"


@functools.singledispatch
def cell(v: Any) -> str:
    """The text of a value in a CSV field, before quoting."""
    return str(v)


cell.register(type(None), lambda v: "")
cell.register(bool, lambda v: str(v).lower())
cell.register(float, lambda v: "" if math.isnan(v) else repr(v))
cell.register(dict, canonical)
cell.register(list, canonical)


def csv_line(values: Iterable[Any]) -> str:
    """One line without its end; a field is quoted if it holds a comma, a quote or a line end."""
    fields = [cell(v) for v in values]
    if fields == [""]:
        return '""'
    return ",".join('"' + f.replace('"', '""') + '"' if any(c in f for c in ',"\n\r') else f for f in fields)


def csv_text(rows: list[dict[str, Any]]) -> str:
    """A small table whose rows may lack keys: the header has all keys, the first seen first."""
    names: dict[str, None] = {}
    for r in rows:
        names.update(dict.fromkeys(r))
    return "".join(csv_line(x) + "\n" for x in (names, *([r.get(n) for n in names] for r in rows)))


def _null_for_nan(v: Any) -> Any:
    if isinstance(v, dict):
        return {k: _null_for_nan(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_null_for_nan(x) for x in v]
    return None if v != v else v


def json_text(value: Any) -> str:
    return json.dumps(_null_for_nan(value), ensure_ascii=False, allow_nan=False, indent=2, sort_keys=True) + "\n"


def gzip_bytes(text: str) -> bytes:
    return gzip.compress(text.encode(), mtime=0)


def _lines(df: DataFrame, make) -> DataFrame:
    """``line``: ``make`` of each row, as a dict, in the order of ``df``."""
    names = df.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            yield pa.RecordBatch.from_arrays([pa.array([make(dict(zip(names, r))) for r in zip(*columns)], pa.string())], ["line"])

    return df.mapInArrow(run, "line string")


def canonical_lines(df: DataFrame) -> DataFrame:
    """``line``: each row as canonical JSON.  Columns without doubles stay in the JVM; others use Python's float text."""
    if any(t in ("double", "float") for _, t in df.dtypes):
        return _lines(df, lambda r: canonical(_null_for_nan(r)))
    return df.select(canonical_json({c: F.col(c) for c in df.columns}).alias("line"))


def csv_lines(df: DataFrame) -> DataFrame:
    return _lines(df, lambda r: csv_line(r.values()))


def write_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Canonical lines as text files, globally ordered where asked."""
    rows = df.orderBy(*order) if order else df
    canonical_lines(rows).write.mode("errorifexists").text(path)


class Store:
    """The file system of a URI, as Spark sees it, for whole small files and for joining the part files of a table."""

    def __init__(self, spark: SparkSession, uri: str) -> None:
        self.jvm = spark._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.FileSystem.newInstance(self.at(uri).toUri(), spark._jsc.hadoopConfiguration())
        self.fs.setWriteChecksum(False)

    def at(self, uri: str):
        return self.jvm.org.apache.hadoop.fs.Path(uri)

    def exists(self, uri: str) -> bool:
        return self.fs.exists(self.at(uri))

    def move(self, source: str, target: str) -> None:
        if not self.fs.rename(self.at(source), self.at(target)):
            raise OSError(f"{source} can't be moved to {target}")

    def delete(self, uri: str) -> None:
        self.fs.delete(self.at(uri), True)

    def read(self, uri: str) -> bytes:
        stream = self.fs.open(self.at(uri))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, uri: str, head: bytes, parts: str | None = None) -> str:
        """``head``, then the part files of the folder ``parts`` in order; the SHA-256 of all of it."""
        digest = self.jvm.java.security.MessageDigest.getInstance("SHA-256")
        out = self.jvm.java.security.DigestOutputStream(self.fs.create(self.at(uri), False), digest)
        try:
            out.write(bytearray(head))
            for f in sorted((f.getPath().toString() for f in self.fs.listStatus(self.at(parts))) if parts else ()):
                if f.rpartition("/")[2].startswith("part-"):
                    stream = self.fs.open(self.at(f))
                    try:
                        self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                    finally:
                        stream.close()
        finally:
            out.close()
        return bytes(b & 255 for b in digest.digest()).hex()


class Release:
    """A version's files: collected out of sight, then published together.

    ``publish`` moves an older release of the same version aside, the new one into place, and only then deletes the old;
    if the second move fails, the first is undone.  Another version's files are never replaced."""

    def __init__(self, spark: SparkSession, target: str, version: str, keep_out: tuple[str, ...] = ()) -> None:
        self.spark, self.store, self.target, self.version = spark, Store(spark, target), target.rstrip("/"), version
        whole = lambda uri: self.store.fs.makeQualified(self.store.at(uri.rstrip("/"))).toString() + "/"
        if any(whole(self.target).startswith(whole(k)) for k in keep_out):
            raise ValueError(f"{target} is kept out")
        parent, _, name = self.target.rpartition("/")
        self.draft = f"{parent}/_draft-{name}-{uuid.uuid4().hex}"
        self.digests: dict[str, str] = {}

    def add(self, name: str, data: str | bytes, parts: str | None = None) -> None:
        self.digests[name] = self.store.write(f"{self.draft}/{name}", data.encode() if isinstance(data, str) else data, parts)

    def table(self, name: str, df: DataFrame, order: list[str] | None = None) -> None:
        """``df`` as one CSV file; its rows go from the executors to the store and never to the driver."""
        parts = f"{self.draft}/_parts-{uuid.uuid4().hex}"
        csv_lines(df.orderBy(*order) if order else df).write.text(parts)
        self.add(f"tables/{name}.csv", csv_line(df.columns) + "\n", parts)
        self.store.delete(parts)

    def publish(self, expected: set[str] | None = None, replace: bool = False) -> None:
        odd = expected ^ self.digests.keys() if expected is not None else set()
        if odd:
            raise ValueError(f"not as expected: {', '.join(sorted(odd))}")
        there = self.store.exists(self.target)
        if there and not (replace and self.store.exists(f"{self.target}/{MANIFEST}") and json.loads(self.store.read(f"{self.target}/{MANIFEST}")).get("version") == self.version):
            raise ValueError(f"{self.target} is not this release's to replace")
        seal = self.store.write(f"{self.draft}/{MANIFEST}", json_text({"files": self.digests, "version": self.version}).encode())
        self.store.write(f"{self.draft}/{SEAL}", f"{seal}\n".encode())
        if not there:
            return self.store.move(self.draft, self.target)
        aside = f"{self.draft}-replaced"
        self.store.move(self.target, aside)
        try:
            self.store.move(self.draft, self.target)
        except Exception:
            self.store.move(aside, self.target)
            raise
        self.store.delete(aside)


def audit(spark: SparkSession, target: str) -> DataFrame:
    """``file, problem`` of what is missing, changed or unlisted in a release; the manifest is held against its seal."""
    store = Store(spark, target)
    manifest = store.read(f"{target}/{MANIFEST}")
    listed = json.loads(manifest)["files"] | {MANIFEST: store.read(f"{target}/{SEAL}").decode().strip()}
    base = store.fs.makeQualified(store.at(target)).toUri().getPath()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(target)
    found = found.select(F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})").alias("file"), F.sha2("content", 256).alias("is")).filter(F.col("file") != SEAL)
    both = spark.createDataFrame(list(listed.items()), "file string, should string").join(found, "file", "full")
    problem = F.when(F.col("is").isNull(), "missing").when(F.col("should").isNull(), "unlisted").when(F.col("is") != F.col("should"), "changed")
    return both.select("file", problem.alias("problem")).filter(F.col("problem").isNotNull())


def provider_digest(data: bytes, algorithm: str) -> str:
    """The digest that a provider declares; ``git-blob`` is the SHA-1 of the blob with its header, ``none`` is empty."""
    if algorithm == "none":
        return ""
    if algorithm == "git-blob":
        algorithm, data = "sha1", b"blob %d\0" % len(data) + data
    if algorithm not in ("md5", "sha1", "sha256"):
        raise ValueError(f"no digest is named {algorithm}")
    return hashlib.new(algorithm, data).hexdigest()


def verify_bytes(data: bytes, size: int | None, algorithm: str, expected: str) -> str:
    """The SHA-256 of a download that has the size and digest declared for it."""
    problems = [f"it has {len(data)} bytes, not {size}"] * (size not in (None, len(data))) + [f"its {algorithm} digest is another"] * (provider_digest(data, algorithm) != (expected or "").lower())
    if problems:
        raise ValueError("; ".join(problems))
    return hashlib.sha256(data).hexdigest()


def archive_members(archive: str, skip: tuple[str, ...] = (".pkl", ".pickle")) -> list[tuple[str, str]]:
    """Each file of a ZIP archive with ``take``, ``skip`` (by its ending) or ``unsafe``: a link, a name that is absolute,
    has a drive or a back slash, or climbs out of its folder."""
    out = []
    with zipfile.ZipFile(archive) as z:
        for info in z.infolist():
            name = PurePosixPath(info.filename)
            link = info.external_attr >> 28 == 0xA
            climbs = name.is_absolute() or ".." in name.parts or any(c in info.filename for c in "\\:")
            if not info.is_dir():
                out.append((info.filename, "unsafe" if link or climbs else "skip" if info.filename.endswith(skip) else "take"))
    return out


def extract(archive: str, folder: str, skip: tuple[str, ...] = (".pkl", ".pickle")) -> list[str]:
    """Extracts what is to be taken, if no member is unsafe; the names taken."""
    members = archive_members(archive, skip)
    if bad := [n for n, verdict in members if verdict == "unsafe"]:
        raise ValueError(f"{archive} is refused for {bad[0]}")
    taken = [n for n, verdict in members if verdict == "take"]
    with zipfile.ZipFile(archive) as z:
        for n in taken:
            to = Path(folder, *PurePosixPath(n).parts)
            to.parent.mkdir(parents=True, exist_ok=True)
            with z.open(n) as source, to.open("wb") as out:
                shutil.copyfileobj(source, out)
    return taken
