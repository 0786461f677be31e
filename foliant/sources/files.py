"""Files as rows, evaluation sets, and generations of the index.

`folder` is a Python data source: it keeps files whose names Spark's own sources would drop (`_x`, `.y`), skips hidden
and tool folders, and reads each folder below the root in a task of its own. A file over the limit is a row with an
error, not a failure and not cut.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LIMIT = 64 << 20
# Folders that are never read.
SKIPPED = {"node_modules", "vendor", "__pycache__", "venv", "target", "dist", "build"}
SCHEMA = "path string, size long, modified double, content binary, error string"


def _kept(name: str) -> bool:
    return not name.startswith(".") and name not in SKIPPED


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, suffixes: tuple[str, ...], ignored: tuple[str, ...]):
        self.root, self.suffixes, self.ignored = os.path.realpath(root), suffixes, ignored

    def _shown(self, path: str) -> bool:
        """Not under an ignore pattern: of the path below the root, or of a name where the pattern has no slash."""
        rel = os.path.relpath(path, self.root)
        parts = rel.split(os.sep)
        return not any(fnmatch.fnmatch(rel, p.strip("/")) or any(fnmatch.fnmatch("/".join(parts[: i + 1]), p.strip("/")) for i in range(len(parts))) or ("/" not in p.strip("/") and any(fnmatch.fnmatch(x, p.strip("/")) for x in parts)) for p in self.ignored)

    def partitions(self) -> list[_Part]:
        with os.scandir(self.root) as found:
            below = sorted(e.path for e in found if e.is_dir(follow_symlinks=False) and _kept(e.name) and self._shown(e.path))
        return [_Part(self.root, False), *[_Part(p, True) for p in below]]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for folder, names, files in os.walk(partition.folder):
            names[:] = sorted(n for n in names if _kept(n) and self._shown(os.path.join(folder, n))) if partition.deep else []
            for name in sorted(files):
                path = os.path.join(folder, name)
                if os.path.isfile(path) and name.lower().endswith(self.suffixes) and self._shown(path):
                    s = os.stat(path)
                    if s.st_size > LIMIT:
                        yield path, s.st_size, s.st_mtime, None, "larger than the limit"
                    else:
                        with open(path, "rb") as f:
                            yield path, s.st_size, s.st_mtime, f.read(), None


class Folder(DataSource):
    """spark.read.format("folder").option("suffixes", ".md,.html").option("ignored", "drafts,*.tmp").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> _Reader:
        listed = lambda name: tuple(s for s in self.options.get(name, "").split(",") if s)
        return _Reader(self.options["path"], tuple(s.lower() for s in listed("suffixes")) or ("",), listed("ignored"))


def folder(spark: SparkSession, root: str, suffixes: str = "", ignored: str = "") -> DataFrame:
    spark.dataSource.register(Folder)
    return spark.read.format("folder").option("suffixes", suffixes).option("ignored", ignored).load(root)


CASES = "id string, query string, provenance string, relevant array<struct<pathSuffix:string,contains:string,section:string,anyOf:array<struct<pathSuffix:string,contains:string,section:string>>>>"
FIELDS = ("id", "query", "provenance", "relevant")
LINE = 1 << 20  # most bytes of a line


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines evaluation set; malformed and overlong lines, unknown fields, repeated ids and cases without label are errors."""
    lines = spark.read.text(path).filter(F.col("value").rlike(r"\S"))
    extra = F.exists(F.coalesce(F.json_object_keys("value"), F.array()), lambda k: ~k.isin(*FIELDS))
    odd = lines.agg(F.count_if(F.octet_length("value") > LINE).alias("long"), F.count_if(extra).alias("unknown")).first()
    if odd["long"] or odd["unknown"]:
        raise ValueError(f"{odd['long']} overlong lines, {odd['unknown']} lines with unknown fields")
    cases = spark.read.schema(CASES).option("mode", "FAILFAST").json(path)
    bad = cases.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.coalesce(F.size("relevant"), F.lit(0)) < 1).alias("empty")).first()
    if bad["n"] != bad["ids"] or bad["empty"]:
        raise ValueError(f"{bad['n'] - bad['ids']} repeated ids, {bad['empty']} cases without label")
    return cases


class Generations:
    """Immutable generations of a table below a folder, and numbered pointer files, the highest of which names the live one.

    A table is written to a hidden folder and renamed when whole; then a pointer of the next number is written beside and
    renamed to a name that didn't exist. Nothing that is live is deleted or overwritten, so whatever step a driver is lost
    at, readers see the old or the new generation, and publishing again under the same name mends the rest.
    """

    NAME, POINTER = re.compile(r"g\d+"), re.compile(r"active-(\d{12})\.json")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        at = self._path(self.root)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _pointers(self) -> list[str]:
        return sorted((n for n in self._names() if self.POINTER.fullmatch(n)), reverse=True)

    def active(self, pending: str | None = None) -> str | None:
        """The live generation; None where none was ever published. Generations without a pointer, but for the `pending`
        one that is about to be published, are an error: they aren't an empty index."""
        for pointer in self._pointers():
            name = json.loads(self.spark.read.text(f"{self.root}/{pointer}", wholetext=True).first()[0]).get("generation", "")
            if self.NAME.fullmatch(name) and self._fs.exists(self._path(f"{self.root}/{name}")):
                return name
        if lost := [n for n in self._names() if self.NAME.fullmatch(n) and n != pending]:
            raise ValueError(f"no pointer to any of {len(lost)} generations")
        return None

    def read(self, pending: str | None = None) -> DataFrame | None:
        live = self.active(pending)
        return self.spark.read.parquet(f"{self.root}/{live}") if live else None

    def _step(self, name: str) -> None:
        """Called before each step; tests fail here."""

    def publish(self, df: DataFrame, name: str, vectors: DataFrame | None = None, key: str = "id") -> None:
        """Write the table beside the live one, then move on to it. With `vectors`, every row must have one by `key`, and every vector a row."""
        if not self.NAME.fullmatch(name):
            raise ValueError("a generation's name is g and a number")
        if self.active(name) == name:
            raise ValueError("a live generation isn't written again")
        hidden, final = self._path(f"{self.root}/.staging-{name}"), self._path(f"{self.root}/{name}")
        self._step("write")
        df.write.mode("overwrite").parquet(hidden.toString())
        if vectors is not None:
            rows = self.spark.read.parquet(hidden.toString()).select(key)
            off = rows.exceptAll(vectors.select(key)).count() + vectors.select(key).exceptAll(rows).count()
            if off:
                raise ValueError(f"{off} rows without a vector, or vectors without a row")
        self._step("rename")
        self._fs.delete(final, True)  # what a lost driver left; it was never live
        if not self._fs.rename(hidden, final):
            raise OSError("the generation couldn't be renamed")
        self._step("pointer")
        number = 1 + max((int(self.POINTER.fullmatch(p)[1]) for p in self._pointers()), default=0)
        temp = self._path(f"{self.root}/.pointer-{name}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps({"generation": name}).encode()))
        out.close()
        self._step("move")
        if not self._fs.rename(temp, self._path(f"{self.root}/active-{number:012d}.json")):
            raise OSError("the pointer couldn't be moved")
        self._step("forget")
        for old in self._pointers()[2:]:
            self._fs.delete(self._path(f"{self.root}/{old}"), False)

    def clean(self, keep: int = 2, preview: bool = False) -> list[str]:
        """Delete all generations but the live one and the newest others, `keep` in all; returns their names. Folders that aren't generations stay."""
        if not 1 <= keep <= 1000:
            raise ValueError("keep must be within 1 and 1000")
        live = self.active()
        others = sorted((n for n in self._names() if self.NAME.fullmatch(n) and n != live), key=lambda n: int(n[1:]), reverse=True)
        gone = others[keep - 1 :]
        for name in [] if preview else gone:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return gone
