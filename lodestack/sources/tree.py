"""A directory tree as a Spark data source: every regular file, link and special file, links never followed.

Built-in file sources leave out hidden and empty files and follow links, so the tree is walked here. The tree has to be on a
file system that driver and executors share. There are two ways in:

* ``scan()``, a data source with whole contents: the driver lists the tree, executors read the files. Filters on path and kind
  are applied to the listing, so that files which they leave out are never opened.
* ``walk()``, ``hashed()`` and ``with_content()``, for large trees: tasks list the directories level by level, hash files in steps
  of 1 MiB and keep a sample of each; a file's content is read only for the rows that are asked for.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import stat
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions.canonical import decode_path, encode_path
from ..functions.shared import kept, scratch
from ..operators.ignore import RuleTree, compile_rules
from ..schemas import ScanError, ScanPolicy, ScanRaceError

SCHEMA = "path string, kind string, content binary, mode int, device long, inode long, size long, mtime long"


@dataclass
class Walk:
    """One listing of a tree: rows (path, kind, status), in the order of their names."""

    root: str
    policy: ScanPolicy
    ignore_name: str = ".gitignore"
    rows: list[tuple[str, str, os.stat_result]] = field(default_factory=list)
    met: int = 0
    rules: RuleTree = field(default_factory=RuleTree)

    def run(self) -> Walk:
        self._directory("")
        self.rows.sort(key=lambda r: r[0])
        return self

    def _directory(self, at: str) -> None:
        with os.scandir(os.path.join(self.root, at)) as found:
            children = sorted((e for e in found if e.name not in self.policy.excluded_names), key=lambda e: e.name)
        own = f"{at}/{self.ignore_name}" if at else self.ignore_name
        control = next((e for e in children if e.name == self.ignore_name and e.is_file(follow_symlinks=False)), None)
        if control:
            with open(control.path, "rb") as f:
                text = f.read(self.policy.max_ignore_bytes + 1)
            if len(text) > self.policy.max_ignore_bytes:
                raise ScanError(f"ignore file is too large: {own}")
            self.rules.add(compile_rules({own: text.decode("utf-8", "surrogateescape")}))
        for e in children:
            self.met += 1
            if self.met > self.policy.max_entries:
                raise ScanError(f"more than {self.policy.max_entries} entries")
            path = f"{at}/{e.name}" if at else e.name
            status = e.stat(follow_symlinks=False)
            if stat.S_ISDIR(status.st_mode):
                if not self.rules.ignored(path, True):
                    self._directory(path)
                continue
            if path != own and self.rules.ignored(path, False):
                continue
            self.rows.append((path, _kind(status), status))

    def signature(self) -> list[tuple]:
        return [(p, k, s.st_mode, s.st_ino, s.st_size, s.st_mtime_ns) for p, k, s in self.rows]


def _kind(status: os.stat_result) -> str:
    return "file" if stat.S_ISREG(status.st_mode) else "symlink" if stat.S_ISLNK(status.st_mode) else "special"


class Part(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class TreeReader(DataSourceReader):
    def __init__(self, root: str, parts: int, policy: ScanPolicy):
        self.root, self.parts, self.policy = root, parts, policy
        self.wanted: list[tuple[str, Callable[[str], bool]]] = []

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        """Those on path and kind choose files of the listing. Spark applies all of them once more."""
        for f in filters:
            column = f.attribute if isinstance(f, (EqualTo, In, StringStartsWith)) else ()
            if column in (("path",), ("kind",)):
                if isinstance(f, EqualTo):
                    self.wanted.append((column[0], f.value.__eq__))
                elif isinstance(f, In):
                    self.wanted.append((column[0], frozenset(f.value).__contains__))
                else:
                    self.wanted.append((column[0], lambda text, start=f.value: text.startswith(start)))
        return filters

    def partitions(self) -> list[Part]:
        """Files in name order, cut where sizes are about even."""
        listed = Walk(self.root, self.policy).run().rows
        for column, keeps in self.wanted:
            listed = [r for r in listed if keeps(encode_path(r[0]) if column == "path" else r[1])]
        rows = [(os.fsencode(p), k, s.st_mode, s.st_rdev, s.st_ino, s.st_size, s.st_mtime_ns) for p, k, s in listed]
        total, out, held = sum(r[5] + 4096 for r in rows), [[]], 0
        for r in rows:
            if held >= total / max(1, self.parts) and out[-1]:
                out.append([])
                held = 0
            out[-1].append(r)
            held += r[5] + 4096
        return [Part(x) for x in out]

    def read(self, partition: Part) -> Iterator[tuple]:
        with _opened(os.fsencode(self.root), os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW) as root:
            for name, kind, mode, device, inode, size, mtime in partition.rows:
                with _parent(root, name) as (at, last):
                    if kind == "file":
                        with _opened(last, os.O_RDONLY | os.O_NOFOLLOW, at) as fd, os.fdopen(fd, "rb", closefd=False) as f:
                            body, status = f.read(), os.fstat(fd)
                        if (status.st_ino, status.st_size, status.st_mtime_ns) != (inode, size, mtime) or len(body) != size:
                            raise ScanRaceError(f"file changed while it was read: {os.fsdecode(name)!r}")
                    else:
                        body = os.readlink(last, dir_fd=at) if kind == "symlink" else None
                yield encode_path(os.fsdecode(name)), kind, body, mode, device, inode, size, mtime


@contextlib.contextmanager
def _opened(name: bytes, flags: int, at: int | None = None) -> Iterator[int]:
    try:
        fd = os.open(name, flags | os.O_CLOEXEC, dir_fd=at)
    except OSError as e:
        raise ScanRaceError(f"cannot be opened as it was listed: {os.fsdecode(name)!r}") from e
    try:
        yield fd
    finally:
        os.close(fd)


@contextlib.contextmanager
def _parent(root: int, name: bytes) -> Iterator[tuple[int, bytes]]:
    """The directory of a path below root, opened part by part without following a link anywhere, and the path's last part."""
    with contextlib.ExitStack() as held:
        *above, last = name.split(b"/")
        at = root
        for part in above:
            at = held.enter_context(_opened(part, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, at))
        yield at, last


class TreeSource(DataSource):
    """Options: path (an absolute, real directory), partitions, policy (JSON of a ScanPolicy's fields)."""

    @classmethod
    def name(cls) -> str:
        return "lodestack_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        given = json.loads(self.options.get("policy", "{}"))
        if "excluded_names" in given:
            given["excluded_names"] = tuple(given["excluded_names"])
        return TreeReader(checked_root(self.options["path"]), int(self.options.get("partitions", "8")), ScanPolicy(**given))


def checked_root(path: str) -> str:
    if not os.path.isabs(path) or os.path.islink(path) or not os.path.isdir(path) or os.path.realpath(path) != os.path.normpath(path):
        raise ScanError(f"the root must be an absolute, real directory: {path}")
    return os.path.normpath(path)


def scan(spark: SparkSession, root: str, partitions: int = 8, policy: ScanPolicy = ScanPolicy()) -> DataFrame:
    """Raw rows of a tree. A tree that differs between a listing before and one after the read raises in checked_scan(). Lets the session push
    filters to Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format("lodestack_tree").option("path", root).option("partitions", str(partitions)).option("policy", json.dumps(asdict(policy))).load()


def contents(rows: DataFrame) -> DataFrame:
    """What two scans of one tree have to agree in."""
    return rows.select("path", "kind", "mode", "device", "inode", "size", "mtime", F.sha2("content", 256).alias("sha256"))


def checked_scan(spark: SparkSession, root: str, to: str, policy: ScanPolicy = ScanPolicy(), partitions: int = 8) -> DataFrame:
    """The tree's rows, written to a folder and read again. The tree is listed and read once more, and must be the same in its names, kinds,
    modes, times and contents; the second read stays on executors, which compare hashes."""
    root = checked_root(root)
    before = Walk(root, policy).run().signature()
    scan(spark, root, partitions, policy).write.mode("overwrite").parquet(to)
    first, again = contents(spark.read.parquet(to)), contents(scan(spark, root, partitions, policy))
    changed = not first.exceptAll(again).isEmpty() or not again.exceptAll(first).isEmpty()
    if changed or Walk(root, policy).run().signature() != before:
        raise ScanRaceError("the tree changed while it was scanned")
    return spark.read.parquet(to)


# -- large trees: listed and hashed in tasks ----------------------------------------------------------------------

#: kind is also "directory" (one to be listed, with the ignore files that hold in it) and "listed" (size is its number of names).
_STATUS = StructType().add("path", "string").add("kind", "string").add("mode", "integer").add("device", "long").add("inode", "long").add("size", "long").add("mtime", "long")
_LEVEL = StructType(_STATUS.fields + StructType().add("controls", ArrayType(StringType())).fields)
_HASHED = StructType(_STATUS.fields + StructType().add("sha256", "string").add("head", "binary").fields)
_CONTENT = StructType().add("path", "string").add("content", "binary")
_STEP = 1 << 20


def _batches(rows: Iterator[tuple], schema: StructType, room: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of 1,000, or fewer where their bytes reach room."""
    to, held, size = to_arrow_schema(schema), [], 0
    for r in rows:
        held.append(dict(zip(to.names, r)))
        size += sum(len(v) for v in r if isinstance(v, bytes))
        if len(held) >= 1000 or size >= room:
            yield pa.RecordBatch.from_pylist(held, to)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, to)


def _list_directory(root: int, at: str, controls: list[str], rules: RuleTree, policy: ScanPolicy, ignore_name: str) -> Iterator[tuple]:
    """Rows of one directory: what is kept, directories to go on with, and the number of all names. rules holds those of controls; the directory's
    own are added."""
    name = os.fsencode(at)
    with contextlib.ExitStack() as stack:
        fd = root
        for part in name.split(b"/") if name else ():
            fd = stack.enter_context(_opened(part, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, fd))
        with os.scandir(fd) as found:
            children, met = [], 0
            for e in found:
                if e.name not in policy.excluded_names:
                    met += 1
                    if met > policy.max_entries:
                        raise ScanError(f"more than {policy.max_entries} entries")
                    children.append((e.name, e.stat(follow_symlinks=False)))
        own = f"{at}/{ignore_name}" if at else ignore_name
        if any(n == ignore_name and stat.S_ISREG(s.st_mode) for n, s in children):
            controls = [*controls, encode_path(own)]
            rules.add(compile_rules({own: _control(fd, os.fsencode(ignore_name), own, policy)}))
        for child, s in sorted(children):
            path = f"{at}/{child}" if at else child
            is_dir = stat.S_ISDIR(s.st_mode)
            if (path != own or is_dir) and rules.ignored(path, is_dir):
                continue
            yield encode_path(path), "directory" if is_dir else _kind(s), s.st_mode, s.st_rdev, s.st_ino, s.st_size, s.st_mtime_ns, controls if is_dir else None
        yield encode_path(at), "listed", 0, 0, 0, met, 0, None


def _control(at: int, last: bytes, path: str, policy: ScanPolicy) -> str:
    with _opened(last, os.O_RDONLY | os.O_NOFOLLOW, at) as fd, os.fdopen(fd, "rb", closefd=False) as f:
        text = f.read(policy.max_ignore_bytes + 1)
    if len(text) > policy.max_ignore_bytes:
        raise ScanError(f"ignore file is too large: {path}")
    return text.decode("utf-8", "surrogateescape")


def walk(spark: SparkSession, root: str, policy: ScanPolicy = ScanPolicy(), ignore_name: str = ".gitignore") -> DataFrame:
    """Files, links and special files of a tree without their contents: path, kind, mode, device, inode, size, mtime. Each level of directories is
    listed by tasks and written to the shared folder; the driver sees one number a level, by which the policy's entry limit is held. A
    directory's names are one task's work. An empty tree has no rows."""
    root = checked_root(root)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held: tuple[list[str], RuleTree] | None = None
            with _opened(os.fsencode(root), os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW) as fd:
                for b in batches:
                    for r in b.to_pylist():
                        if held is None or held[0] != r["controls"]:
                            held = r["controls"], RuleTree()
                            for c in map(decode_path, r["controls"]):
                                with _parent(fd, os.fsencode(c)) as (at, last):
                                    held[1].add(compile_rules({c: _control(at, last, c, policy)}))
                        yield from _list_directory(fd, decode_path(r["path"]), r["controls"], held[1], policy, ignore_name)

        return _batches(rows(), _LEVEL)

    folder, level, met, pending = scratch(spark), 0, 0, 1
    frontier = spark.createDataFrame([("", [])], "path string, controls array<string>")
    while pending:
        at = f"{folder}/level={level}"
        frontier.mapInArrow(listed, _LEVEL).write.parquet(at)
        done = spark.read.schema(_LEVEL).parquet(at)
        n = done.agg(F.sum(F.when(F.col("kind") == "listed", F.col("size"))).alias("met"), F.count_if(F.col("kind") == "directory").alias("pending")).first()
        met, pending, level = met + n["met"], n["pending"], level + 1
        if met > policy.max_entries:
            raise ScanError(f"more than {policy.max_entries} entries")
        frontier = done.where("kind = 'directory'").select("path", "controls").repartition("path").sortWithinPartitions("controls", "path")
    return spark.read.schema(_LEVEL).parquet(*(f"{folder}/level={n}" for n in range(level))).where("kind NOT IN ('directory', 'listed')").drop("controls")


def _opened_rows(root: str, read: Callable[[dict, int, bytes], tuple], schema: StructType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            with _opened(os.fsencode(root), os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW) as fd:
                for b in batches:
                    for r in b.to_pylist():
                        with _parent(fd, os.fsencode(decode_path(r["path"]))) as (at, last):
                            yield read(r, at, last)

        return _batches(rows(), schema)

    return run


def _steps(row: dict, at: int, last: bytes) -> Iterator[bytes]:
    """A file's bytes in steps; it must be what was listed, before and after."""
    with _opened(last, os.O_RDONLY | os.O_NOFOLLOW, at) as fd:
        total = 0
        while step := os.read(fd, _STEP):
            total += len(step)
            yield step
        s = os.fstat(fd)
    if (s.st_ino, s.st_size, s.st_mtime_ns, total) != (row["inode"], row["size"], row["mtime"], row["size"]):
        raise ScanRaceError(f"file changed while it was read: {row['path']!r}")


def hashed(listing: DataFrame, root: str, policy: ScanPolicy = ScanPolicy()) -> DataFrame:
    """Rows of walk() with sha256 and head, the first policy.sample_bytes of a file; links have the hash of their target and no head, special
    files neither. A task holds 1 MiB of a file. Filter the listing first: files that are left out are not opened."""
    root, sample = checked_root(root), policy.sample_bytes

    def read(r: dict, at: int, last: bytes) -> tuple:
        same = tuple(r[c] for c in ("path", "kind", "mode", "device", "inode"))
        if r["kind"] == "symlink":
            target = os.readlink(last, dir_fd=at)
            return *same, len(target), r["mtime"], hashlib.sha256(target).hexdigest(), None
        if r["kind"] == "special":
            return *same, r["size"], r["mtime"], None, None
        sha, head = hashlib.sha256(), b""
        for step in _steps(r, at, last):
            sha.update(step)
            head += step[: sample - len(head)]
        return *same, r["size"], r["mtime"], sha.hexdigest(), head

    return listing.select(*_STATUS.names).repartition("path").mapInArrow(_opened_rows(root, read, _HASHED), _HASHED)


def with_content(listing: DataFrame, root: str, max_bytes: int) -> DataFrame:
    """path, content of the regular files of a listing; one above max_bytes raises before it is opened."""
    root = checked_root(root)

    def read(r: dict, at: int, last: bytes) -> tuple:
        if r["size"] > max_bytes:
            raise ScanError(f"file exceeds the read limit: {r['path']}")
        return r["path"], b"".join(_steps(r, at, last))

    return listing.where("kind = 'file'").select("path", "inode", "size", "mtime").repartition("path").mapInArrow(_opened_rows(root, read, _CONTENT), _CONTENT)


def checked_hashes(spark: SparkSession, root: str, to: str, policy: ScanPolicy = ScanPolicy()) -> DataFrame:
    """hashed(walk()), written to a folder and read again; the tree is walked and hashed once more and must be the same. Nothing of it is on the driver."""
    hashed(walk(spark, root, policy), root, policy).write.mode("overwrite").parquet(to)
    first, again = spark.read.schema(_HASHED).parquet(to), kept(hashed(walk(spark, root, policy), root, policy))
    if not first.exceptAll(again).isEmpty() or not again.exceptAll(first).isEmpty():
        raise ScanRaceError("the tree changed while it was scanned")
    return first
