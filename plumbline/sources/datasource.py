"""Packages as a data source: spark.read.format("opc_parts").load(path).

A row is a part: package_id, part_name, slide (its place in the slide list, from 1), size (declared),
content, targets (of its relationships, by id) and problem. The files are listed when a query is
planned and dealt to partitions by size. A partition opens each of its packages once, by random
access: it reads the directory, then only the members that the pushed filters on package_id,
part_name and slide leave, and the few that name slides and targets. So a slide meets its number and
its targets where its package is read, without a join.

The session must let filters be pushed to Python sources (register() sets
spark.sql.python.filterPushdown.enabled). What is pushed: =, IN, IS (NOT) NULL and the begin or end of names; all of
them are also evaluated here exactly, so Spark does not repeat them. Paths are those of pyarrow's
file systems: local ones, file:, hdfs:, s3: and gs:. For other stores read with package.packages().

A package that can't be opened or is over the limits has a row without a name and with the problem; a
member that can't be read has no content. Options: members, size, ratio (limits of a package),
partition_bytes, content ("false": no member is read for its content).
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringEndsWith, StringStartsWith

from plumbline.sources import package
from plumbline.sources.quarantine import BROKEN, Limits, weight_problem

SCHEMA = "package_id string, part_name string, slide int, size long, content binary, targets map<string,string>, problem string"
COLUMNS = ("package_id", "part_name", "slide")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets its filters be pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackageSource)


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "opc_parts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackageReader:
        return PackageReader(dict(self.options))


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        self.paths, self.value = paths, paths


def tested(f: Filter) -> tuple[str, Callable] | None:
    """The column that a filter is on and its test, if it is one of those that are pushed. Null passes IS NULL and <=> only."""
    column = getattr(f, "attribute", ())
    if len(column) != 1 or column[0] not in COLUMNS:
        return None
    if isinstance(f, EqualNullSafe):
        return column[0], lambda x: x == f.value
    if isinstance(f, IsNull):
        return column[0], lambda x: x is None
    if isinstance(f, EqualTo):
        test = lambda x: x == f.value and f.value is not None
    elif isinstance(f, In):
        test = set(f.value).__contains__
    elif isinstance(f, StringStartsWith):
        test = lambda x: x.startswith(f.value)
    elif isinstance(f, StringEndsWith):
        test = lambda x: x.endswith(f.value)
    elif isinstance(f, IsNotNull):
        test = lambda x: True
    else:
        return None
    return column[0], lambda x: x is not None and test(x)


class PackageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.content = options["path"], options.get("content", "true") == "true"
        self.limits = Limits(int(options.get("members", Limits.members)), int(options.get("size", Limits.size)), float(options.get("ratio", Limits.ratio)))
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if tested(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = opened_store(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(root) :].strip("/").split("/"))
        keep = self.passes("package_id")
        files = sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File and keep(f.base_name) and (f.path == root or not hidden(f.path)))
        out, paths, size = [], [], 0
        for path, n in files:
            if paths and size + n > self.partition_bytes:
                out.append(Files(tuple(paths)))
                paths, size = [], 0
            paths.append(path)
            size += n
        return [*out, Files(tuple(paths))]

    def passes(self, column: str) -> Callable:
        mine = [test for c, test in filter(None, map(tested, self.filters)) if c == column]
        return lambda value: all(test(value) for test in mine)

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = opened_store(self.path)
        for path in partition.paths:
            pid = path.rsplit("/", 1)[-1]
            try:
                with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    yield from self.rows(pid, z)
            except BROKEN:
                yield from self.failed(pid, "not a ZIP")

    def failed(self, pid: str, problem: str) -> Iterator[tuple]:
        if self.passes("part_name")(None) and self.passes("slide")(None):
            yield pid, None, None, None, None, None, problem

    def rows(self, pid: str, z: zipfile.ZipFile) -> Iterator[tuple]:
        """The parts of an open package that pass the filters, in the directory's order."""
        if problem := weight_problem(z.infolist(), self.limits):
            yield from self.failed(pid, problem)
            return
        names = {i.filename: i for i in z.infolist()}

        def body(name: str) -> bytes:
            try:
                return z.read(names[name]) if name in names else b""
            except BROKEN:
                return b""

        def targets(source: str) -> dict[str, str]:
            folder, _, leaf = source.rpartition("/")
            links = package.links_of(source, body(f"{folder}/_rels/{leaf}.rels".lstrip("/")))
            return {rel: target for rel, _, target, _, _ in links if rel is not None and target is not None}

        in_list, named = self.passes("slide"), self.passes("part_name")
        if any(map(named, names)):
            places = self.slides(body, targets)
            for name, content, problem in package.members(z, self.limits, lambda name: self.content and named(name) and in_list(places.get(name))):
                yield pid, name, places.get(name), names[name].file_size, content, targets(name) if not name.endswith(".rels") else None, problem
            if not self.content:
                yield from ((pid, name, places.get(name), i.file_size, None, None, None) for name, i in names.items() if not i.is_dir() and named(name) and in_list(places.get(name)))

    def slides(self, body: Callable[[str], bytes], targets: Callable[[str], dict]) -> dict[str, int]:
        """The slide list: place by part; the first place of a part that is listed twice."""
        if not (ids := package.slide_ids(body(package.PRESENTATION))):
            return {}
        folder, _, leaf = package.PRESENTATION.rpartition("/")
        links = {rel: target for rel, kind, target, external, _ in package.links_of(package.PRESENTATION, body(f"{folder}/_rels/{leaf}.rels")) if kind == "slide" and not external}
        out: dict[str, int] = {}
        for n, rel in enumerate(ids, 1):
            if links.get(rel) is not None:
                out.setdefault(links[rel], n)
        return out


def opened_store(path: str):
    """(file system, path in it) of a path with or without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def parts(spark: SparkSession, path: str, **options: str):
    register(spark)
    return spark.read.format("opc_parts").options(**options).load(path)


def nodes(part, strict: bool = False):
    """The object trees of the slides among parts(); filters on slide and package_id before it reach the reader."""
    return package.slide_nodes(part.filter("slide is not null and problem is null"), strict)
