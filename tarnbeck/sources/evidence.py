"""A folder of evidence files as a Spark data source, and the sink that writes such files.

A corpus is a root with a folder for each company; sources are Markdown files with a front matter in its `sources`
folder, structured artifacts are JSON files of `_meta` and `data` in its `structured` folder. A partition of the reading
is a list of slices of folders (a slice: the files whose name hashes to it), so that the driver lists companies alone
and a company with most of the files is still spread over tasks.

Equalities, lists and null tests on text columns are pushed: `folder` prunes folders, `file` (the name without its
ending) prunes names before a file is opened, the others are tested on the metadata before a body is read. Only the
columns of the schema that the reading names are made; without `body` a source is read to its closing fence.

With mode `failfast` (default) a malformed file stops the query with its path and the missing key; with `permissive` it
is a row with nulls and a `problem`. The shape `artifacts` is total: what can't be read has null `meta` and `data`.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from tarnbeck.functions.shipping import ship

# The keys of a source's front matter and of an artifact's _meta.
SOURCE_KEYS = "id ticker kind source url fetched_at as_of title fetch_tool fetch_cmd".split()
META_KEYS = "id ticker producer title source as_of".split()
META_OPTIONAL = "provider_tool fetch_cmd url request fetched_at computed_at generated_at period currency".split()

_STRINGS = lambda names: ", ".join(f"{n} string" for n in names)
SCHEMAS = {
    "sources": f"folder string, file string, {_STRINGS(SOURCE_KEYS)}, request string, supersedes string, cited_urls array<string>, truncated boolean, body string, problem string",
    "structured": f"folder string, file string, {_STRINGS(META_KEYS + META_OPTIONAL)}, adjusted boolean, derived_from array<string>, data string, problem string",
    "artifacts": "folder string, file string, meta string, data string",
}
_REQUIRED = {"sources": SOURCE_KEYS, "structured": META_KEYS, "artifacts": []}
_FENCE = re.compile(rb"^-{3,}[ \t\r]*$", re.M)
_CHUNK = 1 << 14


def scalar(text: str):
    """The value of a front-matter scalar: JSON-like forms and quotes are undone, everything else stays as it is written."""
    text = text.strip()
    if text[:1] in ('"', "[", "{"):
        try:
            return json.loads(text)
        except ValueError:
            pass
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if text[:1] == "[" and text[-1:] == "]":
        return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
    text = re.sub(r"\s+#.*", "", text)
    return {"": None, "~": None, "null": None, "true": True, "false": False}.get(text, text)


def mapping(lines: list[str]) -> dict:
    """Keys and values of a front matter: scalars, folded lines, lists and mappings below a key."""
    out: dict = {}
    at = 0
    while at < len(lines):
        m = re.match(r"([^\s:#][^:]*):(?:\s+(.*)|\s*)$", lines[at])
        at += 1
        if not m:
            continue
        below = []
        while at < len(lines) and (not lines[at].strip() or lines[at][0] in " \t" or lines[at].startswith("- ")):
            below.append(lines[at])
            at += 1
        below = [x for x in below if x.strip()]
        own = (m[2] or "").strip()
        if own or not below:
            value = scalar(" ".join([own, *map(str.strip, below)]))
        elif below[0].lstrip().startswith("- "):
            value = [scalar(x.strip()[2:]) for x in below if x.strip().startswith("- ")]
        else:
            indent = len(below[0]) - len(below[0].lstrip())
            value = mapping([x[indent:] for x in below])
        out[m[1].strip()] = value
    return out


def _written(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _row(values: dict, schema: StructType) -> tuple:
    """values in the schema's order and types; a list column without a value is empty, a flag without one false or null."""

    def typed(field):
        v = values.get(field.name)
        if isinstance(field.dataType, ArrayType):
            return [_written(x) for x in v] if isinstance(v, list) else []
        if isinstance(field.dataType, BooleanType):
            return bool(v) if v is not None or field.name == "truncated" else None
        return _written(v)

    return tuple(typed(f) for f in schema)


class EvidenceReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.shape = schema, options.get("shape", "sources")
        if self.shape not in SCHEMAS:
            raise ValueError(f"shape has to be one of {sorted(SCHEMAS)}, not {self.shape!r}")
        self.root, self.strict = options["path"], options.get("mode", "failfast") == "failfast"
        self.tasks, self.slices = int(options.get("tasks", 64)), int(options.get("slices", 8))
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters):
        text = {f.name for f in self.schema if isinstance(f.dataType, StringType)} - {"body", "data", "problem"}
        for f in filters:
            if len(f.attribute) == 1 and f.attribute[0] in text and isinstance(f, (EqualTo, In, IsNull, IsNotNull)):
                name = f.attribute[0]
                if isinstance(f, (EqualTo, In)):
                    self.tests.append((name, frozenset([f.value] if isinstance(f, EqualTo) else f.value) - {None}))
                else:
                    self.tests.append((name, isinstance(f, IsNull)))
            else:
                yield f

    def _passes(self, values: dict, names=None) -> bool:
        for name, test in self.tests:
            if names is None or name in names:
                v = _written(values.get(name))
                if (v not in test) if isinstance(test, frozenset) else ((v is None) != test):
                    return False
        return True

    def _open(self):
        return files.FileSystem.from_uri(self.root)

    def partitions(self):
        system, root = self._open()
        found = system.get_file_info(files.FileSelector(root))
        folders = sorted(i.base_name for i in found if i.type == files.FileType.Directory and self._passes({"folder": i.base_name}, {"folder"}))
        units = [(f, k) for f in folders for k in range(self.slices)]
        n = max(1, min(self.tasks, len(units)))
        return [InputPartition(units[i::n]) for i in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, root = self._open()
        below, ending = ("sources", ".md") if self.shape == "sources" else ("structured", ".json")
        for folder, part in partition.value:
            found = system.get_file_info(files.FileSelector(f"{root}/{folder}/{below}", allow_not_found=True))
            for info in found:
                name = info.base_name
                if info.type != files.FileType.File or not name.endswith(ending) or name.startswith(".") or zlib.crc32(name.encode()) % self.slices != part:
                    continue
                own = {"folder": folder, "file": name[: -len(ending)]}
                if self._passes(own, {"folder", "file"}):
                    with system.open_input_stream(info.path) as stream:
                        values = self._source(stream, own, info.path) if self.shape == "sources" else self._artifact(stream.read(), own, info.path)
                    if values is not None:
                        yield _row(values, self.schema)

    def _judged(self, own: dict, values: dict, problem: str | None, path: str) -> dict | None:
        missing = next((k for k in _REQUIRED[self.shape] if k not in values), None) if problem is None else None
        problem = f"missing required key '{missing}'" if missing else problem
        if problem and self.strict and self.shape != "artifacts":
            raise ValueError(f"malformed file {path}: {problem}")
        values = {**own, "problem": problem} if problem else {**values, **own, "problem": None}
        return values if self._passes(values) else None

    def _source(self, stream, own: dict, path: str) -> dict | None:
        raw, done, ends = b"", False, []
        while not done and len(ends) < 2:
            more = stream.read(max(_CHUNK, len(raw)))
            raw, done = raw + more, not more
            # A fence at the very end of what was read may be the beginning of a longer line.
            ends = [m for m in list(_fences(raw)) if done or m.end() < len(raw)]
        opened = len(ends) == 2 and not raw[: ends[0].start()].strip()
        keys = mapping(raw[ends[0].end() : ends[1].start()].decode().replace("\r\n", "\n").split("\n")) if opened else {}
        values = self._judged(own, keys, None, path)
        if values is not None and opened and not values["problem"] and "body" in self.schema.fieldNames():
            values["body"] = (raw[ends[1].end() :] + stream.read()).decode().strip()
        return values

    def _artifact(self, raw: bytes, own: dict, path: str) -> dict | None:
        try:
            payload = json.loads(raw.decode())
        except ValueError:
            return self._judged(own, {}, "invalid JSON", path)
        payload = payload if isinstance(payload, dict) else {}
        meta, data = payload.get("_meta"), payload.get("data")
        if self.shape == "artifacts":
            blocks = {"meta": meta if isinstance(meta, dict) else None, "data": data if isinstance(data, dict) else None}
            return self._judged(own, blocks, None, path)
        lacking = next((k for k in ("_meta", "data") if k not in payload), None)
        problem = f"missing required key '{lacking}'" if lacking else None if isinstance(meta, dict) else "_meta is no mapping"
        return self._judged(own, {**meta, "data": data} if problem is None else {}, problem, path)


def _fences(raw: bytes) -> list:
    """The first two fences."""
    out = []
    for m in _FENCE.finditer(raw):
        out.append(m)
        if len(out) == 2:
            break
    return out


class EvidenceWriter(DataSourceWriter):
    """Rows of folder, below, name, content as files `<folder>/<below>/<name>`, each put in place by one move.

    A repeated task writes the same files again; an aborted write leaves whole files behind, never parts of one.
    """

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator) -> WriterCommitMessage:
        system, root = files.FileSystem.from_uri(self.root)
        made: set[str] = set()
        for row in iterator:
            for part in (row["folder"], row["below"], row["name"]):
                if not part or "/" in part or "\\" in part or part.startswith("."):
                    raise ValueError(f"{part!r} can't be a part of a path")
            at = f"{root}/{row['folder']}/{row['below']}"
            if at not in made:
                system.create_dir(at, recursive=True)
                made.add(at)
            held = f"{at}/.{row['name']}.{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(held) as out:
                out.write((row["content"] or "").encode())
            system.move(held, f"{at}/{row['name']}")
        return WriterCommitMessage()


class EvidenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evidence"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("shape", "sources")]

    def reader(self, schema: StructType) -> EvidenceReader:
        return EvidenceReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> EvidenceWriter:
        if overwrite:
            raise ValueError("evidence is appended, never overwritten")
        return EvidenceWriter(self.options["path"])


def _registered(spark: SparkSession) -> SparkSession:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EvidenceSource)
    return spark


def read_evidence(spark: SparkSession, path: str, shape: str = "sources", columns: list[str] | None = None, mode: str = "failfast") -> DataFrame:
    """The files below path in one of three shapes (sources, structured, artifacts); only the named columns are made."""
    schema = SCHEMAS[shape]
    if columns:
        typed = dict(f.strip().split(" ", 1) for f in schema.split(","))
        schema = ", ".join(f"{c} {typed[c]}" for c in columns)
    return _registered(spark).read.format("evidence").schema(schema).option("shape", shape).option("mode", mode).load(path)


def write_evidence(rows: DataFrame, path: str) -> None:
    """Write folder, below, name, content rows as files."""
    _registered(rows.sparkSession)
    rows.select("folder", "below", "name", "content").write.format("evidence").mode("append").save(path)


def front_matter(keys: dict[str, Column], body: Column) -> Column:
    """A Markdown text with the keys (strings, lists, mappings, flags; null: left out) as its front matter."""

    def line(name: str, value: Column) -> Column:
        listed = F.to_json(F.array(value))
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.substr(listed, F.lit(2), F.length(listed) - 2), F.lit("\n")))

    lines = F.concat(*[F.coalesce(line(k, v), F.lit("")) for k, v in keys.items()])
    return F.concat(F.lit("---\n"), lines, F.lit("---\n\n"), F.coalesce(body, F.lit("")), F.lit("\n"))
