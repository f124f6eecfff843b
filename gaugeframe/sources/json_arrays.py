"""Elements of arrays in large JSON files, each file read by many tasks.

A file is cut into byte ranges.  Where a range begins inside a string, or how deep, cannot be seen from the range alone, so a first job
lexes every range under both readings, outside and inside a string, and reports how far the depth moves and which named arrays begin; one small
row per range lets the driver chain the true state from range to range.  The data source then reads each range on its own: elements that begin in it
are parsed, the last one beyond its end, and ranges that hold nothing of the wanted array are not read at all.  Files of one range need no first job.

``level`` 2 reads arrays that are values of the top object (``{"name": [{...}, ...]}``), ``level`` 1 one array as the whole document.  Values that do not fit
their column are NULL; a string column takes any value as JSON text.  A file that is no JSON is an error.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

RANGE_BYTES = 32 << 20
AHEAD = 64 << 10
BATCH = 2048
#: Ranges are read one at a time, by this many tasks at most while those get no more than ``RANGE_BYTES`` each.
TASKS = 64
#: Strings (up to the end of the buffer if they do not end in it) and brackets; everything else is skipped.
TOKEN = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"?|[{}\[\]]', re.S)
_REST = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_COLON = re.compile(rb"\s*:\s*")
_NEXT = re.compile(r"[\s,]*(?=\{)")


@dataclass
class Span(InputPartition):
    """A byte range of a file and the state at its first byte."""

    path: str
    start: int
    end: int
    depth: int = 0
    inside: bool = False
    escaped: bool = False
    section: str | None = None


def open_file(path: str):
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return open(path, "rb")
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def _begin(buffer: bytes, inside: bool, escaped: bool) -> int:
    """First place outside the string that the buffer begins in; -1 if the string does not end."""
    if not inside:
        return 0
    rest = _REST.match(buffer, int(escaped))
    return rest.end() if rest else -1


def summary(buffer: bytes, length: int, inside: bool, escaped: bool) -> dict:
    """What a range of ``length`` bytes does to the state, if it begins inside (or outside) a string; ``buffer`` goes a little further.

    ``move``: change of depth; ``ends``: whether it ends inside a string; ``named``: for each relative depth, the name of the last
    array that begins there as a value, None for an object; ``all``: all those names.
    """
    depth, ends, named, all_ = 0, inside, {}, set()
    at = _begin(buffer, inside, escaped)
    if 0 <= at < length:
        ends = False
        last = None
        for m in TOKEN.finditer(buffer, at):
            first = buffer[m.start()]
            within = m.start() < length
            if not within and (last is None or last.start() >= length):
                break
            if first == 0x22:
                if not within:
                    break
                last = m
                ends = m.end() > length or (m.end() == length and not _closed(buffer, m))
                continue
            if first in b"{[":
                if last is not None and _COLON.fullmatch(buffer, last.end(), m.start()) and _closed(buffer, last):
                    name = _name(last) if first == 0x5B else None
                    named[depth] = name
                    all_.add(name)
                depth += within
            elif within:
                depth -= 1
            last = None
    elif at >= length:
        ends = at > length
    return {"move": depth, "ends": ends, "named": named, "all": all_}


def _name(m: re.Match) -> str:
    return m.group()[1:-1].decode("utf-8", "replace")


def _closed(buffer: bytes, m: re.Match) -> bool:
    """Whether a string token has its closing quote."""
    if m.end() - m.start() < 2 or buffer[m.end() - 1] != 0x22:
        return False
    slashes = 0
    while buffer[m.end() - 2 - slashes] == 0x5C:
        slashes += 1
    return slashes % 2 == 0


def chained(ranges: list[tuple[str, int, int]], summaries: dict, level: int) -> list[tuple[Span, set]]:
    """True state of every range, in order of the file, and the names of the arrays it touches.

    ``summaries`` maps (path, start) to (escaped, outside, inside)."""
    out = []
    depth, inside, section, path = 0, False, None, None
    for p, start, end in ranges:
        if p != path:
            depth, inside, section, path = 0, False, None, p
        escaped, *both = summaries[p, start]
        said = both[int(inside)]
        out.append((Span(p, start, end, depth, inside, escaped, section), {section, *said["all"]}))
        # an array is wanted only where it is a value of the object one level up
        relative = level - 1 - depth
        if relative in said["named"]:
            section = said["named"][relative]
        depth, inside = depth + said["move"], said["ends"]
    return out


def _run(buffer: bytes, begin: int, most: int) -> tuple[list, int]:
    """Objects that follow one another from byte ``begin``, which begin before byte ``most`` and end in the buffer, and the byte after the last."""
    try:
        # the buffer may end inside a character
        text = codecs.getincrementaldecoder("utf-8")("surrogatepass").decode(buffer[begin:])
    except UnicodeDecodeError:
        return [], begin
    decode = json.JSONDecoder().raw_decode
    plain, at, place, out = text.isascii(), 0, begin, []
    while place < most:
        try:
            value, end = decode(text, at)
        except ValueError:
            break
        out.append(value)
        done = place + (end - at if plain else len(text[at:end].encode("utf-8", "surrogatepass")))
        gap = _NEXT.match(text, end)
        if gap is None:
            return out, done
        at, place = gap.end(), done + gap.end() - end
        begin = done
    return out, begin


def elements(read, span: Span, level: int, wanted: str | None) -> Iterator[dict]:
    """Parsed elements that begin in the span; ``read(start, size)`` gives bytes of the file."""
    size = span.end - span.start
    buffer = read(span.start, size + AHEAD)
    depth, section, last, begun = span.depth, span.section, None, None
    at = _begin(buffer, span.inside, span.escaped)
    if at < 0 or at >= size:
        return
    origin = span.start  # of the buffer in the file
    whole = True  # objects of the wanted array are tried at once; one that the buffer cuts off is followed by its tokens
    while True:
        tokens = TOKEN.finditer(buffer, at)
        while (m := next(tokens, None)) is not None:
            if begun is None and origin + m.start() >= span.end:
                return
            first = buffer[m.start()]
            if first == 0x22:
                last = m
            elif first in b"{[":
                if depth == level - 1 and last is not None and _COLON.fullmatch(buffer, last.end(), m.start()):
                    section = _name(last) if first == 0x5B else None
                if first == 0x7B and depth == level and begun is None and (level == 1 or section == wanted):
                    found, after = _run(buffer, m.start(), span.end - origin) if whole else ([], 0)
                    whole = False
                    if found:
                        yield from found
                        tokens, last = TOKEN.finditer(buffer, after), None
                        continue
                    begun = m.start()
                depth, last = depth + 1, None
            else:
                depth, last = depth - 1, None
                if begun is not None and depth == level:
                    yield json.loads(buffer[begun : m.end()])
                    begun = None
        if begun is None:
            return
        # the last element goes on behind the buffer: take it up again with more
        more = read(origin + len(buffer), max(len(buffer) - begun, AHEAD))
        if not more:
            raise ValueError(f"{span.path} ends inside an element that begins at byte {origin + begun}")
        buffer, origin = buffer[begun:] + more, origin + begun
        depth, at, begun, last = level, 0, None, None
        section = wanted if level > 1 else section


def _fit(value, kind: T.DataType):
    """``value`` as a column type, None where it does not fit."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, T.StructType):
        return {f.name: _fit(value.get(f.name), f.dataType) for f in kind} if isinstance(value, dict) else None
    if isinstance(kind, T.ArrayType):
        return [_fit(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, int | float):
        return None
    if isinstance(kind, T.DoubleType | T.FloatType):
        return float(value)
    bits = {T.LongType: 63, T.IntegerType: 31}[type(kind)]
    return int(value) if value == value // 1 and -(1 << bits) <= value < 1 << bits else None


@dataclass
class Spans(InputPartition):
    """Ranges that one task reads, one after the other."""

    spans: list[Span]


def dealt(found: list, sizes: list[int]) -> list[list]:
    """Neighbours in groups, one a task: all alone up to ``TASKS``, more of them together up to ``RANGE_BYTES`` or as many bytes as that number of tasks gives each."""
    share = min(RANGE_BYTES, sum(sizes) / TASKS)
    out, held = [], 0
    for one, size in zip(found, sizes):
        if not out or held + size > share:
            out.append([])
            held = 0
        out[-1].append(one)
        held += size
    return out


class JsonArrayReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.level, self.section = schema, int(options["level"]), options.get("section")
        self.spans = [Span(**s) for s in json.loads(options["spans"])]

    def __getstate__(self) -> dict:
        # tasks get their own spans only, not those of all files
        return self.__dict__ | {"spans": []}

    def partitions(self) -> list[InputPartition]:
        return [Spans(s) for s in dealt(self.spans, [s.end - s.start for s in self.spans])]

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        arrow = to_arrow_schema(self.schema)
        for span in partition.spans:
            yield from self._read(span, arrow)

    def _read(self, span: Span, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        with open_file(span.path) as f:
            def read(start: int, size: int) -> bytes:
                f.seek(start)
                return f.read(size)

            rows: list[dict] = []
            for element in elements(read, span, self.level, self.section):
                rows.append(_fit(element, self.schema))
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)


class JsonArraySource(DataSource):
    """Spans, level and section come as options from :func:`read_arrays`."""

    @classmethod
    def name(cls) -> str:
        return "json_array_spans"

    def reader(self, schema: T.StructType) -> JsonArrayReader:
        return JsonArrayReader(schema, self.options)


def ranges_of(spark: SparkSession, path: str, range_bytes: int) -> list[tuple[str, int, int]]:
    """Byte ranges of all files, in order; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()
    return [(f.path, at, min(at + range_bytes, f.length)) for f in files for at in range(0, f.length, range_bytes)]


def _lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, end in zip(*(batch[n].to_pylist() for n in ("path", "start", "end"))):
            with open_file(path) as f:
                back, slashes = start, 0
                while back > 0:  # backslashes right before the range
                    f.seek(back - 1)
                    if f.read(1) != b"\\":
                        break
                    back, slashes = back - 1, slashes + 1
                f.seek(start)
                buffer = f.read(end - start + AHEAD)
            both = [summary(buffer, end - start, inside, bool(slashes % 2)) for inside in (False, True)]
            said = json.dumps([bool(slashes % 2), *[{**b, "named": list(b["named"].items()), "all": list(b["all"])} for b in both]])
            yield pa.record_batch([pa.array([path]), pa.array([start]), pa.array([said])], names=["path", "start", "said"])


def spans(spark: SparkSession, path: str, level: int, range_bytes: int = RANGE_BYTES) -> list[tuple[Span, set]]:
    """Every range with its state and the names of the arrays it touches: one small row per range on the driver."""
    ranges = ranges_of(spark, path, range_bytes)
    several = {p for p, start, _ in ranges if start}
    outside = {"move": 0, "ends": False, "named": {}, "all": set()}
    summaries = {(p, 0): (False, outside, outside) for p, _, _ in ranges if p not in several}
    rows = [r for r in ranges if r[0] in several]
    if rows:
        groups = dealt(rows, [end - start for _, start, end in rows])
        table = spark.createDataFrame([(g,) for g in groups], "ranges array<struct<path:string,start:long,end:long>>").coalesce(1).repartition(len(groups)).selectExpr("inline(ranges)")
        for r in table.mapInArrow(_lexed, "path string, start long, said string").collect():
            escaped, *both = json.loads(r.said)
            summaries[r.path, r.start] = (escaped, *[{**b, "named": dict(b["named"]), "all": set(b["all"])} for b in both])
    return [(s, names if s.path in several else {"*"}) for s, names in chained(ranges, summaries, level)]


def read_arrays(spark: SparkSession, found: list[tuple[Span, set]], schema: str, level: int, section: str | None = None) -> DataFrame:
    """Elements of one array (``section``, at ``level`` 2) of all files as rows of ``schema``."""
    spark.dataSource.register(JsonArraySource)
    wanted = [asdict(s) for s, names in found if level == 1 or names & {section, "*"}]
    if not wanted:
        return spark.createDataFrame([], schema)
    reader = spark.read.format(JsonArraySource.name()).schema(schema).option("level", level).option("spans", json.dumps(wanted))
    return (reader if section is None else reader.option("section", section)).load()
