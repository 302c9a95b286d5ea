"""Stack traces out of text: debugger frames by built-in expressions, Java traces by an Arrow function."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import bind

# The forms of a debugger's frame in the order they are tried, and which group holds what; the first group is the number.
FRAME_FORMS = [
    (r"^#([\dx]+)\s+(\S+)\s+in\s+(.+?)\s+\(([^\)]*)\)\s+at\s+(\S+)\sfrom\s+(\S+)\s*$", {"address": 2, "function": 3, "args": 4, "file": 5, "dylib": 6}),
    (r"^#([\dx]+)\s+(\S+)\s+in\s+(.+?)\s+\(([^\)]*)\)\s+from\s+(.+?)\s*$", {"address": 2, "function": 3, "args": 4, "dylib": 5}),
    (r"^#([\dx]+)\s+(\S+)\s+(.+?)\s+\(([^\)]*)\)\s+from\s+(.+?)\s*$", {"address": 2, "function": 3, "args": 4, "dylib": 5}),
    (r"^#([\dx]+)\s+(\S+)\s+in\s+(.+?)\s+\((.*?)\)\s+at\s+(.+?)\s*$", {"address": 2, "function": 3, "args": 4, "file": 5}),
    (r"^#([\dx]+)\s+(.+?)\s+\((.*?)\)\s+at\s+(\S+)\s*$", {"function": 2, "args": 3, "file": 4}),
    (r"^#([\dx]+)\s+(\S+)\s+in\s+(.+?)\s*\((.*?)\)?\s*$", {"address": 2, "function": 3, "args": 4}),
    (r"^#([\dx]+)\s+(\S+)\s+in\s+(.+?)\s*$", {"address": 2, "function": 3}),
    (r"^#([\dx]+)\s+(.+?)\s+\((.*?)\)?\s*$", {"function": 2, "args": 3}),
    (r"^#(\d+)\s+(<.*?>)\s*$", {"function": 2}),
]
# A file with its line, and a line that goes on with one.
FILE_LINE = r"^([^:]+):(\d+)\s*$"
AT_FILE_LINE = r"^\s*at\s+([^\s:]+):(\d+)\s*$"
_FIELDS = ("address", "function", "args", "file", "dylib")
_MARK, _ABSENT = "\x01", "\x02"


def lines_of(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def frame_of(line: Column) -> Column:
    """One frame ``{depth, address, function, args, file, fileline, dylib}``; null if no form fits.

    The first form that fits rewrites the line to its fields with marks between them, so each form's pattern runs at most twice.
    """
    rewritten = F.lit(None).cast("string")
    for pattern, groups in reversed(FRAME_FORMS):
        fields = [f"${groups[f]}" if f in groups else _ABSENT for f in _FIELDS]
        rewritten = F.when(line.rlike(pattern), F.regexp_replace(line, pattern, _MARK.join(["$1", *fields]))).otherwise(rewritten)

    def parts(p: Column) -> Column:
        field = {f: F.nullif(F.get(p, F.lit(k + 1)), F.lit(_ABSENT)) for k, f in enumerate(_FIELDS)}
        split = field["file"].rlike(FILE_LINE)
        return F.struct(
            F.get(p, F.lit(0)).try_cast("int").alias("depth"),
            *[field[f].alias(f) for f in ("address", "function", "args")],
            F.when(split, F.regexp_extract(field["file"], FILE_LINE, 1)).otherwise(field["file"]).alias("file"),
            F.when(split, F.regexp_extract(field["file"], FILE_LINE, 2)).alias("fileline"),
            field["dylib"].alias("dylib"),
        )

    return bind(F.split(rewritten, _MARK), lambda p: F.when(p.isNotNull(), parts(p)))


def grouped_lines(text: Column) -> Column:
    """``{line, extras}`` of every line that begins with ``#``; extras are it and the lines that follow it up to the next.

    A text with a line that begins with ``rax``, a register dump, is none and gives an empty array.
    """
    lines = lines_of(text)
    heads = F.filter(F.transform(lines, lambda x, i: F.when(x.startswith("#"), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(heads, 2, F.greatest(F.size(heads), F.lit(1))), F.array(F.size(lines)))
    groups = F.transform(heads, lambda h, k: F.struct(F.rtrim(F.get(lines, h)).alias("line"), F.slice(lines, h + 1, F.greatest(F.get(ends, k) - h, F.lit(1))).alias("extras")))
    return F.when(F.exists(lines, lambda x: x.startswith("rax")), F.slice(groups, 1, 0)).otherwise(groups)


def file_of_extras(extras: Column) -> Column:
    """``{file, fileline}`` of the last extra line that names one."""
    named = F.filter(extras, lambda x: x.rlike(AT_FILE_LINE))
    last = F.try_element_at(named, F.lit(-1))
    return F.when(last.isNotNull(), F.struct(F.regexp_extract(last, AT_FILE_LINE, 1).alias("file"), F.regexp_extract(last, AT_FILE_LINE, 2).alias("fileline")))


# Fixed value: frames of a trace whose frames may run over several lines.
LONG_FRAME = r"(?m)^#([0-9]+) +(?:([a-zA-Z0-9]+) +in +)?(?:(.+?) *[(].*?|(<sig\w+? handler [\w ]+?>)|([\w:<*,> \[\]-]+))(?: +(?:at|from) +(\S+)|$)"


#: Largest frame number up to which the numbers without a frame are filled in.
FILL_LIMIT = 10_000_000
#: Numbers that one generated array holds.
_FILL_CHUNK = 4096


def long_frames(text: Column) -> Column:
    """``{number, function, file}`` of a whole trace; ends before a second frame 0. Numbers without a frame are left out, see ``fill_numbers``."""
    joined = F.regexp_replace(F.regexp_replace(F.translate(text, "\t", " "), "\r\n?", "\n"), "\n +", " ")
    group = lambda k: F.regexp_extract_all(joined, F.lit(LONG_FRAME), F.lit(k))
    rows = F.arrays_zip(group(1).alias("n"), group(3).alias("a"), group(4).alias("b"), group(5).alias("c"), group(6).alias("f"))

    def named(r: Column) -> Column:
        name = F.trim(F.when(r["a"] != "", r["a"]).when(r["b"] != "", r["b"]).otherwise(r["c"]))
        return F.struct(r["n"].try_cast("long").alias("number"), name.alias("function"), F.when(r["f"] != "", r["f"]).alias("file"))

    def cut(frames: Column) -> Column:
        again = F.filter(F.transform(frames, lambda f, i: F.when((f["number"] == 0) & (i > 0), i)), lambda i: i.isNotNull())
        return F.slice(frames, 1, F.coalesce(F.get(again, F.lit(0)), F.size(frames)))

    return bind(F.transform(rows, named), cut)


def fill_numbers(traces: DataFrame, key: str, frames: str) -> DataFrame:
    """``key, number, function, file``: the frames of ``long_frames`` and, with nulls, every number below the largest that has none.

    Holes are generated piece by piece, so a trace of any length needs no array of its length. A trace with a number above
    ``FILL_LIMIT``, which no trace reaches, is not filled; one row without number, function and file tells so. A number too large for 64 bits is null.
    """
    found = traces.select(key, F.inline(frames))
    numbers = F.array_sort(F.array_distinct(F.array_compact(F.transform(frames, lambda f: f["number"]))))
    holes = lambda ns: F.filter(
        F.transform(ns, lambda n, i: F.struct((F.coalesce(F.get(ns, i - 1), F.lit(-1).cast("long")) + 1).alias("lo"), (n - 1).alias("hi"))), lambda h: h["hi"] >= h["lo"]
    )
    sane = F.coalesce(F.array_max(numbers) <= FILL_LIMIT, F.lit(True))
    gaps = traces.where(sane).select(key, F.explode(bind(numbers, holes)).alias("h"))
    pieces = gaps.select(key, "h", F.explode(F.sequence(F.col("h.lo"), F.col("h.hi"), F.lit(_FILL_CHUNK).cast("long"))).alias("from"))
    filled = pieces.select(key, F.explode(F.sequence("from", F.least(F.col("h.hi"), F.col("from") + _FILL_CHUNK - 1))).alias("number"))
    none = [F.lit(None).cast("string").alias(c) for c in ("function", "file")]
    rejected = traces.where(~sane).select(key, F.lit(None).cast("long").alias("number"), *none)
    return found.unionByName(filled.select(key, "number", *none)).unionByName(rejected)


def threads_of(text: Column) -> Column:
    """The texts after each line that begins with ``Thread`` and a number, up to the next."""
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), r"(?im)^Thread +[0-9]+")
    return F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))


def top_frames(text: Column) -> Column:
    """``{function, file}`` of each line of a stack top, which has no numbers."""
    pattern = F.lit(r"(.+?) *[(].*?(?: +(?:at|from) +(\S+)|$)")
    # Line by line, for on a line without a parenthesis the pattern is tried from every place.
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("("))
    zipped = F.flatten(F.transform(lines, lambda x: F.arrays_zip(F.regexp_extract_all(x, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(x, pattern, F.lit(2)).alias("b"))))
    return F.transform(zipped, lambda z: F.struct(F.trim(z["a"]).alias("function"), F.when(z["b"] != "", z["b"]).alias("file")))


def description_of(text: Column) -> Column:
    """The text before the first field."""
    return F.regexp_extract(F.regexp_replace(text, "\r\n?", "\n"), r"(?s)^(.*?)(?:(?m)^[A-Z][\w.]*: |\z)", 1)


def fields_of(text: Column) -> Column:
    """Map of ``Name: value`` fields, names in lower case; a value runs to the next name. Of equal names the last counts."""
    plain = F.regexp_replace(text, "\r\n?", "\n")
    pattern = r"(?s)(?m)^([A-Z][\w.]*): (.*?)(?=^[A-Z][\w.]*: |\z)"
    names = F.transform(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i")))
    values = F.transform(F.regexp_extract_all(plain, F.lit(pattern), F.lit(2)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    # Sorted by name and place, an entry counts if the next has another name.
    ordered = F.array_sort(names)
    last = lambda o: F.filter(o, lambda e, i: ~F.coalesce(F.get(o, i + 1)["k"] == e["k"], F.lit(False)))
    return bind(values, lambda v: F.map_from_entries(F.transform(bind(ordered, last), lambda e: F.struct(e["k"], F.get(v, e["i"])))))


#: Trace files of a report in the order they are tried.
TRACE_FILES = ["Stacktrace.txt (retraced)", "StacktraceSource.txt", "Stacktrace.txt", "Stacktrace", "Stacktrace.gz", "Stacktrace.txt.1"]


def file_priority(name: Column) -> Column:
    """Place of a trace file's name in the order they are tried, null for other files."""
    place = F.array_position(F.array(*map(F.lit, TRACE_FILES)), name)
    return F.when(place > 0, place)


def recover_location(extras: Column) -> Column:
    """``{dylib, file, fileline}`` that extra lines of a frame name; libraries and files of other endings are no such."""
    text = F.array_join(extras, "\n")
    libs = F.transform(F.regexp_extract_all(text, F.lit(r"from +(\S+)"), F.lit(1)), lambda x: F.regexp_replace(x, r"\?$", ""))
    lib = F.get(F.filter(libs, lambda x: x.rlike(r"\.(?:so|hr)(?:\.[0-9]+d?)*$")), F.lit(0))
    base = lambda x: F.regexp_replace(x, ":.*$", "")
    files = F.filter(F.regexp_extract_all(text, F.lit(r"at +(\S+)"), F.lit(1)), lambda x: base(x).rlike(r"\.(?:c|tcc|cpp|h|hpp|m|moc|xs|xsi|S|cc)$|(?:ostream|iostream)$"))
    file = F.when(lib.isNull(), F.get(files, F.lit(0)))
    return F.struct(lib.alias("dylib"), base(file).alias("file"), F.regexp_extract(file, r":([0-9]+)", 1).try_cast("int").alias("fileline"))


def modern_frames(calls: Column) -> Column:
    """Old frames ``{method, source}`` to ``{depth, function, file, fileline}``; the line is what follows the last colon."""

    def one(f: Column, i: Column) -> Column:
        has = f["source"].rlike(r"(?s)^.*:[^:]*$")
        file = F.when(has, F.regexp_extract(f["source"], r"(?s)^(.*):[^:]*$", 1)).otherwise(f["source"])
        return F.struct(i.alias("depth"), f["method"].alias("function"), file.alias("file"), F.when(has, F.regexp_extract(f["source"], r"(?s):([^:]*)$", 1)).alias("fileline"))

    return F.transform(calls, one)


def null_unknown(function: Column) -> Column:
    """Null for ``??`` and for names that are addresses."""
    return F.when((function == "??") | function.rlike(r"^0x[0-9a-zA-Z]+ in"), None).otherwise(function)


# How an exception's name ends, what a call's name looks like after blanks were made single, and the mark of a cause.
_ENDING = re.compile("Exception|Error", re.I)
_METHOD = re.compile(r"[\w$]+(?:[.$/]\$?[\w ]+)*(?:[.$/](?:<init>|<clinit>))? *", re.I)
_CAUSE = re.compile(r"caused +by *: +", re.I)
_COLON = re.compile(r" *: ")
_QUALIFIED = re.compile(r" at [\w$]+[.$/]", re.I)
# The characters of names, and what such a stretch may be.
_NAME, _AT = re.compile(r"[\w.$/]*"), re.compile(r" at (?=[\w$])", re.I)
_STRETCH = re.compile(r"[\w$./ ]*(?:<(?:cl)?init> *)?", re.I)
_BROKEN = re.compile(r"[./]\$?[./]")
_PARENS = re.compile(r"\){1,3}")
#: Blanks in a function's name, over its length, from which the trace is taken to be mixed with prose.
MIXED = 0.05
_STACK_SCHEMA = "exception:string,message:string,frames:array<struct<depth:int,function:string,file:string,fileline:string>>"
JAVA_SCHEMA = f"array<struct<{_STACK_SCHEMA},nested:array<struct<{_STACK_SCHEMA}>>>>"


class _Scanner:
    """Reads a text from left to right: an exception's name, its message up to the first call, the calls that follow each other.

    A call ends in parentheses, so its name reaches to the end of a stretch of name characters. Stretches are told once, and those that no
    parenthesis follows are passed over, so the time is in proportion to the text.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.at = 0
        self.stretch = (0, -1)

    def name(self, here: bool) -> tuple[str, int] | None:
        """(name, its end) of the next exception: a dotted name up to its last ``Exception`` or ``Error``."""
        text, at = self.text, self.at
        while (ending := _ENDING.search(text, at)) is not None:
            low = ending.start()
            while low > at and (text[low - 1] in ".$/_" or text[low - 1].isalnum()):
                low -= 1
            if here and low > self.at:
                return None
            high = _NAME.match(text, ending.end()).end()
            begin = low + len(text[low:high]) - len(text[low:high].lstrip(".$/"))
            after = min((k for k in (text.find(c, begin, high) for c in ".$/") if k >= 0), default=high)
            ends = [m.end() for m in _ENDING.finditer(text, after, high)]
            if ends and not (here and begin > self.at):
                return text[begin : ends[-1]], ends[-1]
            if here:
                return None
            at = high
        return None

    def call(self, at: int, here: bool) -> tuple[int, int, str, str] | None:
        """(start, end, function, source) of the next call, or of the one that stands just there."""
        text = self.text
        while (mark := (_AT.match if here else _AT.search)(text, at)) is not None:
            begin = mark.end()
            if not self.stretch[0] <= begin <= self.stretch[1]:
                self.stretch = begin, _STRETCH.match(text, begin).end()
            end = self.stretch[1]
            if text[end : end + 1] == "(":
                while not _METHOD.fullmatch(text, begin, end):
                    broken = [m.start() for m in _BROKEN.finditer(text, begin, end)]
                    mark = None if here else _AT.search(text, broken[-1] if broken else begin - 1, end)
                    if mark is None:
                        break
                    begin = mark.end()
                else:
                    opened = end + len(text[end : end + 3]) - len(text[end : end + 3].lstrip("("))
                    closed = text.find(")", opened)
                    if closed < 0:
                        return None
                    return mark.start(), _PARENS.match(text, closed).end(), text[begin:end].strip(), text[opened:closed]
            if here:
                return None
            at = max(begin, end - 1)
        return None

    def heading(self, here: bool) -> str | None:
        """The next exception that calls may follow; ``here``: only if it stands where the scanner is. The scanner stops where calls are looked for."""
        while (found := self.name(here)) is not None:
            name, self.at = found
            if here or _COLON.match(self.text, self.at) or self.call(self.at, True):
                return name
        return None

    def stack(self, name: str) -> tuple[dict | None, bool]:
        """The stack under an exception, and whether calls were found at all; None for one that is no sound stack."""
        colon = _COLON.match(self.text, self.at)
        begin = colon.end() if colon else self.at
        call = self.call(begin, not colon)
        if call is None:
            return None, False
        head, first, calls = self.at, call[0], []
        while call is not None:
            calls.append(call[2:])
            self.at = call[1]
            call = self.call(self.at, True)
        earlier = self.call(head, False) if colon else None
        if earlier is not None and earlier[0] < first:
            # A message that is itself a call, which the colon's blank begins.
            calls, place = [], head
            while (call := self.call(place, False)) is not None and call[1] <= self.at:
                calls.append(call[2:])
                place = call[1]
        # The message ends where a call of a qualified name begins.
        named = _QUALIFIED.search(self.text, begin, self.at) if colon else _QUALIFIED.match(self.text, begin, self.at)
        mixed = any(f.count(" ") > MIXED * len(f) for f, _ in calls)
        if named is None or mixed or _CAUSE.search(self.text, begin, first + 1):
            return None, True
        return {"exception": name, "message": self.text[begin : named.start()] if colon else None, "frames": [self.frame(k, *c) for k, c in enumerate(calls)]}, True

    @staticmethod
    def frame(depth: int, function: str, source: str) -> dict:
        file, colon, line = source.rpartition(":")
        digits = "".join(d for d in line if d in "0123456789") if colon else ""
        return {
            "depth": depth, "function": function.replace(" ", ""), "file": (file if colon else source).replace(" ", ""), "fileline": (digits.lstrip("0") or "0") if digits else None,
        }

    def cause(self) -> tuple[dict | None, bool]:
        """The cause that follows at once, and whether one does; the scanner stays where it was if none does."""
        held = self.at
        mark = _CAUSE.match(self.text, held + 1) if self.text[held : held + 1] == " " else None
        if mark is not None:
            self.at = mark.end()
            name = self.heading(here=True)
            if name is not None:
                nested, found = self.stack(name)
                if found:
                    return nested, True
        self.at = held
        return None, False


def java_traces(text: str | None) -> list[dict]:
    """The Java traces of a text: exception, message, frames, and the one trace each that caused it.

    Marks of one word in square brackets are dropped and white space counts as one blank. A stack is dropped if a function's name holds more than one
    blank in twenty characters, and with it one that a dropped stack caused. Lines are digits as text. Null and empty texts give no trace.
    """
    if not text:
        return []
    scanner = _Scanner(re.sub(r"\s+", " ", re.sub(r"\[[a-zA-Z]+\]", "", text)))
    out = []
    while (name := scanner.heading(here=False)) is not None:
        main, found = scanner.stack(name)
        if not found:
            # No call in the whole rest of the text.
            break
        nested, caused = scanner.cause()
        if main is not None and (nested is not None or not caused):
            out.append(main | {"nested": [nested] if nested is not None else []})
    return out


def parse_java(text: Column) -> Column:
    """Java traces of each text, in Arrow batches: calls are matched one by one, at which a pattern of repeated groups would exhaust the JVM's stack."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(java_traces)

    # Annotations are texts here, so the kind of function is told by its signature's objects.
    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, JAVA_SCHEMA)(text)


# Fixed value: a frame of a Python trace.
PYTHON_FRAME = r'^\s*File "([^"]*)", line (\d+)(?:, in (.+?))?\s*$'


def python_frames(text: Column) -> Column:
    """``{depth, function, file, fileline}`` of the frames of a Python trace, the innermost, which stands last, at depth 0; null texts give null."""
    lines = F.filter(lines_of(text), lambda x: x.rlike(PYTHON_FRAME))
    part = lambda x, k: F.regexp_extract(x, PYTHON_FRAME, k)
    one = lambda x, i: F.struct(i.cast("int").alias("depth"), F.nullif(part(x, 3), F.lit("")).alias("function"), part(x, 1).alias("file"), part(x, 2).alias("fileline"))
    return F.transform(F.reverse(lines), one)


def thread_stacks(text: Column) -> Column:
    """One stack for each thread of a debugger's trace: an array of arrays of frames, without threads that have none.

    What stands before the first line that names a thread is a thread of its own. Unknown functions are null; a line that is no frame is passed over. A text
    without frames of a debugger but with a Python trace gives that as one stack. Null texts give null.
    """
    plain = F.regexp_replace(text, "\r\n?", "\n")
    threads = F.split(plain, r"(?im)^Thread +[0-9]+")

    def frames(body: Column) -> Column:
        found = F.array_compact(F.transform(F.filter(F.split(body, "\n"), lambda x: x.startswith("#")), lambda x: frame_of(F.rtrim(x))))
        return F.transform(found, lambda f: f.withField("function", null_unknown(f["function"])))

    stacks = F.filter(F.transform(threads, frames), lambda s: F.size(s) > 0)
    absent = F.lit(None).cast("string")
    python = F.transform(
        python_frames(text),
        lambda f: F.struct(f["depth"].alias("depth"), absent.alias("address"), f["function"].alias("function"), absent.alias("args"), f["file"].alias("file"), f["fileline"].alias("fileline"), absent.alias("dylib")),
    )
    return F.when(F.size(stacks) > 0, stacks).when(F.size(python) > 0, F.array(python)).otherwise(stacks)


def frame_line(depth: Column, address: Column, function: Column, args: Column, file: Column, fileline: Column, dylib: Column) -> Column:
    """A frame as a debugger writes it; unknown functions are ``??``, line breaks in a field become blanks."""
    where = F.when(file.isNotNull(), F.concat(F.lit(" at "), file, F.coalesce(F.concat(F.lit(":"), fileline), F.lit("")))).when(dylib.isNotNull(), F.concat(F.lit(" from "), dylib))
    line = F.concat(
        F.lit("#"), depth.cast("string"), F.lit(" "), F.coalesce(address, F.lit("0x0")), F.lit(" in "), F.coalesce(function, F.lit("??")), F.lit(" ("), F.coalesce(args, F.lit("")), F.lit(")"),
        F.coalesce(where, F.lit("")),
    )
    return F.translate(line, "\r\n", "  ")


def threads_text(frames: DataFrame, max_depth: int = 300) -> DataFrame:
    """``bug_id, text``: the stacks of each report as the threads of a debugger's trace. Copies of a frame count once, frames at ``max_depth`` or below are left out.

    A report's text is one value, so its stacks are gathered; the cut keeps each of them bounded.
    """
    kept = frames.where((F.col("depth") >= 0) & (F.col("depth") < max_depth) & F.col("bug_id").isNotNull() & F.col("stack_no").isNotNull())
    line = frame_line(*[F.col(c) for c in ("depth", "address", "function", "args", "file", "fileline", "dylib")])
    once = kept.groupBy("bug_id", "stack_no", "depth").agg(F.min(line).alias("line"))
    stacks = once.groupBy("bug_id", "stack_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "line"))), lambda x: x["line"]), "\n").alias("body"))
    body = F.concat(F.lit("Thread "), F.col("stack_no").cast("string"), F.lit(":\n"), "body")
    whole = stacks.groupBy("bug_id").agg(F.sort_array(F.collect_list(F.struct("stack_no", body.alias("body")))).alias("s"))
    return whole.select("bug_id", F.array_join(F.transform("s", lambda x: x["body"]), "\n").alias("text"))


def normal_field_names(row: DataFrame) -> DataFrame:
    """Column names in lower case, and ``title`` as ``short_desc``; of names that then agree the last column counts, as a later key replaces an earlier one."""
    last: dict[str, str] = {}
    for c in row.columns:
        low = c.lower()
        last["short_desc" if low == "title" and c != low else low] = c
    return row.select(*[F.col(f"`{c}`").alias(name) for name, c in last.items()])
