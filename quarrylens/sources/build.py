"""Sources that a build leaves behind: compilation databases, dependency files, linker scripts, interrupt lists, rules,
skipped ranges. Text is read by Spark; parsers that need a state run in Arrow batches."""

from __future__ import annotations

import re
import struct
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions.scalars import flags_hash


def compile_database(spark: SparkSession, path: str) -> DataFrame:
    """(file, directory, arguments, flags_hash) of each unit of a JSON compilation database.

    arguments may be given as a list or as one command line.
    """
    raw = spark.read.schema("directory string, file string, command string, arguments array<string>, output string").option("multiLine", True).json(path)
    raw = raw.where("file is not null").withColumnRenamed("file", "unit")
    args = F.coalesce("arguments", F.filter(F.split("command", r"\s+"), lambda a: a != ""))
    full = F.when(F.col("unit").startswith("/"), F.col("unit")).otherwise(F.concat_ws("/", "directory", "unit"))
    return raw.select(full.alias("file"), "directory", args.alias("arguments"), flags_hash(F.filter(args, lambda a: a != F.col("unit"))).alias("flags_hash"))


def dependency_files(spark: SparkSession, path: str) -> DataFrame:
    """(target, header) of make-style dependency files."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\\\r?\n", " ").alias("t"))
    rules = whole.select(F.explode(F.split("t", r"\r?\n")).alias("r")).where("r like '%:%'")
    deps = F.filter(F.split(F.regexp_extract("r", r"^[^:]*:(.*)$", 1), r"(?<!\\)\s+"), lambda x: x != "")
    return rules.select(F.trim(F.regexp_extract("r", r"^([^:]*):", 1)).alias("target"), F.explode(deps).alias("d")).select("target", F.regexp_replace("d", r"\\ ", " ").alias("header"))


def macro_definitions(spark: SparkSession, path: str) -> DataFrame:
    """(name, params, value, is_function_like) of the output of a preprocessor's macro dump."""
    pat = r"^#define\s+(\w+)(\(([^)]*)\))?\s*(.*)$"
    v = F.col("value")
    lines = spark.read.text(path).where(v.rlike(pat))
    return lines.select(F.regexp_extract(v, pat, 1).alias("name"), F.regexp_extract(v, pat, 3).alias("params"), F.regexp_extract(v, pat, 4).alias("value"), (F.regexp_extract(v, pat, 2) != "").cast("int").alias("is_function_like"))


_OPS = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}
_LEX = re.compile(r"\s*(0[xX][0-9a-fA-F]+|\d+\s*[KMGkmg]?\b|[A-Za-z_.]\w*|<<|>>|[-+*/%|&^~()])")


def constant(text: str | None, names: dict[str, int] | None = None) -> int | None:
    """The integer that a linker expression of numbers, given names and operators stands for; null if it isn't constant.

    Numbers may end in K, M or G; a leading 0 means octal. Division rounds down, by zero gives null.
    """
    if text is None:
        return None
    toks, at = [], 0
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if not m:
            return None
        toks.append(m.group(1))
        at = m.end()
    toks.append("")
    here = 0

    def number(t: str) -> int:
        if t[:2].lower() == "0x":
            return int(t, 16)
        scale = {"K": 10, "M": 20, "G": 30}.get(t[-1].upper(), 0)
        digits = t[:-1].strip() if scale else t
        return int(digits, 8 if len(digits) > 1 and digits[0] == "0" else 10) << scale

    def unary() -> int:
        nonlocal here
        t = toks[here]
        here += 1
        if t in ("-", "+", "~"):
            v = unary()
            return -v if t == "-" else ~v if t == "~" else v
        if t == "(":
            v = binary(0)
            if toks[here] != ")":
                raise ValueError(text)
            here += 1
            return v
        if t and t[0].isdigit():
            return number(t)
        return (names or {})[t]

    def binary(least: int) -> int:
        nonlocal here
        left = unary()
        while _OPS.get(toks[here], 0) > least:
            op = toks[here]
            here += 1
            right = binary(_OPS[op])
            if op in ("<<", ">>") and not 0 <= right <= 4096:
                raise ValueError(text)
            left = {"|": int.__or__, "^": int.__xor__, "&": int.__and__, "<<": int.__lshift__, ">>": int.__rshift__, "+": int.__add__, "-": int.__sub__,
                    "*": int.__mul__, "/": int.__floordiv__, "%": int.__mod__}[op](left, right)
        return left

    try:
        value = binary(0)
        return value if toks[here] == "" else None
    except (ValueError, KeyError, ZeroDivisionError, IndexError, RecursionError):
        return None


@F.pandas_udf(T.LongType())
def evaluate(expressions: pd.Series) -> pd.Series:
    """constant over a column; values beyond 64 bits are null."""
    return expressions.map(lambda e: v if (v := constant(e)) is not None and -(1 << 63) <= v < 1 << 63 else None).astype("Int64")


def memory_regions(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, name, attributes, origin, length, origin_value, length_value) of the MEMORY blocks of linker scripts."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_path"), F.regexp_replace("value", r"(?s)/\*.*?\*/", " ").alias("t"))
    block = whole.select("file_path", F.explode(F.regexp_extract_all("t", F.lit(r"(?s)\bMEMORY\s*\{([^}]*)\}"), F.lit(1))).alias("b"))
    one = r"(\w+)\s*(\(([^)]*)\))?\s*:\s*(?:ORIGIN|org|o)\s*=\s*([^,\n]+),\s*(?:LENGTH|len|l)\s*=\s*([^\n]+)"
    rows = block.select("file_path", F.explode(F.regexp_extract_all("b", F.lit(one), F.lit(0))).alias("r"))
    part = lambda i: F.trim(F.regexp_extract("r", one, i))
    found = rows.select("file_path", part(1).alias("name"), part(3).alias("attributes"), part(4).alias("origin"), part(5).alias("length"))
    return found.withColumns({"origin_value": evaluate("origin"), "length_value": evaluate("length")})


def linker_values(symbols: DataFrame, defined: dict[str, int] | None = None) -> DataFrame:
    """linker_symbols with value: what the text stands for, given values of other names (as by --defsym), null if it isn't
    constant. A name given from outside overrides a PROVIDE and holds in the other assignments."""
    given = dict(defined or {})

    @F.pandas_udf(T.LongType())
    def value(names: pd.Series, provided: pd.Series, texts: pd.Series) -> pd.Series:
        found = [given[n] if n in given and p else constant(t, given) for n, p, t in zip(names, provided, texts)]
        return pd.Series([v if v is not None and -(1 << 63) <= v < 1 << 63 else None for v in found], dtype="Int64")

    return symbols.withColumn("value", value("name", "provided", "value_text"))


def linker_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, name, provided, value_text, is_entry): assignments and the entry of linker scripts."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_path"), F.regexp_replace("value", r"(?s)/\*.*?\*/", " ").alias("t"))
    whole = whole.withColumn("t", F.regexp_replace("t", r"\bMEMORY\s*\{[^}]*\}", " "))
    pat = r"(PROVIDE(?:_HIDDEN)?\s*\(\s*)?\b([A-Za-z_]\w*)\s*=\s*([^;=][^;]*);"
    sym = whole.select("file_path", F.explode(F.regexp_extract_all("t", F.lit(pat), F.lit(0))).alias("r")).select(
        "file_path", F.regexp_extract("r", pat, 2).alias("name"), (F.regexp_extract("r", pat, 1) != "").alias("provided"), F.trim(F.regexp_replace(F.regexp_extract("r", pat, 3), r"\)\s*$", "")).alias("value_text"), F.lit(False).alias("is_entry"))
    entry = whole.select("file_path", F.explode(F.regexp_extract_all("t", F.lit(r"\bENTRY\s*\(\s*(\w+)\s*\)"), F.lit(1))).alias("name")).select(
        "file_path", "name", F.lit(False).alias("provided"), F.lit(None).cast("string").alias("value_text"), F.lit(True).alias("is_entry"))
    return sym.unionByName(entry)


def _int_list(content: bytes) -> list[tuple[int, int, int, int]]:
    """Entries (irq, flags, handler, argument) of the .intList section of an ELF file; none if it has no such section."""
    if content[:4] != b"\x7fELF" or len(content) < 52:
        return []
    wide, end = content[4] == 2, "<" if content[5] == 1 else ">"
    try:
        if wide:
            at, = struct.unpack_from(end + "Q", content, 40)
            size, count, names = struct.unpack_from(end + "HHH", content, 58)
        else:
            at, = struct.unpack_from(end + "I", content, 32)
            size, count, names = struct.unpack_from(end + "HHH", content, 46)

        def section(i: int) -> tuple[int, int, int]:
            base = at + i * size
            name, = struct.unpack_from(end + "I", content, base)
            off, length = struct.unpack_from(end + ("QQ" if wide else "II"), content, base + (24 if wide else 16))
            return name, off, length

        _, table, _ = section(names)
        for i in range(count):
            name, off, length = section(i)
            start = table + name
            if content[start : content.index(b"\0", start)] == b".intList":
                body = content[off : off + length]
                head, step = (8, 24) if wide else (8, 16)
                return [struct.unpack_from(end + ("iIQQ" if wide else "iIII"), body, p) for p in range(head, len(body) - step + 1, step)]
    except (struct.error, ValueError):
        return []
    return []


def interrupt_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, irq, flags, handler, argument) of the interrupt registrations in ELF files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *e) for p, c in zip(b["path"], b["content"]) for e in _int_list(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "irq", "flags", "handler", "argument"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, irq int, flags long, handler long, argument long")


def _functions_of(content: bytes) -> list[tuple[int, str]]:
    """(address, name) of the functions in the symbol table of an ELF file; the Thumb bit of an address is cleared."""
    if content[:4] != b"\x7fELF" or len(content) < 52:
        return []
    wide, end = content[4] == 2, "<" if content[5] == 1 else ">"
    try:
        at, = struct.unpack_from(end + ("Q" if wide else "I"), content, 40 if wide else 32)
        size, count = struct.unpack_from(end + "HH", content, 58 if wide else 46)
        sections = []
        for i in range(count):
            base = at + i * size
            kind, = struct.unpack_from(end + "I", content, base + 4)
            off, length = struct.unpack_from(end + ("QQ" if wide else "II"), content, base + (24 if wide else 16))
            link, = struct.unpack_from(end + "I", content, base + (40 if wide else 24))
            sections.append((kind, off, length, link))
        out = []
        for kind, off, length, link in sections:
            if kind != 2:  # SHT_SYMTAB
                continue
            names = sections[link][1]
            for p in range(off, off + length, 24 if wide else 16):
                if wide:
                    name, info, _, _, value, _ = struct.unpack_from(end + "IBBHQQ", content, p)
                else:
                    name, value, _, info, _, _ = struct.unpack_from(end + "IIIBBH", content, p)
                if info & 15 == 2:  # STT_FUNC
                    start = names + name
                    out.append((value & ~1, content[start : content.index(b"\0", start)].decode("utf-8", "replace")))
        return out
    except (struct.error, ValueError, IndexError):
        return []


def interrupt_handlers(spark: SparkSession, path: str) -> DataFrame:
    """(path, irq, link_name, argument) of the interrupt registrations in ELF files, each handler's address by the name that
    the file's own symbol table gives it, of several the smallest; null where it gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                names: dict[int, str] = {}
                for address, name in _functions_of(bytes(c)):
                    names[address] = min(name, names.get(address, name))
                rows += [(p, irq, names.get(handler & ~1), argument) for irq, _, handler, argument in _int_list(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "irq", "link_name", "argument"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, irq int, link_name string, argument long")


def sdk_rules(spark: SparkSession, text: str) -> DataFrame:
    """(entry_name, callee_name, slot_index, kind, sdk) of the rules in a TOML text: tables [[call_graph.sdk]] with sdk, entry, and
    callee or nothing, slot (0 by default) and kind (call by default). A text that is no TOML, or a rule without entry, is an error."""
    rules = tomllib.loads(text).get("call_graph", {}).get("sdk", [])
    rows = [(r["entry"], r.get("callee"), int(r.get("slot", 0)), r.get("kind", "call"), r.get("sdk", "")) for r in rules]
    return spark.createDataFrame(rows, "entry_name string, callee_name string, slot_index int, kind string, sdk string")


def interrupt_sources(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Slot sources (config_hash, slot, function) for interrupts (slot, link_name) whose link name names one symbol."""
    named = symbols.where("link_name <> ''").groupBy("config_hash", "link_name").agg(F.min("usr").alias("function"), F.max("usr").alias("other")).where("function = other")
    return named.join(facts, "link_name").select("config_hash", "slot", "function")


def blank_skipped(files: DataFrame, ranges: DataFrame, text: str = "content") -> DataFrame:
    """files (config_hash, path, text) with the lines of skipped ranges (config_hash, path, first, last; from 1) blanked,
    so that line numbers stay."""
    held = ranges.groupBy("config_hash", "path").agg(F.collect_list(F.struct("first", "last")).alias("__r"))
    joined = files.join(held, ["config_hash", "path"], "left")
    skipped = lambda i: F.exists(F.coalesce("__r", F.array().cast("array<struct<first:int,last:int>>")), lambda r: (r["first"] <= i + 1) & (i + 1 <= r["last"]))
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.when(skipped(i), "").otherwise(line))
    return joined.withColumn(text, F.array_join(lines, "\n")).drop("__r")


_CODE = re.compile(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|//[^\n]*|/\*.*?(?:\*/|\Z)|[{}]', re.S)


def closing_line(text: str, start: int = 0) -> int:
    """The line (from 0) of the brace that closes the first group opened at or after line start, strings and comments
    aside; without one two lines on, at most the last."""
    lines = text.split("\n")
    if start >= len(lines):
        return start
    offset, depth, opened = sum(len(x) + 1 for x in lines[:start]), 0, False
    for m in _CODE.finditer(text, offset):
        if m.group(0) == "{":
            depth, opened = depth + 1, True
        elif m.group(0) == "}":
            depth -= 1
        if opened and depth <= 0:
            return text.count("\n", 0, m.start())
    return len(lines) - 1 if opened else min(len(lines) - 1, start + 2)


@F.pandas_udf(T.IntegerType())
def body_end(texts: pd.Series, starts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else closing_line(t, int(s)) for t, s in zip(texts, starts)], dtype="Int32")
