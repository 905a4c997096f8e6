"""Symbol extraction from source text: a registry of extractors by language."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Symbol = tuple[str, str, int]
#: Definition forms by language, a pattern with the name for each kind.
PATTERNS = {
    "go": (("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("type", r"^type\s+(\w+)")),
    "javascript": (("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("class", r"^\s*(?:export\s+)?class\s+(\w+)")),
    "typescript": (("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("class", r"^\s*(?:export\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?function\s+(\w+)")),
    "java": (("class", r"\b(?:class|enum|record)\s+(\w+)"), ("interface", r"\binterface\s+(\w+)")),
    "rust": (("function", r"\bfn\s+(\w+)"), ("struct", r"\b(?:struct|enum)\s+(\w+)"), ("trait", r"\btrait\s+(\w+)")),
    "c": (("struct", r"\bstruct\s+(\w+)\s*\{"), ("function", r"^\w[\w\s*]*?\b(\w+)\s*\([^;]*\)\s*\{")),
    "kotlin": (("function", r"\bfun\s+(\w+)"), ("class", r"\bclass\s+(\w+)")),
    "swift": (("function", r"\bfunc\s+(\w+)"), ("class", r"\b(?:class|struct)\s+(\w+)")),
    "csharp": (("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)")),
    "dart": (("class", r"\bclass\s+(\w+)"), ("function", r"^\w[\w<>]*\s+(\w+)\s*\([^;]*\)\s*(?:async\s*)?\{")),
    "generic": (("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:def|function|func|fn)\s+(\w+)")),
}


def by_pattern(language: str) -> Callable[[str], list[Symbol]]:
    rules = [(kind, re.compile(p)) for kind, p in PATTERNS[language]]
    return lambda text: [(m[1], kind, n) for n, line in enumerate(text.split("\n"), 1) for kind, p in rules[:] if (m := p.search(line))]


def python_symbols(text: str) -> list[Symbol]:
    """Definitions by the standard parser; by pattern where the text does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return by_pattern("generic")(text)
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return sorted(((n.name, kinds[type(n)], n.lineno) for n in ast.walk(tree) if type(n) in kinds), key=lambda s: s[2])


EXTRACTORS: dict[str, Callable[[str], list[Symbol]]] = {"python": python_symbols} | {x: by_pattern(x) for x in PATTERNS}


def register(language: str, extractor: Callable[[str], list[Symbol]]) -> None:
    EXTRACTORS[language] = extractor


def extract(files: DataFrame, key: str, language: str, text: str) -> DataFrame:
    """(key, name, kind, line) of every definition; languages without an extractor use the generic one."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [
                (k, *s)
                for k, lang, t in zip(*(batch.column(i).to_pylist() for i in range(3)))
                for s in EXTRACTORS.get(lang, EXTRACTORS["generic"])(t or "")
            ]
            if rows:
                keys, names, kinds, lines = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(names), pa.array(kinds), pa.array(lines, pa.int32())], ["k", "name", "kind", "line"])

    picked = files.select(F.col(key).alias("k"), F.col(language).alias("l"), F.col(text).alias("t"))
    return picked.mapInArrow(run, f"k {kind}, name string, kind string, line int").withColumnRenamed("k", key)


def generic_symbols(files: DataFrame, key: str, text: str) -> DataFrame:
    """Definition lines as expressions only: the word after a definition keyword, up to a bracket."""
    lines = files.where(F.col(text).rlike(r"(?m)^\s*(def|class|function|func) ")).select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    name = F.regexp_extract("line", r"^\s*(?:def|class|function|func)\s+([^\s(:{]+)", 1)
    return lines.select(key, (F.col("at") + 1).alias("line"), name.alias("name"), F.regexp_extract("line", r"^\s*(def|class|function|func)\s", 1).alias("keyword")).where("name <> ''")


def manifest_packages(files: DataFrame, key: str, kind: str, text: str) -> DataFrame:
    """(key, package) from dependency manifests: requirements, package.json, go.mod, Cargo.toml."""
    lines = files.select(key, F.col(kind).alias("kind"), F.explode(F.split(text, "\n")).alias("line"))
    name = (
        F.when(F.col("kind") == "requirements", F.regexp_extract("line", r"^\s*([A-Za-z0-9_.-]+)\s*(?:[=<>!~\[;].*)?$", 1))
        .when(F.col("kind") == "npm", F.regexp_extract("line", r'^\s*"([@a-z0-9/_.-]+)"\s*:\s*"[~^]?[0-9]', 1))
        .when(F.col("kind") == "gomod", F.regexp_extract("line", r"^\s*(?:require\s+)?([a-z0-9./_-]+)\s+v[0-9]", 1))
        .otherwise(F.regexp_extract("line", r"^\s*([a-z0-9_-]+)\s*=\s*[\"{]", 1))
    )
    return lines.select(key, name.alias("package")).where("package <> ''").distinct()
