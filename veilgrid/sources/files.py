"""Repository files: walk, ignore rules, languages, test paths, gates, text documents in and out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrid.functions.detect import BINARY_PREFIX, MAX_FILE_BYTES

IGNORE_FILE = ".veilgridignore"
#: Patterns that are ignored unless a repository re-includes them.
DEFAULT_IGNORE = (
    ".git/ .hg/ .svn/ node_modules/ bower_components/ vendor/ Pods/ Carthage/ build/ dist/ out/ target/ .gradle/ .idea/ .vscode/ .next/ .nuxt/ .expo/ coverage/ .cache/ "
    ".terraform/ __pycache__/ .venv/ venv/ .veilgrid/cache/ *.min.js *-min.js *.min.css *.map *.lock package-lock.json pnpm-lock.yaml go.sum gradle.lockfile "
    "*.png *.jpg *.jpeg *.gif *.webp *.ico *.bmp *.tiff *.svg *.mp3 *.mp4 *.mov *.webm *.wav *.ttf *.otf *.woff *.woff2 *.eot *.zip *.gz *.tgz *.bz2 *.xz *.7z *.rar *.jar *.aar "
    "*.apk *.aab *.ipa *.dex *.so *.dylib *.dll *.exe *.class *.o *.a *.pdf *.keystore *.jks *.pb *.bin *.db *.sqlite *.realm *.onnx *.tflite"
).split()
#: Languages with their kind, extensions, endings that are no source, and names of test files.
LANGUAGES = [
    ("go", "code", [".go"], [], ["_test.go"], [], []),
    ("java", "code", [".java"], [], ["Test.java", "Tests.java"], [], []),
    ("kotlin", "code", [".kt", ".kts"], [], ["Test.kt", "Tests.kt"], [], []),
    ("proto", "schema", [".proto"], [], [], [], []),
    ("python", "code", [".py"], [], ["_test.py"], ["test_"], ["conftest.py"]),
    ("sql", "schema", [".sql"], [], [], [], []),
    ("swift", "code", [".swift"], [], ["Tests.swift", "Test.swift"], [], []),
    ("typescript", "code", [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"], [".d.ts", ".d.mts", ".d.cts"], [], [], []),
]
ALIASES = {"golang": "go", "kt": "kotlin", "kts": "kotlin", "protobuf": "proto", "py": "python", "ts": "typescript", "tsx": "typescript", "javascript": "typescript", "js": "typescript", "jsx": "typescript"}
TEST_FOLDERS = "/src/test/ /src/androidTest/ /src/testDebug/ /__tests__/ /__mocks__/ /testdata/ /e2e/ /cypress/ /tests/ /test/ /spec/ /specs/".split()


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder: path relative to it, content, size; any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^\\w+:/*", "/"), "^" + re.escape(base), "")
    return files.select(rel.alias("path"), "content", F.col("length").alias("size"))


def base_name(path: str = "path") -> Column:
    return F.substring_index(path, "/", -1)


def language(path: str = "path") -> Column:
    """The language of a file's extension, or null."""
    name = base_name(path)
    extension = F.lower(F.regexp_extract(name, "(\\.[^.]*)$", 1))
    out = F.lit(None).cast("string")
    for lang, _, extensions, not_source, *_ in LANGUAGES:
        out = F.when(extension.isin(extensions) & ~_any([F.endswith(F.lower(name), F.lit(x)) for x in not_source]), lang).otherwise(out)
    return out


def is_test(path: str = "path") -> Column:
    name, lang = base_name(path), language(path)
    own = [(lang == n) & _any([F.endswith(name, F.lit(x)) for x in ends] + [F.startswith(name, F.lit(x)) for x in starts] + [name == x for x in names]) for n, _, _, _, ends, starts, names in LANGUAGES if ends or starts or names]
    slashed = F.concat(F.lit("/"), F.col(path))
    every = [F.coalesce(t, F.lit(False)) for t in own] + [F.contains(name, F.lit(".test.")), F.contains(name, F.lit(".spec."))] + [F.contains(slashed, F.lit(d)) for d in TEST_FOLDERS]
    return _any(every)


def toolchain_ignored(path: str = "path") -> Column:
    """Go files in folders that the language's own tools skip."""
    folders = F.split(path, "/")
    folders = F.slice(folders, 1, F.size(folders) - 1)
    return (language(path) == "go") & F.exists(folders, lambda d: F.startswith(d, F.lit(".")) | F.startswith(d, F.lit("_")) | (d == "testdata"))


def content_hash(content: str = "content") -> Column:
    return F.substring(F.sha2(content, 256), 1, 32)


def scannable(files: DataFrame) -> DataFrame:
    """Files of a readable size without a NUL near their start, with ``text``."""
    head = F.substring(F.col("content"), 1, BINARY_PREFIX).cast("string")
    return files.filter((F.col("size") > 0) & (F.col("size") <= MAX_FILE_BYTES) & ~F.contains(head, F.lit("\0"))).withColumn("text", F.col("content").cast("string"))


def selected(files: DataFrame, paths: list[str]) -> DataFrame:
    """Files that one of the paths names, or that lie below it; ``.`` selects all."""
    clean = [p.strip("/").removeprefix("./") for p in paths]
    if any(p in ("", ".") for p in clean):
        return files
    return files.filter(_any([(F.col("path") == p) | F.startswith("path", F.lit(p + "/")) for p in clean]))


def glob_regex(pattern: str, anchored: bool) -> str:
    """An expression for a pattern of an ignore file."""
    out, k = ["^" if anchored else "^(?:.*/)?"], 0
    while k < len(pattern):
        rest = pattern[k:]
        if rest.startswith("**/"):
            out.append("(?:.*/)?")
            k += 3
        elif rest == "/**":
            out.append("/.*")
            k += 3
        elif rest.startswith("**"):
            out.append(".*")
            k += 2
        elif rest[0] in "*?":
            out.append("[^/]*" if rest[0] == "*" else "[^/]")
            k += 1
        elif rest[0] == "[" and "]" in rest[1:]:
            held = rest[1 : rest.index("]", 1)]
            out.append("[" + re.sub(r"^!", "^", held).replace("\\", "\\\\") + "]")
            k += len(held) + 2
        elif rest[0] == "\\" and len(rest) > 1:
            out.append(re.escape(rest[1]))
            k += 2
        else:
            out.append(re.escape(rest[0]))
            k += 1
    return "".join(out) + "$"


def parse_ignore(lines: list[str]) -> list[tuple[int, str, bool, bool]]:
    """(ord, expression, negate, folders only) of the lines of an ignore file."""
    rules = []
    for line in lines:
        line = line.rstrip("\r")
        line = line if line.endswith("\\ ") else line.rstrip(" \t")
        if not line or line.startswith("#"):
            continue
        negate = line.startswith("!")
        line = line[1:] if negate or line[:2] in ("\\!", "\\#") else line
        folders = line.endswith("/")
        line = line.rstrip("/") if folders else line
        anchored = "/" in line
        line = line.removeprefix("/")
        if line:
            rules.append((len(rules), glob_regex(line, anchored), negate, folders))
    return rules


def not_ignored(files: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Files that no rule ignores: for the path and every folder above it the last rule that matches decides."""
    spark = files.sparkSession
    rules = spark.createDataFrame(parse_ignore([*DEFAULT_IGNORE, *(patterns or [])]), "ord int, regex string, negate boolean, folders boolean")
    parts = F.split(F.col("path"), "/")
    at = files.select("path").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.size(parts))))
    at = at.withColumns({"prefix": F.array_join(F.slice(parts, 1, F.col("k")), "/"), "is_folder": F.col("k") < F.size(parts)})
    met = at.join(F.broadcast(rules), F.expr("prefix RLIKE regex AND (is_folder OR NOT folders)"))
    gone = met.groupBy("path", "prefix").agg(F.max_by("negate", "ord").alias("kept")).filter("NOT kept").select("path").distinct()
    return files.join(gone, "path", "left_anti")


def files_of(df: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """Any table of texts as files."""
    content = F.col(text_col).cast("binary")
    return df.select(F.col(path_col).cast("string").alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("size"))


BASELINE_TYPE = T.StructType([T.StructField(c, T.StringType()) for c in ("fingerprint", "kind", "data_type", "sink_rule", "dest", "function", "file")])


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a baseline document."""
    whole = spark.read.schema(T.StructType([T.StructField("version", T.IntegerType()), T.StructField("entries", T.ArrayType(BASELINE_TYPE))])).option("multiLine", "true").json(path)
    return whole.select(F.inline("entries"))


def write_baseline(entries: DataFrame, path: str) -> None:
    """One document with all entries in order of their fingerprints."""
    held = entries.agg(F.array_sort(F.collect_list(F.struct(*BASELINE_TYPE.names))).alias("entries"))
    held.select(F.lit(1).alias("version"), "entries").coalesce(1).write.mode("overwrite").json(path)
