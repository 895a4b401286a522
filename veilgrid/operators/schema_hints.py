"""Schema hints: declared types and fields that hold sensitive data.

``fields``: type, kind, external, field, field_type, tags (map). Declarations come from a
catalog, from ``parse_proto`` and ``parse_sql``, or from any extractor.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilgrid.operators import names

#: Tags that mark sensitive data, and tags that name what is stored.
MARKERS = "pii pci phi sensitive veilgrid @PII @Pii @PCI @Pci @PHI @Phi @PersonalData @Sensitive @SensitiveData @Confidential".split()
NAME_TAGS = "column gorm db bson json yaml xml protobuf msgpack mapstructure form query @Column @SerializedName @JsonProperty @Json @ColumnInfo @Field @JsonAlias @SerialName @Property".split()
FLOOR, TAG_BONUS, TAG_CAP, UNKNOWN_OWNER = 0.6, 0.05, 0.95, 0.05


def tag_name(tag: str) -> Column:
    """The name that a tag gives: the column of an ORM tag, the name of a wire tag, else its first part."""
    v = F.try_element_at(F.col("tags"), F.lit(tag))
    if tag == "gorm":
        return F.trim(F.regexp_extract(v, "(?i)(?:^|;)\\s*column\\s*:([^;]*)", 1))
    if tag == "protobuf":
        return F.regexp_extract(v, "(?:^|,)name=([^,]*)", 1)
    first = F.trim(F.split_part(v, F.lit(","), F.lit(1)))
    return F.when(first == "-", "").otherwise(first)


def declared(fields: DataFrame, types: DataFrame, markers: list[str] | None = None, classes: tuple[str, ...] = ("pii", "phi", "pci", "credential")) -> DataFrame:
    """Hints of declared fields: data_type, confidence, suppressed, contextual, via."""
    markers = MARKERS + (markers or [])
    base = fields.withColumn("fid_", F.monotonically_increasing_id())
    marks = F.filter(
        F.array(*(F.when(F.map_contains_key("tags", m), F.struct(F.lit(m).alias("tag"), F.trim(F.split_part(F.element_at(F.col("tags"), F.lit(m)), F.lit(","), F.lit(1))).alias("value"), F.lit(m.lower().removeprefix("@") if m.lower().removeprefix("@") in classes else "pii").alias("cls"))) for m in markers)),
        lambda x: x.isNotNull(),
    )
    base = base.withColumn("mark", F.try_element_at(marks, F.lit(1)))
    own = names.classify_fields(base, "type", "field", types).withColumnRenamed("named", "own")
    own = names.classify(own, "field", types).withColumnRenamed("named", "direct")
    tags = base.select("fid_", "type", F.posexplode(F.array(*(F.struct(F.lit(t).alias("tag"), tag_name(t).alias("value")) for t in NAME_TAGS))).alias("ord", "t"))
    tags = names.classify_fields(tags.filter("t.value != ''").withColumn("value", F.col("t.value")), "type", "value", types).filter("named IS NOT NULL AND named.pattern != 'entity name'")
    # a tag wins by beating what was found before it; its own bonus is capped
    best = tags.groupBy("fid_").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("t.tag").alias("tag"), "value", F.col("named.data_type").alias("data_type"), F.col("named.confidence").alias("c")))).alias("held"))
    out = own.join(best, "fid_", "left")
    start = F.struct(F.col("own.data_type").alias("data_type"), F.coalesce("own.confidence", F.lit(0.0)).alias("c"), F.when(F.col("own").isNotNull(), F.concat(F.lit("field name "), "field")).alias("via"), (F.col("own").isNotNull() & F.col("direct").isNull()).alias("contextual"))
    via = lambda t: F.when(F.startswith(t["tag"], F.lit("@")), F.concat(t["tag"], F.lit('("'), t["value"], F.lit('")'))).otherwise(F.concat(t["tag"], F.lit(':"'), t["value"], F.lit('"')))
    step = lambda acc, t: F.when(t["c"] + TAG_BONUS > acc["c"], F.struct(t["data_type"].alias("data_type"), F.least(t["c"] + TAG_BONUS, F.lit(TAG_CAP)).alias("c"), via(t).alias("via"), F.lit(False).alias("contextual"))).otherwise(acc)
    out = out.withColumn("won", F.aggregate(F.coalesce("held", F.array().cast("array<struct<ord:int,tag:string,value:string,data_type:string,c:double>>")), start, step))
    off = F.lower("mark.value").isin("-", "false", "none")
    given = F.when(F.lower("mark.value").isin("", "true"), F.coalesce("direct.data_type", F.col("mark.cls"))).otherwise(F.col("mark.value"))
    marked = F.col("mark").isNotNull()
    out = out.select(
        *fields.columns,
        F.when(marked & off, None).when(marked, given).otherwise(F.col("won.data_type")).alias("data_type"),
        F.when(marked & off, 0.0).when(marked, 1.0).otherwise(F.col("won.c")).alias("confidence"),
        (marked & off).alias("suppressed"),
        F.when(marked, False).otherwise(F.col("won.contextual")).alias("contextual"),
        F.when(marked, F.concat(F.col("mark.tag"), F.lit(':"'), F.when(off, "-").otherwise(given), F.lit('"'))).otherwise(F.col("won.via")).alias("via"),
    )
    return out.filter("suppressed OR data_type IS NOT NULL")


def type_keys(name: Column) -> Column:
    """The qualified and the short name of a type, without pointer, optional and element marks."""
    n = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^[*\\[\\]&?]+", ""), "\\?$", ""), "(?<=.)[<\\[].*$", "")
    return F.filter(F.array_distinct(F.array(n, F.regexp_extract(n, "([^./]*)$", 1))), lambda k: k != "")


def is_collection(kind: Column) -> Column:
    return F.startswith(kind, F.lit("[]")) | F.endswith(kind, F.lit("[]")) | F.regexp(kind, F.lit("^map\\[")) | F.regexp(kind, F.lit("(?:^|[./])(?:List|Set|Map|Collection|Array|ArrayList|MutableList|Iterable|Sequence|Dict|dict|list|set|Page|Flow|LiveData)[<\\[]"))


def element_type(kind: Column, depth: int = 4) -> Column:
    """What a collection or carrier holds, through a bounded number of layers."""
    for _ in range(depth):
        inner = F.regexp_extract(kind, "^[^<\\[]*[<\\[](?:.*,\\s*)?(.+)[>\\]]\\??$", 1)
        plain = F.regexp_replace(F.regexp_replace(kind, "^(?:\\[\\]|map\\[[^\\]]*\\])", ""), "\\[\\]$", "")
        kind = F.when(plain != kind, plain).when(inner != "", inner).otherwise(kind)
    return F.regexp_replace(kind, "^[*&]+", "")


def carried(fields: DataFrame, hints: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(type, data_types): what values of a declared type carry, one nested level deep, not through collections."""
    fields = fields.select("type", "kind", "external", "field_type")
    direct = hints.filter(~F.col("suppressed") & (F.col("confidence") >= floor)).select("type", "data_type").distinct()
    keyed = direct.withColumn("key", F.explode(type_keys(F.col("type")))).select("key", F.col("type").alias("of"), "data_type")
    nested = fields.filter(~is_collection(F.col("field_type"))).withColumn("key", F.explode(type_keys(F.col("field_type")))).join(keyed, "key").filter("type != of").select("type", "data_type")
    apt = fields.filter("NOT external AND kind NOT IN ('class', 'object')").select("type").distinct()
    return direct.unionByName(nested).join(apt, "type", "left_semi").groupBy("type").agg(F.array_sort(F.collect_set("data_type")).alias("data_types"))


def norm_field(field: Column) -> Column:
    return F.array_join(names.tokens(field), "")


def field_lookup(reads: DataFrame, fields: DataFrame, hints: DataFrame) -> DataFrame:
    """Adds data_type, confidence and state (sensitive, suppressed, unknown) to reads (owner, field).

    The owner's own hint decides; without a known owner, only same-named fields that agree do.
    """
    rid = reads.withColumn("rid_", F.monotonically_increasing_id())
    own = hints.withColumns({"key": F.explode(type_keys(F.col("type"))), "fk": F.lower("field")})
    pick = Window.partitionBy("key", "fk").orderBy(F.col("suppressed").desc(), F.col("confidence").desc(), "type")
    own = own.withColumn("r_", F.row_number().over(pick)).filter("r_ = 1").select("key", "fk", F.struct("data_type", "confidence", "suppressed").alias("h"))
    at = rid.select("rid_", F.lower("field").alias("fk"), F.posexplode(type_keys(F.coalesce("owner", F.lit("")))).alias("k", "key"))
    direct = at.join(own, ["key", "fk"]).groupBy("rid_").agg(F.min_by("h", "k").alias("direct"))
    known = at.join(fields.select(F.explode(type_keys(F.col("type"))).alias("key")).distinct(), "key", "left_semi").select("rid_").distinct().withColumn("known", F.lit(True))
    free = hints.filter("NOT contextual").withColumn("nf", norm_field(F.col("field"))).groupBy("nf").agg(F.count_distinct(F.struct("data_type", "suppressed")).alias("n"), F.max_by(F.struct("data_type", "confidence", "suppressed"), "confidence").alias("any_")).filter("n = 1")
    out = rid.withColumn("nf", norm_field(F.col("field"))).join(direct, "rid_", "left").join(known, "rid_", "left").join(free.drop("n"), "nf", "left")
    loose = F.when(F.col("known").isNull(), F.col("any_"))
    h = F.coalesce("direct", loose)
    fall = F.when(F.col("direct").isNull(), UNKNOWN_OWNER).otherwise(0.0)
    state = F.when(h.isNull(), "unknown").when(h["suppressed"], "suppressed").otherwise("sensitive")
    return out.withColumns({"state": state, "data_type": F.when(state == "sensitive", h["data_type"]), "confidence": F.when(state == "sensitive", h["confidence"] - fall)}).drop("rid_", "nf", "direct", "known", "any_")


FIELDS_SCHEMA = "type string, kind string, external boolean, field string, field_type string, tags map<string,string>"


def parse_proto(text: str) -> list[tuple]:
    """Fields of protobuf messages, nested and in oneofs, with pii options and comments as tags."""
    rows, stack = [], []
    for line in text.splitlines():
        code, _, note = line.partition("//")
        comment = re.search(r"pii:\s*([\w\-]+)", note)
        for opened in re.finditer(r"\b(message|oneof|enum|service)\s+(\w+)\s*\{|(\{)|(\})", code):
            if opened[4]:
                stack and stack.pop()
            else:
                stack.append((opened[1] or "other", opened[2] or ""))
        found = re.match(r"\s*(?:repeated\s+|optional\s+|required\s+)?(map<[^>]+>|[\w.]+)\s+(\w+)\s*=\s*\d+\s*(\[[^\]]*\])?\s*;", code.split("{")[-1])
        owners = [n for k, n in stack if k == "message"]
        if found and owners and stack[-1][0] in ("message", "oneof"):
            option = re.search(r'\(?pii\)?\s*=\s*"?([\w\-]+)"?', found[3] or "")
            mark = option or comment
            repeated = "[]" if re.match(r"\s*repeated\b", code) else ""
            rows.append((".".join(owners), "proto", False, found[2], repeated + found[1], {"pii": mark[1]} if mark else {}))
    return rows


_COLUMN = re.compile(r"""^\s*["`\[]?(\w+)["`\]]?\s+([A-Za-z]\w*(?:\s*\([^)]*\))?)(.*)$""", re.S)
_NO_COLUMN = ("primary", "foreign", "unique", "constraint", "key", "index", "check", "exclude", "like")


def parse_sql(text: str) -> list[tuple]:
    """Columns of CREATE TABLE and ALTER TABLE ... ADD, with pii marks of comments as tags."""
    rows = []
    for create in re.finditer(r"(?is)\bcreate\s+(?:temporary\s+|temp\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)\s*\(", text):
        depth, k = 1, create.end()
        while k < len(text) and depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        body, table = text[create.end() : k - 1], "table:" + re.sub(r"[\"`\[\]]", "", create[1])
        marks = {m[1].lower(): m[2] for m in re.finditer(r"(?im)^\s*[\"`\[]?(\w+)[^\n]*?--\s*pii:\s*([\w\-]+)", body)}
        for part in re.split(r",(?![^(]*\))", re.sub(r"--[^\n]*", "", body)):
            c = _COLUMN.match(part.strip())
            if c and c[1].lower() not in _NO_COLUMN:
                said = re.search(r"(?i)comment\s+'[^']*pii:\s*([\w\-]+)", c[3])
                mark = said[1] if said else marks.get(c[1].lower())
                rows.append((table, "table", False, c[1], c[2], {"pii": mark} if mark else {}))
    for add in re.finditer(r"(?i)\balter\s+table\s+(?:only\s+)?([\w.\"`\[\]]+)\s+add\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?[\"`\[]?(\w+)[\"`\]]?\s+([A-Za-z]\w*(?:\s*\([^)]*\))?)", text):
        if add[2].lower() not in _NO_COLUMN:
            rows.append(("table:" + re.sub(r"[\"`\[\]]", "", add[1]), "table", False, add[2], add[3], {}))
    return rows


def parse_files(files: DataFrame) -> DataFrame:
    """Declared fields of protobuf and SQL files (path, text)."""
    import pandas as pd

    def each(frames):
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"]):
                parse = parse_proto if path.endswith(".proto") else parse_sql if path.endswith(".sql") else None
                rows += parse(text or "") if parse else []
            yield pd.DataFrame(rows, columns=["type", "kind", "external", "field", "field_type", "tags"])

    return files.select("path", "text").mapInPandas(each, FIELDS_SCHEMA)


def catalog_fields(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Columns of tables as declared fields."""
    rows = [(f"table:{name}", "table", False, f.name, f.dataType.simpleString(), {}) for name, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, FIELDS_SCHEMA)


def as_inventory(hints: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Hints of non-external declarations as (store, kind, field, data_type)."""
    keep = reduce(lambda a, b: a & b, [~F.col("suppressed"), F.col("confidence") >= floor, ~F.col("external")])
    return hints.filter(keep).select(F.col("type").alias("store"), "kind", "field", "data_type")
