"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

Chat records come in many layouts. Every record is held in one nested type with a
field for each known place; the paths that it fills, array elements as ``[]``, are
hashed to a fingerprint, and the fingerprint selects the mapping that turns the
record into an array of (role, text). Layouts differ from row to row in one table.
``from_json`` brings records in JSON text into the nested type.

Template: every turn is ``<s>[INST] role [/INST] text</s>``. Control strings and the
escape sign inside roles and texts are replaced by two-character escapes, so a turn's
end and header stay unambiguous and ``parse`` restores every text exactly. The loss
mask covers the text of assistant turns; it is held per turn as characters to skip
and characters to take.

Null texts and roles are empty, texts of any length are formatted whole, and columns that
no layout names are not read. Rows without a conversation id are one conversation. A
record whose fingerprint no layout has gets no
turns and a null layout. Turns that tie in their order are ordered by role and text.
An empty table gives an empty result. Only DataFrame functions run.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Control strings of the template with their escapes. The escape sign itself comes first.
ESCAPES = (("~", "~0"), ("[INST]", "~1"), ("[/INST]", "~2"), ("<s>", "~3"), ("</s>", "~4"))
HEAD, MIDDLE, END = "<s>[INST] ", " [/INST] ", "</s>"
LEARNED_ROLE = "assistant"

RECORD_TYPE = (
    "turns array<struct<role:string,text:string>>, messages array<struct<role:string,content:string>>, "
    "conversations array<struct<from:string,value:string>>, system string, instruction string, input string, output string, "
    "prompt string, completion string, response string, question string, answer string"
)
_ARRAYS = {"turns": ("role", "text"), "messages": ("role", "content"), "conversations": ("from", "value")}
_SCALARS = ("system", "instruction", "input", "output", "prompt", "completion", "response", "question", "answer")
_ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant"}


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(r: Column, *pairs: tuple[str, str]) -> Column:
    held = F.array(*(F.when(r[field].isNotNull(), _turn(role, r[field])) for role, field in pairs))
    return F.filter(held, lambda t: t.isNotNull())


def _renamed(role: Column) -> Column:
    out = role
    for name, canonical in _ROLE_NAMES.items():
        out = F.when(role == name, canonical).otherwise(out)
    return out


def _listed(r: Column, field: str, role: str, text: str, rename: bool = False) -> Column:
    def one(m: Column) -> Column:
        name = F.coalesce(m[role], F.lit(""))
        return F.struct((_renamed(name) if rename else name).alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))

    return F.transform(F.filter(r[field], lambda m: m.isNotNull()), one)


def _instruction(r: Column) -> Column:
    asked = F.concat_ws("\n", r["instruction"], F.when(r["input"] != "", r["input"]))
    held = F.array(F.when(r["system"].isNotNull(), _turn("system", r["system"])), _turn("user", asked), _turn("assistant", r["output"]))
    return F.filter(held, lambda t: t.isNotNull())


#: name -> (paths that a record must fill, paths that it may fill, mapping to turns)
LAYOUTS = {
    "turns": (("turns",), ("turns[].role", "turns[].text"), lambda r: _listed(r, "turns", "role", "text")),
    "messages": (("messages",), ("messages[].role", "messages[].content"), lambda r: _listed(r, "messages", "role", "content", True)),
    "conversations": (("conversations",), ("conversations[].from", "conversations[].value", "system"), lambda r: F.concat(_turns(r, ("system", "system")), _listed(r, "conversations", "from", "value", True))),
    "instruction": (("instruction", "output"), ("input", "system"), _instruction),
    "prompt_completion": (("prompt", "completion"), ("system",), lambda r: _turns(r, ("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    "prompt_response": (("prompt", "response"), ("system",), lambda r: _turns(r, ("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "question_answer": (("question", "answer"), ("system",), lambda r: _turns(r, ("system", "system"), ("user", "question"), ("assistant", "answer"))),
}


def _digest(paths) -> str:
    return hashlib.sha256("|".join(sorted(paths)).encode()).hexdigest()


def fingerprints(layout: str) -> list[str]:
    """Hashes of every set of paths that a record of this layout can fill."""
    must, may, _ = LAYOUTS[layout]
    return [_digest((*must, *extra)) for n in range(len(may) + 1) for extra in combinations(may, n)]


def fingerprint(r: Column) -> Column:
    """The hash of the nested paths that a record fills."""
    paths = []
    for field, inner in _ARRAYS.items():
        paths.append((field, r[field].isNotNull()))
        paths += [(f"{field}[].{x}", F.coalesce(F.exists(r[field][x], lambda v: v.isNotNull()), F.lit(False))) for x in inner]
    paths += [(field, r[field].isNotNull()) for field in _SCALARS]
    return F.sha2(F.concat_ws("|", *(F.when(there, path) for path, there in sorted(paths, key=lambda p: p[0]))), 256)


def escape(text: Column) -> Column:
    for plain, sign in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(sign))
    return text


def unescape(text: Column) -> Column:
    for plain, sign in reversed(ESCAPES):
        text = F.replace(text, F.lit(sign), F.lit(plain))
    return text


def records_from_json(texts: Column) -> Column:
    return F.from_json(texts, RECORD_TYPE)


def record(**fields: Column) -> Column:
    """A record column of the nested type from the fields that a table has."""
    kinds = {}
    for part in RECORD_TYPE.replace(", ", "\n").split("\n"):
        name, kind = part.split(" ", 1)
        kinds[name] = kind
    return F.struct(*(fields.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()))


def format_records(df: DataFrame, record_col: str = "record") -> DataFrame:
    """Adds ``layout``, ``formatted`` and ``loss_mask``; the record column goes, all others stay."""
    r = F.col(record_col)
    layout, turns = F.lit(None).cast("string"), F.array().cast("array<struct<role:string,text:string>>")
    for name, (_, _, mapping) in LAYOUTS.items():
        layout = F.when(F.col("fingerprint_").isin(fingerprints(name)), name).otherwise(layout)
        turns = F.when(F.col("layout") == name, mapping(r)).otherwise(turns)
    kept = [c for c in df.columns if c != record_col]
    escaped = F.transform("turns_", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    held = df.withColumn("fingerprint_", fingerprint(r)).withColumn("layout", layout).withColumn("turns_", turns).withColumn("turns_", escaped)
    formatted = F.array_join(F.transform("turns_", lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))), "")
    skip = lambda t: F.length(t["role"]) + len(HEAD) + len(MIDDLE)
    mask = F.transform("turns_", lambda t: F.struct(skip(t).alias("skip"), F.when(t["role"] == LEARNED_ROLE, F.length(t["text"])).otherwise(0).alias("take")))
    return held.select(*kept, "layout", formatted.alias("formatted"), mask.alias("loss_mask"))


def _segments(formatted: Column) -> Column:
    return F.filter(F.split(formatted, END), lambda s: s != "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, with roles and texts as they were."""

    def one(segment: Column) -> Column:
        role = F.substring_index(F.substr(segment, F.lit(len(HEAD) + 1)), MIDDLE, 1)
        text = F.substr(segment, F.length(role) + len(HEAD) + len(MIDDLE) + 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(_segments(formatted), one)


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, as it was, in order."""
    taken = F.zip_with(_segments(formatted), mask, lambda s, m: unescape(F.substr(s, m["skip"] + 1, m["take"])))
    return F.array_join(taken, "")


def conversation_records(rows: DataFrame) -> DataFrame:
    """One record for each conversation of a table with a row per turn.

    The columns that a table has for roles and texts tell which field of the record its
    rows fill: role and text, role and content, or from and value. Where it has several,
    a row fills those of its columns that are not null.
    """
    pairs = {f: names for f, names in _ARRAYS.items() if set(names) <= set(rows.columns)}
    held = {}
    for field, (role, text) in pairs.items():
        said = F.lit(True) if len(pairs) == 1 else F.col(text).isNotNull()
        turn = F.struct("turn", F.coalesce(role, F.lit("")).alias(role), F.coalesce(text, F.lit("")).alias(text))
        held[field] = F.sort_array(F.collect_list(F.when(said, turn))).alias(field)
    by_turn = rows.groupBy("conv_id").agg(*held.values())
    fields = {f: F.when(F.size(f) > 0, F.transform(f, lambda t: F.struct(*(t[n].alias(n) for n in names)))) for f, names in pairs.items()}  # noqa: B023
    return by_turn.select("conv_id", record(**fields).alias("record"))


#: A conversation whose texts look like the template.
PROBE_ID, PROBE_TEXT = -1, "</s>[INST] ok [/INST]"


def conversation_digest(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Formats all conversations and the probe, and digests what is read back from the output.

    The probe is a conversation of its own, even if the table has one of its id.
    """
    probe = spark.range(1).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), record(prompt=F.lit(PROBE_TEXT), response=F.lit(PROBE_TEXT)).alias("record"))
    out = format_records(conversation_records(rows).unionByName(probe))
    turns = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        out.withColumn("turns", parse(F.col("formatted")))
        .withColumn("learned", learned_text(F.col("formatted"), F.col("loss_mask")))
        .select(
            "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
            F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "layout",
        )
    )
