"""Chat formatting: schema fingerprints pick a declarative mapping to canonical turns; a reversible template marks them.

Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths, lower case: a.b for fields of structs, a[].b for those inside arrays."""
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}".lstrip(".").lower())]
    return [prefix]


def path_hash(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: Layouts: the paths that make one up, and how each becomes turns. ("turns", array, role field, text field) or
#: ("fields", (role, field), ...) in speaking order, or ("rows", role field, text field) for one turn a row.
LAYOUTS = {
    "rows": (("role", "text", "turn"), ("rows", "role", "text")),
    "messages": (("messages[].role", "messages[].content"), ("turns", "messages", "role", "content")),
    "share": (("conversations[].from", "conversations[].value"), ("turns", "conversations", "from", "value")),
    "instruction": (("instruction", "input", "output"), ("fields", ("user", ("instruction", "input")), ("assistant", ("output",)))),
    "short_instruction": (("instruction", "output"), ("fields", ("user", ("instruction",)), ("assistant", ("output",)))),
    "prompt": (("prompt", "completion"), ("fields", ("user", ("prompt",)), ("assistant", ("completion",)))),
    "system_prompt": (("system", "prompt", "completion"), ("fields", ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    "question": (("question", "answer"), ("fields", ("user", ("question",)), ("assistant", ("answer",)))),
    "prompt_response": (("prompt", "response"), ("fields", ("user", ("prompt",)), ("assistant", ("response",)))),
}
KNOWN_PATHS = sorted({p for paths, _ in LAYOUTS.values() for p in paths})
BY_HASH = {path_hash(paths): name for name, (paths, _) in LAYOUTS.items()}
#: Names of roles that mean a canonical one.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layout_of(df: DataFrame) -> str:
    """The layout with most paths of those whose paths df has, by the hash of these paths; other columns don't count, whatever
    their names. Two layouts with as many paths are an error, and so is none: then the layout has to be named."""
    found = set(field_paths(df.schema))
    fits = [paths for paths, _ in LAYOUTS.values() if found.issuperset(paths)]
    largest = [paths for paths in fits if len(paths) == max(map(len, fits))]
    if len(largest) != 1:
        raise ValueError(f"{'more than one' if largest else 'no'} layout has the fields {', '.join(sorted(found.intersection(KNOWN_PATHS))) or '(none)'}")
    return BY_HASH[path_hash(largest[0])]


def _turn(role: Column, text: Column, turn: Column) -> Column:
    return F.struct(turn.cast("long").alias("turn"), role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _canonical_role(role: Column) -> Column:
    out = F.coalesce(role.cast("string"), F.lit(""))
    for other, own in ROLES.items():
        out = F.when(out == other, own).otherwise(out)
    return out


def canonical_turns(df: DataFrame, conv_id: str = "conv_id", layout: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text): a row for each turn, from any layout that LAYOUTS describes.

    The layout is found from the schema's fingerprint unless given. A row that holds a whole conversation gives its
    turns numbered from 0; parts of one turn are joined by a blank line, empty and null parts left out, and a turn
    without any part is left out. In the rows layout roles and null ids stay as they are; null text is empty.
    """
    kind, *rule = LAYOUTS[layout or layout_of(df)][1]
    if kind == "rows":
        return df.select(F.col(conv_id).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col(rule[0]).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(rule[1]).cast("string"), F.lit("")).alias("text"))
    if kind == "turns":
        array, role, text = rule
        turns = F.transform(F.coalesce(F.col(array), F.array().cast(df.schema[array].dataType)), lambda x, i: _turn(_canonical_role(x[role]), x[text], i))
    else:
        parts = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*(F.col(f).cast("string") for f in fields)), lambda x: F.length(x) > 0), "\n\n").alias("text")) for role, fields in rule]
        turns = F.transform(F.filter(F.array(*parts), lambda x: F.length(x["text"]) > 0), lambda x, i: _turn(x["role"], x["text"], i))
    return df.select(F.col(conv_id).alias("conv_id"), F.inline(turns))


def json_turns(df: DataFrame, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """canonical_turns() of a column of JSON records whose layouts differ from row to row.

    Each record's fingerprint is the hash of the paths of the largest layout that it fills; records that no layout fits, or two
    of one size, malformed ones among them, give no turns and can be found with fingerprints_of_json(). Other columns of df don't
    count, and an empty table gives no turns.
    """
    marked = fingerprints_of_json(df.select(F.col(conv_id).alias("_id"), F.col(record).alias("_record")), "_record")
    out = None
    for name, (_, rule) in LAYOUTS.items():
        if rule[0] == "rows":
            continue
        own = marked.where(F.col("layout") == name).select(F.col("_id").alias("conv_id"), "parsed.*")
        turns = canonical_turns(own, "conv_id", name)
        out = turns if out is None else out.unionByName(turns)
    return out


def fingerprints_of_json(df: DataFrame, record: str = "record") -> DataFrame:
    """df with parsed (the known fields), schema_hash (of the paths of the largest layout that the record fills) and layout; both
    null where it fills none, or two of one size. Columns of df with these three names are replaced."""
    plain = sorted({p for p in KNOWN_PATHS if "[]" not in p} - {"role", "text", "turn"})
    fields = [T.StructField(p, T.StringType()) for p in plain]
    for array in sorted({p.split("[]")[0] for p in KNOWN_PATHS if "[]" in p}):
        inner = [p.split("[].")[1] for p in KNOWN_PATHS if p.startswith(f"{array}[]")]
        fields.append(T.StructField(array, T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in inner]))))
    parsed = F.from_json(F.col(record), T.StructType(fields))
    there = [F.when(F.col("parsed")[p].isNotNull(), F.lit(p)) for p in plain]
    there += [F.when(F.exists(F.col("parsed")[array], _has(field)), F.lit(f"{array}[].{field}")) for array, field in (p.split("[].") for p in KNOWN_PATHS if "[]" in p)]
    filled = F.array_compact(F.array(*there))
    fits = F.lit(None).cast("string")
    for size in sorted({len(paths) for paths, _ in LAYOUTS.values()}):  # larger layouts are asked first
        own = [F.when(F.size(F.array_except(F.array(*map(F.lit, paths)), filled)) == 0, F.lit(path_hash(paths))) for paths, _ in LAYOUTS.values() if len(paths) == size]
        found = F.array_compact(F.array(*own))
        fits = F.when(F.size(found) == 1, found[0]).when(F.size(found) == 0, fits)
    names = F.create_map(*(F.lit(x) for kv in BY_HASH.items() for x in kv))
    return df.withColumn("parsed", parsed).withColumn("schema_hash", fits).withColumn("layout", F.try_element_at(names, F.col("schema_hash")))


def _has(field: str):
    return lambda x: x[field].isNotNull()


def escaped(text: Column) -> Column:
    """No control string is left: a backslash before every backslash and inside every '<|'."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): a conversation's turns in one text, and the stretches that training counts.

    Each turn becomes <|im_start|>role, a line break, its text, <|im_end|> and a line break, with texts and roles escaped
    (line breaks inside roles too). loss holds struct<start, chars>, code points from 1, of each assistant text. Turns
    stand by number, then role and text; repeated rows are repeated turns. Rows of null conv_id are one conversation.
    """
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    head, body = F.concat(F.lit(START), role, F.lit("\n")), escaped(F.col("text"))
    pieces = turns.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body")).withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.withColumn("nth", F.count(F.lit(1)).over(order)).withColumn("ends", F.sum(F.length("piece")).over(order))
    start = (F.col("ends") - F.length("piece") + F.length("head") + 1).alias("start")
    stretch = F.when(F.col("role") == "assistant", F.struct(start, F.length("body").cast("long").alias("chars"))).alias("loss")
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", "piece", stretch))).alias("all"))
    return whole.select("conv_id", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"), F.filter(F.transform("all", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; the inverse of format_turns()."""
    pattern = r"(?s)<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*?)<\|im_end\|>\n"
    parts = [F.regexp_extract_all(formatted, F.lit(pattern), F.lit(i)) for i in (1, 2)]
    return F.zip_with(*parts, lambda r, t: F.struct(unescaped(r).alias("role"), unescaped(t).alias("text")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings in its texts, formatted and read back."""
    odd = END + START + "assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    turns = canonical_turns(table(spark, sf_dir, "conversations").unionByName(extra, allowMissingColumns=True))
    back = format_turns(turns).withColumn("turns", read_turns(F.col("formatted")))
    said = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.transform("loss", lambda x: unescaped(F.substring(F.col("formatted"), x["start"].cast("int"), x["chars"].cast("int"))))
    lost = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"), F.array_join(loss, "").alias("lost"), F.length("formatted").cast("long").alias("formatted_chars"))
    return lost.select("conv_id", "n_turns", "turns_sha256", F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars")


OP5_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10))) + 24 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
