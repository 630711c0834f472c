"""Chat formatting by schema fingerprints (operator 2), in DataFrame functions only.

Records of unlike layouts (messages, prompt and response, instruction and input,
one row a turn) come as JSON text or VARIANT.  A record's fingerprint is the hash
of its nested field paths (names and nesting in canonical order, not the types of
the leaves).  It selects a declarative mapping, and the mapping's compiled
expression turns the record into canonical turns (role, text).

Turns are rendered with a marker template.  Control strings inside texts are
escaped reversibly: the backslash and the two characters that any control string
begins with are replaced by two-character codes, so neither the markers nor
strings like ``</s>`` or ``[INST]`` occur in a formatted text other than as
markers.  The loss mask is a list of spans (start, length in code points) of the
formatted text: the assistant's texts.

Defined results: a null text is the empty text, a null role the empty role; a
record whose fingerprint no mapping has keeps ``mapping`` null and has no turns
(it is not dropped); a JSON text that cannot be parsed counts as such.  Turns are
ordered by the order column, then role, then text, nulls first; repeated rows are
repeated turns.  Null keys form one conversation.  A conversation is one output
row, so its turns meet in one task; nothing is cut.  Input columns beyond those
named are ignored; a column named mapping or turns is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import table

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>\n"
#: Character -> code.  Every backslash of an escaped text begins a code, so codes can be undone one kind at a time, the backslash last.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
LINE = ("\n", "\\n")
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    ``turns``: (role, paths) pairs of a flat record; the texts of the paths are
    joined by a blank line, empty ones left out; a turn of optional paths only is
    left out if all are absent or empty.  ``items``: instead, the path of an array
    whose elements are turns with the fields ``role`` and ``text``.
    ``required`` and ``optional`` are the field paths that the layout has.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    rename: bool = True

    def skeletons(self) -> list[str]:
        """Of the layout with each choice of its optional paths, and with an empty array of items."""
        out = []
        for n in range(len(self.optional) + 1):
            for extra in combinations(self.optional, n):
                out.append(skeleton([*self.required, *extra]))
                if self.items:
                    own = [p for p in (*self.required, *extra) if not p.startswith(f"{self.items}[]")]
                    out.append(skeleton([*own, f"{self.items}[]"]))
        return out

    def expression(self, record: Column) -> Column:
        if self.items:
            items = F.try_variant_get(record, f"$.{self.items}", "array<variant>")
            made = F.transform(items, lambda m: F.struct(self._role(F.try_variant_get(m, f"$.{self.role}", "string")).alias("role"), _text(m, self.text).alias("text")))
            return F.coalesce(made, F.array()).cast(TURN)
        made = []
        for role, paths in self.turns:
            fields = [F.nullif(_text(record, p), F.lit("")) for p in paths]
            text = F.concat_ws("\n\n", *fields) if len(fields) > 1 else F.coalesce(fields[0], F.lit(""))
            name = self._role(F.try_variant_get(record, role, "string")) if role.startswith("$.") else F.lit(role)
            one = F.array(F.struct(name.alias("role"), text.alias("text"))).cast(TURN)
            made.append(F.when(text != "", one).otherwise(F.array().cast(TURN)) if all(p in self.optional for p in paths) else one)
        return F.concat(*made)

    def _role(self, value: Column) -> Column:
        out = F.coalesce(value, F.lit(""))
        for k, v in ROLE_NAMES.items() if self.rename else ():
            out = F.when(F.lower(value) == k, v).otherwise(out)
        return out


def _text(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit(""))


#: The layouts known from the start; callers may pass others.
MAPPINGS = (
    Mapping("turn_row", ("role", "text"), turns=(("$.role", ("text",)),), rename=False),
    Mapping("messages", ("messages[].role", "messages[].content"), ("id", "source"), items="messages", role="role", text="content"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("id", "system"), items="conversations", role="from", text="value"),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt", ("prompt", "response"), ("system",), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("completion", ("prompt", "completion"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question", ("question", "answer"), ("context",), turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
    Mapping("nested", ("data.prompt.text", "data.reply.text"), ("meta.lang",), turns=(("user", ("data.prompt.text",)), ("assistant", ("data.reply.text",)))),
)


def skeleton(paths: list[str]) -> str:
    """The canonical text of a set of field paths (``a.b``, ``a[].b``): names in order, nested."""
    if paths == [""] or not paths:
        return ""
    if any(p.startswith("[]") for p in paths):
        return f"ARRAY<{skeleton([p[2:].removeprefix('.') for p in paths])}>"
    tree: dict[str, list[str]] = {}
    for p in paths:
        name = p.split(".")[0].split("[]")[0]
        tree.setdefault(name, []).append(p[len(name) :].removeprefix("."))
    return "OBJECT<" + ", ".join(f"{n}: {s}" if (s := skeleton(sub)) else n for n, sub in sorted(tree.items())) + ">"


def record_skeleton(record: Column) -> Column:
    """The same text of a VARIANT: its schema without the types of the leaves."""
    schema = F.schema_of_variant(record)
    leaf = r"(?<=: |^|ARRAY<)(?!OBJECT<|ARRAY<)[A-Z_ ]+(?:\([0-9, ]+\))?(?=[,>]|$)"
    return F.regexp_replace(F.regexp_replace(schema, leaf, ""), r": (?=[,>])", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(record_skeleton(record))


def canonical_turns(df: DataFrame, record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds ``mapping`` (name or null) and ``turns`` (array of role, text) for a VARIANT or JSON-text record."""
    kind = df.select(record.alias("r")).schema["r"].dataType.typeName()
    variant = F.try_parse_json(record) if kind == "string" else record
    named = df.withColumn("_record", variant).withColumn("_print", fingerprint(F.col("_record")))
    name, turns = F.lit(None).cast("string"), F.array().cast(TURN)
    for m in reversed(mappings):
        # literals of the declared paths' hashes: chosen by one comparison of longs a mapping
        own = F.col("_record").isNotNull() & F.col("_print").isin(*[F.xxhash64(F.lit(s)) for s in m.skeletons()])
        name, turns = F.when(own, m.name).otherwise(name), F.when(own, m.expression(F.col("_record"))).otherwise(turns)
    return named.withColumn("mapping", name).withColumn("turns", turns).drop("_record", "_print")


def escape(text: Column, more: tuple = ()) -> Column:
    for char, code in (*ESCAPES, *more):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column, more: tuple = ()) -> Column:
    for char, code in reversed((*ESCAPES, *more)):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_conversations(turns: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, formatted string, loss array<struct<start, length>> of rows with ``role`` and ``text``.

    The window and the grouping share one exchange by key.  Spans come from a
    running sum of the rendered turns' lengths.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escape(role, (LINE,)), F.lit("\n"))
    rows = turns.select(key, *order, role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    by = Window.partitionBy(key).orderBy(*order, "role", "text")
    rows = rows.withColumn("place", F.row_number().over(by))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == "assistant", F.struct("start", F.length("body").cast("long").alias("length")))
    made = rows.groupBy(key).agg(F.collect_list(F.struct("place", "piece")).alias("pieces"), F.collect_list(span).alias("loss"))
    joined = F.array_join(F.transform(F.array_sort("pieces"), lambda p: p["piece"]), "")
    return made.select(key, joined.alias("formatted"), F.array_sort("loss").alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.length(F.substring_index(p, "\n", 1))
        body = F.substring(p, head + 2, F.length(p) - head - F.lit(1 + len(END)))
        return F.struct(unescape(F.substring_index(p, "\n", 1), (LINE,)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    every = rows.union(probe).withColumn("record", F.to_variant_object(F.struct("role", "text")))
    turns = canonical_turns(every.select("conv_id", "turn", "record"), F.col("record")).select("conv_id", "turn", F.inline("turns"))
    out = format_conversations(turns, "conv_id", ["turn"]).withColumn("read", read_turns(F.col("formatted"))).withColumn("under_loss", loss_text(F.col("formatted"), F.col("loss")))
    lines = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("under_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("under_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(column: str) -> str:
    for char, code in ESCAPES:
        column = f"replace({column}, '{char}', '{code}')"
    return column


CHAT_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {len(START) + 1 + len(END)}) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

QUERIES = {"op2_chat_format": op2_chat_format}
ORACLE = {"op2_chat_format": CHAT_SQL}
