"""Operator 4, chat formatting: schema fingerprints select declarative mappings from records to canonical turns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Each:
    """A turn for each element of the list at `path`."""

    path: str
    role: str
    text: str


@dataclass(frozen=True)
class Part:
    """One turn of a fixed role: the texts at `paths` that aren't empty, a blank line between. Without any: no turn."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Row:
    """The record is one turn."""

    role: str
    text: str


#: Layouts by the nested field paths that a record has; [] stands for the elements of a list.
MAPPINGS: dict[tuple[str, ...], tuple] = {
    ("role", "text"): (Row("role", "text"),),
    ("content", "role"): (Row("role", "content"),),
    ("messages[].content", "messages[].role"): (Each("messages", "role", "content"),),
    ("conversations[].from", "conversations[].value"): (Each("conversations", "from", "value"),),
    ("turns[].role", "turns[].text"): (Each("turns", "role", "text"),),
    ("instruction", "output"): (Part("user", ("instruction",)), Part("assistant", ("output",))),
    ("input", "instruction", "output"): (Part("user", ("instruction", "input")), Part("assistant", ("output",))),
    ("completion", "prompt"): (Part("user", ("prompt",)), Part("assistant", ("completion",))),
    ("prompt", "response"): (Part("user", ("prompt",)), Part("assistant", ("response",))),
    ("prompt", "response", "system"): (Part("system", ("system",)), Part("user", ("prompt",)), Part("assistant", ("response",))),
    ("answer", "question"): (Part("user", ("question",)), Part("assistant", ("answer",))),
}
ROLES: dict[str, str] = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def _skeleton(paths: tuple[str, ...]) -> str:
    """The paths as a nested type without the leaves' own types, keys in order: how a record's schema is written too."""
    tree: dict = {}
    for path in paths:
        at = tree
        for name in path.split("."):
            at = at.setdefault(name, {})

    def written(t: dict) -> str:
        out = []
        for name in sorted(t):
            key, many = name.removesuffix("[]"), name.endswith("[]")
            inner = written(t[name]) if t[name] else ""
            out.append(key + (f": ARRAY<{inner}>" if many else f": {inner}" if inner else ""))
        return f"OBJECT<{', '.join(out)}>"

    return written(tree)


def fingerprint(skeleton: str) -> int:
    h = xxhash.xxh64_intdigest(skeleton.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def typed_fingerprint(schema: StructType) -> int:
    """The fingerprint of a table's own schema: all its records have one layout."""

    def paths(kind: DataType, at: str) -> list[str]:
        if isinstance(kind, StructType):
            return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
        return paths(kind.elementType, f"{at}[]") if isinstance(kind, ArrayType) else [at]

    return fingerprint(_skeleton(tuple(sorted(paths(schema, "")))))


def record_fingerprint(record: Column) -> Column:
    """The fingerprint of each parsed record (a variant): a hash of its nested field paths, whatever the leaves hold."""
    return F.xxhash64(F.regexp_replace(F.schema_of_variant(record), r": (?!ARRAY<|OBJECT<)[A-Z]+(\([0-9, ]*\))?", ""))


def _canonical(role: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.element_at(known, F.coalesce(role, F.lit(""))), role, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(_canonical(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _listed(elements: Column, rule: Each) -> Column:
    return F.coalesce(F.transform(elements, lambda x: _turn(x[rule.role], x[rule.text])), F.array().cast(TURNS))


def _turns(rules: tuple, get, each) -> Column:
    """get(path) is a text of the record, each(path, names) its list's elements as structs of texts."""
    out = []
    for rule in rules:
        if isinstance(rule, Each):
            out.append(_listed(each(rule.path, (rule.role, rule.text)), rule))
        elif isinstance(rule, Row):
            out.append(F.array(_turn(get(rule.role), get(rule.text))))
        else:
            texts = F.filter(F.array(*map(get, rule.paths)), lambda x: F.coalesce(x, F.lit("")) != "")
            out.append(F.when(F.size(texts) > 0, F.array(F.struct(F.lit(rule.role).alias("role"), F.array_join(texts, "\n\n").alias("text")))).otherwise(F.array().cast(TURNS)))
    return F.concat(*out) if len(out) > 1 else out[0]


def typed_turns(table: DataFrame, *keep: str) -> DataFrame:
    """The columns keep of each row and its turns; the other columns' schema selects the mapping for the whole table."""
    fields = StructType([f for f in table.schema.fields if f.name not in keep])
    rules = next((r for p, r in MAPPINGS.items() if fingerprint(_skeleton(p)) == typed_fingerprint(fields)), None)
    if rules is None:
        raise ValueError(f"no mapping for {fields.simpleString()}")
    return table.select(*keep, _turns(rules, lambda p: F.col(p).cast("string"), lambda p, _: F.col(p)).alias("turns"))


def json_turns(table: DataFrame, record: str, *keep: str) -> DataFrame:
    """The columns keep of each row, the turns of its JSON record, and mapped: false (and no turns) where the record
    isn't valid JSON or has a layout without a mapping; such rows stay, to be reported."""
    rows = table.select(*keep, F.try_parse_json(F.col(record)).alias("v")).withColumn("print", record_fingerprint(F.col("v")))
    get = lambda p: F.try_variant_get("v", f"$.{p}", "string")
    each = lambda p, names: F.try_variant_get("v", f"$.{p}", f"array<struct<{','.join(f'`{n}`:string' for n in names)}>>")
    chosen, mapped = F.lit(None).cast(TURNS), F.lit(False)
    for paths, rules in MAPPINGS.items():
        mine = F.col("print") == fingerprint(_skeleton(paths))
        chosen, mapped = F.when(mine, _turns(rules, get, each)).otherwise(chosen), mapped | mine
    return rows.select(*keep, F.coalesce(chosen, F.array().cast(TURNS)).alias("turns"), F.coalesce(mapped, F.lit(False)).alias("mapped"))


@dataclass(frozen=True)
class Template:
    """A turn is opening, role, between, text, closing."""

    opening: str = "<|im_start|>"
    between: str = "\n"
    closing: str = "<|im_end|>\n"


CHATML = Template()
#: Starts of control strings of this and other templates: a backslash goes behind the first character of each, and
#: behind each backslash, so that no text holds a control string and the text can be had back.
_CONTROL = r"\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
_BROKEN = r"([\\<\[])\\"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$0\\")


def escape(text: str) -> str:
    return re.sub(_CONTROL, lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(_BROKEN, r"\1", text)


def formatted(turns: DataFrame, *keep: str, template: Template = CHATML) -> DataFrame:
    """The columns keep of each row, and for each of its turns number, segment, loss_from and loss_length.

    segment is the turn in the template; the loss lies on an assistant's text, so many code points of the segment. A
    conversation's output is its segments in order; none is ever gathered, so a conversation may be of any length. A
    line break in a role is escaped as well."""
    rows = turns.select(*keep, F.posexplode("turns").alias("number", "t"))
    role = F.replace(escaped(F.col("t.role")), F.lit("\n"), F.lit("\\\n"))
    rows = rows.select(*keep, "number", F.col("t.role").alias("role"), role.alias("r"), escaped(F.col("t.text")).alias("x"))
    head = F.concat(F.lit(template.opening), "r", F.lit(template.between))
    return rows.select(*keep, "number", F.concat(head, "x", F.lit(template.closing)).alias("segment"), F.char_length(head).alias("loss_from"), F.when(F.col("role") == "assistant", F.char_length("x")).otherwise(0).alias("loss_length"))


def parse(segment: str, template: Template = CHATML) -> tuple[str, str]:
    """Role and text of a segment."""
    inner = segment[len(template.opening) : len(segment) - len(template.closing)]
    m = re.match(rf"((?:[^\\\n]|\\.|\\\n)*?){re.escape(template.between)}", inner)
    return unescape(m[1]).replace("\\\n", "\n"), unescape(inner[m.end() :])


def digests(segments: DataFrame, *order: str, template: Template = CHATML) -> DataFrame:
    """A row for each conversation (conv_id), read back from its segments in the given order.

    Segments are sorted within their conversation's partition and streamed: a digest is a chain over all turns, so a
    conversation is read by one task, but no more than a batch of it is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> tuple:
            return now, n, whole.hexdigest(), loss_n, loss.hexdigest(), chars

        now, some, out = None, False, []
        n = loss_n = chars = 0
        whole = loss = hashlib.sha256()
        for batch in batches:
            for conv, segment, at, length in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_from", "loss_length")), strict=True):
                if not some or conv != now:
                    if some:
                        out.append(row())
                    now, some, n, loss_n, chars, whole, loss = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text = parse(segment, template)
                whole.update(f"{role}\n{text}\n".encode())
                kept = unescape(segment[at : at + length])
                loss.update(kept.encode())
                n, loss_n, chars = n + 1, loss_n + len(kept), chars + len(segment)
            if out:
                yield batch_of(out)
                out = []
        if some:
            yield batch_of([row()])

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    sorted_ = segments.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    return sorted_.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation of control strings, as a JSON record.
TRICKY = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def chat_report(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations (rows conv_id, turn, role, text) and of conversation -7, read back from the output.

    Rows go by turn, nulls first; rows of one turn by role, then text. A null text or role is empty, a null conv_id is
    a conversation of its own; an empty table leaves conversation -7; other columns are ignored."""
    rows = typed_turns(conversations.select("conv_id", "turn", "role", "text"), "conv_id", "turn")
    one = conversations.sparkSession.createDataFrame([(-7, 0, TRICKY)], "conv_id long, turn long, record string")
    turns = rows.unionByName(json_turns(one, "record", "conv_id", "turn").drop("mapped"))
    return digests(formatted(turns, "conv_id", "turn"), "turn", "number", "segment")


CHAT_SQL = """
with t as (
  select conv_id, turn, 0 as number, case coalesce(role, '') {cases} else coalesce(role, '') end as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 0, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(regexp_replace(text, '(\\\\)', '\\1\\\\', 'g'), '(<)(\\||/?s>|</?SYS>>)', '\\1\\\\\\2', 'g') as once from t),
s as (select *, length(regexp_replace(once, '(\\[)(/?INST\\])', '\\1\\\\\\2', 'g')) + length(role) + {frame} as chars from e)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, number, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, number, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from s group by conv_id
""".format(cases=" ".join(f"when '{k}' then '{v}'" for k, v in ROLES.items()), frame=len(CHATML.opening + CHATML.between + CHATML.closing))
