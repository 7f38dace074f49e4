"""Chat formatting: layouts told apart by schema fingerprint, turns marked and escaped reversibly.

A record's fingerprint is the hash of its nested field paths (an array's items
share the path ``name[]``), restricted to the paths that some mapping knows, so
that further fields don't matter.  A fingerprint selects a declarative mapping,
which names where roles and contents are; the result is canonical turns.

Each turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control
strings within a text are broken up by a backslash after their first character
and backslashes are doubled, so that no control string in the output comes from
a text, and the text can be had back exactly.  Roles are percent-encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>"
# Strings that tokenizers and chat templates treat as control.
CONTROL = (START, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_control = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_turn = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, where its escaped text starts and ends)."""
    head = f"{START}{quote(role, safe=' ')}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unquote(m[1]), unescape(m[2])) for m in _turn.finditer(formatted)]


# ---------------------------------------------------------------- layouts

@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``fields``: (path, role) pairs of one turn each, in order, for flat layouts.
    ``items``, ``role``, ``content``: the array of turns and its items' fields
    (without ``items``: the record's own, one turn).
    ``roles``: other names of roles.
    """

    name: str
    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    content: str = ""
    roles: dict = field(default_factory=dict)


NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _flat(name: str, *fields: tuple[str, str]) -> Mapping:
    return Mapping(name, tuple(f for f, _ in fields), fields=fields)


def _list(name: str, items: str, role: str, content: str, *parts: str) -> Mapping:
    return Mapping(name, (items, f"{items}[].{role}", f"{items}[].{content}", *(f"{items}[].{content}[].{p}" for p in parts)), items=items, role=role, content=content, roles=NAMES)


MAPPINGS = (
    _flat("prompt-completion", ("prompt", "user"), ("completion", "assistant")),
    _flat("prompt-response", ("prompt", "user"), ("response", "assistant")),
    _flat("system-prompt-response", ("system", "system"), ("prompt", "user"), ("response", "assistant")),
    _flat("question-answer", ("question", "user"), ("answer", "assistant")),
    _flat("instruction", ("instruction", "user"), ("output", "assistant")),
    _flat("instruction-input", ("instruction", "user"), ("input", "user"), ("output", "assistant")),
    _flat("system-instruction-input", ("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")),
    _list("messages", "messages", "role", "content"),
    _list("message-parts", "messages", "role", "content", "type", "text"),
    _list("conversations", "conversations", "from", "value"),
    _list("turns", "turns", "role", "text"),
    Mapping("turn", ("role", "text"), role="role", content="text"),
)


def fingerprint(paths) -> str:
    known = {p for m in MAPPINGS for p in m.paths}
    return hashlib.blake2b("\n".join(sorted(known.intersection(paths))).encode(), digest_size=8).hexdigest()


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def layout_of(paths: set[str]) -> Mapping | None:
    """The mapping with the paths' fingerprint.

    Where fields of several layouts meet, a record has the fingerprints of its
    projections to each layout's fields; of the layouts found by these, the one
    that needs most fields is taken (the first on ties).
    """
    found = BY_FINGERPRINT.get(fingerprint(paths))
    if found is None:
        parts = (BY_FINGERPRINT.get(fingerprint(paths.intersection(m.paths))) for m in MAPPINGS)
        found = max((p for p in parts if p is not None), key=lambda m: len(m.paths), default=None)
    return found


def value_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a JSON value; fields that are null count as absent."""
    out: set[str] = set()
    if isinstance(value, dict):
        for k, v in value.items():
            if v is not None:
                path = f"{prefix}.{k}" if prefix else k
                out |= {path} | value_paths(v, path)
    elif isinstance(value, list):
        for v in value:
            out |= value_paths(v, f"{prefix}[]")
    return out


def _content(value) -> str:
    if isinstance(value, list):
        return "".join(_content(p.get("text") if isinstance(p, dict) else p) for p in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record: dict) -> tuple[str | None, list[tuple[str, str]]]:
    """(mapping's name, turns) of a record; (None, []) if no mapping has its fingerprint."""
    m = layout_of(value_paths(record))
    if m is None:
        return None, []
    if m.fields:
        turns: list[tuple[str, str]] = []
        for path, role in m.fields:
            text = _content(record.get(path))
            if turns and turns[-1][0] == role:
                turns[-1] = (role, turns[-1][1] + "\n\n" + text if text else turns[-1][1])
            else:
                turns.append((role, text))
        return m.name, turns
    items = [x for x in record[m.items] if isinstance(x, dict)] if m.items else [record]
    role = lambda x: "" if x.get(m.role) is None else str(x[m.role])
    return m.name, [(m.roles.get(role(x), role(x)), _content(x.get(m.content))) for x in items]


# ---------------------------------------------------------------- operators

#: Characters of formatted text in one output row; longer conversations go on in further segments, cut between turns.
SEGMENT_CHARS = 1_000_000
SPANS = "array<struct<first:int,end:int>>"
_spans = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _turns(raw: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """(layout, turns) of a record as JSON; none of what isn't an object."""
    try:
        record = json.loads(raw) if raw else None
    except ValueError:
        record = None
    return canonical(record) if isinstance(record, dict) else (None, [])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        layout, text, loss = [], [], []
        for raw in b.column(b.num_columns - 1).to_pylist():
            name, turns = _turns(raw)
            out, spans, at = [], [], 0
            for role, body in turns:
                piece, first, end = format_turn(role, body)
                if role == "assistant":
                    spans.append({"first": at + first, "end": at + end})
                out.append(piece)
                at += len(piece)
            layout.append(name)
            text.append("".join(out))
            loss.append(spans)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(layout, pa.string()), pa.array(text, pa.string()), pa.array(loss, _spans)], [*b.schema.names[:-1], "layout", "formatted", "loss"])


def format_records(records: DataFrame, key: str = "id", record: str = "record") -> DataFrame:
    """``records(key, record as JSON)`` -> ``(key, layout, formatted, loss)``, a row for each row.

    Each record's layout is found by its fingerprint.  Null records, broken
    JSON and unknown layouts give a null layout and no text.  ``loss`` spans
    (code points) cover the assistant's texts.  Fields that no layout knows
    don't matter, null fields are absent; repeated rows and rows that share a
    key, or lack one, are formatted one by one.  Other columns are ignored; an
    empty table gives no rows; a record is one text, however long it is.
    """
    common.small_batches(records.sparkSession)
    source = records.select(F.col(key), F.col(record).cast("string").alias("record"))
    return source.mapInArrow(_records, f"`{key}` {source.schema[0].dataType.simpleString()}, layout string, formatted string, loss {SPANS}")


FORMATTED = f"conv_id long, segment long, n_turns long, formatted string, loss {SPANS}"


def _format_rows(assistant: str, segment_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"conv": None, "segment": 0, "out": [], "spans": [], "at": 0}
        ready: list[tuple] = []

        def cut():
            ready.append((state["conv"][0], state["segment"], len(state["out"]), "".join(state["out"]), state["spans"]))
            state.update(segment=state["segment"] + 1, out=[], spans=[], at=0)

        def rows():
            cols = list(zip(*ready, strict=True))
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), _spans), strict=True)], ["conv_id", "segment", "n_turns", "formatted", "loss"])

        for b in batches:
            for conv, raw in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                if state["conv"] != (conv,):
                    if state["out"]:
                        cut()
                    state.update(conv=(conv,), segment=0)
                for role, text in _turns(raw)[1]:
                    piece, first, end = format_turn(role, text)
                    if role == assistant:
                        state["spans"].append({"first": state["at"] + first, "end": state["at"] + end})
                    state["out"].append(piece)
                    state["at"] += len(piece)
                    if state["at"] >= segment_chars:
                        cut()
            if len(ready) >= 1000 or sum(len(r[3]) for r in ready) >= 4 * segment_chars:
                yield rows()
        if state["out"]:
            cut()
        if ready:
            yield rows()

    return run


def format_conversations(records: DataFrame, segment_chars: int = SEGMENT_CHARS, assistant: str = "assistant", order: tuple[str, ...] = ("turn", "record")) -> DataFrame:
    """Records ``(conv_id, turn, record as JSON)`` of any layouts -> formatted conversations, in segments of whole turns.

    Each record's fingerprint selects its layout, whatever those around it have;
    a record gives one turn or several.  Records without a layout give none.
    Records are in the order of ``order`` (null first); rows with a null conv_id
    make up one conversation; repeated rows are all kept.  Other columns are
    ignored; an empty table gives no rows.  Turns stream through a task in
    order, which holds one segment at a time, however long a conversation is.
    Segments of a conversation stay together, in order.
    """
    common.small_batches(records.sparkSession)
    source = records.select(F.col("conv_id").cast("long").alias("conv_id"), *[F.col(c) for c in order], *(["record"] if "record" not in order else []))
    ordered = source.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    return ordered.select("conv_id", F.col("record").cast("string").alias("record")).mapInArrow(_format_rows(assistant, segment_chars), FORMATTED)


def format_turn_rows(rows: DataFrame, segment_chars: int = SEGMENT_CHARS, assistant: str = "assistant") -> DataFrame:
    """Rows by turn ``(conv_id, turn, role, text)`` -> formatted conversations (see ``format_conversations``).

    Each row is a record of its role and text and goes by its fingerprint like
    any other.  Turns are ordered by turn (null first), ties by role and text; a
    null role or text counts as empty.
    """
    named = rows.select(F.col("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    empty = F.lit("")
    record = F.to_json(F.struct(F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")))
    return format_conversations(named.withColumn("record", record), segment_chars, assistant, ("turn", "role", "text"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, n, turns, loss_chars, loss, chars = None, 0, None, 0, None, 0
    done: list[tuple] = []

    def rows():
        cols = list(zip(*done, strict=True))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for b in batches:
        for name, segment, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "formatted", "loss")), strict=True):
            if segment == 0:
                if conv is not None:
                    done.append((conv[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                conv, n, turns, loss_chars, loss, chars = (name,), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            for role, body in parse(text):
                n += 1
                turns.update(f"{role}\n{body}\n".encode())
            for s in spans:
                body = unescape(text[s["first"] : s["end"]])
                loss_chars += len(body)
                loss.update(body.encode())
            chars += len(text)
        if len(done) >= 1000:
            yield rows()
    if conv is not None:
        done.append((conv[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
    if done:
        yield rows()


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from formatted segments as ``format_turn_rows`` leaves them."""
    return formatted.mapInArrow(_read_back, DIGEST)


def op3_schema_fingerprint_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(format_turn_rows(rows.unionByName(more)))


def chat_mixed_layouts(spark, sf_dir: str) -> DataFrame:
    """A JSON view of all conversations whose rows are in five layouts by turns, formatted together and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    name = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    message = lambda content: F.to_json(F.struct(F.array(F.struct(role.alias("role"), content.alias("content"))).alias("messages")))
    layouts = [
        F.to_json(F.struct(role.alias("role"), text.alias("text"), F.lit(1).alias("weight"))),
        message(text),
        F.to_json(F.struct(F.array(F.struct(name.alias("from"), text.alias("value"))).alias("conversations"))),
        message(F.array(F.struct(F.lit("text").alias("type"), F.substring(text, 1, 3).alias("text")), F.struct(F.lit("text").alias("type"), F.substring(text, 4, 1 << 30).alias("text")))),
        F.to_json(F.struct(text.alias("instruction"), F.lit("ok").alias("output"))),
    ]
    record = layouts[-1]
    for i, layout in enumerate(layouts[:-1]):
        record = F.when((F.col("conv_id") + F.col("turn")) % 5 == i, layout).otherwise(record)
    return read_back(format_conversations(rows.withColumn("record", record), order=("turn", "role", "text")))
