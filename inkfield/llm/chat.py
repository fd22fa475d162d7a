"""Chat formatting by schema fingerprints.

The nested field paths of a record are hashed; the fingerprint selects a declarative
mapping that says which fields give the turns. Records of many layouts (prompt and
completion, instruction and input, lists of messages, rows of one turn each) so become
canonical turns: conv_id, turn, role, text. The template marks turns with control
strings; the same strings inside a text are escaped so that reading gives the text back.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfield.llm.common import Written, arrow_map, pick

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "conv_id long, turn long, role string, text string"
LOSS_ROLES = ("assistant",)
ESCAPED = re.compile(r"<\\(\\*)\|")
ROLE_ESCAPE = re.compile(r"\\[\\n]")
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Mapping:
    """How a layout gives turns. fixed: (role, paths whose texts are joined by two line feeds);
    listed: (path of a list, field of the role, field of the text) in their order."""

    name: str
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    listed: tuple[str, str, str] | None = None


def fingerprint(paths) -> str:
    """Hash of a set of field paths; [] stands for the items of a list."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def paths_of(value, at: str = "") -> set[str]:
    """Paths of all leaves of parsed JSON. Empty lists and null have the path of their field."""
    if isinstance(value, dict):
        return set().union(*(paths_of(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths_of(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def paths_of_type(kind: T.DataType, at: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return set().union(*(paths_of_type(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind))
    if isinstance(kind, T.ArrayType):
        return paths_of_type(kind.elementType, f"{at}[]")
    return {at}


def layout(*paths: str, mapping: Mapping) -> tuple[str, Mapping]:
    return fingerprint(paths), mapping


def messages(field: str, role: str, text: str) -> tuple[str, Mapping]:
    return layout(f"{field}[].{role}", f"{field}[].{text}", mapping=Mapping(field, listed=(field, role, text)))


def question(user: tuple[str, ...], answer: str, system: str | None = None) -> tuple[str, Mapping]:
    fixed = (("system", (system,)),) if system else ()
    fixed += (("user", user), ("assistant", (answer,)))
    return layout(*user, answer, *((system,) if system else ()), mapping=Mapping("+".join(user), fixed))


LAYOUTS: dict[str, Mapping] = dict(
    (
        question(("prompt",), "completion"),
        question(("prompt",), "response"),
        question(("prompt",), "response", "system"),
        question(("question",), "answer"),
        question(("question",), "answer", "system"),
        question(("instruction",), "output"),
        question(("instruction", "input"), "output"),
        question(("instruction", "input"), "output", "system"),
        question(("instruction", "context"), "response"),
        messages("messages", "role", "content"),
        messages("messages", "role", "text"),
        messages("conversations", "from", "value"),
        messages("conversation", "role", "content"),
        messages("turns", "role", "text"),
        layout("role", "text", mapping=Mapping("turn row", listed=("", "role", "text"))),
        layout("role", "content", mapping=Mapping("turn row", listed=("", "role", "content"))),
    )
)


def canonical(record, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) of a parsed record under a mapping; a fixed turn without any text is left out."""
    if mapping.listed:
        field, role, text = mapping.listed
        items = record.get(field) or [] if field else [record]
        name = role_name if role == "from" else as_text
        return [(name(m.get(role)), as_text(m.get(text))) for m in items if m is not None]
    turns = []
    for role, paths in mapping.fixed:
        parts = [as_text(record.get(p)) for p in paths]
        if any(parts) or role == "assistant":
            turns.append((role, "\n\n".join(p for p in parts if p)))
    return turns


def role_name(role) -> str:
    return ROLE_NAMES.get(as_text(role), as_text(role))


def as_text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def json_turns(df: DataFrame, id_col: str, json_col: str, layouts: dict[str, Mapping] = LAYOUTS) -> DataFrame:
    """Canonical turns of JSON records of any known layout, told apart row by row.

    A record of an unknown layout, or that is no JSON object, gives one row with null turn,
    role and text, so that none is lost in silence. A record with an empty list of messages has no turn.
    """

    def make():
        def step(batch):
            if batch is None or not batch.num_rows:
                return
            out = {"conv_id": [], "turn": [], "role": [], "text": []}
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    record = json.loads(raw) if raw else None
                except ValueError:
                    record = None
                known = layouts.get(fingerprint(paths_of(record))) if isinstance(record, dict) else None
                empty = isinstance(record, dict) and len(record) == 1 and next(iter(record.values())) == []
                turns = canonical(record, known) if known else []
                for n, (role, text) in enumerate(turns):
                    for c, v in zip(out.values(), (key, n, role, text), strict=True):
                        c.append(v)
                if not known and not empty:
                    for c, v in zip(out.values(), (key, None, None, None), strict=True):
                        c.append(v)
            yield out

        return step

    return arrow_map(pick(df, id_col, json_col).select(F.col(id_col).cast("long"), F.col(json_col).cast("string")), make, TURNS)


def table_turns(df: DataFrame, id_col: str, turn_col: str | None = None, layouts: dict[str, Mapping] = LAYOUTS) -> DataFrame:
    """Canonical turns of a table whose schema has a known layout beside its id (and turn) columns.

    The mapping found by the schema's fingerprint becomes DataFrame expressions. Extra columns are
    tried without: the widest known layout among the table's columns counts. Null texts and roles are empty.
    """
    meant = {f.name: paths_of_type(f.dataType, f.name) for f in df.schema if f.name not in (id_col, turn_col)}
    best = None
    for mapping in layouts.values():
        fields = {mapping.listed[0]} if mapping.listed and mapping.listed[0] else set(mapping.listed[1:]) if mapping.listed else {p for _, ps in mapping.fixed for p in ps}
        if fields <= meant.keys() and fingerprint(set().union(*(meant[f] for f in fields))) in layouts and layouts[fingerprint(set().union(*(meant[f] for f in fields)))] == mapping:
            best = max(best, (len(fields), mapping.name, mapping), key=lambda x: x[:2]) if best else (len(fields), mapping.name, mapping)
    if not best:
        raise ValueError(f"no known layout among {sorted(meant)}")
    mapping, key = best[2], F.col("conv_id").cast("long").alias("conv_id")
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    named = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv]), empty(c)), empty(c))
    if mapping.listed and not mapping.listed[0]:
        role, text = mapping.listed[1:]
        rows = pick(df, id_col, *([turn_col] if turn_col else []), role, text)
        at = F.col(turn_col) if turn_col else F.lit(0)
        return rows.withColumnRenamed(id_col, "conv_id").select(key, at.cast("long").alias("turn"), empty(F.col(role)).alias("role"), empty(F.col(text)).alias("text"))
    if mapping.listed:
        field, role, text = mapping.listed
        rows = pick(df, id_col, field).withColumnRenamed(id_col, "conv_id").select("conv_id", F.posexplode(field).alias("turn", "m")).where("m is not null")
        return rows.select(key, F.col("turn").cast("long").alias("turn"), (named if role == "from" else empty)(F.col(f"m.{role}")).alias("role"), empty(F.col(f"m.{text}")).alias("text"))
    rows = pick(df, id_col, *{p for _, ps in mapping.fixed for p in ps}).withColumnRenamed(id_col, "conv_id")
    made = [F.struct(F.lit(r).alias("role"), F.array_join(F.filter(F.array(*[empty(F.col(p)) for p in ps]), lambda x: x != ""), "\n\n").alias("text")) for r, ps in mapping.fixed]
    told = rows.select("conv_id", F.posexplode(F.filter(F.array(*made), lambda m: (m["text"] != "") | (m["role"] == "assistant"))).alias("turn", "m"))
    return told.select(key, F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


def escaped(c):
    """One more backslash into every `<`, backslashes, `|`: after it no control string starts in the text."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def escaped_role(c):
    return F.replace(F.replace(escaped(c), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def unescape_role(role: str) -> str:
    return unescape(ROLE_ESCAPE.sub(lambda m: "\n" if m[0] == "\\n" else "\\", role))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_length: the turns' slices of each conversation's string.

    A conversation's string is its slices joined in the order of turn, then of the slices
    themselves, null turns first: a turn is `<|im_start|>role, line feed, text<|im_end|>,
    line feed`. Spans count code points from the slice's start; under the loss mask lie the
    texts of assistant turns, as escaped. Repeated rows are turns of their own. Null roles and texts are empty.
    """
    rows = pick(turns, "conv_id", "turn", "role", "text")
    role, text = escaped_role(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    loss = F.coalesce("role", F.lit("")).isin(*LOSS_ROLES)
    return rows.select(
        "conv_id",
        "turn",
        F.concat(head, text, F.lit(END + "\n")).alias("formatted"),
        F.when(loss, F.length(head)).cast("long").alias("loss_start"),
        F.when(loss, F.length(text)).cast("long").alias("loss_length"),
    )


SLICE = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + "\n", re.DOTALL)


def parse_slice(formatted: str) -> tuple[str, str]:
    """Role and text of a turn's slice."""
    found = SLICE.fullmatch(formatted)
    if not found:
        raise ValueError("no turn of this template")
    return unescape_role(found[1]), unescape(found[2])


def read_digest(formatted: DataFrame) -> DataFrame:
    """What the formatted slices hold, a row for each conversation.

    Slices are sorted by conversation and turn and read as a stream: a task holds the running hashes
    of one conversation and one batch of slices, however long the conversation is.
    """
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted", "loss_start", "loss_length")

    def make():
        now = None

        def told(x) -> dict:
            return {"conv_id": [x[0]], "n_turns": [x[1]], "turns_sha256": [x[2].hexdigest()], "loss_chars": [x[3]], "loss_sha256": [x[4].hexdigest()], "formatted_chars": [x[5]]}

        def step(batch):
            nonlocal now
            if batch is None:
                if now:
                    yield told(now)
                return
            for conv, text, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now:
                        yield told(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parse_slice(text)
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode())
                now[5] += len(text)
                if start is not None:
                    under = unescape(text[start : start + length])
                    now[3] += len(under)
                    now[4].update(under.encode())

        return step

    return arrow_map(dealt, make, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_digest(conversations: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Formats rows of turns, writes the slices to the shared folder and reads them back: a row for each conversation.

    Null texts and roles are empty, repeated turns count each; an empty table gives a row for the extra turns only.
    """
    turns = table_turns(conversations, "conv_id", "turn")
    written = Written(format_turns(turns.unionByName(extra) if extra is not None else turns), "chat")
    return read_digest(written.read())
