"""Chat formatting: records of many layouts become canonical turns and training text.

A record's layout is known by a fingerprint, the hash of its nested field
paths. Each fingerprint selects a declarative mapping, which says where the
turns, their roles and their texts are. The template then marks turns with
control strings and escapes such strings inside texts reversibly, one row per
turn, so a conversation of any length never has to be one row; spans of the
text give the loss mask.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import col


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``each`` is the path of a list of turns, of which ``role`` and ``text`` are
    paths within an element. Without ``each``, ``turns`` lists (role, paths); the
    texts at those paths that aren't empty are joined by a blank line, and a role
    ``@path`` is read there. ``optional`` paths may be absent.
    """

    name: str
    each: str = ""
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> set[str]:
        if self.each:
            return {f"{self.each}[].{self.role}", f"{self.each}[].{self.text}", *self.optional}
        own = {p for _, paths in self.turns for p in paths} | {r[1:] for r, _ in self.turns if r.startswith("@")}
        return own | set(self.optional)


_ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("messages", each="messages", role="role", text="content"),
    Mapping("messages with system", each="messages", role="role", text="content", turns=(("system", ("system",)),), optional=("system",)),
    Mapping("conversations", each="conversations", role="from", text="value", roles=_ALIASES),
    Mapping("dialogue", each="dialogue", role="speaker", text="utterance", roles=_ALIASES),
    Mapping("prompt and completion", turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping("instruction", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Mapping("question and answer", turns=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("turn", turns=(("@role", ("text",)),)),
    Mapping("nested turn", turns=(("@message.role", ("message.content",)),)),
    Mapping("turn parts", turns=(("@speaker.role", ("utterance.text",)),)),
)

#: Control strings of this template and of common others; texts hold them only escaped.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROLS = (TURN, BODY, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def field_paths(value: object, at: str = "") -> Iterator[str]:
    """The paths of the leaves of a JSON value; list elements share the path ``at[]``."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from field_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        for v in value:
            yield from field_paths(v, f"{at}[]")
    else:
        yield at


def fingerprint(paths: set[str]) -> str:
    """The hash of a set of nested field paths."""
    return hashlib.sha1("\n".join(sorted(paths)).encode()).hexdigest()


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    """The mapping for each fingerprint, with and without the optional paths; the first mapping of a fingerprint holds."""
    found: dict[str, Mapping] = {}
    for m in mappings:
        for n in range(len(m.optional) + 1):
            for left_out in combinations(m.optional, n):
                found.setdefault(fingerprint(m.paths() - set(left_out)), m)
    return found


def _at(value: object, path: str) -> object:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def mapped(record: object, mapping: Mapping) -> list[tuple[str, str]]:
    """The (role, text) turns of a record."""
    out = []
    for role, paths in mapping.turns:
        texts = [_at(record, p) for p in paths]
        if role == "system" and all(t is None for t in texts):
            continue
        role = _text(_at(record, role[1:])) if role.startswith("@") else role
        out.append((role, "\n\n".join(t for t in map(_text, texts) if t)))
    for turn in _at(record, mapping.each) or [] if mapping.each else []:
        out.append((_text(_at(turn, mapping.role)), _text(_at(turn, mapping.text))))
    return [(mapping.roles.get(r, r), t) for r, t in out]


def canonical_turns(records: DataFrame, key_cols: tuple[str, ...], record_col: str = "record") -> DataFrame:
    """The ``key_cols`` with ``layout, part, role, text``: a row per turn, ``part`` counting within the record.

    ``record_col`` holds JSON. A record that no mapping fits, null or not JSON gives
    one row with layout, role and text null, so nothing is lost silently; null
    roles and texts are empty; equal records each give their turns; an empty
    table gives an empty result; other columns are not read.
    """
    chosen = records.select(*[col(k) for k in key_cols], col(record_col).cast("string").alias("__record"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    known = registry()
    kind = pa.list_(pa.struct([("layout", pa.string()), ("part", pa.int32()), ("role", pa.string()), ("text", pa.string())]))

    def turns(record: str | None) -> list[dict]:
        try:
            value = json.loads(record) if record is not None else None
        except ValueError:
            value = None
        paths = set(field_paths(value)) if isinstance(value, dict) else set()
        mapping = known.get(fingerprint(paths))
        if mapping is None:
            return [{"layout": None, "part": 0, "role": None, "text": None}]
        return [{"layout": mapping.name, "part": k, "role": r, "text": t} for k, (r, t) in enumerate(mapped(value, mapping))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([turns(r) for r in batch.column(batch.num_columns - 1).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], "__turns"])

    spread = chosen.mapInArrow(run, f"{fields}, __turns array<struct<layout:string,part:int,role:string,text:string>>")
    return spread.select(*[col(k) for k in key_cols], F.inline("__turns"))


def escaped(text: Column) -> Column:
    """Backslashes doubled and one put after the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """``turns`` with ``formatted``, the turn as training text, and ``loss_start, loss_chars``, its span under the loss mask.

    The texts of role ``assistant`` are under the mask; the span counts code points
    from 0 within the turn's own formatted text. A turn without a role (a record
    that no mapping fits) has an empty formatted text. A conversation's text is
    that of its turns in order, with nothing between.
    """
    head, body = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY)), escaped(F.col("text"))
    whole = F.coalesce(F.concat(head, body, F.lit(END)), F.lit(""))
    masked = F.col("role") == "assistant"
    return turns.withColumns(
        {
            "formatted": whole,
            "loss_start": F.when(masked, F.char_length(head)).cast("long"),
            "loss_chars": F.when(masked, F.char_length(body)).cast("long"),
        }
    )


def parsed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``role, text`` as read back from ``formatted`` and ``loss_text`` from the masked span, all unescaped."""
    cut = F.locate(BODY, F.col("formatted"))
    role = F.substring("formatted", F.lit(len(TURN) + 1), cut - len(TURN) - 1)
    text = F.substring(
        "formatted", cut + len(BODY), F.char_length("formatted") - cut - len(BODY) - len(END) + 1
    )
    loss = F.substring("formatted", F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int"))
    return rows.withColumns({"role": unescaped(role), "text": unescaped(text), "loss_text": unescaped(loss)})


def conversation_digests(rows: DataFrame, conv_col: str = "conv_id", order: tuple[str, ...] = ("turn", "part")) -> DataFrame:
    """One row per conversation, from ``formatted`` turns alone.

    Digests run over a conversation's turns in order, so its rows meet in one
    task, sorted; they are hashed as they stream past and never held together.
    Turns that tie in ``order`` follow by their formatted text. Records that no
    mapping fits are counted as ``n_unmapped`` and have no turn. Rows without a
    conversation are each one of their own, with a null id.
    """
    own = parsed(rows).select(
        col(conv_col).cast("long").alias("conv_id"), *order, "role", "text", "loss_text", "formatted"
    )
    dealt = own.repartition(F.coalesce("conv_id", F.xxhash64("formatted"))).sortWithinPartitions("conv_id", *order, "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def out() -> pa.RecordBatch:
            conv, turns, loss = now[0], now[1].hexdigest(), now[2].hexdigest()
            values = [[conv], [now[3]], [turns], [now[4]], [loss], [now[5]], [now[6]]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_unmapped"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "role", "text", "loss_text", "formatted")]
            for conv, role, text, loss, whole in zip(*columns, strict=True):
                if now is None or conv is None or now[0] != conv:
                    if now is not None:
                        yield out()
                    now = [conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0]
                if not whole:
                    now[6] += 1
                    continue
                now[1].update(f"{role}\n{text}\n".encode())
                now[3] += 1
                now[5] += len(whole)
                if loss is not None:
                    now[2].update(loss.encode())
                    now[4] += len(loss)
        if now is not None:
            yield out()

    return dealt.select("conv_id", "role", "text", "loss_text", "formatted").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_unmapped long"
    )


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({len(TURN) + len(BODY) + len(END)} + length({_sql_escaped("role")}) + length({_sql_escaped("text")})) AS BIGINT) AS formatted_chars,
    CAST(0 AS BIGINT) AS n_unmapped
FROM t GROUP BY conv_id
"""


def turn_records(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, record``: each row of ``conv_id, turn, role, text`` as JSON in one of four layouts, by its conversation.

    Null roles and texts are empty.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    layouts = [
        F.to_json(F.struct(role.alias("role"), text.alias("text"))),
        F.to_json(F.struct(F.struct(role.alias("role"), text.alias("content")).alias("message"))),
        F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages"))),
        F.to_json(F.struct(F.struct(role.alias("role")).alias("speaker"), F.struct(text.alias("text")).alias("utterance"))),
    ]
    which = F.coalesce(F.pmod("conv_id", F.lit(len(layouts))), F.lit(0))
    record = layouts[0]
    for k, layout in enumerate(layouts[1:], 1):
        record = F.when(which == k, layout).otherwise(record)
    return conversations.select("conv_id", "turn", record.alias("record"))
