"""Chat formatting: nested field paths are hashed to select the mapping that turns a record into canonical turns."""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Names that roles go by in the layouts below.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: layout: (field paths, how to take turns). "each" walks a list: (list, role field, text field);
#: "fields" takes fields in order: (role, field); empty optional ones are left out.
LAYOUTS = {
    "turn_rows": (("turns[].role", "turns[].text", "turns[].turn"), ("each", "turns", "role", "text")),
    "messages": (("messages[].content", "messages[].role"), ("each", "messages", "role", "content")),
    "messages_bare": (("[].content", "[].role"), ("each", "", "role", "content")),
    "share": (("conversations[].from", "conversations[].value"), ("each", "conversations", "from", "value")),
    "instruction": (("instruction", "output"), ("fields", ("user", "instruction"), ("assistant", "output"))),
    "instruction_input": (("input", "instruction", "output"), ("fields", ("user", "instruction", "input"), ("assistant", "output"))),
    "prompt_completion": (("completion", "prompt"), ("fields", ("user", "prompt"), ("assistant", "completion"))),
    "prompt_response": (("prompt", "response"), ("fields", ("user", "prompt"), ("assistant", "response"))),
    "system_prompt_response": (("prompt", "response", "system"), ("fields", ("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "question_answer": (("answer", "question"), ("fields", ("user", "question"), ("assistant", "answer"))),
    "preference": (("chosen", "prompt", "rejected"), ("fields", ("user", "prompt"), ("assistant", "chosen"))),
}


def field_paths(value, at: str = "") -> set[str]:
    """Paths of the leaves; list items share one path. An empty list or object is a leaf itself.

    Dots, brackets and backslashes in names are escaped, so that no name reads as a path.
    """
    found, todo = set(), [(value, at)]
    while todo:
        value, at = todo.pop()
        if isinstance(value, dict) and value:
            todo += [(v, f"{at}.{name}" if at else name) for k, v in value.items() for name in (re.sub(r"([\\.\[\]])", r"\\\1", k),)]
        elif isinstance(value, list) and value:
            todo += [(v, f"{at}[]") for v in value]
        else:
            found.add(at)
    return found


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()


BY_HASH = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()}


def layout_of(paths: set[str]) -> str:
    """The layout with just these paths, else that with the most paths among those contained (extra fields are let be)."""
    if name := BY_HASH.get(fingerprint(paths)):
        return name
    inside = [(len(p), name) for name, (p, _) in LAYOUTS.items() if paths.issuperset(p)]
    return max(inside)[1] if inside else "unknown"


def _text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def canonical(record, layout: str, roles=ROLES) -> list[tuple[str, str]]:
    if layout == "unknown":
        return []
    kind, *how = LAYOUTS[layout][1]
    if kind == "each":
        name, role, text = how
        roles = {} if layout == "turn_rows" else roles  # rows of turns state canonical roles
        rows = record[name] if name else record
        return [(roles.get(_text(r.get(role)), _text(r.get(role))), _text(r.get(text))) for r in rows if isinstance(r, dict)]
    return [(role, "\n".join(x for f in fields if (x := _text(record.get(f))))) for role, *fields in how]


def escape(text: str) -> str:
    r"""After ``<`` and any backslashes before ``|`` one backslash more: no ``<|`` is left, and ``unescape`` gives text back."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans (code points) of assistants' texts that the loss counts."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{_role_out(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((_role_in(role), unescape(rest.removesuffix(END))))
    return turns


FORMATTED = pa.schema([("conv_id", pa.int64()), ("layout", pa.string()), ("schema_hash", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])


def format_records(records: DataFrame, roles=ROLES) -> DataFrame:
    """(conv_id, layout, schema_hash, turns, formatted, loss_spans) from rows of (conv_id, record: JSON text).

    Null records, texts that are no JSON, nested too deeply to be read or of no known layout, and those whose turns
    hold half a surrogate pair (no Unicode text): layout "unknown", no turns, empty text.
    Null role or text: empty. Each row is done by itself, so repeated ids stay repeated.
    """

    def work(batches):
        for b in batches:
            rows = []
            for conv_id, raw in zip(b.column("conv_id").to_pylist(), b.column("record").to_pylist(), strict=True):
                try:
                    record = json.loads(raw) if raw is not None else None
                except (ValueError, RecursionError):
                    record = None
                paths = field_paths(record) if isinstance(record, dict | list) else set()
                layout = layout_of(paths)
                try:
                    turns = canonical(record, layout, roles)
                    text, spans = render(turns)
                    text.encode()
                except (UnicodeEncodeError, RecursionError):
                    layout, turns, text, spans = "unknown", [], "", []
                rows.append({"conv_id": conv_id, "layout": layout, "schema_hash": fingerprint(paths), "turns": [{"role": r, "text": t} for r, t in turns], "formatted": text, "loss_spans": [{"begin": x, "end": y} for x, y in spans]})
                if len(rows) >= 512:
                    yield pa.RecordBatch.from_pylist(rows, FORMATTED)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, FORMATTED)

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), "record").mapInArrow(work, "conv_id long, layout string, schema_hash string, turns array<struct<role:string,text:string>>, formatted string, loss_spans array<struct<begin:int,end:int>>")


def rows_to_records(rows: DataFrame) -> DataFrame:
    """One JSON record for each conv_id of rows (conv_id, turn, role, text), in the layout that suits its turns.

    A user and an assistant: prompt and response; those behind a system turn: system, prompt and response; users and
    assistants only, otherwise: a share of "from" and "value"; with system turns among them: messages; any other
    roles, null ones among them: rows of turns. Turns are ordered by turn, then role and text (nulls first), so ties
    and repeated rows come out the same each run. Each layout gives back the same turns.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    out = rows.groupBy("conv_id").agg(turns.alias("turns")).withColumn("roles", F.transform("turns", lambda t: F.coalesce(t["role"], F.lit(""))))
    text = lambda k, name: F.get("turns", k)["text"].alias(name)
    names = lambda *xs: F.col("roles") == F.array(*[F.lit(x) for x in xs])
    only = lambda *xs: F.forall("roles", lambda r: r.isin(*xs))
    each = lambda role, value: F.transform("turns", lambda t: F.struct(role(t["role"]).alias("from" if value == "value" else "role"), t["text"].alias(value)))
    spoken = lambda r: F.when(r == "user", "human").otherwise("gpt")
    json_of = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    record = (
        F.when(names("user", "assistant"), json_of(text(F.lit(0), "prompt"), text(F.lit(1), "response")))
        .when(names("system", "user", "assistant"), json_of(text(F.lit(0), "system"), text(F.lit(1), "prompt"), text(F.lit(2), "response")))
        .when(only("user", "assistant"), json_of(each(spoken, "value").alias("conversations")))
        .when(only("user", "assistant", "system"), json_of(each(lambda r: r, "content").alias("messages")))
        .otherwise(json_of("turns"))
    )
    return out.select("conv_id", record.alias("record"))


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted texts back: turns and their digest, the text under the loss mask and its digest."""

    def work(batches):
        for b in batches:
            rows = []
            for conv_id, text, spans in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
                rows.append((conv_id, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_pylist([dict(zip(READ.names, r, strict=True)) for r in rows], READ)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
