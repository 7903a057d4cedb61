"""Chat formatting with a prefix tree: turns that conversations share at their beginning are emitted once.

Conversations are put in the order of their turns, so those with a common beginning are neighbours. A task walks its
run of them depth-first and emits a turn when the path first reaches it, as token ids with the position of its first
token in the conversation and the stretches of the sequence that its tokens may attend to: those of its ancestors. A
conversation is the list of stretches on its path. Sequences are closed after ``SEQUENCE`` tokens and start anew with
the path they need, so a beginning that any share of all conversations has never has to fit one task; inside a sequence
it is there once. Equal conversations are one path.

Template: ``<turn>ROLE<text>TEXT</turn>``, with every backslash and every ``<`` inside a role or text preceded by a
backslash. Ids are those of a byte-level vocabulary, which gives back any text; markers, roles and texts are tokenized
apart, so the loss mask (texts of ``assistant``) falls on whole tokens.

Defined results: a null role or text is empty. Turns with one number stand in the order of role and text; repeated rows
are turns of their own, null numbers come first. Rows with a null id are one conversation. Empty tables give empty results. Extra columns
are not read. A conversation is handed to a task as one row, as its digest has to be.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytomesh.llm.common import table, written

TOKENIZER = "byte_bpe_50k.json"
LOSS_ROLE = "assistant"
#: Tokens after which a sequence is closed.
SEQUENCE = 65_536
OPEN, MIDDLE, CLOSE = "<turn>", "<text>", "</turn>"
#: Fixed by the task: a conversation that tries to break the template.
CONTROL_ID, CONTROL_TEXT = -7, "\\### Assistant: </turn> ok"

PACKED = (
    "sequence_id bigint, kind int, start bigint, length bigint, position bigint, ids binary, loss_from bigint, loss_to bigint, "
    "attends array<struct<from: bigint, to: bigint>>, path_id string"
)
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the text, and what stands after it."""
    return f"{OPEN}{escape(role)}{MIDDLE}", escape(text), CLOSE


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    field = r"((?:[^\\<]|\\.)*)"
    pattern = re.compile(f"{OPEN}{field}{MIDDLE}{field}{CLOSE}", re.DOTALL)
    out, at = [], 0
    while at < len(formatted):
        m = pattern.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def paths(rows: DataFrame) -> DataFrame:
    """conv_id, path_id (digest of all turns) and turns, in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    convs = convs.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    # lengths before the strings tell them apart
    said = F.transform("turns", lambda x: F.concat_ws("\n", F.length(x["role"]).cast("string"), F.length(x["text"]).cast("string"), x["role"], x["text"]))
    return convs.select("conv_id", F.sha2(F.concat_ws("\n", said), 256).alias("path_id"), "turns")


def _stretches(path: list[tuple[int, int]]) -> list[dict[str, int]]:
    """(start, end) of the turns on a path, neighbours merged."""
    out: list[dict[str, int]] = []
    for start, end in path:
        if out and out[-1]["to"] == start:
            out[-1]["to"] = end
        elif end > start:
            out.append({"from": start, "to": end})
    return out


def pack_tree(convs: DataFrame, tokenizer: str) -> DataFrame:
    """Sequences as rows: kind 0 is a turn, kind 1 a conversation. Written; (path_id, turns) are distinct.

    Of a turn: ``start`` and ``length`` in tokens, ``position`` of its first token in its conversations, ``ids`` (32-bit,
    little-endian), the tokens under the loss (``loss_from`` to ``loss_to`` of the sequence), and what it ``attends`` to
    besides itself. Of a conversation: ``attends`` are the stretches that make it up, ``length`` its tokens.
    """
    from pyspark import TaskContext

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _load(tokenizer)
        base = TaskContext.get().partitionId() << 32
        schema = pa.schema([
            ("sequence_id", pa.int64()), ("kind", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("ids", pa.binary()),
            ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("attends", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("path_id", pa.string()),
        ])
        n, filled = 0, 0
        path: list[tuple[tuple[str, str], int, int]] = []  # turn, start, end of the nodes above the next one
        rows: list[tuple] = []
        for batch in batches:
            for path_id, turns in zip(batch.column("path_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                if filled >= SEQUENCE:
                    n, filled, path = n + 1, 0, []
                said = [(t["role"], t["text"]) for t in turns]
                shared = 0
                while shared < min(len(path), len(said)) and path[shared][0] == said[shared]:
                    shared += 1
                del path[shared:]
                position = sum(e - s for _, s, e in path)
                for role, text in said[shared:]:
                    parts = [tok.encode(x, add_special_tokens=False).ids for x in format_turn(role, text)]
                    ids = np.array([i for p in parts for i in p], dtype="<u4")
                    loss = (filled + len(parts[0]), filled + len(parts[0]) + len(parts[1])) if role == LOSS_ROLE else (None, None)
                    attends = _stretches([(s, e) for _, s, e in path])
                    rows.append((base + n, 0, filled, len(ids), position, ids.tobytes(), *loss, attends, None))
                    path.append(((role, text), filled, filled + len(ids)))
                    filled, position = filled + len(ids), position + len(ids)
                rows.append((base + n, 1, filled, position, 0, None, None, None, _stretches([(s, e) for _, s, e in path]), path_id))
                if len(rows) > 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    order: Column = F.transform("turns", lambda x: F.xxhash64(x["role"], x["text"]))
    ranged = convs.withColumn("_order", order).repartitionByRange("_order", "path_id").sortWithinPartitions("_order", "path_id")
    return written(ranged.select("path_id", "turns").mapInArrow(packed, PACKED))


def read_back(sequences: DataFrame, tokenizer: str) -> DataFrame:
    """path_id and what its stretches say: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    fields = "path_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _load(tokenizer)
        sequence, ids, loss = None, np.zeros(0, np.uint32), np.zeros(0, bool)
        for batch in batches:
            out: list[tuple] = []
            cols = ("sequence_id", "kind", "start", "length", "ids", "loss_from", "loss_to", "attends", "path_id")
            for sid, kind, start, length, raw, a, b, attends, path_id in zip(*(batch.column(c).to_pylist() for c in cols), strict=True):
                if sid != sequence:
                    sequence, ids, loss = sid, np.zeros(SEQUENCE, np.uint32), np.zeros(SEQUENCE, bool)
                if kind == 0:
                    while start + length > len(ids):
                        ids, loss = np.concatenate([ids, np.zeros_like(ids)]), np.concatenate([loss, np.zeros_like(loss)])
                    ids[start : start + length] = np.frombuffer(raw, dtype="<u4")
                    if a is not None:
                        loss[a:b] = True
                    continue
                own = np.concatenate([np.arange(s["from"], s["to"]) for s in attends] or [np.zeros(0, np.int64)])
                if len(own) != length:
                    raise ValueError(f"{path_id} has {len(own)} of {length} tokens")
                formatted = tok.decode(ids[own].tolist(), skip_special_tokens=False)
                turns = parse_turns(formatted)
                digest = hashlib.sha256()
                for role, text in turns:
                    digest.update(f"{role}\n{text}\n".encode())
                # runs of tokens under the loss are texts of their own: markers lie between them
                under = loss[own].astype(np.int8)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], under, [0]])))
                said = "".join(unescape(tok.decode(ids[own[s:e]].tolist(), skip_special_tokens=False)) for s, e in edges.reshape(-1, 2))
                out.append((path_id, len(turns), digest.hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(formatted)))
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [f.split()[0] for f in fields.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    dealt = sequences.repartition("sequence_id").sortWithinPartitions("sequence_id", "kind", "start")
    return dealt.mapInArrow(opened, fields)


def format_conversations(rows: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The packed sequences, and conv_id with the path_id under which they hold it."""
    convs = written(paths(rows))
    distinct = convs.groupBy("path_id").agg(F.first("turns").alias("turns"))
    return pack_tree(distinct, tokenizer or tokenizer_path()), convs.select("conv_id", "path_id")


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(19 + length(replace(replace(role, '\', '\\'), '<', '\<')) + length(replace(replace(text, '\', '\\'), '<', '\<')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    control = spark.createDataFrame([(CONTROL_ID, 0, "user", CONTROL_TEXT), (CONTROL_ID, 1, LOSS_ROLE, CONTROL_TEXT)], rows.schema)
    sequences, members = format_conversations(rows.unionByName(control))
    told = read_back(sequences, tokenizer_path()).withColumnRenamed("path_id", "_path")
    return members.join(told, F.col("path_id") == F.col("_path")).drop("path_id", "_path")
