"""Chat formatting over prefix trees.

Conversations are sorted by the hashes of their messages, so those that share initial turns lie side by side. The sort
is a range partitioning by whole paths: a first turn that a third of all conversations share is spread over many
partitions. A task streams its sorted paths depth-first into packs of about PACK_TOKENS tokens. A turn that paths of the range
share is emitted once: later packs refer to it where it stands. Tokens have position ids, and every node has the intervals of
its ancestors, by pack, that its tokens may attend to (besides the earlier tokens of the node itself); intervals that touch are
one, so a conversation of any length that goes on in one pack has one. A turn is emitted again only where a range begins
within it, at most once a range. Identical conversations are one path.

Template of a turn: <|im_start|>role, line feed, text<|im_end|>, line feed. The control strings are ids of their own.
Inside roles and texts a backslash more is put between "<" and "|", and taken out when reading, so a text never spells
a control string; a role's backslashes and line feeds are doubled and named.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import byte_tokens
from .common import bounded_batches, column, stored

START, END = "<|im_start|>", "<|im_end|>"
#: A pack closes after the path that takes it past so many tokens.
PACK_TOKENS = 1 << 16
PACKS = (
    "part string, pack int, ids array<int>, positions array<int>, loss array<boolean>, "
    "nodes array<struct<first:int,last:int,parent:int,context:array<struct<pack:int,first:int,last:int>>>>, "
    "paths array<struct<path:string,node:int>>"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def turn_text(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


class _Turns:
    """Ids of a turn, with the control strings past the vocabulary's end, and back."""

    def __init__(self, tokenizer: str):
        self.tokens = byte_tokens(tokenizer)
        self.start = self.tokens.library.get_vocab_size(with_added_tokens=True)
        self.end = self.start + 1
        self.special = re.compile(f"({'|'.join(map(re.escape, self.tokens.special))})" if self.tokens.special else "(?!)")
        self.line = self._ids("\n")

    def _ids(self, text: str) -> list[int]:
        # The vocabulary's own special strings are spelt out: here they are ordinary text.
        out: list[int] = []
        for i, part in enumerate(self.special.split(text)):
            for piece in (part[:1], part[1:]) if i % 2 else (part,):
                out += np.frombuffer(next(self.tokens.encode([piece])), "<u4").tolist()
        return out

    def encode(self, role: str, text: str, loss: bool) -> tuple[list[int], list[bool]]:
        head = [self.start, *self._ids(escape_role(role) + "\n")]
        body = self._ids(escape(text))
        tail = [self.end, *self.line]
        return head + body + tail, [False] * len(head) + [loss] * len(body) + [False] * len(tail)

    def decode(self, ids: list[int]) -> str:
        return self.tokens.library.decode(ids, skip_special_tokens=False) if ids else ""


_SPAN = pa.struct([("pack", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
_PACK_SCHEMA = pa.schema([
    ("part", pa.string()), ("pack", pa.int32()), ("ids", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())),
    ("nodes", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("context", pa.list_(_SPAN))]))),
    ("paths", pa.list_(pa.struct([("path", pa.string()), ("node", pa.int32())]))),
])


class _Open:
    """A turn on the way to the last one emitted: where it stands, and the intervals up to its end."""

    __slots__ = ("message", "pack", "node", "spans", "position")

    def __init__(self, message: tuple[str, str], pack: int, node: int, spans: list[tuple[int, int, int]], position: int):
        self.message, self.pack, self.node, self.spans, self.position = message, pack, node, spans, position


def _packing(tokenizer: str, role_of_loss: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = _Turns(tokenizer)
        part, number = None, 0
        pack: dict = {}
        stack: list[_Open] = []

        def fresh() -> None:
            pack.update(part=part, pack=number, ids=[], positions=[], loss=[], nodes=[], paths=[])

        fresh()
        for batch in batches:
            for path, messages in zip(column(batch, "path").to_pylist(), column(batch, "messages").to_pylist(), strict=True):
                part = pack["part"] = part or path
                said = [(m["role"], m["text"]) for m in messages]
                common = 0
                while common < min(len(stack), len(said)) and stack[common].message == said[common]:
                    common += 1
                if said and common == len(said) and stack[common - 1].pack != number:
                    common -= 1  # a path ends in its own pack
                del stack[common:]
                for message in said[common:]:
                    above = stack[-1] if stack else None
                    spans, position = (above.spans, above.position) if above else ([], 0)
                    ids, loss = turns.encode(*message, message[0] == role_of_loss)
                    first, last = len(pack["ids"]), len(pack["ids"]) + len(ids)
                    pack["ids"] += ids
                    pack["loss"] += loss
                    pack["positions"] += range(position, position + len(ids))
                    context = [{"pack": p, "first": x, "last": y} for p, x, y in spans]
                    pack["nodes"].append({"first": first, "last": last, "parent": above.node if above and above.pack == number else -1, "context": context})
                    touching = spans and spans[-1][0] == number and spans[-1][2] == first
                    spans = [*spans[:-1], (number, spans[-1][1], last)] if touching else [*spans, (number, first, last)]
                    stack.append(_Open(message, number, len(pack["nodes"]) - 1, spans, position + len(ids)))
                pack["paths"].append({"path": path, "node": stack[-1].node if stack else -1})
                if len(pack["ids"]) >= PACK_TOKENS:
                    yield pa.RecordBatch.from_pylist([pack], _PACK_SCHEMA)
                    number += 1
                    fresh()
        if pack["paths"]:
            yield pa.RecordBatch.from_pylist([pack], _PACK_SCHEMA)

    return run


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """A row a conversation: conv_id, path (digest of its turns) and messages (role, text) by turn.

    Nulls in role or text are empty. Turns that tie are ordered by role and text. Rows that repeat are turns each. Rows
    without a conv_id are one conversation with a null id.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("m"))
    whole = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("m")), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))
    return whole.select("conv_id", F.sha2(F.to_json("messages"), 256).alias("path"), "messages")


def chat_packs(paths: DataFrame, tokenizer: str, role_of_loss: str = "assistant") -> DataFrame:
    """Packs of the distinct paths: ids, position ids and loss mask token by token, nodes with their ancestors' intervals, paths with their last node.

    part, the first path of its range, and pack, a number in it, tell packs apart. A path without a turn has node -1; an empty table has no pack.
    """
    bounded_batches(paths.sparkSession)
    distinct = paths.groupBy("path").agg(F.first("messages").alias("messages"))
    keyed = distinct.withColumn("_order", F.transform("messages", lambda m: F.xxhash64(m["role"], m["text"])))
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(parts, "_order", "path").sortWithinPartitions("_order", "path").select("path", "messages").mapInArrow(_packing(tokenizer, role_of_loss), PACKS)


def read_packs(packs: DataFrame, tokenizer: str) -> DataFrame:
    """Each path of the packs, read from ids, masks and intervals alone: path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A part's packs are read in order by one task. Of the packs before it holds the turns that lead to the last one read: no
    later pack refers to others.
    """
    bounded_batches(packs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = _Turns(tokenizer)
        held: dict[int, dict[int, tuple]] = {}  # of a pack, turns by their first token: the last one's end, and what is read
        now = None
        for batch in batches:
            tokens, masks = column(batch, "ids"), column(batch, "loss")
            for i, pack in enumerate(batch.drop_columns(["ids", "loss"]).to_pylist()):
                if pack["part"] != now:
                    held, now = {}, pack["part"]
                ids, loss = np.asarray(tokens[i].values), np.asarray(masks[i].values)
                nodes, number, rows = pack["nodes"], pack["pack"], []
                own: dict[int, tuple] = {}
                for n in nodes:
                    first, last = n["first"], n["last"]
                    some = ids[first:last]
                    role, _, text = turns.decode(some[1 : int(np.argmax(some == turns.end))].tolist()).partition("\n")
                    masked = unescape(turns.decode(some[loss[first:last].astype(bool)].tolist()))
                    own[first] = (last, (unescape_role(role), unescape(text), masked, len(START) + len(role) + 1 + len(text) + len(END) + 1))

                def said(spans: list[dict]) -> Iterator[tuple]:
                    for c in spans:
                        at, known = c["first"], own if c["pack"] == number else held[c["pack"]]  # noqa: B023
                        while at < c["last"]:
                            at, turn = known[at]
                            yield turn

                def way(node: dict) -> list[dict]:
                    return [*node["context"], {"pack": number, "first": node["first"], "last": node["last"]}]  # noqa: B023

                for p in pack["paths"]:
                    digest, learnt, n, chars, formatted = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                    for role, text, masked, size in said(way(nodes[p["node"]])) if p["node"] >= 0 else ():
                        digest.update(f"{role}\n{text}\n".encode())
                        learnt.update(masked.encode())
                        n, chars, formatted = n + 1, chars + len(masked), formatted + size
                    rows.append((p["path"], n, digest.hexdigest(), chars, learnt.hexdigest(), formatted))
                if nodes:
                    keep: dict[int, dict[int, tuple]] = {}
                    for c in way(nodes[-1]):
                        at, known = c["first"], own if c["pack"] == number else held[c["pack"]]
                        while at < c["last"]:
                            keep.setdefault(c["pack"], {})[at] = known[at]
                            at = known[at][0]
                    held = keep
                names = ["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([(c, pa.string() if c in ("path", "turns_sha256", "loss_sha256") else pa.int64()) for c in names]))

    ordered = packs.drop("positions").repartition("part").sortWithinPartitions("part", "pack")
    return ordered.mapInArrow(run, "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_chats(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """A row a conversation with what its pack, once written, gives when read back.

    Nulls in role or text are empty, rows that repeat are turns each, and turns that tie are ordered by role and text. A very long
    conversation is a row of one task, and its digests are made in time in proportion to its length. Other columns are ignored,
    whatever their names. An empty table gives an empty one.
    """
    whole = stored(conversation_paths(conversations), "chat-paths")
    packs = stored(chat_packs(whole, tokenizer), "chat-packs")
    return whole.select("conv_id", "path").join(read_packs(packs, tokenizer), "path").drop("path")
