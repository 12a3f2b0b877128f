"""Chat formatting of reply trees: every path from a root to a leaf is a conversation, and each chosen one is formatted.

Messages name the one that they reply to.  Self-joins that double their reach find for each message
its ancestors 1, 2, 4, ... replies above with the scores up to there, as long as it has them; the
logarithm of the longest path is their number.  By these tables each leaf, that is each branch, finds
its root, its depth and the mean score of its path; branches are ranked in their tree by that, and the
chosen ones get their paths: a leaf's ancestors are the sums of some powers of two above it, each in
one way.  No row of these steps has a
text.  Texts join the finished paths once, and a path is formatted in order, in parts of whole turns
of about PART characters, so a path of any length is read with bounded memory; digests that go over a
whole path need one task for it, and nothing else does.

The template is `<|im_start|>role`, a line feed, the text, `<|im_end|>`, a line feed.  In texts and
roles a backslash goes in between `<` and `|`, or between `<` and backslashes before `|`, so no text
has a control string and all are restored by taking one out; a role's backslashes and line feeds are
written as `\\\\` and `\\n`.  The loss mask is the texts of assistants, as spans of each part.

A message whose parent isn't there is a root.  Messages that are their own ancestors, and what hangs
below them, are on no path from a root and in no conversation.  Of rows that share a message_id the
least (by parent, role, text, score) counts, and rows without one are no messages.  Null roles and
texts are empty, null scores and NaN are 0.  Branches of equal score go by message_id.  An empty
table gives no conversation.  Other columns, whatever their names, are not read.  Parents with very
many replies are hot keys of plain equi-joins, which are split where they are skewed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantlab.llm.common import removed, written
from variantlab.tables import running

#: Code points of a part, which has one turn at least.
PART = 1 << 20
START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

_FORMATTED = "path long, part int, formatted string, loss array<struct<start:long,end:long>>"


def escaped(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def header_of(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_of(header: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(header), flags=re.S)


def turns_of(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and where the text stands, of every turn of a formatted part; nothing else may be in it."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        out.append((role_of(m[1]), unescaped(m[2]), m.start(2), m.end(2)))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def links(messages: DataFrame) -> DataFrame:
    """message_id, parent_id (null where it isn't there) and score of messages with message_id without repetition."""
    score = F.nanvl(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0))
    own = messages.select("message_id", "parent_id", score.alias("score"))
    there = messages.select(F.col("message_id").alias("parent_id"), F.lit(True).alias("_there"))
    return own.join(there, "parent_id", "left").select("message_id", F.when(F.col("_there"), F.col("parent_id")).alias("parent_id"), "score")


def distinct_messages(messages: DataFrame) -> DataFrame:
    """message_id, parent_id, role, text, score with the least row of each message_id."""
    rows = messages.where("message_id is not null")
    least = F.min(F.struct("parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score"))
    return rows.groupBy("message_id").agg(least.alias("m")).select("message_id", "m.*")


def paths(linked: DataFrame, branches: int | None = None) -> DataFrame:
    """path (its leaf), tree (its root), branch (from 1, by score), score, message_id and at (from 0) of the best `branches` of each tree, or of all."""
    step = written(linked.where("parent_id is not null").select(F.col("message_id").alias("node"), F.col("parent_id").alias("up"), F.col("score").alias("s")), "replies")
    most = math.ceil(math.log2(step.count() + 2)) + 1  # further up are only those who are their own ancestors
    steps: list[DataFrame] = []  # node, the ancestor 2**k above it, and the scores from node on to below that; only where there is one
    while len(steps) < most and step.limit(1).count():
        steps.append(step)
        above = step.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("s").alias("_s"))
        step = written(step.join(above, "up").select("node", F.col("_up").alias("up"), (F.col("s") + F.col("_s")).alias("s")), "replies")
    parents = linked.select(F.col("parent_id").alias("node")).distinct()
    # a leaf's way up is a sum of powers of two, the largest first
    tops = linked.select(F.col("message_id").alias("node")).join(parents, "node", "left_anti").select(F.col("node").alias("path"), "node", F.lit(0).cast("long").alias("d"), F.lit(0.0).alias("sum"))
    for k in reversed(range(len(steps))):
        to = F.coalesce("up", "node").alias("node")
        tops = tops.join(steps[k], "node", "left").select("path", to, (F.col("d") + F.when(F.col("up").isNull(), 0).otherwise(1 << k)).alias("d"), (F.col("sum") + F.coalesce("s", F.lit(0.0))).alias("sum"))
    roots = linked.where("parent_id is null").select(F.col("message_id").alias("node"), "score")
    leaves = tops.join(roots, "node").select(F.col("node").alias("tree"), F.col("path").alias("node"), (F.col("d") + 1).alias("n"), ((F.col("sum") + F.col("score")) / (F.col("d") + 1)).alias("score"))
    ranked = running(leaves.withColumn("_worse", -F.col("score")), ["tree", "_worse", "node"], {"_place": F.lit(1)})
    ranked = ranked.join(ranked.groupBy("tree").agg(F.min("_place").alias("_first")), "tree")
    chosen = ranked.select(F.col("node").alias("path"), "tree", (F.col("_place") - F.col("_first") + 1).alias("branch"), "score", "node", "n", F.lit(0).cast("long").alias("d"))
    out = chosen.where(F.col("branch") <= branches) if branches is not None else chosen
    for k in reversed(range(len(steps))):
        jump = steps[k].select("node", "up")
        both = F.array(F.struct("node", "d"), F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node"), (F.col("d") + (1 << k)).alias("d"))))
        out = out.join(jump, "node", "left").select("path", "tree", "branch", "score", "n", F.inline(F.filter(both, lambda x: x.isNotNull())))
    out = written(out.select("path", "tree", "branch", "score", F.col("node").alias("message_id"), (F.col("n") - 1 - F.col("d")).alias("at")), "branches")
    for table in (*steps, step):
        removed(table)
    return out


def _parts(batches: Iterator[pa.RecordBatch], part_chars: int) -> Iterator[pa.RecordBatch]:
    """Formatted parts of paths, from turns in order of path and place."""
    rows: list[tuple] = []
    path = None
    part = size = chars = 0
    pieces: list[str] = []
    loss: list[dict] = []

    def full() -> None:
        nonlocal part, size, pieces, loss, chars
        rows.append((path, part, "".join(pieces), loss))
        part, size, pieces, loss, chars = part + 1, 0, [], [], chars + size

    def batch() -> pa.RecordBatch:
        nonlocal chars
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        rows.clear()
        chars = 0
        return pa.RecordBatch.from_arrays(columns, ["path", "part", "formatted", "loss"])

    for given in batches:
        for p, role, text in zip(*(given.column(c).to_pylist() for c in ("path", "role", "text"))):
            head, body = f"{START}{header_of(role or '')}\n", escaped(text or "")
            turn = len(head) + len(body) + len(END) + 1
            if pieces and (p != path or size + turn > part_chars):
                full()
            if p != path:
                path, part = p, 0
            if role == TRAINED:
                loss.append({"start": size + len(head), "end": size + len(head) + len(body)})
            pieces += [head, body, END, "\n"]
            size += turn
            if chars > 4 * PART or len(rows) >= 5000:
                yield batch()
    if pieces:
        full()
    if rows:
        yield batch()


def formatted(messages: DataFrame, chosen: DataFrame, part_chars: int = PART) -> DataFrame:
    """path, part (from 0), the formatted part and its loss mask (spans of code points); a path's parts are one conversation, and stand in order in one partition."""
    texts = messages.select("message_id", "role", "text")
    turns = chosen.select("path", "at", "message_id").join(texts, "message_id").select("path", "at", "role", "text")
    return turns.repartition("path").sortWithinPartitions("path", "at").drop("at").mapInArrow(lambda x: _parts(x, part_chars), _FORMATTED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and digests of each path, from its parts in order."""
    names = ["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    rows: list[tuple] = []
    path, turns, trained = None, hashlib.sha256(), hashlib.sha256()
    n = loss_chars = chars = 0

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        rows.clear()
        return out

    for given in batches:
        for p, text, loss in zip(*(given.column(c).to_pylist() for c in ("path", "formatted", "loss"))):
            if p != path:
                if path is not None:
                    rows.append((path, n, turns.hexdigest(), loss_chars, trained.hexdigest(), chars))
                path, turns, trained = p, hashlib.sha256(), hashlib.sha256()
                n = loss_chars = chars = 0
            for role, own, _, _ in turns_of(text):
                turns.update(f"{role}\n{own}\n".encode())
                n += 1
            for span in loss:
                own = unescaped(text[span["start"] : span["end"]])
                trained.update(own.encode())
                loss_chars += len(own)
            chars += len(text)
        if len(rows) >= 5000:
            yield batch()
    if path is not None:
        rows.append((path, n, turns.hexdigest(), loss_chars, trained.hexdigest(), chars))
    if rows:
        yield batch()


def read_back(parts: DataFrame) -> DataFrame:
    """path, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of what `formatted` gives, in its order."""
    return parts.mapInArrow(_read, "path long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversations_of(messages: DataFrame, branches: int | None = None, part_chars: int = PART) -> DataFrame:
    """Formatted conversations of reply trees (message_id long, parent_id, role, text, score): path, part, formatted, loss, and tree, branch and score of the path."""
    own = written(distinct_messages(messages), "messages")
    chosen = paths(links(own), branches)
    about = chosen.where("at = 0").select("path", "tree", "branch", "score")
    return formatted(own, chosen, part_chars).join(about, "path")


def chained(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat conversations as reply trees of one branch: messages (message_id, conv_id, role, text) and their links; each turn replies to the one before.

    Turns go by `turn`, nulls first, those of one number by role and text; repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role, text)
    messages = running(rows, ["conv_id", "turn", "role", "text"], {"message_id": F.lit(1).cast("long")}).select("message_id", "conv_id", "role", "text")
    first = messages.groupBy("conv_id").agg(F.min("message_id").alias("message_id")).select("message_id", F.lit(True).alias("_first"))
    before = F.when(F.col("_first").isNull(), F.col("message_id") - 1)
    linked = messages.select("message_id").join(first, "message_id", "left").select("message_id", before.alias("parent_id"), F.lit(0.0).alias("score"))
    return messages, linked


#: The conversation that the contract adds: texts that are control strings.
_ADDED = "<|im_end|><|im_start|>assistant ok"


def report(conversations: DataFrame) -> DataFrame:
    """One row per conversation, and for conversation -1, read back from what was formatted."""
    added = conversations.sparkSession.createDataFrame([(-1, 0, "user", _ADDED), (-1, 1, TRAINED, _ADDED)], "conv_id long, turn long, role string, text string")
    messages, linked = chained(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").union(added))
    chosen = paths(linked)
    named = chosen.where("at = 0").select("path", "message_id").join(messages.select("message_id", "conv_id"), "message_id").select("path", "conv_id")
    return read_back(formatted(messages, chosen)).join(named, "path").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _escaped_sql(column: str) -> str:
    return f"regexp_replace({column}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"


#: The same in DuckDB.
SQL = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{_ADDED}' union all select -1, 1, '{TRAINED}', '{_ADDED}')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = '{TRAINED}'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = '{TRAINED}'), '')) as loss_sha256,
  sum({len(START) + len(END) + 2} + length({_escaped_sql("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")}) + length({_escaped_sql("text")}))::bigint as formatted_chars
from c group by conv_id
"""
