"""Chat formatting by incremental rendering of a template that is only called, never looked into.

For each turn the template renders the turns up to it. Consecutive outputs show where the turn
went and whether the template rewrote what it had rendered before; two probes of one character
in the turn's place show where its text lies between the marks around it.

Every prefix is rendered and compared, however long the conversation; its cost grows with the square
of a conversation's length. Prefixes don't need each other: a conversation of more than PART turns is dealt to
several tasks, each of which has the turns up to the end of a part and renders the prefixes of its own part's turns. A caller who knows that a template looks no further back than some turns
may give that number as `window`: later turns are then rendered behind so many only, and the joined
output is compared with the whole where turns have doubled and at the end. What a template does to
older turns in between, and undoes, is not seen then.

Cases: null texts and roles are empty; turns of equal number follow by role, then text; null turns
come first; rows with a null conv_id form one conversation; repeated rows are turns of their own;
an empty table gives no conversations; columns of other names are not read. A conversation that
the template rewrites is flagged, and has no spans and no loss. A task holds the turns of one conversation at
a time, as its output is one string.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import materialise

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]
Span = tuple[int, int, int]

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[END]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_MARK = re.compile(r"<s>(\[INST\]) |\[ROLE\](.*?)\[/ROLE\] | ", re.DOTALL)
#: Turns of a long conversation that one task renders the prefixes of.
PART = 256
#: Turns of which the default template remembers the rendering.
REMEMBERED = 1 << 14
#: Characters of output to hold before a batch is sent on.
FLUSH = 1 << 23


def escape(text: str) -> str:
    """Break control strings with a backslash behind their first character; backslashes are doubled."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@lru_cache(REMEMBERED)
def _instruct_turn(turn: Turn) -> str:
    role, text = turn
    marks = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
    before, after = marks.get(role, (f"[ROLE]{escape(role)}[/ROLE] ", " [END]"))
    return f"{before}{escape(text)}{after}"


def instruct(turns: list[Turn]) -> str:
    """The default template."""
    return "".join(map(_instruct_turn, turns))


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _step(render: Render, before: str, turns: list[Turn], role: str, text: str, safe: int) -> tuple[str, Span] | None:
    """Render one turn more: the output, and where the turn, its text and its text's end are; None if anything before `safe` changed."""
    now = render([*turns, (role, text)])
    start = len(before) if now.startswith(before) else common_prefix(before, now)
    one, two = render([*turns, (role, "x")]), render([*turns, (role, "y")])
    at = common_prefix(one, two)
    tail = one[at + 1 :]
    end = len(now) - len(tail)
    if start < safe or one[at : at + 1] != "x" or tail != two[at + 1 :] or end < at or now[:at] != one[:at] or now[end:] != tail:
        return None
    return now, (min(start, at), at, end)


def _locate_far(render: Render, turns: list[Turn], now: str, spans: list[Span], window: int) -> tuple[str, list[Span]] | None:
    """Go on from the first turns, rendering each further one behind the last `window` only; None if the template looks further back."""
    spans, parts, size = list(spans), [now], len(now)
    for k in range(len(spans), len(turns)):
        context = turns[k - window : k]
        before = render(context)
        found = _step(render, before, context, *turns[k], len(before))
        if not found:
            return None
        after, span = found
        spans.append(tuple(size + x - len(before) for x in span))
        parts.append(after[len(before) :])
        size += len(parts[-1])
        if k + 1 == len(turns) or (k + 1) & k == 0:
            parts = ["".join(parts)]
            if parts[0] != render(turns[: k + 1]):
                return None
    return parts[0], spans


def locate(render: Render, turns: list[Turn], window: int | None = None, first: int = 0) -> tuple[str, list[Span] | None]:
    """The output, and for each turn from the first one on (start, text start, text end) in it; None if history was rewritten."""
    spans: list[Span] = []
    now, safe = render(turns[:first]), 0
    if first:  # where the turn before ends, nothing may change
        found = _step(render, render(turns[: first - 1]), turns[: first - 1], *turns[first - 1], 0)
        if not found:
            return render(turns), None
        safe = found[1][2]
    for k, turn in enumerate(turns[first:], first):
        if k == window and (far := _locate_far(render, turns, now, spans, window)):
            return far
        found = _step(render, now, turns[:k], *turn, safe)
        if not found:
            return render(turns), None
        now, span = found
        safe = span[2]
        spans.append(span)
    return now, spans


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], list[Turn]]]:
    """Turns in order of conversation and part, to those of each; one may go on in the next batch."""
    key, turns = None, []
    for batch in batches:
        for conv, part, role, text in zip(batch["conv"], batch["part"], batch["role"], batch["text"], strict=True):
            if key is not None and (conv, part) != key:
                yield key, turns
                turns = []
            key = conv, part
            turns.append((role, text))
    if key is not None:
        yield key, turns


SPANS = "spans array<struct<start: int, text_start: int, text_end: int, loss: boolean>>"


def format_conversations(conversations: DataFrame, render: Render = instruct, loss_role: str = "assistant", window: int | None = None) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, formatted, spans, rewritten).

    spans has start, text_start, text_end (code points) and loss for each turn in order.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        columns = ["conv", "part", "formatted", "spans", "rewritten"]
        for (conv, part), turns in _conversations(batches):
            first = max(0, part) * PART
            out, spans = locate(render, turns, window, first)
            marked = [{"start": s, "text_start": a, "text_end": b, "loss": role == loss_role} for (s, a, b), (role, _) in zip(spans or [], turns[first:], strict=False)]
            rows.append((conv, part, out, marked, spans is None))
            held += len(out)
            if held > FLUSH:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns)

    key, text = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.coalesce("text", F.lit("")).alias("text")
    turns = conversations.select(key, "turn", F.coalesce("role", F.lit("")).alias("role"), text)
    rows = turns.withColumn("part", F.lit(-1))
    many = None
    if window is None:
        many = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART)
        many = materialise(many.select("conv", F.floor((F.col("n") - 1) / PART).cast("int").alias("last")), "chat-long")
    if many is not None and not many.isEmpty():
        short = rows.join(many, "conv", "left_anti")
        number = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")) - 1
        long = turns.join(many, "conv").withColumn("own", F.floor(number / PART).cast("int"))
        rows = short.union(long.select("conv", "turn", "role", "text", F.explode(F.sequence("own", "last")).alias("part")))
    else:
        many = None
    ordered = rows.repartition("conv", "part").sortWithinPartitions("conv", "part", "turn", "role", "text")
    found = ordered.mapInPandas(run, f"conv string, part int, formatted string, {SPANS}, rewritten boolean")
    if many is not None:
        found = materialise(found, "chat-parts")
        whole = found.where("part >= 0").groupBy("conv").agg(
            F.max_by("formatted", "part").alias("formatted"),  # the last part renders the whole
            F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "spans"))), lambda p: p["spans"])).alias("spans"),
            F.max("rewritten").alias("rewritten"),
        )
        whole = whole.withColumn("spans", F.when(F.col("rewritten"), F.array().cast(found.schema["spans"].dataType)).otherwise(F.col("spans")))
        found = found.where("part < 0").select("conv", "formatted", "spans", "rewritten").union(whole)
    conv_id = F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id")
    return found.select(conv_id, "formatted", "spans", "rewritten")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the default template's outputs, from their strings and spans alone."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch["formatted"], batch["spans"], strict=True):
                turns, loss = sha256(), []
                for s in spans:
                    mark = _MARK.fullmatch(text[s["start"] : s["text_start"]])
                    role = "user" if mark[1] else "assistant" if mark[2] is None else unescape(mark[2])
                    said = unescape(text[s["text_start"] : s["text_end"]])
                    turns.update(f"{role}\n{said}\n".encode())
                    loss += [said] * bool(s["loss"])
                joined = "".join(loss)
                rows.append((len(spans), turns.hexdigest(), len(joined), sha256(joined.encode()).hexdigest(), len(text)))
            columns = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pd.concat([batch[["conv_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=columns)], axis=1)

    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "spans").mapInPandas(run, out)


#: What the planted conversation -7 says, as its user and as its assistant.
PLANTED = "</s>[INST] ok [/INST]"


def op1_chat(spark, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(planted)))


def _op1_sql() -> str:
    def escaped(column: str) -> str:
        sql = f"replace({column}, chr(92), repeat(chr(92), 2))"
        for c in CONTROL:  # no two control strings overlap, so they may be replaced one after the other
            sql = f"replace({sql}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
        return sql

    return f"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{PLANTED}'), (-7, 1, 'assistant', '{PLANTED}')
), shown AS (
    SELECT *, CASE role WHEN 'user' THEN '<s>[INST] ' || {escaped("text")} || ' [/INST]' WHEN 'assistant' THEN ' ' || {escaped("text")} || ' </s>'
              ELSE '[ROLE]' || {escaped("role")} || '[/ROLE] ' || {escaped("text")} || ' [END]' END AS marked
    FROM said
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(marked))::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""


OP1_SQL = _op1_sql()
