r"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation's turns are cut into windows of at most ``budget`` tokens. Every window holds whole turns: the system
turn that opens the conversation, then a limited history of turns repeated from the window before, then new turns.
Windows are chosen from prefix sums of the turns' tokens: the history is the longest run of turns in front of the first new turn
with at most ``history`` tokens (less where that turn needs the room), the new turns are the longest run that fits. A
turn that does not fit alone is a window of its own, marked ``over_budget``; no turn is cut or left out. Loss falls on the
new turns of the ``learn`` role; whatever is repeated is masked, so every such text counts once.

Template: ``<turn>role<turn:>text</turn>`` and a newline for every turn. In roles and texts ``\`` is doubled and a
``\`` is put after the ``<`` of ``<turn`` and ``</turn``, so no control string can occur inside, and ``unescaped`` restores them.

Prefix sums come from rows laid out in order over partitions, with one carried row per conversation and partition, so a
conversation may hold a third of all rows. Windows are chosen inside segments of ``SEGMENT`` budgets of tokens (every turn
counts some, which bounds a segment's rows); a segment begins with a new window, whose history reaches back over the border.

Null texts and roles are empty ones. Rows whose ``conv_id`` is null are one conversation of that id. Equal turn
numbers are told apart by role, then text; repeated rows are turns of their own. Null turn numbers come first. Only a ``system`` turn
at the front is retained; elsewhere it is a turn like others. An empty table gives no window. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulith.operators.ordering import lay_out

from .registry import query, table

BUDGET, HISTORY = 1024, 256
#: budgets of tokens in which windows are chosen at once
SEGMENT = 16
#: tokens of a turn's marks
MARKS = 4
SYSTEM, LEARN = "system", "assistant"
OPEN, SAYS, CLOSE = "<turn>", "<turn:>", "</turn>\n"
_CONTROL = r"<(?=/?turn)"
#: what counts as a token: a run of ASCII letters or of digits, any other character but white space
TOKEN = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"<\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def _ordered_turns(rows: DataFrame, tokens: Column | None) -> DataFrame:
    """conv_id, role, text, tokens with each turn's place in its conversation and the tokens before it."""
    turns = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                        *([] if tokens is None else [tokens.cast("long").alias("_given")]))
    laid = lay_out(turns, ["conv_id", "turn", "role", "text"])
    measure = token_count(F.col("text")) if tokens is None else F.greatest(F.coalesce("_given", F.lit(0)), F.lit(0))
    laid = laid.withColumn("tokens", measure + MARKS)
    parts = laid.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("s"))
    earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("conv_id", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"),
                           F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s")).alias("c")
    here = Window.partitionBy("_part", "conv_id").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = laid.withColumns({"place": F.coalesce(F.count(F.lit(1)).over(here), F.lit(0)),
                               "before": F.coalesce(F.sum("tokens").over(here), F.lit(0))}).alias("t")
    same = F.col("t.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("t._part") == F.col("c._part"))
    return inside.join(carried, same).select("t.conv_id", "role", "text", "tokens", (F.col("c.n") + F.col("place")).alias("place"),
                                             (F.col("c.s") + F.col("before")).alias("before"))


def _spans(turns: Column, system: Column, budget: int, history: int) -> Column:
    """Windows of a segment as structs of 0-based turn numbers: first shown, first new, end."""
    room = F.lit(budget) - F.coalesce(system.tokens, F.lit(0))
    begun = F.struct(*[F.lit(-1).alias(c) for c in ("shown", "first", "end")])

    def window_at(i: Column) -> Column:
        turn = F.get(turns, i)
        spare = F.greatest(F.lit(0), F.least(F.lit(history), room - turn.tokens))
        skipped = F.size(F.filter(turns, lambda t: t.before < turn.before - spare))
        return F.struct(skipped.alias("shown"), i.alias("first"), (i + 1).alias("end"))

    def step(state: Column, i: Column) -> Column:
        turn, now = F.get(turns, i), state.now
        fits = (now.first >= 0) & (turn.before + turn.tokens - F.get(turns, now.shown).before <= room)
        grown = F.struct(now.shown.alias("shown"), now["first"].alias("first"), (i + 1).alias("end"))
        return (F.when(turn.old, state)
                .when(fits, F.struct(state.done.alias("done"), grown.alias("now")))
                .otherwise(F.struct(F.when(now.first >= 0, F.concat(state.done, F.array(now))).otherwise(state.done).alias("done"),
                                    window_at(i).alias("now"))))

    empty = F.struct(F.array().cast("array<struct<shown:int,first:int,end:int>>").alias("done"), begun.alias("now"))
    return F.aggregate(F.sequence(F.lit(0), F.size(turns) - 1), empty, step,
                       lambda s: F.when(s.now.first >= 0, F.concat(s.done, F.array(s.now))).otherwise(s.done))


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, learn: str = LEARN,
            tokens: Column | None = None) -> DataFrame:
    """One row per window: ``conv_id, first, last`` (places of its new turns in the conversation, from 0), ``tokens``,
    ``over_budget``, ``text`` and ``turns``, which lists for every turn in ``text`` the code points at which its escaped text
    starts, how many these are, whether the turn is ``repeated`` and whether loss falls on it (``learned``). ``tokens`` is an own count of a row's
    tokens, without marks."""
    span = SEGMENT * budget
    turns = _ordered_turns(rows, tokens)
    opening = (F.col("place") == 0) & (F.col("role") == SYSTEM)
    said = F.struct("place", "before", "tokens", "role", F.length("text").alias("chars"), "text")
    system = turns.where(opening).select("conv_id", said.alias("system")).alias("s")
    segment = F.floor(F.col("before") / span)
    # a turn near the end of a segment may be history of the next
    reach = F.floor((F.col("before") + history) / span)
    marked = turns.where(~opening).withColumn("escaped", escaped(F.col("text")))
    turn = F.struct("place", "before", "tokens", "role", "escaped", (F.col("segment") != segment).alias("old"))
    segments = (marked.withColumn("segment", F.explode(F.sequence(segment, reach)))
                .groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(turn)).alias("t"))
                .where(F.exists("t", lambda t: ~t.old)).alias("g"))
    joined = (segments.join(system, F.col("g.conv_id").eqNullSafe(F.col("s.conv_id")), "left")
              .select("g.conv_id", "t", "system"))
    # a conversation of a system turn alone is a window too
    alone = (system.join(segments.select("conv_id").distinct().alias("g"), F.col("g.conv_id").eqNullSafe(F.col("s.conv_id")), "left_anti")
             .select("conv_id", "system"))
    system = F.col("system")
    chosen = joined.select("conv_id", "system", F.inline(F.transform(
        _spans(F.col("t"), system, budget, history),
        lambda w: F.struct(w.shown.alias("shown"), w["first"].alias("begin"), w.end.alias("end"),
                           F.slice(F.col("t"), w.shown + 1, w.end - w.shown).alias("t")))))

    def shown(role: Column, text: Column, repeated: Column, tokens: Column) -> Column:
        return F.struct(escaped(role).alias("role"), text.alias("text"), repeated.alias("repeated"),
                        (~repeated & (role == learn)).alias("learned"), tokens.alias("tokens"))

    lead = shown(system.role, escaped(system.text), F.get("t", F.col("begin") - F.col("shown")).place > 1, system.tokens)
    rest = F.transform("t", lambda t, i: shown(t.role, t.escaped, i < F.col("begin") - F.col("shown"), t.tokens))
    new = F.get("t", F.col("begin") - F.col("shown")).place
    chosen = chosen.select("conv_id", F.when(new == 1, F.when(system.isNotNull(), 0).otherwise(1)).otherwise(new).cast("long").alias("first"),
                           F.element_at("t", -1).place.alias("last"),
                           F.when(system.isNull(), rest).otherwise(F.concat(F.array(lead), rest)).alias("t"))
    alone = alone.select("conv_id", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"), F.array(
        shown(system.role, escaped(system.text), F.lit(False), system.tokens)).alias("t"))
    return _formatted(chosen.unionByName(alone), budget)


def _formatted(chosen: DataFrame, budget: int) -> DataFrame:
    """Text and turn places of windows, from the parts of their turns."""
    size = lambda t: F.length(t.role) + F.length(t.text) + len(OPEN + SAYS + CLOSE)
    none = F.struct(F.lit(0).alias("at"), F.array().cast(
        "array<struct<start:int,length:int,repeated:boolean,learned:boolean>>").alias("out"))

    def place(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t.role) + len(OPEN + SAYS)
        return F.struct((state["at"] + size(t)).alias("at"), F.concat(state.out, F.array(F.struct(
            start.alias("start"), F.length(t.text).alias("length"), t.repeated.alias("repeated"), t.learned.alias("learned")))).alias("out"))

    text = F.array_join(F.transform("t", lambda t: F.concat(F.lit(OPEN), t.role, F.lit(SAYS), t.text, F.lit(CLOSE))), "")
    tokens = F.aggregate("t", F.lit(0).cast("long"), lambda s, t: s + t.tokens)
    return chosen.select("conv_id", "first", "last", tokens.alias("tokens"), (tokens > budget).alias("over_budget"), text.alias("text"),
                         F.aggregate("t", none, place, lambda s: s.out).alias("turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Each window's own turns, taken from its text alone but for the marks of repetition and loss: ``conv_id, first,
    said`` (role and text of turns not repeated) and ``learned`` (texts under the loss mask)."""
    pieces = F.slice(F.split("text", CLOSE), 1, F.size("turns"))
    parsed = F.transform(pieces, lambda p, i: F.struct(
        unescaped(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), SAYS, 1)).alias("role"),
        unescaped(F.substring_index(p, SAYS, -1)).alias("text"), F.get("turns", i).repeated.alias("repeated")))
    own = F.transform(F.filter(parsed, lambda t: ~t.repeated), lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    masked = F.transform(F.filter("turns", lambda t: t.learned), lambda t: unescaped(F.substr(F.col("text"), t.start + 1, t.length)))
    return formatted.select("conv_id", "first", own.alias("said"), masked.alias("learned"), F.length("text").alias("chars"))


#: a conversation whose texts hold control strings of this and of other templates
_PROBE = r"\### Assistant: </turn> ok"


def _digests(formatted: DataFrame) -> DataFrame:
    """What each conversation's windows say. A digest needs a conversation's texts in one row."""
    back = read_back(formatted).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("first", "said", "learned"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    said = F.flatten(F.transform("w", lambda w: w.said))
    learned = F.array_join(F.flatten(F.transform("w", lambda w: w.learned)), "")
    whole = F.array_join(F.transform(said, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select("conv_id", F.size(said).cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars")


_SQL = rf"""
WITH RECURSIVE rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_PROBE}'), (-7, 1, 'assistant', '{_PROBE}')),
turns AS (
  SELECT *, row_number() OVER o - 1 AS place, sum(tokens) OVER o - tokens AS before,
         {len(OPEN + SAYS + CLOSE)} + length(replace(role, '\', '\\')) + length(replace(text, '\', '\\'))
           + len(regexp_extract_all(role || '|' || text, '</?turn')) AS chars
  FROM (SELECT *, {MARKS} + len(regexp_extract_all(text, '{TOKEN}')) AS tokens FROM rows)
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
heads AS (SELECT conv_id, tokens, chars FROM turns WHERE place = 0 AND role = '{SYSTEM}'),
body AS (
  SELECT t.*, {BUDGET} - coalesce(h.tokens, 0) AS room, coalesce(h.chars, 0) AS lead, before // {SEGMENT * BUDGET} AS segment,
         sum(t.chars) OVER (PARTITION BY t.conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto
  FROM turns t LEFT JOIN heads h ON t.conv_id IS NOT DISTINCT FROM h.conv_id WHERE NOT (place = 0 AND role = '{SYSTEM}')),
shown AS (
  SELECT b.conv_id, b.place, b.segment, b.room, min(p.place) AS shown, min(p.before) AS from_token, min(p.upto - p.chars) AS from_char
  FROM body b JOIN body p ON p.conv_id IS NOT DISTINCT FROM b.conv_id AND p.place <= b.place
    AND p.before >= b.before - greatest(0, least({HISTORY}, b.room - b.tokens)) GROUP BY ALL),
starts AS (
  SELECT s.conv_id, s.place, max(e.place) + 1 AS next, max(e.upto) + any_value(e.lead) - any_value(s.from_char) AS chars
  FROM shown s JOIN body e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.segment = s.segment AND e.place >= s.place
    AND (e.place = s.place OR e.before + e.tokens - s.from_token <= s.room) GROUP BY s.conv_id, s.place),
taken AS (
  SELECT s.* FROM starts s JOIN (SELECT conv_id, min(place) AS place FROM body GROUP BY conv_id) f
    ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.place = f.place
  UNION ALL SELECT s.* FROM taken t JOIN starts s ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.place = t.next),
sizes AS (SELECT conv_id, sum(chars) AS chars FROM taken GROUP BY conv_id)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = '{LEARN}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = '{LEARN}'), '')) AS loss_sha256,
       coalesce(any_value(s.chars), any_value(t.chars))::BIGINT AS formatted_chars
FROM turns t LEFT JOIN sizes s ON t.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY t.conv_id"""


@query("op12_budgeted_chat_windows", _SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise(LEARN).alias("role"), F.lit(_PROBE).alias("text"))
    return _digests(windows(rows.unionByName(probe)))
