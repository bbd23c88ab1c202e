"""Preference formatting of paired conversations.

A chosen and a rejected conversation share their longest common prefix of turns, equal in role and text. It is
rendered once, as the prompt; what follows in each is rendered as a completion with the character spans in it that
a trainer learns from: the texts of assistant turns. Everything is built from windows, joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.scratch import Scratch

#: Rendering of a turn: opening with the role, the text, the closing.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"
TRAINED_ROLE = "assistant"


def numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id, place, role, text``: turns numbered from 1 by turn, then role, then text; nulls first, null text and role empty."""
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return rows.where("conv_id is not null").select("conv_id", place.alias("place"), "role", "text")


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def _joined(parts: Column) -> Column:
    """Concatenation of the texts of ``(place, text)`` pairs in order of place."""
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["text"]), "")


def preference_pairs(turns: DataFrame, pairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Render each pair of ``pairs (chosen_id, rejected_id)`` whose conversations both exist.

    ``chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans``: spans are
    ``start:end`` character offsets within the completion, joined by blanks, of the texts of assistant turns.

    Null roles and texts count as empty; turns that tie or repeat are ordered by role and text and all kept;
    rows without conv_id belong to no conversation. If one conversation is a prefix of the other (or equal), its
    completion is empty, without spans. Repeated pairs give one row. Empty tables give no rows. A pair's turns
    meet in one row, since its texts are the result, very long ones too; no other group is gathered. Other columns
    are ignored, whatever their names.
    """
    own = numbered(turns, conv_col, turn_col, role_col, text_col)
    wanted = pairs.select(F.col("chosen_id").cast("long"), F.col("rejected_id").cast("long")).distinct()
    side = lambda name: own.select(F.col("conv_id").alias(f"{name}_id"), "place", F.col("role").alias(f"{name[0]}_role"), F.col("text").alias(f"{name[0]}_text"))
    key = ["chosen_id", "rejected_id"]
    chosen = wanted.join(side("chosen"), "chosen_id")
    rejected = wanted.join(side("rejected"), "rejected_id")
    return _formatted(chosen.join(rejected, [*key, "place"], "full_outer"))


def _formatted(both: DataFrame) -> DataFrame:
    """Rows of pairs from their turns ``chosen_id, rejected_id, place, c_role, c_text, r_role, r_text``, null where a side has no turn."""
    key = ["chosen_id", "rejected_id"]
    both = both.withColumn("differs", ~(F.col("c_role").eqNullSafe(F.col("r_role")) & F.col("c_text").eqNullSafe(F.col("r_text"))))
    up_to_here = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("common", ~F.max("differs").over(up_to_here))
    before = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    for s in "cr":
        made = F.when(F.col(f"{s}_role").isNotNull(), _rendered(F.col(f"{s}_role"), F.col(f"{s}_text")))
        both = both.withColumn(f"{s}_made", made)
        start = F.coalesce(F.sum(F.when(~F.col("common"), F.length(f"{s}_made"))).over(before), F.lit(0)) + len(OPEN + MIDDLE) + F.length(f"{s}_role")
        span = F.concat(start.cast("string"), F.lit(":"), (start + F.length(f"{s}_text")).cast("string"))
        both = both.withColumn(f"{s}_span", F.when(~F.col("common") & (F.col(f"{s}_role") == TRAINED_ROLE), span))

    def gathered(text: str, where: Column) -> Column:
        return F.collect_list(F.when(where & F.col(text).isNotNull(), F.struct("place", F.col(text).alias("text"))))

    rows = both.groupBy(*key).agg(
        F.count_if("common").alias("prompt_turns"), F.count("c_role").alias("cn"), F.count("r_role").alias("rn"),
        _joined(gathered("c_made", F.col("common"))).alias("prompt"),
        _joined(gathered("c_made", ~F.col("common"))).alias("chosen"),
        _joined(gathered("r_made", ~F.col("common"))).alias("rejected"),
        F.array_join(F.transform(F.array_sort(gathered("c_span", ~F.col("common"))), lambda x: x["text"]), " ").alias("chosen_spans"),
        F.array_join(F.transform(F.array_sort(gathered("r_span", ~F.col("common"))), lambda x: x["text"]), " ").alias("rejected_spans"),
    )
    return rows.where("cn > 0 and rn > 0").drop("cn", "rn")


def neighbouring_pairs(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Pairs of an even conversation, chosen, and the next odd one, rejected."""
    ids = turns.select(F.col(conv_col).cast("long").alias("conv_id")).where("conv_id is not null")
    return ids.select((F.floor(F.col("conv_id") / 2) * 2).alias("chosen_id"), (F.floor(F.col("conv_id") / 2) * 2 + 1).alias("rejected_id")).distinct()


def answer_preferences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each conversation, chosen, against itself with another conversation's last answer in place of its own, rejected.

    Columns as of :func:`preference_pairs`; the prompt is all turns before the last assistant turn. Different last
    answers form a ring by SHA-256; a conversation takes the next one, and ``rejected_id`` is the smallest
    conversation that gave it. Conversations without an assistant turn give no row, nor do any if all end in one and
    the same answer. Null answers count as empty, turns that tie go by role and text, repeated turns are turns of
    their own, very long answers are swapped whole, an empty table gives no rows, and other columns are ignored,
    whatever their names. The ring is linked within buckets of the digest and over the firsts of the buckets; turns
    are shuffled by conversation alone.
    """
    scratch = Scratch(turns.sparkSession, "answers")
    own = numbered(turns, conv_col, turn_col, role_col, text_col)
    last = F.max(F.when(F.col("role") == TRAINED_ROLE, F.struct("place", "text")))
    answers = own.groupBy("conv_id").agg(last.alias("last")).where("last is not null").select("conv_id", F.col("last.place").alias("at"), F.col("last.text").alias("answer"))
    answers = scratch.save(answers.withColumn("sha", F.unhex(F.sha2(F.col("answer").cast("binary"), 256))), "own")
    texts = scratch.save(answers.groupBy("sha").agg(F.min_by("answer", "conv_id").alias("other"), F.min("conv_id").alias("rejected_id")), "texts")
    bucketed = texts.select("sha", F.substring(F.hex("sha"), 1, 3).alias("bucket"))
    firsts = bucketed.groupBy("bucket").agg(F.min("sha").alias("head"))
    ring = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = F.coalesce(F.lead("head").over(Window.orderBy("bucket")), F.first("head").over(ring))
    firsts = F.broadcast(firsts.select("bucket", follows.alias("after")))
    following = F.coalesce(F.lead("sha").over(Window.partitionBy("bucket").orderBy("sha")), F.col("after"))
    linked = bucketed.join(firsts, "bucket").select(F.col("sha").alias("of"), following.alias("sha")).where("of <> sha")
    linked = scratch.save(linked.join(texts, "sha").select(F.col("of").alias("sha"), "rejected_id", "other"), "linked")
    found = scratch.save(answers.join(linked, "sha").select("conv_id", "at", "rejected_id", "other"), "pairs")
    text = F.when(F.col("place") == F.col("at"), F.col("other")).otherwise(F.col("text"))
    both = own.join(found, "conv_id").select(
        F.col("conv_id").alias("chosen_id"), "rejected_id", "place", F.col("role").alias("c_role"), F.col("text").alias("c_text"), F.col("role").alias("r_role"), text.alias("r_text")
    )
    return _formatted(both)


ANSWER_ORACLE = r"""
with n as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place,
    coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
a as (select conv_id, max(place) as final, arg_max(text, place) as answer from n where role = 'assistant' group by conv_id),
t as (select answer, min(conv_id) as donor from a group by answer),
u as (
  select answer, coalesce(lead(answer) over w, first_value(answer) over w) as other, coalesce(lead(donor) over w, first_value(donor) over w) as rejected_id
  from t window w as (order by sha256(answer))),
m as (
  select n.conv_id, rejected_id, place, final, a.answer, other, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) as made,
    '<|' || role || '|>' || chr(10) || case when place = final then other else text end || chr(10) || '<|end|>' || chr(10) as replaced
  from n join a using (conv_id) join u on a.answer = u.answer where other <> a.answer)
select conv_id as chosen_id, rejected_id, final - 1 as prompt_turns,
  coalesce(string_agg(made, '' order by place) filter (where place < final), '') as prompt,
  string_agg(made, '' order by place) filter (where place >= final) as chosen,
  string_agg(replaced, '' order by place) filter (where place >= final) as rejected,
  '14:' || cast(14 + length(any_value(answer)) as varchar) as chosen_spans,
  '14:' || cast(14 + length(any_value(other)) as varchar) as rejected_spans
from m group by conv_id, rejected_id, final
"""

ORACLE = r"""
with n as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place,
    coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
m as (select *, conv_id - conv_id % 2 as chosen_id, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) as made from n),
b as (
  select coalesce(c.chosen_id, r.chosen_id) as chosen_id, coalesce(c.place, r.place) as place, c.role as c_role, c.text as c_text, c.made as c_made,
    r.role as r_role, r.text as r_text, r.made as r_made,
    (c.role is not distinct from r.role and c.text is not distinct from r.text) as same
  from (select * from m where conv_id % 2 = 0) c full join (select * from m where conv_id % 2 = 1) r on c.chosen_id = r.chosen_id and c.place = r.place),
k as (select *, bool_and(same) over (partition by chosen_id order by place rows between unbounded preceding and current row) as common from b),
s as (
  select *,
    coalesce(sum(case when not common then length(c_made) end) over w, 0) + 5 + length(c_role) as c_start,
    coalesce(sum(case when not common then length(r_made) end) over w, 0) + 5 + length(r_role) as r_start
  from k window w as (partition by chosen_id order by place rows between unbounded preceding and 1 preceding))
select chosen_id, chosen_id + 1 as rejected_id, count(*) filter (where common) as prompt_turns,
  coalesce(string_agg(c_made, '' order by place) filter (where common), '') as prompt,
  coalesce(string_agg(c_made, '' order by place) filter (where not common), '') as chosen,
  coalesce(string_agg(r_made, '' order by place) filter (where not common), '') as rejected,
  coalesce(string_agg(cast(c_start as bigint) || ':' || cast(c_start + length(c_text) as bigint), ' ' order by place) filter (where not common and c_role = 'assistant'), '') as chosen_spans,
  coalesce(string_agg(cast(r_start as bigint) || ':' || cast(r_start + length(r_text) as bigint), ' ' order by place) filter (where not common and r_role = 'assistant'), '') as rejected_spans
from s group by chosen_id having count(c_role) > 0 and count(r_role) > 0
"""
