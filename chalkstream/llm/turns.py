"""Recorded speech into clean, ordered turns of one speaker each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkstream.functions.text import plain_spaces, seconds
from chalkstream.llm.conversations import BLOCK_BITS, clean_role
from chalkstream.session import cut

KINDS = ("stamp", "sound", "label", "filler")

_CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
#: A clock in brackets, a range of clocks, a marked offset; bare clocks only where a line begins or ends with them.
STAMP = "|".join(
    [
        r"\d{1,3}:\d{2}:\d{2}[.,]\d{1,3}\s*-{1,2}>\s*\d{1,3}:\d{2}:\d{2}[.,]\d{1,3}",
        rf"\[\s*{_CLOCK}\s*\]",
        rf"<\s*{_CLOCK}\s*>",
        r"(?:(?m)^[ \t]*|(?<=\s))\(\s*\d{1,2}:\d{2}(?::\d{2})?\s*\)(?=\s|$)",
        r"\[(?:\d{1,3}h)?\d{1,3}m\d{1,2}(?:\.\d+)?s\]",
        r"\{t=\d+(?:\.\d+)?s?\}",
        r"(?<![\w.])@\d{1,3}:\d{2}(?::\d{2})?(?![\w:])",
        r"(?:(?m)^)[ \t]*\d{1,2}:\d{2}(?::\d{2})?[ \t]+-(?=\s|$)",
        r"(?:(?m)^)[ \t]*\d{1,2}:\d{2}:\d{2}(?=\s|$)",
        r"(?<=[\w.?!,;\])>}*~♪][ \t])\d{2}:\d{2}:\d{2}[ \t]*(?:(?m)$)",
    ]
)
#: What a note of a sound may say, with what may stand before it.
_SOUNDS = (
    r"(?:(?:soft|softly|loud|loudly|heavy|quiet|nervous|light|both|all|children|child|student|tutor|people|background|distant|faint)\s+)?"
    r"(?:laugh(?:s|ing|ter)?|giggl(?:es|ing|e)|chuckl(?:es|ing|e)|snigger(?:s|ing)?|cough(?:s|ing)?|sneez(?:es|ing|e)|sniff(?:s|ing|les)?|sigh(?:s|ing)?|yawn(?:s|ing)?|gasp(?:s|ing)?|groan(?:s|ing)?|hums?|humming|whistl(?:es|ing)|whisper(?:s|ing)?|breath(?:es|ing)?|sobs?|sobbing|cr(?:ies|ying)|cheer(?:s|ing)?|clap(?:s|ping)?|shout(?:s|ing)?|scream(?:s|ing)?|applause"
    r"|clears?\s+(?:his\s+|her\s+|their\s+)?throat|clearing\s+throat|throat\s+clearing|(?:bell|phone|telephone|alarm)\s*(?:rings?|ringing)?|doorbell|door\s+(?:slams?|slamming|opens?|closes?|creaks?|knocks?)|knock(?:s|ing)?|chairs?\s+(?:scrap(?:es?|ing)|squeak(?:s|ing)?)|papers?\s+(?:rustl(?:es?|ing)|shuffl(?:es?|ing))|rustling|keyboard(?:\s+(?:clicks?|clicking|typing))?|typing|music(?:\s+playing)?|static|buzz(?:es|ing)?|beep(?:s|ing)?|noises?|crosstalk|silence|dogs?\s+bark(?:s|ing)?|barking|(?:baby|children)\s+(?:cry(?:ing)?|cries|shouting|playing)|footsteps|traffic(?:\s+noise)?|siren|wind)"
)
SOUND = "(?i)" + "|".join(
    [rf"\(\(\s*{_SOUNDS}\s*\)\)", rf"\[\s*{_SOUNDS}\s*\]", rf"[({{<]\s*{_SOUNDS}\s*[)}}>]", rf"\*{{1,2}}\s*{_SOUNDS}\s*\*{{1,2}}", rf"~\s*{_SOUNDS}\s*~", rf"♪+\s*{_SOUNDS}\s*♪*", rf"\[\s*{_SOUNDS}(?![\w\]])"]
)
_WHO = r"(?:tutor|tutr|teacher|instructor|coach|student|pupil|learner|speaker[ _]?\d{1,2}|spk[ _]?\d{1,2})"
#: A speaker's name at the start of a line, with the sign that makes a label of it. It is sought where stamps and sounds are gone.
LABEL = rf"(?m)^[ \t]*(?:(?i:\*\*[ \t]*{_WHO}[ \t]*:?[ \t]*\*\*[ \t]*:?|\[[ \t]*{_WHO}[ \t]*\][ \t]*:?|\([ \t]*{_WHO}[ \t]*\)[ \t]*:?|<[ \t]*{_WHO}[ \t]*>[ \t]*:?|{_WHO}[ \t]?(?:>>?|:)|{_WHO}[ \t][-–—](?=\s))|[TS](?:>>?|[ \t]?:)(?=\s|$))"
#: Hesitation sounds, with the signs that trail them; mm after a number is a unit, and what is part of a name or an
#: address is none. The first letter comes first, so that the search skips fast to where one may begin.
FILLER = (
    r"[uUeEhHmM](?<![\p{L}\p{N}_@'’&+-].)(?<![\p{L}\p{N}]\..)(?:"
    r"(?<=[uU])(?i:u*(?:-?u*m+|h+-?m*|-uh+))|(?<=[eE])(?i:r+(?:-?r*m*)|-er+m*)|(?<=[hH])(?i:m+)"
    r"|(?<=[mM])(?i:-h+m+|m{2,})|(?<=M)[mM]|(?<=m)m(?<!\d\s?mm)"
    r")(?![\p{L}\p{N}_@'’&]|-\p{L}|\.\p{L})(?:\.{2,}|…|,)?"
)


def cleaned(rows: DataFrame, text: str = "content") -> DataFrame:
    """rows with noise_bits, the kinds of noise that were taken out, and __b, the text before labels go, __d, what was said.

    Each step takes what the one before leaves: stamps, notes of sounds, labels, hesitations. No step takes a line's end.
    Odd spaces count as plain ones. Null text stays null, without noise.
    """
    rows = rows.withColumn("__x", plain_spaces(F.col(text)))
    x = F.col("__x")

    def drop(old: str | Column, pattern: str, gate: Column) -> Column:
        old = F.col(old) if isinstance(old, str) else old
        return F.when(gate, F.regexp_replace(old, pattern, " ")).otherwise(old)

    # each gate is true wherever the pattern can match, and much cheaper
    a = rows.withColumn("__a", drop(x, STAMP, x.contains(":") | x.contains("{t=") | x.contains("s]")))
    b = a.withColumn("__b", drop("__a", SOUND, F.col("__a").rlike(r"[\[({<*~♪]")))
    c = b.withColumn("__c", drop("__b", LABEL, F.col("__b").rlike(r"^[ \t]*(?:[\[(<*]|[TSts](?i:[>:]|\s:|tud|ut|eac|p[ek])|[pP](?i:up)|[lL](?i:ear)|[iI](?i:nst)|[cC](?i:oac))|\R")))
    d = c.withColumn("__d", F.regexp_replace("__c", FILLER, " "))
    steps = list(zip(KINDS, (x, F.col("__a"), F.col("__b"), F.col("__c")), (F.col("__a"), F.col("__b"), F.col("__c"), F.col("__d"))))
    mask = sum((F.when(old != new, 1 << i).otherwise(0) for i, (_, old, new) in enumerate(steps)), F.lit(0))
    return d.withColumn("noise_bits", F.coalesce(mask, F.lit(0)))


#: Rows without id that come after all ids stand at this power of two and their second, or a hash where they have no time.
LOOSE_BITS = 52


def timing_edges(timed: DataFrame, loose: DataFrame) -> DataFrame:
    """session_id, secs, before, after, crossed: for each time of loose, the ids that its timing edges keep it between.

    timed: session_id, utterance_id, secs of rows with both; loose: session_id, secs of rows with a time only. A loose row
    has an edge from the last id whose time is not later, and one to the first id whose time is later; an edge weighs
    more, the closer the two times are. Dialogue edges, from each id to the next, weigh more than all. Where the first
    id stands after the second in the dialogue, both edges and the dialogue's close a cycle, and the lighter one is
    dropped (of equals, the later): crossed is true, and before or after null then. It is null, too, where there is no such id.

    The ids of a second are summed first, so a window sees one row a second of a session.
    """
    clock = timed.groupBy("session_id", "secs").agg(F.max("utterance_id").alias("last_id"), F.min("utterance_id").alias("first_id")).unionByName(loose.distinct(), allowMissingColumns=True)
    clock = clock.groupBy("session_id", "secs").agg(F.max("last_id").alias("last_id"), F.min("first_id").alias("first_id"), F.max(F.col("first_id").isNull()).alias("sought"))
    known = F.col("last_id").isNotNull()
    w = W.partitionBy("session_id").orderBy("secs")
    back = w.rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("session_id").orderBy(F.desc("secs")).rowsBetween(W.unboundedPreceding, -1)
    both = clock.select(
        "session_id", "secs", "sought",
        F.last(F.when(known, F.struct("secs", F.col("last_id").alias("id"))), ignorenulls=True).over(back).alias("p"),
        F.last(F.when(known, F.struct("secs", F.col("first_id").alias("id"))), ignorenulls=True).over(ahead).alias("s"),
    ).where("sought")
    crossed = F.coalesce(F.col("p.id") >= F.col("s.id"), F.lit(False))
    first = F.col("secs") - F.col("p.secs") <= F.col("s.secs") - F.col("secs")
    return both.select("session_id", "secs", F.when(~crossed | first, F.col("p.id")).alias("before"), F.when(~crossed | ~first, F.col("s.id")).alias("after"), crossed.alias("crossed"))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Each different row with its place in the topological order of what its precedence edges leave, and what was said.

    rows: session_id, utterance_id, role, content, ts. Columns: session_id, utterance_id, role, noise_bits, block, pos,
    side, secs, row (a hash), lines (label and text of each line). Rows with null session or content are left out.

    Precedence edges are of three kinds. Cues: from each line of a row to the next. Dialogue: from each utterance id to
    the next. Timing: as timing_edges, for rows without id. An edge that closes a cycle with heavier ones is dropped;
    cues and dialogue never disagree, and times of rows with an id that fall against the dialogue are lighter than it.
    What is left has no cycle: a row with an id stands at its id, one without just before the first id it precedes
    (side -1), else just after the id that it follows (side 1), after all ids by time where no id is later, and after
    those by hash without a time. Rows of one id are ordered by time and hash.
    """
    once = rows.where("session_id is not null and content is not null").select(
        "session_id", "utterance_id", clean_role(F.col("role")).alias("role"), "content", seconds(F.col("ts")).alias("secs"), F.xxhash64("role", "content", "ts").alias("row")
    )
    uid, secs = F.col("utterance_id"), F.col("secs")
    spoken = once.where(uid.isNotNull()).withColumns({"pos": uid, "side": F.lit(0)})
    loose = once.where(uid.isNull())
    edges = timing_edges(once.where(uid.isNotNull() & secs.isNotNull()).select("session_id", "utterance_id", "secs"), loose.where(secs.isNotNull()).select("session_id", "secs"))
    held = loose.join(edges, ["session_id", "secs"], "left")
    end = F.lit(1 << LOOSE_BITS) + F.coalesce(secs.cast("bigint"), F.lit(1 << 30) + F.pmod("row", F.lit(1 << 24)))
    # a row later than all ids stands at the end by its own time, so that such rows are no one block
    put = held.withColumn("pos", F.coalesce("after", F.when(F.col("crossed"), F.col("before")), end)).withColumn("side", F.when(F.col("after").isNotNull(), -1).otherwise(1))
    placed = spoken.unionByName(put.select(spoken.columns))
    said = cleaned(placed)
    labels = F.transform(F.split("__b", r"\r\n|[\r\n]"), lambda x: F.regexp_extract(x, LABEL, 0))
    texts = F.transform(F.split("__d", r"\r\n|[\r\n]"), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " ")))
    done = said.select("session_id", "utterance_id", "role", "noise_bits", F.shiftright("pos", BLOCK_BITS).alias("block"), "pos", "side", "secs", "row", F.arrays_zip(labels.alias("label"), texts.alias("text")).alias("lines"))
    return done


def noise(rows: DataFrame) -> DataFrame:
    """session_id, utterance_id, kind: of the ordered rows with an id, each kind of noise that was taken out.

    rows: as for ordered_rows; role and ts may be missing.
    """
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("role", "ts") if c not in rows.columns})
    # exploded before it is filtered: a filter on the marks would be pushed down and run every step again
    kinds = F.array_compact(F.array(*[F.when(F.col("noise_bits").bitwiseAND(1 << i) > 0, k) for i, k in enumerate(KINDS)]))
    marked = ordered_rows(rows).where("utterance_id is not null")
    return marked.select("session_id", "utterance_id", F.explode_outer(kinds).alias("kind")).where("kind is not null").distinct()


def speaker_turns(rows: DataFrame) -> DataFrame:
    """session_id, turn, role, text, first_id, last_id, n_segments: ordered turns with only the words that were said.

    rows: session_id, utterance_id, role, content, ts, ordered as ordered_rows says; a segment is a line of a row.
    Neighbours of one role are merged to a turn; role is the line's own label where it names one, else the row's. A label
    such as Speaker 2 names nobody.

    Segments without words are left out, as are rows with null session or text, and segments that neither a label nor
    the row gives to student or tutor, such as background and null roles; what stands around them is merged. Exact
    repeats count once. Turns are numbered from 1.

    Texts are cleaned before they are shuffled, once, by session and block of 4,096 positions. Turns are first built
    within blocks. Roles alternate within a block, so a window over one row a block tells which blocks go on with the
    turn before, and only the pieces at such edges are grouped again: where blocks end changes no turn.
    """
    found = ordered_rows(rows).select("session_id", "utterance_id", "role", "block", "pos", "side", "secs", "row", "lines")
    # through explode_outer, so that the filters below are not pushed down to run every step again
    lines = found.repartition("session_id", "block").dropDuplicates(["session_id", "block", "pos", "side", "utterance_id", "row"])
    segs = lines.select("session_id", "utterance_id", "role", "block", "pos", "side", "secs", "row", F.posexplode_outer("lines").alias("line", "s")).select("*", "s.text", clean_role(F.regexp_replace("s.label", r"[^\p{L}]+", "")).alias("label"))
    segs = segs.withColumn("role", F.when(F.col("label").isin("student", "tutor"), F.col("label")).otherwise(F.col("role")))
    segs = segs.where("text <> '' and role in ('student', 'tutor')")
    w = W.partitionBy("session_id", "block").orderBy("pos", "side", "secs", "row", "line")
    turn = F.sum(F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    numbered = segs.withColumn("k", F.row_number().over(w)).withColumn("turn", turn)
    built = numbered.groupBy("session_id", "block", "turn").agg(
        F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("k", "text"))).alias("parts"), F.min("utterance_id").alias("first_id"), F.max("utterance_id").alias("last_id"), F.count(F.lit(1)).alias("n_segments")
    )
    return _joined(cut(built.withColumn("text", F.array_join("parts.text", " ")).drop("parts")))


def _joined(pieces: DataFrame) -> DataFrame:
    """The turns of pieces within blocks: session_id, block, turn (from 1 in each block), role, text, first_id, last_id, n_segments."""
    past = W.partitionBy("session_id").orderBy("block")
    blocks = pieces.groupBy("session_id", "block").agg(F.max("turn").alias("m"), F.max(F.when(F.col("turn") == 1, (F.col("role") == "student").cast("int"))).alias("head"))
    tail = F.when(F.col("m") % 2 == 1, F.col("head")).otherwise(1 - F.col("head"))
    blocks = blocks.withColumn("on", F.coalesce(F.lag(tail).over(past) == F.col("head"), F.lit(False)).cast("int"))
    blocks = blocks.select("session_id", "block", "m", "on", F.coalesce(F.lead("on").over(past), F.lit(0)).alias("goes_on"), F.coalesce(F.sum(F.col("m") - F.col("on")).over(past.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = pieces.join(blocks, ["session_id", "block"]).withColumn("edge", ((F.col("turn") == 1) & (F.col("on") == 1)) | ((F.col("turn") == F.col("m")) & (F.col("goes_on") == 1)))
    placed = placed.withColumn("turn", F.col("before") + F.col("turn") - F.col("on"))
    out = ("session_id", "turn", "role", "text", "first_id", "last_id", "n_segments")
    again = placed.where("edge").groupBy("session_id", "turn").agg(
        F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n_segments").alias("n_segments")
    )
    return placed.where("not edge").select(*out).unionByName(again.withColumn("text", F.array_join("parts.text", " ")).select(*out))
