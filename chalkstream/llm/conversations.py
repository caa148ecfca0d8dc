"""Rebuilding conversations from message rows: roles, reply links, link trees, and what must be dropped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkstream.functions.keys import is_blank, stripped
from chalkstream.functions.text import seconds, words
from chalkstream.llm.components import stars
from chalkstream.session import cut

#: Spellings of each role, lower-case letters only.
ROLES = {
    "tutor": ("tutor", "tutr", "tut", "tutors", "t", "teacher", "teach", "tchr", "coach", "instructor", "mentor", "educator"),
    "student": ("student", "students", "stu", "stud", "studnt", "s", "pupil", "pupils", "learner", "child", "kid"),
    "background": ("background", "bg", "bgd", "backgrnd", "noise", "ambient", "room"),
}


def clean_role(role: Column) -> Column:
    """tutor, student or background; other for any other spelling; null for null and blank."""
    x = F.regexp_replace(F.lower(stripped(role)), "[^a-z]+", "")
    out = F.when(x == "", F.when(F.length(stripped(role)) > 0, "other"))
    for name, spelled in ROLES.items():
        out = out.when(x.isin(*spelled), name)
    return out.when(x.isNotNull(), "other")


#: Positions are cut into blocks of 4,096, so that no window holds more of a session than a block.
BLOCK_BITS = 12
#: Rows without a whole-number id come after all others: by time, and after those by hash.
LATE = 1 << 52
#: A message may answer any of so many said just before it, and no farther back than so many positions.
WINDOW, HORIZON = 8, 64
#: Words of four letters and more that say nothing of what is talked about.
PLAIN = (
    "about also because been could does doing don't done from going good have here into it's just know like look okay over really right said same some that that's them then there these they thing think this those "
    "very want well were what when where which will with would yeah your"
).split()


def messages(rows: DataFrame) -> DataFrame:
    """session_id, utterance_id, role (clean), content, secs, pos, block, says, h: rows in the form links are sought in.

    pos orders a session: the utterance_id, or for rows without one a late position by time, then by hash. says is true
    for student and tutor rows with content; h is the content's hash, null for none. Repeats are still there.
    """
    secs, h = seconds(F.col("ts")), F.xxhash64("content", "role", "ts")
    late = F.lit(LATE) + F.coalesce(secs.cast("bigint"), F.lit(1 << 40) + F.pmod(h, F.lit(1 << 30)))
    m = rows.where(F.col("session_id").isNotNull()).select(
        "session_id", "utterance_id", clean_role(F.col("role")).alias("role"), "content", secs.alias("secs"), F.coalesce("utterance_id", late).alias("pos"), F.when(F.col("content").isNotNull(), F.xxhash64("content")).alias("h")
    )
    says = F.coalesce(F.col("role").isin("student", "tutor"), F.lit(False)) & ~is_blank(F.col("content"))
    return m.withColumn("block", F.shiftright("pos", BLOCK_BITS)).withColumn("says", says)


def _signature(found: Column) -> Column:
    """Two sets of 64 bits by two hashes of each word: of the words of one text, those that another has are counted by both."""
    bit = lambda x, shift: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(63)).cast("int"))
    zero = F.lit(0).cast("bigint")
    return F.aggregate(F.transform(found, lambda x: F.xxhash64(x)), F.struct(zero.alias("a"), zero.alias("b")), lambda s, x: F.struct(s["a"].bitwiseOR(bit(x, 0)).alias("a"), s["b"].bitwiseOR(bit(x, 6)).alias("b")))


def reply_links(rows: DataFrame, content: bool = False, window: int = WINDOW) -> DataFrame:
    """messages(), each different row once, with their likeliest parent: parent_pos, parent_score, crosses.

    rows: session_id, utterance_id, role, content, ts. Candidates are the window messages said just before it by either
    speaker, no farther back than HORIZON positions (utterance ids, or for rows without one seconds). A link's score adds
    closeness in time (0.4 where a time is missing or falls), 0.8 of the share of the message's words that the candidate
    has (words of four characters and more, but for PLAIN; by signatures, in which one word in about 100 agrees by
    chance), and between speakers 0.2, 0.2 more for answering a question, and 0.3 where the message addresses the other
    by placeholder. The best is the parent; of ties the later. A message whose best score is under 0.25 starts a
    conversation and has none. crosses says that the parent is the other speaker's. Rows that say nothing have no
    links, and rows of one position none to each other. first_of_id marks the first row of an utterance_id, torn a row
    whose content differs from that of another row of its utterance_id.

    Rows are shuffled once, by session and block; the HORIZON positions before a block go along with it, so a room with
    a third of all rows is spread over tasks, and where blocks end changes no link. Links are then found in one pass
    over the sorted rows, by whole columns. The text goes along only if content is true.
    """
    m = messages(rows)
    lower = F.lower("content")
    named = F.when(F.col("role") == "student", F.contains(lower, F.lit("[tutor_name]"))).otherwise(F.contains(lower, F.lit("[student_name]")))
    said = F.when(F.col("says"), _signature(F.array_except(words(F.col("content"), 4), F.array(*map(F.lit, PLAIN)))))
    own = ("session_id", "utterance_id", "role", "secs", "pos", "says", "h", *(("content",) if content else ()))
    asks = F.col("content").rlike(r"\?\s*$")
    low = F.col("pos").bitwiseAND((1 << BLOCK_BITS) - 1)
    over = F.when((low >= (1 << BLOCK_BITS) - HORIZON) & F.col("says"), F.struct((F.col("block") + 1).alias("block"), F.lit(False).alias("own")))
    slim = m.select(*own, "block", said.alias("said"), F.coalesce(asks, F.lit(False)).alias("asks"), F.coalesce(named, F.lit(False)).alias("named"))
    spread = slim.select(*own, F.col("said.a").alias("a"), F.col("said.b").alias("b"), "asks", "named", F.explode(F.array_compact(F.array(F.struct("block", F.lit(True).alias("own")), over))).alias("at"))
    ready = spread.select(*own, "a", "b", "asks", "named", "at.block", "at.own").repartition("session_id", "block").sortWithinPartitions("session_id", "block", "pos", "role", "h", "secs")
    keep = [*own, "block"]
    schema = T.StructType([*[ready.schema[c] for c in keep], T.StructField("first_of_id", T.BooleanType()), T.StructField("torn", T.BooleanType()), T.StructField("parent_pos", T.LongType()), T.StructField("parent_score", T.DoubleType()), T.StructField("crosses", T.BooleanType())])
    return ready.mapInArrow(lambda batches: _linked(batches, keep, window), schema)


def _linked(batches: Iterator[pa.RecordBatch], keep: list[str], window: int) -> Iterator[pa.RecordBatch]:
    """Rows by session, block and order, without repeats and rows of the block before, with their parents."""
    roles = {None: 0, "student": 1, "tutor": 2, "background": 3, "other": 4}
    held: dict[str, np.ndarray] | None = None
    session = ""
    for b in batches:
        if not b.num_rows:
            continue
        whole = lambda c, none, b=b: b.column(c).fill_null(none).to_numpy(zero_copy_only=False)
        coded, names = b.column("role").dictionary_encode(), b.column("session_id").dictionary_encode()
        role = np.array([roles[x] for x in coded.dictionary.to_pylist()] + [0], np.int8)[coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)]
        x = {
            "session": names.indices.to_numpy(zero_copy_only=False).astype(np.int64), "block": whole("block", 0), "pos": whole("pos", 0), "secs": whole("secs", -1).astype(float), "h": whole("h", 0), "none": b.column("h").is_null().to_numpy(zero_copy_only=False),
            "uid": whole("utterance_id", 0), "has_id": b.column("utterance_id").is_valid().to_numpy(zero_copy_only=False), "role": role, "says": whole("says", False), "own": whole("own", False), "a": whole("a", 0).astype(np.uint64), "b": whole("b", 0).astype(np.uint64),
            "asks": whole("asks", False), "named": whole("named", False),
        }
        n_held = 0 if held is None else len(held["pos"])
        if held is not None:
            held["session"] = np.full(n_held, names.dictionary.index(pa.scalar(session, pa.string())).as_py(), np.int64)
            x = {k: np.concatenate([held[k], v]) for k, v in x.items()}
        same = np.zeros(len(x["pos"]), bool)
        same[1:] = (x["session"][1:] == x["session"][:-1]) & (x["block"][1:] == x["block"][:-1])
        group = np.cumsum(~same)
        equal = lambda *names: np.logical_and.reduce([np.r_[False, x[k][1:] == x[k][:-1]] for k in names]) & same
        repeat = equal("pos", "has_id", "uid", "role", "h", "none", "secs")
        same_id = equal("has_id", "uid") & x["has_id"]
        torn = same_id & ~equal("h", "none")
        first = x["has_id"] & ~same_id
        at = np.flatnonzero(x["says"] & ~repeat)
        g, pos, secs, tutor = group[at], x["pos"][at], x["secs"][at], x["role"][at] == 2
        n_a, n_b = np.bitwise_count(x["a"][at]), np.bitwise_count(x["b"][at])
        best, parent, crosses = np.full(len(at), -1.0), np.full(len(at), -1, np.int64), np.zeros(len(at), bool)
        for k in range(1, min(window, len(at) - 1) + 1):
            i, j = slice(k, None), slice(None, -k)
            far = pos[i] - pos[j]
            ok = (g[i] == g[j]) & (far > 0) & (far <= HORIZON)
            gap = secs[i] - secs[j]
            time = np.where((secs[i] >= 0) & (secs[j] >= 0) & (gap >= 0), np.exp(-np.clip(gap, 0, None) / 60.0), 0.4)
            shared = np.minimum(*(np.bitwise_count(x[c][at[i]] & x[c][at[j]]) / np.maximum(n[i], 1) for c, n in (("a", n_a), ("b", n_b))))
            cross = tutor[i] != tutor[j]
            score = np.round(time + 0.8 * shared + cross * (0.2 + 0.2 * x["asks"][at[j]] + 0.3 * x["named"][at[i]]), 6)
            better = ok & (score > best[i])
            best[i] = np.where(better, score, best[i])
            parent[i] = np.where(better, pos[j], parent[i])
            crosses[i] = np.where(better, cross, crosses[i])
        linked = best >= 0.25
        spread = lambda v, dtype: _put(len(x["pos"]), at, v, dtype)[n_held:]
        out = (x["own"] & ~repeat)[n_held:]
        mask = pa.array(out)
        made = {
            "first_of_id": pa.array(first[n_held:][out]), "torn": pa.array(torn[n_held:][out]), "parent_pos": pa.array(spread(parent, np.int64)[out], mask=~spread(linked, bool)[out]),
            "parent_score": pa.array(spread(best, float)[out], mask=~spread(best >= 0, bool)[out]), "crosses": pa.array(spread(linked & crosses, bool)[out]),
        }
        yield pa.RecordBatch.from_arrays([*[b.column(c).filter(mask) for c in keep], *made.values()], names=[*keep, *made])
        # what the next batch may need of the group that may go on: the last messages said, and the last row
        stay = np.unique(np.r_[at[g == group[-1]][-window:], len(group) - 1]) if len(at) else np.array([len(group) - 1])
        held = {k: v[stay] for k, v in x.items()}
        held["own"], session = np.zeros(len(stay), bool), b.column("session_id")[-1].as_py()


def _put(n: int, at: np.ndarray, values: np.ndarray, dtype: type) -> np.ndarray:
    out = np.zeros(n, dtype)
    out[at] = values
    return out


def session_verdicts(links: DataFrame, named: DataFrame) -> DataFrame:
    """session_id, reason, n_messages, n_replies: every session of links or named once; reason null for one that stays.

    links: reply_links. named: session_id of the sessions that are expected. The first that applies: missing
    (no row), empty (no student or tutor message), no_reply (no message's parent is the other speaker's, and, as an
    exact check on these, only one of them speaks), broken (a whole number is missing between the least and the largest utterance_id, or one has rows of different
    content; a null content differs from any text). Null session ids are left out; repeated rows change nothing.
    """
    uid = F.col("utterance_id")
    parts = links.groupBy("session_id", "block").agg(
        F.count_if("says").alias("said"), F.count_if("crosses").alias("crossed"), F.max(F.when(F.col("says"), F.col("role"))).alias("one"), F.min(F.when(F.col("says"), F.col("role"))).alias("two"),
        F.count_if("first_of_id").alias("n"), F.min(uid).alias("a"), F.max(uid).alias("b"), F.max("torn").alias("torn"),
    )
    asked = named.where(F.col("session_id").isNotNull()).select("session_id").distinct()
    both = parts.withColumn("there", F.lit(True)).unionByName(asked.withColumn("there", F.lit(False)), allowMissingColumns=True)
    each = both.groupBy("session_id").agg(
        F.max("there").alias("there"), F.sum("said").alias("said"), F.sum("crossed").alias("crossed"), (F.max("one") == F.min("two")).alias("alone"),
        F.sum("n").alias("n"), (F.max("b") - F.min("a") + 1).alias("span"), F.max("torn").alias("torn"),
    )
    reason = F.when(~F.col("there"), "missing").when(F.col("said") == 0, "empty").when((F.col("crossed") == 0) & F.col("alone"), "no_reply").when((F.col("n") != F.col("span")) | F.col("torn"), "broken")
    return each.select("session_id", reason.alias("reason"), F.coalesce("said", F.lit(0)).alias("n_messages"), F.coalesce("crossed", F.lit(0)).alias("n_replies"))


def _with_heads(links: DataFrame) -> DataFrame:
    """links with head: the position of the furthest ancestor that a row has among the rows that come before it here.

    Rows come by session, block and position. A row whose parent is not among them, as it is in an earlier block, is its
    own head; link_trees joins such heads. Texts pass through as Arrow columns, untouched.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for b in batches:
            out = []
            for session, block, pos, parent in zip(*(b.column(c).to_pylist() for c in ("session_id", "block", "pos", "parent_pos"))):
                if (session, block) != at:
                    at, known = (session, block), {}
                out.append(known.setdefault(pos, known.get(parent, pos)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "head"])

    return links.mapInArrow(heads, T.StructType([*links.schema.fields, T.StructField("head", T.LongType())]))


def link_trees(links: DataFrame) -> DataFrame:
    """The messages of links (with heads) that say something, each with the root of its link tree: root_pos.

    Within a block heads are known, so trees are joined over heads whose parent is in another block, of which a session
    has few: one for each link that reaches over the end of a block.
    """
    says = links.where("says")
    name = lambda p: F.format_string("%s|%020d", F.col("session_id"), p)
    open_ = says.where("head = pos and parent_pos is not null").select("session_id", F.col("pos").alias("u"), F.col("parent_pos").alias("pos")).distinct()
    over = open_.join(says.select("session_id", "pos", F.col("head").alias("v")), ["session_id", "pos"]).groupBy("session_id", "u").agg(F.min("v").alias("v"))
    root = stars(over.select(name(F.col("u")).alias("u"), name(F.col("v")).alias("v")))
    root = root.select(F.regexp_extract("node", r"^(.*)\|", 1).alias("session_id"), F.substring_index("node", "|", -1).cast("bigint").alias("head"), F.substring_index("root", "|", -1).cast("bigint").alias("root_pos"))
    return says.join(root, ["session_id", "head"], "left").withColumn("root_pos", F.coalesce("root_pos", "head")).drop("head")


def conversations(rows: DataFrame, named: DataFrame) -> DataFrame:
    """session_id, conversation, place, utterance_id, role, content, reply_to: ordered messages of the sessions that stay.

    conversation is the position of the root message of the link tree within the session; place orders a session.
    """
    links = cut(_with_heads(reply_links(rows, content=True)))
    dropped = session_verdicts(links, named).where("reason is not null").select("session_id")
    kept = link_trees(links.join(dropped, "session_id", "left_anti"))
    return kept.select("session_id", F.col("root_pos").alias("conversation"), F.col("pos").alias("place"), "utterance_id", "role", "content", F.col("parent_pos").alias("reply_to"))
