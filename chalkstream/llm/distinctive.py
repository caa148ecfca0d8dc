"""How much each term marks the record it stands in, against the whole collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term: a run of four or more letters a-z of the lower-cased text.
TERM = "([a-z]{4,})"
#: Units of a record that are counted together before anything is shuffled by term.
BLOCK_BITS = 10


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1))


def distinctive_terms(rows: DataFrame, record: str, unit: str, text: str, same: tuple[str, ...] = ()) -> DataFrame:
    """One row for each record and term: record, term, tf, n_units, df, n_records, record_terms, idf, score.

    tf counts occurrences, n_units the different units (bigint, such as utterance ids) of the record that hold the
    term, df the records that hold it. idf = ln((1 + n_records) / (1 + df)) + 1 and score = tf / record_terms * idf,
    so a record's length does not matter. Rows alike in record, unit, text and the columns of same count once.

    Rows with a null record or a null text hold no term. A row with a null unit counts for tf and df but for no unit.
    Records without any term have no rows and are not counted in n_records. An empty table gives no rows. Other
    columns of rows are ignored, whatever their names. Ties need no order, since all terms of a record come out.

    A record is cut into blocks of 1,024 units, and rows without a unit by their text, so that a record with a third
    of all rows is spread over tasks. Units of a block are counted as bits of 64-bit words, so distinct counts merge
    without keeping the units. The frequent terms' join with df is split by adaptive execution where it is skewed.
    """
    u = F.col(unit).cast("bigint")
    row = rows.where(F.col(record).isNotNull() & F.col(text).isNotNull()).select(
        F.col(record).alias("record"),
        F.coalesce(F.shiftright(u, BLOCK_BITS), -1 - F.pmod(F.xxhash64(F.col(text)), F.lit(1024))).alias("block"),
        u.alias("unit"),
        F.col(text).alias("text"),
        *[F.col(c).alias(f"same_{i}") for i, c in enumerate(same)],
    )
    # one shuffle of the texts; all that is grouped by more than (record, block) stays in place
    once = row.repartition("record", "block").dropDuplicates()
    # outer: else a filter would seek the terms twice
    at = once.select("record", "block", F.shiftright("unit", 6).alias("word"), F.when(F.col("unit").isNotNull(), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("unit", F.lit(64)).cast("int"))).alias("bit"), F.explode_outer(terms(F.col("text"))).alias("term")).where("term is not null")
    words = at.groupBy("record", "block", "word", "term").agg(F.count(F.lit(1)).alias("tf"), F.bit_or("bit").alias("bits"))
    blocks = words.groupBy("record", "block", "term").agg(F.sum("tf").alias("tf"), F.sum(F.coalesce(F.bit_count("bits"), F.lit(0))).alias("n_units"))
    counts = blocks.groupBy("record", "term").agg(F.sum("tf").alias("tf"), F.sum("n_units").alias("n_units"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # lengths come from the texts, before terms are exploded; the filter keeps both uses of them on one exchange
    lengths = once.groupBy("record").agg(F.sum(F.size(terms(F.col("text")))).alias("record_terms")).where("record_terms > 0")
    n = lengths.agg(F.count(F.lit(1)).alias("n_records"))
    out = counts.join(df.hint("shuffle_hash"), "term").join(lengths.hint("shuffle_hash"), "record").crossJoin(F.broadcast(n))
    idf = F.log((1 + F.col("n_records")) / (1 + F.col("df"))) + 1
    return out.select(
        F.col("record").alias(record), "term", "tf", "n_units", "df", "n_records", "record_terms",
        idf.alias("idf"), (F.col("tf") / F.col("record_terms") * idf).alias("score"),
    )


def recurring_terms(scored: DataFrame, least_units: int = 4, least_records: int = 2, most_records: int = 6) -> DataFrame:
    """Of distinctive_terms, the rows whose term recurs in the record and in few records of the collection."""
    return scored.where((F.col("n_units") >= least_units) & F.col("df").between(least_records, most_records))
