"""Cutting long texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boundary_pattern(most: int) -> str:
    """A regex whose successive matches tile a text, each of at most most code points.

    Alternatives from the strongest boundary down: the rest of the text, a blank line, a line end, the end of a
    sentence, of a clause, of a word; at last any character. Boundaries but the first are taken only in the second
    half of the room, so that a strong early boundary does not make tiny pieces.
    """
    room = f"{{{max(1, most // 2)},{most}}}"
    ends = [r"(?<=\n[ \t]{0,8}\n)", r"(?<=\n)", r"(?<=[.!?…]['\")\]]{0,3}\s{1,3})", r"(?<=[,;:—–]\s{1,3})", r"(?<=\s)"]
    return "(?s)(" + "|".join([rf".{{1,{most}}}\z", *(rf".{room}{end}" for end in ends), rf".{{1,{most}}}"]) + ")"


def pieces(text: Column, limit: int = 500, overlap: int = 50) -> Column:
    """Array of struct(piece_no, start, piece): each piece at most limit code points, numbered from 1.

    start is the 0-based offset of the piece. A piece after the first begins with the tail of the text before its own
    part: overlap code points, or down to half as many where that makes it begin with a word. Taking from each piece
    what lies after the end of the piece before it gives the text back, character for character.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and smaller than limit")
    parts = F.regexp_extract_all(text, F.lit(boundary_pattern(limit - overlap)), F.lit(1))
    # running ends of the parts, so that each part knows its offset
    ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))

    def piece(part: Column, i: Column) -> Column:
        at = F.get(ends, i)
        back = F.substring(text, F.greatest(at - overlap + 1, F.lit(1)), F.least(at, F.lit(overlap)))
        # begin with a word: drop what stands before the first white space in the older half of the lookback
        cut = F.regexp_extract(back, rf"(?s)^(\S{{0,{max(1, overlap // 2)}}}\s)", 1)
        tail = F.when(i == 0, F.lit("")).otherwise(F.substr(back, F.length(cut) + 1))
        return F.struct((i + 1).alias("piece_no"), (at - F.length(tail)).alias("start"), F.concat(tail, part).alias("piece"))

    whole = F.array(F.struct(F.lit(1).alias("piece_no"), F.lit(0).alias("start"), text.alias("piece")))
    return F.when(F.length(text) <= limit, whole).otherwise(F.transform(parts, piece))


def split_long(rows: DataFrame, text: str, limit: int = 500, overlap: int = 50) -> DataFrame:
    """All rows, one for each piece of their text, with piece_no, n_pieces, start and piece beside their own columns.

    A text within limit is one piece. Null texts give no piece and no row; empty texts give one empty piece. Repeated
    rows are each cut. Columns of rows named as a result column are replaced. An empty table gives no rows.
    Everything runs in one stage without a shuffle; a text's pieces are made by one regex pass over it.
    """
    own = [c for c in rows.columns if c not in ("piece_no", "n_pieces", "start", "piece")]
    cut = rows.where(F.col(text).isNotNull()).select(*[F.col(f"`{c}`") for c in own], pieces(F.col(f"`{text}`"), limit, overlap).alias("__pieces"))
    # outer: else a filter on the array would be pushed down and cut every text twice
    one = cut.select(*[F.col(f"`{c}`") for c in own], F.size("__pieces").alias("n_pieces"), F.explode_outer("__pieces").alias("__piece"))
    return one.select(*[F.col(f"`{c}`") for c in own], "__piece.piece_no", "n_pieces", "__piece.start", "__piece.piece")
