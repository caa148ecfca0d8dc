"""SQL text for Spark and for DuckDB from one template, so that a query and its check differ only where engines do.

A template is a function of the dialect and of names of frames. Its windows say {e.w}: Spark's partition a session
further by blocks, whose rows near the edges are there twice (own is false for the copies), DuckDB's don't.
"""

from __future__ import annotations

import inspect
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from chalkstream.functions.lexicons import PATTERNS


@dataclass(frozen=True)
class Dialect:
    spark: bool

    @property
    def w(self) -> str:
        return "partition by session_id, blk order by i" if self.spark else "partition by session_id order by i"

    def text(self, s: str) -> str:
        return f'r"{s}"' if self.spark else "'" + s.replace("'", "''") + "'"

    def strings(self, words: list[str] | tuple[str, ...]) -> str:
        inner = ", ".join(self.text(w) for w in words)
        return f"array({inner})" if self.spark else f"[{inner}]"

    def has(self, col: str, name: str) -> str:
        return self.matches(col, PATTERNS[name])

    def matches(self, col: str, pattern: str, any_case: bool = True) -> str:
        p = self.text(("(?i)" if any_case else "") + pattern)
        return f"coalesce({col} rlike {p}, false)" if self.spark else f"coalesce(regexp_matches({col}, {p}), false)"

    def count(self, col: str, pattern: str) -> str:
        return f"cast(regexp_count({col}, {self.text(pattern)}) as bigint)" if self.spark else f"cast(len(regexp_extract_all({col}, {self.text(pattern)})) as bigint)"

    def found(self, col: str, pattern: str, group: int = 0) -> str:
        """All matches as an array."""
        return f"regexp_extract_all({col}, {self.text(pattern)}, {group})"

    def replace(self, col: str, pattern: str, to: str) -> str:
        return f"regexp_replace({col}, {self.text(pattern)}, {self.text(to)})" if self.spark else f"regexp_replace({col}, {self.text(pattern)}, {self.text(to)}, 'g')"

    def words(self, col: str) -> str:
        """Runs of letters, digits and underscores of any script, in lower case."""
        return self.found(f"lower({col})", r"[\p{L}\p{N}_]+")

    def talk_words(self, col: str) -> str:
        return self.found(f"lower({col})", "[a-z0-9']+")

    def size(self, a: str) -> str:
        return f"cast(size({a}) as bigint)" if self.spark else f"cast(len({a}) as bigint)"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})" if self.spark else f"list_distinct({a})"

    def both(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})" if self.spark else f"list_intersect({a}, {b})"

    def either(self, a: str, b: str) -> str:
        return f"array_union({a}, {b})" if self.spark else f"list_distinct(list_concat({a}, {b}))"

    def without(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})" if self.spark else f"list_filter(list_distinct({a}), lambda v: not list_contains({b}, v))"

    def keep(self, a: str, cond: str) -> str:
        """The elements v of a that fulfil cond."""
        return f"filter({a}, v -> {cond})" if self.spark else f"list_filter({a}, lambda v: {cond})"

    def explode(self, a: str) -> str:
        return f"explode({a})" if self.spark else f"unnest({a})"

    def last(self, x: str, over: str) -> str:
        """The last value that is not null within the window."""
        return f"last_value({x}) ignore nulls over {over}" if self.spark else f"last_value({x} ignore nulls) over {over}"

    def first(self, x: str, over: str) -> str:
        return f"first_value({x}) ignore nulls over {over}" if self.spark else f"first_value({x} ignore nulls) over {over}"

    def slope(self, y: str, x: str) -> str:
        return f"regr_slope({y}, {x})"

    def joined(self, col: str, order: str, sep: str = " ") -> str:
        return f"listagg({col}, {self.text(sep)}) within group (order by {order})" if self.spark else f"string_agg({col}, {self.text(sep)} order by {order})"

    def overlap(self, a: str, b: str) -> str:
        """Jaccard similarity of two arrays as sets, 0 if either is empty."""
        return f"case when {self.size(a)} > 0 and {self.size(b)} > 0 then {self.size(self.both(a, b))} * 1.0D / {self.size(self.either(a, b))} else 0.0D end" if self.spark else f"case when len({a}) > 0 and len({b}) > 0 then cast({self.size(self.both(a, b))} as double) / {self.size(self.either(a, b))} else 0.0 end"

    @property
    def dbl(self) -> str:
        return "double"

    @property
    def any(self) -> str:
        return "bool_or"

    def half_even(self, x: str) -> str:
        return f"bround({x})" if self.spark else f"round_even({x}, 0)"

    def share_of(self, key: str) -> str:
        """A number in [0, 1] from the first 32 bits of the key's MD5."""
        return f"cast(conv(substr(md5({key}), 1, 8), 16, 10) as double) / 4294967295.0D" if self.spark else f"cast(('0x' || substr(md5({key}), 1, 8)) as ubigint) / 4294967295.0"


SPARK, DUCK = Dialect(True), Dialect(False)
Template = Callable[..., str]


def run(template: Template, **frames: DataFrame) -> DataFrame:
    """The template in Spark over DataFrames of the names that it uses."""
    spark = next(iter(frames.values())).sparkSession
    names = {k: f"{k}_{uuid.uuid4().hex[:12]}" for k in frames}
    for k, df in frames.items():
        df.createOrReplaceTempView(names[k])
    try:
        return spark.sql(template(SPARK, **names))
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


def duck(template: Template, **frames: str) -> str:
    """The template for DuckDB; frames are the text of queries that give the same rows, and may use those before them."""
    ctes = ", ".join(f"{k} as ({v})" for k, v in frames.items())
    used = {k: k for k in frames if k in inspect.signature(template).parameters}
    return f"with {ctes} select * from ({template(DUCK, **used)}) final_rows"
