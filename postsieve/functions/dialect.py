"""Expression texts for Spark SQL, and for DuckDB where a registered query is held against it.

The functions of this package take a dialect and column expressions and give an expression; column() makes a Spark
Column of one. Everything stays a built-in expression, so it runs inside generated code without Python workers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.functions.factors import factors

_names = count()
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def lit(self, s: str) -> str:
        if self.spark:
            s = s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
            return f"'{s}'"
        return "'" + s.replace("'", "''") + "'"

    def has(self, x: str, word: str) -> str:
        return f"contains({x}, {self.lit(word)})"

    def let(self, x: str, body: Callable[[str], str]) -> str:
        """body(x), with x evaluated once a row: where it is named many times in branches, Spark evaluates it for each."""
        if re.fullmatch(r"\w+", x) or not self.spark:
            return body(x)
        v = f"_v{next(_names)}"
        return f"transform(array({x}), {v} -> {body(v)})[0]"

    def any_of(self, x: str, words: Iterable[str]) -> str:
        return self.let(x, lambda v: "(" + " OR ".join(self.has(v, w) for w in words) + ")")

    def matches(self, x: str, regex: str) -> str:
        return f"({x} RLIKE {self.lit(regex)})" if self.spark else f"regexp_matches({x}, {self.lit(regex)})"

    def seek(self, x: str, regex: str) -> str:
        """matches for long texts: Spark looks for the regex's literals first, and runs it where they leave it open."""
        if not self.spark:
            return self.matches(x, regex)
        enough, needed = factors(regex)
        any_of = lambda words: "(" + " OR ".join(self.has(x, w) for w in words) + ")"
        left = [] if needed is None else [" AND ".join([*map(any_of, needed), self.matches(x, regex)])]
        return "(" + " OR ".join([*([any_of(enough)] if enough else []), *left]) + ")"

    def extract(self, x: str, regex: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(regex)}, {group})"

    def extract_all(self, x: str, regex: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(regex)}, {group})"

    def sub(self, x: str, regex: str, by: str = "") -> str:
        return f"regexp_replace({x}, {self.lit(regex)}, {self.lit(by)}" + (")" if self.spark else ", 'g')")

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})" if self.spark else f"[{', '.join(xs)}]"

    def map(self, a: str, body: Callable[[str], str], v: str = "v") -> str:
        return f"transform({a}, {v} -> {body(v)})" if self.spark else f"list_transform({a}, lambda {v}: {body(v)})"

    def keep(self, a: str, body: Callable[[str], str], v: str = "k") -> str:
        return f"filter({a}, {v} -> {body(v)})" if self.spark else f"list_filter({a}, lambda {v}: {body(v)})"

    def distinct(self, a: str) -> str:
        """In order of first occurrence."""
        return f"array_distinct({a})" if self.spark else f"list_filter({a}, lambda d, i: list_position({a}, d) = i)"

    def join(self, a: str, by: str) -> str:
        return f"array_join({a}, {self.lit(by)})" if self.spark else f"coalesce(array_to_string({a}, {self.lit(by)}), '')"

    def first(self, a: str, n: int) -> str:
        return f"slice({a}, 1, {n})" if self.spark else f"({a})[1:{n}]"

    def at(self, a: str, i: int) -> str:
        """From 0; null outside."""
        return f"get({a}, {i})" if self.spark else f"({a})[{i + 1}]"

    def size(self, a: str) -> str:
        return f"size({a})" if self.spark else f"len({a})"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, {self.lit(by)}, -1)" if self.spark else f"string_split({x}, {self.lit(by)})"

    def toint(self, x: str) -> str:
        """Truncated toward zero."""
        return f"CAST({x} AS BIGINT)" if self.spark else f"CAST(trunc({x}) AS BIGINT)"

    def div(self, x: str, n: int) -> str:
        return f"({x} DIV {n})" if self.spark else f"({x} // {n})"

    def when_parsed(self, x: str, formats: Iterable[tuple[str, str]]) -> str:
        """The first format that fits, of (Spark pattern, strptime format) pairs; else null."""
        if not self.spark:
            return f"coalesce({', '.join(f'try_strptime({x}, {self.lit(b)})' for _, b in formats)})"
        # A text of another shape is turned away by a regex: a parse that fails is an exception inside Spark.
        return self.let(x, lambda v: f"coalesce({', '.join(f'CASE WHEN {self.matches(v, self._shape(a))} THEN try_to_timestamp({v}, {self.lit(a)}) END' for a, _ in formats)})")

    @staticmethod
    def _shape(pattern: str) -> str:
        parts = {"yyyy": r"[0-9]{4}", "MMM": "[A-Za-z]{3}", "M": "[0-9]{1,2}", "d": "[0-9]{1,2}", "H": "[0-9]{1,2}", "m": "[0-9]{1,2}", "s": "[0-9]{1,2}", "MM": "[0-9]{1,2}", "dd": "[0-9]{1,2}", "HH": "[0-9]{1,2}", "mm": "[0-9]{1,2}", "ss": "[0-9]{1,2}", "'T'": "T"}
        return "^" + re.sub(r"'T'|([A-Za-z])\1*", lambda m: parts[m.group()], pattern) + "$"

    def seconds(self, ts: str) -> str:
        return f"unix_seconds({ts})" if self.spark else f"CAST(floor(epoch({ts})) AS BIGINT)"

    def of_seconds(self, n: str) -> str:
        return f"timestamp_seconds({n})" if self.spark else f"make_timestamp(CAST(({n}) * 1000000 AS BIGINT))"

    def day_text(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd')" if self.spark else f"strftime({ts}, '%Y-%m-%d')"

    def bigint(self, x: str) -> str:
        return f"TRY_CAST({x} AS BIGINT)"

    def nonblank(self, *xs: str) -> str:
        """The first value that isn't blank, else blank."""
        return f"coalesce({', '.join(f'''nullif({x}, '')''' for x in xs)}, '')"

    def cases(self, rules: Iterable[tuple[str, str]], default: str) -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {default} END"

    def first_match(self, x: str, table: Iterable[tuple[str, Iterable[str]]], default: str) -> str:
        """The name of the first (name, words) whose words x holds any of."""
        return self.let(x, lambda v: self.cases(((self.any_of(v, words), self.lit(name)) for name, words in table), default))


SPARK, DUCK = Dialect(True), Dialect(False)


def column(f: Callable[..., str], *args, **options) -> Column:
    """A Spark Column of one of this package's functions over column expressions."""
    return F.expr(f(SPARK, *args, **options))
