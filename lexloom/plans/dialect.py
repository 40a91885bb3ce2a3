"""One text for two engines: queries are written once against named tables and a few functions that differ.

A query is a function of a dialect; ``t`` names a table of the plan, the rest are expressions.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_count = itertools.count()


class Spark:
    spark = True

    def __init__(self, session: SparkSession, sf_dir: str, tables: dict[str, Callable]) -> None:
        self.session, self.sf_dir, self.tables, self.frames = session, sf_dir, tables, {}
        self._keys = None

    def frame(self, name: str) -> DataFrame:
        if name not in self.frames:
            made = self.tables.get(name)
            self.frames[name] = made(self) if made else self.session.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.frames[name]

    def t(self, name: str) -> str:
        view = f"lexloom_{name}_{next(_count)}"
        self.frame(name).createOrReplaceTempView(view)
        return view

    def keys(self):
        """The lexicon as constants, read once for a plan."""
        if self._keys is None:
            from lexloom.operators import normalize

            words = {r["word"] for name in ("function_words", "hedges") for r in self.frame(name).select("word").distinct().collect()}
            self._keys = normalize.Keys(self.frame("matcher"), self.frame("forbidden"), [w for w in words if w is not None])
        return self._keys

    def size(self, x): return f"size({x})"
    def join(self, x, sep=" "): return f"array_join({x}, '{sep}')"
    def all_of(self, x, by=None, sep=","):
        if by is None:
            return f"array_join(array_sort(collect_list({x})), '{sep}')"
        return f"array_join(transform(array_sort(collect_list(struct({by} as a, {x} as b))), y -> y.b), '{sep}')"
    def set_of(self, x, sep=","): return f"array_join(array_sort(collect_set({x})), '{sep}')"
    def rx(self, x, p): return f"regexp_like({x}, r'{p}')"
    def rx_count(self, x, p): return f"regexp_count({x}, r'{p}')"
    def rx_sub(self, x, p, r): return f"regexp_replace({x}, r'{p}', '{r}')"
    def rx_get(self, x, p, g=1): return f"regexp_extract({x}, r'{p}', {g})"
    def rx_all(self, x, p): return f"regexp_extract_all({x}, r'{p}', 0)"
    def sha(self, x): return f"sha2({x}, 256)"
    def hashed(self, x): return f"cast(conv(substring(md5({x}), 1, 12), 16, 10) AS bigint)"
    def octets(self, x): return f"octet_length({x})"
    def words(self, x): return f"split({x}, ' ')"
    def lam(self, v, body): return f"{v} -> {body}"
    def filter(self, x, v, body): return f"filter({x}, {v} -> {body})"
    def map(self, x, v, body): return f"transform({x}, {v} -> {body})"
    def at(self, x, k): return f"element_at({x}, {k})"
    def has(self, x, y): return f"array_contains({x}, {y})"
    def both(self, x, y): return f"array_intersect({x}, {y})"
    def either(self, x, y): return f"array_union({x}, {y})"
    def minus(self, x, y): return f"array_except({x}, {y})"
    def distinct(self, x): return f"array_distinct({x})"
    def sorted(self, x): return f"array_sort({x})"
    def explode(self, x, name): return f"explode({x}) AS {name}"
    def numbers(self, a, b, name): return f"(SELECT explode(sequence({a}, {b})) AS {name})"
    def median(self, x): return f"median({x})"
    def pstdev(self, x): return f"stddev_pop({x})"
    def int(self, x): return f"cast({x} AS int)"
    def big(self, x): return f"cast({x} AS bigint)"
    def dbl(self, x): return f"cast({x} AS double)"
    def text(self, x): return f"cast({x} AS string)"
    def array(self, *xs): return f"array({', '.join(xs)})"
    def with_(self): return "WITH"
    def recursive(self): return "WITH RECURSIVE"
    def half_even(self, x): return f"cast(rint({x}) AS int)"


class Duck:
    spark = False

    def __init__(self, tables: dict[str, Callable]) -> None:
        self.tables, self.used = tables, {}

    def t(self, name: str) -> str:
        if name in self.tables and name not in self.used:
            self.used[name] = None
            text = self.tables[name](self)
            del self.used[name]
            self.used[name] = text
        return name

    def finish(self, text: str) -> str:
        if not self.used:
            return text
        head = "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in self.used.items())
        text = text.strip()
        for start in ("WITH RECURSIVE", "WITH"):
            if text.startswith(start):
                return f"{head}, {text[len(start):]}"
        return f"{head} {text}"

    def size(self, x): return f"len({x})"
    def join(self, x, sep=" "): return f"array_to_string({x}, '{sep}')"
    def all_of(self, x, by=None, sep=","):
        return f"string_agg({x}, '{sep}' ORDER BY {by if by else x})"
    def set_of(self, x, sep=","): return f"array_to_string(list_sort(list_distinct(list({x}))), '{sep}')"
    def rx(self, x, p): return f"regexp_matches({x}, '{p}')"
    def rx_count(self, x, p): return f"len(regexp_extract_all({x}, '{p}'))"
    def rx_sub(self, x, p, r):
        for k in range(1, 5):
            r = r.replace(f"${k}", f"\\{k}")
        return f"regexp_replace({x}, '{p}', '{r}', 'g')"
    def rx_get(self, x, p, g=1): return f"regexp_extract({x}, '{p}', {g})"
    def rx_all(self, x, p): return f"regexp_extract_all({x}, '{p}')"
    def sha(self, x): return f"sha256({x})"
    def hashed(self, x): return f"cast('0x' || substring(md5({x}), 1, 12) AS bigint)"
    def octets(self, x): return f"strlen({x})"
    def words(self, x): return f"string_split({x}, ' ')"
    def lam(self, v, body): return f"lambda {v}: {body}"
    def filter(self, x, v, body): return f"list_filter({x}, lambda {v}: {body})"
    def map(self, x, v, body): return f"list_transform({x}, lambda {v}: {body})"
    def at(self, x, k): return f"list_extract({x}, {k})"
    def has(self, x, y): return f"list_contains({x}, {y})"
    def both(self, x, y): return f"list_distinct(list_filter({x}, lambda zz: list_contains({y}, zz)))"
    def either(self, x, y): return f"list_distinct(list_concat({x}, {y}))"
    def minus(self, x, y): return f"list_distinct(list_filter({x}, lambda zz: NOT list_contains({y}, zz)))"
    def distinct(self, x): return f"list_distinct({x})"
    def sorted(self, x): return f"list_sort({x})"
    def explode(self, x, name): return f"unnest({x}) AS {name}"
    def numbers(self, a, b, name): return f"(SELECT unnest(range({a}, ({b}) + 1)) AS {name})"
    def median(self, x): return f"median({x})"
    def pstdev(self, x): return f"stddev_pop({x})"
    def int(self, x): return f"cast({x} AS integer)"
    def big(self, x): return f"cast({x} AS bigint)"
    def dbl(self, x): return f"cast({x} AS double)"
    def text(self, x): return f"cast({x} AS varchar)"
    def array(self, *xs): return f"[{', '.join(xs)}]"
    def with_(self): return "WITH"
    def recursive(self): return "WITH RECURSIVE"
    def half_even(self, x): return f"cast(round_even({x}, 0) AS integer)"
