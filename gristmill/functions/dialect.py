"""Expressions that are written once and rendered for Spark SQL, the engine, or for DuckDB, its check."""

from __future__ import annotations


class Spark:
    name = "spark"

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"

    def like(self, s: str, pattern: str) -> str:
        """True where the pattern is found."""
        return f"({s} RLIKE {self.lit(pattern)})"

    def sub(self, s: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(to.replace('@', '$'))})"

    def get(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({s}, {self.lit(pattern)}, {group})"

    def split(self, s: str, mark: str) -> str:
        quoted = "".join("\\" + c if c in "|.*+?()[]{}^$\\" else c for c in mark)
        return f"split({s}, {self.lit(quoted)})"

    def join(self, a: str, mark: str) -> str:
        return f"array_join({a}, {self.lit(mark)})"

    def map(self, a: str, v: str, body: str) -> str:
        return f"transform({a}, {v} -> {body})"

    def mapi(self, a: str, v: str, i: str, body: str) -> str:
        """i counts from 1."""
        return f"transform({a}, (x_, i_) -> {body.replace(f'<{v}>', 'x_').replace(f'<{i}>', '(i_ + 1)')})"

    def keep(self, a: str, v: str, body: str) -> str:
        return f"filter({a}, {v} -> {body})"

    def any(self, a: str, v: str, body: str) -> str:
        return f"exists({a}, {v} -> {body})"

    def all(self, a: str, v: str, body: str) -> str:
        return f"forall({a}, {v} -> {body})"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def length(self, s: str) -> str:
        return f"CAST(length({s}) AS BIGINT)"

    def octets(self, s: str) -> str:
        return f"CAST(octet_length({s}) AS BIGINT)"

    def at(self, a: str, i: str) -> str:
        """From 1; null beyond the end."""
        return f"try_element_at({a}, CAST({i} AS INT))"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"slice({a}, CAST({start} AS INT), CAST(greatest({n}, 0) AS INT))"

    def seq(self, n: str) -> str:
        """1 .. n, empty for n < 1."""
        return f"(CASE WHEN {n} >= 1 THEN sequence(1L, CAST({n} AS BIGINT)) ELSE CAST(array() AS ARRAY<BIGINT>) END)"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def cat(self, *a: str) -> str:
        return f"concat({', '.join(a)})"

    def flat(self, a: str) -> str:
        return f"flatten({a})"

    def words(self, *w: str) -> str:
        return f"array({', '.join(self.lit(x) for x in w)})"

    def explode(self, source: str, keep: str, array: str, pos: str, value: str) -> str:
        """A row for each element; positions from 0."""
        return f"(SELECT {keep}, CAST({pos}_ AS BIGINT) AS {pos}, {value} FROM {source} LATERAL VIEW posexplode({array}) AS {pos}_, {value})"

    def last(self, x: str, over: str) -> str:
        return f"last_value({x}) IGNORE NULLS OVER ({over})"

    def ordered(self, x: str, order: str, mark: str) -> str:
        """Strings joined in order."""
        return f"array_join(transform(array_sort(collect_list(struct({order} AS o_, {x} AS x_))), z_ -> z_.x_), {self.lit(mark)})"

    def ordered_list(self, x: str, order: str) -> str:
        return f"transform(array_sort(collect_list(struct({order} AS o_, {x} AS x_))), z_ -> z_.x_)"

    def total(self, a: str) -> str:
        return f"aggregate({a}, 0L, (s_, v_) -> s_ + v_)"

    def div(self, a: str, b: str) -> str:
        """Null for a zero divisor."""
        return f"try_divide(CAST({a} AS DOUBLE), {b})"

    def idiv(self, a: str, b: str) -> str:
        return f"CAST(({a}) DIV ({b}) AS BIGINT)"

    def sha(self, s: str) -> str:
        return f"sha2({s}, 256)"

    def hex24(self, s: str, start: int) -> str:
        """Six hexadecimal digits as a number."""
        return f"CAST(conv(substr({s}, {start}, 6), 16, 10) AS BIGINT)"

    def json(self, s: str, key: str) -> str:
        return f"get_json_object({s}, '$.{key}')"

    def least_words(self, a: str) -> str:
        return f"array_min({a})"


class Duck:
    name = "duck"

    def lit(self, s: str) -> str:
        if "\n" in s or "\t" in s:
            return "E'" + s.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\t", "\\t") + "'"
        return "'" + s.replace("'", "''") + "'"

    def like(self, s, pattern):
        return f"regexp_matches({s}, {self.lit(pattern)})"

    def sub(self, s, pattern, to=""):
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(to.replace('@', chr(92)))}, 'g')"

    def get(self, s, pattern, group=0):
        return f"regexp_extract({s}, {self.lit(pattern)}, {group})"

    def split(self, s, mark):
        return f"string_split({s}, {self.lit(mark)})"

    def join(self, a, mark):
        return f"array_to_string({a}, {self.lit(mark)})"

    def map(self, a, v, body):
        return f"list_transform({a}, lambda {v}: {body})"

    def mapi(self, a, v, i, body):
        return f"list_transform({a}, lambda x_, i_: {body.replace(f'<{v}>', 'x_').replace(f'<{i}>', 'i_')})"

    def keep(self, a, v, body):
        return f"list_filter({a}, lambda {v}: {body})"

    def any(self, a, v, body):
        return f"(len(list_filter({a}, lambda {v}: {body})) > 0)"

    def all(self, a, v, body):
        return f"(len(list_filter({a}, lambda {v}: NOT ({body}))) = 0)"

    def size(self, a):
        return f"CAST(len({a}) AS BIGINT)"

    def length(self, s):
        return f"CAST(length({s}) AS BIGINT)"

    def octets(self, s):
        return f"CAST(strlen({s}) AS BIGINT)"

    def at(self, a, i):
        return f"({a})[{i}]"

    def has(self, a, x):
        return f"list_contains({a}, {x})"

    def slice(self, a, start, n):
        return f"list_slice({a}, {start}, ({start}) + ({n}) - 1)"

    def seq(self, n):
        return f"range(1, CAST({n} AS BIGINT) + 1)"

    def distinct(self, a):
        # in first-seen order, as Spark's
        return f"list_filter({a}, lambda x_, i_: list_position({a}, x_) = i_)"

    def cat(self, *a):
        return f"list_concat({', '.join(a)})" if len(a) > 1 else a[0]

    def flat(self, a):
        return f"flatten({a})"

    def words(self, *w):
        return f"[{', '.join(self.lit(x) for x in w)}]"

    def explode(self, source, keep, array, pos, value):
        return f"(SELECT {keep}, CAST(generate_subscripts({array}, 1) - 1 AS BIGINT) AS {pos}, unnest({array}) AS {value} FROM {source})"

    def last(self, x, over):
        return f"last_value({x} IGNORE NULLS) OVER ({over})"

    def ordered(self, x, order, mark):
        return f"string_agg({x}, {self.lit(mark)} ORDER BY {order})"

    def ordered_list(self, x, order):
        return f"list({x} ORDER BY {order})"

    def total(self, a):
        return f"coalesce(list_sum({a}), 0)"

    def div(self, a, b):
        return f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"

    def idiv(self, a, b):
        return f"CAST(({a}) // ({b}) AS BIGINT)"

    def sha(self, s):
        return f"sha256({s})"

    def hex24(self, s, start):
        return f"CAST(concat('0x', substr({s}, {start}, 6)) AS BIGINT)"

    def json(self, s, key):
        return f"json_extract_string({s}, '$.{key}')"

    def least_words(self, a):
        return f"list_min({a})"


SPARK, DUCK = Spark(), Duck()
