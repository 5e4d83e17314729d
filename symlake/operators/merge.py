"""Merging of parser and heuristic results, of flat lists, of relations and of notices.

Several merges here depend on the order of a list and on what was kept of it before. They fold the sorted array of
those rows that can meet at all (of one owner, or file, with one kind and name) with built-in higher-order functions; the
merge of symbol tables, whose lists stay long, goes through sorted rows instead and looks up only lines that are near.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window


def compatible_snippets(a: str, b: str) -> bool:
    """Blank, equal or containing."""
    a, b = a.strip(), b.strip()
    return not a or not b or a in b or b in a


def compatible(a: Column, b: Column) -> Column:
    """compatible_snippets of two columns; null counts as blank."""
    a, b = (F.trim(F.coalesce(x, F.lit(""))) for x in (a, b))
    return (a == "") | (b == "") | F.contains(a, b) | F.contains(b, a)


def close(a: Column, b: Column) -> Column:
    """same_symbol of two structs with line and snippet and the same kind and name."""
    known, apart = (a["line"] > 0) & (b["line"] > 0), F.abs(a["line"] - b["line"])
    return (known & (apart <= 1)) | ((~known | (apart <= 3)) & compatible(a["snippet"], b["snippet"]))


def same_symbol(a, b) -> bool:
    """Same kind and name, at lines that differ by at most 1, or by 2 or 3 (or unknown) with compatible snippets."""
    if (a.kind, a.name) != (b.kind, b.name):
        return False
    known = a.line > 0 and b.line > 0
    apart = abs(a.line - b.line)
    return (known and apart <= 1) or ((not known or apart <= 3) and compatible_snippets(a.snippet, b.snippet))


def merge_symbols(primary: list, secondary: list) -> list:
    """The primary list, filled and extended from the secondary one; members are merged too, and the order kept."""
    out = list(primary)
    known = {(m.kind, m.name, m.line) for s in primary for m in (s, *s.members)}
    for other in secondary:
        match = next((s for s in out if same_symbol(s, other)), None)
        if match is None:
            if (other.kind, other.name, other.line) not in known:
                other.source_mode = other.source_mode or "heuristic"
                out.append(other)
            continue
        match.detail, match.snippet, match.line = match.detail or other.detail, match.snippet or other.snippet, match.line or other.line
        match.calls = list(dict.fromkeys([*match.calls, *other.calls]))
        match.members = merge_symbols(match.members, other.members)
    return out


def merge_flat(primary: DataFrame, secondary: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Union of two flat lists; of rows with one key the first stays, those of the primary list being first."""
    both = primary.withColumn("__side", F.lit(0)).unionByName(secondary.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy(*key).orderBy("__side", *order)
    return both.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__side")


def merge_symbol_tables(primary: DataFrame, secondary: DataFrame, scope: list[str], values: list[str]) -> DataFrame:
    """Symbol tables (scope, kind, name, line, snippet, ord and string columns values) merged by same_symbol.

    The secondary rows are taken in order. Each fills the blank values, snippet and unknown line of the first row of the
    list so far that is the same symbol, be it a primary row or one added before; without one it is added itself.
    The rows of a group stand together in a sorted partition, so a task holds one group at a time.
    """
    key, own = [*scope, "kind", "name"], list(dict.fromkeys(["line", "snippet", "ord", *values]))
    rows = primary.select(*key, *own, F.lit(0).alias("__side")).unionByName(secondary.select(*key, *own, F.lit(1).alias("__side")))
    dealt = rows.repartition(*key).sortWithinPartitions(*key, "__side", "ord", *[c for c in own if c != "ord"])
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]])
    return dealt.mapInArrow(partial(_merge_batches, len(key), own, values, to_arrow_schema(shape)), shape)


class _Merged:
    """The merged list of one group, and where its rows stand: by line, and there by snippet, places ascending."""

    def __init__(self, own: list[str], values: list[str]):
        self.line, self.snippet = own.index("line"), own.index("snippet")
        self.filled = [own.index(c) for c in dict.fromkeys(["snippet", *values])]
        self.clear()

    def clear(self) -> None:
        self.rows: list[list] = []
        self.places: dict[int | None, dict[str, list[int]]] = {}

    def _key(self, row: list) -> tuple[int | None, str]:
        line = row[self.line]
        return line if line is None or line > 0 else 0, (row[self.snippet] or "").strip(" ")

    def _place(self, at: int) -> None:
        line, snippet = self._key(self.rows[at])
        insort(self.places.setdefault(line, {}).setdefault(snippet, []), at)

    def add(self, row: list) -> None:
        self.rows.append(row)
        self._place(len(self.rows) - 1)

    def _found(self, line: int | None, snippet: str) -> int:
        """The first row that `close` allows, or their number; a null line is close to unknown ones alone."""
        best, places = len(self.rows), self.places
        if line:
            for near in (line - 1, line, line + 1):
                if near > 0 and near in places:
                    best = min(best, min(some[0] for some in places[near].values()))
            others = [n for n in (line - 3, line - 2, line + 2, line + 3) if n > 0]
            others.append(0)
        else:
            others = [0] if line is None else list(places)
        for other in others:
            for old, some in places.get(other, {}).items():
                if some[0] < best and (not old or not snippet or old in snippet or snippet in old):
                    best = some[0]
        return best

    def take(self, row: list) -> None:
        """A secondary row fills the first row that is close to it, or is added."""
        at = self._found(*self._key(row))
        if at == len(self.rows):
            self.add(row)
            return
        old = self.rows[at]
        line, snippet = before = self._key(old)
        for c in self.filled:
            if not (old[c] or "").strip(" "):
                old[c] = row[c]
        if line == 0:
            old[self.line] = row[self.line]
        if self._key(old) != before:
            some = self.places[line][snippet]
            some.remove(at)
            if not some:
                del self.places[line][snippet]
                if not self.places[line]:
                    del self.places[line]
            self._place(at)


def _merge_batches(keys: int, own: list[str], values: list[str], schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by group (the first columns), side (the last) and order, merged group by group."""
    merged, group = _Merged(own, values), None
    done: list[tuple] = []
    give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != group:
                done += [(*group, *r) for r in merged.rows]  # type: ignore[misc]
                merged.clear()
                group = row[:keys]
            if row[-1]:
                merged.take(list(row[keys:-1]))
            else:
                merged.add(list(row[keys:-1]))
        if done:
            yield give(done)
            done = []
    if merged.rows:
        yield give([(*group, *r) for r in merged.rows])  # type: ignore[misc]


def dedupe_relations(relations: DataFrame, key: list[str]) -> DataFrame:
    """Of an owner's relations (kind, name, line, snippet, ord) those that repeat one kept before them go.

    A relation repeats another of the same kind and name if both lines are known and at most 1 apart, or if the
    snippets are compatible. What was dropped is compared with nothing.
    """
    group = [*key, "kind", "name"]
    rest = [c for c in relations.columns if c not in (*group, "ord")]
    lists = relations.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("ord", *rest))).alias("rows"))

    def repeats(kept: Column, new: Column) -> Column:
        near = (kept["line"] > 0) & (new["line"] > 0) & (F.abs(kept["line"] - new["line"]) <= 1)
        return near | compatible(kept["snippet"], new["snippet"])

    none = F.slice("rows", 1, 0)
    kept = F.aggregate("rows", none, lambda kept, new: F.when(F.exists(kept, lambda old: repeats(old, new)), kept).otherwise(F.concat(kept, F.array(new))))
    return lists.select(*group, F.explode(kept).alias("r")).select(*[F.col(c) if c in group else F.col(f"r.{c}").alias(c) for c in relations.columns])


def canonical(relations: DataFrame, symbols: DataFrame, scope: list[str]) -> DataFrame:
    """Relations (scope, owner_id, kind, name, line, snippet, ord) as the surviving top-level symbols they mean, with target_id.

    That is the first symbol in order of the same kind and name that same_symbol allows, and its line and snippet
    stand for the relation's; a relation without one stays as it is, with a null. What then repeats goes.
    """
    top = symbols.where("depth = 0").select(*scope, "kind", "name", F.struct(F.col("sym_id"), F.col("line"), F.col("snippet")).alias("t"))
    lists = top.groupBy(*scope, "kind", "name").agg(F.array_sort(F.collect_list("t")).alias("__symbols"))
    meant = F.get(F.filter(F.coalesce("__symbols", F.array().cast(lists.schema["__symbols"].dataType)), lambda t: close(t, F.struct(F.col("line"), F.col("snippet")))), F.lit(0))
    rows = relations.join(lists, [*scope, "kind", "name"], "left").withColumn("__t", meant)
    found = F.col("__t").isNotNull()
    rows = rows.select(*[c for c in relations.columns if c not in ("line", "snippet")], F.when(found, F.col("__t.line")).otherwise(F.col("line")).alias("line"), F.when(found, F.col("__t.snippet")).otherwise(F.col("snippet")).alias("snippet"), F.col("__t.sym_id").alias("target_id"))
    return dedupe_relations(rows, [*scope, "owner_id"])


def provenance(mode: Column, errors: Column) -> Column:
    """Confidence by source mode: ast high, or medium with errors; heuristic and recovered medium; otherwise low."""
    return F.when(mode == "ast", F.when(errors, "medium").otherwise("high")).when(mode.isin("heuristic", "recovered"), "medium").otherwise("low")


def with_notice(notices: Column, severity: str, message: str) -> Column:
    """The list with the notice, once."""
    one = F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"))
    return F.array_distinct(F.concat(notices, F.array(one)))
