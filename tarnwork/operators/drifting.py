"""Files of JSON records whose fields drift: tagged-union schemas, their changes, and one table of all records.

The schema of a file is a union: each top-level field keeps all JSON types its values have, with their counts. Per-file unions
are built in parallel from typed values (VARIANT) and fused. Between consecutive files of a feed the unions are compared;
a field that has gone is paired with a new one of the same content. The fused union of all files gives the table: one column
per field in its canonical type, and one more per alternative type for the values as they came.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.session import plan_bytes

#: Per-file tables up to this size are broadcast to the scan of the records; larger ones are joined by key.
BROADCAST_BYTES = 32 << 20
#: A gone and a new field are a rename from this likeness on (0 to 1).
RENAME_LIKENESS = 0.6
CHANGE = ["source_file", "change", "field_from", "field_to"]


def _parsed(df: DataFrame, raw: str) -> Column:
    """The record as VARIANT; null if it is no JSON. Of a key that a record repeats the last value counts."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # else such a record would be no JSON at all
    return F.try_parse_json(raw)


def valid_records(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``v``, the record as VARIANT, of the rows whose text is one JSON object; the others are left to
    ``rejected_records``."""
    v = df.select(*keep, _parsed(df, raw).alias("v"))
    return v.where(F.schema_of_variant("v").startswith("OBJECT"))


def rejected_records(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """``keep``, ``raw`` and ``reason`` of the rows that are no record: empty (null or blank) or no_object."""
    v = df.select(*keep, raw, _parsed(df, raw).alias("__v"))
    blank = F.col(raw).isNull() | (F.trim(raw) == "")
    reason = F.when(blank, "empty").when(F.col("__v").isNull() | ~F.schema_of_variant("__v").startswith("OBJECT"), "no_object")
    return v.select(*keep, raw, reason.alias("reason")).where("reason IS NOT NULL")


def json_type(schema: Column) -> Column:
    """string, number, boolean, array or object of a ``schema_of_variant``; null for JSON null."""
    return (
        F.when(schema == "VOID", None)
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .otherwise("number")
    )


def first_deliveries(df: DataFrame, system: str, file: str, ts: str) -> DataFrame:
    """(system, file, ts, k, last): each file's first delivery and its place in its system; ties by name."""
    first = df.where(F.col(system).isNotNull() & F.col(file).isNotNull()).groupBy(F.col(system).alias("system"), F.col(file).alias("file")).agg(F.min(ts).alias("ts"))
    k = F.row_number().over(W.partitionBy("system").orderBy("ts", "file"))
    return first.select("*", k.alias("k"), (k == F.count(F.lit(1)).over(W.partitionBy("system"))).alias("last"))


def _number(type_: Column, text: Column) -> Column:
    """The value as DOUBLE. A failing cast costs an exception, so only what looks like a number is cast."""
    return F.when((type_ == "number") | ((type_ == "string") & text.rlike(r"^[-+]?[0-9.]+([eE][-+]?[0-9]+)?\z")), text.try_cast("double"))


def _kind(type_: Column, schema: Column, text: Column, num: Column) -> Column:
    """What a value is like, coarse and fine, with a tab between: the same content gives the same distribution of these."""
    date = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|20[0-9]{2}[01][0-9][0-3][0-9])([T ][0-9:.Z+]*)?\z"
    decimals = F.when(text.contains("."), F.length(F.substring_index(text, ".", -1))).otherwise(0)
    whole = num == F.floor(num)
    size = F.when(whole & (F.abs(num) < 100), num.cast("int").cast("string")).otherwise(F.concat(F.lit("m"), F.floor(F.log2(F.abs(num) + 1)).cast("string")))
    number = F.concat(F.when(whole & (F.abs(num) < 100), "few").when(whole, "int").otherwise("dec"), F.lit("\t"), F.when(whole, "0").otherwise(F.greatest(decimals, F.lit(2)).cast("string")), F.lit(":"), size)
    masked = F.mask(text, F.lit("A"), F.lit("a"), F.lit("9"))
    shape = F.when(masked.contains("aa"), F.regexp_replace(masked, "a+", "a")).otherwise(masked)
    words = F.when(F.length(text) > 40, F.concat(F.lit("long\t"), F.floor(F.log2(F.length(text))).cast("string"))).otherwise(F.concat(F.when(text.contains(" "), "words").otherwise("code"), F.lit("\t"), shape))
    return (
        F.when(type_ == "boolean", F.concat(F.lit("boolean\t"), text))
        .when(type_ == "object", F.concat(F.lit("object\t"), F.regexp_replace(schema, r": (?:BIGINT|DOUBLE|DECIMAL\([0-9,]+\)|STRING|BOOLEAN|VOID)", "")))
        .when(type_ == "array", F.concat(F.lit("array\t"), F.when(F.length(text) > 40, "long").otherwise(F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), r"\p{L}+", "a"))))
        .when((type_ != "number") & F.octet_length(text).between(8, 40) & text.rlike(date), "date\td")
        .when(num.isNotNull() & ~F.isnan(num), number)
        .otherwise(words)
    )


def file_unions(records: DataFrame, files: DataFrame, system: str, file: str, ts: str) -> DataFrame:
    """One row per file and field with a value: (system, k, file, last, field, n, records, types, type, kinds).

    ``types`` maps JSON type -> count; ``type`` is the most frequent (ties: first by name). Only the first delivery counts.
    """
    small = plan_bytes(files) <= BROADCAST_BYTES
    r = records.select(F.col(system).alias("system"), F.col(file).alias("file"), F.col(ts).alias("ts"), "v")
    r = r.join(F.broadcast(files) if small else files, ["system", "file", "ts"])
    # each record gives its fields and one row without field, which counts the record
    itself = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value")))
    field = F.inline(F.concat(F.map_entries(F.col("v").cast("map<string,variant>")), itself))
    schema, text = F.col("schema"), F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value"))
    vals = r.select("system", "k", field.alias("field", "value")).withColumn("schema", F.schema_of_variant("value"))
    vals = vals.select("system", "k", "field", json_type(schema).alias("type"), schema, text.alias("text"))
    vals = vals.withColumn("num", _number(F.col("type"), F.col("text")))  # on its own: the kind looks at it often
    per = vals.groupBy("system", "k", "field", "type", _kind(F.col("type"), schema, F.col("text"), F.col("num")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    by_type = per.groupBy("system", "k", "field", "type").agg(F.sum("n").alias("n"), F.collect_list(F.struct("kind", "n")).alias("kinds"))
    # JSON nulls have no type and count only where the record itself is counted; a filter on the type before this point
    # would be pushed down to the values and type them once more
    typed = lambda c: F.when(F.col("type").isNotNull(), c)
    union = by_type.groupBy("system", "k", "field").agg(
        F.sum(typed(F.col("n"))).alias("n"),
        F.sum("n").alias("__rows"),
        F.map_from_entries(F.sort_array(F.collect_list(typed(F.struct("type", "n"))))).alias("types"),
        F.min(typed(F.struct((-F.col("n")).alias("n"), F.col("type").alias("type"))))["type"].alias("type"),
        F.flatten(F.collect_list(typed(F.col("kinds")))).alias("kinds"),
    )
    in_file = F.max(F.when(F.col("field").isNull(), F.col("__rows"))).over(W.partitionBy("system", "k"))
    union = union.withColumn("records", in_file).where("field IS NOT NULL AND n > 0").drop("__rows")
    return union.join(files.select("system", "k", "file", "last"), ["system", "k"])


def _likeness(a: Counter, b: Counter, fill_a: float, fill_b: float, name_a: str, name_b: str) -> float:
    """0 to 1: the overlap of the kinds of value, of their coarse kinds, and of how often the field is filled."""
    fine = lambda c: {k: v / sum(c.values()) for k, v in c.items()}

    def overlap(x: dict, y: dict) -> float:
        return sum(min(v, y.get(k, 0)) for k, v in x.items())

    def coarse(c: dict) -> dict:
        out: Counter = Counter()
        for k, v in c.items():
            out[k.split("\t")[0]] += v
        return out

    fa, fb = fine(a), fine(b)
    wide = overlap(coarse(fa), coarse(fb))
    fill = min(fill_a, fill_b) / max(fill_a, fill_b, 1e-9)
    x, y = ("".join(ch for ch in s.lower() if ch.isalnum()) for s in (name_a, name_b))
    it = iter(max(x, y, key=len))
    akin = 0.05 if all(ch in it for ch in min(x, y, key=len)) else 0.0
    return 0.25 * wide + 0.6 * overlap(fa, fb) + 0.15 * fill * (wide > 0.3) + akin


def _pair(pdf: pd.DataFrame) -> pd.DataFrame:
    """Gone and new fields of one file: the best pairs first, each field once."""
    rows = [(r.side, r.field, Counter({k["kind"]: 0 for k in r.kinds}), r.n / max(r.records, 1), r.kinds) for r in pdf.itertuples()]
    for _, _, c, _, kinds in rows:
        for k in kinds:
            c[k["kind"]] += k["n"]
    gone, new = ([x for x in rows if x[0] == s] for s in ("removed", "added"))
    scored = sorted(((-_likeness(g[2], n[2], g[3], n[3], g[1], n[1]), g[1], n[1]) for g in gone for n in new))
    used: set[tuple[str, str]] = set()
    own = (pdf["system"].iloc[0], int(pdf["k"].iloc[0]), pdf["file"].iloc[0])
    out = []
    for s, g, n in scored:
        if -s >= RENAME_LIKENESS and ("g", g) not in used and ("n", n) not in used:
            used |= {("g", g), ("n", n)}
            out.append((*own, "renamed", g, n))
    out += [(*own, "removed", g[1], "") for g in gone if ("g", g[1]) not in used]
    out += [(*own, "added", "", n[1]) for n in new if ("n", n[1]) not in used]
    return pd.DataFrame(out, columns=["system", "k", *CHANGE])


def schema_changes(unions: DataFrame, files: DataFrame) -> DataFrame:
    """(source_file, change, field_from, field_to) of every file against the one before it in its system."""
    return placed_changes(unions, files).select(*CHANGE)


def placed_changes(unions: DataFrame, files: DataFrame) -> DataFrame:
    """``schema_changes`` with the system and the place of the file in it.

    Fields are followed through the files of their system; a file with fields both gone and new is settled by pairing, whose
    input is the fields of one file.
    """
    run = W.partitionBy("system", "field").orderBy("k")
    cols = ["system", "field", "kinds", "n", "records"]
    u = unions.select(*cols, "k", "file", "last", "type", F.lag("k").over(run).alias("pk"), F.lag("type").over(run).alias("pt"), F.lead("k").over(run).alias("nk"))
    follows = F.col("pk").eqNullSafe(F.col("k") - 1)
    retyped = u.where(follows & (F.col("pt") != F.col("type"))).select("system", "k", F.col("file").alias("source_file"), F.lit("retyped").alias("change"), F.col("field").alias("field_from"), F.col("field").alias("field_to"))
    added = u.where((F.col("k") > 1) & ~follows).select(*cols, "k", F.lit("added").alias("side"))
    removed = u.where(~F.col("last") & ~F.col("nk").eqNullSafe(F.col("k") + 1)).select(*cols, (F.col("k") + 1).alias("k"), F.lit("removed").alias("side"))
    moved = added.unionByName(removed).join(files.select("system", "k", "file"), ["system", "k"])
    out = f"system {dict(unions.dtypes)['system']}, k int, " + ", ".join(f"{c} string" for c in CHANGE)
    return retyped.unionByName(moved.groupBy("system", "k").applyInPandas(_pair, out))


def new_alternatives(unions: DataFrame) -> DataFrame:
    """(source_file, field, type, n): types a field has in a file for the first time in its system, past its first file."""
    return _first_seen(unions.select("system", "k", "file", "field", F.explode("types").alias("type", "n")))


_TYPE = re.compile(r"OBJECT<|ARRAY<|>|, |`(?:[^`]|``)*`: |[^,<>:`]+: |[A-Z]+(?:\([0-9, ]+\))?")


def paths_of(schema: str, root: str = "$") -> list[tuple[str, str]]:
    """(path, JSON type) of everything below a value with the text of ``schema_of_variant``; elements of arrays as ``[]``."""
    out, stack = [], [root]
    for m in _TYPE.finditer(schema):
        t = m[0]
        if t == ">":
            stack.pop()
        elif t.endswith(": "):
            name = t[:-2]
            stack[-1] = f"{stack[-1].rsplit(chr(0), 1)[0]}\0.{name[1:-1].replace('``', '`') if name[0] == '`' else name}"
        elif t != ", ":
            kind = {"OBJECT<": "object", "ARRAY<": "array", "STRING": "string", "BOOLEAN": "boolean"}.get(t, "number")
            if t not in ("VOID", "VARIANT"):
                out.append((stack[-1].replace("\0", ""), kind))
            if t == "OBJECT<":
                stack.append(stack[-1].replace("\0", "") + "\0")
            elif t == "ARRAY<":
                stack.append(stack[-1].replace("\0", "") + "[]")
    return out[1:]


def nested_alternatives(records: DataFrame, files: DataFrame, system: str, file: str, ts: str) -> DataFrame:
    """(source_file, field, type, n): as ``new_alternatives``, for the paths below objects and arrays (``a.b``, ``a[].b``).

    Values shrink to their distinct schemas per file and field before any is taken apart; ``n`` counts values that hold the
    path with that type at least once.
    """
    r = records.select(F.col(system).alias("system"), F.col(file).alias("file"), F.col(ts).alias("ts"), "v")
    r = r.join(F.broadcast(files) if plan_bytes(files) <= BROADCAST_BYTES else files, ["system", "file", "ts"])
    vals = r.select("system", "k", "file", F.inline(F.map_entries(F.col("v").cast("map<string,variant>"))).alias("field", "value"))
    per = vals.select("system", "k", "file", "field", F.schema_of_variant("value").alias("schema")).where("schema LIKE 'OBJECT%' OR schema LIKE 'ARRAY%'")
    per = per.groupBy("system", "k", "file", "field", "schema").agg(F.count(F.lit(1)).alias("n"))

    def take_apart(batches):
        for pdf in batches:
            rows = [(x.system, x.k, x.file, path, t, x.n) for x in pdf.itertuples() for path, t in dict.fromkeys(paths_of(x.schema, x.field))]
            yield pd.DataFrame(rows, columns=["system", "k", "file", "field", "type", "n"])

    types = dict(per.dtypes)
    long = per.mapInPandas(take_apart, f"system {types['system']}, k int, file string, field string, type string, n long")
    return _first_seen(long.groupBy("system", "k", "file", "field", "type").agg(F.sum("n").alias("n")))


def _first_seen(long: DataFrame) -> DataFrame:
    first = long.groupBy("system", "field", "type").agg(F.min(F.struct("k", "file", "n")).alias("f"))
    start = F.min("f.k").over(W.partitionBy("system", "field"))
    return first.withColumn("__s", start).where(F.col("f.k") > F.col("__s")).select(F.col("f.file").alias("source_file"), "field", "type", F.col("f.n").alias("n"))


def rename_moves(changes: DataFrame, unions: DataFrame) -> list[tuple[str, str, int, int, str]]:
    """(system, name, first k, last k, column): where the values of names that take part in renames go.

    A rename holds in its system, from its file on; a name that comes back later is a field of its own, as is one that stands
    beside the other in any file of the system (then the rename is not followed). Two fields of a system never share a column,
    so no two names of a file do. ``changes``: of ``schema_changes`` or ``placed_changes``. Driver-side: as large as the
    number of renames times the files of their systems.
    """
    renamed = changes.where("change = 'renamed'")
    if "system" not in changes.columns:
        renamed = renamed.join(unions.select("system", "k", F.col("file").alias("source_file"), F.col("field").alias("field_to")), ["source_file", "field_to"])
    by_system: dict[str, list[tuple[int, str, str]]] = {}
    for r in renamed.select("system", "k", "field_from", "field_to").distinct().collect():
        by_system.setdefault(r.system, []).append((r.k, r.field_from, r.field_to))
    if not by_system:
        return []
    names = renamed.select("system", F.explode(F.array("field_from", "field_to")).alias("field")).distinct()
    files: dict[tuple[str, str], list[int]] = {}
    for r in unions.join(names, ["system", "field"]).select("system", "field", "k").collect():
        files.setdefault((r.system, r.field), []).append(r.k)
    counts = {r.field: r.n for r in unions.join(names.select("field").distinct(), "field").groupBy("field").agg(F.sum("n").alias("n")).collect()}
    out = []
    for system, renames in sorted(by_system.items()):
        own = {n: files.get((system, n), []) for k, *pair in renames for n in pair}
        steps = {n: [(0, (n, 0))] for n in own}  # name -> from which file on it is which field
        for k, x, y in sorted(renames):
            if set(own[x]) & set(own[y]):
                continue
            steps[y].append((k, steps[x][-1][1]))
            steps[x].append((k, (x, k)))
        ranges = [(n, k, (run[i + 1][0] if i + 1 < len(run) else 2**31) - 1, f) for n, run in steps.items() for i, (k, f) in enumerate(run)]
        fields: dict[tuple[str, int], list[str]] = {}
        for n, lo, hi, f in ranges:
            if any(lo <= k <= hi for k in own[n]):
                fields.setdefault(f, []).append(n)
        taken: dict[str, tuple[str, int]] = {}
        column = {}
        for f in sorted(fields, key=lambda f: (len(set(fields[f])), f)):
            best = sorted(set(fields[f]), key=lambda n: (-counts[n], n))
            free = [n for n in best if n not in taken] or [f"{best[0]}_{i}" for i in range(2, 2 + len(fields) + len(own)) if f"{best[0]}_{i}" not in taken]
            column[f] = free[0]
            taken[free[0]] = f
        out += [(system, n, lo, hi, column[f]) for n, lo, hi, f in ranges if f in column]
    return out


def _moves_table(unions: DataFrame, moves: list[tuple[str, str, int, int, str]]) -> DataFrame:
    return unions.sparkSession.createDataFrame(moves, f"system {dict(unions.dtypes)['system']}, field string, lo int, hi int, column string")


def columns_of_files(moves: list[tuple[str, str, int, int, str]], files: DataFrame) -> DataFrame:
    """(system, file, to): per file the columns of the names that moves speak of, as a map."""
    m = _moves_table(files, moves)
    own = files.join(F.broadcast(m), "system").where(F.col("k").between(F.col("lo"), F.col("hi")))
    return own.groupBy("system", "file").agg(F.map_from_entries(F.collect_list(F.struct("field", "column"))).alias("to"))


def canonical_names(changes: DataFrame, unions: DataFrame) -> dict[str, tuple[list[str], dict[str, int], str]]:
    """Column -> (the names of its values, JSON type -> count over all files, what it is). Names joined by renames are one
    field where ``rename_moves`` says so, called by the name with the most values; else a column has the name of its field.
    Driver-side: as large as the number of distinct field names."""
    moves = rename_moves(changes, unions)
    m = F.broadcast(_moves_table(unions, moves))
    u, at = unions.alias("u"), (F.col("u.system") == F.col("m.system")) & (F.col("u.field") == F.col("m.field")) & F.col("u.k").between(F.col("m.lo"), F.col("m.hi"))
    to = F.coalesce("m.column", "u.field").alias("column")
    moved = u.join(m.alias("m"), at, "left").select(to, "u.field", "u.types", "u.kinds")
    per = moved.select("column", "field", F.explode("types").alias("type", "c")).groupBy("column", "field", "type").agg(F.sum("c").alias("c"))
    sort = moved.select("column", F.explode("kinds").alias("x")).groupBy("column", F.substring_index("x.kind", "\t", 1).alias("kind")).agg(F.sum("x.n").alias("c"))
    groups: dict[str, tuple[Counter, Counter, Counter]] = {}
    for r in per.collect():
        names, types, _ = groups.setdefault(r.column, (Counter(), Counter(), Counter()))
        names[r.field] += r.c
        types[r.type] += r.c
    for r in sort.collect():
        groups[r.column][2]["number" if r.kind in ("few", "int", "dec") else r.kind] += r.c
    out = {}
    for column, (names, types, kinds) in groups.items():
        best = min(names, key=lambda x: (-names[x], x))
        what = min(types, key=lambda x: (-types[x], x))
        for k in ("date", "number", "boolean"):
            if kinds[k] > 0.5 * sum(kinds.values()):
                what = k
        out[column] = ([best, *sorted(x for x in names if x != best)], dict(types), what)
    return dict(sorted(out.items()))


def _free(name: str, taken: set[str]) -> str:
    """``name``, with ``_2`` appended until it is not taken; takes it."""
    while name in taken:
        name += "_2"
    taken.add(name)
    return name


def _timestamp(text: Column) -> Column:
    """A date text as TIMESTAMP: ISO forms by a cast, others by the one format that fits, since a format that fails costs an
    exception."""
    at = lambda i, c: F.substring(text, i, 1) == c
    n = F.length(text)
    return (
        F.when(at(5, "-"), text.try_cast("timestamp"))
        .when((n == 10) & at(3, "."), F.try_to_timestamp(text, F.lit("dd.MM.yyyy")))
        .when((n == 10) & at(3, "/"), F.try_to_timestamp(text, F.lit("dd/MM/yyyy")))
        .when((n == 8) & text.rlike(r"^[0-9]{8}\z"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
        .otherwise(F.when(text.rlike(r"^[0-9]{1,2}[./]|^[0-9]{4}"), F.coalesce(F.try_to_timestamp(text, F.lit("d.M.yyyy")), F.try_to_timestamp(text, F.lit("d/M/yyyy")), text.try_cast("timestamp"))))
    )


def _first_of(values: list[Column]) -> Column:
    """The first that is not null; ``coalesce`` would make strings of variants."""
    out = values[-1]
    for v in values[-2::-1]:
        out = F.when(v.isNotNull(), v).otherwise(out)
    return out


def one_table(records: DataFrame, fields: dict[str, tuple[list[str], dict[str, int], str]], keep: list[str], to: str | None = None) -> DataFrame:
    """All valid records: ``keep``, then per field its canonical column and, where types conflict, a branch ``<field>__<type>``
    with the values of that type as they came. Canonical: dates TIMESTAMP, numbers DOUBLE, booleans BOOLEAN, else text
    (arrays and objects as JSON); of a field of texts only, those that do not convert go to ``<field>__string``. A field named as one of ``keep`` gets ``_2`` appended.

    ``to``: a column of ``records`` that maps names to fields in this record's file; other names go to the field of that
    name, else to the first that has it. Should a record hold two names of a field, the second value goes, as it came, to a
    column of its own, ``<field>__of_<name>``.
    """
    home = {n: c for c, (names, _, _) in reversed(fields.items()) for n in names}
    home |= {c: c for c in fields if c in home}
    m = records.select(*keep, *([F.col(to).alias("__to")] if to else []), F.col("v").cast("map<string,variant>").alias("__m"))
    cells, second = [], []
    wanted: dict[str, int] = {}
    shared = Counter(n for names, _, _ in fields.values() for n in names)
    for i, (field, (names, _, _)) in enumerate(fields.items()):
        value = {}
        for n in names:
            own = F.coalesce(F.col("__to")[n], F.lit(home[n])) if to else F.lit(home[n])
            here = F.col(f"__n{wanted.setdefault(n, len(wanted))}")
            value[n] = here if shared[n] == 1 else F.when(own == field, here)
        cells.append(_first_of(list(value.values())).alias(f"__f{i}"))
        for j, n in enumerate(names[1:], 1):
            before = reduce(Column.__or__, (value[x].isNotNull() for x in names[:j]))
            second.append((f"{field}__of_{n}", F.when(before, value[n]).alias(f"__s{len(second)}")))
    # a JSON null is no value
    m = m.select(*keep, *(["__to"] if to else []), *(F.col("__m")[n].alias(f"__n{i}") for n, i in wanted.items()))
    m = m.select(*keep, *(["__to"] if to else []), *(F.when(~F.is_variant_null(c), F.col(c)).alias(c) for c in (f"__n{i}" for i in wanted.values())))
    m = m.select(*keep, *cells, *(c for _, c in second))
    text_of = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    m = m.select(*keep, *(F.when(F.col(f"__f{i}").isNotNull(), F.struct(json_type(F.schema_of_variant(f"__f{i}")).alias("type"), text_of(F.col(f"__f{i}")).alias("text"))).alias(f"__f{i}") for i in range(len(cells))), *(F.when(F.col(f"__s{i}").isNotNull(), text_of(F.col(f"__s{i}"))).alias(f"__s{i}") for i in range(len(second))))
    taken = set(keep)
    out: list[Column] = []
    for i, (field, (_, types, what)) in enumerate(fields.items()):
        text, t = F.col(f"__f{i}.text"), F.col(f"__f{i}.type")
        if what == "date":
            canon = _timestamp(text)
        elif what == "number":
            # a failing cast costs an exception
            canon = F.when((t == "number") | ((t == "string") & text.rlike(r"^[-+]?[0-9.,]+([eE][-+]?[0-9]+)?\z")), F.replace(text, F.lit(","), F.lit(".")).try_cast("double")).when(t == "boolean", F.when(text == "true", 1.0).otherwise(0.0))
        elif what == "boolean":
            canon = text.try_cast("boolean")
        else:
            canon = text
        name = _free(field if field not in keep else f"{field}_2", taken)
        out.append(canon.alias(name))
        if len(types) == 1 and canon is not text and "string" in types:
            out.append(F.when(canon.isNull(), text).alias(_free(f"{name}__string", taken)))  # what does not convert
        if len(types) > 1:
            for alt in sorted(types):
                raw = F.when(t == alt, text)
                out.append((raw.try_cast("double") if alt == "number" else raw.try_cast("boolean") if alt == "boolean" else raw).alias(_free(f"{name}__{alt}", taken)))
    out += [F.col(f"__s{i}").alias(_free(name, taken)) for i, (name, _) in enumerate(second)]
    return m.select(*keep, *out)
