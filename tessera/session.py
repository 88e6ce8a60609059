"""A session that takes SQL text: queries, parameters, batches, DDL and DML with row counts, metadata, cancellation."""

from __future__ import annotations

import datetime
import decimal
import json
import os
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.joins import asof_join
from tessera.operators.match import match_sequence
from tessera.operators.recursion import repeat_union
from tessera.plans import rewrites
from tessera.plans.dml import FileTable
from tessera.plans.frontend import _closing, _split, tokens, translate

#: Options and their defaults.
OPTIONS = {"approximateDistinctCount": False, "defaultNullCollation": "HIGH", "caseSensitive": False, "timeZone": "UTC", "schema": None, "model": None, "dual": True}


class Engine:
    """SQL over a Spark session. Tables are temporary views of it, or file tables where they take DML."""

    def __init__(self, spark: SparkSession, **options: Any):
        unknown = set(options) - set(OPTIONS)
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        self.spark, self.options = spark, OPTIONS | options
        self.tables: dict[str, FileTable] = {}
        self.views: dict[str, str] = {}
        self.modifiable: dict[str, tuple[str, dict[str, Any]]] = {}
        self.observers: list[Callable[[str, DataFrame], None]] = []
        self.hooks: dict[str, list[Callable[[Any], None]]] = {"parse": [], "text": [], "plan": []}
        self.measures: dict[str, list[str]] = {}
        self.tag = f"tessera-{uuid.uuid4().hex}"
        spark.conf.set("spark.sql.session.timeZone", self.options["timeZone"])
        spark.conf.set("spark.sql.caseSensitive", str(self.options["caseSensitive"]).lower())
        if self.options["dual"]:
            spark.sql("SELECT 'X' AS DUMMY").createOrReplaceTempView("DUAL")
        if self.options["model"]:
            self.load_model(self.options["model"])

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def load_model(self, model: str) -> None:
        """A model as JSON text or a file of it: schemas with tables of type parquet, csv, json (path), values (rows) or view (sql)."""
        if not model.lstrip().startswith("{"):
            if not os.path.exists(model):
                raise FileNotFoundError(model)
            with open(model) as f:
                model = f.read()
        for schema in json.loads(model).get("schemas", []):
            for table in schema.get("tables", []):
                kind = table.get("type", "parquet")
                if kind == "view":
                    sql = table["sql"]
                    self.create_view(table["name"], " ".join(sql) if isinstance(sql, list) else sql, table.get("modifiable"))
                elif kind == "values":
                    self.register(table["name"], self.spark.createDataFrame([tuple(r) for r in table["rows"]], table["columns"]))
                else:
                    read = self.spark.read.format(kind).options(**table.get("options", {}))
                    self.register(table["name"], read.load(table["path"]))

    def create_view(self, name: str, sql: str, modifiable: dict[str, Any] | None = None) -> None:
        """A view that sees its tables as they are when it is read. modifiable: columns with the value that rows inserted through it get."""
        self.views[name.upper()] = sql
        self._query(sql).createOrReplaceTempView(name)
        if modifiable is not None:
            source = next(t for t in self.tables if t in (x.strip("`").upper() for x in tokens(sql)))
            self.modifiable[name.upper()] = (source, modifiable)

    def _query(self, sql: str | list[str], args: list | None = None) -> DataFrame:
        t = tokens(sql) if isinstance(sql, str) else sql
        self._tell("parse", t)
        t = self._staged(t, args)
        high = self.options["defaultNullCollation"] == "HIGH"
        if self.options["approximateDistinctCount"]:
            t = _approximate(t)
        run = lambda text: self.spark.sql(text, args=args) if args else self.spark.sql(text)
        shown = rewrites.measures(t, self.measures)
        text = translate(shown, high, self.measures)
        if [x.upper() for x in shown].count("EXISTS") > 1:
            try:
                run(text)
            except AnalysisException:  # Spark has no references over two levels
                shown = rewrites.flat_exists(shown)
                text = translate(shown, high, self.measures)
        if any(x == "/" or x.upper() in ("AVG", "SUM") for x in shown):
            t = rewrites.integer_arithmetic(shown, lambda marked: run(translate(marked, high, self.measures)))
            text = translate(t, high, self.measures)
        self._tell("text", text)
        df = run(text)
        self._tell("plan", df)
        for see in self.observers:
            see(text, df)
        return df

    def hook(self, stage: str, see: Callable[[Any], None]) -> None:
        """Have see called for each query: with its tokens (parse), with the text that Spark gets (text), or with the planned DataFrame (plan)."""
        self.hooks[stage].append(see)

    def _tell(self, stage: str, what: Any) -> None:
        for see in self.hooks[stage]:
            see(what)

    # ---- what a DataFrame operator answers, put into the text as a view

    def _view(self, df: DataFrame) -> str:
        name = f"__tessera_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(name)
        return name

    def _staged(self, t: list[str], args: list | None) -> list[str]:
        words = {x.upper() for x in t}
        if "EXCLUDE" in words:
            t = rewrites.excluded_frames(t)
        if "RECURSIVE" in words:
            t = self._recursive(t, args)
        if "MATCH_RECOGNIZE" in words:
            t = self._matched(t, args)
        if "ASOF" in words and not args:
            t = self._nearest(t)
        return t

    def _recursive(self, t: list[str], args: list | None) -> list[str]:
        """WITH RECURSIVE c AS (seed UNION step): UNION, which drops rows that were there before, by repeat_union; UNION ALL is Spark's own."""
        if [x.upper() for x in t[:2]] != ["WITH", "RECURSIVE"]:
            return t
        i, kept = 2, []
        while True:
            name, columns = t[i], None
            i += 1
            if t[i] == "(":
                j = _closing(t, i)
                columns, i = [c[0].strip("`") for c in _split(t[i + 1 : j])], j + 1
            j = _closing(t, i + 1)
            body = t[i + 2 : j]
            at = _union(body)
            if at is not None and name.upper() in (x.upper() for x in body[at:]):
                if args:
                    raise NotImplementedError("parameters in a query with WITH RECURSIVE .. UNION")
                head = ["WITH", *(y for k, c in enumerate(kept) for y in ([","] if k else []) + c)] if kept else []
                seed = self._query([*head, *body[:at]])
                seed = seed.toDF(*columns) if columns else seed

                def step(rows: DataFrame, head=head, body=body, at=at, name=name) -> DataFrame:
                    view = self._view(rows)
                    return self._query(_renamed([*head, *body[at + 1 + (body[at + 1].upper() == "DISTINCT") :]], name, view))

                t = t[: j + 1] + _renamed(t[j + 1 :], name, self._view(repeat_union(seed, step)))
            else:
                recursive = ["RECURSIVE"] if name.upper() in (x.upper() for x in body) else []
                kept.append([*recursive, name, *(["(", *(y for k, c in enumerate(columns) for y in ([","] if k else []) + [f"`{c}`"]), ")"] if columns else []), "AS", "(", *body, ")"])
            i = j + 1
            if i < len(t) and t[i] == ",":
                i += 1
                continue
            break
        rest = t[i:]
        if not kept:
            return rest
        recursive = any(c[0] == "RECURSIVE" for c in kept)
        kept = [c[1:] if c[0] == "RECURSIVE" else c for c in kept]
        return ["WITH", *(["RECURSIVE"] if recursive else []), *(y for k, c in enumerate(kept) for y in ([","] if k else []) + c), *rest]

    def _matched(self, t: list[str], args: list | None) -> list[str]:
        """x MATCH_RECOGNIZE (PARTITION BY .. ORDER BY .. MEASURES .. PATTERN (A B ..) DEFINE ..) by match_sequence."""
        i = next(k for k, x in enumerate(t) if x.upper() == "MATCH_RECOGNIZE")
        j = _closing(t, i + 1)
        start, depth = i, 0
        while start and not (depth == 0 and t[start - 1].upper() in ("FROM", "JOIN", ",")):
            start -= 1
            depth += (t[start] == ")") - (t[start] == "(")
        parts = _parts(t[i + 2 : j])
        rows = self._query(["SELECT", "*", "FROM", *t[start:i]], args)
        pattern = [x.strip("`") for x in parts["PATTERN"][1:-1]]
        if any(not x[0].isalpha() and x[0] != "_" for x in pattern):
            raise NotImplementedError("a pattern of more than symbols one after the other")
        if [x.upper() for x in parts.get("AFTER", [])] not in ([], ["MATCH", "SKIP", "PAST", "LAST", "ROW"]):
            raise NotImplementedError("MATCH_RECOGNIZE other than AFTER MATCH SKIP PAST LAST ROW")
        keys = [k[-1].strip("`") for k in _split(parts.get("PARTITION", []))] if parts.get("PARTITION") else []
        order = [F.expr(translate(o)) if o[-1].upper() not in ("ASC", "DESC") else getattr(F.expr(translate(o[:-1])), o[-1].lower())() for o in _split(parts["ORDER"])]
        measures = {}
        for m in _split(parts["MEASURES"]):
            source = m[: next(k for k, x in enumerate(m) if x.upper() == "AS")]
            if len(source) == 6 and source[0].upper() in ("FIRST", "LAST", "FINAL", "RUNNING"):
                source = source[2:5]
            if len(source) != 3 or source[1] != ".":
                raise NotImplementedError(f"measure {' '.join(source)}")
            measures[m[-1].strip("`")] = (source[0].strip("`"), source[2].strip("`"))
        define = {d[0].strip("`"): _condition(d[2:], pattern, d[0].strip("`"), rows.columns) for d in _split(parts.get("DEFINE", [])) if d}
        found = match_sequence(rows, keys, order, pattern, define, measures)
        return self._staged([*t[:start], self._view(found), *t[j + 1 :]], args)

    def _nearest(self, t: list[str]) -> list[str]:
        """FROM l a [LEFT] ASOF JOIN r b MATCH_CONDITION a.x >= b.y ON a.k = b.k by asof_join, whose rows stand in the text as structs a and b.

        That serves columns written with their table's name, of two plain sources; all else stays a lateral sub-query.
        """
        i = next((k for k in range(len(t) - 1) if t[k].upper() == "ASOF" and t[k + 1].upper() == "JOIN"), None)
        if i is None:
            return t
        how = "left" if t[i - 1].upper() == "LEFT" else "inner"
        end = i - (how == "left")
        begin = max((k for k in range(end) if t[k].upper() == "FROM"), default=None)
        if begin is None:
            return t
        left, j = t[begin + 1 : end], i + 2
        if t[j] == "(":
            j = _closing(t, j)
        match = next(k for k in range(j, len(t)) if t[k].upper() == "MATCH_CONDITION")
        right = t[i + 2 : match]
        on = next(k for k in range(match, len(t)) if t[k].upper() == "ON")
        stop = next((k for k in range(on, len(t)) if t[k].upper() in ("WHERE", "ORDER", "GROUP", "LIMIT", "HAVING", "UNION", ")", "FETCH", "OFFSET", ";")), len(t))
        names = []
        for side in (left, right):
            side = [x for x in side if x.upper() != "AS"]
            if not (len(side) == 2 and side[0] != "(") and not (side[:1] == ["("] and _closing(side, 0) == len(side) - 2):
                return t
            names.append(side[-1])
        a, b = (x.strip("`").upper() for x in names)
        condition = t[match + 1 : on]
        condition = condition[1:-1] if condition[:1] == ["("] else condition
        test = _sides(condition, a, b)
        pairs = [_sides(part, a, b) for part in _conjuncts(t[on + 1 : stop])]
        if test is None or None in pairs or any(op != "=" for _, op, _ in pairs) or test[1] not in ("<", "<=", ">", ">="):
            return t
        frames = [self._query(["SELECT", "*", "FROM", *side]) for side in (left, right)]
        flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
        joined = asof_join(frames[0], frames[1], [(x, y) for x, _, y in pairs], (test[0], test[2]), flip[test[1]], how, prefix="__r_")
        n = len(frames[0].columns)
        flat = joined.toDF(*(f"c{k}" for k in range(len(joined.columns))))
        structs = (F.struct(*(F.col(f"c{k + off}").alias(c) for k, c in enumerate(f.columns))).alias(x.strip("`")) for f, off, x in zip(frames, (0, n), names, strict=True))
        rewritten = [*t[: begin + 1], self._view(flat.select(*structs)), *t[stop:]]
        try:
            self.spark.sql(translate(rewritten))
        except AnalysisException:
            return t
        return rewritten

    def observe(self, see: Callable[[str, DataFrame], None]) -> None:
        """Have see(text for Spark, DataFrame) called for each query that is planned; plans are in df._jdf.queryExecution()."""
        self.observers.append(see)

    def _refresh_views(self) -> None:
        for name, sql in self.views.items():
            self._query(sql).createOrReplaceTempView(name)

    def execute(self, sql: str, args: list | None = None) -> DataFrame:
        """The rows of a query; of a statement, one row with its count."""
        words = [t.upper() for t in tokens(sql)[:2]]
        if words and words[0] in ("SELECT", "WITH", "VALUES", "TABLE", "("):
            return self._query(sql, args)
        if words and words[0] == "EXPLAIN":
            rest = tokens(sql)[1:]
            rest = rest[2:] if [x.upper() for x in rest[:2]] == ["PLAN", "FOR"] else rest
            modes = {"LOGICAL": "EXTENDED", "EXTENDED": "EXTENDED", "COST": "COST", "CODEGEN": "CODEGEN", "FORMATTED": "FORMATTED"}
            mode = "FORMATTED"
            if [x.upper() for x in rest[:1]] != ["SELECT"] and rest[0].upper() in modes:
                mode, rest = modes[rest[0].upper()], rest[1:]
            return self.spark.sql(f"EXPLAIN {mode} " + translate(self._staged(rest, args), measures=self.measures))
        return self.spark.createDataFrame([(self.execute_non_query(sql, args),)], "ROWCOUNT long")

    def scalar(self, sql: str, args: list | None = None) -> Any:
        """The first column of the first row, or None."""
        row = self.execute(sql, args).first()
        return None if row is None else row[0]

    def rows(self, sql: str, args: list | None = None) -> Iterator[Row]:
        """Rows as they come, a partition at a time; cancel() from elsewhere stops them."""
        context = self.spark.sparkContext
        context.addJobTag(self.tag)  # a property of the jobs, which the iterator's own thread inherits
        try:
            yield from self.execute(sql, args).toLocalIterator(prefetchPartitions=True)
        finally:
            context.removeJobTag(self.tag)

    def cancel(self) -> None:
        """Stop the jobs of all reads that rows() has begun; who reads gets an error."""
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def batch(self, statements: list[str]) -> list[DataFrame]:
        """Results of the statements, run one after the other."""
        return [self.execute(s) for s in statements]

    def begin(self) -> None:
        raise NotImplementedError("transactions aren't supported")

    def execute_non_query(self, sql: str, args: list | None = None) -> int:
        """-1 for queries, 0 for DDL, and the number of rows for DML."""
        t = tokens(sql)
        if t and t[-1] == ";":
            t = t[:-1]
        words = [x.upper() for x in t]
        name = lambda i: t[i].strip("`")
        if words[0] in ("SELECT", "WITH", "VALUES"):
            self._query(sql, args)
            return -1
        if words[:2] == ["CREATE", "SCHEMA"]:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {t[-1]}")
            return 0
        if words[:2] == ["CREATE", "TABLE"]:
            i = 2 + 3 * (words[2:5] == ["IF", "NOT", "EXISTS"])
            if "AS" in words[i + 1 : i + 2]:
                rows = self._query(" ".join(t[i + 2 :]))
                self.create_table(name(i), rows.schema).insert(rows)
                return 0
            fields = _split(t[i + 2 : _closing(t, i + 1)])
            self.create_table(name(i), T.StructType([T.StructField(f[0].strip("`"), _type(f[1:])) for f in fields]))
            return 0
        if words[0] == "CREATE" and "VIEW" in words[:4]:
            i = words.index("VIEW") + 1
            body = words.index("AS", i)
            if "OR" not in words[:3] and name(i).upper() in self.views:
                raise ValueError(f"view {name(i)} is there already")
            columns = [c[0].strip("`") for c in _split(t[i + 2 : body - 1])] if body > i + 1 else None
            text = " ".join(t[body + 1 :])
            self.create_view(name(i), text if columns is None else f"SELECT * FROM ({text}) AS v({', '.join(columns)})")
            return 0
        if words[:2] in (["DROP", "VIEW"], ["DROP", "TABLE"]):
            kept = self.views if words[1] == "VIEW" else self.tables
            if name(-1).upper() not in kept and "EXISTS" not in words:
                raise ValueError(f"there is no {words[1].lower()} {name(-1)}")
            kept.pop(name(-1).upper(), None)
            self.spark.catalog.dropTempView(name(-1))
            return 0
        n = self._change(t, words, args)
        self._refresh_views()
        return n

    def create_table(self, name: str, schema: T.StructType) -> FileTable:
        if name.upper() in self.tables:
            raise ValueError(f"table {name} is there already")
        self.tables[name.upper()] = FileTable(self.spark, name, schema)
        return self.tables[name.upper()]

    def _table(self, name: str) -> FileTable:
        try:
            return self.tables[name.strip("`").upper()]
        except KeyError:
            raise ValueError(f"{name} is not a table that can be changed") from None

    def _change(self, t: list[str], words: list[str], args: list | None) -> int:
        expr = lambda x: F.expr(translate(" ".join(x)))
        if words[:2] == ["INSERT", "INTO"]:
            target, i = t[2], 3
            columns = None
            if t[i] == "(" and words[i + 1] not in ("SELECT", "VALUES"):
                columns = [c[0].strip("`") for c in _split(t[i + 1 : _closing(t, i)])]
                i = _closing(t, i) + 1
            rows = self._query(" ".join(t[i:]), args)
            if target.strip("`").upper() in self.modifiable:
                source, fixed = self.modifiable[target.strip("`").upper()]
                columns = columns or [c for c in self.spark.table(target.strip("`")).columns if c not in fixed]
                rows = rows.toDF(*columns).withColumns({k: F.lit(v) for k, v in fixed.items()})
                return self._table(source).insert(rows, rows.columns)
            return self._table(target).insert(rows, columns)
        if args:
            t = _with_values(t, args)
            words = [x.upper() for x in t]
        where = words.index("WHERE") if "WHERE" in words else len(t)
        if words[0] == "UPDATE":
            values = {p[0].strip("`"): expr(p[2:]) for p in _split(t[3:where])}
            return self._table(t[1]).update(values, expr(t[where + 1 :]) if where < len(t) else None)
        if words[:2] == ["DELETE", "FROM"]:
            return self._table(t[2]).delete(expr(t[where + 1 :]) if where < len(t) else None)
        if words[:2] == ["MERGE", "INTO"]:
            return self._merge(t, words)
        raise ValueError(f"unknown statement: {' '.join(t[:3])} ...")

    def _merge(self, t: list[str], words: list[str]) -> int:
        """MERGE INTO t [a] USING s [b] ON a.x = b.x [AND ...] WHEN MATCHED THEN UPDATE SET c = b.d, ... WHEN NOT MATCHED THEN INSERT ..."""
        using, on = words.index("USING"), words.index("ON")
        source = " ".join(t[using + 1 : _closing(t, using + 1) + 1]) if t[using + 1] == "(" else t[using + 1]
        rows = self._query(f"SELECT * FROM {source}")
        whens = [i for i, w in enumerate(words) if w == "WHEN"] + [len(t)]
        keys = []
        for part in " ".join(t[on + 1 : whens[0]]).replace("(", " ").replace(")", " ").split(" AND "):
            a, b = (x.strip().rpartition(".")[2].strip(" `") for x in part.split("="))
            if a != b:
                rows = rows.withColumn(a, F.col(b))
            keys.append(a)
        update, insert = None, False
        for a, b in zip(whens[:-1], whens[1:], strict=True):
            if words[a + 1] == "MATCHED":
                update = {p[: p.index("=")][-1].strip("`"): p[-1].strip("`") for p in _split(t[words.index("SET", a) + 1 : b])}
            else:
                insert = True
        return self._table(t[2]).merge(rows, keys, update, insert)

    def schema(self, collection: str = "Tables") -> DataFrame:
        """Metadata as rows: MetaDataCollections names the collections."""
        kinds = {"MetaDataCollections", "Restrictions", "DataSourceInformation", "Tables", "Columns", "DataTypes", "ReservedWords"}
        if collection == "MetaDataCollections":
            return self.spark.createDataFrame([(k,) for k in sorted(kinds)], "CollectionName string")
        if collection == "Restrictions":
            return self.spark.createDataFrame([("Tables", "TABLE_NAME", 1), ("Columns", "TABLE_NAME", 1), ("Columns", "COLUMN_NAME", 2)], "CollectionName string, RestrictionName string, RestrictionNumber int")
        if collection == "DataSourceInformation":
            return self.spark.createDataFrame([("Spark", self.spark.version, "?", '"', not self.options["caseSensitive"])], "ProductName string, Version string, ParameterMarker string, Quote string, IgnoresCase boolean")
        if collection == "DataTypes":
            return self.spark.createDataFrame(sorted(TYPES.items()), "TypeName string, SparkType string")
        if collection == "ReservedWords":
            return self.spark.sql("SELECT keyword AS ReservedWord FROM sql_keywords()")
        tables = [x.name for x in self.spark.catalog.listTables()]
        if collection == "Tables":
            return self.spark.createDataFrame([(x, "VIEW" if x.upper() in self.views else "TABLE") for x in tables], "TABLE_NAME string, TABLE_TYPE string")
        if collection == "Columns":
            rows = [(x, f.name, i + 1, f.dataType.simpleString(), f.nullable) for x in tables for i, f in enumerate(self.spark.table(x).schema.fields)]
            return self.spark.createDataFrame(rows, "TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int, DATA_TYPE string, IS_NULLABLE boolean")
        raise ValueError(f"unknown collection {collection!r}")


#: SQL types and what they are in Spark.
TYPES = {
    "BOOLEAN": "boolean", "TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "INT": "int", "BIGINT": "bigint", "REAL": "float", "FLOAT": "double",
    "DOUBLE": "double", "DECIMAL": "decimal(38,10)", "CHAR": "string", "VARCHAR": "string", "BINARY": "binary", "VARBINARY": "binary", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
}


def _type(words: list[str]) -> T.DataType:
    kind = words[0].upper()
    if kind not in TYPES:
        raise ValueError(f"unknown type {kind}")
    if kind == "DECIMAL" and len(words) > 1 and words[1] == "(":
        return T._parse_datatype_string("decimal(" + "".join(words[2 : words.index(")")]) + ")")
    return T._parse_datatype_string(TYPES[kind])


def _approximate(t: list[str]) -> list[str]:
    """COUNT(DISTINCT x) as a sketch's estimate."""
    out, i = [], 0
    while i < len(t):
        if [x.upper() for x in t[i : i + 3]] == ["COUNT", "(", "DISTINCT"] and len(_split(t[i + 3 : _closing(t, i + 1)])) == 1:
            out += ["approx_count_distinct", "("]
            i += 3
            continue
        out.append(t[i])
        i += 1
    return out


def _union(body: list[str]) -> int | None:
    """Place of a UNION that isn't UNION ALL, outside brackets."""
    depth = 0
    for i, x in enumerate(body):
        depth += (x == "(") - (x == ")")
        if depth == 0 and x.upper() == "UNION":
            return None if body[i + 1].upper() == "ALL" else i
    return None


def _renamed(t: list[str], name: str, to: str) -> list[str]:
    """t with the table `name` read from `to`, under its own name."""
    out = []
    for i, x in enumerate(t):
        if x.strip("`").upper() == name.strip("`").upper() and i and t[i - 1].upper() in ("FROM", "JOIN", ",", "TABLE"):
            after = t[i + 1] if i + 1 < len(t) else ""
            plain = not after or after.upper() in _AFTER_TABLE or not (after[0].isalpha() or after[0] in "_`")
            out += [to, *(["AS", x] if plain and after != "." else [])]
        else:
            out.append(x)
    return out


_AFTER_TABLE = set("WHERE GROUP ORDER HAVING LIMIT OFFSET FETCH JOIN INNER LEFT RIGHT FULL CROSS ON UNION INTERSECT EXCEPT NATURAL ASOF USING WINDOW".split())


def _parts(t: list[str]) -> dict[str, list[str]]:
    """Clauses of MATCH_RECOGNIZE by their first word."""
    heads = {"PARTITION": 2, "ORDER": 2, "MEASURES": 1, "ONE": 1, "ALL": 1, "AFTER": 1, "PATTERN": 1, "DEFINE": 1}
    out: dict[str, list[str]] = {}
    now, depth, i = None, 0, 0
    while i < len(t):
        x = t[i].upper()
        if depth == 0 and x in heads and not (x in ("ONE", "ALL") and now == "DEFINE"):
            now = "ROWS" if x in ("ONE", "ALL") else x
            if x == "ALL":
                raise NotImplementedError("ALL ROWS PER MATCH")
            out[now] = []
            i += heads[x]
            continue
        depth += (x == "(") - (x == ")")
        out[now].append(t[i])
        i += 1
    return out


def _condition(t: list[str], pattern: list[str], symbol: str, columns: list[str]) -> tuple[str, dict[str, tuple[str, int]]]:
    """A DEFINE condition as text over names that stand for a column of a row so many places from the symbol's own: other symbols'
    columns, PREV and NEXT."""
    known = {c.upper(): c for c in columns}
    own = pattern.index(symbol)
    places: dict[str, tuple[str, int]] = {}
    out, i = [], 0

    def put(column: str, offset: int) -> str:
        name = f"__at{offset}_{known[column.strip('`').upper()]}".replace("-", "m")
        places[name] = (known[column.strip("`").upper()], offset)
        return f"`{name}`"

    while i < len(t):
        word, offset, ref, j = t[i].upper(), 0, t[i : i + 1], i
        if word in ("PREV", "NEXT") and i + 1 < len(t) and t[i + 1] == "(":
            j = _closing(t, i + 1)
            inner = _split(t[i + 2 : j])
            offset, ref = int(inner[1][0]) if len(inner) > 1 else 1, inner[0]
            offset = -offset if word == "PREV" else offset
        elif i + 2 < len(t) and t[i + 1] == ".":
            ref, j = t[i : i + 3], i + 2
        if len(ref) == 3 and ref[1] == "." and ref[0].strip("`") in pattern and ref[2].strip("`").upper() in known:
            out.append(put(ref[2], pattern.index(ref[0].strip("`")) - own + offset))
        elif len(ref) == 1 and ref[0].strip("`").upper() in known:
            out.append(put(ref[0], offset))
        else:
            out += t[i : j + 1]
        i = j + 1
    return translate(out), places


def _conjuncts(t: list[str]) -> list[list[str]]:
    if t[:1] == ["("] and _closing(t, 0) == len(t) - 1:
        return _conjuncts(t[1:-1])
    out: list[list[str]] = [[]]
    depth = 0
    for x in t:
        depth += (x == "(") - (x == ")")
        if depth == 0 and x.upper() == "AND":
            out.append([])
        else:
            out[-1].append(x)
    return out


def _sides(t: list[str], a: str, b: str) -> tuple[str, str, str] | None:
    """a.x op b.y as (x, op, y), turned round where b stands first."""
    if len(t) != 7 or t[1] != "." or t[5] != ".":
        return None
    first, second = t[0].strip("`").upper(), t[4].strip("`").upper()
    x, op, y = t[2].strip("`"), t[3], t[6].strip("`")
    if (first, second) == (a, b):
        return x, op, y
    turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
    return (y, turned.get(op, op), x) if (first, second) == (b, a) else None


def _with_values(t: list[str], args: list) -> list[str]:
    """t with each ? as a literal."""
    values, out = iter(args), []
    for x in t:
        out += tokens(_literal(next(values))) if x == "?" else [x]
    if next(values, None) is not None:
        raise ValueError("more parameters than marks")
    return out


def _literal(v: Any) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)"
    if isinstance(v, decimal.Decimal):
        return f"CAST('{v}' AS DECIMAL(38,{max(0, -v.as_tuple().exponent)}))"
    if isinstance(v, datetime.datetime):
        return f"CAST('{v.isoformat(' ')}' AS TIMESTAMP)"
    if isinstance(v, datetime.date):
        return f"CAST('{v.isoformat()}' AS DATE)"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    raise TypeError(f"a parameter of type {type(v).__name__}")
