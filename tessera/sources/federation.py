"""Other databases, with as much of a query as they can answer sent to them as one text in their own dialect.

A Remote is a relational expression over one database: filters, projections, joins, aggregates, sorts, limits, set operations and
values compose into one SELECT, which read() sends. What joins two databases, or calls a user function, runs in Spark over what each side sent.
"""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from tessera.plans import rewrites
from tessera.plans.frontend import tokens


@dataclasses.dataclass(frozen=True)
class Dialect:
    """What a product writes its own way."""

    name: str
    quote: tuple[str, str] = ('"', '"')
    #: LIMIT n OFFSET m, OFFSET m ROWS FETCH NEXT n ROWS ONLY, or TOP (n) where there is no offset.
    paging: str = "limit"
    concat: str = "||"
    boolean: tuple[str, str] = ("TRUE", "FALSE")
    #: Joins, set operations and clauses that the product lacks: these parts run in Spark.
    lacks: frozenset[str] = frozenset()
    nulls_clause: bool = True

    def identifier(self, name: str) -> str:
        a, b = self.quote
        return ".".join(a + p.replace(b, b * 2) + b for p in name.split("."))

    def literal(self, v: Any) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return self.boolean[not v]
        if isinstance(v, int | float | decimal.Decimal):
            return repr(v) if isinstance(v, float) else str(v)
        if isinstance(v, datetime.datetime):
            return f"TIMESTAMP '{v.isoformat(' ')}'" if self.name not in ("sqlite", "sqlserver") else f"'{v.isoformat(' ')}'"
        if isinstance(v, datetime.date):
            return f"DATE '{v.isoformat()}'" if self.name not in ("sqlite", "sqlserver") else f"'{v.isoformat()}'"
        if isinstance(v, bytes):
            return f"X'{v.hex()}'" if self.name != "sqlserver" else f"0x{v.hex()}"
        return "'" + str(v).replace("'", "''") + "'"

    def page(self, sql: str, limit: int | None, offset: int, ordered: bool) -> str:
        if limit is None and not offset:
            return sql
        if self.paging == "limit":
            many = f" LIMIT {limit}" if limit is not None else " LIMIT -1" if self.name == "sqlite" else ""
            return sql + many + (f" OFFSET {offset}" if offset else "")
        if self.paging == "top" and not offset:
            return re.sub(r"^SELECT ", f"SELECT TOP ({limit}) ", sql, count=1)
        order = "" if ordered else " ORDER BY (SELECT NULL)" if self.name == "sqlserver" else ""
        return f"{sql}{order} OFFSET {offset} ROWS" + (f" FETCH NEXT {limit} ROWS ONLY" if limit is not None else "")


_FULL = frozenset({"FULL", "RIGHT"})
#: By product name; dialect() also tells versions apart.
DIALECTS = {
    "ansi": Dialect("ansi", paging="fetch"),
    "sqlite": Dialect("sqlite", boolean=("1", "0"), lacks=frozenset({"INTERSECT ALL", "EXCEPT ALL"})),
    "duckdb": Dialect("duckdb"),
    "postgresql": Dialect("postgresql"),
    "mysql": Dialect("mysql", quote=("`", "`"), concat="concat", lacks=frozenset({"FULL"}), nulls_clause=False),
    "sqlserver": Dialect("sqlserver", quote=("[", "]"), paging="fetch", concat="+", boolean=("1", "0"), lacks=frozenset({"INTERSECT ALL", "EXCEPT ALL", "FILTER"}), nulls_clause=False),
    "oracle": Dialect("oracle", paging="fetch", boolean=("1", "0"), lacks=frozenset({"FILTER"})),
    "db2": Dialect("db2", paging="fetch"),
}
_PRODUCTS = {"microsoft sql server": "sqlserver", "sql server": "sqlserver", "postgres": "postgresql", "mariadb": "mysql", "sqlite3": "sqlite"}


def dialect(product: str, version: str = "") -> Dialect:
    """The dialect of a product by the name that it gives itself; unknown products get the standard's."""
    name = product.strip().lower()
    name = _PRODUCTS.get(name, name)
    found = DIALECTS.get(name, DIALECTS["ansi"])
    numbers = [int(x) for x in re.findall(r"\d+", version)[:3]]
    if name == "sqlite" and numbers and numbers < [3, 39]:
        found = dataclasses.replace(found, lacks=found.lacks | _FULL)
    if name == "sqlite" and numbers and numbers < [3, 30]:
        found = dataclasses.replace(found, lacks=found.lacks | {"FILTER"}, nulls_clause=False)
    if name == "sqlserver" and numbers and numbers[0] < 11:
        found = dataclasses.replace(found, paging="top")
    if name == "mysql" and numbers and numbers < [8, 0, 31]:
        found = dataclasses.replace(found, lacks=found.lacks | {"INTERSECT", "EXCEPT", "INTERSECT ALL", "EXCEPT ALL"})
    return found


#: Declared types of databases as Spark's; what isn't here is a string.
_KINDS = [
    (r"^(TINYINT|SMALLINT|INT2)", "smallint"), (r"^(BIGINT|INT8|HUGEINT)", "bigint"), (r"^(INTEGER|INT|INT4|MEDIUMINT)", "int"), (r"^(REAL|FLOAT4)", "float"), (r"^(DOUBLE|FLOAT)", "double"),
    (r"^(DECIMAL|NUMERIC)", "decimal"), (r"^(MONEY)", "decimal(19,4)"), (r"^(SMALLMONEY)", "decimal(10,4)"), (r"^(BOOL|BIT$)", "boolean"), (r"^(BLOB|BYTEA|VARBINARY|BINARY|IMAGE)", "binary"),
    (r"^(TIMESTAMP|DATETIME|SMALLDATETIME)", "timestamp_ntz"), (r"^DATE", "date"), (r"^TIME", "string"),
]


def spark_type(declared: str) -> str:
    """The Spark type of a declared type such as DECIMAL(12,3)."""
    name = declared.strip().upper()
    for pattern, kind in _KINDS:
        if re.match(pattern, name):
            size = re.search(r"\((\d+)\s*(?:,\s*(\d+))?\)", name)
            return (f"decimal({size.group(1)},{size.group(2) or 0})" if size else "decimal(38,10)") if kind == "decimal" else kind
    return "string"


def decode(v: Any, kind: T.DataType) -> Any:
    """A driver's value as Spark has it for the type; what can't be is an error, not a null."""
    if v is None:
        return None
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(str(v)).quantize(decimal.Decimal(1).scaleb(-kind.scale))
    if isinstance(kind, T.BooleanType):
        return bool(v)
    if isinstance(kind, T.DateType):
        return v if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime) else datetime.date.fromisoformat(str(v)[:10])
    if isinstance(kind, T.TimestampNTZType):
        return v if isinstance(v, datetime.datetime) else datetime.datetime.fromisoformat(str(v))
    if isinstance(kind, T.BinaryType):
        return bytes(v)
    if isinstance(kind, T.IntegralType):
        return int(v)
    if isinstance(kind, T.FractionalType):
        return float(v)
    return str(v)


class Database:
    """A database that a Python driver reaches: connect() gives a connection of the DB-API, on executors as on the driver.

    It is asked for metadata once, on the driver; queries run as tasks. connect must be importable or picklable, and what it opens
    reachable from every executor.
    """

    def __init__(self, spark: SparkSession, connect: Callable[[], Any], product: str, version: str = ""):
        self.spark, self.connect, self.dialect = spark, connect, dialect(product, version)

    def _ask(self, sql: str, params: Iterable = ()) -> tuple[list[str], list[tuple]]:
        c = self.connect()
        try:
            cur = c.cursor()
            cur.execute(sql, tuple(params))
            return [d[0] for d in cur.description], cur.fetchall()
        finally:
            c.close()

    def tables(self) -> list[tuple[str, str]]:
        """Names and types (TABLE or VIEW)."""
        if self.dialect.name == "sqlite":
            return [(n, k.upper()) for n, k in self._ask("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")[1]]
        return [(n, "VIEW" if "VIEW" in k.upper() else "TABLE") for n, k in self._ask("SELECT table_name, table_type FROM information_schema.tables ORDER BY table_name")[1]]

    def columns(self, table: str) -> list[tuple[str, str, str, bool]]:
        """Name, declared type, Spark type and whether it may be null, of each column in order."""
        if self.dialect.name == "sqlite":
            rows = [(n, k, not required) for _, n, k, required, _, _ in self._ask(f"PRAGMA table_info({self.dialect.identifier(table)})")[1]]
        else:
            found = self._ask(f"SELECT column_name, data_type, is_nullable FROM information_schema.columns WHERE table_name = {self.dialect.literal(table)} ORDER BY ordinal_position")[1]
            rows = [(n, k, str(null).upper() in ("YES", "TRUE", "1")) for n, k, null in found]
        if not rows:
            raise ValueError(f"there is no table {table}")
        return [(n, k, spark_type(k), null) for n, k, null in rows]

    def metadata(self) -> DataFrame:
        """All columns of all tables."""
        rows = [(t, kind, n, i + 1, k, s, null) for t, kind in self.tables() for i, (n, k, s, null) in enumerate(self.columns(t))]
        return self.spark.createDataFrame(rows, "TABLE_NAME string, TABLE_TYPE string, COLUMN_NAME string, ORDINAL_POSITION int, DECLARED_TYPE string, DATA_TYPE string, IS_NULLABLE boolean")

    def table(self, name: str) -> Remote:
        fields = tuple((n, s) for n, _, s, _ in self.columns(name))
        return Remote(self, f"SELECT {', '.join(self.dialect.identifier(n) for n, _ in fields)} FROM {self.dialect.identifier(name)}", fields, plain=name)

    def values(self, rows: list[tuple], schema: str) -> Remote:
        """Literal rows, as part of the text that is sent."""
        fields = tuple((f.name, f.dataType.simpleString()) for f in T._parse_datatype_string(schema).fields)
        one = lambda r: "SELECT " + ", ".join(f"{self.dialect.literal(v)} AS {self.dialect.identifier(n)}" for v, (n, _) in zip(r, fields, strict=True))
        if not rows:
            return Remote(self, one([None] * len(fields)) + " WHERE 1 = 0", fields)
        return Remote(self, " UNION ALL ".join(map(one, rows)), fields)

    def query(self, sql: str, schema: str, params: list | None = None, split: tuple[str, list[tuple]] | None = None) -> DataFrame:
        """The rows of a text in the database's own dialect. params stand for its marks (?).

        split: a condition with marks, and a list of values for them: one task for each, so that a large result is read in parallel;
        the conditions must divide the rows.
        """
        return _scan(self, sql, schema, list(params or []), split)

    def correlate(self, outer: DataFrame, sql: str, schema: str, params: list[str], how: str = "inner") -> DataFrame:
        """For each row of outer the rows of sql, with the values of the outer columns `params` for its marks: one statement for each
        distinct combination of them, run by the tasks that hold these. how: inner or left."""
        connect, keys = self.connect, outer.select(*params).distinct()
        made = T._parse_datatype_string(schema)
        types = [f.dataType for f in made.fields]
        out = T.StructType([*keys.schema.fields, *made.fields])

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            target = to_arrow_schema(out)
            c = connect()
            try:
                for batch in batches:
                    rows = []
                    for key in batch.to_pylist():
                        cur = c.cursor()
                        cur.execute(sql, tuple(key[p] for p in params))
                        rows += [(*key.values(), *(decode(v, t) for v, t in zip(r, types, strict=True))) for r in cur.fetchall()]
                    columns = list(zip(*rows, strict=True)) or [()] * len(target)
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, target, strict=True)], schema=target)
            finally:
                c.close()

        found = keys.mapInArrow(run, out)
        renamed = found.toDF(*(f"__p{i}" for i in range(len(params))), *made.names)
        same = None
        for i, p in enumerate(params):
            test = outer[p].eqNullSafe(renamed[f"__p{i}"])
            same = test if same is None else same & test
        return outer.join(renamed, same, how).select(*(outer[c] for c in outer.columns), *(renamed[c] for c in made.names))


class Remote:
    """A relational expression over one database. Each operation gives a new one; NotImplementedError says that Spark must do it."""

    def __init__(self, db: Database, sql: str, fields: tuple[tuple[str, str], ...], plain: str | None = None, ordered: bool = False):
        self.db, self.text, self.fields, self.plain, self.ordered = db, sql, fields, plain, ordered

    @property
    def columns(self) -> list[str]:
        return [n for n, _ in self.fields]

    def sql(self) -> str:
        return self.text

    def _id(self, name: str) -> str:
        return self.db.dialect.identifier(name)

    def _from(self, alias: str = "t") -> str:
        return f"FROM {self._id(self.plain)} {alias}" if self.plain else f"FROM ({self.text}) {alias}"

    def _expr(self, text: str, names: dict[str, str] | None = None) -> str:
        """An expression of column names, literals and operators in the dialect: names quoted, nothing but what databases share."""
        known = names or {n.upper(): self._id(n) for n in self.columns}
        out = []
        t = tokens(text)
        for i, x in enumerate(t):
            if x[0] == "`" or x[0].isalpha() or x[0] == "_":
                word = x.strip("`").upper()
                called = i + 1 < len(t) and t[i + 1] == "("
                if called and word not in _SHARED:
                    raise NotImplementedError(f"{x}() isn't sent to the database")
                if called or (word in _WORDS and x[0] != "`"):
                    out.append(x.upper())
                elif i and t[i - 1] == "." or (i + 1 < len(t) and t[i + 1] == "."):
                    out.append(x.strip("`") if i + 1 < len(t) and t[i + 1] == "." else self._id(x.strip("`")))
                elif word in known:
                    out.append(known[word])
                else:
                    raise ValueError(f"there is no column {x}")
            else:
                out.append(x)
        done = " ".join(out).replace(" . ", ".")
        if self.db.dialect.concat == "+":
            done = done.replace("||", "+")
        elif self.db.dialect.concat == "concat" and "||" in done:
            raise NotImplementedError("|| isn't sent to this database")
        return done

    def _like(self, sql: str, fields=None, ordered: bool = False) -> Remote:
        return Remote(self.db, sql, fields or self.fields, ordered=ordered)

    def where(self, condition: str) -> Remote:
        return self._like(f"SELECT {', '.join(map(self._id, self.columns))} {self._from()} WHERE {self._expr(condition)}")

    def select(self, *columns: str, **made: tuple[str, str]) -> Remote:
        """Columns by name, and made columns: name=(expression, Spark type)."""
        of = {n: k for n, k in self.fields}
        shown = [self._id(c) for c in columns] + [f"{self._expr(e)} AS {self._id(n)}" for n, (e, _) in made.items()]
        return self._like(f"SELECT {', '.join(shown)} {self._from()}", tuple((c, of[c]) for c in columns) + tuple((n, k) for n, (_, k) in made.items()))

    def join(self, other: Remote, on: list[tuple[str, str]], how: str = "inner", condition: str | None = None, prefix: str = "r_") -> Remote:
        """An equi-join in the database (a condition may name l.x and r.y besides). Semi, anti and joins with another database aren't sent."""
        kind = {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "full": "FULL"}.get(how)
        if kind is None or other.db is not self.db or kind in self.db.dialect.lacks:
            raise NotImplementedError(f"a {how} join isn't sent to the database")
        taken = {n.upper() for n in self.columns}
        names = [(n, prefix + n if n.upper() in taken else n, k) for n, k in other.fields]
        shown = [f"l.{self._id(n)}" for n in self.columns] + [f"r.{self._id(n)} AS {self._id(a)}" for n, a, _ in names]
        tests = [f"l.{self._id(a)} = r.{other._id(b)}" for a, b in on] + ([self._expr(condition, {})] if condition else [])
        return self._like(f"SELECT {', '.join(shown)} {self._from('l')} {kind} JOIN {other._from('r')[5:]} ON {' AND '.join(tests) or '1 = 1'}", self.fields + tuple((a, k) for _, a, k in names))

    def aggregate(self, by: list[str], **made: tuple[str, str]) -> Remote:
        """One grouping set: name=(aggregate expression, Spark type)."""
        of = dict(self.fields)
        for e, _ in made.values():
            if "FILTER" in e.upper() and "FILTER" in self.db.dialect.lacks:
                raise NotImplementedError("FILTER isn't sent to this database")
        shown = [self._id(c) for c in by] + [f"{self._expr(e)} AS {self._id(n)}" for n, (e, _) in made.items()]
        group = f" GROUP BY {', '.join(map(self._id, by))}" if by else ""
        return self._like(f"SELECT {', '.join(shown)} {self._from()}{group}", tuple((c, of[c]) for c in by) + tuple((n, k) for n, (_, k) in made.items()))

    def sort(self, *order: str, limit: int | None = None, offset: int = 0) -> Remote:
        """Order items such as "X DESC" (nulls high: last ascending, first descending), with a limit and an offset."""
        items = []
        for o in order:
            name, _, way = o.partition(" ")
            down = way.strip().upper() == "DESC"
            column = self._expr(name)
            if self.db.dialect.nulls_clause:
                items.append(f"{column} {'DESC NULLS FIRST' if down else 'ASC NULLS LAST'}")
            else:
                items += [f"CASE WHEN {column} IS NULL THEN 1 ELSE 0 END {'DESC' if down else 'ASC'}", f"{column} {'DESC' if down else 'ASC'}"]
        sql = f"SELECT {', '.join(map(self._id, self.columns))} {self._from()}" + (f" ORDER BY {', '.join(items)}" if items else "")
        return self._like(self.db.dialect.page(sql, limit, offset, bool(items)), ordered=True)

    def limit(self, n: int, offset: int = 0) -> Remote:
        return self.sort(limit=n, offset=offset)

    def _set(self, word: str, others: tuple[Remote, ...]) -> Remote:
        if word in self.db.dialect.lacks or any(o.db is not self.db or len(o.fields) != len(self.fields) for o in others):
            raise NotImplementedError(f"{word} isn't sent to the database")
        parts = [f"SELECT {', '.join(map(o._id, o.columns))} {o._from()}" for o in (self, *others)]
        return self._like(f" {word} ".join(parts))

    def union(self, *others: Remote, every: bool = False) -> Remote:
        return self._set("UNION ALL" if every else "UNION", others)

    def intersect(self, *others: Remote, every: bool = False) -> Remote:
        return self._set("INTERSECT ALL" if every else "INTERSECT", others)

    def minus(self, *others: Remote, every: bool = False) -> Remote:
        return self._set("EXCEPT ALL" if every else "EXCEPT", others)

    def read(self, split: tuple[str, list[tuple]] | None = None) -> DataFrame:
        """The rows in Spark. Filters that Spark plans over them are sent along, where the database answers them alike."""
        schema = ", ".join(f"`{n}` {k}" for n, k in self.fields)
        return _scan(self.db, self.text, schema, [], split)


#: Functions and words that databases share with the same meaning; user functions and all else stay in Spark.
_SHARED = set("COUNT SUM MIN MAX AVG COALESCE NULLIF UPPER LOWER ABS CAST IN AND OR NOT FILTER WHERE CASE WHEN THEN ELSE BETWEEN".split())
_WORDS = _SHARED | set("IS NULL LIKE END AS DISTINCT TRUE FALSE INTEGER INT BIGINT VARCHAR DOUBLE PRECISION DECIMAL DATE ESCAPE".split())

_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _scan(db: Database, sql: str, schema: str, params: list, split: tuple[str, list[tuple]] | None) -> DataFrame:
    struct = T._parse_datatype_string(schema)
    connect, words = db.connect, db.dialect
    parts = [(None, ())] if split is None else [(split[0], tuple(v)) for v in split[1]]

    class Reader(DataSourceReader):
        def __init__(self):
            self.filters: list[tuple[str, list]] = []

        def pushFilters(self, filters):
            """Comparisons with numbers and tests for null: alike in all databases. Strings compare by collations, so these stay."""
            for f in filters:
                name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
                column = words.identifier(name) if name else ""
                value = getattr(f, "value", None)
                number = isinstance(value, int | float) and not isinstance(value, bool) and value == value and abs(value) != float("inf")
                if name and type(f) in _COMPARE and number:
                    self.filters.append((f"{column} {_COMPARE[type(f)]} ?", [value]))
                elif name and isinstance(f, IsNull | IsNotNull):
                    self.filters.append((f"{column} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []))
                elif name and isinstance(f, In) and f.value and all(isinstance(v, int) and not isinstance(v, bool) for v in f.value):
                    self.filters.append((f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)))
                elif name and isinstance(f, EqualNullSafe) and number:
                    self.filters.append((f"{column} = ?", [value]))
                else:
                    yield f

        def partitions(self):
            return [InputPartition(p) for p in parts]

        def read(self, partition):
            condition, values = partition.value
            tests = [c for c, _ in self.filters] + ([condition] if condition else [])
            text = f"SELECT * FROM ({sql}) pushed WHERE {' AND '.join(f'({c})' for c in tests)}" if tests else sql
            c = connect()
            try:
                cur = c.cursor()
                cur.execute(text, tuple([*params, *(v for _, vs in self.filters for v in vs), *values]))
                while rows := cur.fetchmany(4096):
                    for r in rows:
                        yield tuple(decode(v, f.dataType) for v, f in zip(r, struct.fields, strict=True))
            finally:
                c.close()

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "tessera_federation"

        def schema(self):
            return struct

        def reader(self, schema):
            return Reader()

    db.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    db.spark.dataSource.register(Source)
    return db.spark.read.format("tessera_federation").load()


def called(text: str) -> set[str]:
    """Functions that an expression calls, in capitals: those not in _SHARED block pushing it down."""
    t = tokens(text)
    return {x.upper() for i, x in enumerate(t) if i + 1 < len(t) and t[i + 1] == "(" and rewrites.up(t, i) not in _WORDS and (x[0].isalpha() or x[0] == "_")}
