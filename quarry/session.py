"""A PostgreSQL-flavoured SQL session on Spark.

Queries go to Spark SQL through `dialect`. Statements that Spark's Parquet tables lack are done here:
constraint-checked INSERT with ON CONFLICT and RETURNING, UPDATE, DELETE, DDL with constraints, sequences, types
and domains. A table is a Spark Parquet table; its constraints and defaults are a JSON table property, and schemas,
sequences, types and domains of a database are a property of its hidden table `__engine`, so that every session
over the same catalog sees them. INSERT adds files; UPDATE and DELETE rewrite the files that hold rows they touch
(`tablestore`). A statement validates all its rows before any is visible.
"""
from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialect import Dialect, tokens
from .errors import (
    BindError, CatalogError, ConstraintError, ParseError,
    DatabaseAlreadyExists, DatabaseNotFound, SchemaAlreadyExists, SchemaNotFound, TableAlreadyExists, TableNotFound, ObjectNotFound, InvalidConnectionLimit, DuplicateColumn, ColumnNotFound, MultiplePrimaryKeys, ArityMismatch, TypeMismatch, NotNullViolation, UniqueViolation, CheckViolation, ForeignKeyViolation,
)
from .operators import duplicates
from .tablestore import TableStore
from .types import spark_type

_NAME = r"(?:\"[^\"]+\"|`[^`]+`|[A-Za-z_]\w*)"
_TABLE = rf"({_NAME}(?:\.{_NAME}){{0,1}})"


def new_spark(app: str = "quarry", **options: str) -> SparkSession:
    """A session with the settings that the engine's semantics need."""
    conf = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.adaptive.enabled": "true"} | options
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()


@dataclass
class Meta:
    """What Spark's catalog doesn't hold about a table."""
    columns: list[str]
    types: list[str]
    not_null: list[str] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    keys: dict[str, list[str]] = field(default_factory=dict)  # primary and unique, by name
    checks: dict[str, str] = field(default_factory=dict)
    foreign: dict[str, list] = field(default_factory=dict)  # name -> [columns, table, columns]
    generated: dict[str, str] = field(default_factory=dict)
    identity: list[str] = field(default_factory=list)
    cluster: list[str] = field(default_factory=list)  # columns of PARTITION BY: files are sorted by them
    options: dict[str, str] = field(default_factory=dict)


#: Strings, quoted names and dollar-quoted bodies: what is inside is never rewritten.
_QUOTED = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\$(\w*)\$.*?\$\1\$", re.S)


def flattened(text: str) -> str:
    """text without comments (block comments nest), with single blanks outside quotes."""
    out, i = [], 0
    while i < len(text):
        if quoted := _QUOTED.match(text, i):
            out.append(quoted[0])
            i = quoted.end()
        elif text.startswith("--", i):
            i = end if (end := text.find("\n", i)) >= 0 else len(text)
        elif text.startswith("/*", i):
            depth = 0
            for mark in re.finditer(r"/\*|\*/", text[i:]):
                depth += 1 if mark[0] == "/*" else -1
                if not depth:
                    break
            if depth:
                raise ParseError("a comment doesn't end")
            i += mark.end()
            out.append(" ")
        else:
            out.append(" " if text[i].isspace() else text[i])
            i += 1
        if len(out) > 1 and out[-1] == " " and out[-2] == " ":
            out.pop()
    return "".join(out).strip()


def renamed(text: str, old: str, new: str) -> str:
    """An expression with the column's name changed where it stands as a name."""
    out = []
    for t in tokens(text):
        same = t.kind in ("word", "name") and bare(t.text) == old
        out.append(f"`{new}`" if same else t.text)
    return " ".join(out)


def mentions(text: str, column: str) -> bool:
    """Whether an expression names a column."""
    return any(t.kind in ("word", "name") and bare(t.text) == column for t in tokens(text))


def split(text: str, at: str = ",") -> list[str]:
    """Parts of text between top-level separators; quotes and brackets protect."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c in "'\"`$" and (quoted := _QUOTED.match(text, i)):
            i = quoted.end() - 1
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth == 0 and text[i:i + len(at)].upper() == at and (at == "," or at == ";" or re.match(r"\W|\Z", text[i + len(at):i + len(at) + 1] or " ") and re.match(r"\W", text[i - 1:i] or " ")):
            out.append(text[start:i].strip())
            start = i = i + len(at)
            continue
        i += 1
    out.append(text[start:].strip())
    return [x for x in out if x]


def cut(text: str, word: str) -> tuple[str, str | None]:
    """Text before and after the first top-level keyword."""
    if leading := re.match(rf"\s*{word}\b", text, re.I):
        return "", text[leading.end():].strip()
    parts = split(text, word.upper())
    return (parts[0], f" {word} ".join(parts[1:])) if len(parts) > 1 else (text, None)


def inner(text: str) -> tuple[str, str]:
    """Content of the leading bracket and what follows it."""
    text, depth, i = text.strip(), 0, 0
    while i < len(text):
        if quoted := _QUOTED.match(text, i):
            i = quoted.end()
            continue
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth:
            return text[1:i], text[i + 1:].strip()
        i += 1
    raise ParseError(f"unbalanced: {text[:40]}")


def bare(name: str) -> str:
    return name.strip().strip('"`')


def _literal(text: str) -> str:
    """text as a string of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Session:
    """Statements against databases of schemas of tables; every database starts with `public`."""

    def __init__(self, spark: SparkSession | None = None, database: str = "main"):
        self.spark = spark or new_spark()
        self.store = TableStore(self.spark)
        self.database = database
        self.tag: str | None = None
        self._create_database(database, True, {})

    # Catalog

    def _load(self) -> None:
        """Read the current database's schemas, types, domains and sequences."""
        row = self.spark.sql(f"SHOW TBLPROPERTIES {self._place('__engine')}").filter("key = 'engine.catalog'").first()
        kept = json.loads(row["value"])
        self.schemas, self.types, self.domains, self.sequences = (kept[k] for k in ("schemas", "types", "domains", "sequences"))

    def _keep(self) -> None:
        """Write them."""
        kept = {"schemas": self.schemas, "types": self.types, "domains": self.domains, "sequences": self.sequences}
        self.spark.sql(f"ALTER TABLE {self._place('__engine')} SET TBLPROPERTIES ('engine.catalog' = {_literal(json.dumps(kept))})")

    def _dialect(self, take: bool = True) -> Dialect:
        return Dialect(self.spark, self.types, lambda parts: self._place(".".join(f'"{p}"' for p in parts)) if len(parts) == 2 and parts[0] in self.schemas else None,
                       (lambda name: str(self.nextval(name))) if take else None)

    def _expr(self, text: str, source: str = "") -> str:
        """An expression in Spark's words, over the columns of `source` (a FROM clause's content)."""
        self.spark.catalog.setCurrentDatabase(self._space())
        return self._dialect().expression(text, source)

    def _space(self, schema: str = "public") -> str:
        return f"{self.database}__{schema}"

    def _place(self, name: str) -> str:
        """Spark's name of a table: [schema.]table."""
        parts = [bare(p) for p in name.split(".")]
        if len(parts) > 2:
            raise BindError(f"too many name parts: {name}")
        return f"`{self._space(parts[0] if len(parts) == 2 else 'public')}`.`{parts[-1]}`"

    def _exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self._place(name))

    def _meta(self, name: str) -> Meta:
        if not self._exists(name):
            raise TableNotFound(f"table {name} does not exist")
        self.store.recover(self._place(name), self.store.location(self._place(name)))
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self._place(name)}").filter("key = 'engine.meta'").collect()
        if rows:
            return Meta(**json.loads(rows[0]["value"]))
        schema = self.table(name).schema
        return Meta(schema.names, [f.dataType.simpleString() for f in schema])

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._place(name))

    # Dispatch

    def sql(self, text: str) -> DataFrame | None:
        """Run one statement; queries and RETURNING give a DataFrame, others None. `tag` is its command tag."""
        flat = flattened(text).rstrip(";").strip()
        for pattern, run in self._STATEMENTS:
            if m := re.match(pattern, flat, re.I):
                self._load()
                out = run(self, m, flat[m.end():].strip())
                words = re.match(r"(?:CREATE|DROP|ALTER)\s+(?:OR REPLACE |TEMP |TEMPORARY |UNLOGGED |UNIQUE |MATERIALIZED )*(\w+)|(\w+)", flat, re.I)
                self.tag = "INSERT TABLE" if flat[:6].upper() == "INSERT" else f"{flat.split()[0].upper()} {words[1].upper()}" if words[1] else words[2].upper()
                return out
        if re.match(r"(SELECT|WITH|VALUES|EXPLAIN|DESCRIBE|SHOW|ANALYZE)\b|\(", flat, re.I):
            self.tag = "SELECT"
            return self.query(flat)
        raise ParseError(f"unsupported statement: {flat[:60]}")

    def script(self, text: str) -> list[DataFrame | None]:
        return [self.sql(s) for s in split(flattened(text), ";")]

    def query(self, text: str) -> DataFrame:
        """A query in the engine's dialect."""
        self.spark.catalog.setCurrentDatabase(self._space())
        if re.match(r"(DESCRIBE|SHOW|ANALYZE)\b", text, re.I):
            return self.spark.sql(text)
        if explain := re.match(r"EXPLAIN( EXTENDED| FORMATTED| COST| CODEGEN)?\s+", text, re.I):
            return self.spark.sql(explain[0] + self._rewritten(text[explain.end():]))
        return self.spark.sql(self._rewritten(text))

    def _rewritten(self, text: str) -> str:
        return self._dialect().query(text)

    # Databases and schemas

    def _known(self, name: str) -> bool:
        return self.spark.catalog.databaseExists(f"{name}__public")

    def _create_database(self, name: str, silent: bool, options: dict) -> None:
        if int(options.get("CONNECTION LIMIT", -1)) < -1:
            raise InvalidConnectionLimit("connection limit is below -1")
        if self._known(name) and not silent:
            raise DatabaseAlreadyExists(f"database {name} already exists")
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}__public`")
        first = _literal(json.dumps({"schemas": {"public": ""}, "types": {}, "domains": {}, "sequences": {}}))
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}__public`.`__engine` (x INT) USING parquet TBLPROPERTIES ('engine.catalog' = {first})")
        if name == self.database:
            self._load()

    def _database(self, m, rest):
        options = {k.upper(): v.strip("'\"") for k, v in re.findall(r"(OWNER|ENCODING|LOCALE|TABLESPACE|CONNECTION LIMIT)\s*=?\s*('[^']*'|-?\w+)", rest, re.I)}
        self._create_database(bare(m[2]), bool(m[1]), options)

    def _use(self, m, rest):
        if not self._known(bare(m[1])):
            raise DatabaseNotFound(f"database {m[1]} does not exist")
        self.database = bare(m[1])
        self._load()

    def _schema(self, m, rest):
        owner = re.search(rf"AUTHORIZATION\s+({_NAME})", m[2] + rest, re.I)
        name = re.match(rf"(?!AUTHORIZATION\b){_NAME}", m[2], re.I)
        name = bare(name[0] if name else owner[1])
        if name in self.schemas:
            if m[1]:
                return
            raise SchemaAlreadyExists(f"schema {name} already exists")
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{self._space(name)}`")
        self.schemas[name] = bare(owner[1]) if owner else ""
        self._keep()

    def _drop_space(self, m, rest):
        kind, names = m[1].upper(), [bare(x) for x in split(re.sub(r"\b(CASCADE|RESTRICT)\b", "", rest, flags=re.I))]
        for name in names:
            found = self._known(name) if kind == "DATABASE" else name in self.schemas
            if not found:
                if m[2]:
                    continue
                raise (DatabaseNotFound if kind == "DATABASE" else SchemaNotFound)(f"{kind.lower()} {name} does not exist")
            spaces = [d.name for d in self.spark.catalog.listDatabases(f"{name}__*")] if kind == "DATABASE" else [self._space(name)]
            for space in spaces:
                if self.spark.catalog.currentDatabase().lower() == space.lower():
                    self.spark.catalog.setCurrentDatabase("default")  # no statement resolves in a dropped schema
                root = self.store.schema_root(space)
                self.spark.sql(f"DROP SCHEMA IF EXISTS `{space}` CASCADE")
                self.store.remove(root)
            if kind == "SCHEMA":
                self.schemas.pop(name)
                self._keep()

    # Tables

    def _create_table(self, m, rest):
        name, silent = m[2], bool(m[1])
        if self._exists(name):
            if silent:
                return
            raise TableAlreadyExists(f"table {name} already exists")
        if re.match(r"AS\b", rest, re.I):
            df = self.query(rest[2:].strip().strip("()"))
            self._save(name, df, Meta(df.columns, [f.dataType.simpleString() for f in df.schema]), "")
            return
        body, tail = inner(rest)
        meta = Meta([], [])
        label = bare(name.split(".")[-1])
        for part in split(body):
            if c := re.match(rf"(?:CONSTRAINT ({_NAME}) )?(PRIMARY KEY|UNIQUE|CHECK|FOREIGN KEY)\s*(?=\()", part, re.I):
                content, after = inner(part[c.end():])
                kind, own = c[2].upper(), bare(c[1]) if c[1] else None
                if kind == "CHECK":
                    meta.checks[own or f"{label}_check{len(meta.checks) + 1}"] = content
                    continue
                columns = [bare(x) for x in split(content)]
                if kind == "FOREIGN KEY":
                    self._add_foreign(meta, columns, after, own, label)
                    continue
                self._add_key(meta, kind, columns, own, label)
                continue
            self._add_column(meta, part, label)
        for columns in [*meta.keys.values(), *(f[0] for f in meta.foreign.values())]:
            for c in columns:
                if c not in meta.columns:
                    raise ColumnNotFound(f"column {c} of a constraint does not exist")
        schema = ", ".join(f"`{c}` {t}" for c, t in zip(meta.columns, meta.types))
        parts = re.search(r"PARTITION BY (?:RANGE|LIST|HASH)\s*\(([^)]*)\)", tail, re.I)
        meta.cluster = [bare(x) for x in split(parts[1]) if bare(x) in meta.columns] if parts else []
        self._save(name, self.spark.createDataFrame([], schema), meta, "")

    def _add_key(self, meta: Meta, kind: str, columns: list[str], own: str | None, label: str) -> None:
        primary = kind.upper() == "PRIMARY KEY"
        if primary and any(k.endswith("_pkey") for k in meta.keys):
            raise MultiplePrimaryKeys("more than one primary key")
        meta.keys[own + ("_pkey" if primary and not own.endswith("_pkey") else "") if own else f"{label}_pkey" if primary else f"{label}_{'_'.join(columns)}_key"] = columns
        if primary:
            meta.not_null += [c for c in columns if c not in meta.not_null]

    def _add_foreign(self, meta: Meta, columns: list[str], after: str, own: str | None, label: str) -> None:
        ref = re.match(rf"REFERENCES {_TABLE}\s*(?:\(([^)]*)\))?", after, re.I)
        if not ref:
            raise ParseError("a foreign key without REFERENCES")
        meta.foreign[own or f"{label}_{'_'.join(columns)}_fkey"] = [columns, ref[1], [bare(x) for x in split(ref[2] or "")] or columns]

    def _add_column(self, meta: Meta, part: str, label: str) -> None:
        found = re.match(rf"({_NAME})\s+((?:DOUBLE PRECISION|CHARACTER VARYING|[\w.]+)(?:\s*\([\d,\s]+\))?(?:\[\])*)\s*(.*)$", part, re.I)
        if not found:
            raise ParseError(f"bad column: {part}")
        name, kind, rest = bare(found[1]), found[2], found[3]
        if name in meta.columns:
            raise DuplicateColumn(f"column {name} is given twice")
        meta.columns.append(name)
        meta.types.append(spark_type(kind, self.types))
        if kind.lower() in self.domains:
            meta.checks[f"{label}_{name}_domain"] = "".join(f" `{name}`" if t.key == "VALUE" else f" {t.text}" for t in tokens(self.domains[kind.lower()]))
        if re.search(r"\bNOT NULL\b", rest, re.I):
            meta.not_null.append(name)
        if re.search(r"\bPRIMARY KEY\b", rest, re.I):
            self._add_key(meta, "PRIMARY KEY", [name], None, label)
        elif re.search(r"\bUNIQUE\b", rest, re.I):
            self._add_key(meta, "UNIQUE", [name], None, label)
        if re.search(r"\bAUTO_?INCREMENT\b", rest, re.I):
            meta.identity.append(name)
        if g := re.search(r"GENERATED ALWAYS AS\s*(?=\()", rest, re.I):
            meta.generated[name] = inner(rest[g.end():])[0]
        if d := re.search(r"\bDEFAULT\s+(.+?)(?=\s+(?:NOT NULL|NULL|PRIMARY KEY|UNIQUE|CHECK|REFERENCES|GENERATED|AUTO_?INCREMENT)\b|$)", rest, re.I):
            meta.defaults[name] = d[1]
        if c := re.search(r"\bCHECK\s*(?=\()", rest, re.I):
            meta.checks[f"{label}_{name}_check"] = inner(rest[c.end():])[0]
        if r := re.search(rf"\bREFERENCES {_TABLE}\s*(?:\(([^)]*)\))?", rest, re.I):
            meta.foreign[f"{label}_{name}_fkey"] = [[name], r[1], [bare(r[2])] if r[2] else [name]]

    def _save(self, name: str, df: DataFrame, meta: Meta, old: str | None = None) -> None:
        """Write a new version of a whole table beside the old one, point the table at it and delete the old
        one; old = "" for a new table."""
        place = self._place(name)
        old = self.store.location(place) if old is None else old
        path = self.store.new_location(place)
        (df.sortWithinPartitions(*meta.cluster) if meta.cluster else df).write.parquet(path)
        self.spark.sql(f"DROP TABLE IF EXISTS {place}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        self.spark.sql(f"CREATE TABLE {place} ({schema}) USING parquet LOCATION '{path}' TBLPROPERTIES ('engine.meta' = {_literal(json.dumps(asdict(meta)))})")
        if old:
            self.store.remove(old)

    def _set_meta(self, name: str, meta: Meta) -> None:
        self.spark.sql(f"ALTER TABLE {self._place(name)} SET TBLPROPERTIES ('engine.meta' = {_literal(json.dumps(asdict(meta)))})")

    def _tables(self) -> list[str]:
        """All tables of the database, as schema.table."""
        return [f'{schema}."{t.name}"' for schema in self.schemas for t in self.spark.catalog.listTables(self._space(schema)) if t.tableType != "VIEW" and not t.isTemporary and t.name != "__engine"]

    def _drop_table(self, m, rest):
        for name in split(re.sub(r"\b(CASCADE|RESTRICT)\b", "", rest, flags=re.I)):
            if not self._exists(name):
                if m[1]:
                    continue
                raise TableNotFound(f"table {name} does not exist")
            root = self.store.location(self._place(name))
            self.spark.sql(f"DROP TABLE {self._place(name)}")
            self.store.remove(root)

    def _truncate(self, m, rest):
        for name in split(re.sub(r"\b(RESTART IDENTITY|CONTINUE IDENTITY|CASCADE|RESTRICT)\b", "", rest, flags=re.I)):
            meta, df = self._meta(name), self.table(name)
            self._check_children(name, meta, df, df.limit(0))
            place = self._place(name)
            folder = self.store.location(place)
            self.store.commit(place, folder, None, self.store.names(folder))

    def compact(self, name: str) -> None:
        """Rewrite a table's files as few large ones and delete the old ones."""
        meta, df = self._meta(name), self.table(name)
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        self._save(name, df.repartition(max(1, size // (256 << 20))), meta)

    def _alter(self, m, rest):
        name, meta = m[1], self._meta(m[1])
        df, label = self.table(name), bare(name.split(".")[-1])
        if a := re.match(rf"ADD (?:CONSTRAINT ({_NAME}) )?(PRIMARY KEY|UNIQUE|CHECK|FOREIGN KEY)\s*(?=\()", rest, re.I):
            content, after = inner(rest[a.end():])
            own, kind = bare(a[1]) if a[1] else None, a[2].upper()
            if kind == "CHECK":
                meta.checks[own or f"{label}_check{len(meta.checks) + 1}"] = content
            elif kind == "FOREIGN KEY":
                self._add_foreign(meta, [bare(x) for x in split(content)], after, own, label)
            else:
                self._add_key(meta, kind, [bare(x) for x in split(content)], own, label)
            self._validate(meta, name, df)
            self._set_meta(name, meta)
        elif a := re.match(r"ADD (?:COLUMN )?(IF NOT EXISTS )?(.+)$", rest, re.I):
            if a[1] and bare(re.match(_NAME, a[2])[0]) in meta.columns:
                return
            before = Meta(**json.loads(json.dumps(asdict(meta))))
            self._add_column(meta, a[2], label)
            c, kind = meta.columns[-1], meta.types[-1]
            value = meta.generated.get(c) or meta.defaults.get(c)
            if value or c in meta.not_null or meta.checks != before.checks or meta.keys != before.keys:
                df = df.withColumn(c, F.expr(self._expr(value or "NULL", self._place(name))).cast(kind))
                self._validate(meta, name, df, columns=[c])
                self._save(name, df, meta)
            else:  # the files lack the column, which reads as NULL
                self.spark.sql(f"ALTER TABLE {self._place(name)} ADD COLUMNS (`{c}` {kind})")
                self._set_meta(name, meta)
        elif a := re.match(rf"DROP CONSTRAINT (IF EXISTS )?({_NAME})", rest, re.I):
            found = [g for g in (meta.keys, meta.checks, meta.foreign) if bare(a[2]) in g]
            if not found and not a[1]:
                raise ObjectNotFound(f"constraint {a[2]} does not exist")
            for group in found:
                group.pop(bare(a[2]))
            self._set_meta(name, meta)
        elif a := re.match(rf"DROP (?:COLUMN )?(IF EXISTS )?({_NAME})", rest, re.I):
            c = bare(a[2])
            if c not in meta.columns:
                if a[1]:
                    return
                raise ColumnNotFound(f"column {c} does not exist")
            at = meta.columns.index(c)
            del meta.columns[at], meta.types[at]
            meta.not_null, meta.identity, meta.cluster = ([x for x in own if x != c] for own in (meta.not_null, meta.identity, meta.cluster))
            meta.defaults.pop(c, None)
            meta.keys = {k: v for k, v in meta.keys.items() if c not in v}
            meta.foreign = {k: v for k, v in meta.foreign.items() if c not in v[0]}
            meta.checks = {k: v for k, v in meta.checks.items() if not mentions(v, c)}
            meta.generated = {k: v for k, v in meta.generated.items() if k != c and not mentions(v, c)}
            self._save(name, df.drop(c), meta)
        elif a := re.match(rf"RENAME CONSTRAINT ({_NAME}) TO ({_NAME})", rest, re.I):
            for group in (meta.keys, meta.checks, meta.foreign):
                if bare(a[1]) in group:
                    group[bare(a[2])] = group.pop(bare(a[1]))
            self._set_meta(name, meta)
        elif a := re.match(rf"RENAME TO ({_NAME})", rest, re.I):
            place = self._place(name)
            self.spark.sql(f"ALTER TABLE {place} RENAME TO {place.rsplit('.', 1)[0]}.`{bare(a[1])}`")
        elif a := re.match(rf"RENAME (?:COLUMN )?({_NAME}) TO ({_NAME})", rest, re.I):
            old, new = bare(a[1]), bare(a[2])
            if old not in meta.columns or new in meta.columns:
                raise BindError(f"cannot rename column {old} to {new}")
            swap = lambda names: [new if x == old else x for x in names]
            meta.columns, meta.not_null, meta.identity, meta.cluster = swap(meta.columns), swap(meta.not_null), swap(meta.identity), swap(meta.cluster)
            meta.keys = {k: swap(v) for k, v in meta.keys.items()}
            meta.foreign = {k: [swap(v[0]), v[1], swap(v[2]) if v[1] == name else v[2]] for k, v in meta.foreign.items()}
            meta.checks = {k: renamed(v, old, new) for k, v in meta.checks.items()}
            meta.generated = {new if k == old else k: renamed(v, old, new) for k, v in meta.generated.items()}
            meta.defaults = {new if k == old else k: v for k, v in meta.defaults.items()}
            self._save(name, df.withColumnRenamed(old, new), meta)
            for child, own in self._children(name):
                for f in own.foreign.values():
                    if self._place(f[1]) == self._place(name):
                        f[2] = swap(f[2])
                self._set_meta(child, own)
        elif a := re.match(rf"SET SCHEMA ({_NAME})", rest, re.I):
            if bare(a[1]) not in self.schemas:
                raise SchemaNotFound(f"schema {a[1]} does not exist")
            old, root = self._place(name), self.store.location(self._place(name))
            self._save(f"{a[1]}.{name.split('.')[-1]}", df, meta, "")
            self.spark.sql(f"DROP TABLE {old}")
            self.store.remove(root)
        elif a := re.match(r"(OWNER TO|SET TABLESPACE|(?:NO )?INHERIT) (\S+)$|(SET|RESET)\s*(?=\()", rest, re.I):
            if a[3]:
                for item in split(inner(rest[a.end():])[0]):
                    key, _, value = item.partition("=")
                    meta.options.pop(key.strip(), None) if a[3].upper() == "RESET" else meta.options.update({key.strip(): value.strip()})
            else:
                meta.options[a[1].lower()] = bare(a[2])
            self._set_meta(name, meta)
        elif a := re.match(rf"ALTER (?:COLUMN )?({_NAME}) (SET NOT NULL|DROP NOT NULL|DROP DEFAULT|SET DEFAULT (.+)|SET (?:STATISTICS|STORAGE) \S+|(?:SET DATA )?TYPE (.+?)(?: USING (.+))?)$", rest, re.I):
            c, what = bare(a[1]), a[2].upper()
            if c not in meta.columns:
                raise ColumnNotFound(f"column {c} does not exist")
            if what == "SET NOT NULL":
                meta.not_null += [c] if c not in meta.not_null else []
                self._validate(meta, name, df, columns=[])
            elif what == "DROP NOT NULL":
                meta.not_null = [x for x in meta.not_null if x != c]
            elif what == "DROP DEFAULT":
                meta.defaults.pop(c, None)
            elif what.startswith("SET DEFAULT"):
                meta.defaults[c] = a[3]
            elif what.startswith(("SET STATISTICS", "SET STORAGE")):
                meta.options[f"{c}.{what.split()[1].lower()}"] = what.split()[2]
            else:
                kind = spark_type(a[4], self.types)
                meta.types[meta.columns.index(c)] = kind
                df = df.withColumn(c, F.expr(self._expr(a[5], self._place(name)) if a[5] else f"`{c}`").cast(kind))
                self._validate(meta, name, df, columns=[c])
                self._save(name, df, meta)
                return
            self._set_meta(name, meta)
        else:
            raise ParseError(f"unsupported ALTER TABLE action: {rest[:40]}")

    # Constraints

    def _validate(self, meta: Meta, name: str, new: DataFrame, rest: DataFrame | None = None, columns: list[str] | None = None) -> None:
        """Raise if rows `new`, beside `rest`, violate a constraint. Keys and foreign keys without any of `columns`
        (all, if None) are left out. Conditions on single rows take one pass."""
        tests = [(F.col(f"`{c}`").isNull(), f"null value in column {c} violates not-null constraint") for c in meta.not_null]
        tests += [(F.expr(f"NOT ({self._expr(e, self._place(name))})"), f"row violates check constraint {k}") for k, e in meta.checks.items()]
        touched = lambda own: columns is None or set(own) & set(columns)
        keys = {k: own for k, own in meta.keys.items() if touched(own)}
        bounds = {own[0]: None for own in keys.values()} if rest is not None else {}
        if tests or bounds:
            row = new.agg(*[F.count_if(t).alias(f"t{i}") for i, (t, _) in enumerate(tests)], *[f(f"`{c}`").alias(f"{n}{i}") for i, c in enumerate(bounds) for n, f in (("low", F.min), ("high", F.max))]).first()
            for i, (_, what) in enumerate(tests):
                if row[f"t{i}"]:
                    raise (NotNullViolation if i < len(meta.not_null) else CheckViolation)(what)
            bounds = {c: (row[f"low{i}"], row[f"high{i}"]) for i, c in enumerate(bounds)}
        for key, own in keys.items():
            again = duplicates(new.select(*own), own).limit(1).count() > 0
            if not again and rest is not None and bounds[own[0]][0] is not None:  # only row groups within the new keys' bounds are read
                near = rest.filter(F.col(f"`{own[0]}`").between(*(F.lit(x) for x in bounds[own[0]]))).select(*own)
                again = new.select(*own).dropna().join(near, own, "left_semi").limit(1).count() > 0
            if again:
                raise UniqueViolation(f"duplicate key value violates unique constraint {key}")
        for key, (own, table, theirs) in meta.foreign.items():
            if not touched(own):
                continue
            same = self._place(table) == self._place(name)
            parents = self.table(table) if not same else new if rest is None else rest.select(*theirs).unionByName(new.select(*theirs))
            if new.select(*own).dropna().join(parents.select(*[F.col(t).alias(c) for c, t in zip(own, theirs)]), own, "left_anti").limit(1).count():
                raise ForeignKeyViolation(f"row violates foreign key constraint {key}")

    def _children(self, name: str) -> list[tuple[str, Meta]]:
        """Tables with foreign keys to a table."""
        found = [(t, self._meta(t)) for t in self._tables()]
        return [(t, own) for t, own in found if any(self._place(f[1]) == self._place(name) for f in own.foreign.values())]

    def _check_children(self, name: str, meta: Meta, gone: DataFrame, left: DataFrame, columns: list[str] | None = None, own_left: DataFrame | None = None) -> None:
        """Raise if a row of another table, or of what is left of this one, refers to a key of `gone` that `left` lacks."""
        for child, own in self._children(name):
            for key, (mine, table, theirs) in own.foreign.items():
                if self._place(table) != self._place(name) or columns is not None and not set(theirs) & set(columns):
                    continue
                lost = gone.select(*theirs).dropna().join(left.select(*theirs), theirs, "left_anti").select(*[F.col(t).alias(c) for c, t in zip(mine, theirs)])
                rows = left if self._place(child) == self._place(name) else self.table(child)
                if rows.select(*mine).join(lost, mine, "left_semi").limit(1).count():
                    raise ForeignKeyViolation(f"row is still referenced by foreign key constraint {key}")

    # Rows

    def _insert(self, m, rest):
        name, meta = m[1], self._meta(m[1])
        place = self._place(name)
        folder, columns, target = self.store.location(place), meta.columns, self.table(name)
        alias = bare(m[2] or name.split(".")[-1])
        if rest.startswith("("):
            given, after = inner(rest)
            if not re.match(r"\s*(SELECT|WITH|VALUES)\b", given, re.I):
                columns, rest = [bare(c) for c in split(given)], after
        for c in columns:
            if c not in meta.columns:
                raise ColumnNotFound(f"column {c} does not exist")
        if len(set(columns)) < len(columns):
            raise DuplicateColumn("a column is given twice")
        rest, returning = cut(rest, "RETURNING")
        rest, conflict = cut(rest, "ON CONFLICT")
        kinds = dict(zip(meta.columns, meta.types))
        if re.match(r"DEFAULT VALUES", rest, re.I):
            columns, source = [], self.spark.range(1).select()
        elif v := re.match(r"VALUES\b", rest, re.I):
            rows = []
            for part in split(rest[v.end():]):
                values = split(inner(part)[0])
                if len(values) != len(columns):
                    raise ArityMismatch(f"{len(values)} values for {len(columns)} columns")
                rows.append("SELECT " + ", ".join(self._value(x, c, kinds[c], meta) for x, c in zip(values, columns)))
            source = self.spark.sql(" UNION ALL ".join(rows)).toDF(*columns)
        else:
            source = self.query(rest)
            if len(source.columns) != len(columns):
                raise ArityMismatch(f"{len(source.columns)} columns for {len(columns)}")
            source = source.toDF(*columns)
        new = self._completed(name, meta, columns, source)
        try:
            if conflict is not None:
                return self._insert_or(name, meta, target, new, conflict, alias, returning)
            key, staged = self.store.stage(folder, new, meta.cluster)
            try:
                self._validate(meta, name, staged, target)
                out = self._returned(staged, returning)
            except Exception:
                self.store.discard(folder, key)
                raise
            self.store.commit(place, folder, key)
            return out
        finally:
            self.store.remove(folder + "/_numbered")

    def _completed(self, name: str, meta: Meta, columns: list[str], source: DataFrame) -> DataFrame:
        """Rows of `columns` as rows of the whole table: defaults, numbers and generated columns added, all cast."""
        kinds, target = dict(zip(meta.columns, meta.types)), self.table(name)
        counted = {c: self._step(meta.defaults[c]) for c in meta.columns if c not in columns and c in meta.defaults and self._step(meta.defaults[c])}
        numbered = bool(counted) or any(c in meta.identity for c in meta.columns if c not in columns)
        if numbered:  # each row takes the next number
            source = self.store.numbered(self.store.location(self._place(name)) + "/_numbered", source)
        ready = []
        for c, kind in kinds.items():
            if c in columns:
                ready.append(F.col(f"`{c}`").cast(kind).alias(c))
            elif c in meta.generated:
                continue
            elif c in counted:
                n = source.count()
                s = self.sequences[counted[c]]
                if n > 1 and not s["low"] <= s["next"] + s["step"] * (n - 1) <= s["high"]:
                    raise ConstraintError(f"sequence {counted[c]} is at its end")
                first = self.nextval(counted[c]) if n else 0
                if n > 1:
                    s = self.sequences[counted[c]]
                    s["next"] = first + s["step"] * n
                    self._keep()
                ready.append((F.lit(first) + F.col("__n") * s["step"]).cast(kind).alias(c))
            elif c in meta.identity:
                ready.append((F.lit((target.agg(F.max(c)).first()[0] or 0) + 1) + F.col("__n")).cast(kind).alias(c))
            else:
                ready.append(F.expr(self._expr(meta.defaults.get(c, "NULL"))).cast(kind).alias(c))
        new = source.select(*ready)
        if meta.generated:
            base = self._view_of(new)
            new = new.withColumns({c: F.expr(self._expr(e, base)).cast(kinds[c]) for c, e in meta.generated.items()})
            self.spark.catalog.dropTempView(base)
        return new.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()])

    def _view_of(self, df: DataFrame) -> str:
        """A temporary view for the dialect to look types up in."""
        view = f"__view_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        return view

    def _insert_or(self, name: str, meta: Meta, target: DataFrame, new: DataFrame, conflict: str, alias: str, returning: str | None) -> DataFrame | None:
        """INSERT ... ON CONFLICT. Rows with a NULL in the key conflict with nothing."""
        what = re.match(rf"(?:\(([^)]*)\)|ON CONSTRAINT ({_NAME}))?\s*DO (NOTHING|UPDATE SET (.+))$", conflict, re.I | re.S)
        if not what:
            raise ParseError(f"bad ON CONFLICT: {conflict[:40]}")
        place = self._place(name)
        folder = self.store.location(place)
        if what[2] and bare(what[2]) not in meta.keys:
            raise ObjectNotFound(f"constraint {what[2]} does not exist")
        keys = [[bare(x) for x in split(what[1])]] if what[1] else [meta.keys[bare(what[2])]] if what[2] else list(meta.keys.values())
        if what[1] and sorted(keys[0]) not in [sorted(k) for k in meta.keys.values()]:
            raise BindError("there is no unique constraint for the columns of ON CONFLICT")
        if what[3].upper() == "NOTHING":
            rows = self.store.numbered(folder + "/_numbered", new)
            for key in keys:
                rows = rows.join(target.select(*key), key, "left_anti") if key else rows
            fresh = self._first_of_each(rows, keys, folder + "/_numbered").select(*meta.columns)
            staged_key, staged = self.store.stage(folder, fresh, meta.cluster)
            try:
                self._validate(meta, name, staged, target)
                out = self._returned(staged, returning)
            except Exception:
                self.store.discard(folder, staged_key)
                raise
            self.store.commit(place, folder, staged_key)
            return out
        if not what[1] and not what[2]:
            raise BindError("ON CONFLICT DO UPDATE needs a key")
        own = keys[0]
        if duplicates(new.select(*own), own).limit(1).count():
            raise ConstraintError("ON CONFLICT would change a row twice")
        sets_text, where = cut(what[4], "WHERE")
        sets = self._assignments(sets_text, meta)
        # The target's columns are plain and qualified names, the new row's fields of `excluded`: nothing is renamed.
        excluded = new.select(F.struct(*[F.col(f"`{c}`") for c in meta.columns]).alias("excluded"))
        on = lambda rows: [F.col(f"{alias}.`{c}`") == F.col(f"excluded.`{c}`") for c in own]
        kinds = dict(zip(meta.columns, meta.types))
        scope = self._view_of(target.alias(alias).crossJoin(excluded.limit(0)).select(f"{alias}.*", "excluded"))
        values = {c: F.expr(self._expr(e, f"{scope} AS {alias}")).cast(kinds[c]) for c, e in sets.items()}
        wanted = F.coalesce(F.expr(self._expr(where, f"{scope} AS {alias}")), F.lit(False)) if where else F.lit(True)
        self.spark.catalog.dropTempView(scope)
        placed = self.store.placed(target)
        met = lambda rows: rows.alias(alias).join(excluded, on(rows), "left")
        touched = sorted(r["__file"] for r in placed.alias(alias).join(excluded, on(placed), "inner").filter(wanted).select("__file").distinct().collect())
        rest = self.store.without(target, touched)
        fresh = new.join(target.select(*own), own, "left_anti").select(*meta.columns)
        if touched:
            rows = met(self.store.read(target, touched))
            hit = F.col("excluded").isNotNull() & wanted
            changed = rows.filter(hit).select(*[values.get(c, F.col(f"{alias}.`{c}`")).alias(c) for c in meta.columns])
            changed = self._generated(changed, meta)
            kept = rows.filter(~F.coalesce(hit, F.lit(False))).select(*[F.col(f"{alias}.`{c}`") for c in meta.columns])
            written = kept.unionByName(changed).unionByName(fresh)
            added, beside = changed.unionByName(fresh), rest.unionByName(kept)
            before = rows.filter(hit).select(*[F.col(f"{alias}.`{c}`") for c in meta.columns])
        else:
            written, added, beside, before = fresh, fresh, rest, target.limit(0)
        staged_key, _ = self.store.stage(folder, written, meta.cluster)
        try:
            self._validate(meta, name, added, beside)
            if touched:
                self._check_children(name, meta, before, beside.unionByName(added), list(sets))
            out = self._returned(added, returning)
        except Exception:
            self.store.discard(folder, staged_key)
            raise
        self.store.commit(place, folder, staged_key, [f.rsplit("/", 1)[1] for f in touched])
        return out

    def _first_of_each(self, rows: DataFrame, keys: list[list[str]], folder: str) -> DataFrame:
        """Rows (with `__n`) that are inserted one after the other where none inserted before has an equal key: in each
        round those that come first under all their keys are in, and what meets one of them is out."""
        if not keys:
            return rows
        done = None
        while True:
            ahead = rows
            for i, key in enumerate(keys):
                least = rows.dropna(subset=key).groupBy(*key).agg(F.min("__n").alias(f"__least{i}"))
                ahead = ahead.join(least, key, "left")
            ahead = ahead.filter(" AND ".join(f"coalesce(__least{i}, __n) = __n" for i in range(len(keys)))).select(*rows.columns)
            ahead = self._kept(ahead, "_first", folder)
            done = ahead if done is None else done.unionByName(ahead)
            if len(keys) == 1:
                return done
            for key in keys:
                rows = rows.join(ahead.select(*key), key, "left_anti")
            rows = self._kept(rows.join(ahead.select("__n"), "__n", "left_anti"), "_left", folder)
            if not rows.limit(1).count():
                return done

    def _generated(self, rows: DataFrame, meta: Meta) -> DataFrame:
        """rows with their generated columns computed anew."""
        if not meta.generated:
            return rows
        view = self._view_of(rows)
        made = {c: F.expr(self._expr(e, view)).cast(meta.types[meta.columns.index(c)]) for c, e in meta.generated.items()}
        self.spark.catalog.dropTempView(view)
        return rows.withColumns(made)

    def _assignments(self, text: str, meta: Meta) -> dict[str, str]:
        """column -> expression of a SET list."""
        sets = {}
        for item in split(text):
            c, eq, e = item.partition("=")
            c = bare(c.strip().split(".")[-1])
            if not eq or c not in meta.columns:
                raise ColumnNotFound(f"column {c} does not exist")
            if c in meta.generated:
                raise BindError(f"column {c} is generated")
            sets[c] = meta.defaults.get(c, "NULL") if e.strip().upper() == "DEFAULT" else e.strip()
        return sets

    def _returned(self, rows: DataFrame, returning: str | None) -> DataFrame | None:
        """The rows that RETURNING gives, written before the table moves on: they may be as many as the table's."""
        if returning is None:
            return None
        view = self._view_of(rows)
        out = self.spark.sql(f"SELECT {self._expr(returning, view)} FROM {view}")
        out = self._kept(out, "returned")
        self.spark.catalog.dropTempView(view)
        return out

    def _kept(self, rows: DataFrame, label: str, folder: str | None = None) -> DataFrame:
        """rows, written beside the tables of `public` and read back, so that later reads see the same."""
        path = f"{folder or self.store.schema_root(self._space())}/{label}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _value(self, text: str, column: str, kind: str, meta: Meta) -> str:
        if text.upper() == "DEFAULT":
            return f"CAST({self._expr(meta.defaults.get(column, 'NULL'))} AS {kind})"
        quoted, number = re.fullmatch(r"'(?:[^']|'')*'", text, re.S), re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?", text)
        family = "text" if kind == "string" else "bool" if kind == "boolean" else "int" if kind in ("smallint", "bigint") else "float" if kind in ("float", "double") else "other"
        wrong = (quoted and family in ("int", "float", "bool")) or (number and (family in ("text", "bool") or family == "int" and (number[1] or number[2]))) or (re.fullmatch(r"(?i)true|false", text) and family in ("int", "float", "text"))
        if wrong:
            raise TypeMismatch(f"value {text} does not fit column {column} of type {kind}")
        return f"CAST({self._expr(text)} AS {kind})"

    def _update(self, m, rest):
        name, meta = m[1], self._meta(m[1])
        rest, returning = cut(rest, "RETURNING")
        rest, where = cut(rest, "WHERE")
        rest, source = cut(rest, "FROM")
        sets, kinds = self._assignments(rest, meta), dict(zip(meta.columns, meta.types))
        alias, target = bare(m[2] or name.split(".")[-1]), self.table(name)
        if source or self._nested(where, *sets.values()):
            found, hit, value = self._matches(name, alias, source, where, {c: f"CAST(({e}) AS {kinds[c]})" for c, e in sets.items()}), F.col("__new").isNotNull(), {c: F.col(f"__new.`{c}`") for c in sets}
        else:
            scope = f"{self._place(name)} AS {alias}"
            found, value = None, {c: F.expr(self._expr(e, scope)) for c, e in sets.items()}
            hit = F.coalesce(F.expr(self._expr(where, scope)), F.lit(False)) if where else F.lit(True)
        change = lambda rows: self._generated(rows.select(*[value.get(c, F.col(f"{alias}.`{c}`")).cast(k).alias(c) for c, k in kinds.items()]), meta)
        try:
            return self._exchange(name, meta, target, alias, found, hit, change, list(sets) + list(meta.generated), returning)
        finally:
            self.store.remove(self.store.location(self._place(name)) + "/_scratch")

    def _delete(self, m, rest):
        name, meta = m[1], self._meta(m[1])
        rest, returning = cut(rest, "RETURNING")
        rest, where = cut(rest, "WHERE")
        source = cut(rest, "USING")[1]
        alias, target = bare(m[2] or name.split(".")[-1]), self.table(name)
        if source or self._nested(where):
            found, hit = self._matches(name, alias, source, where, {}), F.col("__new").isNotNull()
        else:
            found, hit = None, F.coalesce(F.expr(self._expr(where, f"{self._place(name)} AS {alias}")), F.lit(False)) if where else F.lit(True)
        try:
            return self._exchange(name, meta, target, alias, found, hit, None, None, returning)
        finally:
            self.store.remove(self.store.location(self._place(name)) + "/_scratch")

    def _exchange(self, name: str, meta: Meta, target: DataFrame, alias: str, found: DataFrame | None, hit, change, columns: list[str] | None, returning: str | None) -> DataFrame | None:
        """Change (or, without `change`, delete) the rows that are hit; only files that hold such rows are rewritten."""
        place = self._place(name)
        folder = self.store.location(place)
        plain = [F.col(f"{alias}.`{c}`").alias(c) for c in meta.columns]
        files = sorted(target.inputFiles())
        placed = lambda rows: rows.alias(alias) if found is None else self.store.located(rows, files).alias(alias).join(found, "__at", "left")
        touched = self.store.files_of(found, files) if found is not None else sorted(r["__file"] for r in placed(self.store.placed(target)).filter(hit).select("__file").distinct().collect())
        if touched:
            rows = placed(self.store.read(target, touched))
            others = self.store.without(target, touched)
            kept = rows.filter(~hit).select(*plain)
            before = rows.filter(hit)
            changed = change(before) if change else None
            left = others.unionByName(kept)
            key, _ = self.store.stage(folder, kept if changed is None else kept.unionByName(changed), meta.cluster)
            try:
                if changed is not None:
                    self._validate(meta, name, changed, left, columns)
                self._check_children(name, meta, before.select(*plain), left if changed is None else left.unionByName(changed), columns)
                out = self._returned(before.select(*plain) if changed is None else changed, returning)
            except Exception:
                self.store.discard(folder, key)
                raise
            self.store.commit(place, folder, key, [f.rsplit("/", 1)[1] for f in touched])
            return out
        return self._returned(target.limit(0), returning)

    @staticmethod
    def _nested(*texts: str | None) -> bool:
        """Whether an expression holds a subquery."""
        return any(t and re.search(r"\(\s*(SELECT|WITH)\b", t, re.I) for t in texts)

    def _matches(self, name: str, alias: str, source: str | None, where: str | None, sets: dict[str, str]) -> DataFrame:
        """For each row of the target that joins `source` under `where` its place `__at` and new values `__new`. A row
        that joins more than once takes the least of its new values, so that reruns agree."""
        target = self.table(name)
        view = self._view_of(self.store.located(self.store.placed(target), sorted(target.inputFiles())))
        values = ", ".join(f"{e} AS `{c}`" for c, e in sets.items()) or "true AS `__any`"
        try:
            found = self.query(f"SELECT {alias}.__at AS __at, struct({values}) AS __new FROM {view} AS {alias}{', ' + source if source else ''}{' WHERE ' + where if where else ''}")
            return self._kept(found.groupBy("__at").agg(F.min("__new").alias("__new")), "_matches", self.store.location(self._place(name)) + "/_scratch")
        finally:
            self.spark.catalog.dropTempView(view)

    def _merge(self, m, rest):
        """MERGE: for each pair of a source and a target row, and each source row without one, the first WHEN that fits
        is carried out. A target row that would be changed twice is refused, as is WHEN NOT MATCHED BY SOURCE."""
        name, meta = m[1], self._meta(m[1])
        place, target, alias = self._place(name), self.table(name), bare(m[2] or name.split(".")[-1])
        folder, kinds = self.store.location(place), dict(zip(meta.columns, meta.types))
        rest, returning = cut(rest, "RETURNING")
        head, clauses = [], []
        for part in split(rest, "WHEN"):  # a WHEN of a CASE belongs to what is before it
            if re.match(r"(NOT )?MATCHED\b", part, re.I):
                clauses.append(part)
            elif clauses:
                clauses[-1] += f" WHEN {part}"
            else:
                head.append(part)
        source, on = cut(" WHEN ".join(head), "ON")
        if on is None or not clauses:
            raise ParseError("MERGE needs ON and WHEN")
        conditions, values, acts = [], [], []
        for clause in clauses:
            when = re.match(r"(NOT )?MATCHED(?: BY TARGET)?\s*(?:AND\b)?", clause, re.I)
            parts = split(clause[when.end():], "THEN")
            k = next((i for i, x in enumerate(parts) if re.match(r"(UPDATE SET |INSERT\b)|(DELETE|DO NOTHING)$", x, re.I)), None)
            if k is None or bool(when[1]) == bool(re.match(r"UPDATE|DELETE", parts[k], re.I)) and not re.match("DO", parts[k], re.I):
                raise ParseError(f"bad WHEN of MERGE: {clause[:40]}")
            test, what = " THEN ".join(parts[:k]), " THEN ".join(parts[k:])
            conditions.append(f"{alias}.__at IS {'' if when[1] else 'NOT '}NULL{f' AND ({test})' if test else ''}")
            act, columns, made = what.split()[0].upper(), [], ["true AS `__any`"]
            if act == "UPDATE":
                sets = self._assignments(re.sub(r"^UPDATE SET ", "", what, flags=re.I), meta)
                columns, made = list(sets), [f"CAST(({e}) AS {kinds[c]}) AS `{c}`" for c, e in sets.items()]
            elif act == "INSERT" and not re.match(r"INSERT DEFAULT VALUES$", what, re.I):
                given = re.match(r"INSERT\s*(\([^)]*\))?\s*VALUES\s*(?=\()", what, re.I)
                if not given:
                    raise ParseError(f"bad INSERT of MERGE: {what[:40]}")
                columns = [bare(c) for c in split(given[1][1:-1])] if given[1] else [c for c in meta.columns if c not in meta.generated]
                items = split(inner(what[given.end():])[0])
                if len(items) != len(columns):
                    raise ArityMismatch(f"{len(items)} values for {len(columns)} columns")
                for c in columns:
                    if c not in kinds:
                        raise ColumnNotFound(f"column {c} does not exist")
                made = [f"CAST(({meta.defaults.get(c, 'NULL') if e.upper() == 'DEFAULT' else e}) AS {kinds[c]}) AS `{c}`" for c, e in zip(columns, items)]
            before = "".join(f"WHEN {c} THEN NULL " for c in conditions[:-1])
            values.append(f"CASE {before}WHEN {conditions[-1]} THEN struct({', '.join(made)}) END AS __v{len(acts)}")
            acts.append((act, columns))
        files = sorted(target.inputFiles())
        view = self._view_of(self.store.located(self.store.placed(target), files))
        try:
            which = " ".join(f"WHEN {c} THEN {k}" for k, c in enumerate(conditions))
            found = self.query(f"SELECT {alias}.__at AS __at, CASE {which} END AS __act, {', '.join(values)} FROM {source} LEFT JOIN {view} AS {alias} ON {on}")
            of = lambda *kind: F.col("__act").isin([k for k, (act, _) in enumerate(acts) if act in kind])
            found = self._kept(found.filter(of("UPDATE", "DELETE", "INSERT")), "_matches", folder + "/_scratch")
            hits = found.filter(of("UPDATE", "DELETE"))
            if hits.groupBy("__at").count().filter("count > 1").limit(1).count():
                raise ConstraintError("MERGE would change a row twice")
            touched = self.store.files_of(hits, files)
            added, beside = target.limit(0), self.store.without(target, touched)
            for k, (act, columns) in enumerate(acts):
                if act == "INSERT":
                    rows = found.filter(F.col("__act") == k)
                    added = added.unionByName(self._completed(name, meta, columns, rows.select(*[F.col(f"__v{k}.`{c}`").alias(c) for c in columns])))
            written, before = added, target.limit(0)
            if touched:
                rows = self.store.located(self.store.read(target, touched), files).alias(alias).join(hits, "__at", "left")
                own = {c: F.col(f"{alias}.`{c}`") for c in meta.columns}
                kept, before = (rows.filter(f"__act IS {x}NULL").select(*[e.alias(c) for c, e in own.items()]) for x in ("", "NOT "))
                new = dict(own)
                for k, (act, columns) in enumerate(acts):
                    if act == "UPDATE":
                        new |= {c: F.when(F.col("__act") == k, F.col(f"__v{k}.`{c}`")).otherwise(new[c]) for c in columns}
                changed = self._generated(rows.filter(of("UPDATE")).select(*[e.alias(c) for c, e in new.items()]), meta)
                added = changed.unionByName(added)
                beside, written = beside.unionByName(kept), kept.unionByName(added)
            key, _ = self.store.stage(folder, written, meta.cluster)
            try:
                self._validate(meta, name, added, beside)
                if touched:
                    self._check_children(name, meta, before, beside.unionByName(added))
                out = self._returned(added, returning)
            except Exception:
                self.store.discard(folder, key)
                raise
            self.store.commit(place, folder, key, [f.rsplit("/", 1)[1] for f in touched])
            return out
        finally:
            self.spark.catalog.dropTempView(view)
            for scratch in ("_scratch", "_numbered"):
                self.store.remove(f"{folder}/{scratch}")

    def _copy(self, m, rest):
        """COPY table [(columns)] FROM 'path', or table or (query) TO 'path'. A path is a folder of files of one format:
        csv (as it is where none is named; NULL is the unquoted empty text, or that of NULL '..'), json or parquet.
        A csv file may break lines within quotes, so each is read by one task; TO writes one for each partition."""
        what, rest = inner(rest) if rest.startswith("(") else (None, rest)
        found = re.match(rf"(?:{_TABLE}\s*(?:\(([^)]*)\))?\s*)?(FROM|TO)\s+'((?:[^']|'')*)'\s*(?:WITH\s*)?(\(.*\))?$", rest, re.I)
        if not found or (what is None) != bool(found[1]) or what is not None and found[3].upper() == "FROM":
            raise ParseError(f"bad COPY: {rest[:40]}")
        path = found[4].replace("''", "'")
        given = {k.upper(): v.strip("'") for k, v in re.findall(r"(\w+)(?:\s+('[^']*'|\w+))?\s*(?:,|$)", inner(found[5])[0])} if found[5] else {}
        kind = given.get("FORMAT", "csv").lower()
        if kind not in ("csv", "json", "parquet") or set(given) - {"FORMAT", "HEADER", "DELIMITER", "NULL"}:
            raise ParseError(f"bad options of COPY: {found[5]}")
        reads = found[3].upper() == "FROM"
        options = {"header": str("HEADER" in given and given["HEADER"].lower() not in ("false", "off")).lower(), "sep": given.get("DELIMITER", ","), "quote": '"', "escape": '"', "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"} if kind == "csv" else {}
        if reads:
            meta = self._meta(found[1])
            columns = [bare(c) for c in split(found[2])] if found[2] else [c for c in meta.columns if c not in meta.generated]
            if absent := [c for c in columns if c not in meta.columns]:
                raise ColumnNotFound(f"column {absent[0]} does not exist")
            options |= {"nullValue": given.get("NULL", "\x00"), "multiLine": "true", "mode": "FAILFAST"} if kind == "csv" else {"mode": "FAILFAST"} if kind == "json" else {}
            rows = self.spark.read.format(kind).options(**options).schema(", ".join(f"`{c}` {meta.types[meta.columns.index(c)]}" for c in columns)).load(path)
            view = self._view_of(rows)
            try:
                self.sql(f"INSERT INTO {found[1]} ({', '.join(f'`{c}`' for c in columns)}) SELECT * FROM {view}")
            finally:
                self.spark.catalog.dropTempView(view)
            return
        rows = self.query(what) if what is not None else self.table(found[1])
        rows = rows.select(*[F.col(f"`{bare(c)}`") for c in split(found[2])]) if found[2] else rows
        options |= {"nullValue": given.get("NULL", ""), "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"} if kind == "csv" else {"ignoreNullFields": "false"} if kind == "json" else {}
        rows.write.format(kind).options(**options).save(path)

    def _vacuum(self, m, rest):
        """Merge the small files of the tables named, or of all."""
        for name in split(rest) or self._tables():
            self.compact(name)

    # Other objects

    def _view(self, m, rest):
        columns = f"({m[3]})" if m[3] else ""
        body = re.sub(r"\s+WITH (?:LOCAL |CASCADED )?CHECK OPTION$", "", rest, flags=re.I)
        self.spark.catalog.setCurrentDatabase(self._space())
        kind = "OR REPLACE TEMPORARY VIEW" if m[1] and "TEMP" in m[1].upper() else f"{'OR REPLACE ' if m[1] and 'REPLACE' in m[1].upper() else ''}VIEW"
        name = m[2] if "TEMPORARY" in kind else self._place(m[2])
        self.spark.sql(f"CREATE {kind} {name} {columns} AS {self._rewritten(body)}")

    def _materialized(self, m, rest):
        """A table of a query's rows, and the query, by which REFRESH makes them anew."""
        if self._exists(m[2]):
            if m[1]:
                return
            raise TableAlreadyExists(f"table {m[2]} already exists")
        df = self.query(rest)
        self._save(m[2], df, Meta(df.columns, [f.dataType.simpleString() for f in df.schema], options={"query": rest}), "")

    def _refresh(self, m, rest):
        meta = self._meta(m[1])
        if "query" not in meta.options:
            raise BindError(f"{m[1]} is not a materialized view")
        self._save(m[1], self.query(meta.options["query"]), meta)

    def _drop_view(self, m, rest):
        for name in split(re.sub(r"\b(CASCADE|RESTRICT)\b", "", rest, flags=re.I)):
            self.spark.sql(f"DROP VIEW {'IF EXISTS ' if m[1] else ''}{self._place(name)}")

    def _alter_view(self, m, rest):
        place = self._place(m[1])
        if a := re.match(rf"RENAME TO ({_NAME})$", rest, re.I):
            self.spark.sql(f"ALTER VIEW {place} RENAME TO {place.rsplit('.', 1)[0]}.`{bare(a[1])}`")
        elif a := re.match(r"AS ", rest, re.I):
            self.spark.catalog.setCurrentDatabase(self._space())
            self.spark.sql(f"ALTER VIEW {place} AS {self._rewritten(rest[a.end():])}")
        else:
            raise ParseError(f"unsupported ALTER VIEW action: {rest[:40]}")

    def _sequence(self, m, rest):
        if bare(m[2]) in self.sequences:
            if m[1]:
                return
            raise CatalogError(f"sequence {m[2]} already exists")
        of = lambda pattern, other: int(x[1]) if (x := re.search(pattern + r"\s+(-?\d+)", rest, re.I)) else other
        step = of(r"INCREMENT(?: BY)?", 1)
        start = of(r"START(?: WITH)?", of("MINVALUE", 1) if step > 0 else of("MAXVALUE", -1))
        self.sequences[bare(m[2])] = {"next": start, "step": step, "low": of("MINVALUE", 1 if step > 0 else -(1 << 63)), "high": of("MAXVALUE", (1 << 63) - 1 if step > 0 else -1), "cycle": int(bool(re.search(r"(?<!NO )\bCYCLE\b", rest, re.I)))}
        self._keep()

    def _drop_sequence(self, m, rest):
        for name in (bare(x) for x in split(re.sub(r"\b(CASCADE|RESTRICT)\b", "", rest, flags=re.I))):
            if name not in self.sequences and not m[1]:
                raise ObjectNotFound(f"sequence {name} does not exist")
            self.sequences.pop(name, None)
        self._keep()

    def nextval(self, name: str) -> int:
        """The next number of a sequence, which is kept before it is used."""
        self._load()
        if name not in self.sequences:
            raise ObjectNotFound(f"sequence {name} does not exist")
        s = self.sequences[name]
        value = s["next"]
        if not s["low"] <= value <= s["high"]:
            if not s["cycle"]:
                raise ConstraintError(f"sequence {name} is at its end")
            value = s["low"] if s["step"] > 0 else s["high"]
        s["next"] = value + s["step"]
        self._keep()
        return value

    @staticmethod
    def _step(default: str) -> str | None:
        """The sequence of a default that is one's nextval."""
        found = re.fullmatch(r"\s*nextval\(\s*'(\w+)'\s*\)\s*", default, re.I)
        return found[1] if found else None

    def _type(self, m, rest):
        name = bare(m[1]).lower()
        if m[2].upper().startswith("ENUM"):
            self.types[name] = "string"
            self.domains[name] = f"VALUE IN ({inner(rest)[0]})"
        else:
            fields = [re.match(rf"({_NAME})\s+(.+)$", x) for x in split(inner(rest)[0])]
            self.types[name] = "struct<" + ",".join(f"{bare(x[1])}:{spark_type(x[2], self.types)}" for x in fields) + ">"
        self._keep()

    def _domain(self, m, rest):
        name = bare(m[1]).lower()
        self.types[name] = spark_type(m[2], self.types)
        checks = [inner(rest[c.end():])[0] for c in re.finditer(r"CHECK\s*(?=\()", rest, re.I)] + (["VALUE IS NOT NULL"] if re.search(r"NOT NULL", rest, re.I) else [])
        if checks:
            self.domains[name] = " AND ".join(f"({c})" for c in checks)
        self._keep()

    def _function(self, m, rest):
        """SQL functions, scalar or RETURNS TABLE, by Spark's own temporary functions."""
        body = re.search(r"\bAS\s+(?:'((?:[^']|'')*)'|\$\w*\$(.*?)\$\w*\$)|\bRETURN\b(.+)$", rest, re.I | re.S)
        if (language := re.search(r"\bLANGUAGE\s+(\w+)", rest, re.I)) and language[1].upper() != "SQL":
            raise ParseError(f"functions of language {language[1]} are not supported")
        head = re.match(r"(\(.*?\))\s*RETURNS\s+(TABLE\s*\([^)]*\)|\w+(?:\s*\([\d, ]+\))?)", rest, re.I)
        if not body or not head:
            raise ParseError("only SQL functions with a body are supported")
        code = (body[1] or body[2] or body[3]).strip().rstrip(";")
        returns = head[2] if head[2].upper().startswith("TABLE") else spark_type(head[2], self.types)
        typed = lambda text: re.sub(rf"({_NAME})\s+(\w+)(?=\s*[,)])", lambda x: f"{x[1]} {spark_type(x[2], self.types)}", text)
        table = head[2].upper().startswith("TABLE")
        code = self._rewritten(code) if table else self._expr(re.sub(r"^SELECT\s+", "", code.replace("''", "'") if body[1] else code, flags=re.I))
        if not table and re.search(r"\bSTRICT\b|\bRETURNS NULL ON NULL INPUT\b", rest, re.I):
            names = [re.match(_NAME, x)[0] for x in split(inner(head[1])[0])]
            code = f"CASE WHEN {' OR '.join(f'{n} IS NULL' for n in names)} THEN NULL ELSE {code} END"
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {m[1]}{typed(head[1])} RETURNS {typed(returns) if '(' in returns and returns.upper().startswith('TABLE') else returns} RETURN {code}")

    def _index(self, m, rest):
        """Indexes have no physical form over Parquet; a unique one is a key."""
        table, columns = m[3], [bare(re.sub(r"\s+(ASC|DESC)\b.*", "", c, flags=re.I)) for c in split(m[4])]
        if m[1]:
            meta = self._meta(table)
            meta.keys[bare(m[2]) if m[2] else f"{bare(table)}_{'_'.join(columns)}_idx"] = columns
            self._validate(meta, table, self.table(table), columns=columns)
            self._set_meta(table, meta)
        elif not self._exists(table):
            raise TableNotFound(f"table {table} does not exist")

    def _transaction(self, m, rest):
        if m[1].upper().startswith("ROLLBACK"):
            raise ParseError("ROLLBACK: each statement commits by itself")

    _STATEMENTS = [
        (rf"CREATE DATABASE (IF NOT EXISTS )?({_NAME})", _database),
        (rf"USE ({_NAME})$", _use),
        (rf"CREATE SCHEMA (IF NOT EXISTS )?((?:{_NAME}\s*)+)", _schema),
        (r"DROP (DATABASE|SCHEMA) (IF EXISTS )?", _drop_space),
        (rf"CREATE (?:TEMP(?:ORARY)? |UNLOGGED )?TABLE (IF NOT EXISTS )?{_TABLE}\s*", _create_table),
        (r"DROP (?:TEMP(?:ORARY)? )?TABLE (IF EXISTS )?", _drop_table),
        (r"TRUNCATE TABLE ()", _truncate),
        (rf"ALTER TABLE (?:IF EXISTS )?{_TABLE} ", _alter),
        (rf"INSERT INTO {_TABLE}\s*(?:AS ({_NAME})\s*)?", _insert),
        (rf"UPDATE {_TABLE}(?: (?:AS )?((?!SET\b){_NAME}))? SET ", _update),
        (rf"DELETE FROM {_TABLE}(?: (?:AS )?((?!(?:USING|WHERE|RETURNING)\b){_NAME}))?\s*", _delete),
        (rf"MERGE INTO {_TABLE}(?: (?:AS )?((?!USING\b){_NAME}))? USING ", _merge),
        (r"COPY ", _copy),
        (r"VACUUM(?: FULL)?\b", _vacuum),
        (rf"ALTER VIEW {_TABLE} ", _alter_view),
        (rf"CREATE MATERIALIZED VIEW (IF NOT EXISTS )?{_TABLE}\s+AS ", _materialized),
        (rf"REFRESH MATERIALIZED VIEW {_TABLE}$", _refresh),
        (r"DROP MATERIALIZED VIEW (IF EXISTS )?", _drop_table),
        (rf"CREATE ((?:OR REPLACE )?(?:TEMP(?:ORARY)? )?)VIEW {_TABLE}\s*(?:\(([^)]*)\))?\s*(?:WITH \([^)]*\) )?AS ", _view),
        (r"DROP VIEW (IF EXISTS )?", _drop_view),
        (rf"CREATE SEQUENCE (IF NOT EXISTS )?({_NAME})", _sequence),
        (r"DROP SEQUENCE (IF EXISTS )?", _drop_sequence),
        (rf"CREATE TYPE ({_NAME}) AS (ENUM\s*|)(?=\()", _type),
        (rf"CREATE DOMAIN ({_NAME}) AS (\w+(?:\s*\([\d, ]+\))?)", _domain),
        (rf"CREATE (?:OR REPLACE )?FUNCTION ({_NAME})\s*(?=\()", _function),
        (rf"CREATE (UNIQUE )?INDEX (?:IF NOT EXISTS )?({_NAME})? ?ON {_TABLE}\s*(?:USING \w+\s*)?\(([^)]*)\)", _index),
        (r"(BEGIN|COMMIT|ROLLBACK)\b", _transaction),
    ]
