"""The engine: a catalog of time-series tables and the statements that work on them.

Tables are Parquet folders partitioned by day or hour of their time column. The catalog is a JSON file that gets a new
version with every change; a change that another engine has overtaken is refused, never written over.
"""

from __future__ import annotations

import fnmatch
import re
import threading
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.udf import FunctionRegistry
from ..plans import ast as a
from ..plans.builder import Builder, Source
from ..plans.lexer import QueryError, interval_nanos
from ..plans.parser import parse
from ..plans.promql import PromQL
from . import line_protocol
from .access import Access, kind, needs
from .files import Files

TYPES = {"TIMESTAMP": T.TimestampNTZType(), "INT64": T.LongType(), "FLOAT64": T.DoubleType(), "FLOAT32": T.FloatType(), "SYMBOL": T.StringType()}
FORMATS = {"day": "yyyyMMdd", "hour": "yyyyMMddHH"}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")
GROUP_PROPS = ("region", "retention", "profile", "replica")
DEVICE_PROPS = ("type", "location", "status")
CONSUMER_PARTITIONS = 4
TAG_BYTES = 64 << 20  # of tags that are broadcast


class Engine:
    def __init__(self, spark: SparkSession, root: str, audit: bool = False):
        """With audit, every statement leaves a record that ``audit_log`` reads."""
        self.spark, self.root, self.files, self.audit = spark, root.rstrip("/"), Files(spark), audit
        self.access = Access(self.files, f"{self.root}/users.json")
        self.functions = FunctionRegistry(spark)
        self.views: dict[str, Source] = {}
        self.current: dict[str, str | None] = {"database": None, "group": None}
        self.refresh()

    # catalog
    def refresh(self) -> None:
        """Takes the newest catalog; statements that change it do so first."""
        empty = {"databases": {}, "groups": {}, "devices": {}, "tables": {}, "stables": {}, "consumers": {}}
        self.version, held = self.files.read_latest(f"{self.root}/catalog.json", {})
        self.catalog = empty | held

    def _save(self) -> None:
        if not self.files.write_next(f"{self.root}/catalog.json", self.version, self.catalog):
            self.refresh()
            raise QueryError("another engine has changed the catalog; run the statement again")
        self.version += 1

    def _entry(self, kind: str, name: str) -> dict:
        if name not in self.catalog[kind]:
            raise QueryError(f"no {kind[:-1]} {name}")
        return self.catalog[kind][name]

    def _new(self, kind: str, name: str, value: dict) -> None:
        if not _NAME.fullmatch(name):
            raise QueryError(f"not a name: {name}")
        taken = {*self.catalog["tables"], *self.catalog["stables"]} if kind in ("tables", "stables") else self.catalog[kind]
        if name in taken:
            raise QueryError(f"{name} exists")
        self.catalog[kind][name] = value
        self._save()

    def register(self, name: str, df: DataFrame, ts: str | None = None, tie: Sequence[str] = ()) -> None:
        """A DataFrame under a name, for reading."""
        self.views[name] = Source(df, ts, tie)

    def path(self, table: str) -> str:
        return f"{self.root}/data/{table}"

    def _shape(self, t: dict) -> list[tuple[str, str]]:
        return [tuple(c) for c in (self.catalog["stables"][t["stable"]]["columns"] if t.get("stable") else t["columns"])]

    def _time(self, t: dict) -> str:
        return self.catalog["stables"][t["stable"]]["ts"] if t.get("stable") else t["ts"]

    def _part(self, t: dict) -> str:
        return f"_part_{t.get('props', {}).get('partition', 'day')}"

    def schema(self, table: str) -> T.StructType:
        return T.StructType([T.StructField(c, TYPES[k]) for c, k in self._shape(self._entry("tables", table))])

    def table(self, name: str) -> Source:
        """A view, table or super-table as a source."""
        if name in self.views:
            return self.views[name]
        if name in self.catalog["stables"]:
            return self._family(name)
        t = self._entry("tables", name)
        part = self._part(t)
        full = T.StructType([*self.schema(name).fields, T.StructField(part, T.StringType())])
        df = self.spark.read.schema(full).parquet(self.path(name)) if self.files.names(self.path(name)) else self.spark.createDataFrame([], full)
        return Source(self._doubled(df), self._time(t), (), part)

    @staticmethod
    def _doubled(df: DataFrame) -> DataFrame:
        """FLOAT32 is stored, doubles are read."""
        return df.withColumns({f.name: F.col(f"`{f.name}`").cast("double") for f in df.schema if isinstance(f.dataType, T.FloatType)})

    def _family(self, name: str) -> Source:
        s = self._entry("stables", name)
        children = {n: t for n, t in self.catalog["tables"].items() if t.get("stable") == name}
        tag_schema = T.StructType([T.StructField("__child", T.StringType()), *[T.StructField(c, self._doubled_type(k)) for c, k in s["tags"]]])
        tags = self.spark.createDataFrame([(n, *t["tags"]) for n, t in sorted(children.items())], tag_schema)
        shape = T.StructType([*[T.StructField(c, TYPES[k]) for c, k in s["columns"]], T.StructField("_part_day", T.StringType())])
        paths = [self.path(n) for n in sorted(children) if self.files.names(self.path(n))]
        if not paths:
            rows = self.spark.createDataFrame([], shape).withColumn("tbname", F.lit(None).cast("string"))
        else:
            # One scan over all children, however many; the child's name is the folder of the row's file.
            files = self.spark.read.schema(T.StructType(shape.fields[:-1])).option("recursiveFileLookup", "true").parquet(*paths)
            at = F.col("_metadata.file_path")
            rows = files.withColumns({"_part_day": F.regexp_extract(at, r"_part_day=(\d+)", 1), "tbname": F.regexp_extract(at, r"/data/([^/]+)/_part_day=[^/]+/[^/]+$", 1)})
        size = sum(len(n) + sum(len(str(v)) for v in t["tags"]) + 16 * (1 + len(t["tags"])) for n, t in children.items())
        out = self._doubled(rows).join(F.broadcast(tags) if size <= TAG_BYTES else tags, F.col("tbname") == F.col("__child")).drop("__child")
        return Source(out, s["ts"], (), "_part_day")

    @staticmethod
    def _doubled_type(kind: str) -> T.DataType:
        return T.DoubleType() if kind == "FLOAT32" else TYPES[kind]

    # queries
    def sql(self, text: str, user: str | None = None) -> DataFrame:
        """Runs a statement. Queries and lists give rows, all others one row with what was done.

        With a user's name, that user's privileges are checked; without, the program itself runs it.
        """
        s = None
        try:
            s = parse(text)
            if user is not None:
                self.access.check(user, s)
            out = self._run(s)
        except Exception:
            self._record(s, user, False)
            raise
        self._record(s, user, True)
        return out

    def _record(self, s, user: str | None, ok: bool) -> None:
        """One file a statement: stores need not append. Texts stay out, as they may hold passwords."""
        if self.audit:
            now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
            action = "" if s is None else "SELECT" if isinstance(s, a.Select) else s.verb.upper().replace("_", " ")
            on = [] if s is None else needs(s)[1]
            self.files.write_json(f"{self.root}/audit/{uuid.uuid4().hex}.json", {"at": now, "user": user or "", "event": kind(s), "action": action, "object": ", ".join(on), "ok": ok})

    def audit_log(self) -> DataFrame:
        """at, user, event, action, object, ok of every recorded statement."""
        shape = "at timestamp_ntz, user string, event string, action string, object string, ok boolean"
        path = f"{self.root}/audit"
        return self.spark.read.schema(shape).option("multiLine", "true").json(path) if self.files.exists(path) else self.spark.createDataFrame([], shape)

    def collect(self, text: str, seconds: float, user: str | None = None) -> list[Row]:
        """Rows of a statement; its Spark jobs are cancelled after so many seconds and TimeoutError is raised."""
        tag, late, context = f"tidemark-{uuid.uuid4().hex}", threading.Event(), self.spark.sparkContext

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            return self.sql(text, user).collect()
        except Exception as e:
            if late.is_set():
                raise TimeoutError(f"not done in {seconds} s") from e
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    def _run(self, s) -> DataFrame:
        if isinstance(s, a.Select):
            out = Builder(self.table, self.functions).build(s)
            return out.drop(*[c for c in out.columns if c.startswith("_part_")])
        self.refresh()
        done = getattr(self, f"_{s.verb}", None)
        if done is None and s.verb.split("_")[0] in ("list", "show"):
            return self._list(s.verb.split("_", 1)[1], s.args)
        if done is None:
            raise QueryError(f"cannot run {s.verb}")
        out = done(**s.args) if s.args else done()
        return out if isinstance(out, DataFrame) else self.spark.createDataFrame([(s.verb, out or 0)], "done string, n long")

    def promql(self, text: str, value: str = "value") -> DataFrame:
        def resolve(name: str):
            s = self.table(name)
            return (s.df.drop(s.part) if s.part else s.df), s.ts

        return PromQL(resolve, value).query(text)

    # data in
    def append(self, table: str, df: DataFrame) -> None:
        """Appends rows with the table's columns; sorted by time inside each file."""
        t = self._entry("tables", table)
        ts, part, schema = self._time(t), self._part(t), self.schema(table)
        rows = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        rows = rows.withColumn(part, F.date_format(ts, FORMATS[part.removeprefix("_part_")])).where(F.col(ts).isNotNull())
        order = [c for c in t.get("props", {}).get("sort", "").split(",") if c in schema.names]
        rows.repartition(part, F.pmod(F.xxhash64(ts), F.lit(int(t.get("props", {}).get("files", 1))))).sortWithinPartitions(part, *order, ts).write.mode("append").partitionBy(part).parquet(self.path(table))

    def append_arrow(self, table: str, columns: pa.Table | dict) -> int:
        """Bulk columns at once."""
        data = columns if isinstance(columns, pa.Table) else pa.table(columns)
        self.append(table, self.spark.createDataFrame(data))
        return data.num_rows

    def batch(self, table: str) -> Batch:
        return Batch(self, table)

    def _insert_into(self, table: str, columns: list[str] | None, rows: list[list]) -> int:
        shape = self._shape(self._entry("tables", table))
        names = columns or [c for c, _ in shape]
        if sorted(names) != sorted(c for c, _ in shape):
            raise QueryError("INSERT lists every column once")
        kinds, out = dict(shape), []
        for row in rows:
            if len(row) != len(names):
                raise QueryError(f"expected {len(names)} values, got {len(row)}")
            given = {n: self._value(v, kinds[n]) for n, v in zip(names, row, strict=True)}
            out.append(tuple(given[c] for c, _ in shape))
        self.append(table, self.spark.createDataFrame(out, self.schema(table)))
        return len(out)

    @staticmethod
    def _value(v, kind: str):
        if kind == "TIMESTAMP":
            if isinstance(v, int):
                return datetime(1970, 1, 1) + timedelta(microseconds=v // 1000)
            if isinstance(v, str):
                m = re.match(r"(\d{4}-\d\d-\d\d)(?:[ T](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?)?", v)
                if m:
                    return datetime.fromisoformat(f"{m[1]} {m[2] or '00:00:00'}") + timedelta(microseconds=int((m[3] or "0").ljust(9, "0")) // 1000)
            raise QueryError(f"not a time: {v}")
        fits = {"INT64": isinstance(v, int), "FLOAT64": isinstance(v, (int, float)), "FLOAT32": isinstance(v, (int, float)), "SYMBOL": isinstance(v, str)}[kind]
        if not fits:
            raise QueryError(f"{v!r} is no {kind}")
        return float(v) if kind.startswith("FLOAT") else v

    def _write_to(self, table: str, path: str) -> int:
        return self.load_csv(table, path)

    def load_csv(self, table: str, path: str, header: bool = False) -> int:
        """Rows of CSV files, in the table's column order; a bad value stops the load."""
        times = "yyyy-MM-dd[['T'][ ]HH:mm:ss[.SSSSSS]]"
        df = self.spark.read.option("timestampNTZFormat", times).csv(path, schema=self.schema(table), header=header, mode="FAILFAST")
        n = df.count()
        self.append(table, df)
        return n

    def ingest_lines(self, lines: DataFrame, column: str = "value") -> dict[str, int]:
        """Line protocol into tables named after measurements, made as needed. Returns rows per table and bad lines under ""."""
        parsed = line_protocol.parse(lines, column).cache()
        try:
            counts = {m or "": n for m, n in parsed.groupBy("measurement").count().collect()}
            for name, (tags, fields) in line_protocol.shapes(parsed).items():
                if name not in self.catalog["tables"]:
                    self._new("tables", name, {"columns": [["ts", "TIMESTAMP"], *[[t, "SYMBOL"] for t in tags], *[[f, k] for f, k in fields.items()]], "ts": "ts", "props": {}})
                held = self._shape(self.catalog["tables"][name])
                flat = line_protocol.measurement(parsed, name, [t for t in tags if (t, "SYMBOL") in held], {f: k for f, k in held if f in fields and f != self._time(self.catalog["tables"][name])})
                for f, k in held:
                    if f not in flat.columns:
                        flat = flat.withColumn(f, F.lit(None).cast(TYPES[k]))
                self.append(name, flat)
        finally:
            parsed.unpersist()
        return counts

    # DDL
    def _create_table(self, name: str, columns=None, ts=None, props=None, stable=None, tags=None) -> None:
        if stable:
            shape = self._entry("stables", stable)["tags"]
            if len(tags) != len(shape):
                raise QueryError(f"expected {len(shape)} tags")
            return self._new("tables", name, {"stable": stable, "tags": [self._value(v, k) for v, (_, k) in zip(tags, shape, strict=True)]})
        if len(columns) > 256 or len({c for c, _ in columns}) != len(columns):
            raise QueryError("columns are at most 256, each named once")
        if dict(columns).get(ts) != "TIMESTAMP":
            raise QueryError(f"{ts} is no TIMESTAMP column")
        props = {k: str(v).lower() for k, v in (props or {}).items()}
        if props.get("partition", "day") not in FORMATS:
            raise QueryError("partitions are day or hour")
        self._new("tables", name, {"columns": [list(c) for c in columns], "ts": ts, "props": props})

    _create_ptable = _create_table

    def _create_stable(self, name: str, columns, tags, ts, database=None, group=None) -> None:
        if len(columns) > 64 or not 1 <= len(tags) <= 16 or ts is None:
            raise QueryError("a super-table has a TIMESTAMP, up to 64 columns and 1 to 16 tags")
        self._new("stables", name, {"columns": [list(c) for c in columns], "tags": [list(t) for t in tags], "ts": ts, "database": database or self.current["database"], "group": group or self.current["group"]})

    _create_vtable = _create_stable

    def _drop_table(self, name: str) -> None:
        self._entry("tables", name)
        self.files.delete(self.path(name))
        del self.catalog["tables"][name]
        self._save()

    _drop_ptable = _drop_table

    def _drop_stable(self, name: str) -> int:
        self._entry("stables", name)
        children = [n for n, t in self.catalog["tables"].items() if t.get("stable") == name]
        for n in children:
            self._drop_table(n)
        del self.catalog["stables"][name]
        self._save()
        return len(children)

    _drop_vtable = _drop_stable

    def _truncate_table(self, name: str) -> None:
        self._entry("tables", name)
        self.files.delete(self.path(name))

    def _alter_table(self, table: str, column: tuple[str, str]) -> None:
        t = self._entry("tables", table)
        if t.get("stable"):
            raise QueryError("children have their super-table's columns")
        if column[0] in [c for c, _ in t["columns"]]:
            raise QueryError(f"{column[0]} exists")
        t["columns"].append(list(column))
        self._save()

    def _create_database(self, name: str, props: dict) -> None:
        self._new("databases", name, {"retention": props.get("retention"), "props": props})

    def _drop_database(self, name: str) -> None:
        if name == "sysdb":
            raise QueryError("sysdb is protected")
        self._entry("databases", name)
        del self.catalog["databases"][name]
        self._save()

    def _create_group(self, name: str, props: dict, database=None, group=None) -> None:
        self._new("groups", name, {"database": database or self.current["database"], **{p: props.get(p) for p in GROUP_PROPS}, "tags": {k: v for k, v in props.items() if k not in GROUP_PROPS}})

    def _drop_group(self, name: str) -> None:
        self._entry("groups", name)
        del self.catalog["groups"][name]
        self._save()

    def _create_device(self, name: str, props: dict, group=None, database=None) -> None:
        group = group or self.current["group"]
        self._entry("groups", group or "")
        self._new("devices", name, {"group": group, **{p: props.get(p) for p in DEVICE_PROPS}, "tags": {k: v for k, v in props.items() if k not in DEVICE_PROPS}})

    def _drop_device(self, name: str, **_) -> None:
        self._entry("devices", name)
        del self.catalog["devices"][name]
        self._save()

    def _use_database(self, name: str) -> None:
        self._entry("databases", name)
        self.current["database"] = name

    def _use_group(self, name: str) -> None:
        self._entry("groups", name)
        self.current["group"] = name

    def _list(self, kind: str, args: dict) -> DataFrame:
        if kind == "functions":
            return self.spark.createDataFrame(self.functions.rows(), "name string, nargs int, ret_type string, source string")
        if kind == "users":
            return self.spark.createDataFrame(self.access.rows(), "name string, role string, grants string")
        if kind == "consumers":
            rows = [(n, c["topic"], m, p, c["offsets"][str(p)]) for n, c in sorted(self.catalog["consumers"].items()) for p in range(CONSUMER_PARTITIONS) for m in [self._owner(c, p)]]
            return self.spark.createDataFrame(rows, "name string, topic string, member string, partition int, committed long")
        kind = {"vtables": "stables", "ptables": "tables"}.get(kind, kind)
        within = {k: v for k, v in {**({"database": self.current["database"]} if kind in ("groups", "stables") and self.current["database"] else {}), **args}.items() if v}
        rows = [(n, str(v.get("database") or v.get("group") or v.get("stable") or "")) for n, v in sorted(self.catalog[kind].items()) if all(v.get(k) == x for k, x in within.items())]
        return self.spark.createDataFrame(rows, "name string, parent string")

    def _describe(self, name: str) -> DataFrame:
        out = "col_name string, type string, is_tag boolean, tag_value string"
        if name in self.views:
            return self.spark.createDataFrame([(c, t, False, None) for c, t in self.views[name].df.dtypes], out)
        if name in self.catalog["stables"]:
            s = self.catalog["stables"][name]
            return self.spark.createDataFrame([(c, k, tag, None) for tag, cols in ((False, s["columns"]), (True, s["tags"])) for c, k in cols], out)
        t = self._entry("tables", name)
        tags = [(c, k, True, str(v)) for (c, k), v in zip(self.catalog["stables"][t["stable"]]["tags"], t["tags"], strict=True)] if t.get("stable") else []
        return self.spark.createDataFrame([(c, k, False, None) for c, k in self._shape(t)] + tags, out)

    # users
    def _create_user(self, name: str, password: str, admin: bool) -> None:
        self.access.create(name, password, admin)

    def _alter_user(self, name: str, password: str) -> None:
        self.access.set_password(name, password)

    def _drop_user(self, name: str) -> None:
        self.access.drop(name)

    def _grant(self, privilege: str, on: str, name: str) -> None:
        self.access.grant(name, privilege, on)

    def _revoke(self, privilege: str, on: str, name: str) -> None:
        self.access.revoke(name, privilege, on)

    # functions
    def _create_function(self, name: str, args: list[str], returns: str, symbol: str, **rest) -> None:
        self.functions.create(name, args, returns, f"{rest['from']}:{symbol}")

    def _drop_function(self, name: str) -> None:
        self.functions.drop(name)

    # consumer groups
    @staticmethod
    def _owner(c: dict, partition: int) -> str | None:
        return c["members"][partition % len(c["members"])] if c["members"] else None

    def _create_consumer_group(self, name: str, topic: str) -> None:
        if topic not in self.views:
            self._entry("tables", topic)
        self._new("consumers", name, {"topic": topic, "members": [], "offsets": {str(p): 0 for p in range(CONSUMER_PARTITIONS)}})

    def _drop_consumer_group(self, name: str) -> None:
        self._entry("consumers", name)
        del self.catalog["consumers"][name]
        self._save()

    def _join_group(self, group: str, member: str) -> None:
        c = self._entry("consumers", group)
        if member not in c["members"]:
            c["members"].append(member)
            self._save()

    def _leave_group(self, group: str, member: str) -> None:
        c = self._entry("consumers", group)
        if member in c["members"]:
            c["members"].remove(member)
            self._save()

    def _commit_offset(self, group: str, member: str | None, offset: int) -> None:
        """Never moves back; a member commits its own partitions."""
        c = self._entry("consumers", group)
        for p in range(CONSUMER_PARTITIONS):
            if member is None or self._owner(c, p) == member:
                c["offsets"][str(p)] = max(c["offsets"][str(p)], offset)
        self._save()

    # partitions
    def partitions(self, table: str) -> list[tuple[str, datetime, datetime]]:
        """(folder, begin, end) of each partition."""
        part = self._part(self._entry("tables", table))
        hours = part.endswith("hour")
        out = []
        for n in self.files.names(self.path(table)):
            if m := re.fullmatch(rf"{part}=(\d+)", n):
                begin = datetime.strptime(m[1], "%Y%m%d%H" if hours else "%Y%m%d")
                out.append((n, begin, begin + (timedelta(hours=1) if hours else timedelta(days=1))))
        return out

    def _swap(self, table: str, name: str, fresh: str | None) -> None:
        """Puts the folder ``fresh`` (or nothing) in a partition's place. The old one is renamed aside first and deleted last;
        ``recover`` brings it back if the work ends in between."""
        here, aside = f"{self.path(table)}/{name}", f"{self.path(table)}/_old-{name.replace('=', '-')}"  # no partition's name
        self.files.rename(here, aside)
        if fresh:
            self.files.rename(fresh, here)
        else:
            self.files.write_json(f"{aside}/_empty", True)
        self.files.delete(aside)

    def recover(self, table: str) -> int:
        """Settles rewrites that were broken off: partitions set aside without a successor come back, remains go."""
        here, done = self.path(table), 0
        names = self.files.names(here)
        for n in names:
            if n.startswith("_old-"):
                back = "=".join(n.removeprefix("_old-").rsplit("-", 1))
                if back not in names and not self.files.exists(f"{here}/{n}/_empty"):
                    self.files.rename(f"{here}/{n}", f"{here}/{back}")
                    done += 1
                else:
                    self.files.delete(f"{here}/{n}")
            elif n.startswith(("_new-", "_gone-")):
                self.files.delete(f"{here}/{n}")
        return done

    def _drop_partitions(self, table: str, gone: Callable[[datetime, datetime], bool]) -> int:
        names = [n for n, begin, end in self.partitions(table) if gone(begin, end)]
        for n in names:  # renamed first, so that a reader's listing never sees half a partition
            aside = f"{self.path(table)}/_gone-{uuid.uuid4().hex}"
            self.files.rename(f"{self.path(table)}/{n}", aside)
            self.files.delete(aside)
        return len(names)

    def _delete_from(self, table: str, where) -> int:
        """Drops the partitions that lie wholly in the range; rows of partitions on its border stay."""
        ts = self._time(self._entry("tables", table))
        low, high = datetime.min, datetime.max  # [low, high)
        todo = [where]
        while todo:
            e = todo.pop()
            if isinstance(e, a.Binary) and e.op == "AND":
                todo += [e.left, e.right]
                continue
            if isinstance(e, a.Between) and not e.negated:
                todo += [a.Binary(">=", e.arg, e.low), a.Binary("<=", e.arg, e.high)]
                continue
            if not (isinstance(e, a.Binary) and isinstance(e.left, a.Name) and e.left.name == ts and isinstance(e.right, a.Literal) and e.op in ("<", "<=", ">", ">=")):
                raise QueryError(f"DELETE takes ranges of {ts}")
            at, step = self._value(e.right.value, "TIMESTAMP"), timedelta(microseconds=1)
            if e.op in (">", ">="):
                low = max(low, at + step if e.op == ">" else at)
            else:
                high = min(high, at + step if e.op == "<=" else at)
        return self._drop_partitions(table, lambda begin, end: begin >= low and end <= high)

    def delete_exact(self, table: str, where: str) -> None:
        """Deletes matching rows, also of border partitions, by rewriting the partitions that hold any."""
        self.recover(table)
        s = self.table(table)
        cond = F.coalesce(Builder(self.table).expr(s.df, parse(f"SELECT * FROM x WHERE {where}").where), F.lit(False))
        for (n,) in s.df.where(cond).select(s.part).distinct().collect():
            keep, aside = s.df.where((F.col(s.part) == n) & ~cond).drop(s.part), f"{self.path(table)}/_new-{uuid.uuid4().hex}"
            keep.write.parquet(aside)
            left = not self.spark.read.schema(keep.schema).parquet(aside).isEmpty()
            self._swap(table, f"{s.part}={n}", aside if left else None)
            if not left:
                self.files.delete(aside)

    def sweep(self, rules: Sequence[tuple[str, str]], now: datetime) -> dict[str, int]:
        """Retention: the first rule (name pattern, interval) that fits a table drops partitions that ended before now - interval."""
        out = {}
        for table in self.catalog["tables"]:
            keep = next((i for pattern, i in rules if fnmatch.fnmatchcase(table, pattern)), None)
            if keep:
                limit = now - timedelta(microseconds=interval_nanos(keep) // 1000)
                out[table] = self._drop_partitions(table, lambda _, end, limit=limit: end <= limit)
        return out

    def trim_after(self, table: str, instant: datetime) -> int:
        """Point in time: drops partitions that begin after the instant."""
        return self._drop_partitions(table, lambda begin, _: begin > instant)

    def compact(self, table: str, files: int = 1) -> int:
        """Rewrites partitions of more than ``files`` files, sorted by time."""
        ts, done = self._time(self._entry("tables", table)), 0
        self.recover(table)
        for n, *_ in self.partitions(table):
            here = f"{self.path(table)}/{n}"
            if sum(x.endswith(".parquet") for x in self.files.names(here)) > files:
                aside = f"{self.path(table)}/_new-{uuid.uuid4().hex}"
                self.spark.read.schema(self.schema(table)).parquet(here).repartitionByRange(files, ts).sortWithinPartitions(ts).write.parquet(aside)
                self._swap(table, n, aside)
                done += 1
        return done

    # data out
    def _export_table(self, table: str, path: str) -> int:
        s = self.table(table)
        s.df.repartition(s.part).sortWithinPartitions(s.ts).write.mode("overwrite").partitionBy(s.part).parquet(path)
        return len([n for n in self.files.names(path) if n.startswith("_part_")])

    def _copied(self, name: str, path: str, to: str) -> None:
        """One table's rows from folder to folder, by the executors, as they are stored."""
        t = self._entry("tables", name)
        part = self._part(t)
        rows = self.spark.read.schema(T.StructType([*self.schema(name).fields, T.StructField(part, T.StringType())])).parquet(path)
        rows.sortWithinPartitions(part, self._time(t)).write.mode("overwrite").partitionBy(part).parquet(to)

    def _state(self, name: str) -> dict:
        s = self.table(name)
        n, last = s.df.agg(F.count(F.lit(1)), F.max(s.ts).cast("string")).first()
        return {"rows": n, "last": last}

    def backup(self, to: str) -> dict:
        """Copies catalog and tables; the manifest, written last, makes the set valid."""
        tables = {}
        for name in self.catalog["tables"]:
            if self.files.names(self.path(name)):
                self._copied(name, self.path(name), f"{to}/data/{name}")
            tables[name] = self._state(name)
        manifest = {"tables": tables, "catalog": self.catalog}
        self.files.write_json(f"{to}/manifest.json", manifest)
        return manifest

    @classmethod
    def restore(cls, spark: SparkSession, source: str, root: str) -> Engine:
        """A new engine from a backup. Tables that are already whole are left, so a broken restore can go on."""
        files = Files(spark)
        manifest = files.read_json(f"{source}/manifest.json")
        if manifest is None:
            raise FileNotFoundError(f"no manifest in {source}")
        out = cls(spark, root)
        out.catalog = manifest["catalog"]
        for name in manifest["tables"]:
            if files.names(f"{source}/data/{name}") and not files.exists(f"{root}/data/{name}"):
                out._copied(name, f"{source}/data/{name}", f"{root}/data/_restoring-{name}")
                files.rename(f"{root}/data/_restoring-{name}", f"{root}/data/{name}")
        out._save()
        return out

    def migrate(self, to: Engine, tables: Sequence[str], drop: bool = False) -> dict[str, int]:
        """Moves tables into another engine's store: rows a table. Done over, it copies nothing twice: a table that the other
        store already holds whole is left, and one that it holds otherwise is refused. With drop the own copy goes once the
        other's rows and last time are the same."""
        out = {}
        for name in tables:
            t, state = self._entry("tables", name), self._state(name)
            to.refresh()
            if name not in to.catalog["tables"]:
                if t.get("stable") and t["stable"] not in to.catalog["stables"]:
                    to._new("stables", t["stable"], self.catalog["stables"][t["stable"]])
                if self.files.names(self.path(name)):
                    self._copied(name, self.path(name), to.path(name))
                to._new("tables", name, t)
            if to.catalog["tables"][name] != t or to._state(name) != state:
                raise QueryError(f"{name} differs in the other store")
            out[name] = state["rows"]
            if drop:
                self._drop_table(name)
        return out

    def stats(self, table: str) -> DataFrame:
        """column, least, most (as text) and rows: of every number column from the files' footers alone, of the time column from
        the first and the last partition.

        Parquet's own statistics are asked for by aggregate push-down, which only Spark's second Parquet reader has (and not for
        times); a session of its own has that reader and the setting.
        """
        t = self._entry("tables", table)
        names, ts, part = [c for c, k in self._shape(t) if k not in ("SYMBOL", "TIMESTAMP")], self._time(t), self._part(t)
        session = self.spark.newSession()
        for key, value in (("spark.sql.sources.useV1SourceList", ""), ("spark.sql.parquet.aggregatePushdown", "true"), ("spark.sql.session.timeZone", "UTC")):
            session.conf.set(key, value)
        full = T.StructType([*self.schema(table).fields, T.StructField(part, T.StringType())])
        held = sorted(n.split("=")[1] for n, *_ in self.partitions(table))
        rows = session.read.schema(full).parquet(self.path(table)) if held else session.createDataFrame([], full)
        found = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate(names) for f in (F.min, F.max)]).withColumn("one", F.lit(1))
        ends = rows.where(F.col(part).isin(held[:1] + held[-1:])).agg(F.min(ts).alias("min_t"), F.max(ts).alias("max_t")).withColumn("one", F.lit(1))
        told = lambda c, i: F.struct(F.lit(c).alias("column"), F.col(f"min_{i}").cast("string").alias("least"), F.col(f"max_{i}").cast("string").alias("most"), F.col("n").alias("rows"))
        return found.join(ends, "one").select(F.explode(F.array(told(ts, "t"), *[told(c, i) for i, c in enumerate(names)])).alias("x")).select("x.*")

    def verify(self, manifest: dict) -> list[str]:
        """Tables whose rows or last time differ from the manifest."""
        bad = []
        for name, want in manifest["tables"].items():
            if self._state(name) != want:
                bad.append(name)
        return bad


class Batch:
    """Rows gathered and committed at once."""

    def __init__(self, engine: Engine, table: str):
        self.engine, self.table, self.rows = engine, table, []

    def row(self, **values) -> Batch:
        shape = self.engine._shape(self.engine._entry("tables", self.table))
        if set(values) != {c for c, _ in shape}:
            raise QueryError("a row has every column")
        self.rows.append(tuple(values[c] if isinstance(values[c], datetime) else self.engine._value(values[c], k) for c, k in shape))
        return self

    def commit(self) -> int:
        rows, self.rows = self.rows, []
        if rows:
            self.engine.append(self.table, self.engine.spark.createDataFrame(rows, self.engine.schema(self.table)))
        return len(rows)

    def discard(self) -> None:
        self.rows = []
