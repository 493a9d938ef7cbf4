"""Recursive descent from text to statements."""

from __future__ import annotations

from . import ast as a
from .lexer import QueryError, Token, tokens

_END_OF_EXPR = {"FROM", "AS", "WHERE", "SAMPLE", "SESSION", "STATE_WINDOW", "EVENT_WINDOW", "LATEST", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "PARTITION", "FILL", "ASOF", "ON", "ASC", "DESC", "AND", "OR"}
_COMPARE = {"=": "=", "!=": "!=", "<>": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
COLUMN_TYPES = ("TIMESTAMP", "INT64", "FLOAT64", "FLOAT32", "SYMBOL")


class Parser:
    def __init__(self, text: str):
        self.text, self.all, self.i = text, tokens(text), 0

    # tokens
    @property
    def now(self) -> Token:
        return self.all[self.i]

    def is_word(self, *words: str) -> bool:
        return all(self.i + k < len(self.all) and self.all[self.i + k].kind == "name" and self.all[self.i + k].text.upper() == w for k, w in enumerate(words))

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.word(*words):
            raise self.error(f"expected {' '.join(words)}")

    def op(self, text: str) -> bool:
        if self.now.kind == "op" and self.now.text == text:
            self.i += 1
            return True
        return False

    def need_op(self, text: str) -> None:
        if not self.op(text):
            raise self.error(f"expected {text!r}")

    def take(self, kind: str) -> Token:
        if self.now.kind != kind:
            raise self.error(f"expected a {kind}")
        self.i += 1
        return self.all[self.i - 1]

    def name(self) -> str:
        return str(self.take("name").value)

    def error(self, why: str) -> QueryError:
        return QueryError(f"{why} at {self.now.at}: {self.text[self.now.at : self.now.at + 20]!r}")

    def list_of(self, one) -> list:
        out = [one()]
        while self.op(","):
            out.append(one())
        return out

    # expressions
    def expr(self):
        left = self.conjunction()
        while self.word("OR"):
            left = a.Binary("OR", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.word("AND"):
            left = a.Binary("AND", left, self.negation())
        return left

    def negation(self):
        return a.Unary("NOT", self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self):
        left = self.sum()
        if self.now.kind == "op" and self.now.text in _COMPARE:
            self.i += 1
            return a.Binary(_COMPARE[self.all[self.i - 1].text], left, self.sum())
        if self.word("IS"):
            negated = self.word("NOT")
            self.need("NULL")
            return a.IsNull(left, negated)
        negated = self.word("NOT")
        if self.word("IN"):
            self.need_op("(")
            items = tuple(self.list_of(self.sum))
            self.need_op(")")
            return a.In(left, items, negated)
        if self.word("BETWEEN"):
            low = self.sum()
            self.need("AND")
            return a.Between(left, low, self.sum(), negated)
        if negated:
            raise self.error("expected IN or BETWEEN")
        return left

    def sum(self):
        left = self.product()
        while self.now.kind == "op" and self.now.text in "+-":
            self.i += 1
            left = a.Binary(self.all[self.i - 1].text, left, self.product())
        return left

    def product(self):
        left = self.unary()
        while self.now.kind == "op" and self.now.text in "*/%":
            self.i += 1
            left = a.Binary(self.all[self.i - 1].text, left, self.unary())
        return left

    def unary(self):
        if self.op("-"):
            return a.Unary("-", self.unary())
        self.op("+")
        return self.primary()

    def primary(self):
        t = self.now
        if t.kind in ("number", "string"):
            self.i += 1
            return a.Literal(t.value)
        if t.kind == "interval":
            self.i += 1
            return a.Interval(t.value, t.text)
        if self.op("("):
            inner = self.expr()
            self.need_op(")")
            return inner
        if t.kind == "op" and t.text == "*":
            self.i += 1
            return a.Star()
        if t.kind == "name":
            if t.text.upper() in _END_OF_EXPR:
                raise self.error("expected an expression")
            for word, value in (("NULL", None), ("TRUE", True), ("FALSE", False)):
                if self.word(word):
                    return a.Literal(value)
            name = self.name()
            if self.op("("):
                args = () if self.now.text == ")" and self.now.kind == "op" else tuple(self.list_of(self.expr))
                self.need_op(")")
                return a.Call(name.lower(), args)
            if self.op("."):
                return a.Name(self.name())
            return a.Name(name)
        raise self.error("expected an expression")

    # SELECT
    def item(self) -> a.Item:
        start = self.now.at
        e = self.expr()
        last = self.all[self.i - 1]
        return a.Item(e, self.name() if self.word("AS") else None, self.text[start : last.at + len(last.text)])

    def interval(self) -> a.Interval:
        if self.now.kind == "string":
            from .lexer import interval_nanos

            text = str(self.take("string").value)
            return a.Interval(interval_nanos(text), text)
        t = self.take("interval")
        return a.Interval(t.value, t.text)

    def select(self) -> a.Select:
        distinct = self.word("DISTINCT")
        items = self.list_of(self.item)
        self.need("FROM")
        q = a.Select(items, self.name(), distinct)
        while self.now.kind != "end" and not self.op(";"):
            self.clause(q)
        if self.now.kind != "end":
            raise self.error("trailing tokens")
        windows = [x for x in (q.sample, q.session, q.state, q.event, q.latest) if x is not None]
        if len(windows) > 1:
            raise QueryError("only one of SAMPLE BY, SESSION, STATE_WINDOW, EVENT_WINDOW, LATEST ON")
        if q.distinct and q.group_by:
            raise QueryError("DISTINCT and GROUP BY exclude each other")
        if q.having is not None and not q.group_by:
            raise QueryError("HAVING needs GROUP BY")
        if q.fill is not None and q.sample is None:
            raise QueryError("FILL needs SAMPLE BY")
        return q

    def once(self, held, what: str) -> None:
        if held not in (None, []):
            raise self.error(f"{what} twice")

    def clause(self, q: a.Select) -> None:
        if self.word("ASOF", "JOIN"):
            self.once(q.asof, "ASOF JOIN")
            q.asof = self.name()
            if self.word("ON"):
                q.asof_on = self.list_of(self.pair)
        elif self.word("WHERE"):
            self.once(q.where, "WHERE")
            q.where = self.expr()
        elif self.word("PARTITION", "BY"):
            self.once(q.partition_by, "PARTITION BY")
            q.partition_by = self.list_of(self.name)
        elif self.word("SAMPLE", "BY"):
            self.once(q.sample, "SAMPLE BY")
            q.sample = self.interval()
        elif self.word("FILL"):
            self.once(q.fill, "FILL")
            self.need_op("(")
            if self.now.kind == "name":
                q.fill = self.name().lower()
                if q.fill not in ("prev", "null", "linear"):
                    raise self.error("unknown FILL")
            else:
                sign = -1 if self.op("-") else 1
                q.fill = sign * self.take("number").value
            self.need_op(")")
        elif self.word("SESSION"):
            self.need_op("(")
            self.name()
            self.need_op(",")
            q.session = self.interval()
            self.need_op(")")
        elif self.word("STATE_WINDOW"):
            self.need_op("(")
            q.state = self.name()
            self.need_op(")")
        elif self.word("EVENT_WINDOW"):
            self.need_op("(")
            start = self.expr()
            self.need_op(",")
            q.event = (start, self.expr())
            self.need_op(")")
        elif self.word("LATEST", "ON"):
            q.latest = self.name()
        elif self.word("GROUP", "BY"):
            self.once(q.group_by, "GROUP BY")
            q.group_by = self.list_of(self.expr)
        elif self.word("HAVING"):
            q.having = self.expr()
        elif self.word("ORDER", "BY"):
            q.order_by = self.list_of(self.sort_key)
        elif self.word("LIMIT"):
            q.limit = self.whole()
        elif self.word("OFFSET"):
            q.offset = self.whole()
        else:
            raise self.error("trailing tokens")

    def whole(self) -> int:
        n = self.take("number").value
        if not isinstance(n, int):
            raise self.error("expected a whole number")
        return n

    def pair(self) -> tuple[str, str]:
        left = self.qualified()
        self.need_op("=")
        return left, self.qualified()

    def qualified(self) -> str:
        name = self.name()
        return self.name() if self.op(".") else name

    def sort_key(self) -> tuple[str, bool]:
        name = self.name()
        if self.op("("):  # the derived name of an aggregate
            start = self.all[self.i - 2].at
            while not self.op(")"):
                if self.now.kind == "end":
                    raise self.error("expected )")
                self.i += 1
            name = self.text[start : self.all[self.i - 1].at + 1]
        down = self.word("DESC")
        if not down:
            self.word("ASC")
        return name, down

    # statements
    def statement(self):
        if self.word("SELECT"):
            return self.select()
        for words, make in self.VERBS:
            if self.word(*words):
                args = make(self)
                self.op(";")
                if self.now.kind != "end":
                    raise self.error("trailing tokens")
                return a.Statement("_".join(words).lower(), args)
        raise self.error("unknown statement")

    def value(self):
        sign = -1 if self.op("-") else 1
        t = self.now
        if t.kind in ("number", "string", "interval"):
            self.i += 1
            return sign * t.value if t.kind == "number" else t.value
        if self.word("NULL"):
            return None
        raise self.error("expected a value")

    def parens(self, one) -> list:
        self.need_op("(")
        out = self.list_of(one)
        self.need_op(")")
        return out

    def column(self) -> tuple[str, str]:
        name, kind = self.name(), self.name().upper()
        if kind not in COLUMN_TYPES:
            raise self.error(f"unknown type {kind}")
        return name, kind

    def props(self) -> dict:
        def one():
            key = self.name().lower()
            self.need_op("=")
            t = self.now
            self.i += 1
            if t.kind not in ("string", "number", "interval", "name"):
                raise self.error("expected a value")
            return key, t.value

        return dict(self.parens(one) if self.now.text == "(" else self.list_of(one)) if self.word("WITH") else {}

    def insert(self):
        table = self.name()
        cols = self.parens(self.name) if self.now.text == "(" else None
        self.need("VALUES")
        return {"table": table, "columns": cols, "rows": self.list_of(lambda: self.parens(self.value))}

    def create_table(self):
        name = self.name()
        if self.word("USING"):
            stable = self.name()
            self.need("TAGS")
            return {"name": name, "stable": stable, "tags": self.parens(self.value)}
        cols = self.parens(self.column)
        self.need("TIMESTAMP")
        self.need_op("(")
        ts = self.name()
        self.need_op(")")
        return {"name": name, "columns": cols, "ts": ts, "props": self.props()}

    def create_stable(self):
        name, cols = self.name(), self.parens(self.column)
        ts = None
        if self.word("TIMESTAMP"):
            self.need_op("(")
            ts = self.name()
            self.need_op(")")
        self.need("TAGS")
        out = {"name": name, "columns": cols, "tags": self.parens(self.column), "ts": ts or next((c for c, t in cols if t == "TIMESTAMP"), None)}
        return out | self.inside()

    def inside(self):
        if not self.word("IN"):
            return {}
        kind = "database" if self.word("DATABASE") else "group" if self.word("GROUP") else None
        if not kind:
            raise self.error("expected DATABASE or GROUP")
        return {kind: self.name()}

    def named(self):
        return {"name": self.name()} | self.inside() | {"props": self.props()}

    def maybe_inside(self):
        return self.inside()

    def delete(self):
        table = self.name()
        self.need("WHERE")
        return {"table": table, "where": self.expr()}

    def alter(self):
        table = self.name()
        self.need("ADD")
        self.word("COLUMN")
        return {"table": table, "column": self.column()}

    def export(self):
        table = self.name()
        self.need("TO", "PARQUET")
        return {"table": table, "path": self.take("string").value}

    def function(self):
        name, args = self.name(), self.parens(lambda: self.name().upper())
        self.need("RETURNS")
        returns = self.name().upper()
        self.need("FROM")
        path = self.take("string").value
        return {"name": name, "args": args, "returns": returns, "from": path, "symbol": self.take("string").value if self.word("SYMBOL") else name}

    def consumer_group(self):
        name = self.name()
        self.need("ON")
        return {"name": name, "topic": self.name()}

    def member(self):
        group = self.name()
        self.need("AS")
        return {"group": group, "member": self.name()}

    def commit(self):
        out = {"group": self.name(), "member": None, "offset": None}
        for _ in range(2):
            if self.word("AS"):
                out["member"] = self.name()
            elif self.word("AT"):
                out["offset"] = self.whole()
        if out["offset"] is None:
            raise self.error("expected AT")
        return out

    def write(self):
        table = self.name()
        self.need("FROM", "FILE")
        return {"table": table, "path": self.take("string").value}

    def user(self):
        name = self.name()
        self.need("IDENTIFIED", "BY")
        return {"name": name, "password": self.take("string").value}

    def new_user(self):
        out = self.user() | {"admin": False}
        if self.word("ROLE"):
            out["admin"] = self.word("ADMIN")
            if not out["admin"]:
                self.need("NORMAL")
        return out

    def privilege(self, link: str):
        privilege = self.name().upper()
        if privilege not in ("SELECT", "INSERT", "DDL", "ALL"):
            raise self.error("expected SELECT, INSERT, DDL or ALL")
        self.need("ON")
        on = "*" if self.op("*") else self.name()
        self.need(link)
        return {"privilege": privilege, "on": on, "name": self.name()}

    def granted(self):
        return self.privilege("TO")

    def revoked(self):
        return self.privilege("FROM")

    def described(self):
        self.word("STABLE") or self.word("TABLE")
        return {"name": self.name()}

    def one_name(self):
        return {"name": self.name()}

    def nothing(self):
        return {}

    VERBS = [
        (("INSERT", "INTO"), insert),
        (("CREATE", "TABLE"), create_table),
        (("CREATE", "PTABLE"), create_table),
        (("CREATE", "STABLE"), create_stable),
        (("CREATE", "VTABLE"), create_stable),
        (("CREATE", "DATABASE"), named),
        (("CREATE", "GROUP"), named),
        (("CREATE", "DEVICE"), named),
        (("CREATE", "CONSUMER", "GROUP"), consumer_group),
        (("CREATE", "FUNCTION"), function),
        (("CREATE", "USER"), new_user),
        (("ALTER", "USER"), user),
        (("DROP", "USER"), one_name),
        (("GRANT",), granted),
        (("REVOKE",), revoked),
        (("DROP", "CONSUMER", "GROUP"), one_name),
        (("DROP", "TABLE"), one_name),
        (("DROP", "PTABLE"), one_name),
        (("DROP", "STABLE"), one_name),
        (("DROP", "VTABLE"), one_name),
        (("DROP", "DATABASE"), one_name),
        (("DROP", "GROUP"), one_name),
        (("DROP", "DEVICE"), named),
        (("DROP", "FUNCTION"), one_name),
        (("TRUNCATE", "TABLE"), one_name),
        (("ALTER", "TABLE"), alter),
        (("DELETE", "FROM"), delete),
        (("DESCRIBE",), described),
        (("EXPORT", "TABLE"), export),
        (("JOIN", "GROUP"), member),
        (("LEAVE", "GROUP"), member),
        (("COMMIT", "OFFSET"), commit),
        (("USE", "DATABASE"), one_name),
        (("USE", "GROUP"), one_name),
        (("WRITE", "TO"), write),
    ]


Parser.VERBS += [((verb, what), Parser.maybe_inside) for verb in ("LIST", "SHOW") for what in ("DATABASES", "GROUPS", "DEVICES", "TABLES", "STABLES", "VTABLES", "PTABLES", "FUNCTIONS", "CONSUMERS", "USERS")]


def parse(text: str):
    """A Select or a Statement."""
    return Parser(text).statement()
