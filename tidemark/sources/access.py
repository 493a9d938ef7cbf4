"""Users, privileges and what each statement needs. The engine asks only when a statement comes with a user's name."""

from __future__ import annotations

import hashlib
import hmac
import os

from ..plans import ast as a
from ..plans.lexer import QueryError
from .files import Files

PRIVILEGES = ("SELECT", "INSERT", "DDL")
ROUNDS = 10_000
ADMIN_ONLY = {"create_user", "alter_user", "drop_user", "list_users", "show_users", "grant", "revoke", "create_function", "drop_function"}
READS = {"describe", "export_table", "use_database", "use_group"}
WRITES = {"insert_into", "write_to"}


class Denied(QueryError):
    """The user lacks a privilege."""


def needs(s) -> tuple[str, list[str]]:
    """(privilege, or ADMIN; the objects it is needed on, * for the catalog at large)."""
    if isinstance(s, a.Select):
        return "SELECT", [t for t in (s.table, s.asof) if t]
    if s.verb in ADMIN_ONLY:
        return "ADMIN", [str(s.args.get("name", "*"))]
    consumer = "offset" in s.args or "member" in s.args or "consumer" in s.verb
    on = ["*"] if consumer or s.verb.endswith("_device") else [str(s.args.get("table") or s.args.get("name") or "*")]
    if s.verb in WRITES:
        return "INSERT", on
    return "SELECT" if s.verb in READS or s.verb.split("_")[0] in ("list", "show") else "DDL", on


def kind(s) -> str:
    """The class of a statement in the audit log."""
    if s is None:
        return "INVALID"
    if isinstance(s, a.Select) or s.verb in READS or s.verb.split("_")[0] in ("list", "show"):
        return "QUERY"
    if s.verb in ADMIN_ONLY and "function" not in s.verb:
        return "AUTH"
    return "DATA" if s.verb in WRITES | {"delete_from", "truncate_table", "commit_offset", "join_group", "leave_group"} else "DDL"


class Access:
    """Users in one JSON file beside the catalog; passwords as salted PBKDF2 hashes."""

    def __init__(self, files: Files, path: str):
        self.files, self.path = files, path
        self.users: dict[str, dict] = files.read_json(path, {})

    def _save(self) -> None:
        self.files.write_json(self.path, self.users)

    def _user(self, name: str) -> dict:
        if name not in self.users:
            raise QueryError(f"no user {name}")
        return self.users[name]

    @staticmethod
    def _hash(password: str, salt: bytes) -> str:
        return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ROUNDS).hex()

    def _secret(self, password: str) -> dict:
        salt = os.urandom(16)
        return {"salt": salt.hex(), "hash": self._hash(password, salt)}

    def create(self, name: str, password: str, admin: bool = False) -> None:
        if name in self.users:
            raise QueryError(f"{name} exists")
        self.users[name] = self._secret(password) | {"admin": admin, "grants": {}}
        self._save()

    def set_password(self, name: str, password: str) -> None:
        self._user(name).update(self._secret(password))
        self._save()

    def drop(self, name: str) -> None:
        self._user(name)
        del self.users[name]
        self._save()

    def grant(self, name: str, privilege: str, on: str) -> None:
        held = self._user(name)["grants"]
        held[on] = sorted({*held.get(on, ()), *(PRIVILEGES if privilege == "ALL" else (privilege,))})
        self._save()

    def revoke(self, name: str, privilege: str, on: str) -> None:
        held = self._user(name)["grants"]
        left = [p for p in held.get(on, ()) if privilege not in ("ALL", p)]
        held.pop(on, None)
        if left:
            held[on] = left
        self._save()

    def authenticate(self, name: str, password: str) -> bool:
        u = self.users.get(name)
        return bool(u) and hmac.compare_digest(u["hash"], self._hash(password, bytes.fromhex(u["salt"])))

    def allowed(self, name: str, privilege: str, on: str) -> bool:
        """Admins may do all; others what is granted on the object or on *."""
        u = self._user(name)
        return u["admin"] or any(privilege in u["grants"].get(x, ()) for x in (on, "*"))

    def check(self, name: str, s) -> None:
        privilege, objects = needs(s)
        for on in objects:
            if not self.allowed(name, privilege, on):
                raise Denied(f"{name} needs {privilege} on {on}")

    def rows(self) -> list[tuple[str, str, str]]:
        return [(n, "ADMIN" if u["admin"] else "NORMAL", "; ".join(f"{', '.join(p)} ON {on}" for on, p in sorted(u["grants"].items()))) for n, u in sorted(self.users.items())]
