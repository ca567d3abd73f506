"""Users: names without case, passwords as PBKDF2 digests. No roles, and no user until one is created."""

from __future__ import annotations

import hashlib
import hmac
import secrets
import threading

from .errors import LoomError
from .sources.files import Folder

#: Fixed values of the password digest.
DIGEST, ROUNDS, SALT_BYTES = "sha256", 100_000, 16
FOLDER = "_users"


class Users:
    """Kept in numbered files of a folder, the newest of which counts, or in memory only.

    A change makes the next number, which only one writer can; so users are never half written, and none are lost.
    """

    def __init__(self, folder: Folder | None):
        self.folder, self._mutex = folder, threading.Lock()
        self._users: dict[str, dict[str, str]] = {}
        self._version = -1
        self._refresh()

    def _refresh(self) -> None:
        versions = [int(x.removesuffix(".json")) for x in self.folder.names(FOLDER) if x.endswith(".json")] if self.folder else []
        if versions and max(versions) > self._version:
            self._version = max(versions)
            self._users = self.folder.read(f"{FOLDER}/{self._version:020d}.json")

    def _digest(self, password: str, salt: bytes) -> str:
        return hashlib.pbkdf2_hmac(DIGEST, password.encode(), salt, ROUNDS).hex()

    def _set(self, user: str, password: str) -> None:
        salt = secrets.token_bytes(SALT_BYTES)
        self._users[user.lower()] = {"name": user, "salt": salt.hex(), "digest": self._digest(password, salt)}

    def change(self, verb: str, user: str, password: str | None) -> str:
        with self._mutex:
            self._refresh()
            before = dict(self._users)
            there = user.lower() in self._users
            if verb == "CREATE" and there:
                raise LoomError(f"User '{user}' already exists")
            if verb != "CREATE" and not there:
                raise LoomError(f"User '{user}' does not exist")
            if verb == "DROP":
                del self._users[user.lower()]
            else:
                self._set(user, password or "")
            if self.folder:
                if not self.folder.create(f"{FOLDER}/{self._version + 1:020d}.json", self._users):
                    self._users = before
                    raise LoomError("Users were changed by another session")
                self._version += 1
        return {"CREATE": f"User '{user}' created", "DROP": f"User '{user}' dropped", "ALTER": f"Password updated for '{user}'"}[verb]

    def accepts(self, user: str, password: str) -> bool:
        held = self._users.get(user.lower())
        salt = bytes.fromhex(held["salt"]) if held else bytes(SALT_BYTES)
        given = self._digest(password, salt)  # also for an unknown user, so that time tells nothing
        return held is not None and hmac.compare_digest(given, held["digest"])

    def names(self) -> list[str]:
        return sorted(u["name"] for u in self._users.values())
