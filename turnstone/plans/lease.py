"""One writer at a time: a lock file beside the index, on the file system that holds it."""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from dataclasses import dataclass

from turnstone.plans.files import Files

#: Seconds after which a lock that can't be read is broken, and one of a process on another machine, which can't be asked for.
STALE_S, STALE_ELSEWHERE_S = 30, 24 * 3600


@dataclass
class Lease:
    files: Files
    name: str
    token: str

    def release(self) -> bool:
        """Delete the lock if it's still this one's."""
        held = _read(self.files, self.name)
        if held is None or held.get("token") != self.token:
            return False
        return self.files.delete(self.name)


def _read(files: Files, name: str) -> dict | None:
    try:
        found = json.loads(files.read(name) or "")
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _alive(pid: object) -> bool:
    if not isinstance(pid, int) or pid <= 0:
        return False
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except OSError:
        return True
    return True


def _held(files: Files, name: str) -> bool | None:
    """Whether a lock holds; None where it has gone meanwhile."""
    said, age = _read(files, name), files.age(name)
    if age is None:
        return None
    if said is None:
        return age <= STALE_S
    if said.get("host", socket.gethostname()) != socket.gethostname():
        return age <= STALE_ELSEWHERE_S
    return _alive(said.get("pid"))


def acquire(files: Files, name: str = "writer.lock") -> Lease | None:
    """The lease, or None while a living process holds it. A dead owner's lock is broken; others once they're old."""
    for _ in range(2):
        token = uuid.uuid4().hex
        if files.create(name, json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "startedAt": int(time.time() * 1000), "token": token})):
            return Lease(files, name, token)
        held = _held(files, name)
        if held:
            return None
        if held is False:
            files.delete(name)
    return None
