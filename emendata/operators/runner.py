"""Programs in supervised child processes, by a fork server that one interpreter start sets up for a whole task.

The worker talks to the server in frames and never reads more of a program than a stated number of bytes. A server
that does not answer in time, as a program may kill it, is replaced, and its program counts as gone.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import os
import pkgutil
import select
import signal
import struct
import subprocess
import sys
import time

#: Bounds of a program: memory, and bytes of its output and of each file it writes.
MEMORY, OUTPUT = 4 << 30, 64 << 20
#: Seconds beyond a program's own time after which the server itself counts as lost.
GRACE = 10.0


class Runner:
    """A fork server. ``starts`` counts the interpreters that it took."""

    def __init__(self, memory: int = MEMORY, output: int = OUTPUT):
        self.memory, self.output, self.starts = memory, output, 0
        self._server: subprocess.Popen | None = None

    def _started(self) -> subprocess.Popen:
        if self._server is None or self._server.poll() is not None:
            text = pkgutil.get_data(__package__, "forkserver.py").decode()
            self._server = subprocess.Popen([sys.executable, "-I", "-c", text], stdin=subprocess.PIPE, stdout=subprocess.PIPE, bufsize=0, env={"PATH": "/usr/bin:/bin", "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "TMPDIR": os.environ.get("TMPDIR", "/tmp")}, start_new_session=True)
            self.starts += 1
        return self._server

    def _asked(self, message: dict, seconds: float) -> dict:
        server = self._started()
        data = json.dumps(message).encode()
        until = time.monotonic() + seconds + GRACE
        try:
            server.stdin.write(struct.pack(">I", len(data)) + data)
            head = self._read(server, 4, until)
            if head and (body := self._read(server, struct.unpack(">I", head)[0], until)):
                return json.loads(body)
        except OSError:
            pass
        self.close()
        return {"ended": "gone"}

    def _read(self, server: subprocess.Popen, n: int, until: float) -> bytes:
        out = bytearray()
        while len(out) < n:
            if not select.select([server.stdout], [], [], max(0.0, until - time.monotonic()))[0] or not (part := os.read(server.stdout.fileno(), min(n - len(out), 1 << 20))):
                return b""
            out += part
        return bytes(out)

    def script(self, code: str, given: str, seconds: float) -> tuple[str | None, str, int]:
        """(standard output, or null past the time; standard error; return code) of a script of its own."""
        done = self._asked({"op": "script", "code": code, "input": given, "seconds": seconds, "memory": self.memory, "bytes": self.output}, seconds)
        if done["ended"] == "over":
            return None, "", -1
        return done.get("output", ""), done.get("error", ""), done.get("exit", 1) if done["ended"] == "ok" else 1

    @contextlib.contextmanager
    def session(self, kind: str, code: str, seconds: float, until: float, **more):
        """(what came of preparing the program, a function that runs a step and gives its reply)."""
        limits = {"memory": self.memory, "bytes": self.output}
        made = self._asked({"op": "open", "kind": kind, "code": code, "seconds": seconds, "until": until, **limits, **more}, until)

        def step(until: float, **job) -> dict:
            return self._asked({"op": "step", "seconds": seconds, "until": until, **limits, **job}, until)

        server = self._server
        try:
            yield made, step
        finally:
            if self._server is server and server is not None:
                self._asked({"op": "close"}, 0)

    def close(self) -> None:
        server, self._server = self._server, None
        if server is not None:
            with contextlib.suppress(OSError):
                os.killpg(server.pid, signal.SIGKILL)
            for pipe in (server.stdin, server.stdout):
                with contextlib.suppress(OSError):
                    pipe.close()
            server.wait()


_shared: list[Runner] = []


def shared() -> Runner:
    """The runner of this worker process."""
    if not _shared:
        _shared.append(Runner())
        atexit.register(_shared[0].close)
    return _shared[0]
