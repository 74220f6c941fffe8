"""The fork server of runner.py: a process of its own that needs nothing of this package but this text.

It reads frames (four bytes of length, then JSON) from standard input and answers each on standard output. A program
runs in a child that it forks: one interpreter start serves all programs of a task. The child leads a session of its
own, in an empty folder, under limits of memory, file size and core. It reports through a pipe, of which no more than
a stated number of bytes is read. When it ends or its time is over, its whole session is killed; whatever has left
that session becomes the server's own child, as the server is their subreaper, and is killed as well.
"""

import contextlib
import ctypes
import io
import json
import os
import resource
import select
import shutil
import signal
import struct
import sys
import tempfile
import time
import types
import unittest

PR_SET_PDEATHSIG, PR_SET_CHILD_SUBREAPER = 1, 36


def control(option, value):
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).prctl(option, value, 0, 0, 0)


def write_all(fd, data, until=None):
    """Whether all was written before ``until``; a reader that has gone counts as not."""
    view = memoryview(data)
    while view:
        if until is not None and not select.select([], [fd], [], max(0.0, until - time.monotonic()))[1]:
            return False
        try:
            view = view[os.write(fd, view[:65536] if until is not None else view) :]
        except BlockingIOError:
            continue
        except OSError:
            return False
    return True


def read_exact(fd, n, until=None, child=None):
    """``n`` bytes, None where the writer has gone before, or False past the time.

    ``child`` is a descriptor of the writing process: others may hold the pipe open when that has ended.
    """
    out = bytearray()
    while len(out) < n:
        if until is not None:
            ready = select.select([fd] if child is None else [fd, child], [], [], max(0.0, until - time.monotonic()))[0]
            if not ready:
                return False
            if fd not in ready:
                return None
        part = os.read(fd, min(n - len(out), 1 << 20))
        if not part:
            return None
        out += part
    return bytes(out)


def frame(message):
    data = json.dumps(message).encode("utf-8", "surrogatepass")
    return struct.pack(">I", len(data)) + data


def short(value, length=300):
    text = value if isinstance(value, str) else str(value)
    return text if len(text) <= length else text[: length // 2] + "...(truncated) ..." + text[-(length // 2) :]


# what follows runs in the child


class TimeoutException(Exception):
    pass


def alarm(*_):
    raise TimeoutException


@contextlib.contextmanager
def timer(seconds):
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)


def memory_file(data=b""):
    fd = os.memfd_create("stream")
    if data:
        os.write(fd, data) if len(data) < 1 << 30 else None
        os.lseek(fd, 0, os.SEEK_SET)
    return fd


def streams(given, out):
    """Standard input and output over files, for programs that read either by name or by number."""
    os.dup2(given, 0)
    os.dup2(out, 1)
    sys.stdin = io.TextIOWrapper(io.BufferedReader(io.FileIO(0, "r", closefd=False)), "utf-8", errors="replace")
    sys.stdout = io.TextIOWrapper(io.BufferedWriter(io.FileIO(1, "w", closefd=False)), "utf-8", errors="replace")


def flush():
    with contextlib.suppress(OSError, ValueError):
        sys.stdout.flush()


def content(fd, most):
    data, at = b"", 0
    while at < most and (part := os.pread(fd, min(1 << 20, most - at), at)):
        data += part
        at += len(part)
    return data.decode("utf-8", "replace")


class Called:
    """A function, of the class Solution where the program has one, called with a JSON value for each line."""

    def __init__(self, job):
        module = types.ModuleType("tmp_sol", "")
        exec(compile(job["code"], "<string>", "exec"), module.__dict__)
        owner = module.Solution() if "class Solution" in job["code"] else module
        self.method, self.lenient = getattr(owner, job["name"]), job.get("lenient")

    def step(self, job):
        arguments, want = [json.loads(line) for line in job["input"].split("\n")], json.loads(job["expected"])
        with timer(job["seconds"]):
            value = self.method(*arguments)
        value = list(value) if isinstance(value, tuple) else value
        right = bool(value == want)
        if self.lenient and not right:
            first = want[0] if isinstance(want, list) and want else None
            rows = [list(x) for x in value] if isinstance(value, list) and value and isinstance(value[0], tuple) else None
            right = bool(first is not None and (value == first or rows == first)) or bool(rows is not None and rows == want)
        return {"ended": "ok", "right": right, "output": short(value), "inputs": short(arguments), "expected": short(want)}


class Streamed:
    """A script as a function without arguments, run with a standard input and output for each test."""

    def __init__(self, job):
        module = types.ModuleType("tmp_sol", "")
        exec(compile(job["code"], "<string>", "exec"), module.__dict__)
        self.method = getattr(module, job["name"])

    def step(self, job):
        given, out = memory_file(job["input"].encode("utf-8", "replace")), memory_file()
        streams(given, out)
        try:
            with timer(job["seconds"]), contextlib.suppress(SystemExit):
                self.method()
            flush()
            return {"ended": "ok", "output": content(out, job["bytes"])}
        finally:
            os.close(given)
            os.close(out)


class Suite:
    """A program and its unit tests, in one module."""

    def __init__(self, job):
        self.code = job["code"] + "\n" + job["test"]

    def step(self, job):
        module = types.ModuleType("solution")
        sys.modules["solution"] = module
        with timer(job["seconds"]):
            exec(compile(self.code, "solution.py", "exec"), module.__dict__)
            result = unittest.TestResult()
            unittest.defaultTestLoader.loadTestsFromModule(module).run(result)
        details = {t.id().split(".")[-1]: e[-2000:] for t, e in result.failures + result.errors}
        return {"ended": "ok", "result": [result.testsRun, len(result.failures), len(result.errors), len(result.skipped), result.wasSuccessful(), details]}


KINDS = {"call": Called, "stdio": Streamed, "unittest": Suite}


def limited(job, folder):
    os.setsid()
    control(PR_SET_PDEATHSIG, signal.SIGKILL)
    for what, most in ((resource.RLIMIT_AS, job["memory"]), (resource.RLIMIT_CORE, 0), (resource.RLIMIT_FSIZE, job["bytes"])):
        resource.setrlimit(what, (most, most))
    os.chdir(folder)
    signal.signal(signal.SIGPIPE, signal.SIG_DFL)


def attempt(work, *arguments):
    try:
        return work(*arguments)
    except TimeoutException as e:
        return {"ended": "slow", "error": repr(e)}
    except BaseException as e:  # noqa: BLE001  whatever the program raises is its result
        return {"ended": "error", "error": repr(e)[-2000:], "text": str(e)[-2000:]}


def stepped(job, given, answer):
    """Prepare the program, then a reply for each step until the server closes the pipe."""
    signal.signal(signal.SIGALRM, alarm)
    made = []

    def prepare():
        with timer(job["seconds"]):
            made.append(KINDS[job["kind"]](job))
        return {"ended": "ok"}

    write_all(answer, frame(attempt(prepare)))
    while made and (head := read_exact(given, 4)):
        step = json.loads(read_exact(given, struct.unpack(">I", head)[0]))
        write_all(answer, frame(attempt(made[0].step, step)))


def script(job, given, out, error):
    """The program as a script of its own; the code with which it ends."""
    streams(given, out)
    os.dup2(error, 2)
    sys.stderr = io.TextIOWrapper(io.FileIO(2, "w", closefd=False), "utf-8", errors="replace", write_through=True)
    module = types.ModuleType("__main__")
    sys.modules["__main__"] = module
    code = 0
    try:
        exec(compile(job["code"], "<script>", "exec"), module.__dict__)
        sys.stdout.flush()
    except SystemExit as e:
        code = e.code if isinstance(e.code, int) else 0 if e.code is None else 1
    except BaseException:  # noqa: BLE001  as the interpreter does
        import traceback

        code = 1
        with contextlib.suppress(BaseException):
            traceback.print_exc()
    flush()
    return code & 255


# the server


class Session:
    def __init__(self, job, streams_of=()):
        self.folder = tempfile.mkdtemp(prefix="run-")
        self.bytes = job["bytes"]
        given, self.ask_fd = os.pipe()
        self.answer_fd, answer = os.pipe()
        self.pid = os.fork()
        if not self.pid:
            try:
                for fd in (self.ask_fd, self.answer_fd, *SERVER_FDS):
                    os.close(fd)
                limited(job, self.folder)
                code = script(job, *streams_of) if streams_of else stepped(job, given, answer)
                os._exit(code or 0)
            except BaseException:  # noqa: BLE001
                os._exit(1)
        os.close(given)
        os.close(answer)
        os.set_blocking(self.ask_fd, False)
        self.child = os.pidfd_open(self.pid)
        self.exit = None

    def reply(self, until):
        """The child's next frame; {"ended": "over"} past the time, "gone" where it has died, "flood" where it is too long."""
        head = read_exact(self.answer_fd, 4, until, self.child)
        if head:
            size = struct.unpack(">I", head)[0]
            if size > 2 * self.bytes + (1 << 16):
                return {"ended": "flood"}
            body = read_exact(self.answer_fd, size, until, self.child)
            if body:
                try:
                    return json.loads(body)
                except ValueError:
                    return {"ended": "gone"}
            head = body
        return {"ended": "over" if head is False else "gone"}

    def step(self, message, until):
        return self.reply(until) if write_all(self.ask_fd, frame(message), until) else {"ended": "over" if time.monotonic() >= until else "gone"}

    def wait(self, until):
        """Whether the child ended by itself before the time; its code is in ``exit``."""
        if not select.select([self.child], [], [], max(0.0, until - time.monotonic()))[0]:
            return False
        self.exit = os.waitstatus_to_exitcode(os.waitpid(self.pid, 0)[1])
        return True

    def close(self):
        with contextlib.suppress(OSError):
            os.killpg(self.pid, signal.SIGKILL)
        with contextlib.suppress(OSError):
            os.kill(self.pid, signal.SIGKILL)
        if self.exit is None:
            with contextlib.suppress(OSError):
                os.waitpid(self.pid, 0)
        for fd in (self.ask_fd, self.answer_fd, self.child):
            os.close(fd)
        clear_strays()
        shutil.rmtree(self.folder, ignore_errors=True)


def clear_strays(passes=200):
    """Kill and reap what programs left behind: it has become the server's child."""
    for _ in range(passes):
        try:
            with open(f"/proc/self/task/{os.getpid()}/children") as f:
                pids = [int(p) for p in f.read().split()]
        except OSError:
            return
        if not pids:
            return
        for pid in pids:
            with contextlib.suppress(OSError):
                os.kill(pid, signal.SIGKILL)
        for pid in pids:
            with contextlib.suppress(OSError):
                os.waitpid(pid, 0)


def whole(job):
    """A script from its start to its end."""
    fds = [memory_file(job["input"].encode("utf-8", "replace")), memory_file(), memory_file()]
    session = Session(job, fds)
    try:
        ended = session.wait(time.monotonic() + job["seconds"])
        return {"ended": "ok" if ended else "over", "exit": session.exit, "output": content(fds[1], job["bytes"]), "error": content(fds[2], 1 << 20)[-4000:]}
    finally:
        session.close()
        for fd in fds:
            os.close(fd)


def serve():
    session = None
    try:
        while head := read_exact(SERVER_FDS[0], 4):
            job = json.loads(read_exact(SERVER_FDS[0], struct.unpack(">I", head)[0]))
            if job["op"] == "script":
                answer = whole(job)
            elif job["op"] == "open":
                session = Session(job)
                answer = session.reply(time.monotonic() + job["until"])
            elif job["op"] == "step":
                answer = session.step(job, time.monotonic() + job["until"])
            else:
                session.close()
                session, answer = None, {}
            write_all(SERVER_FDS[1], frame(answer))
    finally:
        if session:
            session.close()


if __name__ == "__main__":
    control(PR_SET_PDEATHSIG, signal.SIGKILL)
    control(PR_SET_CHILD_SUBREAPER, 1)
    SERVER_FDS = (os.dup(0), os.dup(1))
    nothing = os.open(os.devnull, os.O_RDWR)
    for standard in (0, 1, 2):
        os.dup2(nothing, standard)
    with contextlib.suppress(ImportError):
        import numpy  # noqa: F401  programs find it loaded
    serve()
