"""Work on untrusted bytes in a child process with a time and a memory limit.

A task keeps one child and hands it one item after another; a child that hangs, dies or is out of memory is killed and the next item gets a
new one. So an item that loops costs its own row and the limit's seconds, and nothing else. The child gets the function itself, so the
machines of a cluster need no copy of the package.
"""

from __future__ import annotations

import os
import pickle
import selectors
import subprocess
import sys
import time

#: Seconds for one item, and bytes of memory of a child.
SECONDS, MEMORY = 10.0, 1 << 30
#: Bytes of a length before what is passed.
HEAD = 8

#: What the child runs: a function first, then items; for each, whether it went well, and the result or the error's kind and text.
CHILD = f"""
import os, pickle, resource, sys
items, results = sys.stdin.buffer, os.fdopen(os.dup(1), "wb")
os.dup2(2, 1)  # what the work prints is no result
read = lambda: items.read(int.from_bytes(head)) if (head := items.read({HEAD})) else None
work = pickle.loads(read())
resource.setrlimit(resource.RLIMIT_AS, (int(sys.argv[1]),) * 2)
while (item := read()) is not None:
    try:
        said = pickle.dumps((True, work(item)))
    except Exception as e:
        said = pickle.dumps((False, (type(e).__name__, str(e))))
    results.write(len(said).to_bytes({HEAD}) + said)
    results.flush()
"""


class ItemError(RuntimeError):
    """The work failed with an error of its own: kind and text."""

    def __init__(self, kind: str, text: str):
        super().__init__(text)
        self.kind = kind


class ChildError(RuntimeError):
    """The child gave no result: why."""


class Child:
    """A function of bytes, given as its pickle (by cloudpickle), in another process."""

    def __init__(self, function: bytes, seconds: float = SECONDS, memory: int = MEMORY):
        self.function, self.seconds, self.memory = function, seconds, memory
        self._process: subprocess.Popen | None = None

    def _started(self) -> subprocess.Popen:
        if self._process is None or self._process.poll() is not None:
            paths = os.pathsep.join(p for p in sys.path if p)
            self._process = subprocess.Popen([sys.executable, "-c", CHILD, str(self.memory)], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=os.environ | {"PYTHONPATH": paths})
            self._send(self.function)
        return self._process

    def _send(self, item: bytes) -> None:
        self._process.stdin.write(len(item).to_bytes(HEAD) + item)
        self._process.stdin.flush()

    def close(self) -> None:
        if self._process is not None:
            self._process.kill()
            self._process.wait()
            self._process.stdout.close()
            self._process = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def _read(self, n: int, until: float) -> bytes:
        out, pipe = b"", self._process.stdout
        with selectors.DefaultSelector() as ready:
            ready.register(pipe, selectors.EVENT_READ)
            while len(out) < n:
                if not ready.select(max(0.0, until - time.monotonic())):
                    raise TimeoutError
                part = os.read(pipe.fileno(), min(n - len(out), 1 << 20))
                if not part:
                    raise EOFError
                out += part
        return out

    def __call__(self, item: bytes):
        """The function's result. ItemError where it raised, ChildError where there is none."""
        until = time.monotonic() + self.seconds
        try:
            self._started()
            self._send(item)  # the child reads all of an item before it works
            good, said = pickle.loads(self._read(int.from_bytes(self._read(HEAD, until)), until))
        except TimeoutError:
            self.close()
            raise ChildError(f"the reader took more than {self.seconds:g} s") from None
        except (EOFError, OSError):
            self.close()
            raise ChildError("the reader died") from None
        if good:
            return said
        raise ItemError(*said)
