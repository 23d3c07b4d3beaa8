"""Plug-in readers in a process of their own, so that none can take a task down or hold it up."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable
from typing import Any


class Unreadable(ValueError):
    """A reader failed, died or did not answer in time; the message says which."""


def _serve(make: Callable[[], Callable], calls: Any, ours: Any) -> None:
    ours.close()  # so that the end of the parent ends this process too
    read = None
    while True:
        try:
            args = calls.recv()
        except EOFError:
            return
        try:
            read = read or make()
            calls.send((True, read(*args)))
        except Exception as e:
            calls.send((False, str(e) if isinstance(e, ValueError) else f"{type(e).__name__}: {e}"))


class Guarded:
    """Calls the function that ``make`` returns in a child process, which is started when it is first needed.

    Whatever the function raises becomes Unreadable. After ``seconds`` without an answer the child is killed, and so is
    one that died; the next call starts another. ``make`` runs once in each child, so an engine is made once.
    """

    def __init__(self, make: Callable[[], Callable], seconds: float = 60):
        self.make, self.seconds = make, seconds
        self.child = self.calls = None

    def __call__(self, *args: Any) -> Any:
        if self.child is None:
            context = multiprocessing.get_context("fork")
            self.calls, theirs = context.Pipe()
            self.child = context.Process(target=_serve, args=(self.make, theirs, self.calls), daemon=True)
            self.child.start()
            theirs.close()
        try:
            self.calls.send(args)
            if not self.calls.poll(self.seconds):
                self.close()
                raise Unreadable(f"no answer within {self.seconds:g} s")
            good, value = self.calls.recv()
        except (EOFError, BrokenPipeError, ConnectionResetError):
            self.close()
            raise Unreadable("the reader's process died") from None
        if not good:
            raise Unreadable(value)
        return value

    def close(self) -> None:
        """Kill the child, if there is one."""
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.calls.close()
            self.child = self.calls = None
