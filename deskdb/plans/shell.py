"""A batch shell: statements and ``set`` commands, results as text."""

from __future__ import annotations

import re
from collections.abc import Iterator

from deskdb.engine import Engine
from deskdb.errors import DeskError
from deskdb.render.boxes import boxes, plain
from deskdb.sql.tokens import statements


class Shell:
    """``pretty``: boxes; else values with ``delimiter`` between them. ``set showplan on`` prints plans first, ``set noexec on`` only analyses."""

    def __init__(self, engine: Engine, pretty: bool = True, delimiter: str = "\t", header: bool = True, footer: bool = True) -> None:
        self.engine, self.pretty, self.delimiter, self.header, self.footer = engine, pretty, delimiter, header, footer
        self.settings = {"stats": False, "showplan": False, "noexec": False}
        self.over = False

    def run(self, script: str) -> Iterator[str]:
        """A script's output, line by line; an error is a line, and the next statement goes on. Commands stand on lines of their own:
        exit, quit, bye; reset (forgets what stands before it); ``:r file``; set."""
        held: list[str] = []
        for line in [*script.split("\n"), "go"]:
            word = line.strip().lower()
            if word in ("exit", "quit", "bye"):
                yield from self._statements(held)
                self.over = True
                return
            if word == "reset":
                held = []
            elif word.startswith(":r "):
                held += "".join(r["value"] for r in self.engine.spark.read.text(line.strip()[3:].strip(), wholetext=True).collect()).split("\n")
            elif m := re.fullmatch(r"set\s+(\w+)\s+(on|off);?", word):
                if m[1] in self.settings:
                    self.settings[m[1]] = m[2] == "on"
                else:
                    yield f"Unknown setting {m[1]}"
            elif word == "go":
                yield from self._statements(held)
                held = []
            else:
                held.append(line)

    def _statements(self, lines: list[str]) -> Iterator[str]:
        for sql in statements("\n".join(lines)):
            yield from self.one(sql)

    def one(self, sql: str) -> Iterator[str]:
        try:
            df = self.engine.execute(sql)
            if self.settings["showplan"]:
                yield self.engine.explain(sql)
            if self.settings["noexec"] or df.columns == ["result"]:
                return
            yield from boxes(df, self.header, self.footer) if self.pretty else plain(df, self.delimiter, self.header, self.footer)
            if self.settings["stats"]:
                yield f"{df.rdd.getNumPartitions()} partitions"
        except DeskError as e:
            yield f"Error: {e}"
