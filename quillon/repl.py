"""An interactive shell: python -m quillon.repl [folder of Parquet tables]

    exit            leaves
    \\x              switches between aligned and expanded output
    debug           switches plans before results on or off
                    (of queries, and of the rows that a change would work on)
    load FOLDER     takes tables from a folder of Parquet tables
    load FILE.sql   runs a script
    load sample [schema|data]   makes the sample tables, from the folder's rows
"""

from __future__ import annotations

import sys
import time

from quillon import render
from quillon.dialect.lexer import statements
from quillon.session import Engine
from quillon.sources import sample


class Shell:
    def __init__(self, engine: Engine, out=sys.stdout):
        self.engine, self.out = engine, out
        self.pending, self.expanded, self.debug = "", False, False

    def say(self, text: str):
        print(text, end="" if text.endswith("\n") else "\n", file=self.out)

    def feed(self, line: str) -> bool:
        """Takes a line; False when the shell should end."""
        word = line.strip().rstrip(";").strip()
        if not self.pending.strip():
            if word == "exit":
                return False
            if word == "\\x":
                self.expanded = not self.expanded
                self.say(f"Expanded display is {'on' if self.expanded else 'off'}.")
                return True
            if word == "debug":
                self.debug = not self.debug
                self.say(f"Debug is {'on' if self.debug else 'off'}.")
                return True
            if word.startswith("load "):
                self.guarded(lambda: self.load(word[5:].strip()))
                return True
        found, self.pending = statements(self.pending + line + "\n")
        for one in found:
            self.guarded(lambda one=one: self.show(one))
        return True

    def guarded(self, action):
        """Whatever goes wrong is said, and the shell goes on."""
        try:
            action()
        except Exception as problem:
            self.say(f"error: {str(problem).strip().splitlines()[0]}")

    def load(self, path: str):
        if path.split()[0] == "sample":
            sample.load(self.engine, *path.split()[1:2])
        elif path.endswith(".sql"):
            with open(path) as script:
                self.engine.script(script.read())
        else:
            self.engine.catalog.folder = path
        self.say(f"loaded {path}")

    def show(self, text: str):
        began = time.time()
        if self.debug and text.split(None, 1)[0].lower() in ("select", "with", "insert", "update", "delete"):
            self.say(self.engine.explained(text))
        df = self.engine.sql(text)
        self.say((render.expanded if self.expanded else render.table)(df))
        self.say(f"\nTime: {(time.time() - began) * 1000:.3f} ms")


def main(args: list[str]):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quillon").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    shell = Shell(Engine(spark, args[0] if args else None))
    while True:
        try:
            line = input("... " if shell.pending.strip() else "quillon> ")
        except EOFError:
            break
        except KeyboardInterrupt:
            shell.pending = ""
            continue
        if not shell.feed(line):
            break


if __name__ == "__main__":
    main(sys.argv[1:])
