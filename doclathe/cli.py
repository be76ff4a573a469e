"""A shell over named collections: python -m doclathe.cli --load orders.json:orders --eval 'find orders {"status":"A"}'

Commands, each with JSON arguments:
  find NAME [QUERY [PROJECTION]]     count NAME [QUERY]         distinct NAME FIELD [QUERY]
  aggregate NAME PIPELINE            explain NAME [QUERY]
  insert NAME DOC-OR-LIST            update NAME QUERY UPDATE   delete NAME QUERY    drop NAME
  load FILE [NAME]                   save NAME FILE             show collections     use DB     help   exit"""

from __future__ import annotations

import argparse
import json
import os
import sys

from doclathe.collection import Collection
from doclathe.context import SpecError
from doclathe.sources import catalog, documents


def arguments(text: str) -> list:
    """JSON values and bare words, one after the other."""
    out, decoder, text = [], json.JSONDecoder(), text.strip()
    while text:
        if text[0] in '{["':
            value, end = decoder.raw_decode(text)
        else:
            value = text.split(None, 1)[0]
            end = len(value)
        out.append(value)
        text = text[end:].lstrip()
    return out


class Shell:
    def __init__(self, spark, out=None):
        self.spark, self.out, self.database = spark, out or sys.stdout, "test"

    def load(self, path: str, name: str | None = None) -> int:
        name = name or os.path.splitext(os.path.basename(path))[0]
        c = Collection(documents.read(self.spark, path))
        catalog.put(name, c)
        return c.count()

    def save(self, name: str, path: str) -> int:
        return documents.save_json(self.collection(name).frame, path)

    def collection(self, name: str) -> Collection:
        if not catalog.has(name):
            catalog.put(name, Collection([], self.spark))
        return catalog.get(name)

    def run(self, line: str):
        """The result of one command: documents, a number, a report or text."""
        words = arguments(line)
        if not words:
            return None
        command, *a = words
        if command == "help":
            return __doc__
        if command == "use":
            self.database = a[0]
            return f"switched to {a[0]}"
        if command == "show":
            if a[:1] in (["collections"], ["tables"]):
                return catalog.names()
            if a[:1] in (["dbs"], ["databases"]):
                return [self.database]
            raise SpecError("show collections or show dbs")
        if command == "load":
            return self.load(*a)
        if command == "save":
            return self.save(*a)
        if command in ("find", "count", "distinct", "aggregate", "explain", "insert", "update", "delete", "drop"):
            c, rest = self.collection(a[0]), a[1:]
            if command == "find":
                return c.find(*rest).to_list()
            if command == "aggregate":
                return documents.to_dicts(c.aggregate(*rest))
            if command == "explain":
                return c.find(*rest).explain()
            if command == "drop":
                return catalog.drop(a[0])
            return {"count": c.count, "distinct": c.distinct, "insert": c.insert, "update": c.update_many, "delete": c.delete_many}[command](*rest)
        raise SpecError(f"unknown command {command}; try help")

    def show(self, result) -> None:
        if isinstance(result, str):
            print(result, file=self.out)
        elif isinstance(result, list):
            for r in result:
                print(json.dumps(r, default=str, ensure_ascii=False), file=self.out)
        elif result is not None:
            print(json.dumps(result, default=str, ensure_ascii=False), file=self.out)

    def loop(self, lines) -> None:
        for line in lines:
            if line.strip() in ("exit", "quit", ".exit"):
                return
            try:
                self.show(self.run(line))
            except Exception as e:
                print(f"error: {e}", file=self.out)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="doclathe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--load", action="append", default=[], metavar="FILE[:NAME]")
    p.add_argument("--eval", action="append", default=[], metavar="COMMAND")
    p.add_argument("--file", help="commands, one a line")
    p.add_argument("--json", action="store_true", help="one JSON value for each result")
    p.add_argument("--shell", action="store_true", help="read commands from the terminal afterwards")
    o = p.parse_args(argv)
    from pyspark.sql import SparkSession

    shell = Shell(SparkSession.builder.appName("doclathe").getOrCreate())
    for x in o.load:
        path, _, name = x.partition(":")
        shell.load(path, name or None)
    lines = [*o.eval, *(open(o.file).read().splitlines() if o.file else [])]
    try:
        for line in lines:
            result = shell.run(line)
            print(json.dumps(result, default=str, ensure_ascii=False)) if o.json else shell.show(result)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if o.shell or not (lines or o.load):
        shell.loop(iter(lambda: input("> "), None) if sys.stdin.isatty() else sys.stdin)
    return 0


if __name__ == "__main__":
    sys.exit(main())
