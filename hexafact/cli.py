"""A shell over a store of facts: python -m hexafact.cli parquet:///path [lens_id]."""

from __future__ import annotations

import cmd
import sys
import time

from pyspark.sql import SparkSession

from hexafact.lang.parser import read
from hexafact.operators import discovery
from hexafact.operators.substrate import DiscoveryError, Substrate, discover, explain, query
from hexafact.plans.ir import Discovery
from hexafact.sources.readers import load_substrate


class Shell(cmd.Cmd):
    r"""Queries, discovery expressions, and \schema [DIM], \explain QUERY, \pivot, \limit N, \history, \clear, \help, \q."""

    prompt = "facts> "

    def __init__(self, substrate: Substrate, out=None) -> None:
        super().__init__(stdout=out)
        self.substrate, self.limit, self.history, self.last = substrate, 20, [], None

    def say(self, text: str) -> None:
        self.stdout.write(f"{text}\n")

    def show(self, df, n: int = 50) -> None:
        rows = df.limit(n).collect()
        self.say("\t".join(df.columns))
        for r in rows:
            self.say("\t".join(str(v)[:40] for v in r))

    def completenames(self, text, *_):
        return [d for d in ("WHO", "WHAT", "WHEN", "WHERE", "WHY", "HOW") if d.startswith(text.upper())]

    def onecmd(self, line: str) -> bool:
        line = line.strip()
        if line in ("\\q", "EOF", "exit", "quit"):
            return True
        if line:
            self.history.append(line)
            try:
                self.run(line)
            except (ValueError, DiscoveryError) as e:
                self.say(f"error: {e}")
        return False

    def run(self, line: str) -> None:
        word, _, rest = line.partition(" ")
        if word == "\\schema":
            self.show(discovery.by_key(self.substrate.facts, rest, values=True) if rest else discovery.schema(self.substrate.facts))
        elif word == "\\explain":
            self.show(explain(self.substrate, rest))
        elif word == "\\pivot":
            self.show(self.last.pivot()) if self.last else self.say("no query yet")
        elif word == "\\limit":
            self.limit = int(rest) or None
        elif word == "\\history":
            self.say("\n".join(self.history))
        elif word == "\\clear":
            self.say("\033[2J\033[H")
        elif word == "\\help":
            self.say(type(self).__doc__)
        elif isinstance(read(line), Discovery):
            self.show(discover(self.substrate, line, 50).rows)
        else:
            start = time.time()
            self.last = query(self.substrate, line, self.limit)
            self.show(self.last.to_dataframe(), 500)
            self.say(f"{self.last.count} entities, {1000 * (time.time() - start):.0f} ms")


def main(args: list[str]) -> None:
    spark = SparkSession.builder.appName("facts").getOrCreate()
    Shell(load_substrate(spark, args[0], args[1] if len(args) > 1 else None)).cmdloop()


if __name__ == "__main__":
    main(sys.argv[1:])
