"""python -m quern.cli COMMAND ...

    sort IN OUT [MB]         sorts a file of unsigned 64-bit numbers (MB is accepted and left to Spark)
    isSorted FILE [MB]       exit 0: sorted, 2: not, 1: error
    generate FILE N          N pseudo-random numbers
    parseSchema FILE         prints the relations of a CREATE TABLE text
    loadSchema FILE CATALOG  stores them in a catalog, in place of what it held
    showSchema CATALOG       prints a catalog
    index                    an index from standard input: i, l, d FIRST [LAST [STEP]], v [FILE], q, # comment
    matches R S THREADS      counts matches of random keys by each strategy and prints rates
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.hashing import STRATEGIES, match_count
from ..operators.index import UniqueIndex
from ..sources import Catalog, parse
from ..sources.u64 import external_sort, generate, is_sorted


def session(threads: str = "*") -> SparkSession:
    builder = SparkSession.builder.appName("quern").config("spark.ui.showConsoleProgress", "false")
    return (builder if SparkSession.getActiveSession() else builder.master(f"local[{threads}]")).getOrCreate()


class Repl:
    """Commands on an index of whole numbers; a key's value is its square."""

    def __init__(self, spark: SparkSession, out=None) -> None:
        self.spark, self.out, self.index, self.drawings = spark, out or sys.stdout, UniqueIndex.empty(spark), 0

    def say(self, text: str) -> None:
        self.out.write(text + "\n")

    def _range(self, words: list[str]) -> range | None:
        try:
            numbers = [int(w) for w in words]
        except ValueError:
            return None
        if not 1 <= len(numbers) <= 3:
            return None
        first, last, step = (*numbers, numbers[0], 1)[:2] + ((numbers[2] if len(numbers) == 3 else 1),) if len(numbers) > 1 else (numbers[0], numbers[0], 1)
        if not step:
            return None
        step = abs(step) if first <= last else -abs(step)
        return range(first, last + (1 if step > 0 else -1), step)

    def run(self, line: str) -> bool:
        """False when the session is over."""
        words = line.split()
        if not words or words[0].startswith("#"):
            return True
        if words[0] == "q":
            return False
        if words[0] == "v":
            name = words[1] if len(words) > 1 else f"{self.drawings}.dot"
            self.drawings += len(words) == 1
            name += "" if name.endswith(".dot") else ".dot"
            Path(name).write_text(self.index.export_dot())
            self.say(f"saved {name}")
            return True
        if words[0] not in ("i", "l", "d"):
            self.say("unknown command")
            return True
        keys = self._range(words[1:])
        if keys is None:
            self.say(f"usage: {words[0]} FIRST [LAST [STEP]]")
            return True
        df = self.spark.createDataFrame([(k, k * k) for k in keys], "key bigint, tid bigint")
        if words[0] == "i":
            new, bad = self.index.insert(df)
            failed = sorted(r.key for r in bad.collect())
            self._settle(new)
            for k in failed:
                self.say(f"not inserted: {k}")
            self.say(f"inserted {len(keys) - len(failed)} entries")
        elif words[0] == "d":
            new, missing = self.index.erase(df.select("key"))
            failed = sorted(r.key for r in missing.collect())
            self._settle(new)
            for k in failed:
                self.say(f"not there: {k}")
            self.say(f"deleted {len(keys) - len(failed)} entries")
        else:
            found = {r.key: r.tid for r in self.index.lookup(df.select("key")).collect()}
            for k in keys:
                self.say(f"{k}: {'not found' if found[k] is None else found[k]}")
        return True

    def _settle(self, index: UniqueIndex) -> None:
        """Cuts the plan's growth between commands; what is typed by hand fits the driver."""
        rows = [tuple(r) for r in index.df.collect()]
        self.index = UniqueIndex(self.spark.createDataFrame(rows, "key bigint, tid bigint"))


def matches(spark: SparkSession, r: int, s: int) -> list[tuple[str, int, float]]:
    keys = lambda n, seed: spark.range(n).select((F.abs(F.xxhash64("id", F.lit(seed))) % max(1, r)).alias("k"))
    out = []
    for strategy in STRATEGIES:
        began = time.time()
        n = match_count(keys(r, 1), keys(s, 2), "k", strategy).head()[0]
        out.append((strategy, n, (r + s) / 1e6 / (time.time() - began)))
    return out


def main(args: list[str]) -> int:
    try:
        match args:
            case ["sort", source, target, *_]:
                external_sort(session(), source, target, single=True)
            case ["isSorted", source, *_]:
                return 0 if is_sorted(session(), source) else 2
            case ["generate", target, n]:
                generate(target, int(n))
            case ["parseSchema", source]:
                print("".join(map(str, parse(Path(source).read_text()))), end="")
            case ["loadSchema", source, catalog]:
                Catalog(catalog).store(session(), parse(Path(source).read_text()))
            case ["showSchema", catalog]:
                print("".join(map(str, Catalog(catalog).read(session()))), end="")
            case ["index"]:
                repl = Repl(session())
                for line in sys.stdin:
                    if not repl.run(line.rstrip("\n")):
                        break
            case ["matches", r, s, threads]:
                for strategy, n, rate in matches(session(threads), int(r), int(s)):
                    print(f"{strategy}: {n} matches, {rate:.2f} million keys a second")
            case _:
                print(__doc__, file=sys.stderr)
                return 1
    except (OSError, ValueError, PySparkException) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
