"""Names of a dictionary in texts, found by an Aho-Corasick automaton in Arrow batches (inventory C16).

Names are tried in one order, longest first, then by code point. Each name found is taken out of the text everywhere, and
leaves a space; so a name is looked for in what its predecessors left. The automaton reads the text once and gives the
names that are in it; the first of them in the order is taken out, and only the places where it was are read again, as far
as a name can reach across them. That is linear in the text and in what is taken out of it.

A worker holds the automaton of one shard of the dictionary. Shards are cut in the order of the names, so a text that has
gone through all shards in turn has met all names in their order. Between shards it is written to the shared folder.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folkmoot._store import kept
from folkmoot.operators.scans import row_number

SHARD_NAMES = 100_000


@lru_cache(maxsize=1)
def automaton(names: tuple[str, ...]):
    """Of names in the order in which they are tried; a hit gives the place of its name. A worker's tasks share it."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, n in enumerate(names):
        out.add_word(n, k)
    out.make_automaton()
    return out


def taken_out(text: str, names: tuple[str, ...], machine) -> tuple[list[str], str]:
    """(names found, text left) by the automaton of the names."""
    if not names or not text:
        return [], text
    longest = len(names[0])
    waiting = list({k for _, k in machine.iter(text)})
    heapq.heapify(waiting)
    known, found = set(waiting), []
    while waiting:
        k = heapq.heappop(waiting)
        parts = text.split(names[k])
        if len(parts) == 1:
            continue  # an earlier name took all of its places
        found.append(names[k])
        text = " ".join(parts)
        at = 0
        for part in parts[:-1]:  # names across the space that was left; those before k have had their turn
            at += len(part)
            for _, new in machine.iter(text, max(0, at - longest + 1), min(len(text), at + longest)):
                if new > k and new not in known:
                    known.add(new)
                    heapq.heappush(waiting, new)
            at += 1
    return found, text


def _tagged(names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(names)
        for b in batches:
            done = [taken_out(t, names, machine) for t in b.column("text").to_pylist()]
            found = [[*old, *new] for old, (new, _) in zip(b.column("found").to_pylist(), done)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([t for _, t in done], pa.string()), pa.array(found, pa.list_(pa.string()))], names=["id", "text", "found"])

    return run


def tagged_by_shards(texts: DataFrame, names: DataFrame, names_in_shard: int = SHARD_NAMES) -> DataFrame:
    """(id, name) of texts (id, text) and names (name)."""
    tried = names.filter("name <> ''").distinct().withColumns({"fewer": -F.length("name"), "whole": F.lit(0)})
    total = tried.count()
    if total > names_in_shard:
        tried = kept(row_number(tried, ["whole"], ["fewer", "name"], "place"), "dictionary")
    rows = texts.withColumn("found", F.array().cast("array<string>"))
    schema = f"id {dict(texts.dtypes)['id']}, text string, found array<string>"
    for first in range(0, total, names_in_shard):
        shard = tried.filter(F.col("place").between(first + 1, first + names_in_shard)) if total > names_in_shard else tried
        own = tuple(r["name"] for r in shard.orderBy("fewer", "name").select("name").collect())  # names_in_shard at most
        rows = rows.mapInArrow(_tagged(own), schema)
        if first + names_in_shard < total:
            rows = kept(rows, "texts-left")
    return rows.select("id", F.explode("found").alias("name"))
