"""Problem 2: ordered patterns with gaps that many songs support.

Sequence decision diagrams. Every song becomes a node of one shared acyclic graph
whose paths are the patterns the song supports; equal sub-diagrams exist once (unique
table) and unions are memoised. The database is then a weighted set of roots: songs
with the same diagram are one root with a weight. Counting pushes conditional
diagrams per prefix item; roots that fall together below a prefix are merged, and a
conditional database that occurs below several prefixes is counted once. A position's
diagrams follow from its item and the diagrams just behind it, so equal surroundings
are built once too. Classes that too few songs have can be in no frequent pattern and
take a place only.

A song of any size is spread over range-sorted chunks. A chunk counts the songs that
lie wholly inside it. Songs cut by a boundary give their patterns as rows, and the
``reach`` positions on either side of each boundary are mined again together, so no
window is lost and no task needs a whole song.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantus.llm.segments import in_order
from cantus.plans.storage import cut

SCHEMA = "kind string, song string, pattern string, n bigint, chunk bigint, place bigint, item string, chunk_end boolean"
MOST_NODES = 300_000
EMPTY, DONE = 0, 1


class Diagrams:
    """A unique table of nodes; a node is a sorted tuple of (item, child). 0 is the empty set, 1 the empty pattern."""

    def __init__(self, length: int, between: int):
        self.length, self.between = length, between
        self.clear()

    def clear(self) -> None:
        self.nodes: list[tuple] = [(), ()]
        self.ids: dict[tuple, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.begun: dict[tuple, tuple] = {}

    def node(self, edges: tuple) -> int:
        if not edges:
            return EMPTY
        found = self.ids.get(edges)
        if found is None:
            found = self.ids[edges] = len(self.nodes)
            self.nodes.append(edges)
        return found

    def union(self, a: int, b: int) -> int:
        if a == b or not b:
            return a
        if not a:
            return b
        key = (a, b) if a < b else (b, a)
        found = self.joined.get(key)
        if found is None:
            edges = dict(self.nodes[a])
            for item, child in self.nodes[b]:
                edges[item] = self.union(edges[item], child) if item in edges else child
            found = self.joined[key] = self.node(tuple(sorted(edges.items())))
        return found

    def song(self, items: list) -> int:
        """The diagram of all patterns of a sequence (None: a place that is no step)."""
        root, near = EMPTY, ()  # near: by position, nearest first, the diagrams of 1..length-1 steps that start there
        nothing = (EMPTY,) * self.length
        for item in reversed(items):
            starts = nothing
            if item is not None:
                starts = self.begun.get((item, near))
                if starts is None:
                    new = [EMPTY] * self.length
                    new[0] = self.node(((item, DONE),))
                    for k in range(1, self.length):
                        rest = EMPTY
                        for later in near:
                            rest = self.union(rest, later[k - 1])
                        if not rest:
                            break
                        new[k] = self.node(((item, rest),))
                    starts = self.begun[item, near] = tuple(new)
                root = self.union(root, starts[-1])
            near = (starts, *near[: self.between])
        return root

    def supports(self, roots: Counter) -> Iterator[tuple[tuple, int]]:
        """Patterns below a weighted set of diagrams, each with its weight."""
        yield from self._below(frozenset(roots.items()), self.length, {})

    def _below(self, roots: frozenset, left: int, known: dict) -> list[tuple[tuple, int]]:
        """The patterns of ``left`` steps of a conditional database, each database counted once."""
        found = known.get((roots, left))
        if found is None:
            below: dict = {}
            for root, weight in roots:
                for item, child in self.nodes[root]:
                    below.setdefault(item, Counter())[child] += weight
            if left == 1:
                found = [((item,), sum(c.values())) for item, c in below.items()]
            else:
                found = [((item, *rest), n) for item, c in below.items() for rest, n in self._below(frozenset(c.items()), left - 1, known)]
            known[roots, left] = found
        return found


def _mine(length: int, between: int):
    reach = (length - 1) * (between + 1)

    def chunk_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, d, roots = TaskContext.get().partitionId(), Diagrams(length, between), Counter()
        first, name = True, None
        held: list = []  # items of the open song since its last mined block
        head: list = []
        place = root = 0

        def counted() -> pd.DataFrame:
            rows = [("count", None, ">".join(p), n, chunk, None, None, None) for p, n in d.supports(roots)]
            roots.clear()
            d.clear()
            return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

        def paths(node: int, prefix: tuple = ()) -> Iterator[str]:
            for item, child in d.nodes[node]:
                if child == DONE:
                    yield ">".join((*prefix, item))
                else:
                    yield from paths(child, (*prefix, item))

        def edge() -> pd.DataFrame:
            """The open song touches a boundary: its patterns, and the places near both of its ends in this chunk."""
            rows = [("song", name, p, None, chunk, None, None, None) for p in paths(root)]
            n, tail = place, held[-reach:]
            near = dict(enumerate(head)) | {n - len(tail) + i: x for i, x in enumerate(tail)}
            rows += [("edge", name, None, None, chunk, i, x, i == n - 1) for i, x in near.items()]
            return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

        def block() -> None:
            """Mine what is held; keep the last ``reach`` places, for windows into what follows."""
            nonlocal root, held
            root = d.union(root, d.song(held))
            held = held[-reach:]

        for pdf in batches:
            for song, item in zip(pdf["song"], pdf["class_name"]):
                if song != name:
                    if name is not None:
                        block()
                        if first:
                            yield edge()
                            first = False
                        else:
                            roots[root] += 1
                        if len(d.nodes) > MOST_NODES:
                            yield counted()
                    name, held, head, place, root = song, [], [], 0, EMPTY
                held.append(item)
                if place < reach:
                    head.append(item)
                place += 1
                if len(held) >= 4096:
                    block()
                    if len(d.nodes) > MOST_NODES:  # within one very long song: keep only its own diagram
                        kept = list(paths(root))
                        if roots:
                            yield counted()
                        d.clear()
                        root = EMPTY
                        for p in kept:
                            node = DONE
                            for x in reversed(p.split(">")):
                                node = d.node(((x, node),))
                            root = d.union(root, node)
        if name is not None:
            block()
            yield edge()
        if roots:
            yield counted()

    return chunk_rows


def _across(length: int, between: int):
    def song_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        """Windows of one song across chunk boundaries: at most 2 * reach places a chunk."""
        d = Diagrams(length, between)
        root, run, before = EMPTY, [], None
        for chunk, place, item, end in pdf.sort_values(["chunk", "place"])[["chunk", "place", "item", "chunk_end"]].itertuples(index=False):
            joined = before is not None and (place == before[1] + 1 if chunk == before[0] else place == 0 and before[2])
            if not joined:
                root, run = d.union(root, d.song(run)), []
            run.append(item)
            before = (chunk, place, end)
        root = d.union(root, d.song(run))
        rows = [p for p, _ in d.supports(Counter({root: 1}))] if root else []
        return pd.DataFrame({"song": pdf["song"].iloc[0], "pattern": [">".join(p) for p in rows]}, columns=["song", "pattern"])

    return song_rows


def frequent_patterns(segments: DataFrame, length: int = 4, between: int = 2, share: tuple[int, int] = (1, 5)) -> DataFrame:
    """pattern, support, songs: the patterns of ``length`` classes supported by at least ``share`` of all songs.

    At most ``between`` places lie between neighbouring steps. Segments without a
    class take a place but are no step; steps may be equal; each song counts once a
    pattern. Ties in start_sec are ordered by segment_index. Songs without any class
    count as songs. An empty input gives no rows. Item names must not contain ``>``.
    """
    segments = cut(segments.select("song", "start_sec", "segment_index", "class_name"))  # read three times
    songs = segments.agg(F.countDistinct("song").alias("songs"))  # one row
    # no more songs have a class than there are segments of it; at most share[1] / share[0] times the mean length of a song classes stay
    common = segments.where("class_name is not null").groupBy("class_name").agg(F.count("*").alias("n"))
    common = common.crossJoin(F.broadcast(songs)).where(F.col("n") * share[1] >= F.col("songs") * share[0]).select("class_name", F.col("class_name").alias("kept"))
    steps = segments.select("song", "start_sec", "segment_index", "class_name").join(common, "class_name", "left").select("song", "start_sec", "segment_index", F.col("kept").alias("class_name"))
    mined = cut(in_order(steps).mapInPandas(_mine(length, between), SCHEMA))
    edges = mined.where("kind = 'edge'").groupBy("song").applyInPandas(_across(length, between), "song string, pattern string")
    cut_songs = mined.where("kind = 'song'").select("song", "pattern").union(edges).distinct().groupBy("pattern").agg(F.count("*").alias("n"))
    supports = mined.where("kind = 'count'").select("pattern", "n").union(cut_songs).groupBy("pattern").agg(F.sum("n").alias("support"))
    return supports.crossJoin(F.broadcast(songs)).where(F.col("support") * share[1] >= F.col("songs") * share[0]).select("pattern", "support", "songs")
