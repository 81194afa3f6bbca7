"""Approximate nearest neighbours by inner product: NN-descent builds a graph, greedy search asks it.

Equal vectors are one node.  A node starts with the best of the vectors that share one of its cells:
the centres of the cells are fitted on a sample of bounded size, every node falls in several, and a
cell of too many nodes is cut along a random projection.  In each round it learns from its neighbours: every node receives the
vectors it lists and a sample of those that list it, compares them with each other, and tells them
about those that are better than what they have; only pairs with a new member are compared.  Joins
carry the vectors to the nodes, and what comes back is merged by node.

A query starts from its own node's list and, round by round, looks at the neighbours of its best
unvisited candidates, until a round changes the best ones of hardly any query.  Vectors stay in blocks
of bounded size, to which queries travel.

Vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part.  Rows of one id count once, with the least vector; rows without an id are left out.
Equal scores go to the smaller id.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.llm.common import parts_of, written

#: Neighbours a node keeps, nodes that list it and that it hears of, and what it tells each about.
DEGREE, REVERSE, TOLD = 48, 32, 6
#: Cells a node falls in, nodes of a cell, about, centres at most, and nodes of the sample for each centre.
CELLS, LEAF, CENTRES, SAMPLED = 6, 2_000, 4_096, 8
ROUNDS, SETTLED = 12, 0.02
#: Search: candidates looked at in a round, kept, rounds at most, and best ones that must stay the same for a query to be settled.
EXPANDED, BEAM, STEPS, TOP = 64, 256, 8, 24
#: Nodes of a partition, nodes of a block of the search, and queries settled together, about.
PART_NODES, BLOCK_NODES, ASKED = 2_000, 16_000, 400
#: A query's vector goes to all blocks that it asks, so blocks are large; so many may be smaller, to keep all cores busy.
BLOCKS = 12

#: Scores in the lists are relative to the largest vector, so that single precision holds them.
LISTS = "id bigint, ids array<bigint>, scores array<float>, fresh array<boolean>"
#: Neighbours found for the nodes of a part, in one row.
FOUND = "part int, node array<bigint>, other array<bigint>, score array<float>, fresh array<boolean>"


def valid_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, vec`` (doubles) of the rows that take part, one per id."""
    found = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
        & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0))
    found = written(found.groupBy("vec_id").agg(F.min("vec").alias("vec")))
    usual = found.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found.where(F.size("vec") == (usual["n"] if usual else 0))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(flat), -1)


def _packed(vectors: np.ndarray, top: float) -> pa.Array:
    """Each vector as the largest of its components, by the largest of all, and its components by its own largest.

    Directions are halves then, whatever the numbers' magnitude, and no vector is lost beside larger ones.
    """
    own = np.abs(vectors).max(axis=1, keepdims=True)
    return pa.array([s.tobytes() + d.tobytes() for s, d in zip(own / top, (vectors / own).astype(np.float16), strict=True)], pa.binary())


def _halves(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and scales of packed vectors.

    Whom a node lists depends on the others' scales and not on its own, so that its scores leave its own out.
    """
    rows = np.frombuffer(b"".join(column.to_pylist()), np.dtype([("scale", "<f8"), ("half", "<f2", (width,))]))
    return rows["half"].astype(np.float32), rows["scale"]


def _flat(*lists: pa.ChunkedArray) -> list[np.ndarray]:
    """The elements of list columns."""
    return [c.combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in lists]


def _block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    mixed = ids.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(blocks)).astype(np.int32)


def _best(node: np.ndarray, other: np.ndarray, score: np.ndarray, fresh: np.ndarray, degree: int) -> tuple[np.ndarray, ...]:
    """The ``degree`` best others per node, each once, by node and best first; what is known already is not fresh."""
    keep = node != other
    node, other, score, fresh = node[keep], other[keep], score[keep], fresh[keep]
    order = np.lexsort((fresh, other, node))
    node, other, score, fresh = node[order], other[order], score[order], fresh[order]
    first = np.ones(len(node), bool)
    first[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
    node, other, score, fresh = node[first], other[first], score[first], fresh[first]
    order = np.lexsort((other, -score, node))
    node, other, score, fresh = node[order], other[order], score[order], fresh[order]
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
    rank = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
    keep = rank < degree
    return node[keep], other[keep], score[keep].astype(np.float32), fresh[keep].astype(bool)


def _lists(node: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """One row per node of what is sorted by node."""
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(starts, len(node)).astype(np.int32))
    return pa.table([pa.array(node[starts]), *[pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]], ["id", "ids", "scores", "fresh"])


def _by_part(parts: int, node: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """What was found for nodes, one row per part."""
    part = _block_of(node, 4 * parts)
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0])) if len(node) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(starts, len(node)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[order][starts], pa.int32()), *[pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in (node, *columns)]],
        ["part", "node", "other", "score", "fresh"])


def _whole_partition(work):
    """A function of batches that gathers its partition, whose size ``PART_NODES`` bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return run


def _merge(found: DataFrame, parts: int, degree: int) -> DataFrame:
    def work(table: pa.Table) -> pa.Table:
        return _lists(*_best(*_flat(table["node"], table["other"], table["score"], table["fresh"]), degree))

    return found.repartition(parts, "part").mapInArrow(_whole_partition(work), LISTS)


def _known(lists: DataFrame, parts: int) -> DataFrame:
    """Lists as what was found, nothing of it new."""
    return lists.mapInArrow(lambda batches: (_by_part(
        parts, np.repeat(b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy()), *_flat(*(pa.chunked_array([b.column(i)]) for i in (1, 2))),
        np.zeros(len(b.column(1).flatten()), bool)) for b in batches), FOUND)


def _directions(vectors: np.ndarray) -> np.ndarray:
    found = (vectors / np.abs(vectors).max(axis=1, keepdims=True)).astype(np.float32)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def centres_of(nodes: DataFrame, count: int) -> np.ndarray:
    """Directions about which the nodes' directions lie, fitted on ``SAMPLED`` nodes for each of them."""
    rows = nodes.select("vec").orderBy(F.xxhash64("id", F.lit(5)), "id").limit(SAMPLED * count).toArrow()
    sample = _directions(_matrix(rows["vec"], np.float64))
    centres = sample[:count]
    for _ in range(5):
        near = np.concatenate([(sample[i : i + 1024] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-30), centres)
    return centres


def first_lists(nodes: DataFrame, count: int, width: int, parts: int, top: float, degree: int = DEGREE) -> DataFrame:
    """The best neighbours of ``count`` nodes among those of the ``CELLS`` cells each falls in, ``LEAF`` of a cell at a time."""
    centres = centres_of(nodes, min(CENTRES, parts_of(count * CELLS, LEAF)))
    cells = min(CELLS, len(centres))
    planes = np.random.default_rng(11).normal(size=(64, width)).astype(np.float32)  # cells of the same nodes are cut along different ones

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _matrix(batch.column(1), np.float64)
            packed, directions = _packed(whole, top), _directions(whole)
            near = np.concatenate([np.argpartition(-(directions[i : i + 1024] @ centres.T), cells - 1, axis=1)[:, :cells] for i in range(0, len(whole), 1024)])
            seen = (directions @ planes.T).astype(np.float64)
            for cell in near.T:
                at = seen[np.arange(len(seen)), cell % len(planes)]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(at), batch.column(0), packed], ["cell", "at", "id", "vec"])

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table["id"].to_numpy()
        vectors, scales = _halves(table["vec"], width)
        listed, found = min(degree, len(ids) - 1), []
        for begin in range(0, len(ids) if listed else 0, 500):
            scores = (vectors[begin : begin + 500] @ vectors.T) * scales
            own = np.arange(len(scores))
            scores[own, begin + own] = -np.inf
            best = np.argpartition(-scores, listed - 1, axis=1)[:, :listed]
            found.append((np.repeat(ids[begin : begin + 500], listed), ids[best].ravel(), np.take_along_axis(scores, best, 1).ravel().astype(np.float32)))
        if found:
            node, other, score = (np.concatenate(x) for x in zip(*found, strict=True))
            yield _by_part(parts, node, other, score, np.ones(len(node), bool))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            cell = held["cell"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist()]
            while held.num_rows - edges[-1] >= 2 * LEAF:
                edges.append(edges[-1] + LEAF)
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                for start, stop in _even(begin, end):
                    yield from compared(held.slice(start, stop - start))
            held = held.slice(edges[-1])
        if held is not None:
            for start, stop in _even(0, held.num_rows):
                yield from compared(held.slice(start, stop - start))

    placed = nodes.select("id", "vec").mapInArrow(place, "cell int, at double, id bigint, vec binary")
    dealt = placed.repartitionByRange(parts_of(count * cells, 8 * LEAF), "cell", "at", "id").sortWithinPartitions("cell", "at", "id")
    return _merge(dealt.mapInArrow(leaves, FOUND), parts, degree)


def _even(begin: int, end: int) -> list[tuple[int, int]]:
    """The range in even parts of less than twice ``LEAF``."""
    edges = np.linspace(begin, end, max(1, (end - begin) // LEAF) + 1).astype(int).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def _round(halves: DataFrame, lists: DataFrame, width: int, parts: int, degree: int, number: int) -> DataFrame:
    """Candidates that the nodes' neighbours tell each other about.

    Who meets whom is settled by ids alone, so that a vector goes to each meeting once.
    """
    least = F.when(F.size("ids") >= degree, F.element_at("scores", -1)).otherwise(F.lit(float("-inf"))).cast("float")
    own = halves.join(lists.select("id", least.alias("least")), "id")
    edges = lists.select("id", F.explode(F.arrays_zip("ids", "fresh")).alias("link")).select(F.col("link.ids").alias("to"), "id", F.col("link.fresh").alias("fresh"))
    among = Window.partitionBy("to").orderBy(F.xxhash64(F.lit(number), "to", "id"))
    heard = edges.withColumn("_rank", F.row_number().over(among)).where(F.col("_rank") <= REVERSE).drop("_rank")
    listed = edges.select(F.col("id").alias("to"), F.col("to").alias("id"), "fresh")
    members = heard.unionByName(listed).join(own, "id").select("to", "id", "half", "least", "fresh")

    def work(table: pa.Table) -> pa.Table:
        to, member, least = (table[c].to_numpy() for c in ("to", "id", "least"))
        fresh = table["fresh"].to_numpy(zero_copy_only=False).astype(bool)
        vectors, scales = _halves(table["half"], width)
        order = np.lexsort((~fresh, member, to))
        edge = np.concatenate([[0], np.flatnonzero(np.diff(to[order])) + 1, [len(to)]])
        found = []
        for begin, end in zip(edge[:-1], edge[1:], strict=True):
            at = order[begin:end]
            at = at[np.concatenate([[True], member[at][1:] != member[at][:-1]])]
            scores = (vectors[at] @ vectors[at].T) * scales[at]
            scores[~(fresh[at][:, None] | fresh[at][None, :])] = -np.inf
            np.fill_diagonal(scores, -np.inf)
            told = min(TOLD, len(at) - 1)
            if told < 1:
                continue
            best = np.argpartition(-scores, told - 1, axis=1)[:, :told]
            value = np.take_along_axis(scores, best, 1)
            row, column = np.nonzero(value > least[at][:, None])
            found.append((member[at[row]], member[at[best[row, column]]], value[row, column]))
        node, other, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pa.Table.from_batches([_by_part(parts, *_best(node, other, score, np.ones(len(node), bool), degree))])

    return members.repartition(parts * 2, "to").mapInArrow(_whole_partition(work), FOUND)


def build_graph(nodes: DataFrame, width: int, degree: int = DEGREE) -> DataFrame:
    """``id, vec, ids``: every node's approximate nearest neighbours, best first.

    Rounds end when fewer than ``SETTLED`` of the listed neighbours are new, or after ``ROUNDS``.
    """
    count = nodes.count()
    parts = parts_of(count, PART_NODES)

    top = nodes.agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x))))).first()[0]

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(_matrix(batch.column(1), np.float64), top)], ["id", "half"])

    halves = written(nodes.select("id", "vec").mapInArrow(halve, "id bigint, half binary").repartition(parts, "id"))
    lists = written(first_lists(nodes, count, width, parts, top, degree))
    for number in range(ROUNDS):
        told = _round(halves, lists, width, parts, degree, number)
        lists = written(_merge(_known(lists, parts).unionByName(told), parts, degree))
        listed, fresh = lists.agg(F.sum(F.size("ids")), F.sum(F.size(F.filter("fresh", lambda x: x)))).first()
        if not listed or fresh < SETTLED * listed:
            break
    return written(nodes.select("id", "vec").join(lists.select("id", "ids"), "id", "left").select(
        "id", "vec", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids")))


def _by_query(found: pd.DataFrame) -> dict[int, list[int]]:
    """The places of the rows of each query."""
    places: dict[int, list[int]] = {}
    for place, query in enumerate(found["query"].tolist()):
        places.setdefault(query, []).append(place)
    return places


def search(graph: DataFrame, starts: DataFrame) -> DataFrame:
    """``query, ids, scores``: the best ``BEAM`` nodes found for each query node, its own left out, best first.

    A round is two visits to the blocks: the first reads the lists of the nodes to be expanded,
    the second scores the vectors named there that are not among the query's best.  One that was
    scored before and is not among them is no better now.
    """
    count = graph.count()
    blocks = max(parts_of(count, BLOCK_NODES), min(BLOCKS, parts_of(count, PART_NODES)))

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(_block_of(ids.to_numpy(), blocks))

    placed = written(graph.withColumn("block", block_of("id")))
    names, vectors = placed.select("block", "id", "ids"), placed.select("block", "id", "vec")

    def rows_of(block: pd.DataFrame):
        """Where the block has given ids."""
        order = np.argsort(block["id"].to_numpy())
        ids = block["id"].to_numpy()[order]
        return lambda sought: order[np.searchsorted(ids, sought)]

    def lists(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        place, ids = rows_of(block), block["ids"].to_numpy()
        at = ids[place(asked["node"].to_numpy())]
        out = [(query, np.unique(np.concatenate(at[rows]))) for query, rows in _by_query(asked).items()]
        return pd.DataFrame(out, columns=["query", "found"])

    def deal(state: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """Nodes that are not among a query's best, by block."""
        places, named, out = _by_query(found), found["found"].to_numpy(), []
        for query, vec, ids, scores in zip(state["query"], state["vec"], state["ids"], state["scores"], strict=True):
            new = np.setdiff1d(np.concatenate([np.zeros(0, np.int64), *named[places.get(query, [])]]), np.append(ids, query))
            least = scores[-1] if len(scores) >= BEAM else -np.inf
            block = _block_of(new, blocks)
            order = np.argsort(block, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(new) else ():
                out.append((block[part[0]], query, vec, least, new[part]))
        return pd.DataFrame(out, columns=["block", "query", "vec", "least", "found"])

    def scored(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        place, matrix = rows_of(block), np.stack(block["vec"].to_list())
        out = []
        for query, vec, least, wanted in zip(asked["query"], asked["vec"], asked["least"], asked["found"], strict=True):
            score = matrix[place(wanted)] @ vec
            best = np.lexsort((wanted, -score))[:BEAM]
            best = best[score[best] >= least]
            out.append((query, wanted[best], score[best]))
        return pd.DataFrame(out, columns=["query", "found", "scores"])

    def settle(state: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """The beam with what was found; what was asked for its list is expanded."""
        places, named, values, out = _by_query(found), found["found"].to_numpy(), found["scores"].to_numpy(), []
        for row in state.itertuples(index=False):
            at = places.get(row.query, [])
            ids = np.concatenate([row.ids, *named[at]]).astype(np.int64)
            scores = np.concatenate([row.scores, *values[at]]).astype(float)
            best = np.lexsort((ids, -scores))[:BEAM]
            done = np.union1d(row.expanded, row.next).astype(np.int64)
            out.append((row.bucket, row.query, row.vec, ids[best], scores[best], done, not np.array_equal(ids[best][:TOP], row.ids[:TOP])))
        return pd.DataFrame(out, columns=["bucket", "query", "vec", "ids", "scores", "expanded", "changed"])

    def together(one: DataFrame, other: DataFrame, key: str, work, schema: str) -> DataFrame:
        """``work`` over the groups of both; where ``one`` has no rows there is nothing to do."""
        names = [field.split()[0] for field in schema.split(", ")]

        def run(first: pd.DataFrame, second: pd.DataFrame) -> pd.DataFrame:
            found = work(first, second) if len(first) else []
            return found if len(found) else pd.DataFrame({name: pd.Series([], dtype=object) for name in names})

        return one.groupBy(key).cogroup(other.groupBy(key)).applyInPandas(run, schema)

    buckets = parts_of(starts.count(), ASKED)
    bucket = F.pmod(F.xxhash64("query"), F.lit(buckets)).cast("int")
    empty = F.array().cast("array<bigint>")
    state = starts.select(
        F.col("id").alias("query"), "vec", F.array("id").alias("ids"), F.array(F.lit(float("-inf"))).alias("scores"), empty.alias("expanded"))
    state = state.withColumn("bucket", bucket)
    for _ in range(STEPS):
        state = state.withColumn("next", F.slice(F.array_except("ids", "expanded"), 1, EXPANDED))
        asked = state.select("query", F.explode("next").alias("node")).withColumn("block", block_of("node"))
        found = together(asked, names, "block", lists, "query bigint, found array<bigint>").withColumn("bucket", bucket)
        wanted = together(state, found, "bucket", deal, "block int, query bigint, vec array<double>, least double, found array<bigint>")
        named = together(wanted, vectors, "block", scored, "query bigint, found array<bigint>, scores array<double>").withColumn("bucket", bucket)
        state = written(together(
            state, named, "bucket", settle,
            "bucket int, query bigint, vec array<double>, ids array<bigint>, scores array<double>, expanded array<bigint>, changed boolean"))
        changed, queries = state.agg(F.count_if("changed"), F.count(F.lit(1))).first()
        if changed <= SETTLED * queries:
            break
    return state.select("query", "ids", "scores")


def nearest(rows: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest other rows found for each row that ``is_query``.

    ``is_query`` is a condition on ``vec_id``.  Of a group of equal vectors the ``k + 1`` smallest ids
    are enough for any answer, so large groups are never gathered.
    """
    valid = written(valid_vectors(rows, vec_id, vector))
    first = valid.first()
    if first is None:
        return valid.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    width = len(first["vec"])
    nodes = written(valid.groupBy("vec").agg(F.min("vec_id").alias("id")).select("id", "vec"))
    named = written(valid.join(nodes, "vec").select("vec_id", "id"))
    graph = build_graph(nodes, width)
    queries = named.where(is_query)
    starts = nodes.join(queries.select("id").distinct(), "id")
    found = search(graph, starts)
    inside = Window.partitionBy("id").orderBy("vec_id")
    members = named.withColumn("_rank", F.row_number().over(inside)).where(F.col("_rank") <= k + 1).select("id", "vec_id")
    itself = F.aggregate(F.zip_with("vec", "vec", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    hits = found.select("query", F.explode(F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda x: x["scores"] > float("-inf")), 1, 2 * k)).alias("hit")).select(
        "query", F.col("hit.ids").alias("id"), F.col("hit.scores").alias("score"))
    hits = hits.unionByName(starts.select(F.col("id").alias("query"), "id", itself.alias("score")))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = hits.join(members, "id").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k + 1)
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("id").alias("query"))
    ranked = asked.join(answers.select("query", "vec_id", "score"), "query").where("query_id <> vec_id").withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
