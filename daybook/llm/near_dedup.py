"""Near-duplicate groups from bottom-k sketches.

One hash function over word shingles; a text keeps its ``k`` least values. Texts with the
same words in the same order are one class, and one node stands for it.

Candidates come from inverted lists of retained values. Two texts whose Jaccard similarity
is at least 0.8 share all but a known few of their values, so each text is listed only under
its rarest ones, as many as must include a shared one (a prefix filter, by document
frequency). A passage that many documents share is thus listed only where it makes up most
of a text. The filter demands half of the values in common; that a pair of similarity 0.8
has fewer has a probability of 2e-8 at k = 64, and none where sets have at most k members.

Groups are joined without all pairs of a list: first texts meet the head of the list of
their least value (a star), then, where a list still holds several groups, the head of the
list meets the others, and at last what is still apart in a list is compared in blocks, only
between groups. The head is the text whose values are found in most others: the original of
many copies. The overlap of the k least values of the union estimates each
pair, and full sets verify it. Skipped pairs lie within one group already, so the groups are
those of all links.

No join puts a head, a list, a class or a component into one task: keys with many rows are
counted and dealt over salts (``common.spread_join``).

Defined cases. Null or empty text, or one without words: an empty set, linked with nothing,
its own component. Fewer words than a shingle has: the whole sequence is the one shingle.
Repeated rows and ties: equal texts are one class whose least id stands for it. Null ids are
passed over when the least id is sought; a component of null ids alone has a null id.
Ids may repeat or be null: ``stands`` is true for the row that stands for its component,
its first by id (null last) and text hash, and for rows equal to it in both.
Empty table: empty result. Very long texts are read whole. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import HOT_ROWS, hot_keys, hot_limit, spread_join, written
from daybook.llm.language_model import _LOWER, _mixed, word_keys

BATCH_WORDS = 400_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def shingle_sets(texts: list[bytes | None], size: int) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """(class, sorted distinct 64-bit shingle hashes) of each text; the class is null and the
    set empty where there are no words."""
    words = [t.translate(_LOWER).split() if t else [] for t in texts]
    numbers = _Words()
    ids = [np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)) for w in words]
    keys = word_keys(iter(numbers), len(numbers))
    odd = np.arange(1, 2 * size, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for w, i in zip(words, ids, strict=True):
        if not w:
            yield None, np.zeros(0, np.int64)
            continue
        own, n = keys[i], min(size, len(w))
        with np.errstate(over="ignore"):
            total = np.full(len(w) - n + 1, n, np.uint64)
            for j in range(n):
                total = _mixed(total + own[j : len(w) - n + 1 + j] * odd[j])
        yield hashlib.md5(b" ".join(w)).digest(), np.unique(total.view(np.int64))


def _lots(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low, size = 0, 0
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(lengths):
            size += (n or 0) // 6 + 1
            if size >= BATCH_WORDS or i == len(lengths) - 1:
                yield batch.slice(low, i + 1 - low)
                low, size = i + 1, 0


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """(doc_id, text_hash, cls, n, sketch) of each row of (doc_id, text, text_hash)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.binary()), ("cls", pa.binary()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _lots(batches, 1):
            rows = [(c, len(s), s[:k]) for c, s in shingle_sets(part.column(1).to_pylist(), size)]
            columns = [part.column(0), part.column(2), *(pa.array(x, f.type) for x, f in zip(zip(*rows), list(schema)[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, text_hash binary, cls binary, n bigint, sketch array<bigint>")


def full_sets(nodes: DataFrame, size: int) -> DataFrame:
    """(node, members) of each row of (node, text, cls) whose text is of the class."""
    schema = pa.schema([("node", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _lots(batches, 1):
            found = shingle_sets(part.column(1).to_pylist(), size)
            rows = [(n, s) for n, want, (c, s) in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), found) if c == want]
            columns = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return nodes.mapInArrow(run, "node bigint, members array<bigint>")


def least_common(k: int, percent: int) -> int:
    """How many of k retained values a pair at the threshold must share (see above)."""
    p, n = percent / 100, k
    tail, t = 0.0, 0
    while t < n:
        tail += math.comb(n, t) * p**t * (1 - p) ** (n - t)
        if tail > 2e-8:
            break
        t += 1
    return t


def needed(m: Column, k: int, percent: int) -> Column:
    """Values that a text with m retained values must share with a partner."""
    return F.least(F.lit(least_common(k, percent)), F.ceil(m * percent / 100)).cast("int")


def components(edges: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """(node, label): the least node reachable over ``edges`` (a, b), by alternating stars.
    The driver sees two numbers per round; a star of more than ``limit`` edges is spread."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    last = None
    while True:
        # Every neighbour above a node goes to the least node around it.
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("c")), "least")
        large = spread_join(both.filter("b > a"), least.drop("c"), ["a"], hot_keys(least, ["a"], limit), F.xxhash64("b"))
        large = written(large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # Then every neighbour below it, and it itself.
        below = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c")), "below")
        small = (
            spread_join(large, below.drop("c"), ["a"], hot_keys(below, ["a"], limit), F.xxhash64("b"))
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .filter("a > b")
            .distinct()
        )
        edges = written(small, "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


class _Graph:
    fine = 256

    def __init__(self, k: int, percent: int, nodes: DataFrame, sets: DataFrame) -> None:
        self.k, self.percent, self.nodes, self.sets = k, percent, nodes, sets

    def _alike(self, a: Column, b: Column) -> Column:
        """The estimate by the union's sketch lets the pair pass."""
        common = F.array_intersect(a, b)
        union = F.slice(F.sort_array(F.array_union(a, b)), 1, self.k)
        least = needed(F.least(F.size(a), F.size(b)), self.k, self.percent)
        floor = least_common(self.k, self.percent) / self.k
        return (F.size(common) >= least) & (F.size(F.array_intersect(union, common)) >= F.floor(floor * F.size(union)))

    def _joined(self, pairs: DataFrame, table: DataFrame, hot: dict[str, DataFrame]) -> DataFrame:
        """``pairs`` with the columns of ``table`` (node, ...) for both ends, named by the end.
        ``hot`` has, for each end, the nodes that very many pairs share."""
        for side, other in (("a", "b"), ("b", "a")):
            own = table.select(*(F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in table.columns))
            pairs = spread_join(pairs, own, [side], hot[side], F.xxhash64(other)) if side in hot else pairs.join(own, side)
        return pairs

    def estimated(self, pairs: DataFrame, hot: dict[str, DataFrame]) -> DataFrame:
        """Of pairs (a, b) of nodes, those whose sketches let them pass."""
        pairs = self._joined(pairs, self.nodes.select("node", "n", "sketch"), hot)
        sizes = 100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")
        return pairs.filter(sizes & self._alike(F.col("sketch_a"), F.col("sketch_b"))).select("a", "b")

    def verified(self, pairs: DataFrame, hot: dict[str, DataFrame]) -> DataFrame:
        """Of pairs (a, b) of nodes, those whose full sets are similar."""
        pairs = self._joined(pairs, self.sets.select("node", "members"), hot)
        inside = F.size(F.array_intersect("members_a", "members_b"))
        both = F.size("members_a") + F.size("members_b") - inside
        return pairs.filter(100 * inside >= self.percent * both).select("a", "b")

    def links(self, pairs: DataFrame, hot: dict[str, DataFrame]) -> DataFrame:
        return self.verified(self.estimated(pairs, hot), hot)


def _labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _meet(postings: DataFrame, labels: DataFrame, hot: DataFrame) -> DataFrame:
    """The head of each list with what is in the list and not yet in the head's group.
    ``hot``: heads (head) of many rows."""
    heads = _labelled(postings.select(F.col("head").alias("node")).distinct(), labels)
    heads = heads.select(F.col("node").alias("head"), F.col("label").alias("of_head"))
    return (
        spread_join(_labelled(postings.select("head", "node"), labels), heads, ["head"], hot, F.xxhash64("node"))
        .filter("label <> of_head")
        .select(F.col("head").alias("a"), F.col("node").alias("b"))
        .distinct()
    )


#: Lists of at most so many texts are compared pair by pair, larger ones in blocks.
SMALL_LIST = 24


def _apart(postings: DataFrame, labels: DataFrame, graph: _Graph, width: int, limit: int) -> DataFrame:
    """Pairs (a, b) of different groups in one list that may be similar, a below b."""
    own = _labelled(postings, labels)
    groups = own.groupBy("value", "label").agg(F.count(F.lit(1)).alias("c"))
    lists = groups.groupBy("value").agg(
        F.count(F.lit(1)).alias("labels"), F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("top")
    ).filter("labels > 1")
    lists = written(lists.select("value", F.col("top.label").alias("trunk"), F.col("top.c").alias("c"), "all"), "unsettled")
    hot = hot_keys(lists, ["value"], limit, "all")
    own = written(spread_join(own.select("value", "node", "label"), lists, ["value"], hot, F.xxhash64("node")), "apart")
    few = own.filter(F.col("all") <= SMALL_LIST)
    a, b = (few.select("value", F.col("node").alias(s), F.col("label").alias(f"l{s}")) for s in "ab")
    pairs = a.join(b, "value").filter("a < b AND la <> lb").select("a", "b").distinct()
    return graph.estimated(pairs, {}).unionAll(_blocks(own.filter(F.col("all") > SMALL_LIST), graph, width))


def overlaps(values: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, step: int = 1024) -> np.ndarray:
    """How many values each of the rows ``left`` has in common with each of ``right``; rows
    are ``sizes`` values each. A value that a row has twice counts for both, so that halves
    which two values of a text share never lower an overlap."""
    different, place = np.unique(values, return_inverse=True)
    times = np.bincount(place, minlength=len(different))
    column = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    use, width = times[place] > 1, int((times > 1).sum())
    out = np.zeros((len(left), len(right)), np.float32)
    at = np.full(len(sizes), -1)
    for low in range(0, width, step):
        cols = min(step, width - low)
        inside = use & (column[place] >= low) & (column[place] < low + cols)
        matrices = []
        for side in (left, right):
            at[:] = -1
            at[side] = np.arange(len(side))
            mine = inside & (at[owner] >= 0)
            cells = np.bincount(at[owner[mine]] * cols + column[place[mine]] - low, minlength=len(side) * cols)
            matrices.append(cells.reshape(len(side), cols).astype(np.float32))
        out += matrices[0] @ matrices[1].T
    return out


def _blocks(own: DataFrame, graph: _Graph, width: int) -> DataFrame:
    """Pairs of different groups in one list, compared ``width`` by ``width``.

    In each list the largest group is the trunk; texts outside it meet one another and the
    trunk. Here ``graph.fine`` values of each text are compared, by their upper halves, and
    equal halves, in one text or in two, only add to an overlap (``overlaps``): whole sets up
    to that size, and sketches beyond. Pairs leave the task that may be similar, once for all
    their lists; full sets verify them."""
    slabs = lambda n: F.ceil(n / width).cast("int")
    own = own.withColumns(
        {"outer": F.col("label") != F.col("trunk"), "no": slabs(F.col("all") - F.col("c")), "nt": slabs(F.col("c"))}
    )
    spread = F.xxhash64("node")
    o, t = F.pmod(spread, "no").cast("int"), F.pmod(spread, "nt").cast("int")
    # Cells (i, j): outer slab i against outer slab j >= i, or (i, -1 - j) against trunk slab j.
    cell = lambda i, j, r: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), r.alias("row"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    of_outer = F.concat(
        F.transform(F.sequence(o, F.col("no") - 1), lambda j: cell(o, j, F.lit(True))),
        F.transform(F.sequence(F.lit(0), o), lambda i: cell(i, o, F.lit(False))),
        F.transform(upto(F.col("nt")), lambda j: cell(o, -1 - j, F.lit(True))),
    )
    of_trunk = F.transform(upto(F.col("no")), lambda i: cell(i, -1 - t, F.lit(False)))
    cells = own.select("value", "node", "label", F.explode(F.when(F.col("outer"), of_outer).otherwise(of_trunk)).alias("x"))
    marks = F.transform(F.slice("members", 1, graph.fine), lambda x: F.shiftright(x, 32).cast("int"))
    fine = graph.sets.select("node", F.size("members").alias("n"), marks.alias("sketch"))
    # At most as many lists as a node has retained values.
    where = own.groupBy("node").agg(F.collect_set("value").alias("listed"))
    # A node's values and lists meet once, and only then its cells.
    cells = cells.join(fine.join(where, "node"), "node").select("value", "x.*", "node", "label", "n", "sketch", "listed")
    most, percent, common = graph.fine, graph.percent, least_common(graph.fine, graph.percent)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        rows = table["row"].to_numpy(zero_copy_only=False).astype(bool)
        node, label, n = (table[c].to_numpy() for c in ("node", "label", "n"))
        kept = table["sketch"].combine_chunks()
        found_a, found_b = [], []
        left, right = np.flatnonzero(rows), np.flatnonzero(~rows)
        if len(left) and len(right):
            overlap = overlaps(np.asarray(kept.flatten()), np.asarray(kept.value_lengths()), left, right)
            ni, nj = n[left][:, None], n[right][None, :]
            small, large = np.minimum(ni, nj), np.maximum(ni, nj)
            alike = np.where(
                large <= most,
                100 * overlap >= percent * (ni + nj - overlap),
                overlap >= np.minimum(common, np.ceil(np.minimum(small, most) * percent / 100)),
            )
            alike &= (100 * small >= percent * large) & (label[left][:, None] != label[right][None, :])
            i, j = np.nonzero(alike)
            # A pair that meets in several lists is reported in the first of them.
            sets = [frozenset(x) for x in table["listed"].to_pylist()]
            here = table["value"][0].as_py()
            first = np.array([min(sets[a] & sets[b]) == here for a, b in zip(left[i].tolist(), right[j].tolist())], bool)
            i, j = i[first], j[first]
            found_a, found_b = node[left[i]], node[right[j]]
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())}, schema=schema)

    pairs = cells.groupBy("value", "i", "j").applyInArrow(compare, "a bigint, b bigint")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, k: int = 64, width: int = 1024, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, cls, n_shingles, component_id, kept,
    stands`` (``text_hash``: md5 of the text as it is; ``cls``: of its words)."""
    own = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    own = own.withColumn("text_hash", F.unhex(F.md5(F.coalesce("text", F.lit(b"").cast("binary")))))
    rows = written(sketches(own, size, k).withColumn("row", F.monotonically_increasing_id()), "sketches")
    limit = hot_limit(rows.count())
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = written(
        rows.filter("cls IS NOT NULL")
        .groupBy("cls")
        .agg(
            F.min("doc_id").alias("id"), F.min(place).alias("first_row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"),
            F.count(F.lit(1)).alias("times"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    values = nodes.select("node", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    often = written(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "often")
    shared = spread_join(values, often, ["value"], hot_keys(often, ["value"], limit, "df"), F.xxhash64("node"))
    per_node = Window.partitionBy("node")
    shared = shared.withColumns(
        {
            "place": F.row_number().over(per_node.orderBy("df", "value")),
            "here": F.count(F.lit(1)).over(per_node),
            # An original has no values of its own: most of its values are in its copies too.
            "middle": F.struct(F.sum(F.log("df")).over(per_node).alias("s"), F.col("node").alias("n")),
        }
    )
    # Values found in one text alone come first in the order and fill the prefix unlisted.
    prefix = F.col("m") - needed(F.col("m"), k, percent) + 1
    postings = written(shared.filter(F.col("m") - F.col("here") + F.col("place") <= prefix).select("value", "node", "middle"), "postings")
    lists = postings.groupBy("value").agg(F.count(F.lit(1)).alias("c"), F.max("middle").alias("head")).filter("c > 1")
    lists = written(lists.select("value", "c", F.col("head.n").alias("head")), "heads")
    hot_lists = hot_keys(lists, ["value"], limit)
    postings = written(spread_join(postings, lists.drop("c"), ["value"], hot_lists, F.xxhash64("node")), "lists")
    hot_heads = written(hot_keys(lists.groupBy("head").agg(F.sum("c").alias("c")), ["head"], limit), "hot_heads")
    listed = nodes.join(postings.select("node").distinct(), "node", "left_semi")
    sets = written(full_sets(_one_text(own, listed, rows, limit), size), "sets")
    if sets.count() > listed.count():  # rows repeated whole
        sets = written(sets.dropDuplicates(["node"]), "sets")
    graph = _Graph(k, percent, nodes, sets)
    middle = postings.groupBy("node").agg(F.first("middle").alias("middle"))
    first = written(nodes.select("node", F.get("sketch", F.lit(0)).alias("value")).join(middle, "node"), "first")
    heads = first.groupBy("value").agg(F.max("middle").alias("m"), F.count(F.lit(1)).alias("c"))
    heads = written(heads.select("value", F.col("m.n").alias("a"), "c"), "stars")
    hot = {"a": hot_keys(heads, ["a"], limit)}
    star = spread_join(first, heads.drop("c"), ["value"], hot_keys(heads, ["value"], limit), F.xxhash64("node"))
    star = star.filter("node <> a").select("a", F.col("node").alias("b"))
    edges = written(graph.links(star, hot), "links")
    labels = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    meet = graph.links(_meet(postings, labels, hot_heads), {"a": hot_heads.withColumnRenamed("head", "a")})
    edges = written(edges.unionAll(meet), "links")
    labels = components(edges, limit)
    rest = written(_apart(postings, labels, graph, width, limit).distinct(), "pairs")
    if not rest.isEmpty():
        hot = {s: written(hot_keys(rest.groupBy(s).agg(F.count(F.lit(1)).alias("c")), [s], limit), "hot") for s in "ab"}
        edges = edges.unionAll(graph.verified(rest, hot))
        labels = components(edges, limit)
    named = written(_labelled(nodes.select("node", "cls", "id", "first_row", "times"), labels), "labelled")
    least = named.groupBy("label").agg(F.min("id").alias("component_id"), F.min("first_row").alias("of_all"), F.count(F.lit(1)).alias("c"))
    least = written(least, "components")
    named = spread_join(named, least.drop("c"), ["label"], hot_keys(least, ["label"], limit), F.xxhash64("node"))
    named = written(named.select("cls", "times", "component_id", "of_all"), "named")
    out = spread_join(rows.drop("sketch"), named.drop("times"), ["cls"], hot_keys(named, ["cls"], limit, "times"), F.xxhash64("row"), "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id",
        "text_hash",
        "cls",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        (F.col("cls").isNull() | place.eqNullSafe(F.col("of_all"))).alias("stands"),
    )


def _one_text(own: DataFrame, listed: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """(node, text, cls) of the first row of each class in ``listed``; once for each time that
    the row is repeated whole."""

    def key(doc_id: Column, text_hash: Column) -> Column:
        return F.unhex(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("~")), F.hex(text_hash)))).alias("key")

    wanted = listed.select(key(F.col("first_row.doc_id"), F.col("first_row.text_hash")), "node", "cls")
    texts = own.select(key(F.col("doc_id"), F.col("text_hash")), "text", F.monotonically_increasing_id().alias("at"))
    repeated = rows.groupBy(key(F.col("doc_id"), F.col("text_hash"))).agg(F.count(F.lit(1)).alias("c"))
    hot = written(hot_keys(repeated, ["key"], limit), "hot_rows")
    return spread_join(texts, wanted, ["key"], hot, F.xxhash64("at")).select("node", "text", "cls")
