"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Steps:

1. Rows of equal sets become one class, as copies have the same links; a class is told by two 64-bit sums over its set.
2. A class stays if other classes share at least 0.8 of its shingles. That follows from the bound on one link, and drops most text.
3. Shingles of those that stay are ordered from rare to common. Of two linked sets, the smaller shares a shingle of its
   first ninth with the first fifth of the larger. Classes that share so, in size classes that the bound allows, form candidate blocks.
   A block is kept as links to one head for each shingle, never as pairs.
4. In each block, the product is made: overlap counts are accumulated through the columns (common columns as a dense product, others through
   their postings) for some rows at a time, and entries below 4/9 of the sum of sizes are dropped. Blocks too large for
   a task are dealt into row groups, and each pair of row groups is a task. Each pair of candidates is decided in exactly one task.

The result has a row for each row of docs: doc_id, n_shingles, component_id, n_links (rows that link to this one). Null and empty texts have no
shingles and link with nothing. A null doc_id takes part and is never a component's id unless all are null. Rows that
repeat a doc_id are rows of their own.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.components import components
from corvane.llm.session import cut, documents, scaled
from corvane.llm.textops import U, shingle_sets, signature

FLUSH_TOKENS = 2_000_000
PART_TOKENS = 2_000_000
BROADCAST_ROWS = 500_000
GROUP_DOCS = 4096
GROUP_TOKENS = 4_000_000
CELLS = 4_000_000


def _table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in schema], schema=schema)


def shingle_signatures(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, n_shingles, s1, s2 for each row."""
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(x), *signature(x)) for _, x in shingle_sets(batch.column("text"))]
            n, s1, s2 = zip(*found, strict=True) if found else ((), (), ())
            ids = {k: batch.column(k).to_pylist() for k in ("row_id", "doc_id")}
            yield _table({**ids, "n_shingles": n, "s1": s1, "s2": s2}, schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row_id long, doc_id long, n_shingles long, s1 long, s2 long")


def _parts_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    return (((tokens >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


PAIRS = pa.schema([("part", pa.int32()), ("instance", pa.int64()), ("classes", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("many", pa.binary())])
PAIRS_SQL = "part int, instance long, classes binary, counts binary, tokens binary, many binary"


def _dealt(classes: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, parts: int, instance: int) -> pa.RecordBatch:
    """Rows that carry shingles to their part; a shingle of several of these classes goes as one entry without class."""
    owner = np.repeat(np.arange(len(classes)), sizes)
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    several = np.zeros(len(tokens), bool)
    several[order] = (np.bincount(run) > 1)[run] if len(run) else several
    rows = {k: [] for k in PAIRS.names}

    def add(part, classes_, counts, low, many):
        for k, v in zip(PAIRS.names, (part, instance, classes_.tobytes(), counts.astype("<u4").tobytes(), low.astype("<u4").tobytes(), many.astype("<u4").tobytes()), strict=True):
            rows[k].append(v)

    none = np.zeros(0, U)
    here = np.bincount(owner[several], minlength=len(classes))
    add(-1, classes[here > 0], here[here > 0], none, none)
    part = _parts_of(tokens, parts)
    shared = np.unique(tokens[several])
    shared_part = _parts_of(shared, parts)
    alone = np.flatnonzero(~several)
    alone = alone[np.argsort(part[alone], kind="stable")]
    edges = np.searchsorted(part[alone], np.arange(parts + 1))
    shared_edges = np.searchsorted(shared_part, np.arange(parts + 1))
    for p in range(parts):
        mine = alone[edges[p] : edges[p + 1]]
        many = shared[shared_edges[p] : shared_edges[p + 1]]
        if len(mine) or len(many):
            own, counts = np.unique(owner[mine], return_counts=True)
            add(p, classes[own], counts, tokens[mine] & U(0xFFFFFFFF), many & U(0xFFFFFFFF))
    return _table(rows, PAIRS)


def dealt_shingles(docs: DataFrame, parts: int) -> DataFrame:
    """Shingles by part, with the classes that have them. An instance is a share of a task's rows; its number does not change when it runs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        instance = TaskContext.get().partitionId() << 24
        seen: set[int] = set()
        classes, sets, total = [], [], 0
        for batch in batches:
            for _, x in shingle_sets(batch.column("text")):
                if not len(x) or (name := signature(x)[0]) in seen:
                    continue
                seen.add(name)
                classes.append(name)
                sets.append(x)
                total += len(x)
                if total >= FLUSH_TOKENS:
                    yield _dealt(np.array(classes, "<i8"), np.array(list(map(len, sets))), np.concatenate(sets), parts, instance)
                    instance, classes, sets, total, seen = instance + 1, [], [], 0, set()
        if sets:
            yield _dealt(np.array(classes, "<i8"), np.array(list(map(len, sets))), np.concatenate(sets), parts, instance)

    return docs.select("text").mapInArrow(run, PAIRS_SQL)


def _binary(column, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


COUNTS_SQL = "part int, classes binary, instances binary, shared binary"


def _grouped(names: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by group, and the edges of groups in it."""
    group = (names.view(U) % U(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    return order, np.searchsorted(group[order], np.arange(groups + 1))


def _shared_counts(groups: int):
    """For each class of an instance, how many of its shingles in this part another class has too; dealt by class, a row a group."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        classes, counts = _binary(table.column("classes"), "<i8"), _binary(table.column("counts"), "<u4")
        name = np.concatenate(classes)
        instance = np.repeat(table.column("instance").to_numpy(), list(map(len, classes)))
        n = np.concatenate(counts).astype(np.int64)
        if part >= 0:
            tokens = np.concatenate(_binary(table.column("tokens"), "<u4"))
            many = np.unique(np.concatenate(_binary(table.column("many"), "<u4")))
            entry = np.repeat(np.arange(len(name)), n)
            order = np.lexsort((name[entry], tokens))
            ordered, owners = tokens[order], name[entry[order]]
            n = np.zeros(len(name), np.int64)
            if len(ordered):
                first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                last = np.r_[first[1:], len(ordered)] - 1
                shared = (owners[first] != owners[last]) | np.isin(ordered[first], many, assume_unique=True)
                n = np.bincount(entry[order][np.repeat(shared, last - first + 1)], minlength=len(name))
        keep = n > 0
        name, instance, n = name[keep], instance[keep], n[keep]
        order, edges = _grouped(name, groups)
        rows = [(g, name[x].tobytes(), instance[x].tobytes(), n[x].astype("<u4").tobytes()) for g in range(groups) if len(x := order[edges[g] : edges[g + 1]])]
        kinds = [pa.int32()] + [pa.binary()] * 3
        return pa.table([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["part", "classes", "instances", "shared"])

    return run


def _sum_shared(table: pa.Table) -> pa.Table:
    """Sums over parts for each class and instance; every instance of a class comes to the same, so that any will do."""
    name, instance = (np.concatenate(_binary(table.column(k), "<i8")) for k in ("classes", "instances"))
    n = np.concatenate(_binary(table.column("shared"), "<u4")).astype(np.int64)
    order = np.lexsort((instance, name))
    name, instance, n = name[order], instance[order], n[order]
    first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (instance[1:] != instance[:-1])])
    total, name = np.add.reduceat(n, first), name[first]
    start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    return pa.table({"s1": name[start], "shared": np.maximum.reduceat(total, start)})


def survivors(docs: DataFrame, classes: DataFrame, parts: int) -> DataFrame:
    """The classes of which others share at least 0.8 of the shingles."""
    counts = dealt_shingles(docs, parts).groupBy("part").applyInArrow(_shared_counts(parts), COUNTS_SQL)
    each = counts.groupBy("part").applyInArrow(_sum_shared, "s1 long, shared long")
    return classes.join(each, "s1").filter("5 * shared >= 4 * n_shingles").drop("shared")


SETS = "s1 long, n int, size long, tokens binary"


def class_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row or more (where a doc_id is repeated) for each chosen class, with its sorted shingles.

    A class's text is that of its smallest doc_id. Classes that have only null ids are found by their signature among the rows without id.
    """
    schema = pa.schema([("s1", pa.int64()), ("n", pa.int32()), ("size", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want, size = batch.column("s1").to_pylist(), batch.column("size").to_pylist()
            found = [(want[i], len(x), size[i], x.tobytes()) for i, x in shingle_sets(batch.column("text")) if signature(x)[0] == want[i]]
            if found:
                yield _table(dict(zip(schema.names, zip(*found, strict=True), strict=True)), schema)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(signature(x)[0], len(x), 0, x.tobytes()) for _, x in shingle_sets(batch.column("text")) if len(x)]
            if found:
                yield _table(dict(zip(schema.names, zip(*found, strict=True), strict=True)), schema)

    picked = chosen.filter("least_id is not null").select(F.col("least_id").alias("doc_id"), "s1", "size")
    unnamed = chosen.filter("least_id is null").select("s1", "size")
    if chosen.count() <= BROADCAST_ROWS:  # three numbers a row; beyond that, texts and picks shuffle by doc_id
        picked, unnamed = F.broadcast(picked), F.broadcast(unnamed)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id").select("text", "s1", "size").mapInArrow(run, SETS)
    others = docs.filter("doc_id is null").select("text").mapInArrow(run_all, SETS).drop("size").join(unnamed, "s1")
    return named.union(others.select(named.columns))


RARITY_SQL = "part int, classes binary, counts binary, tokens binary, ranks binary"


def _deal_sets(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("classes", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("ranks", pa.binary())])
        for batch in batches:
            names, sets = batch.column("s1").to_numpy(), _binary(batch.column("tokens"), U)
            owner, tokens = np.repeat(np.arange(len(names)), list(map(len, sets))), np.concatenate(sets)
            part = _parts_of(tokens, parts)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            rows = {k: [] for k in schema.names}
            for p in range(parts):
                mine = order[edges[p] : edges[p + 1]]
                if len(mine):
                    own, counts = np.unique(owner[mine], return_counts=True)
                    for k, v in zip(schema.names, (p, names[own].tobytes(), counts.astype("<u4").tobytes(), tokens[mine].tobytes(), b""), strict=True):
                        rows[k].append(v)
            yield _table(rows, schema)

    return run


def _count_rarity(groups: int):
    """In a part: how many classes have each shingle; those with two or more go on, dealt by class."""

    def run(table: pa.Table) -> pa.Table:
        name = np.concatenate(_binary(table.column("classes"), "<i8"))
        owner = np.repeat(name, np.concatenate(_binary(table.column("counts"), "<u4")))
        tokens = np.concatenate(_binary(table.column("tokens"), U))
        order = np.lexsort((owner, tokens))
        tokens, owner = tokens[order], owner[order]
        once = np.r_[True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])]
        tokens, owner = tokens[once], owner[once]
        run_of = np.cumsum(np.r_[True, tokens[1:] != tokens[:-1]]) - 1
        rank = np.bincount(run_of)[run_of]
        keep = rank > 1
        tokens, owner, rank = tokens[keep], owner[keep], rank[keep]
        order, edges = _grouped(owner, groups)
        rows = [(g, owner[x].tobytes(), b"", tokens[x].tobytes(), rank[x].astype("<u4").tobytes()) for g in range(groups) if len(x := order[edges[g] : edges[g + 1]])]
        names = ["part", "classes", "counts", "tokens", "ranks"]
        kinds = [pa.int32()] + [pa.binary()] * 4
        return pa.table([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def _prefixes(left: pa.Table, sizes: pa.Table) -> pa.Table:
    """The prefix of each class in the order from rare to common; shingles of one class only come first and are not listed."""
    out = {k: np.zeros(0, np.int64) for k in ("token", "s1", "size_class")} | {"indexed": np.zeros(0, bool)}
    if left.num_rows:
        owner = np.concatenate(_binary(left.column("classes"), "<i8"))
        tokens = np.concatenate(_binary(left.column("tokens"), U))
        rank = np.concatenate(_binary(left.column("ranks"), "<u4"))
        names, index = np.unique(sizes.column("s1").to_numpy(), return_index=True)
        n_of = sizes.column("n").to_numpy()[index].astype(np.int64)
        who = np.searchsorted(names, owner)
        order = np.lexsort((tokens, rank, who))
        who, tokens = who[order], tokens[order]
        have = np.bincount(who, minlength=len(names))
        first = np.cumsum(have) - have
        n = n_of[who]
        place = n - have[who] + np.arange(len(who)) - first[who]
        keep = place <= n - (4 * n + 4) // 5
        who, n, place = who[keep], n[keep], place[keep]
        out = {"token": tokens[keep].view(np.int64), "s1": names[who], "size_class": np.floor(np.log(n) / np.log(1.3)).astype(np.int64), "indexed": place <= n - (8 * n + 8) // 9}
    return pa.table(out)


def candidate_links(sets: DataFrame, n_tokens: int) -> DataFrame:
    """Links a, b from classes to the heads of blocks; each truly linked pair is connected through them."""
    parts = scaled(n_tokens, PART_TOKENS)
    dealt = sets.select("s1", "tokens").mapInArrow(_deal_sets(parts), RARITY_SQL)
    rarity = dealt.groupBy("part").applyInArrow(_count_rarity(parts), RARITY_SQL)
    # the group of a class is its unsigned value modulo parts, as in _count_rarity
    unsigned = F.expr(f"cast(case when s1 >= 0 then s1 % {parts} else pmod(s1 % {parts} + {2**64 % parts}, {parts}) end as int)")
    sizes = sets.select(unsigned.alias("part"), "s1", "n")
    prefixes = rarity.groupBy("part").cogroup(sizes.groupBy("part")).applyInArrow(_prefixes, "token long, s1 long, size_class long, indexed boolean")
    prefixes = cut(prefixes, "prefixes")
    heads = prefixes.filter("indexed").groupBy("token", "size_class").agg(F.min("s1").alias("head"))
    reach = prefixes.select("token", "s1", F.explode(F.array("size_class", F.col("size_class") - 1)).alias("size_class"))
    return reach.join(heads, ["token", "size_class"]).filter("s1 <> head").select(F.col("s1").alias("a"), F.col("head").alias("b")).distinct()


class Product:
    """Rows of a block's product of the incidence matrix with its transpose."""

    def __init__(self, sets: list[np.ndarray]):
        self.m = len(sets)
        self.n = np.array(list(map(len, sets)), np.int64)
        tokens = np.concatenate(sets)
        row = np.repeat(np.arange(self.m), self.n)
        _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
        common = (count >= max(16, self.m // 16)) if self.m > 64 else np.zeros(len(count), bool)
        self.dense = np.zeros((self.m, int(common.sum())), np.float32)
        place = np.cumsum(common) - 1
        is_common = common[column]
        self.dense[row[is_common], place[column[is_common]]] = 1
        light = ~is_common & (count > 1)[column]
        self.row, self.column = row[light], column[light]
        order = np.argsort(self.column, kind="stable")
        self.posting = self.row[order]
        self.count = np.where(common, 0, count)
        self.count[count == 1] = 0
        self.first = np.cumsum(self.count) - self.count
        self.row_edge = np.searchsorted(self.row, np.arange(self.m + 1))

    def rows(self, a: int, b: int) -> np.ndarray:
        """Overlap of rows a to b with all rows."""
        out = np.zeros((b - a, self.m), np.int64)
        if self.dense.shape[1]:
            out += np.rint(self.dense[a:b] @ self.dense.T).astype(np.int64)
        at = slice(self.row_edge[a], self.row_edge[b])
        row, column = self.row[at] - a, self.column[at]
        repeat = self.count[column]
        for i, j in _limited(repeat, CELLS):
            r = repeat[i:j]
            within = np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r)
            other = self.posting[np.repeat(self.first[column[i:j]], r) + within]
            out += np.bincount(np.repeat(row[i:j], r) * self.m + other, minlength=out.size).reshape(out.shape)
        return out

    def links(self) -> Iterator[tuple[int, np.ndarray]]:
        """Yields the first row and the link matrix (without the diagonal) of some rows at a time."""
        step = max(1, CELLS // max(self.m, 1))
        for a in range(0, self.m, step):
            b = min(self.m, a + step)
            linked = 9 * self.rows(a, b) >= 4 * (self.n[a:b, None] + self.n[None, :])
            linked[np.arange(b - a), np.arange(a, b)] = False
            yield a, linked


def _limited(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    total, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


LINKED = pa.schema([("s1", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def link_block(names: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The smallest name that each row is connected with in the block, and how many rows of docs link to it. side: only pairs of different sides count."""
    label, links = np.arange(len(names)), np.zeros(len(names), np.int64)
    for a, linked in Product(sets).links():
        if side is not None:
            linked &= side[a : a + len(linked), None] != side[None, :]
        links[a : a + len(linked)] = linked @ sizes
        for i in np.flatnonzero(linked.any(axis=1)):
            own = np.unique(label[np.r_[a + i, np.flatnonzero(linked[i])]])
            if len(own) > 1:
                label[np.isin(label, own)] = own[0]
    order = np.lexsort((names, label))
    head = names[order[np.searchsorted(label[order], label)]]
    return head, links


def _link_task(table: pa.Table) -> pa.Table:
    """All blocks of one task; several small blocks or one pair of row groups."""
    block, side = table.column("label").to_numpy(), table.column("side").to_numpy()
    names, sizes = table.column("s1").to_numpy(), table.column("size").to_numpy()
    tokens = table.column("tokens").to_pylist()
    order = np.lexsort((names, block))
    edges = np.r_[np.flatnonzero(np.r_[True, np.diff(block[order]) != 0]), len(order)]
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows = order[a:b]
        rows = rows[np.r_[True, np.diff(names[rows]) != 0]]
        if len(rows) > 1:
            across = side[rows] if side[rows[0]] >= 0 else None
            root, links = link_block(names[rows], [np.frombuffer(tokens[i], U) for i in rows], sizes[rows], across)
            hit = links > 0
            out.append((names[rows][hit], root[hit], links[hit]))
    columns = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3)]
    return pa.table(columns, schema=LINKED)


def block_links(sets: DataFrame, blocks: DataFrame, group_docs: int = GROUP_DOCS) -> DataFrame:
    """s1, root, links from the product of every block; blocks: node, label."""
    rows = sets.join(blocks.withColumnRenamed("node", "s1"), "s1")
    weight = F.greatest(F.count(F.lit(1)) / group_docs, F.sum("n") / GROUP_TOKENS)
    sizes = rows.groupBy("label").agg(F.ceil(weight).cast("int").alias("groups"))
    rows = cut(rows.join(sizes, "label"), "blocks")
    total = rows.filter("groups = 1").agg(F.sum("n")).first()[0] or 0
    small = rows.filter("groups = 1").withColumn("side", F.lit(-1)).withColumn("lo", F.expr(f"pmod(xxhash64(label), {scaled(total, PART_TOKENS)})")).withColumn("hi", F.lit(-1))
    mine = F.expr("cast(pmod(xxhash64(s1), groups) as int)")
    large = rows.filter("groups > 1").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    large = large.withColumn("side", F.expr("if(mine = other, -1, mine)")).withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    columns = ["label", "s1", "size", "tokens", "side"]
    schema = "s1 long, root long, links long"
    from_small = small.groupBy("lo").applyInArrow(lambda t: _link_task(t.select(columns)), schema)
    from_large = large.groupBy("label", "lo", "hi").applyInArrow(lambda t: _link_task(t.select(columns)), schema)
    return from_small.union(from_large)


def row_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, row_id (of monotonically_increasing_id) and keep_row (of the row that has the component's id) for each row."""
    rows = cut(shingle_signatures(docs), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_id"))
    classes = rows.filter("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(least.alias("least"), F.count(F.lit(1)).alias("size"))
    classes = cut(classes.withColumn("least_id", F.col("least.doc_id")), "classes")
    n_tokens = classes.agg(F.sum("n_shingles")).first()[0] or 0
    chosen = cut(survivors(docs, classes, scaled(n_tokens, PART_TOKENS)), "survivors")
    sets = cut(class_sets(docs, chosen), "sets")
    blocks = cut(components(candidate_links(sets, sets.agg(F.sum("n")).first()[0] or 0)), "candidates")
    links = cut(block_links(sets, blocks), "found")
    roots = components(links.select(F.col("s1").alias("a"), F.col("root").alias("b")))
    degree = links.groupBy("s1").agg(F.sum("links").alias("links"))
    joined = classes.select("s1", "s2", "least").join(roots.withColumnRenamed("node", "s1"), "s1").join(degree, "s1", "left")
    heads = joined.groupBy("label").agg(F.min("least").alias("head"))
    joined = joined.join(heads, "label").select("s1", "s2", "head", "links")
    final = classes.join(joined, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("head", "least").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = rows.join(final.filter("n_links > 0"), ["s1", "s2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("n_links").isNotNull()
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(linked, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        "row_id",
        F.when(linked, F.col("head.row_id")).otherwise(F.col("row_id")).alias("keep_row"),
    )


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row."""
    return row_groups(docs).drop("row_id", "keep_row")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir, "doc_id", "text"))
