"""N-gram Jaccard join: prefix filters under several global token orders, intersected before verification.

Steps, each written to the shared folder so that none is lost with an executor:

1. Every document becomes a set of hashed word n-grams; documents with equal sets are one from here on.
2. First order (by hash): only a set's prefix is dealt out, by token. A set stays only if as many of its prefix
   tokens are held by other sets' prefixes as any partner would have to share. Most documents end here.
3. Second order (rarest first, counted over all sets left): tokens of one set only come first in it. A set stays
   if its shared tokens suffice; its prefix tokens join it to the smallest set that has them, and these links
   (one for each posting, never all pairs) make clusters: sets of different clusters cannot be similar.
4. Inside clusters, in blocks: a pair is verified only if its prefixes meet under the second order and under two
   more (by other hashes). Clusters too large for a block are first held against a few of their sets; then only
   sets outside the cluster's largest component are compared further. Only forests of links leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactrix.llm import textnp
from redactrix.llm.common import Scratch, bucket_count, components, fresh
from redactrix.llm.embeddings import _forest

U = np.uint64
#: Share of a set (one in so many tokens) by which the first order's prefix is lengthened, to ask for more shared tokens.
LONGER = 20
#: A block of a cluster: tokens and sets at most; first comparands of a cluster larger than that.
BLOCK_TOKENS, BLOCK_SETS, HUBS = 1_000_000, 1000, 32
#: Tokens of a long text handled at once.
CHUNK = 1 << 18
MORE_ORDERS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


def least_overlap(n, percent: int):
    """What a set of n tokens must share with any set similar to it."""
    return (percent * n + 99) // 100


def _sets(column: pa.Array, words: int):
    """For each run of texts: its place, the distinct tokens (by text, then hash) and their text numbers."""
    data, offsets = textnp.text_bytes(column)
    for i, j in textnp.blocks(offsets):
        part, upto = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(part) > 2 * textnp.BLOCK:  # one long text
            h = textnp.long_shingles(part, words)
            yield i, j, h, np.zeros(len(h), np.int8)
            continue
        begin, end, text = textnp.word_table(part, upto)
        h, t = textnp.distinct(*textnp.shingles(textnp.word_hashes(part, begin, end), text, j - i, words))
        yield i, j, h, t


def _signature(h: np.ndarray, t: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit sums of each set: equal for equal sets."""
    if n == 1:
        sums = [sum(int(textnp.mixed(h[s : s + CHUNK] * k).sum(dtype=U)) for s in range(0, len(h), CHUNK)) % (1 << 64) for k in MORE_ORDERS]
        return np.array([len(h)]), np.array(sums[:1], U), np.array(sums[1:], U)
    count = np.bincount(t, minlength=n)
    c1, c2 = (np.concatenate([np.zeros(1, U), np.cumsum(textnp.mixed(h * k), dtype=U)]) for k in MORE_ORDERS)
    upto = np.concatenate([[0], np.cumsum(count)])
    return count, c1[upto[1:]] - c1[upto[:-1]], c2[upto[1:]] - c2[upto[:-1]]


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): rows of one id are told apart by their texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def token_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, s1, s2): the size and signature of each row's set."""

    def work(batches):
        for b in batches:
            for i, j, h, t in _sets(b.column("text"), words):
                n, s1, s2 = _signature(h, t, j - i)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("text_hash").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))], names=["doc_id", "text_hash", "n_shingles", "s1", "s2"])

    return _rows(docs).mapInArrow(work, "doc_id long, text_hash long, n_shingles long, s1 long, s2 long")


def _packed(bucket: np.ndarray, **columns) -> pa.RecordBatch:
    """Rows (bucket, a binary of packed numbers for each column), one for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = (np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])) if len(bucket) else (cuts, cuts)
    pack = lambda x: pa.array([x[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int64()), *(pack(x[order]) for x in columns.values())], names=["bucket", *columns])


def _numbers(t: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(column).to_pylist()), kind)


def _distinct_pairs(token: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (token, owner) pairs by token, and each pair's rank among its token's."""
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    at = np.flatnonzero(first)
    return token, owner, np.arange(len(token)) - at[np.cumsum(first) - 1] if len(token) else np.zeros(0, np.int64)


def _prefixes(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """The first order's lengthened prefixes, dealt by token; owners are the sets' first signatures.

    Of a token's owners in one batch two are dealt: the others share it for certain. They are counted on the spot and
    come as rows of their own (bucket below 0, tokens: counts), so a token has two owners a batch in its bucket at most.
    """

    def dealt(tokens, owners):
        token, owner, rank = _distinct_pairs(np.concatenate(tokens), np.concatenate(owners))
        few = rank < 2
        yield _packed((token[few] % U(buckets)).astype(np.int64), tokens=token[few], owners=owner[few])
        if not few.all():
            owner, n = np.unique(owner[~few], return_counts=True)
            yield _packed(-1 - np.mod(owner, buckets), tokens=n.astype(U), owners=owner)

    def work(batches):
        for b in batches:
            tokens, owners = [], []
            for i, j, h, t in _sets(b.column("text"), words):
                n, s1, _ = _signature(h, t, j - i)
                length = n - least_overlap(n, percent) + (n + LONGER - 1) // LONGER
                if j - i == 1:
                    h, t = h[: length[0]], t[: length[0]]
                else:
                    own = np.arange(len(h)) - np.concatenate([[0], np.cumsum(n)[:-1]])[t] < length[t]
                    h, t = h[own], t[own]
                tokens.append(h)
                owners.append(s1.view(np.int64)[t])
                if sum(map(len, tokens)) > 8 * CHUNK:
                    yield from dealt(tokens, owners)
                    tokens, owners = [], []
            if tokens:
                yield from dealt(tokens, owners)

    return docs.select("text").mapInArrow(work, "bucket long, tokens binary, owners binary")


def _shared_counts(t: pa.Table) -> pa.Table:
    """Of each owner in a bucket, how many of its tokens another owner has too (an owner met in several batches may count twice)."""
    token, owner = _numbers(t, "tokens", U), _numbers(t, "owners", np.int64)
    if t.column("bucket")[0].as_py() < 0:
        return pa.table({"s1": pa.array(owner), "k": pa.array(token.astype(np.int64))})
    token, owner, _ = _distinct_pairs(token, owner)
    _, of, count = np.unique(token, return_inverse=True, return_counts=True)
    owner, n = np.unique(owner[count[of] > 1], return_counts=True)
    return pa.table({"s1": pa.array(owner), "k": pa.array(n.astype(np.int64))})


HELD = "bucket long, nodes binary, ns binary, counts binary, tokens binary"


def _held(texts: DataFrame, words: int) -> DataFrame:
    """Whole sets (node, n, count of tokens, tokens) of rows (node, s1, text), about 4 CHUNK tokens a row; ``bucket`` is a row's own number.

    A row of texts counts only if its text's signature is that of its node: rows of one id may hold several texts.
    """

    def work(batches):
        from pyspark import TaskContext

        row, held = TaskContext.get().partitionId() << 33, []

        def out():
            nodes, ns, counts, tokens = (np.concatenate([h[k] for h in held]) for k in range(4))
            return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (nodes, ns, counts, tokens))], names=["bucket", "nodes", "ns", "counts", "tokens"])

        for b in batches:
            node, s1 = b.column("node").to_numpy(), b.column("s1").to_numpy()
            for i, j, h, t in _sets(b.column("text"), words):
                n, found, _ = _signature(h, t, j - i)
                own = (found.view(np.int64) == s1[i:j]) & (n > 0)
                if own.any():
                    held.append((node[i:j][own], n[own].astype(np.int64), n[own].astype(np.int64), h if own.all() else h[own[t]]))
                if sum(len(x[3]) for x in held) > 4 * CHUNK:
                    yield out()
                    row, held = row + 1, []
        if held:
            yield out()

    return texts.mapInArrow(work, HELD)


def _asked(held: DataFrame, buckets: int) -> DataFrame:
    """Of each row of whole sets its different tokens with how many of its sets have them, dealt by token."""

    def work(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                token, n = np.unique(_numbers(row, "tokens", U), return_counts=True)
                for s in range(0, len(token), 4 * CHUNK):
                    part = token[s : s + 4 * CHUNK]
                    yield _packed((part % U(buckets)).astype(np.int64), tokens=part, rows=np.full(len(part), row.column("bucket")[0].as_py(), np.int64), counts=n[s : s + 4 * CHUNK].astype(np.int32))

    return held.select("bucket", "tokens").mapInArrow(work, "bucket long, tokens binary, rows binary, counts binary")


def _answered(t: pa.Table) -> pa.Table:
    """How many sets have each token that several have, for each row that asked: (bucket: the row, tokens, dfs)."""
    token, row, n = _numbers(t, "tokens", U), _numbers(t, "rows", np.int64), _numbers(t, "counts", np.int32)
    _, of = np.unique(token, return_inverse=True)
    df = np.bincount(of, n, minlength=1).astype(np.int64)[of] if len(token) else np.zeros(0, np.int64)
    some = df > 1
    return pa.Table.from_batches([_packed(row[some], tokens=token[some], dfs=df[some])])


def _bits(parts: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """A row of bits for each part: which of the known numbers it has."""
    out = np.zeros((len(parts), max(1, (len(known) + 63) // 64) * 8), np.uint8)
    if len(known):
        row = np.zeros(out.shape[1] * 8, bool)
        for packed, p in zip(out, parts, strict=True):
            at = np.minimum(np.searchsorted(known, p), len(known) - 1)
            at = at[known[at] == p]
            row[at] = True
            packed[:] = np.packbits(row)
            row[at] = False
    return out.view(U)


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    values, n = np.unique(np.concatenate(a + b) if a is not b else np.concatenate(a), return_counts=True)
    return values[n > 1]


def _orders(tokens: np.ndarray, n: int, percent: int) -> list[np.ndarray]:
    """The prefix under each order. ``tokens`` are the shared ones, rarest first; unshared ones precede them in every order."""
    k = n - least_overlap(n, percent) + 1 - (n - len(tokens))
    return [tokens[:k], *(tokens[np.argsort(textnp.mixed(tokens * m))[:k]] for m in MORE_ORDERS)]


class Block:
    def __init__(self, t: pa.Table, percent: int):
        self.id = t.column("rep").to_numpy()
        self.n = t.column("n").to_numpy()
        self.tokens = [np.frombuffer(x, U) for x in t.column("tokens").to_pylist()]
        self.prefixes = [_orders(x, int(n), percent) for x, n in zip(self.tokens, self.n, strict=True)]


def verified_links(a: Block, b: Block, percent: int) -> list[tuple[int, int]]:
    """A forest of the similar pairs between two blocks (or in one, if they are the same)."""
    if not len(a.id) or not len(b.id):
        return []
    filters = []
    for k in range(1 + len(MORE_ORDERS)):
        pa_, pb = [p[k] for p in a.prefixes], [p[k] for p in b.prefixes]
        known = _common(pa_, pb if b is not a else pa_)
        filters.append((x := _bits(pa_, known), x if b is a else _bits(pb, known)))
    known = _common(a.tokens, b.tokens)
    full_a = _bits(a.tokens, known)
    full_b = full_a if b is a else _bits(b.tokens, known)
    found_a, found_b = [], []
    for i in range(len(a.id)):
        lo = i + 1 if b is a else 0
        size = (100 * np.minimum(a.n[i], b.n[lo:]) >= percent * np.maximum(a.n[i], b.n[lo:])) & (b.id[lo:] != a.id[i])
        j = np.flatnonzero(size) + lo
        for x, y in filters:
            j = j[(y[j] & x[i]).any(1)]
        if len(j):
            inter = np.bitwise_count(full_b[j] & full_a[i]).sum(1, dtype=np.int64)
            j = j[(100 + percent) * inter >= percent * (a.n[i] + b.n[j])]
            found_a.append(np.full(len(j), a.id[i]))
            found_b.append(b.id[j])
    return _forest(np.concatenate(found_a), np.concatenate(found_b)) if found_a else []


def _smallest(forest: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest id of each linked id's component."""
    near: dict[int, list[int]] = {}
    for a, b in forest:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    root: dict[int, int] = {}
    for start in sorted(near):
        todo = [] if start in root else [start]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += near[x]
    return root


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _groups(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id) of each row: ``component`` numbers the group, component_id is its smallest doc_id.

    Documents with equal sets are one node. Nodes are numbered in a written table, so that ids may repeat.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    buckets = bucket_count(docs, 8 << 20)
    sets = scratch.write(token_sets(docs, words), "sets")
    shared = _prefixes(docs.filter(F.col("doc_id").isNotNull()), words, percent, buckets).groupBy("bucket").applyInArrow(_shared_counts, "s1 long, k long")
    shared = shared.groupBy("s1").agg(F.sum("k").alias("k"))
    nodes = sets.filter("doc_id is not null and n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("least"))
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    fit = nodes.join(shared, "s1").filter(F.col("k") >= F.floor((percent * F.col("n_shingles") + 100 * LONGER - 1) / (100 * LONGER)))
    # always a shuffle by id: the sets left grow with the corpus, so they are not broadcast at any size
    texts = docs.select(F.col("doc_id").cast("long").alias("least"), "text")
    texts = texts.hint("shuffle_merge").join(fit.select("least", "node", "s1"), "least").select("node", "s1", "text")
    held = scratch.write(_held(texts, words), "held")
    answered = _asked(scratch.again(held), buckets).groupBy("bucket").applyInArrow(_answered, "bucket long, tokens binary, dfs binary")

    def order(t: pa.Table, known: pa.Table) -> pa.Table:
        """Of a row's sets, all that may be similar to another: their shared tokens, rarest first, and their prefixes."""
        out = {"rep": [], "n": [], "u": [], "size": [], "tokens": [], "prefix": []}
        token, df = _numbers(known, "tokens", U), _numbers(known, "dfs", np.int64)
        by = np.argsort(token)
        token, df = token[by], df[by]
        node, ns, counts = (_numbers(t, c, np.int64) for c in ("nodes", "ns", "counts"))
        tokens = _numbers(t, "tokens", U)
        for at, n, s, e in zip(node.tolist(), ns.tolist(), (np.cumsum(counts) - counts).tolist(), np.cumsum(counts).tolist(), strict=True):
            own = tokens[s:e]
            place = np.minimum(np.searchsorted(token, own), max(len(token) - 1, 0))
            has = token[place] == own if len(token) else np.zeros(len(own), bool)
            own, place = own[has], place[has]
            if len(own) >= least_overlap(n, percent):
                own = own[np.lexsort((own, df[place]))]
                for k, v in zip(out, (at, n, n - len(own), len(own), own.tobytes(), _orders(own, n, percent)[0].view(np.int64)), strict=True):
                    out[k].append(v)
        sizes = np.array([len(p) for p in out["prefix"]], np.int64)
        flat = np.concatenate(out["prefix"]) if out["prefix"] else np.zeros(0, np.int64)
        return pa.table([*(pa.array(out[k], pa.int64()) for k in ("rep", "n", "u", "size")), pa.array(out["tokens"], pa.binary()), textnp.list_array(flat, sizes)], names=list(out))

    full = scratch.write(held.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(order, "rep long, n long, u long, size long, tokens binary, prefix array<long>"), "full")
    postings = full.select("rep", "u", F.explode("prefix").alias("token"))
    hubs = scratch.again(full).select("rep", "u", F.explode("prefix").alias("token")).groupBy("token").agg(F.min(F.struct("u", "rep"))["rep"].alias("hub"), F.count("*").alias("c")).filter("c > 1").select("token", "hub")
    near = postings.join(hubs, "token").filter("rep != hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    clusters = components(near, scratch)
    members = scratch.write(scratch.again(full).select("rep", "n", "u", "size", "tokens").join(clusters.withColumnRenamed("id", "rep").withColumnRenamed("component", "cluster"), "rep"), "members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    sizes = scratch.write(sizes.withColumn("blocks", F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_TOKENS)).cast("int")), "sizes")
    total = sizes.agg(F.sum("s")).first()[0] or 0

    def all_of(t: pa.Table) -> pa.Table:
        """Clusters that fit into a block are done with here: their sets' components."""
        ids, roots, cluster = [], [], t.column("cluster").to_numpy()
        by = np.argsort(cluster, kind="stable")
        for at in np.split(by, np.flatnonzero(np.diff(cluster[by])) + 1):
            block = Block(t.take(pa.array(at)), percent)
            root = _smallest(verified_links(block, block, percent))
            ids += list(root)
            roots += list(root.values())
        return pa.table({"id": pa.array(ids, pa.int64()), "component": pa.array(roots, pa.int64())})

    sized = members.join(sizes, "cluster")
    groups = max(1, -(-int(total) // BLOCK_TOKENS), buckets)
    small = sized.filter("blocks = 1").withColumn("g", F.pmod(F.xxhash64("cluster"), F.lit(groups))).select("g", "cluster", "rep", "n", "tokens")
    done = small.groupBy("g").applyInArrow(all_of, "id long, component long")
    if not sizes.filter("blocks > 1").limit(1).count():
        return _labelled(sets, nodes, done, scratch)

    def between(left: pa.Table, right: pa.Table) -> pa.Table:
        return _edges(verified_links(Block(left, percent), Block(right, percent), percent) if left.num_rows and right.num_rows else [])

    salt, every = lambda k: F.pmod(F.xxhash64("rep"), F.col(k)).cast("int"), lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    columns = ["cluster", "rep", "n", "tokens"]
    large = scratch.write(sized.filter("blocks > 1").select(*columns, "u", "blocks", salt("blocks").alias("block")), "large")
    hub_ids = large.groupBy("cluster", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(HUBS))).agg(F.min(F.struct("u", "rep"))["rep"].alias("rep")).select("rep")
    hub_rows = scratch.again(large).join(hub_ids, "rep").select(*columns, every("blocks").alias("block"))
    keys = ["cluster", "block"]
    by_hubs = scratch.write(scratch.again(large).select(*columns, "block").groupBy(*keys).cogroup(hub_rows.groupBy(*keys)).applyInArrow(between, "a long, b long"), "by-hubs")
    joined = components(by_hubs, scratch)
    labelled = scratch.again(large).join(joined.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = scratch.write(labelled, "labelled")
    largest = labelled.groupBy("cluster", "component").count().groupBy("cluster").agg(F.max(F.struct("count", "component"))["component"].alias("main"))
    rest = scratch.again(labelled).join(largest, "cluster").filter("component != main")
    rest_blocks = rest.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("rest_blocks"))
    rest_blocks = scratch.write(rest_blocks, "rest-blocks")
    keys = ["cluster", "block", "rest_block"]
    outside = rest.join(rest_blocks, "cluster").select(*columns, every("blocks").alias("block"), salt("rest_blocks").alias("rest_block"))
    inside = scratch.again(labelled).join(scratch.again(rest_blocks), "cluster").select(*columns, "block", every("rest_blocks").alias("rest_block"))
    more = scratch.write(outside.groupBy(*keys).cogroup(inside.groupBy(*keys)).applyInArrow(between, "a long, b long"), "more")
    return _labelled(sets, nodes, done.union(components(by_hubs.union(more), scratch)), scratch)


def _labelled(sets: DataFrame, nodes: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Each row of sets with the component that its node was found in, or the node's own."""
    joined = scratch.write(scratch.again(nodes).join(found, F.col("node") == F.col("id")).select("node", "component", "least"), "joined")
    smallest = scratch.again(joined).groupBy("component").agg(F.min("least").alias("smallest"))
    joined = joined.join(smallest, "component").select("node", "component", "smallest")
    known = scratch.again(nodes).join(joined, "node", "left").select("n_shingles", "s1", "s2", F.coalesce("component", "node").alias("component"), F.coalesce("smallest", "least").alias("component_id"))
    filled = scratch.again(sets).filter("n_shingles > 0").join(known, ["n_shingles", "s1", "s2"], "left")
    has_id = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    empty = scratch.again(sets).filter("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return filled.select("doc_id", "text_hash", "n_shingles", has_id("component"), has_id("component_id")).union(empty)


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text).

    Two rows link when 100 * intersection >= percent * union of their sets of word n-grams (A-Z as a-z, words
    parted by white space; a text of fewer words is one n-gram). Null texts and texts without words have empty
    sets, link with nothing and are their own component. Rows of one id with different texts are rows of their
    own: they share a component only if their texts are linked. Rows without an id are passed through without a
    component and link with nothing. Empty table: no rows. Only doc_id and text are read.
    """
    return _groups(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when one of each group does: that of the smallest doc_id, and of its texts that of the smallest hash.

    Rows without an id or without words stay. Rows of one id are judged by their own texts. Of rows equal in id
    and text, which are copies like any other, one stays. The columns of docs are kept, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    groups = scratch.write(_groups(docs.select("doc_id", "text"), words, percent).filter("component is not null"), "groups")
    first = scratch.again(groups).filter("doc_id = component_id").groupBy("component").agg(F.min("text_hash").alias("first"))
    id_, hash_ = fresh(docs, "gone_id", "gone_hash")
    keys = lambda df: df.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    same = (docs["doc_id"].cast("long") == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(hash_))
    gone = keys(groups.join(first, "component").filter("doc_id != component_id or text_hash != first")).distinct()
    left = docs.join(gone, same, "left_anti")
    again = scratch.write(keys(scratch.again(groups).groupBy("doc_id", "text_hash").agg(F.count("*").alias("c")).filter("c > 1")), "again")
    if not again.limit(1).count():
        return left
    once = left.join(scratch.again(again), same).dropDuplicates([id_, hash_]).select(*docs.columns)
    return left.join(again, same, "left_anti").union(once)
