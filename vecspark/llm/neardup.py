"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set is its distinct five-word shingles (the whole word sequence when
shorter). Two documents are linked when 100 * |A ∩ B| >= 85 * |A ∪ B| (the threshold
is a parameter). The join runs in three steps:

1. Documents with equal sets collapse to one class (a map-side combined minimum), so
   exact copies cost nothing further, however many there are.
2. Independent random trees over the classes. A node picks a minwise coordinate by
   hashing its own path (sometimes two, 1/threshold on average); its members branch by
   their value there. Nodes of at most `leaf` members are compared exhaustively on
   their signatures. In a larger node, members somewhat like its head join the head's
   candidate group, and those not clearly like it branch on (a member clearly like the
   head needs no more branching: whatever is linked with it is somewhat like the head,
   and so in the same group). Nodes still large at the last level join one group. This
   yields candidate groups: no pair is ever dropped inside one.
3. The candidate links, likeliest first, are confirmed on full sets; that settles most
   groups. A group that stays in several parts, and of which not all pairs were compared,
   is decided whole: it is cut into blocks of bounded
   size, and each pair of blocks is one unit of work that returns only a spanning
   forest of its confirmed links.

With 64 values, a linked pair at exactly 0.85 passes the signature test (0.62) but for
odds of 1e-6; a tree brings it together in a leaf with odds of 0.85 at the first level,
so twelve trees miss it with odds below 1e-6 in sparse neighbourhoods and about 1e-4
where nodes split five times.

Null or word-less texts have an empty set and are linked with nothing. Every input row
gives one output row; rows that share a doc_id keep their own sets and links. Columns other than
doc_id and text are not looked at, texts may have any length, and an empty table gives an empty result.
A group of copies or a hub of links that holds a large part of all rows is split by its counted size; where narrow rows
(ids and node numbers) are joined by a skewed key, adaptive execution splits the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import textkernel as K
from vecspark.llm.common import BROADCAST_ROWS, Scratch, components, hot_bound, join_split, pairs_with, read, small_side

SHINGLE = 5
VALUES = 64
TREES = 12
LEVELS = 8
LEAF = 64
BLOCK_DOCS = 1024
BLOCK_SHINGLES = 1_000_000
_MULTIPLIERS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _digest(s: np.ndarray) -> tuple[int, int]:
    a = K.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    b = (K.mix(s + np.uint64(0x51ED270B)) * np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    return int(a), int(b)


def class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """One number for each set of shingles."""
    n = np.array([len(s) for s in sets], np.uint64)
    return K.mix(np.array([(a * 31 + b) & (2**64 - 1) for a, b in map(_digest, sets)], np.uint64) + n).view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, cid, sig) by row; cid identifies the set, sig has its minwise values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in K.slices(batch.column(1)):
                sets = K.shingles(texts, SHINGLE)
                n = np.array([len(s) for s in sets], np.int64)
                sig = np.zeros((len(sets), VALUES), np.int32)
                if n.any():
                    flat = np.concatenate([s for s in sets if len(s)])
                    heads = np.concatenate([[0], np.cumsum(n[n > 0])[:-1]])
                    for k in range(VALUES):
                        low = np.minimum.reduceat(flat * _MULTIPLIERS[k], heads)
                        sig[n > 0, k] = (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
                cid = class_ids(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)).cast(pa.int64()),
                        pa.array(n),
                        pa.array(cid),
                        pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel()), VALUES).cast(pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "n_shingles", "cid", "sig"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_shingles long, cid long, sig array<int>")


def _forest(pairs_a: np.ndarray, pairs_b: np.ndarray) -> list[tuple[int, int]]:
    """Of the given links, those that join parts not joined before."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    out = []
    for a, b in zip(pairs_a.tolist(), pairs_b.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            up[x] = y
            out.append((a, b))
    return out


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables that end where the first `keys` columns change; rows come sorted by them."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and any(c[0] != v for c, v in zip(cols, last, strict=True))
        last = [c[-1] for c in cols]
        cut = np.flatnonzero(change)
        if len(cut):
            rest.append(batch.slice(0, cut[0]))
            yield pa.Table.from_batches(rest)
            if cut[-1] > cut[0]:
                yield pa.Table.from_batches([batch.slice(cut[0], cut[-1] - cut[0])])
            rest = [batch.slice(cut[-1])]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def _leaf_links(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, 1):
            node, cid = np.asarray(t.column(0)), np.asarray(t.column(1))
            sig = np.asarray(t.column(2).combine_chunks().flatten()).reshape(len(cid), VALUES)
            a, b, like = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)]
            for shift in range(1, len(cid)):
                i = np.flatnonzero(node[shift:] == node[:-shift])
                if not len(i):
                    break
                for part in np.array_split(i, max(1, len(i) // 50_000)):
                    same = (sig[part] == sig[part + shift]).sum(axis=1)
                    hit = part[same >= similar * VALUES]
                    a.append(hit)
                    b.append(hit + shift)
                    like.append(same[same >= similar * VALUES])
            a, b, like = np.concatenate(a), np.concatenate(b), np.concatenate(like)
            order = np.lexsort((b, a, -like))  # the likeliest first
            # a row stands in one node, so rows of different nodes are never joined here
            links = _forest(a[order], b[order])
            if links:
                links = np.array(links)
                yield pa.RecordBatch.from_arrays([pa.array(cid[links[:, 0]]), pa.array(cid[links[:, 1]])], names=["a", "b"])

    return run


def candidate_links(scratch: Scratch, classes: DataFrame, threshold: float, trees: int = TREES, levels: int = LEVELS, leaf: int = LEAF) -> DataFrame:
    """(a, b): links that join all classes which may be similar, from the leaves of all trees."""
    similar = threshold - 5.2 * (threshold * (1 - threshold) / VALUES) ** 0.5
    sig = classes.select("cid", "sig")
    coordinate = lambda *c: F.pmod(F.xxhash64(*c), F.lit(VALUES)).cast("int") + 1
    tree = sig.select("cid", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = tree.select("cid", F.xxhash64("tree", F.element_at("sig", coordinate("tree"))).alias("node"))
    leaves, heads = [], []
    for level in range(1, levels + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("cid").alias("head")).where("size > 1")
        kept = scratch.put(rows.join(sizes, "node"), f"level{level}")
        leaves.append(kept.where(F.col("size") <= leaf).select("node", "cid"))
        large = kept.where(F.col("size") > leaf)
        if level == levels:
            heads.append(large.select(F.col("cid").alias("a"), F.col("head").alias("b")))
        if level == levels or large.isEmpty():
            break
        leaders = large.where("cid = head").select("node", "cid").distinct().join(sig, "cid").select("node", F.col("sig").alias("head_sig"))
        alike = F.aggregate(F.zip_with("sig", "head_sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / VALUES
        near = large.join(sig, "cid").join(leaders, "node").select("cid", "node", "head", "sig", alike.alias("alike"))
        near = scratch.put(near, f"large{level}")
        heads.append(near.where(F.col("alike") >= threshold - 0.45).select(F.col("cid").alias("a"), F.col("head").alias("b")))
        more = F.pmod(F.xxhash64("node", F.lit("second")), F.lit(1000)) < int(1000 * (1 / threshold - 1))
        picks = F.when(more, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        rows = near.where(F.col("alike") < threshold - 0.25).select("cid", "node", "sig", F.explode(picks).alias("pick"))
        rows = rows.select("cid", F.xxhash64("node", "pick", F.element_at("sig", coordinate("node", "pick"))).alias("node"))
    members = leaves[0]
    for more in leaves[1:]:
        members = members.unionAll(more)
    links = (
        members.join(sig, "cid").select("node", "cid", "sig").repartition("node").sortWithinPartitions("node", "cid").mapInArrow(_leaf_links(similar), "a long, b long")
    )
    for more in heads:
        links = links.unionAll(more.where("a <> b"))
    return links


def _confirmed(percent: int):
    """Of one block pair, a spanning forest of the links that full sets confirm."""

    def within(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(s) for s in sets])
        if len(sets) == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            ok = 100 * both >= percent * (n.sum() - both)
            return (np.array([0]), np.array([1])) if ok else (np.zeros(0, int), np.zeros(0, int))
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
        token = np.cumsum(fresh) - 1
        df = np.bincount(token)
        keep = df[token] > 1
        owner, token = owner[keep], token[keep]
        _, token = np.unique(token, return_inverse=True)
        both = np.zeros((len(sets), len(sets)), np.float32)
        wide = max(1, 8_000_000 // len(sets))
        for at in range(0, int(token.max(initial=-1)) + 1, wide):
            some = (token >= at) & (token < at + wide)
            m = np.zeros((len(sets), min(wide, int(token.max()) + 1 - at)), np.float32)
            m[owner[some], token[some] - at] = 1
            both += m @ m.T
        linked = 100 * both.astype(np.int64) >= percent * (n[:, None] + n[None, :] - both.astype(np.int64))
        return np.nonzero(np.triu(linked, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, 3):
            keys = np.stack([np.asarray(t.column(i)) for i in range(3)], axis=1)
            heads = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            cid = np.asarray(t.column(3))
            sets = t.column(4).combine_chunks()
            at, flat = np.asarray(sets.offsets), np.asarray(sets.values).view(np.uint64)
            out = []
            for x, y in zip(heads[:-1], heads[1:], strict=True):
                if y - x > 1:
                    a, b = within([flat[at[i] : at[i + 1]] for i in range(x, y)])
                    out += [(cid[x + i], cid[x + j]) for i, j in _forest(a, b)]
            if out:
                out = np.array(out)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return run


def _sets(docs: DataFrame) -> DataFrame:
    """(cid, shingles) of the rows (cid, text) whose text has that set; a task gives each set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at, texts in K.slices(batch.column(1)):
                wanted = batch.column(0).slice(at, len(texts)).to_pylist()
                sets = K.shingles(texts, SHINGLE)
                own = class_ids(sets).tolist()
                some = []
                for i, cid in enumerate(wanted):
                    if own[i] == cid and cid not in seen:
                        seen.add(cid)
                        some.append(i)
                flat = np.concatenate([sets[i] for i in some]) if some else np.zeros(0, np.uint64)
                at_ = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([wanted[i] for i in some], pa.int64()), pa.ListArray.from_arrays(pa.array(at_), pa.array(flat.view(np.int64)))], names=["cid", "shingles"])

    return docs.mapInArrow(run, "cid long, shingles array<long>")


def _tested(scratch: Scratch, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked): whether full sets confirm each link; a, the smaller, may be the head of a large node."""
    both = pairs_with(scratch, links, sets, "a", "b", "cid", "shingles")
    common, total = F.size(F.array_intersect("a_shingles", "b_shingles")), F.size("a_shingles") + F.size("b_shingles")
    return both.select("a", "b", (100 * common >= percent * (total - common)).alias("linked"))


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs; see the module.

    component_id is the smallest doc_id reachable over links; kept says that it is the
    document's own. A null doc_id stays null and never names a component of others.
    """
    scratch = Scratch(spark)
    rows = scratch.put(signatures(docs, id_col, text_col), "rows")
    some = rows.where("n_shingles > 0")
    classes = scratch.put(some.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"), F.count("*").alias("copies")), "classes")
    links = candidate_links(scratch, classes, percent / 100)
    links = scratch.put(links.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("b")).where("x <> b").withColumnRenamed("x", "a").distinct(), "links")
    # one row stands for a class: one with its smallest id; rows that share an id are told apart by their sets
    wanted = scratch.put(links.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "rep"), "cid"), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).where("rep is not null")
    size = wanted.count()  # no table of linked classes has more rows
    found = texts.join(small_side(wanted, size, BROADCAST_ROWS), "rep").select("cid", "text")
    sets = scratch.put(_sets(found).dropDuplicates(["cid"]), "sets")
    # most groups are joined by their candidate links alone
    tested = scratch.put(_tested(scratch, links, sets, percent), "tested")
    parts = scratch.put(components(scratch, tested.where("linked").select("a", "b")), "parts")
    rest = _undecided(scratch, tested, parts, classes, size)
    if rest is not None:
        own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
        units = (
            rest.join(sets, "cid")
            .withColumn("own", own)
            .select("grp", "cid", "shingles", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            .select("grp", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "cid", "shingles")
        )
        more = units.repartition("grp", "p", "q").sortWithinPartitions("grp", "p", "q", "cid").mapInArrow(_confirmed(percent), "a long, b long")
        more = scratch.put(_between(more, parts, size), "more")
        if not more.isEmpty():
            merged = components(scratch, more).select(F.col("label").alias("to"), F.col("node").alias("label"))
            inner = parts.unionAll(merged.join(parts.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), "label"))
            parts = inner.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    named = scratch.put(small_side(parts, size).join(classes.select(F.col("cid").alias("node"), "rep"), "node"), "members")
    lowest = small_side(named.groupBy("label").agg(F.min("rep").alias("component")), size)
    # every class: its component's smallest id, or its own
    merged = named.join(lowest, "label").select(F.col("node").alias("cid"), "component")
    classes = classes.select("cid", "rep", "copies").join(small_side(merged, size), "cid", "left").select("cid", "copies", F.coalesce("component", "rep").alias("component"))
    classes = scratch.put(classes, "named")
    hot = [r[0] for r in classes.where(F.col("copies") > hot_bound(spark, classes.agg(F.sum("copies")).first()[0] or 0)).select("cid").collect()]
    alone = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = join_split(rows.select("doc_id", "n_shingles", "cid"), classes.drop("copies"), "cid", hot, "left").select("doc_id", "n_shingles", alone.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _between(links: DataFrame, parts: DataFrame, rows: int) -> DataFrame:
    """The links (a, b) as links of different parts, which have so many rows at most."""
    x, y = (small_side(parts.select(F.col("node").alias(n), F.col("label").alias(p)), rows) for n, p in (("a", "x"), ("b", "y")))
    links = links.join(x, "a", "left").join(y, "b", "left")
    return links.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b").distinct()


def _undecided(scratch: Scratch, tested: DataFrame, parts: DataFrame, classes: DataFrame, size: int) -> DataFrame | None:
    """(grp, blocks, cid) of the parts that refused links connect, where not all pairs of classes were compared."""
    refused = scratch.put(_between(tested.where("not linked").select("a", "b"), parts, size), "refused")
    if refused.isEmpty():
        return None
    groups = components(scratch, refused).select(F.col("node").alias("part"), F.col("label").alias("grp"))
    of = parts.select(F.col("node").alias("cid"), F.col("label").alias("part"))
    alone = groups.join(of.select("part"), "part", "left_anti").select(F.col("part").alias("cid"), "grp")
    members = scratch.put(small_side(of, size).join(groups, "part").select("cid", "grp").unionAll(alone), "members")
    tried = tested.join(members.select(F.col("cid").alias("a"), "grp"), "a").groupBy("grp").agg(F.count("*").alias("tried"))
    sized = members.join(classes.select("cid", "n"), "cid").groupBy("grp").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    open_ = sized.join(tried, "grp").where(F.col("tried") < F.col("docs") * (F.col("docs") - 1) / 2)
    open_ = open_.select("grp", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rest = scratch.put(members.join(open_, "grp"), "rest")
    return None if rest.isEmpty() else rest


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each group, those with its smallest doc_id.

    Rows without words and rows without doc_id stay; rows that repeat a doc_id go or stay together.
    """
    gone = near_duplicates(spark, docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "documents"))


ORACLE = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
t2 AS (SELECT doc_id, g FROM t SEMI JOIN (SELECT g FROM t GROUP BY g HAVING count(*) > 1) USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM t2 a JOIN t2 b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, least(n.doc_id, coalesce(r.low, n.doc_id)) AS component_id,
  n.doc_id = least(n.doc_id, coalesce(r.low, n.doc_id)) AS kept
FROM n LEFT JOIN r ON r.a = n.doc_id
"""
