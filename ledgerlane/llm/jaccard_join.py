"""N-gram Jaccard join by prefix trees, with the components of its links.

Two documents link when the Jaccard similarity of their sets of word n-grams reaches ``num / den``. The join is exact;
n-grams and sets are told apart by 64-bit hashes.

1. Equal sets are one node, whatever the number of copies.
2. All documents order the n-grams of their sets in one global order, rarest first. Linked sets share an n-gram among the
   first |x| - ceil(num / den * |x|) + 1 of either, so a set whose prefix is all its own can't link and is done.
   Frequencies are counted for the n-grams with small hashes only (class A, a share of them that leaves every prefix long
   enough); the rest come after them in the order, by hash. Sets of up to SHORT n-grams, which may have too few in class
   A, are ordered in a second order with all n-grams counted. Counting is done in hash buckets: a task sends each bucket
   the packed n-grams of its sets, a few rows instead of one for each n-gram.
3. First round: the smallest set of each shared prefix n-gram is its centre, and is searched in a prefix tree of the other
   sets that have the n-gram. All centres of a task are searched at once in one forest. What a centre links with is one
   component from then on, so families of near copies are settled at the cost of their size, and an n-gram that only two
   sets share is settled whether they link or not.
4. Second round: n-grams whose other sets are still in several components. Sizes are cut into bands as wide as a link can
   reach, and sets of two neighbouring bands that share such an n-gram form groups (connected components, of each pair of
   bands by itself). A group's sets go into one tree, and every set outside the largest component is searched.
5. In a tree the sets share the nodes of their common beginnings; the overlap with a path counts for all sets below it, and
   a subtree is left as soon as the overlap so far plus the most that either side has left can't reach what its shortest
   set requires.
6. Tasks are bounded by n-grams: a centre's sets are dealt into parts of about PART_GRAMS, a group's into blocks of about
   BLOCK_GRAMS, of which every pair is a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.components import connected_components
from ledgerlane.llm.runtime import arrow_map, bounded_rows, discard, durable, sent_if_small
from ledgerlane.llm.textkernel import LOWER, Chunk, U, chunks, distinct_per_row, mix, ngrams, span_hashes, words

SHORT, STRIDE = 64, 8
#: N-grams of a part of a centre's sets, and of a block of a group's; sets that a group searches at a time.
PART_GRAMS, BLOCK_GRAMS, QUERIES = 500_000, 500_000, 64
#: Packed n-grams that a counting bucket should hold, and that a task holds before it sends them.
BUCKET_GRAMS, FLUSH_GRAMS = 2_000_000, 2_000_000
#: Bits of the filter that spares most documents the second reading of their sets. 8 MB, whatever the corpus.
FILTER_BITS = 26
ORDERS = (U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25))  # salts of the order for short sets and of that for the others


def sets_of(c: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of each row's distinct n-grams, ascending. A row of fewer than n words has its whole sequence as one."""
    c = c._replace(buf=LOWER[c.buf])
    w = words(c)
    row, h = w.rows(), span_hashes(c.buf, w.start, w.end)
    count = np.diff(w.first)
    at, g = ngrams(h, row, n)
    rows, hashes = [row[at]], [g]
    for k in range(1, n):
        if (count == k).any():
            at, g = ngrams(h, row, k)
            mine = count[row[at]] == k
            rows.append(row[at][mine])
            hashes.append(g[mine])
    return distinct_per_row(np.concatenate(hashes), np.concatenate(rows))


class Rule:
    """Similarity of at least num / den, and what follows from it."""

    def __init__(self, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den
        self.share = min(1.0, 2.5 * (den - num) / den)  # of hashes in class A
        self.limit = U(min(int(self.share * 2.0**64), 2**64 - 1))
        self.most_short = SHORT * den // num + 1  # a set of up to SHORT can't link with a larger one

    def prefix(self, size: np.ndarray) -> np.ndarray:
        return size + (-size * self.num) // self.den + 1

    def linked(self, shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return shared * (self.den + self.num) >= self.num * (a + b)

    def views(self, row: np.ndarray, g: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, list]:
        """Sizes and digests of the rows' sets, and for both orders: which rows take part, and which of the n-grams are counted."""
        size = np.bincount(row, minlength=n_rows)
        first = np.concatenate([[0], np.cumsum(size)])
        total = np.concatenate([[U(0)], np.cumsum(mix(g ^ U(0x8EBC6AF09C88C6E3)))])
        digest = mix((total[first[1:]] - total[first[:-1]]) ^ size.astype(np.uint64))
        short, long = (size > 0) & (size <= self.most_short), size > SHORT
        return size, digest, [(short, short[row]), (long, long[row] & (g <= self.limit))]


def _meta(rule: Rule):
    """For each document: size and digest of its set, for each order the number of counted n-grams (null: not in it), and the uncounted n-grams of its prefix."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            parts = []
            for c in chunks(batch.column(1)):
                row, g = sets_of(c, rule.n)
                n_rows = c.hi - c.lo
                size, digest, views = rule.views(row, g, n_rows)
                counted = [np.where(rows, np.bincount(row[grams], minlength=n_rows), -1) for rows, grams in views]
                p = rule.prefix(size)
                late = [[] for _ in range(n_rows)]
                start = np.cumsum(size) - size
                for r in np.flatnonzero((counted[1] >= 0) & (counted[1] < p)).tolist():
                    late[r] = g[start[r] + counted[1][r] : start[r] + p[r]].view(np.int64).tolist()
                parts.append((size, digest.view(np.int64), *counted, late))
            cols = [np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, np.int64) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols), pa.array([y for x in parts for y in x[4]], pa.list_(pa.int64()))], ["doc_id", "n", "d", "na0", "na1", "late"])

    return run


def _packed(rule: Rule, buckets: int):
    """Rows of (bucket, keys, owners, views): packed counted n-grams of the sets, each set once a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0

        def flush() -> pa.RecordBatch:
            m, view = (np.concatenate(x) if held else np.zeros(0, np.uint64) for x in (zip(*held, strict=True) if held else ((), ())))
            bucket = ((m & U(0xFFFFFFFF)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            m, view, bucket = m[order], view[order], bucket[order]
            names, start = np.unique(bucket, return_index=True)
            rows: list[list] = [[], [], [], []]
            for b, lo, hi in zip(names.tolist(), start.tolist(), [*start[1:].tolist(), len(m)], strict=False):
                own, owner = np.unique(view[lo:hi], return_inverse=True)
                for column, v in zip(rows, (b, m[lo:hi].astype("<u8").tobytes(), owner.astype("<u4").tobytes(), own.astype("<u8").tobytes()), strict=True):
                    column.append(v)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])], ["bucket", "keys", "owners", "views"])

        for batch in it:
            for c in chunks(batch.column(0)):
                row, g = sets_of(c, rule.n)
                _, digest, views = rule.views(row, g, c.hi - c.lo)
                fresh = np.zeros(c.hi - c.lo, bool)
                for r, d in enumerate(digest.tolist()):
                    if d not in seen:
                        seen.add(d)
                        fresh[r] = True
                for salt, (_, grams) in zip(ORDERS, views, strict=True):
                    at = np.flatnonzero(grams & fresh[row])
                    held.append((mix(g[at] ^ salt), digest[row[at]] ^ salt))
                    n_held += len(at)
            if n_held >= FLUSH_GRAMS:
                yield flush()
                n_held = 0
        yield flush()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket, the n-grams that two or more sets have: for each set their places in the order (frequency, then the hash)."""
    keys, views = [], []
    for k, o, v in zip(*(table.column(x).to_pylist() for x in ("keys", "owners", "views")), strict=True):
        keys.append(np.frombuffer(k, "<u8"))
        views.append(np.frombuffer(v, "<u8")[np.frombuffer(o, "<u4")])
    key, view = np.concatenate(keys), np.concatenate(views)
    order = np.lexsort((view, key))
    key, view = key[order], view[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (view[1:] != view[:-1])  # tasks send the same set again
    key, view = key[new], view[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    df = np.diff(np.append(start, len(key)))
    many = np.repeat(df, df)
    keep = many > 1
    view, key, many = view[keep], key[keep], many[keep]
    order = np.argsort(view, kind="stable")
    view, key, many = view[order], key[order], many[order]
    first = np.flatnonzero(np.concatenate([[True], view[1:] != view[:-1]])) if len(view) else np.zeros(0, np.int64)
    places = pa.StructArray.from_arrays([pa.array(many.astype(np.int64)), pa.array(key.view(np.int64))], ["df", "key"])
    return pa.table({"v": pa.array(view[first].view(np.int64)), "places": pa.ListArray.from_arrays(pa.array(np.append(first, len(view)).astype(np.int32)), places)})


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of], of


class Forest:
    """Prefix trees, one for each group, over sets of ascending numbers under ``top``, with nodes of up to STRIDE elements, as arrays."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, group: np.ndarray, n_groups: int, top: int):
        self.sizes, self.groups, self.top = sizes, n_groups, top
        begin = np.cumsum(sizes) - sizes
        node = mix(group.astype(np.uint64))  # the node that a set has reached, by the hash of its path
        parents, parts, depth, last, ends = [], [], [], [], []
        least, most, base = [], [], 0
        index = group - n_groups  # parent of a tree's first nodes: from -n_groups to -1
        for level in range(-(-int(sizes.max()) // STRIDE)):
            own = np.flatnonzero(sizes > level * STRIDE)
            at = begin[own][:, None] + level * STRIDE + np.arange(STRIDE)
            inside = level * STRIDE + np.arange(STRIDE) < sizes[own][:, None]
            part = np.where(inside, flat[np.minimum(at, len(flat) - 1)], top)
            path = node[own]
            for j in range(STRIDE):
                path = mix(path + part[:, j].astype(np.uint64) + U(0x9E3779B97F4A7C15))
            _, pick, back = np.unique(path, return_index=True, return_inverse=True)
            count = len(pick)
            parents.append(index[own[pick]])
            parts.append(part[pick])
            depth.append(level * STRIDE + inside[pick].sum(1))
            last.append(np.where(inside[pick], part[pick], -1).max(1))
            lo, hi = np.full(count, 1 << 60), np.zeros(count, np.int64)
            np.minimum.at(lo, back, sizes[own])
            np.maximum.at(hi, back, sizes[own])
            least.append(lo)
            most.append(hi)
            node[own], index[own] = path, base + back
            done = own[sizes[own] <= (level + 1) * STRIDE]
            ends.append(np.stack([index[done], done], 1))
            base += count
        self.part, self.depth, self.last, self.least, self.most = map(np.concatenate, (parts, depth, last, least, most))
        parent = np.concatenate(parents)
        self.child = np.argsort(parent, kind="stable")
        self.child_from = np.searchsorted(parent[self.child], np.arange(-n_groups, base + 1))
        ends = np.concatenate(ends)
        ends = ends[np.argsort(ends[:, 0], kind="stable")]
        self.end_set, self.end_from = ends[:, 1], np.searchsorted(ends[:, 0], np.arange(base + 1))

    def search(self, flat: np.ndarray, sizes: np.ndarray, group: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, set) that link, each query in the tree of its group. All queries walk at once, level by level."""
        width, begin = self.top + 1, np.cumsum(sizes) - sizes
        keys = np.repeat(np.arange(len(sizes)), sizes) * width + flat  # ascending
        at, q = _ranges(self.child_from[group], self.child_from[group + 1])
        nodes, overlap = self.child[at], np.zeros(len(at), np.int64)
        queries, found = [], []
        while len(nodes):
            k = q[:, None] * width + self.part[nodes]
            place = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            overlap = overlap + (keys[place] == k).sum(1)
            at, of = _ranges(self.end_from[nodes], self.end_from[nodes + 1])
            if len(at):
                s = self.end_set[at]
                yes = rule.linked(overlap[of], sizes[q[of]], self.sizes[s])
                queries.append(q[of[yes]])
                found.append(s[yes])
            left = sizes[q] - (np.searchsorted(keys, q * width + self.last[nodes], "right") - begin[q])
            bound = overlap + np.minimum(left, self.most[nodes] - self.depth[nodes])
            go = rule.linked(bound, sizes[q], self.least[nodes]) & (self.most[nodes] * rule.den >= rule.num * sizes[q]) & (self.least[nodes] * rule.num <= rule.den * sizes[q])
            nodes, overlap, q = nodes[go], overlap[go], q[go]
            at, of = _ranges(self.child_from[nodes + self.groups], self.child_from[nodes + self.groups + 1])
            nodes, overlap, q = self.child[at], overlap[of], q[of]
        none = np.zeros(0, np.int64)
        return (np.concatenate(queries), np.concatenate(found)) if found else (none, none)


def _numbered(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """The sets' elements by their places among all that occur, the sizes, and how many occur."""
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    return flat.astype(np.int64), np.array([len(s) for s in sets], np.int64), len(values)


def _some(flat: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    end = np.cumsum(sizes)
    return flat[_ranges((end - sizes)[chosen], end[chosen])[0]]


def star_links(sets: list[np.ndarray], group: np.ndarray, centre: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Links (centre, other set) in many groups, whose numbers ascend; both by their places among the sets."""
    flat, sizes, top = _numbered(sets)
    c, m = np.flatnonzero(centre), np.flatnonzero(~centre)
    if not len(c) or not len(m):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    forest = Forest(_some(flat, sizes, m), sizes[m], group[m], int(group[-1]) + 1, top)
    q, s = forest.search(_some(flat, sizes, c), sizes[c], group[c], rule)
    return c[q], m[s]


def join_group(sets: list[np.ndarray], labels: np.ndarray, rule: Rule) -> np.ndarray:
    """The smallest label in the component of each set, by the links among them. Sets with one label are one from the start."""
    flat, sizes, top = _numbered(sets)
    zero = np.zeros(len(sets), np.int64)
    tree = Forest(flat, sizes, zero, 1, top)
    _, comp = np.unique(labels, return_inverse=True)
    size = np.bincount(comp)
    searched, moved = np.zeros(len(sets), bool), {}
    while True:
        left = np.flatnonzero(~searched & (comp != size.argmax()))[:QUERIES]
        if not len(left):
            break
        searched[left] = True
        q, s = tree.search(_some(flat, sizes, left), sizes[left], zero[left], rule)
        pairs = np.unique(np.stack([comp[left[q]], comp[s]], 1), axis=0)
        for a, b in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
            while size[a] == 0:
                a = moved[a]
            while size[b] == 0:
                b = moved[b]
            if a != b:
                a, b = (a, b) if size[a] < size[b] else (b, a)  # the smaller joins the larger
                comp[comp == a] = b
                size[b] += size[a]
                size[a], moved[a] = 0, b
    out = np.full(len(size), np.iinfo(np.int64).max)
    np.minimum.at(out, comp, labels)
    return out[comp]


def _verify_stars(rule: Rule):
    """Over rows (a, part, centre, rep, grams) sorted by the first two: the links of the centres, as (a, b)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, held = None, -1, 0
        reps, sets, group, centre = [], [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            rep = np.array(reps, np.int64)
            c, m = star_links(sets, np.array(group, np.int64), np.array(centre, bool), rule) if sets else (np.zeros(0, np.int64),) * 2
            out = pa.RecordBatch.from_arrays([pa.array(rep[c], pa.int64()), pa.array(rep[m], pa.int64())], ["a", "b"])
            held, number = 0, -1
            for x in (reps, sets, group, centre):
                x.clear()
            return out

        for batch in it:
            for a, part, is_centre, rep, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, part) != key:
                    if held >= PART_GRAMS:
                        yield flush()
                    key, number = (a, part), number + 1
                reps.append(rep)
                sets.append(np.frombuffer(grams, "<u8"))
                group.append(number)
                centre.append(is_centre)
                held += len(sets[-1])
        yield flush()

    return run


def _join_groups(rule: Rule):
    """Over rows (group, i, j, label, grams) sorted by the first three: the links that hold each group's components together, as (a, b) of labels."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, labels, sets = None, [], []

        def close() -> pa.RecordBatch:
            label = np.array(labels, np.int64)
            smallest = join_group(sets, label, rule) if len(sets) > 1 else label
            pairs = np.unique(np.stack([smallest, label], 1)[smallest != label], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])

        for batch in it:
            for group, i, j, label, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, i, j) != key:
                    if key is not None:
                        yield close()
                    key, labels, sets = (group, i, j), [], []
                labels.append(label)
                sets.append(np.frombuffer(grams, "<u8"))
        if key is not None:
            yield close()

    return run


def _gather(rule: Rule, shared):
    """Sets of the documents whose filter bit is set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in it:
            x = batch.column(2).to_numpy(zero_copy_only=False)
            chosen = np.flatnonzero((bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1)
            batch = batch.take(pa.array(chosen))
            digests, blobs = [], []
            for c in chunks(batch.column(1)):
                row, g = sets_of(c, rule.n)
                size, digest, _ = rule.views(row, g, c.hi - c.lo)
                digests.append(digest.view(np.int64))
                end = np.cumsum(size)
                blobs += [g[a:b].astype("<u8").tobytes() for a, b in zip((end - size).tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(digests) if digests else [], pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "d", "grams"])

    return run


def _sets_of_marked(docs: DataFrame, node: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """(rep, grams) of the distinct sets of the given representatives. A filter of fixed size spares most other documents the work."""
    position = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    marked = reps.select(F.col("rep").alias("doc_id")).select(position.alias("x")).groupBy(F.bitmap_bucket_number(F.col("x") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("x") + 1)).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in bounded_rows(marked, 1 << (FILTER_BITS - 15), "filter pages"):
        at = (int(r["k"]) - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    sets = arrow_map(docs.filter("doc_id is not null").select("doc_id", "text", position.alias("x")), _gather(rule, shared), "doc_id bigint, d bigint, grams binary")
    known = node.join(reps, "rep").select(F.col("rep").alias("doc_id"), "d")
    return sets.join(known, ["doc_id", "d"]).groupBy(F.col("doc_id").alias("rep"), "d").agg(F.any_value("grams").alias("grams")).select("rep", "grams")


def _prefix_tokens(docs: DataFrame, meta: DataFrame, node: DataFrame, rule: Rule, bucket_grams: int) -> DataFrame:
    """(rep, n, token): the n-grams in the prefix of each set that another set may share."""
    grams = meta.agg(F.sum("na0").alias("a"), F.sum("na1").alias("b")).first()
    buckets = max(16, -(-((grams["a"] or 0) + (grams["b"] or 0)) // bucket_grams))
    packed = arrow_map(docs.filter("doc_id is not null").select("text"), _packed(rule, buckets), "bucket bigint, keys binary, owners binary, views binary")
    shared = packed.groupBy("bucket").applyInArrow(_shared, "v bigint, places array<struct<df:bigint,key:bigint>>")
    places = shared.groupBy("v").agg(F.flatten(F.collect_list("places")).alias("places"))
    salts = [int(np.array(s).view(np.int64)) for s in ORDERS]
    one = lambda k: node.filter(f"na{k} >= 0").select(F.col("d").bitwiseXOR(F.lit(salts[k])).alias("v"), "rep", "n", F.col(f"na{k}").alias("na"))
    # of the prefix, without the n-grams that no other set has
    room = F.expr(f"n - (n * {rule.num} + {rule.den - 1}) div {rule.den} + 1") - (F.col("na") - F.size("places"))
    first = F.transform(F.slice(F.array_sort("places"), F.lit(1), F.col("room").cast("int")), lambda x: x["key"])
    early = one(0).unionByName(one(1)).join(places, "v").withColumn("room", room).filter("room > 0").select("rep", "n", F.explode(first).alias("token"))
    late = meta.filter("n > 0 and doc_id is not null and size(late) > 0").select("d", "late").distinct().join(node.select("d", "rep", "n"), "d").select("rep", "n", F.explode("late").alias("token"))
    return early.unionByName(late)


def ngram_jaccard_join(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id", part_grams: int = PART_GRAMS, block_grams: int = BLOCK_GRAMS, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """doc_id, n_shingles (size of its set) and component_id for every row.

    The component is the smallest doc_id that links reach. A text without words, or a null one, has an empty set and is
    linked with nothing. Rows with one doc_id are one document to the components, and each has a row of its own in the
    result. A row with a null doc_id has its size and a null component, and links nothing. Ids are cast to bigint; other
    columns are ignored. An empty table gives an empty one. No set, group or frequency is capped, and a text of any length
    is one set.
    """
    rule = Rule(n, num, den)
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    meta = durable(arrow_map(docs, _meta(rule), "doc_id bigint, n bigint, d bigint, na0 bigint, na1 bigint, late array<bigint>"), "sets")
    node = durable(meta.filter("n > 0 and doc_id is not null").groupBy("d").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("na0").alias("na0"), F.max("na1").alias("na1")), "nodes")
    tokens = durable(_prefix_tokens(docs, meta, node, rule, bucket_grams), "prefixes")

    star = tokens.groupBy("token").agg(F.min(F.struct("rep", "n")).alias("a"), F.min(F.struct("rep", (-F.col("n")).alias("other"))).alias("most"), F.max("rep").alias("z"))
    # a doc_id on rows with different texts has several sets: the least and the largest size of those that have the n-gram
    star = durable(star.filter("a.rep < z").select("token", F.col("a.rep").alias("a"), F.col("a.n").alias("least"), (-F.col("most.other")).alias("most")), "centres")
    tagged = durable(tokens.join(star, "token").filter("rep <> a"), "tagged")
    alike = (F.col("n") * den >= F.col("least") * num) & (F.col("most") * den >= F.col("n") * num)
    pairs = durable(tagged.filter(alike).groupBy("a", F.col("rep").alias("b")).agg(F.max("n").alias("n")), "pairs")
    sets = durable(_sets_of_marked(docs, node, tagged.select("rep").unionByName(pairs.select(F.col("a").alias("rep"))).distinct(), rule), "grams")

    heavy = pairs.groupBy("a").agg(F.ceil(F.sum("n") / part_grams).alias("parts")).filter("parts > 1")
    dealt = pairs.join(sent_if_small(heavy), "a", "left").select("a", F.pmod(F.xxhash64(F.lit(5), "b"), F.coalesce("parts", F.lit(1))).alias("part"), F.col("b").alias("rep"), F.lit(False).alias("centre"))
    roles = dealt.unionByName(dealt.select("a", "part", F.col("a").alias("rep"), F.lit(True).alias("centre")).distinct())
    stars = roles.join(sets, "rep").select("a", "part", "centre", "rep", "grams").repartition("a", "part").sortWithinPartitions("a", "part")
    links = durable(arrow_map(stars, _verify_stars(rule), "a bigint, b bigint"), "links")
    first = connected_components(links)

    named = lambda x: x.join(first.withColumnsRenamed({"node": "rep", "component": "label"}), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    # a band is a little wider than the ratio of sizes that a link allows, so that linked sets are in one band or in neighbouring ones
    band = F.floor(F.log("n") / (math.log(den / num) + 1e-9)) if num < den else F.col("n")
    rest = named(tagged.select("token", "rep", "n")).withColumn("cell", F.explode(F.array(band, band - 1)))
    open_ = durable(rest.groupBy("token", "cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("rep").alias("c")).filter("lo < hi").select("token", "cell", "c"), "open")
    made = [tokens, star, tagged, pairs, links, open_]
    classes = named(node.select("d", "rep"))
    if open_.limit(1).count():
        place = lambda c: F.xxhash64(c, "cell")  # noqa: E731  two that collide are one group, which costs time and changes nothing
        member = durable(rest.join(open_, ["token", "cell"]).select("cell", "rep", "n", "label", "c").distinct(), "members")
        group = connected_components(member.select(place("c").alias("a"), place("rep").alias("b")))
        inside = member.select(place("rep").alias("node"), "rep", "label", "n").distinct().join(group, "node")
        large = inside.groupBy("component").agg(F.ceil(F.sum("n") / block_grams).alias("blocks")).filter("blocks > 1")
        own = inside.join(sent_if_small(large), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint"))).withColumn("own", F.pmod(F.xxhash64(F.lit(3), "rep"), "blocks"))
        both = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j")))
        tasks = own.select("component", "rep", "label", F.explode(both).alias("pair")).distinct().join(sets, "rep").select("component", "pair.i", "pair.j", "label", "grams")
        found = durable(arrow_map(tasks.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j"), _join_groups(rule), "a bigint, b bigint"), "links")
        second = connected_components(found)
        classes = classes.join(second.withColumnsRenamed({"node": "label", "component": "smaller"}), "label", "left").withColumn("label", F.coalesce("smaller", "label"))
        made += [member, group, found, second]
    classes = durable(classes.select("d", "label"), "classes")
    discard(*made, first, sets, node)
    # a doc_id on rows with different texts stands for one document
    component = F.when(F.col("doc_id").isNotNull(), F.col("label")).alias("component_id")
    some = meta.filter("n > 0").join(classes, "d", "left").select("doc_id", F.col("n").alias("n_shingles"), component)
    return some.unionByName(meta.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90, den=100)
