"""Near-duplicates by order MinHash, verified by banded alignment.

A text is its sequence of shingles (words lower-cased in ASCII), each labelled with
its occurrence number. Each hash function picks the ``PICKED`` smallest labelled
shingles and keeps them in text order, so two texts share a sketch when they share
shingles *and* their order. There are 40 sketches of five-word shingles; 32 of
two-word ones, which edits spread over the whole text leave in place; and, for
texts of at most ``SHORT`` words, 16 of single words. Texts that share
a sketch meet at the smallest text of that bucket (a star, never all pairs); a
pair is a link if its edit similarity over words, 1 - distance / longer length,
is at least ``SIMILARITY``, measured by an alignment inside the band that the
limit allows. Classes are the connected components of the links.

Other members of a bucket are compared among themselves where they are of different
classes, also with those that joined the centre, whatever their number: blocks of a bucket meet in
one task, each member with short hashes of its words. Products of word counts rule out most pairs; the
rest is aligned there, the most promising first, skipping pairs whose classes have
been joined meanwhile, and each pair only in one of the buckets it shares. Tasks return
links only. So the choice of the centre does not hide a link, and no pair becomes a row.

Scale: a row for each distinct text, with its word hashes, goes into a table in buckets of
its hash once, and joins leave it there. Buckets of sketches pass sorted after one shuffle, and members leave with their centre.
Pairs of a member and a centre are first compared by word counts (each edit changes
one word, so the counts of similar texts differ by a bounded number), and texts move only
for those that remain. Each node is first compared with the centre it meets most often, with
further ones only where both ends are still in different classes. A step's tables are
deleted when the next have been written.

Cases: null text is an empty text, and empty texts are copies of each other;
texts of fewer words than a shingle are one shingle; repeated rows and null ids are
rows of their text's class; the class id is the smallest id of its rows; an
empty table gives no rows. Texts of equal 64-bit hashes count as equal, in alignments words of equal 32-bit ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomeframe.llm.spans import ascii_words, joined, lower_ascii, mix, slices, span_hashes
from genomeframe.session import bucketed, discard, materialize

SHINGLE, PICKED, SIMILARITY = 5, 2, 0.8
#: Words of a shingle, and sketches of such shingles; the last only for texts of ``SHORT`` words at most.
SKETCHES = ((SHINGLE, 40), (2, 32), (1, 16))
SHORT = 20
#: Members of a bucket in a block; cells of hashed word counts in a table and in a block.
BLOCK, CELLS, FINE_CELLS = 2_000, 256, 1_024
#: Bytes of members that a task deals to blocks at once.
DEALT_BYTES = 16 << 20
#: Counts of a cell that a block's product tells apart; the rest is added to the bound.
LEVELS = 2
#: Edits up to which an alignment follows furthest-reaching points.
FEW_EDITS = 10
_FACTORS = mix(np.arange(1, sum(n for _, n in SKETCHES) + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
_SALTS = mix(_FACTORS + np.uint64(77))
_LAST_ID = (1 << 63) - 1
_TOP = np.uint64((1 << 64) - 1)
_PLACES = mix(np.arange(11, 11 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """A 64-bit hash of every word of every text."""
    data, offsets = joined(texts)
    data = lower_ascii(data)
    starts, ends, first = ascii_words(data, offsets)
    hashes = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    return [hashes[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def labelled_shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of ``size`` words, labelled with how often each came before."""
    n = max(1, len(words) - size + 1)
    if not len(words):
        return words
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(size, len(words))):
        out += words[j : j + n] * _PLACES[j]
    out = mix(out)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    same = ranked[1:] == ranked[:-1]
    if same.any():
        begin = np.flatnonzero(np.append(True, ~same))
        lengths = np.diff(np.append(begin, n))
        occurrence = np.arange(n) - np.repeat(begin, lengths)
        out[order] = mix(ranked + occurrence.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return out


def sketches(words: np.ndarray) -> np.ndarray:
    """One 64-bit value for each hash function (none for a text without words)."""
    made, first = [words[:0]], 0
    for size, n in SKETCHES:
        if len(words) and (size > 1 or len(words) <= SHORT):
            made.append(_sketches(labelled_shingles(words, size), first, first + n))
        first += n
    return np.concatenate(made)


def _sketches(s: np.ndarray, first: int, end: int) -> np.ndarray:
    """The values of the hash functions ``first`` to ``end`` for labelled shingles."""
    step = max(1, 2_000_000 // len(s))
    picked = np.empty((end - first, min(PICKED, len(s))), dtype=np.int64)
    for a in range(first, end, step):
        b = min(a + step, end)
        values = (s[None, :] ^ _SALTS[a:b, None]) * _FACTORS[a:b, None]
        rows = np.arange(b - a)
        for k in range(picked.shape[1]):
            picked[a - first : b - first, k] = at = values.argmin(axis=1)
            values[rows, at] = _TOP
    picked.sort(axis=1)
    out = np.zeros(end - first, dtype=np.uint64)
    for k in range(picked.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + s[picked[:, k]])
    return mix(out + _SALTS[first:end])


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The number of word edits from a to b, or None if it is over ``most``.

    Equal beginnings and ends are cut off first. Up to ``FEW_EDITS`` edits it follows furthest-reaching
    points on the diagonals of the band; beyond, whole columns as bits, since a band that
    wide is no narrower.
    """
    if abs(len(a) - len(b)) > most:
        return None
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        d = len(a) + len(b)
        return d if d <= most else None
    shared = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
    if max(len(a), len(b)) - shared > most:
        return None  # each edit changes one word at most
    x, y = a.tolist(), b.tolist()
    found = _few_edits(x, y, min(most, FEW_EDITS))
    if found is None and most > FEW_EDITS:
        found = _many_edits(x, y)
    return found if found is not None and found <= most else None


def _few_edits(x: list, y: list, most: int) -> int | None:
    """The distance by furthest-reaching points, whose cost is the square of the edits."""
    n, m = len(x), len(y)
    goal = m - n
    if abs(goal) > most:
        return None
    reach = {0: 0}
    i = 0
    while i < n and i < m and x[i] == y[i]:
        i += 1
    reach[0] = i
    if goal == 0 and i >= n:
        return 0
    for d in range(1, most + 1):
        new = {}
        for k in range(max(-d, -n), min(d, m) + 1):
            if abs(goal - k) > most - d:
                continue  # cannot come back to the last diagonal within the band
            i = reach.get(k, -2) + 1
            i = max(i, reach.get(k - 1, -1), reach.get(k + 1, -2) + 1)
            if i < 0:
                continue
            i = min(i, n, m - k)
            j = i + k
            while i < n and j < m and x[i] == y[j]:
                i += 1
                j += 1
            if k == goal and i >= n:
                return d
            new[k] = i
        reach = new
    return None


def _many_edits(x: list, y: list) -> int:
    """The distance with a column of the alignment as bits of whole numbers: a few operations a word."""
    places: dict[int, int] = {}
    for i, word in enumerate(x):
        places[word] = places.get(word, 0) | 1 << i
    full, last = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, distance = full, 0, len(x)
    for word in y:
        match = places.get(word, 0)
        same = (((match & up) + up) ^ up) | match | down
        right_up = down | ~(same | up) & full
        right_down = same & up
        distance += ((right_up & last) != 0) - ((right_down & last) != 0)
        right_up = right_up << 1 | 1
        up = ((right_down << 1) | ~(same | right_up)) & full
        down = same & right_up & full
    return distance


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    if not longer:
        return True
    return edit_distance(a, b, int((1 - least) * longer + 1e-9)) is not None


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


NODE = "node long, size long, words binary, counts binary, sketches array<long>"


def _sketched(docs: DataFrame) -> DataFrame:
    """node (the hash of the text), size, words (their hashes in 32 bits), counts and sketches of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                sizes, words, counts, made = [], [], [], []
                for _, texts in slices(part.column(1).to_pylist()):
                    for w in word_hashes(texts):
                        sizes.append(len(w))
                        words.append(short_hashes(w).tobytes())
                        counts.append(word_counts(w))
                        made.append(sketches(w).view(np.int64))
                columns = [
                    pa.array(sizes, pa.int64()), pa.array(words, pa.binary()), pa.array(counts, pa.binary()),
                    pa.array(made, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns], ["node", "size", "words", "counts", "sketches"]
                )

    text = _text(F.col("text"))
    return docs.select(F.xxhash64(text).alias("node"), text.alias("text")).mapInArrow(run, NODE)


def short_hashes(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(32)).astype("<u4")


def _nodes(docs: DataFrame) -> DataFrame:
    """One row for each distinct text, as a table in buckets of ``node``: joins on it leave it in place."""
    return bucketed(_sketched(docs).dropDuplicates(["node"]), "dedup-nodes", "node")


def _meetings(members: DataFrame) -> DataFrame:
    """(key, node, b): the members of each bucket of two nodes or more, b being the smallest.

    One shuffle: buckets pass sorted, and members leave with the first node of theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = (batch.column(i).to_numpy() for i in (0, 1))
            new = np.append(last is None or key[0] != last, key[1:] != key[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            b = np.where(at < 0, centre, node[at])
            later = np.flatnonzero(~new)
            last, centre = key[-1], b[-1]
            if len(later):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[later]), pa.array(node[later]), pa.array(b[later])], ["key", "node", "b"]
                )

    dealt = members.select("key", "node").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "key long, node long, b long")


def word_counts(words: np.ndarray) -> bytes:
    """How often words fall in each of ``CELLS`` cells, at most 255."""
    cells = (words >> np.uint64(32)).astype(np.int64) % CELLS
    return np.minimum(np.bincount(cells, minlength=CELLS), 255).astype(np.uint8).tobytes()


def may_be_similar(words: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """Whether two texts each can be similar: ``words`` and ``counts`` have two columns.

    An edit changes the counts of two cells by one at most, so the counts of similar texts differ little.
    """
    longer, shorter = words.max(axis=1), words.min(axis=1)
    most = ((1 - least) * longer + 1e-9).astype(np.int64)
    differ = np.abs(counts[:, 0].astype(np.int16) - counts[:, 1]).sum(axis=1, dtype=np.int64)
    return differ <= 2 * most - (longer - shorter)


def _sides(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """a, b, and the named columns of both nodes."""
    for x in "ab":
        own = nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in columns))
        pairs = pairs.join(own, x)
    return pairs.select("a", "b", *(f"{x}_{c}" for x in "ab" for c in columns))


def _verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar; words move only for pairs that word counts allow."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.stack([batch.column(i).to_numpy() for i in (2, 4)], axis=1)
            cells = [np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8) for i in (3, 5)]
            both = np.stack([c.reshape(-1, CELLS) for c in cells], axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(may_be_similar(sizes, both, least)))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sides = (part.column(i).to_pylist() for i in (2, 3))
                keep += [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), least) for x, y in zip(*sides)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    likely = _sides(pairs.select("a", "b"), nodes, "size", "counts").mapInArrow(fit, "a long, b long")
    likely = materialize(likely, "dedup-likely")
    return _sides(likely, nodes, "words").mapInArrow(align, "a long, b long")


def near_in_block(
    words: list[np.ndarray], numbers: np.ndarray, keys: list[frozenset], key: int, least: float
) -> list[tuple[int, int]]:
    """Links (positions) that join classes among members of a bucket, until no two similar ones are apart.

    ``numbers`` has columns class and block; pairs are of different classes and, where there
    are two blocks, of different ones. A pair is left to the smallest bucket that both are in.
    Products of cell counts give the most words that two texts can share; pairs with
    enough of them are aligned, the most promising first, unless links have joined their classes.
    """
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    most = ((1 - least) * sizes + 1e-9).astype(np.int64)
    first = np.searchsorted(sizes, sizes - most)  # the shortest that a longer one can be like
    cells = np.zeros((len(order), FINE_CELLS), dtype=np.int64)
    for row, i in enumerate(order.tolist()):
        cells[row] = np.bincount(words[i].astype(np.int64) % FINE_CELLS, minlength=FINE_CELLS)
    level = np.concatenate([cells > n for n in range(LEVELS)], axis=1).astype(np.float32)
    rest = sizes - level.sum(axis=1).astype(np.int64)
    label, block = numbers[order].T
    across = block.min() != block.max()
    found = []
    step = 256
    for a in range(0, len(order), step):
        b = min(a + step, len(order))
        low = int(first[a])
        shared = (level[a:b] @ level[low:b].T).astype(np.int64) + np.minimum(rest[a:b, None], rest[None, low:b])
        far = label[a:b, None] != label[None, low:b]
        if across:
            far &= block[a:b, None] != block[None, low:b]
        rows, others = np.arange(a, b)[:, None], np.arange(low, b)[None, :]
        far &= (others < rows) & (others >= first[a:b, None])
        far &= sizes[a:b, None] - shared <= most[a:b, None]
        x, y = np.nonzero(far)
        found.append(np.stack([x + a, y + low, shared[x, y] - sizes[x + a]]))
    x, y, less = np.concatenate(found, axis=1)
    group: dict[int, int] = {}

    def root(c: int) -> int:
        while c in group:
            c = group[c]
        return c

    links = []
    for k in np.argsort(-less, kind="stable").tolist():
        i, j = order[x[k]], order[y[k]]
        p, q = root(int(label[x[k]])), root(int(label[y[k]]))
        if p == q or min(keys[i] & keys[j]) != key:
            continue
        if similar(words[i], words[j], least):
            group[max(p, q)] = min(p, q)
            links.append((int(i), int(j)))
    return links


def _links_in_buckets(left: DataFrame, nodes: DataFrame, least: float, bits: int) -> DataFrame:
    """(a, b, key): links between classes among the members of buckets (key, node, node_class, n).

    Each node meets the list of its buckets once, so the join has a row a node whatever the size of a bucket;
    the task then deals it, with ``bits`` of its word hashes, to the pairs of blocks of each bucket that still
    holds several classes. Two blocks of a bucket meet in one task, which aligns there and gives only links. Fewer bits only make texts more alike, so no link is missed.
    """
    kind = f"<u{bits // 8}"
    named = ["key", "low", "high", "node_class", "block", "node", "words", "keys"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def give() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 6, pa.binary(), pa.list_(pa.int64())])]
            return pa.RecordBatch.from_arrays(columns, named)

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = (c.to_pylist() for c in batch.slice(start, 500).columns)
                for node, words, node_class, buckets in zip(*part):
                    short = np.frombuffer(words, "<u4").astype(kind).tobytes()
                    keys = [b["key"] for b in buckets]
                    for b in buckets:
                        blocks = -(-b["n"] // BLOCK)
                        own = node % blocks
                        for other in range(blocks):
                            rows.append((b["key"], min(own, other), max(own, other), node_class, own, node, short, keys))
                            size += len(short) + 8 * len(keys) + 100
                            if size > DEALT_BYTES:
                                yield give()
                                rows, size = [], 0
        if rows:
            yield give()

    members = left.groupBy("node").agg(
        F.first("node_class").alias("node_class"), F.collect_set(F.struct("key", "n")).alias("buckets")
    )
    schema = "key long, low long, high long, node_class long, block long, node long, words binary, keys array<long>"
    dealt = (
        nodes.select("node", "words")
        .join(members, "node")
        .mapInArrow(deal, schema)
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def give() -> Iterator[pa.RecordBatch]:
            numbers = np.array([r[3:5] for r in held], dtype=np.int64)
            if (numbers[:, 0] == numbers[0, 0]).all():
                return
            words = [np.frombuffer(r[6], dtype=kind) for r in held]
            links = near_in_block(words, numbers, [frozenset(r[7]) for r in held], held[0][0], least)
            if links:
                ends = np.array([[held[i][5], held[j][5]] for i, j in links], dtype=np.int64)
                columns = [pa.array(ends.max(axis=1)), pa.array(ends.min(axis=1)), pa.array([held[0][0]] * len(links))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "key"])

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                for row in zip(*(c.to_pylist() for c in batch.slice(start, 500).columns)):
                    if held and held[0][:3] != row[:3]:
                        yield from give()
                        held = []
                    held.append(row)
        if held:
            yield from give()

    return dealt.mapInArrow(run, "a long, b long, key long")


def _links_left(left: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): the links of ``_links_in_buckets`` from 16 bits of the word hashes, each confirmed.

    A link that 16 bits only feign may have hidden others of its bucket; such a
    bucket is searched again with all bits.
    """
    found = materialize(_links_in_buckets(left, nodes, least, 16), "dedup-found")
    sure = materialize(_verified(found, nodes, least), "dedup-sure")
    doubtful = found.join(sure, ["a", "b"], "left_anti").select("key").distinct()
    doubtful = materialize(doubtful, "dedup-doubtful")
    if not doubtful.limit(1).count():
        return sure
    again = left.join(doubtful, "key", "left_semi")
    return sure.union(_links_in_buckets(again, nodes, least, 32).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of the links: the smallest node of each connected component.

    Rounds of the smallest neighbouring label and of following labels, each
    written as a table, until nothing changes.
    """
    both = materialize(
        links.select("a", "b").union(links.select("b", "a")).distinct().toDF("node", "other"), "dedup-links"
    )
    labels = both.groupBy("node").agg(F.least("node", F.min("other")).alias("label"))
    labels = materialize(labels, "dedup-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other")
        best = near.groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(best, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("further"))
        new = materialize(
            step.join(jump, "next", "left").select(
                "node", F.col("label").alias("old"), F.least("next", F.coalesce("further", "next")).alias("label")
            ),
            "dedup-labels",
        )
        changed = new.filter("old != label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _rooted(parents: DataFrame) -> DataFrame:
    """(node, label) from one smaller neighbour (a, b) for each node: the end of its chain.

    Labels are followed by doubling: as many written tables as the binary
    logarithm of the longest chain.
    """
    labels = parents.select(F.col("a").alias("node"), F.col("b").alias("label"))
    while True:
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = materialize(labels.join(further, "label", "left"), "dedup-labels")
        labels = step.select("node", F.coalesce("further", "label").alias("label"))
        if not step.filter("further is not null").limit(1).count():
            return labels


def _labelled(frame: DataFrame, labels: DataFrame, *names: str) -> DataFrame:
    """``frame`` with the class of each named node column (the node itself without links)."""
    for name in names:
        known = labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_class"))
        frame = frame.join(known, name, "left").withColumn(
            f"{name}_class", F.coalesce(f"{name}_class", name)
        )
    return frame


def _joined_classes(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after links between nodes of different classes: the classes are joined."""
    between = _labelled(links, labels, "a", "b").select(
        F.col("a_class").alias("a"), F.col("b_class").alias("b")
    )
    joined = components(between)
    renamed = joined.select(F.col("node").alias("label"), F.col("label").alias("joined"))
    known = labels.join(renamed, "label", "left").select("node", F.coalesce("joined", "label").alias("label"))
    alone = joined.filter("node != label").join(labels, "node", "left_anti")
    return materialize(known.unionByName(alone), "dedup-labels")


def _linked(labels: DataFrame, links: DataFrame) -> DataFrame:
    return _joined_classes(labels, links) if links.limit(1).count() else labels


def _left(meetings: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, node_class, n): the members besides the centre of buckets where these differ in class."""
    left = _labelled(meetings.select("key", "node"), labels, "node")
    mixed = (
        left.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("node_class").alias("low"), F.max("node_class").alias("high"))
        .filter("low < high")
        .select("key", "n")
    )
    return materialize(left.join(mixed, "key").select("key", "node", "node_class", "n"), "dedup-left")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, node, class_id and kept.

    The class id is the smallest id of the class; ``kept`` marks the row (or equal
    rows) that stands for the class.
    """
    nodes = _nodes(docs)
    members = nodes.select("node", F.explode("sketches").alias("key"))
    meetings = materialize(_meetings(members), "dedup-meetings")
    votes = meetings.groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("votes"))
    pairs = materialize(votes, "dedup-pairs")

    best = pairs.groupBy("a").agg(F.max(F.struct("votes", (-F.col("b")).alias("b"))).alias("best"))
    first = best.select("a", (-F.col("best.b")).alias("b"))
    labels = _rooted(materialize(_verified(first, nodes, similarity), "dedup-links"))
    apart = _labelled(pairs.select("a", "b"), labels, "a", "b").filter("a_class != b_class")
    apart = apart.join(first, ["a", "b"], "left_anti")  # these have been compared
    labels = _linked(labels, materialize(_verified(apart, nodes, similarity), "dedup-links"))
    left = _left(meetings, labels)
    discard(meetings, pairs)
    labels = _linked(labels, materialize(_links_left(left, nodes, similarity), "dedup-links"))
    discard(left, nodes)
    text = _text(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"))
    named = _labelled(rows, labels, "node")
    rank = F.struct(F.coalesce("doc_id", F.lit(_LAST_ID)).alias("id"), F.col("node").alias("node"))
    firsts = named.groupBy("node_class").agg(F.min("doc_id").alias("class_id"), F.min(rank).alias("first"))
    return named.join(firsts, "node_class").select(
        "doc_id", "node", "class_id", (rank == F.col("first")).alias("kept")
    )


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class: the one with its smallest id.

    Rows are dropped by a join with those that go, the smaller side.
    """
    found = materialize(classes(docs, similarity), "dedup-classes")
    ids = found.select(F.coalesce("doc_id", F.lit(_LAST_ID)).alias("its_id"), F.col("node").alias("its_node"), "kept")
    several = ids.groupBy("its_id", "its_node").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    several = materialize(several.filter("not kept or n > 1"), "dedup-gone")
    own, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)), F.xxhash64(_text(F.col("text")))
    same = (own == F.col("its_id")) & (text == F.col("its_node"))
    others = docs.join(several.hint("merge"), same, "left_anti")
    # of rows with one id and text that stay one is taken from the few that repeat
    repeated = several.filter("kept and n > 1")
    if not repeated.limit(1).count():
        return others
    return others.unionByName(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
