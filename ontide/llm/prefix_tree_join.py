"""Jaccard self-join of n-gram sets by prefix trees, and the groups that its links make.

A text's set holds the 64-bit hashes of its shingles, of three words by default, in ascending order, which is the same
order for all sets. Where sets meet in a bucket they are stored in a trie with merged edges; a set is joined by
walking the trie from its root, so the overlap with a common beginning is counted once for all
sets below it. A subtree is left when the overlap so far and what the remaining lengths can still
give don't reach what the shortest set below needs, or when lengths differ too much, or when all
below belongs to the set's own group or is compared elsewhere.

How sets find their bucket. Two sets with a Jaccard similarity of at least 0.9 differ in at most a
nineteenth of their joint length, D elements. Hash ranges cut a set into more than D parts, so at
least one part of both is the same; its hash is a key. Empty parts count only for sets that
have so many of them that all equal parts could be empty, by the set's own length. The number of parts belongs to a class of
lengths; sets near the upper end of a class also give the keys of the next. No link can be missed,
and a passage that many texts share makes no key by itself, unlike single shingles. As there are some
parts more than D, and a set shorter than its class allows can differ in fewer elements than D, linked
sets have as many keys of a class in common, less the set's empty parts: a set with fewer keys that
others have too leaves the class.

Order of work: equal sets are one class. Merging rounds put every group's head into the bucket
of its smallest key that other groups have too, in chunks of `chunk` heads, and join there; a
group of many near copies shrinks to a few heads at a cost linear in its size. Then everything
that keys of several groups still hold is joined in full: small families that keys connect in a bucket
each, and the other keys by themselves, the largest group of a key in chunks, each with the
key's other members; sets that share several such keys are compared under the smallest. Only the groups
that links make leave a bucket, never all pairs.

Null and empty texts have the empty set: n_shingles 0, linked with nothing, their own component.
Rows with a null id get their set's size and a null component and link nothing. Repeated rows
share a component. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window, types as T, functions as F

from ontide.llm.common import batch_of, lower_words, map_rows, parts, raw
from ontide.session import stage

# Wider classes of lengths have more parts for short sets, and fewer sets that give keys of two classes. The
# number of keys is least between these, the nearer to the upper one the more linked sets may differ.
LEAST_GROWTH, USUAL_GROWTH = 1.5, 2


@dataclass(frozen=True)
class JoinParams:
    """Two sets of shingles of `width` words link when 100 * intersection >= percent * union."""

    percent: int = 90
    width: int = 3
    chunk: int = 128
    rounds: int = 2


class WordHashes(dict):
    """64-bit hashes of words, `most` of them remembered."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, hashes: WordHashes, width: int) -> np.ndarray:
    """Ascending distinct hashes of the shingles; the whole sequence is one where it is shorter."""
    words = lower_words(text)
    if len(words) < width:
        whole = b"\x00".join([b"%d" % len(words), *words])
        return np.array([xxhash.xxh3_64_intdigest(whole)] if words else [], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    joined = mixed(h[:n])
    for i in range(1, width):
        joined = mixed(joined * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i])
    return np.unique(joined)


class Parts:
    """Keys of a set: the hashes of its parts, for each class of lengths that it can link in."""

    def __init__(self, percent: int):
        self.percent = percent
        # sets that link lie in one class of lengths or in two that follow each other
        self.growth = max(LEAST_GROWTH, 100 / percent, min(USUAL_GROWTH, (100 / percent) ** 3))
        self.bounds = [1]

    def _class_of(self, n: int) -> int:
        while self.bounds[-1] <= n:
            last = self.bounds[-1]
            self.bounds.append(max(last + 1, int(last * self.growth)))
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def differing(self, n: int, longest: int) -> int:
        """The most elements in which a set of `n` can differ from a linked one of up to `longest`."""
        other = min(longest, 100 * n // self.percent)
        return (n + other) * (100 - self.percent) // (100 + self.percent)

    def shape(self, number: int, n: int) -> tuple[int, int]:
        """Parts of a class, and how many of them a set of `n` elements has like a linked one at least."""
        longest = self.bounds[number + 1] - 1
        most = self.differing(longest, longest)
        count = most + 1 + min(3, most) + most // 12
        return count, count - self.differing(n, longest)

    def keys(self, values: np.ndarray) -> list[int]:
        """Keys of all classes. A key's last bit tells its class from the next one."""
        return [key for _, keys, _ in self.classes(values) for key in keys]

    def classes(self, values: np.ndarray) -> list[tuple[int, list[int], int]]:
        """Per class: its number, the set's keys, and how many of them a linked set of the class has too."""
        n = len(values)
        if not n:
            return []
        own = self._class_of(n)
        numbers = [own]
        self._class_of(self.bounds[own + 1])
        if 100 * n >= self.percent * self.bounds[own + 1]:
            numbers.append(own + 1)
        out, weights = [], mixed(values)
        for number in numbers:
            count, alike = self.shape(number, n)
            part = ((values >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
            starts = np.flatnonzero(np.diff(part, prepend=part[:1] - np.uint64(1)))
            sums, present = np.add.reduceat(weights, starts), part[starts]
            empty = count - len(present)
            if empty >= alike:
                every = np.zeros(count, np.uint64)
                every[present.astype(np.int64)] = sums
                sums, present = every, np.arange(count, dtype=np.uint64)
            tag = mixed(present + np.uint64(number << 32) + np.uint64(1))
            marked = mixed(sums ^ tag) & np.uint64(2**64 - 2) | np.uint64(number & 1)
            out.append((number, marked.view(np.int64).tolist(), max(1, alike - empty)))
        return out


class Groups:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


class PrefixTree:
    """Trie of ascending sets with merged edges, over sets of small numbers in lexicographic order."""

    PIECE = 256

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.lengths = [len(s) for s in sets]
        self.held = np.zeros(1 + max(int(s[-1]) for s in sets), bool)
        common = [self._common(sets[i], sets[i + 1]) for i in range(len(sets) - 1)]
        self.root = self._node(0, len(sets), 0, common)

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _node(self, low: int, high: int, depth: int, common: list[int]):
        """(low, high, edge's start, edge's end, shortest, longest, children)."""
        lengths = self.lengths[low:high]
        if high - low == 1:
            return low, high, depth, lengths[0], lengths[0], lengths[0], ()
        end = min(common[low : high - 1])
        cuts = [low, *(i + 1 for i in range(low, high - 1) if common[i] == end), high]
        children = [self._node(a, b, end, common) for a, b in zip(cuts, cuts[1:])]
        return low, high, depth, end, min(lengths), max(lengths), children

    def links(self, at: int, done: int):
        """Sets after position `at` that link with its set, but for those whose bit is set in `done`."""
        probe, n, percent = self.sets[at], self.lengths[at], self.percent
        held = self.held
        held[probe] = True
        stack = [(self.root, 0, 0)]  # node, overlap so far, elements of the probe passed
        while stack:
            node, overlap, passed = stack.pop()
            low, high, start, end, shortest, longest, children = node
            if high <= at + 1 or 100 * longest < percent * n or 100 * n < percent * shortest:
                continue
            first = max(low, at + 1)
            every = (1 << (high - first)) - 1
            if (done >> first) & every == every:
                continue
            # what the shortest set below that may link needs in common
            need = -(-percent * (n + max(shortest, -(-percent * n // 100))) // (100 + percent))
            edge, reached = self.sets[low], start
            while reached < end:
                if overlap + min(n - passed, longest - reached) < need:
                    break
                piece = edge[reached : min(end, reached + self.PIECE)]
                overlap += int(np.count_nonzero(held[piece]))
                passed = int(probe.searchsorted(piece[-1], "right"))
                reached += len(piece)
            else:
                if children:
                    stack += [(child, overlap, passed) for child in children]
                elif 100 * overlap >= percent * (n + self.lengths[low] - overlap):
                    yield low
        held[probe] = False


def join_bucket(
    sets: list[np.ndarray], labels: list[int], percent: int, earlier: list[list[int]] | None = None
) -> list[tuple[int, int]]:
    """(smallest label, other label) of the groups that the links of a bucket's sets make.

    Sets of one label count as linked. `earlier` has each set's keys that come before the
    bucket's: two sets that have one of them in common meet there and aren't compared here.
    """
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    coded = np.split(codes, np.cumsum([len(s) for s in sets])[:-1])
    order = sorted(range(len(sets)), key=lambda i: coded[i].astype(">i4").tobytes())
    tree, groups = PrefixTree([coded[i] for i in order], percent), Groups(len(sets))
    bits: dict[int, int] = {}  # members of a group, by the group's first member
    first: dict[int, int] = {}
    holders: dict[int, int] = {}
    for at, i in enumerate(order):
        head = first.setdefault(labels[i], at)
        groups.join(at, head)
        bits[head] = bits.get(head, 0) | 1 << at
        for key in earlier[i] if earlier else ():
            holders[key] = holders.get(key, 0) | 1 << at
    for at, i in enumerate(order):
        done = bits[groups.find(at)]
        for key in earlier[i] if earlier else ():
            done |= holders[key]
        for other in tree.links(at, done):
            one, two = groups.find(at), groups.find(other)
            if groups.join(one, two):
                bits[min(one, two)] = bits.pop(one) | bits.pop(two)
    smallest: dict[int, int] = {}
    for at, i in enumerate(order):
        head = groups.find(at)
        smallest[head] = min(labels[i], smallest.get(head, labels[i]))
    return sorted({(smallest[groups.find(at)], labels[i]) for at, i in enumerate(order)} - {(x, x) for x in labels})


SIGNED = "doc_id bigint, text_key binary, n bigint, digest binary, keys array<bigint>, needs array<int>"


def signatures(docs: DataFrame, params: JoinParams, id_col: str, text_col: str) -> DataFrame:
    def process():
        hashes, cutter = WordHashes(), Parts(params.percent)

        def rows(batch):
            ids, text_keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc_id, text_key, text in zip(ids, text_keys, raw(batch.column(1))):
                values = shingle_set(text, hashes, params.width)
                digest = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
                keys, needs = [], [1, 1]
                for number, own, need in cutter.classes(values):
                    keys += own
                    needs[number & 1] = need
                yield doc_id, text_key, len(values), digest if len(values) else None, keys, needs

        return rows

    text_key = F.unhex(F.md5(docs[text_col]))
    source = docs.select(docs[id_col].cast("bigint"), docs[text_col], text_key.alias("text_key"))
    return map_rows(source, process, SIGNED)


def bucket_links(members: DataFrame, texts: DataFrame, params: JoinParams) -> DataFrame:
    """(a, b): the smallest label and another one of each group that the links make in a bucket of
    `members` (bucket, chunk, cid, label, keys). `keys` may be null; else they are all live keys of the set.
    """
    fields = parts("a bigint, b bigint")

    def run(batches):
        hashes = WordHashes()
        current, sets, labels, earlier = None, [], [], []

        def links():
            return join_bucket(sets, labels, params.percent, earlier)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            out = []
            for bucket, chunk, label, keys, text in zip(*columns, raw(batch.column(4))):
                if (bucket, chunk) != current:
                    if len(sets) > 1:
                        out += links()
                    current, sets, labels, earlier = (bucket, chunk), [], [], []
                labels.append(label)
                sets.append(shingle_set(text, hashes, params.width))
                earlier.append([key for key in keys or () if key < bucket])
            yield batch_of(out, fields)
        if len(sets) > 1:
            yield batch_of(links(), fields)

    joined = members.join(texts, "cid").select("bucket", "chunk", "label", "keys", "text")
    dealt = joined.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def of_several(members: DataFrame) -> DataFrame:
    """(key, cid) of keys that stand in several rows."""
    several = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return members.join(several.select("key"), "key").select("key", "cid")


def with_enough_keys(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, cid) of sets that share as many keys of a class as linked sets do, by their `needs` in `classes`.

    Linked sets have `need` keys of a class in common or more. So each can go without its `need` - 1 most
    frequent ones, in an order that is the same for all: one of the common keys is left to both.
    """
    odd = F.col("key").bitwiseAND(F.lit(1)).cast("int").alias("odd")
    counts = shared.groupBy("cid", odd).agg(F.count("*").alias("n")).join(classes.select("cid", "needs"), "cid")
    need = F.get("needs", F.col("odd"))
    enough = counts.filter(F.col("n") >= need).select("cid", "odd", need.alias("need"))
    members = shared.select("key", "cid", odd).join(enough, ["cid", "odd"])
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # a window holds the keys of one set
    rank = F.row_number().over(Window.partitionBy("cid", "odd").orderBy(F.desc("n"), "key"))
    ranked = members.join(sizes, "key").withColumn("rank", rank)
    return of_several(ranked.filter("rank >= need").select("key", "cid"))


def one_key_per_membership(shared: DataFrame) -> DataFrame:
    """(key, cid) without keys that hold the same sets as another key: near copies share most of theirs."""
    print_of = shared.groupBy("key").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("cid")).alias("one"),
        F.bit_xor(F.xxhash64("cid", F.lit("two"))).alias("two"),
    )
    kept = print_of.groupBy("n", "one", "two").agg(F.min("key").alias("key"))
    return shared.join(kept.select("key"), "key")


def live_members(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, cid, label) of keys that several groups still share."""
    labelled = shared.join(groups, "cid")
    live = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return labelled.join(live.filter("low < high").select("key"), "key").select("key", "cid", "label")


def in_chunks(members: DataFrame, size: int) -> DataFrame:
    """(bucket, chunk, cid, label, keys) of (key, cid, label): keys in chunks of about `size`."""
    counts = members.groupBy("key").agg(F.count("*").alias("n"))
    chunks = F.ceil(F.col("n") / size)
    return members.join(counts, "key").select(
        F.col("key").alias("bucket"),
        F.pmod(F.xxhash64("cid"), chunks).cast("string").alias("chunk"),
        "cid",
        "label",
        F.lit(None).cast("array<bigint>").alias("keys"),
    )


def in_full(members: DataFrame, size: int) -> DataFrame:
    """(bucket, chunk, cid, label, keys) such that all members of different labels of a key meet.

    The key's largest group is cut into chunks; each meets each chunk of the other members, and
    those meet one another. Other members mostly fit one chunk, so the largest group is sent once.
    Sets that share several keys are compared under the smallest only; for that they carry their keys.
    """
    listed = members.groupBy("cid").agg(F.collect_list("key").alias("keys"))
    groups = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    sizes = groups.groupBy("key").agg(
        F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("total")
    )
    sizes = sizes.select(
        "key",
        F.col("most.label").alias("largest"),
        F.ceil(F.col("most.n") / size).alias("blocks"),
        F.ceil((F.col("total") - F.col("most.n")) / size).alias("rest"),
    )
    dealt = members.join(sizes, "key")
    main = F.col("label") == F.col("largest")
    block = F.pmod(F.xxhash64("cid"), F.when(main, F.col("blocks")).otherwise(F.col("rest")))

    def name(prefix, i, j):
        return F.concat(F.lit(prefix), i.cast("string"), F.lit(":"), j.cast("string"))

    def upto(n):
        return F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)

    of_main = F.transform(upto(F.col("rest")), lambda i: name("m", i, F.col("block")))
    of_rest = F.transform(upto(F.col("blocks")), lambda j: name("m", F.col("block"), j))
    among = F.transform(
        upto(F.col("rest")),
        lambda i: name("r", F.least(i, F.col("block")), F.greatest(i, F.col("block"))),
    )
    chunks = F.when(F.col("main"), of_main).otherwise(
        F.when(F.col("rest") > 1, F.concat(of_rest, among)).otherwise(of_rest)
    )
    return (
        dealt.withColumn("main", main)
        .withColumn("block", block)
        .select(F.col("key").alias("bucket"), F.explode(chunks).alias("chunk"), "cid", "label")
        .join(listed, "cid")
    )


def in_families(members: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(bucket, chunk, cid, label, keys) of families, and the (key, cid, label) that they don't settle.

    A family is what keys connect, as far as two rounds of passing on the smallest set see. A family of up to
    `size` sets is a bucket, to which each set is sent once instead of once for every key. A
    key is settled when all its members are of one such family.
    """
    spread = members.withColumn("family", F.col("cid"))
    for _ in range(2):
        low = spread.groupBy("key").agg(F.min("family").alias("low"))
        own = spread.join(low, "key").groupBy("cid").agg(F.min("low").alias("family"))
        spread = members.join(own, "cid")
    spread = stage(spread)
    sizes = spread.select("family", "cid").distinct().groupBy("family").agg(F.count("*").alias("n"))
    small = sizes.filter(F.col("n") <= size).select("family", F.lit(True).alias("small"))
    keys = spread.groupBy("key").agg(F.min("family").alias("family"), F.max("family").alias("last"))
    settled = keys.filter("family = last").join(small, "family").select("key", "small")
    marked = spread.join(settled, "key", "left")
    families = marked.filter("small").select("family", "cid", "label").distinct()
    buckets = families.select(
        F.col("family").alias("bucket"),
        F.lit("family").alias("chunk"),
        "cid",
        "label",
        F.lit(None).cast("array<bigint>").alias("keys"),
    )
    return buckets, marked.filter("small is null").select("key", "cid", "label")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the edges (a, b).

    Labels sink along the edges and then jump to the label of the label, until none changes.
    """
    both = stage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
    labels = labels.select("node", F.least("node", "root").alias("root"))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("low"))
        sunk = labels.join(around, labels["node"] == around["a"]).select(
            "node", "root", F.least("root", "low").alias("lower")
        )
        jump = sunk.select(F.col("node").alias("via"), F.col("lower").alias("target"))
        moved = stage(
            sunk.join(jump, F.col("lower") == F.col("via")).select(
                "node", F.col("root").alias("old"), F.least("lower", "target").alias("root")
            )
        )
        labels = moved.select("node", "root")
        if moved.filter("root <> old").isEmpty():
            return labels


def merged_groups(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """`groups` (cid, label) after labels became those of `roots` (node, root)."""
    moved = groups.join(roots, groups["label"] == roots["node"], "left")
    return stage(moved.select("cid", F.coalesce("root", "label").alias("label")))


def link_documents(
    docs: DataFrame,
    params: JoinParams = JoinParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    with_heads: bool = False,
) -> DataFrame:
    """doc_id, n_shingles, component_id per row of `docs`; `with_heads` adds the digest of the row's text and that
    of its component's first row, by id and digest, as an id may stand before several texts."""
    signed = stage(signatures(docs, params, id_col, text_col))
    usable = signed.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = usable.groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("needs").alias("needs")
    )
    classes = stage(
        classes.select(
            "digest",
            F.col("first.doc_id").alias("rep"),
            F.col("first.text_key").alias("text_key"),
            "needs",
            F.monotonically_increasing_id().alias("cid"),
        )
    )
    own = usable.select("digest", F.col("doc_id").alias("rep"), "text_key", "keys")
    keys = own.join(classes, ["digest", "rep", "text_key"]).select("cid", F.explode("keys").alias("key"))
    # repeated rows count as several here; the next step drops what only they share
    # staged, so that the shuffle files of the counts have gone when the members move
    several = stage(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    shared = stage(keys.join(several, "key").select("key", "cid").distinct())
    shared = stage(one_key_per_membership(stage(with_enough_keys(shared, classes))))

    needed = shared.select("cid").distinct().join(classes, "cid").select("cid", "rep", "text_key")
    source = docs.select(
        docs[id_col].cast("bigint").alias("rep"),
        F.unhex(F.md5(docs[text_col])).alias("text_key"),
        docs[text_col].alias("text"),
    )
    found = source.join(needed, ["rep", "text_key"]).select("cid", "text")
    texts = stage(found.groupBy("cid").agg(F.first("text").alias("text")))
    # at first every class is a group of its own, and all keys are shared by several
    live = shared.withColumn("label", F.col("cid"))
    groups = texts.select("cid", F.col("cid").alias("label"))
    for number in range(params.rounds):
        if number:
            live = live_members(shared, groups).filter(F.col("cid") == F.col("label"))
        chosen = live.groupBy("cid").agg(F.min("key").alias("key"), F.first("label").alias("label"))
        links = bucket_links(in_chunks(chosen, params.chunk), texts, params)
        # a head is in one bucket only, so a bucket's groups are whole
        groups = merged_groups(groups, links.select(F.col("b").alias("node"), F.col("a").alias("root")))
    live = stage(live_members(shared, groups))
    families, rest = in_families(live, 2 * params.chunk)
    last = families.unionByName(in_full(rest, 2 * params.chunk))
    edges = stage(bucket_links(last, texts, params).distinct())
    if not edges.isEmpty():
        groups = merged_groups(groups, components(edges))

    head = F.struct("rep", "text_key")
    grouped = classes.join(groups, "cid", "left").select(
        "digest", "rep", *(["text_key"] if with_heads else []), F.coalesce("label", "cid").alias("label")
    )
    first = F.min(head) if with_heads else F.struct(F.min("rep").alias("rep"))
    smallest = grouped.groupBy("label").agg(first.alias("head"))
    named_classes = grouped.join(smallest, "label").select(
        "digest",
        F.col("head.rep").alias("component_id"),
        *([F.col("head.text_key").alias("head_key")] if with_heads else []),
    )
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    keys = ["text_key", "head_key"] if with_heads else []
    return signed.select("doc_id", "n", "digest", *keys[:1]).join(named_classes, "digest", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        *keys,
    )


def orderable(data_type: T.DataType) -> bool:
    return not any(kind in data_type.simpleString() for kind in ("map<", "variant"))


def one_per_component(
    docs: DataFrame, params: JoinParams = JoinParams(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The first row of each component by id and text, all columns.

    A row goes only for another one that it equals in id and text or is linked with: rows that share an
    id but not their text are two documents. Of rows with equal id and text the smallest stays, by the
    columns that have an order. Rows without shingles link with nothing; rows with a null id all stay.
    """
    links = link_documents(docs, params, id_col, text_col, with_heads=True)
    none = F.lit(b"")
    own = F.coalesce(F.col("text_key"), none)
    is_head = (F.col("component_id") == F.col("doc_id")) & (own == F.coalesce(F.col("head_key"), none))
    heads = links.filter(is_head | (F.col("n_shingles") == 0)).select(
        F.col("doc_id").alias("head_id"), own.alias("head_text")
    )
    text_key = F.coalesce(F.unhex(F.md5(docs[text_col])), none)
    rows = docs.filter(docs[id_col].isNotNull()).select(
        docs[id_col].cast("bigint").alias("head_id"), text_key.alias("head_text"), F.struct(*docs.columns).alias("row")
    )
    kept = rows.join(heads.distinct(), ["head_id", "head_text"], "left_semi")
    order = F.struct(*(F.col(f"row.`{f.name}`") for f in docs.schema if orderable(f.dataType)))
    single = kept.groupBy("head_id", "head_text").agg(F.min_by("row", order).alias("row")).select("row.*")
    return single.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
