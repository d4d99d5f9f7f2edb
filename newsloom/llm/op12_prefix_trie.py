"""Prefix trie of conversations in double arrays.

1. A turn is its role and text (null is empty), told apart by 128 bits of hash; text itself is
   never shuffled. Turns of a conversation are ordered by turn, null first; equal numbers by role, then
   by hash. Each conversation c is rebuilt: the first h turns of conversation c - c % 20, then its
   own after the first h; h is crc32 of c, written as a number, modulo 4.
2. Conversations with equal turns are folded to the smallest. Their ids in order give ``ends_sha256``;
   a digest is sequential, so one task reads the ids of one such group, a batch at a time.
3. The others are range-partitioned by their turns. A partition is a prefix shard: it numbers its
   turns densely, packs a double array (a node's child by turn t is slot BASE + t, whose CHECK is the node) and
   walks every conversation through it for counts and smallest members.
4. A node of two shards lies on the first or last path of each. Only such upper nodes are merged globally:
   members add up, and children, leaves and saved tokens count each merged node once.

A rebuilt conversation is one row of 20 bytes a turn; a shard has about ``SHARD_TURNS`` turns.
Rows without a conv_id belong to no conversation. Repeated rows are repeated turns. An empty
table has no node, not even a root, as no conversation is there to name it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import STEP, U, lists, mix, signed, stored

#: Turns of a shard, and first turns that conversations may have from another.
SHARD_TURNS = 1 << 15
SHARED, FAMILY, HEADS = 3, 20, 4
#: Slots tried at once for a node's children; more children than ``MANY`` are not fitted into gaps.
LOOK, MANY = 1 << 10, 64
WORD = r"[^\x20\x09-\x0D]+"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
EMPTY = hashlib.sha256().hexdigest()


def turn_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: structs of two hashes and the number of words."""
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    turn = F.struct(
        F.col("turn").alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("h0"), F.xxhash64(F.lit(1), text, role).alias("h1"),
        F.regexp_count(text, F.lit(WORD)).alias("words"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    # A family's conversations meet on one key once; no second shuffle is needed to rebuild them.
    return rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).repartition("base").groupBy("base", "conv_id").agg(
        F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["h0"].alias("h0"), t["h1"].alias("h1"), t["words"].alias("words"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, keys (two hashes a turn, in one list) and words of every rebuilt conversation."""
    own = stored(turn_hashes(conversations))
    first = own.where("conv_id = base").select("base", F.slice("turns", 1, SHARED).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast(own.schema["turns"].dataType)), F.lit(1), h)
    tail = F.slice("turns", h + 1, F.size("turns"))
    return own.join(first, "base", "left").select("conv_id", F.concat(head, tail).alias("turns")).select(
        "conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["h0"], t["h1"]))).alias("keys"),
        F.transform("turns", lambda t: t["words"]).alias("words"))


def folded(convs: DataFrame) -> DataFrame:
    """conv_id (smallest), n and ends_sha256 of each group of conversations with equal turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def rows(done: list[list]) -> pa.RecordBatch:
            least, n, sha = zip(*((x[1], x[2], x[3].hexdigest()) for x in done), strict=True)
            return pa.record_batch([pa.array(least, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["conv_id", "n", "ends_sha256"])

        for batch in batches:
            done = []
            for f0, f1, conv in zip(*(batch.column(c).to_pylist() for c in ("f0", "f1", "conv_id")), strict=True):
                if now is None or now[0] != (f0, f1):
                    if now:
                        done.append(now)
                    now = [(f0, f1), conv, 1, hashlib.sha256(str(conv).encode())]
                else:
                    now[2] += 1
                    now[3].update(f",{conv}".encode())
            if done:
                yield rows(done)
        if now:
            yield rows([now])

    whole = convs.select(F.xxhash64("keys").alias("f0"), F.xxhash64(F.size("keys"), "keys").alias("f1"), "conv_id")
    return whole.repartition("f0", "f1").sortWithinPartitions("f0", "f1", "conv_id").mapInArrow(run, "conv_id bigint, n bigint, ends_sha256 string")


class DoubleArray:
    """BASE and CHECK over growing slots. Slot 0 is the root; ``check`` is -1 where a slot is free."""

    def __init__(self, size: int):
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.check[0] = 0
        #: The first slot that may be free, and the slot behind all that are taken.
        self.free = self.end = 1

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def _place(self, codes: np.ndarray) -> int:
        """The first slot from which on all codes fall on free slots, looked for ``LOOK`` slots at a time.

        A node of more than ``MANY`` children goes behind all others at once.
        """
        at = self.free if len(codes) <= MANY else self.end
        while True:
            self._grow(at + LOOK + int(codes[-1]) + 1)
            fit = at + np.arange(LOOK)
            for code in codes.tolist() if at < self.end else ():
                fit = fit[self.check[fit + code] < 0]
                if not len(fit):
                    break
            if len(fit):
                return int(fit[0])
            at += LOOK

    def add(self, node: np.ndarray, turn: np.ndarray) -> None:
        """Children of one level: (node, turn) pairs in order, each once."""
        at = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        count = np.diff(np.append(at, len(node)))
        single = at[count == 1]
        # A single child fits any free slot.
        self._grow(self.free + len(node) + 1)
        while len(slots := self.free + np.flatnonzero(self.check[self.free :] < 0)[: len(single)]) < len(single):
            self._grow(len(self.check) + len(single))
        self.base[node[single]] = slots - turn[single]
        self.check[slots] = node[single]
        self.end = max(self.end, int(slots.max(initial=0)) + 1)
        for a, n in zip(at[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            codes = turn[a : a + n] - turn[a]
            begin = self._place(codes)
            self.base[node[a]] = begin - turn[a]
            self.check[begin + codes] = node[a]
            self.end = max(self.end, begin + int(codes[-1]) + 1)
        taken = self.check[self.free :] >= 0
        self.free += int(np.argmin(taken)) if not taken.all() else len(taken)

    def step(self, node: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The child of each node by a turn; -1 where CHECK names another parent."""
        slot = self.base[node] + turn
        ok = (slot > 0) & (slot < len(self.check))
        slot = np.where(ok, slot, 0)
        return np.where(ok & (self.check[slot] == node), slot, -1)


def dense(keys: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Numbers 0, 1, ... of the turns, in order of the level at which they first occur; so children lie close."""
    order = np.lexsort((np.arange(len(keys)), depth, keys[:, 1], keys[:, 0]))
    k = keys[order]
    new = np.append(True, (k[1:] != k[:-1]).any(axis=1)) if len(k) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    first = order[new]
    rank = np.empty(len(first), np.int64)
    rank[np.lexsort((first, depth[first]))] = np.arange(len(first))
    out = np.empty(len(keys), np.int64)
    out[order] = rank[group]
    return out


def shard_nodes(conv: np.ndarray, n: np.ndarray, ends: pa.Array, size: np.ndarray, keys: np.ndarray, words: np.ndarray) -> pa.Table:
    """All nodes of a shard's conversations, which come in the order of their turns.

    ``shared`` nodes lie on the path of the first or the last one: other shards may have them too.
    Their counts are of this shard, and of children, leaves and tokens below them those that are not shared.
    """
    first = np.append(0, np.cumsum(size))
    depth = np.arange(first[-1]) - np.repeat(first[:-1], size)
    turn = dense(keys, depth)
    trie = DoubleArray(2 * len(turn) + 2)
    # Packing, level by level: the pairs of a node and a turn below it.
    state = np.zeros(len(conv), np.int64)
    for d in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > d)
        pair = np.unique(np.column_stack([state[live], turn[first[live] + d]]), axis=0)
        trie.add(pair[:, 0], pair[:, 1])
        state[live] = trie.step(state[live], turn[first[live] + d])
    # Traversal: every conversation from the root down.
    slots = len(trie.check)
    level, own, least = np.full(slots, -1, np.int64), np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max)
    key, cost, shared, end = np.zeros((slots, 2), np.uint64), np.zeros(slots, np.int64), np.zeros(slots, bool), np.full(slots, -1, np.int64)
    state = np.zeros(len(conv), np.int64)
    for d in range(int(size.max(initial=0)) + 1):
        live = np.flatnonzero(size >= d)
        if d:
            at = first[live] + d - 1
            parent = state[live]
            state[live] = trie.step(parent, turn[at])
            key[state[live]] = mix(mix(key[parent] + STEP) + keys[at])
            cost[state[live]] = words[at]
        here = state[live]
        level[here] = d
        np.add.at(own, here, n[live])
        np.minimum.at(least, here, conv[live])
        shared[here[(live == 0) | (live == len(conv) - 1)]] = True
        done = live[size[live] == d]
        end[state[done]] = done
    nodes = np.flatnonzero(level >= 0)
    nodes = nodes[np.argsort(-level[nodes], kind="stable")]
    parent = trie.check[nodes]
    children, leaves, saved = (np.zeros(slots, np.int64) for _ in range(3))
    # From the leaves up; levels of deeper nodes are whole before they are added to their parents.
    cuts = np.flatnonzero(np.append(True, np.diff(level[nodes]) != 0)) if len(nodes) else []
    for a, b in zip(cuts, [*cuts[1:], len(nodes)], strict=True):
        x = nodes[a:b]
        inner = x[~shared[x]]
        leaves[inner[children[inner] == 0]] = 1
        saved[inner] += (own[inner] - 1) * cost[inner]
        inner = inner[level[inner] > 0]
        up = trie.check[inner]
        np.add.at(children, up, 1)
        np.add.at(leaves, up, leaves[inner])
        np.add.at(saved, up, saved[inner])
    at = end[nodes]
    sha = ends.take(pa.array(np.where(at < 0, 0, at), pa.int64(), mask=at < 0))
    top = level[nodes] == 0
    pkey = key[parent]
    return pa.table({
        "conv_id": least[nodes], "depth": level[nodes], "parent_conv_id": pa.array(least[parent], mask=top | shared[parent]),
        "n_convs": own[nodes], "n_children": children[nodes], "n_leaves": leaves[nodes], "saved_tokens": saved[nodes],
        "ends_sha256": sha, "words": cost[nodes], "shared": shared[nodes], "k0": signed(key[nodes, 0].copy()), "k1": signed(key[nodes, 1].copy()),
        "p0": pa.array(signed(pkey[:, 0].copy()), mask=top), "p1": pa.array(signed(pkey[:, 1].copy()), mask=top),
    })


NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
    "ends_sha256 string, words bigint, shared boolean, k0 bigint, k1 bigint, p0 bigint, p1 bigint, shard int"
)


def shards(convs: DataFrame, shard_turns: int) -> DataFrame:
    """The nodes of every prefix shard, from folded conversations (conv_id, n, ends_sha256, keys, words)."""
    turns = convs.agg(F.sum(F.size("words"))).first()[0] or 0
    ranges = convs.repartitionByRange(max(1, -(-turns // shard_turns)), "keys").sortWithinPartitions("keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        flat = {c: table.column(c).combine_chunks().flatten().to_numpy() for c in ("keys", "words")}
        size = np.diff(table.column("words").combine_chunks().offsets.to_numpy()).astype(np.int64)
        out = shard_nodes(
            table.column("conv_id").to_numpy(), table.column("n").to_numpy(), table.column("ends_sha256").combine_chunks(), size,
            flat["keys"].view(np.uint64).reshape(-1, 2), flat["words"].astype(np.int64))
        yield from out.append_column("shard", pa.array(np.full(len(out), table.column("shard")[0].as_py(), np.int32))).to_batches(max_chunksize=1 << 14)

    return ranges.withColumn("shard", F.spark_partition_id()).mapInArrow(run, NODES)


def _below(table: pa.Table) -> pa.Table:
    """Leaves and tokens below each shared node of a shard, its own included, as far as the shard counts them."""
    rows = sorted(table.to_pylist(), key=lambda r: -r["depth"])
    total = {(r["k0"], r["k1"]): [r["n_leaves"], r["saved_tokens"]] for r in rows}
    for r in rows:
        up = total.get((r["p0"], r["p1"]))
        if up and r["depth"]:
            own = total[r["k0"], r["k1"]]
            up[0] += own[0]
            up[1] += own[1]
    return pa.table({
        "k0": pa.array([r["k0"] for r in rows], pa.int64()), "k1": pa.array([r["k1"] for r in rows], pa.int64()),
        "n_leaves": pa.array([total[r["k0"], r["k1"]][0] for r in rows], pa.int64()),
        "saved_tokens": pa.array([total[r["k0"], r["k1"]][1] for r in rows], pa.int64()),
    })


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node, with the columns ``NODE``."""
    convs = stored(rebuilt(conversations))
    groups = folded(convs)
    nodes = stored(shards(stored(convs.join(groups, "conv_id").select("conv_id", "n", "ends_sha256", "keys", "words")), shard_turns))
    upper = nodes.where("shared")
    merged = stored(upper.groupBy("k0", "k1").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.max("words").alias("words"), F.max("ends_sha256").alias("ends_sha256"), F.max("p0").alias("p0"), F.max("p1").alias("p1"),
        F.min("shard").alias("shard")))
    # Merged nodes under merged ones are children once, however many shards hold them.
    own = merged.where("depth > 0").groupBy("p0", "p1").agg(F.count(F.lit(1)).alias("more")).select(F.col("p0").alias("k0"), F.col("p1").alias("k1"), "more")
    merged = stored(merged.join(own, ["k0", "k1"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"))
    # One shard counts a merged node itself; each adds what hangs below it there.
    once = merged.select(
        "k0", "k1", "shard", (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saving"))
    zero = F.lit(0).cast("bigint")
    below = (
        upper.select("k0", "k1", "p0", "p1", "depth", "shard", "n_leaves", "saved_tokens").join(once, ["k0", "k1", "shard"], "left")
        .select("k0", "k1", "p0", "p1", "depth", "shard", (F.col("n_leaves") + F.coalesce("leaf", zero)).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("saving", zero)).alias("saved_tokens"))
        .groupBy("shard").applyInArrow(_below, "k0 bigint, k1 bigint, n_leaves bigint, saved_tokens bigint")
        .groupBy("k0", "k1").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    )
    names = merged.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    sha = F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    top = merged.join(below, ["k0", "k1"]).join(names, ["p0", "p1"], "left").withColumn("ends_sha256", sha).select(*NODE)
    # Children of a merged node get its smallest member by shard, so that no node's children are one key.
    inner = nodes.where("not shared").withColumn("ends_sha256", sha)
    known = inner.where("parent_conv_id is not null").select(*NODE)
    by_shard = upper.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), "shard").join(names, ["p0", "p1"])
    hung = inner.where("parent_conv_id is null").drop("parent_conv_id").join(by_shard, ["shard", "p0", "p1"]).select(*NODE)
    return top.unionByName(known).unionByName(hung)
