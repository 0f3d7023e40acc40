"""Exact set-similarity join with a token-group matrix.

Similar sets are put into groups of bounded size. The matrix has a row for each token of a group's union, with the members that
hold the token as bits. A set is a query against whole groups: what it shares with a group's union bounds what it shares
with any member, and only groups whose bound reaches the threshold are opened.

* Which documents can have a partner at all: of any linked pair, each side's first tokens (in hash order) must hold some of the other
  side's. Documents without enough tokens that a different set has among its first ones too are left out before any text moves.
* Groups are runs of neighbours in the order of their smallest hashes, cut at a number of members, whatever the data; pairs inside a group are
  compared at once by one product of its bits.
* Tokens are ordered by the number of groups that hold them, rarest first. A query asks with its first tokens only, as many as a
  link to a set of its size or larger can miss, plus one; a group is listed under the first tokens of its members, with the sizes of queries that can still
  reach the threshold from that place on. So a group that differs from the query by rare tokens never meets it, however
  many frequent ones they share.
* Large families of near copies: for each set one group (that of the most central set it shares a first token with) is opened first, and
  the links found are turned into components. After that, only queries and groups of different components meet.

Every link is confirmed on the full sets. Links inside one component may be missing, so components are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.components import connected_components
from logweave.llm.scratch import stored
from logweave.llm.shingles import sets_of

GROUP = 32  # members of a group, 64 at most: their bits fit a number
GROUP_TOKENS = 1 << 20  # a group is closed beyond this many tokens of all members
QUERIES = 256  # sets compared with one copy of a group

GROUPS = "gid bigint, sids array<bigint>, sizes array<int>, parts array<int>, tokens binary"


def need(one: int | np.ndarray, two: int | np.ndarray, percent: int) -> int | np.ndarray:
    """How many tokens linked sets of these sizes share at least."""
    return -(-percent * (one + two) // (100 + percent))


def covered_first(n: int, percent: int) -> tuple[int, int]:
    """(How many of a set's first tokens are looked at, how many of them any linked set has among its own first tokens)."""

    def spare(size: int) -> int:
        return max(1, (size - -(-percent * size // 100)) // 2)

    missed = n - -(-percent * n // 100)
    return min(n, missed + spare(n)), spare(max(1, -(-percent * n // 100)))


class Group:
    """A group's members side by side: the tokens of their union, and who holds which."""

    def __init__(self, sids: list[int], sizes: list[int], tokens: np.ndarray) -> None:
        self.sids, self.sizes = np.array(sids, np.int64), np.array(sizes, np.int64)
        member = np.repeat(np.arange(len(sids)), self.sizes)
        self.union, place = np.unique(tokens, return_inverse=True)
        self.holds = np.zeros((len(self.union), len(sids)), bool)
        self.holds[place, member] = True

    def bits(self) -> np.ndarray:
        return self.holds @ (np.int64(1) << np.arange(len(self.sids), dtype=np.int64))

    def parts(self, percent: int) -> np.ndarray:
        """For each member the first one that links inside the group lead to."""
        dense = self.holds.astype(np.float32)
        shared = (dense.T @ dense).astype(np.int64)
        linked = 100 * shared >= percent * (self.sizes[:, None] + self.sizes[None, :] - shared)
        part = np.arange(len(self.sids))
        while True:
            lower = np.where(linked, part[None, :], len(part)).min(axis=1)
            if (lower == part).all():
                return part
            part = lower

    def linked_to(self, query: np.ndarray, sid: int, percent: int) -> np.ndarray:
        """Members linked to the set ``query`` of sorted tokens; none are looked at if the union's bound excludes them all."""
        least = need(len(query), self.sizes, percent)
        close = (100 * np.minimum(self.sizes, len(query)) >= percent * np.maximum(self.sizes, len(query))) & (self.sids != sid)
        if not close.any():
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.union, query)
        at = at[(at < len(self.union)) & (self.union[np.minimum(at, len(self.union) - 1)] == query)]
        if len(at) < least[close].min():
            return np.zeros(0, np.int64)
        return np.flatnonzero(close & (self.holds[at].sum(axis=0) >= least))


def _groups(sets: DataFrame, percent: int, group: int) -> DataFrame:
    """Groups of neighbours in the order of their smallest tokens: gid, sids, sizes, parts, tokens (of one member after the other)."""
    ordered = sets.orderBy(F.slice("tokens", 1, 8), "sid").select("sid", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sids, arrays, held, number = [], [], 0, TaskContext.get().partitionId() << 33

        def closed() -> pa.RecordBatch:
            sizes, tokens = [len(a) for a in arrays], np.concatenate(arrays)
            parts = Group(sids, sizes, tokens).parts(percent)
            columns = [pa.array([number], pa.int64()), pa.array([sids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32()))]
            columns += [pa.array([parts.tolist()], pa.list_(pa.int32())), pa.array([tokens.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["gid", "sids", "sizes", "parts", "tokens"])

        for batch in batches:
            values, ends = batch.column(1).flatten().to_numpy(), np.cumsum(batch.column(1).value_lengths().to_numpy())
            for sid, tokens in zip(batch.column(0).to_pylist(), np.split(values, ends[:-1])):
                if len(sids) == group or sids and held + len(tokens) > GROUP_TOKENS:
                    yield closed()
                    sids, arrays, held, number = [], [], 0, number + 1
                sids.append(sid)
                arrays.append(tokens)
                held += len(tokens)
        if sids:
            yield closed()

    return stored(ordered.mapInArrow(run, GROUPS), "groups")


def _matrix(groups: DataFrame) -> DataFrame:
    """The token-group matrix: token, gid, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, sids, sizes, tokens in zip(*(batch.column(i).to_pylist() for i in range(4))):
                group = Group(sids, sizes, np.frombuffer(tokens, np.int64))
                columns = [pa.array(group.union), pa.array(np.full(len(group.union), gid)), pa.array(group.bits())]
                yield pa.RecordBatch.from_arrays(columns, ["token", "gid", "bits"])

    return stored(groups.select("gid", "sids", "sizes", "tokens").mapInArrow(run, "token bigint, gid bigint, bits bigint"), "matrix")


def _entries(groups: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """Each set's first tokens that other groups hold too: token, gid, sid, n, pos (tokens before it, rarest first), asks (it asks with it),
    company (how many groups hold a token of the set, on average).

    Tokens of one group alone come first in the order and can't be met, so they only move the places of the others.
    """
    spread = matrix.groupBy("token").agg(F.count("*").alias("spread")).filter("spread > 1")
    shared = matrix.join(spread, "token").groupBy("gid").agg(F.collect_list(F.struct("spread", "token", "bits")).alias("shared"))
    rows = groups.select("gid", "sids", "sizes").join(shared, "gid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "gid", "sid", "n", "pos", "asks", "company"]
        for batch in batches:
            for i in range(batch.num_rows):
                gid, sids, sizes = (batch.column(k)[i].as_py() for k in range(3))
                fields = batch.column(3)[i].values
                spread, token, bits = (fields.field(k).to_numpy() for k in range(3))
                order = np.lexsort((token, spread))
                spread, token, bits = spread[order], token[order], bits[order]
                for m, (sid, n) in enumerate(zip(sids, sizes)):
                    held = (bits >> m) & 1 == 1
                    mine, company = token[held], spread[held].sum() / n
                    pos = np.arange(n - len(mine), n)
                    first = pos <= n + (-percent * n // 100)  # n - ceil(percent * n / 100)
                    if not first.any():
                        continue
                    mine, pos = mine[first], pos[first]
                    same = [pa.array(np.full(len(mine), v, np.int64)) for v in (gid, sid, n)]
                    asks = pa.array(pos <= n - need(n, n, percent))
                    yield pa.RecordBatch.from_arrays([pa.array(mine), *same, pa.array(pos), asks, pa.array(np.full(len(mine), company))], names)

    out = rows.select("gid", "sids", "sizes", "shared").mapInArrow(run, "token bigint, gid bigint, sid bigint, n bigint, pos bigint, asks boolean, company double")
    return stored(out, "entries")


def _opened(pairs: DataFrame, sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the sets sid and members of the groups gid of ``pairs``, one for each part of a group."""
    counts = pairs.groupBy("gid").agg(F.ceil(F.count("*") / QUERIES).alias("salts"))
    salted = stored(pairs.join(counts, "gid").select("gid", "sid", F.pmod(F.xxhash64("sid"), F.col("salts")).alias("salt")), "salted")
    wanted = salted.select("gid", "salt").distinct()
    whole = wanted.join(groups, "gid").select("gid", "salt", F.lit(True).alias("first"), "sids", "sizes", "parts", "tokens", F.lit(None).cast("array<bigint>").alias("query"))
    none = F.lit(None)
    asking = salted.join(sets, "sid").select(
        "gid", "salt", F.lit(False).alias("first"), F.array("sid").alias("sids"), none.cast("array<int>").alias("sizes"), none.cast("array<int>").alias("parts"),
        none.cast("binary").alias("tokens"), F.col("tokens").alias("query"),
    )
    rows = whole.unionByName(asking).repartition("gid", "salt").sortWithinPartitions("gid", "salt", F.desc("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts = None, None
        for batch in batches:
            left, right = [], []
            for i, first in enumerate(batch.column(2).to_pylist()):
                sids = batch.column(3)[i].as_py()
                if first:
                    group = Group(sids, batch.column(4)[i].as_py(), np.frombuffer(batch.column(6)[i].as_py(), np.int64))
                    parts = np.array(batch.column(5)[i].as_py())
                    continue
                found = group.linked_to(batch.column(7)[i].values.to_numpy(), sids[0], percent)
                for member in found[np.unique(parts[found], return_index=True)[1]]:
                    left.append(sids[0])
                    right.append(int(group.sids[member]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return stored(rows.mapInArrow(run, "a bigint, b bigint"), "opened")


def set_links(sets: DataFrame, percent: int, group: int = GROUP) -> DataFrame:
    """Links (a, b) between sets (sid, tokens: different, sorted) that connect whatever 100 * shared >= ``percent`` * all connects.

    ``sets`` is read several times, so it should be stored; sids are unique and sets not empty. Groups have ``group`` members, 64 at most. The result is stored.
    """
    groups = _groups(sets, percent, group)
    inside = groups.select(F.explode(F.arrays_zip("sids", "parts")).alias("m"), "sids").select(F.col("m.sids").alias("a"), F.expr("sids[m.parts]").alias("b")).filter("a <> b")
    entries = _entries(groups, _matrix(groups), percent)
    asking = entries.filter("asks")
    # The group of the set with the most company, the one with the fewest tokens of its own, stands for all groups of a token; a set asks one of these.
    heads = entries.groupBy("token").agg(F.max(F.struct("company", "gid")).alias("head"), F.min("gid").alias("low"), F.max("gid").alias("high"))
    heads = heads.filter("low < high").select("token", "head")
    star = asking.join(heads, "token").groupBy("sid", "gid").agg(F.max("head").alias("head"))
    star = stored(star.filter("gid <> head.gid").select("sid", F.col("head.gid").alias("gid")), "star")
    links = stored(inside.unionByName(_opened(star, sets, groups, percent)), "links")
    rest = _separate(entries, connected_components(links), percent)
    rest = stored(rest.join(star, ["sid", "gid"], "left_anti"), "rest")
    return stored(links.unionByName(_opened(rest, sets, groups, percent)), "links")


def _separate(entries: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Queries and groups (sid, gid) that share a token both are listed under, can reach the threshold from there on and aren't one component.

    Of each token the component with the most entries is set apart: its queries meet only groups with others, so a family
    that is one component already meets nothing of itself.
    """
    named = entries.join(components.select(F.col("node").alias("sid"), "component"), "sid", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "sid")).drop("company"), "named")
    of = named.groupBy("token", "component").agg(F.count("*").alias("n"), F.min("gid").alias("low"), F.max("gid").alias("high"))
    mixed = of.groupBy("token").agg(
        F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("parts"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    mixed = mixed.filter("parts > 1 and low < high").select("token", "major")
    named = stored(named.join(mixed, "token"), "mixed")
    left = F.col("n") - F.col("pos")  # tokens from this place on
    named = named.withColumn("most", F.floor(left * (100 + percent) / percent) - F.col("n"))  # the largest partner it can reach
    listed = named.withColumn("most", F.least("most", "n")).withColumn("least", F.ceil(F.col("n") * percent / 100)).filter("least <= most")

    def by_group(some: DataFrame) -> DataFrame:
        ends = [F.min("least").alias("least"), F.max("most").alias("upto"), F.min("component").alias("low"), F.max("component").alias("high"), F.max("n").alias("largest")]
        return some.groupBy("token", F.col("gid").alias("other")).agg(*ends)

    def met(queries: DataFrame, groups: DataFrame) -> DataFrame:
        fits = (F.col("n") >= F.col("least")) & (F.col("n") <= F.col("upto")) & (F.col("n") <= F.col("largest"))
        apart = (F.col("gid") != F.col("other")) & ((F.col("component") != F.col("low")) | (F.col("component") != F.col("high")))
        return queries.join(groups, "token").filter(fits & apart).select("sid", F.col("other").alias("gid")).distinct()

    asking = named.filter("asks and most >= n").select("token", "sid", "gid", "n", "component", "major")
    minor = met(asking.filter("component <> major"), by_group(listed))
    major = met(asking.filter("component = major"), by_group(listed.filter("component <> major")))
    return minor.unionByName(major).distinct()


def first_tokens(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, set_key, due, first: the smallest tokens, of which a set that can be linked shares ``due``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, due, first = [], [], [], []
            for tokens in sets_of(batch.column(2), width):
                sizes.append(len(tokens))
                look, share = covered_first(len(tokens), percent) if len(tokens) else (0, 0)
                keys.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
                due.append(share)
                first.append(tokens[:look].view(np.int64))
            columns = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(due, pa.int64()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "n_shingles", "set_key", "due", "first"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, due bigint, first array<bigint>")


def token_sets(texts: DataFrame, width: int) -> DataFrame:
    """Sets (sid, tokens: sorted as signed numbers) of texts (sid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.sort(t.view(np.int64)) for t in sets_of(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.int64()))], ["sid", "tokens"])

    return texts.select("sid", "text").mapInArrow(run, "sid bigint, tokens array<bigint>")


def similarity_join(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents are linked if 100 * shared >= ``percent`` * all of their different shingles of ``width`` words (A-Z lower-cased). A document
    of fewer words has one shingle, its whole sequence; one without words, or with a null text, has none and is linked with nothing.
    component_id is the smallest id that links lead to. Rows of one id are one document with several texts; rows without an
    id are linked with nothing and have a null component. An empty table gives no rows; very long texts are compared whole; other columns are not read.
    Shingles are compared by 64-bit hashes.
    """
    first = first_tokens(docs, width, percent, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    rows = stored(first, "first")
    known = rows.filter("doc_id is not null and set_key is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    same = known.join(classes.filter("n > 1"), "set_key").filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))

    # A token is another set's too if more rows have it than have the same set.
    listed = known.select("row", F.explode("first").alias("token"))
    held = listed.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    met = stored(listed.join(held, "token").groupBy("row", "held").agg(F.count("*").alias("tokens")), "met")
    sized = known.join(classes, "set_key").select("row", "doc_id", "text_hash", "set_key", "due", "n")
    able = met.join(sized, "row").filter("held > n").groupBy("row", "doc_id", "text_hash", "set_key", "due").agg(F.sum("tokens").alias("tokens"))
    able = able.filter("tokens >= due").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash", "row")).alias("s"))
    able = stored(able.select(F.col("s.row").alias("sid"), F.col("s.doc_id").alias("node"), "s.text_hash"), "able")

    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("text"))
    texts = texts.join(able.hint("merge"), (F.col("__id") == F.col("node")) & (F.col("__hash") == F.col("text_hash"))).select("sid", "text")
    sets = stored(token_sets(texts, width), "sets")
    if sets.count() > able.count():  # repeated rows
        sets = stored(sets.dropDuplicates(["sid"]), "sets")
    links = set_links(sets, percent, group)
    named = links.join(able.select(F.col("sid").alias("a"), F.col("node").alias("x")), "a").join(able.select(F.col("sid").alias("b"), F.col("node").alias("y")), "b")
    components = connected_components(named.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same))
    found = rows.join(components, rows["doc_id"] == components["node"], "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
