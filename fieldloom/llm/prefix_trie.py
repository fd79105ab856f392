"""Prefix trie over conversations with a count-min screen (operator 13).

A node is a distinct sequence of first turns.  Its key is a polynomial of the
turns' digests modulo the prime 2**61 - 1, at two points, so a prefix's key can be put together
from pieces: no conversation is ever gathered in one row or task.

 1. Turns become narrow rows (digest, words) and are sorted by range over
    (conversation, turn); a conversation may span many tasks.  Each task runs the
    polynomial along its rows; what a conversation brings from the tasks before is
    one small row per task, folded on the driver and applied in a second pass.
 2. Rebuilding puts the head of another conversation before the own turns; for
    keys this is one correction per conversation, added to every row.
 3. Count-min screen: two rows of slots count the prefix keys.  A key whose
    estimate is one proves that its node has a single member, so its row of the trie
    is emitted where it is, without a shuffle.  The screen holds one bit a
    slot (counted more than once), at most ``2 * MAX_SLOTS`` bits, broadcast.
 4. Rows that may be shared are grouped exactly, sums and minima pre-aggregated
    in every task.  Sums over a subtree need no walk of the trie: the members of a
    node carry them.  A conversation stands for a node if it is its smallest
    member, and does so for all deeper ones too; so a member adds to the node the
    words of its turns from there up to the first node that it stands for, and
    one leaf if it stands for the childless node that it ends in.

Scale: past ``MAX_SLOTS`` the screen proves fewer singletons and more rows are
grouped, with the same result.  Lists of ids that end in a node are hashed
from ordered pieces of up to ``PIECE`` ids made in parallel.

Defined cases: rows with NULL conv_id are left out; NULL role or text is empty;
equal turn numbers of a conversation are ordered by the first ``TIE`` characters
of role and of text, then by digest; repeated rows are turns of their own; an empty table
has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import WORD, release, stored
from fieldloom.sources.tables import table

PRIME = (1 << 61) - 1
POINTS = (0x0123456789ABCDE5, 0x0FEDCBA987654321)  # both below PRIME
TIE = 32
HEADS = 3                  # a rebuilt conversation starts with up to so many turns of another
GROUP = 20
SLOTS_PER_PREFIX = 8
MIN_SLOTS, MAX_SLOTS = 1 << 16, 1 << 26
PIECE = 2048
NOTHING = hashlib.sha256(b"").hexdigest()


def _narrow(conversations: DataFrame) -> DataFrame:
    """conv_id, the columns that order a conversation, two digests of the turn and its words."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn"), F.substring(role, 1, TIE).alias("_role"), F.substring(text, 1, TIE).alias("_text"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("w"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("_digest"))
    part = lambda start: F.conv(F.substring("_digest", start, 15), 16, 10).cast("long")
    return rows.select("*", part(1).alias("x1"), part(16).alias("x2"))


_RUN = "conv_id long, part int, first boolean, i long, w long, words long, g1 long, g2 long, p1 long, p2 long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The polynomials and words of each conversation's run within the task, up to every row and before it."""
    conv, first, i, words, g1, g2 = None, True, 0, 0, 0, 0
    b1, b2 = POINTS
    for b in batches:
        c, part, w, x1, x2 = (b.column(k).to_pylist() for k in ("conv_id", "part", "w", "x1", "x2"))
        out: list[list] = [[] for _ in range(7)]
        for k in range(b.num_rows):
            if c[k] != conv:
                first, conv, i, words, g1, g2 = conv is None, c[k], 0, 0, 0, 0
            p1, p2 = g1, g2
            g1, g2 = (g1 * b1 + x1[k] + 1) % PRIME, (g2 * b2 + x2[k] + 1) % PRIME
            i, words = i + 1, words + w[k]
            for o, v in zip(out, (first, i, words, g1, g2, p1, p2)):
                o.append(v)
        longs = [pa.array(o, pa.int64()) for o in out[1:]]
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), b.column("part"), pa.array(out[0], pa.bool_()), longs[0], b.column("w"), *longs[1:]],
            names=["conv_id", "part", "first", "i", "w", "words", "g1", "g2", "p1", "p2"])


def _carried(runs: DataFrame) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(conversation, task) -> turns, words and polynomials of the tasks before.

    Only a task's first run can go on with an earlier task's last one, so at most
    two runs of each task are looked at.
    """
    spans = runs.where("first").select("conv_id").distinct()
    ends = runs.join(spans, "conv_id").groupBy("conv_id", "part").agg(
        F.max(F.struct("i", "words", "g1", "g2")).alias("e")).select("conv_id", "part", "e.*")
    out, last, held = {}, None, (0, 0, 0, 0)
    for r in sorted(ends.collect(), key=lambda r: (r.conv_id, r.part)):
        held = held if r.conv_id == last else (0, 0, 0, 0)
        if held[0]:
            out[r.conv_id, r.part] = held
        last = r.conv_id
        held = (held[0] + r.i, held[1] + r.words,
                *((h * pow(b, r.i, PRIME) + g) % PRIME for h, b, g in zip(held[2:], POINTS, (r.g1, r.g2))))
    return out


def _joined(runs: DataFrame, carried: dict) -> DataFrame:
    """(conv_id, k, w, words, g1, g2, p1, p2): place, words and keys over the whole conversation."""
    if not carried:
        return runs.withColumnRenamed("i", "k").drop("part", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in b.schema.names}
            for at, (c, p) in enumerate(zip(cols["conv_id"], cols["part"])):
                if cols["first"][at] and (held := carried.get((c, p))):
                    i = cols["i"][at]
                    for g, q, h, base in zip(("g1", "g2"), ("p1", "p2"), held[2:], POINTS):
                        before = h * pow(base, i - 1, PRIME)
                        cols[g][at] = (cols[g][at] + before * base) % PRIME
                        cols[q][at] = (cols[q][at] + before) % PRIME
                    cols["i"][at], cols["words"][at] = i + held[0], cols["words"][at] + held[1]
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], pa.int64()) for n in ("conv_id", "i", "w", "words", "g1", "g2", "p1", "p2")],
                                             names=["conv_id", "k", "w", "words", "g1", "g2", "p1", "p2"])

    return runs.mapInArrow(run, "conv_id long, k long, w long, words long, g1 long, g2 long, p1 long, p2 long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Each turn's place k in its conversation (from 1), words up to it, and keys of the prefixes with and without it."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("_role"), F.col("_text"), F.col("_digest")]
    rows = _narrow(conversations).repartitionByRange(*order).sortWithinPartitions(*order)
    runs = stored(rows.select("conv_id", F.spark_partition_id().alias("part"), "w", "x1", "x2").mapInArrow(_runs, _RUN), "trie-runs")
    carried = _carried(runs)
    if not carried:
        return _joined(runs, carried)
    turns = stored(_joined(runs, carried), "trie-turns")
    release(conversations.sparkSession, runs)
    return turns


def _heads(turns: DataFrame) -> DataFrame:
    """One row a conversation: its length and its first turns."""
    early = F.when(F.col("k") <= HEADS, F.struct("k", "w", "words", "g1", "g2", "p1", "p2"))
    return turns.groupBy("conv_id").agg(F.max("k").alias("n"), F.collect_list(early).alias("head")) \
        .withColumn("head", F.array_sort("head"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, n, head, shift): per conversation its rebuilt length, the turns it borrows, and the correction of its own keys.

    ``shift`` holds the number of own turns given up (``own``), borrowed (``got``), the change of words, and the
    change of both polynomials at the place where the own turns go on.
    """
    heads = _heads(turns)
    other = heads.select(F.col("conv_id").alias("_of"), F.col("head").alias("_head")).where(F.col("_of") % GROUP == 0)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    rows = heads.withColumn("_h", h).join(other, (F.col("conv_id") - F.col("conv_id") % GROUP) == F.col("_of"), "left")
    rows = rows.withColumn("_got", F.slice(F.coalesce("_head", F.array().cast("array<struct<k:bigint,w:bigint,words:bigint,g1:bigint,g2:bigint,p1:bigint,p2:bigint>>")), F.lit(1), F.col("_h")))
    rows = rows.withColumn("_own", F.least("_h", "n"))
    last = lambda a, size, field: F.coalesce(F.try_element_at(a, F.greatest(size, F.lit(1)).cast("int"))[field], F.lit(0))

    def change(field: str) -> Column:
        got = F.when(F.size("_got") > 0, last(F.col("_got"), F.size("_got"), field)).otherwise(0)
        own = F.when(F.col("_own") > 0, last(F.col("head"), F.col("_own"), field)).otherwise(0)
        return got - own

    mod = lambda c: F.pmod(c, F.lit(PRIME))
    shift = F.struct(F.col("_own").alias("own"), F.size("_got").cast("long").alias("got"), change("words").alias("words"),
                     mod(change("g1")).alias("d1"), mod(change("g2")).alias("d2"))
    return rows.select("conv_id", (F.size("_got") + F.col("n") - F.col("_own")).alias("n"), F.col("_got").alias("head"), shift.alias("shift"))


_PREFIX = "conv_id long, n long, depth long, w long, before long, k1 long, k2 long, p1 long, p2 long"


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own turns after the ones given up, with the keys that the borrowed head gives them."""
    for b in batches:
        cols = {n: b.column(n).to_pylist() for n in b.schema.names}
        keys: list[list[int]] = []
        for d, g, p, base in (("d1", "g1", "p1", POINTS[0]), ("d2", "g2", "p2", POINTS[1])):
            here, before = [], []
            for delta, k, own, x, y in zip(cols[d], cols["k"], cols["own"], cols[g], cols[p]):
                if delta:
                    turn = delta * pow(base, k - 1 - own, PRIME)
                    x, y = (x + turn * base) % PRIME, (y + turn) % PRIME
                here.append(x)
                before.append(y)
            keys += [here, before]
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), b.column("n"), b.column("depth"), b.column("w"), b.column("before"),
             *(pa.array(keys[i], pa.int64()) for i in (0, 2, 1, 3))],
            names=["conv_id", "n", "depth", "w", "before", "k1", "k2", "p1", "p2"])


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each prefix of at least one turn of each rebuilt conversation."""
    own = turns.join(convs.select("conv_id", "n", "shift.own", "shift.got", F.col("shift.words").alias("_words"), "shift.d1", "shift.d2"), "conv_id") \
        .where(F.col("k") > F.col("own"))
    own = own.select("conv_id", "n", (F.col("k") - F.col("own") + F.col("got")).alias("depth"), "w",
                     (F.col("words") - F.col("w") + F.col("_words")).alias("before"), "k", "own", "g1", "g2", "p1", "p2", "d1", "d2")
    borrowed = convs.select("conv_id", "n", F.explode("head").alias("t")).select(
        "conv_id", "n", F.col("t.k").alias("depth"), "t.w", (F.col("t.words") - F.col("t.w")).alias("before"),
        F.col("t.g1").alias("k1"), F.col("t.g2").alias("k2"), "t.p1", "t.p2")
    return own.mapInArrow(_corrected, _PREFIX).unionByName(borrowed)


class Screen:
    """Count-min screen of prefix keys: which slots were counted more than once."""

    def __init__(self, rows: DataFrame, n: int):
        self.slots = MIN_SLOTS
        while self.slots < min(MAX_SLOTS, SLOTS_PER_PREFIX * n):
            self.slots *= 2
        slot = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), self._slot(r, "k1", "k2", F.col("depth")).alias("s")) for r in (0, 1)]))
        counted = rows.select(slot.alias("_")).groupBy("_.r", "_.s").count().where("count > 1")
        bits = counted.groupBy("r", F.shiftright("s", 6).alias("word")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("s", F.lit(64)).cast("int"))).alias("bits"))
        self.bits = stored(bits, "trie-screen")

    def _slot(self, r: int, k1: str, k2: str, depth: Column) -> Column:
        return F.xxhash64(F.lit(r), F.col(k1), F.col(k2), depth).bitwiseAND(F.lit(self.slots - 1))

    def mark(self, rows: DataFrame, name: str, k1: str, k2: str, depth: Column) -> DataFrame:
        """``rows`` with the boolean ``name``: the estimate is above one."""
        for r in (0, 1):  # at most MAX_SLOTS / 64 rows of two longs
            words = F.broadcast(self.bits.where(F.col("r") == r).select(F.col("word").alias(f"_w{r}"), F.col("bits").alias(f"_b{r}")))
            s = self._slot(r, k1, k2, depth)
            rows = rows.withColumn(f"_s{r}", s).join(words, F.shiftright(f"_s{r}", 6) == F.col(f"_w{r}"), "left")
        hit = [F.coalesce(F.getbit(f"_b{r}", F.pmod(f"_s{r}", F.lit(64)).cast("int")) == 1, F.lit(False)) for r in (0, 1)]
        return rows.withColumn(name, hit[0] & hit[1]).drop(*[f"_{c}{r}" for c in "swb" for r in (0, 1)])


def _listed(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): the hash of the ascending list of ids that end in each node.

    Ids are sorted by range, so that a node with very many is shared by tasks, which
    join pieces of the list; one task per node then hashes its pieces in order.
    """
    key = ["depth", "k1", "k2"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []
        schema = ["depth", "k1", "k2", "start", "piece"]

        def made() -> pa.RecordBatch:
            rows = list(zip(*out)) or [()] * 5
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:4]), pa.array(rows[4], pa.string())], names=schema)

        for b in batches:
            for *node, c in zip(*(b.column(n).to_pylist() for n in [*key, "conv_id"])):
                if held and (node != at or len(held) >= PIECE):
                    out.append((*at, held[0], ",".join(map(str, held))))
                    held = []
                at = node
                held.append(c)
            yield made()
            out = []
        if held:
            out.append((*at, held[0], ",".join(map(str, held))))
            yield made()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []

        def made() -> pa.RecordBatch:
            rows = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.string())],
                                              names=[*key, "ends_sha256"])

        for b in batches:
            for *node, piece in zip(*(b.column(n).to_pylist() for n in [*key, "piece"])):
                if node != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = node, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield made()
            out = []
        if at is not None:
            out.append((*at, state.hexdigest()))
            yield made()

    order = [*key, "conv_id"]
    listed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order) \
        .mapInArrow(pieces, "depth long, k1 long, k2 long, start long, piece string")
    return listed.repartition(*key).sortWithinPartitions(*key, "start") \
        .mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: ``COLUMNS``."""
    spark = conversations.sparkSession
    turns = ordered_turns(conversations)
    convs = stored(rebuilt(turns), "trie-convs")
    every = convs.agg(F.min("conv_id").alias("first"), F.count("*").alias("n"), F.sum("n").alias("prefixes")).first()
    rows = stored(prefixes(turns, convs), "trie-prefixes")
    screen = Screen(rows, every["prefixes"] or 0)
    rows = screen.mark(rows, "shared", "k1", "k2", F.col("depth"))
    rows = screen.mark(rows, "parent_shared", "p1", "p2", F.col("depth") - 1)
    rows = rows.withColumn("last", F.col("depth") == F.col("n"))
    node, up = ["depth", "k1", "k2"], ["_depth", "_p1", "_p2"]
    maybe = stored(rows.where("shared"), "trie-shared")
    tails = rows.where("not shared")

    # exact groups of what may be shared
    smallest = maybe.groupBy(*node).agg(F.min("conv_id").alias("_first"), F.count("*").alias("_n"), F.sum(F.col("last").cast("long")).alias("_ends"))
    stands = F.col("conv_id") == F.col("_first")
    marks = maybe.join(smallest, node).groupBy("conv_id").agg(
        F.sum(F.when(~stands, F.col("w")).otherwise(0)).alias("_alone"),
        F.when(F.max("last"), F.max(F.col("last") & stands & (F.col("_n") == F.col("_ends")))).otherwise(True).alias("_leaf"))
    shared = maybe.join(marks, "conv_id").groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("w").alias("w"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.sum(F.col("last").cast("long")).alias("n_ends"),
        F.min(F.when(F.col("last"), F.col("conv_id"))).alias("_end"), F.sum(F.col("_leaf").cast("long")).alias("n_leaves"),
        F.sum(F.greatest(F.col("_alone") - F.col("before"), F.lit(0))).alias("saved_tokens"))
    shared = stored(shared, "trie-nodes")

    # children, parents, ends
    edge = [(F.col("depth") - 1).alias("_depth"), F.col("p1").alias("_p1"), F.col("p2").alias("_p2")]
    children = shared.select(*edge).unionByName(tails.where("parent_shared").select(*edge)).groupBy(*up).agg(F.count("*").alias("n_children"))
    above = shared.select(F.col("depth").alias("_depth"), F.col("k1").alias("_p1"), F.col("k2").alias("_p2"), F.col("conv_id").alias("_above"))
    first = F.lit(every["first"]).cast("long")

    def with_parent(x: DataFrame) -> DataFrame:
        on = [F.col("depth") - 1 == F.col("_depth"), F.col("p1") == F.col("_p1"), F.col("p2") == F.col("_p2")]
        parent = F.when(F.col("depth") == 1, first).otherwise(F.coalesce("_above", "conv_id"))  # proven single: its only member
        return x.join(above, on, "left").withColumn("parent_conv_id", parent).drop(*up)

    several = shared.where("n_ends > 1").select(*[F.col(c).alias(f"_{c}") for c in node])
    ending = maybe.where("last").join(several, [F.col(c) == F.col(f"_{c}") for c in node]).select(*node, "conv_id")
    bare = convs.where("n = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    lists = stored(_listed(ending.unionByName(bare)), "trie-ends")

    single = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256)
    nodes = with_parent(shared).join(children, [F.col("depth") == F.col("_depth"), F.col("k1") == F.col("_p1"), F.col("k2") == F.col("_p2")], "left").drop(*up)
    nodes = nodes.join(lists, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn(
        "ends_sha256", F.when(F.col("n_ends") == 0, NOTHING).when(F.col("n_ends") == 1, single("_end")).otherwise(F.col("ends_sha256")))
    tail = {"n_convs": F.lit(1).cast("long"), "n_children": (~F.col("last")).cast("long"), "n_leaves": F.lit(1).cast("long"),
            "saved_tokens": F.lit(0).cast("long"), "ends_sha256": F.when(F.col("last"), single("conv_id")).otherwise(NOTHING)}
    heads = with_parent(tails.where("parent_shared or depth = 1")).withColumns(tail)
    rest = tails.where("not parent_shared and depth > 1").withColumn("parent_conv_id", F.col("conv_id")).withColumns(tail)

    top = shared.agg(F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("c"), F.sum(F.when(F.col("n_convs") == F.col("n_ends"), 1).otherwise(0)).alias("l"),
                     F.sum((F.col("n_convs") - 1) * F.col("w")).alias("s")).first()
    ends = tails.agg(F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("c"), F.sum(F.col("last").cast("long")).alias("l")).first()
    n_children, leaves = (top["c"] or 0) + (ends["c"] or 0), (top["l"] or 0) + (ends["l"] or 0)
    root = spark.range(1 if every["n"] else 0).select(
        first.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(every["n"]).cast("long").alias("n_convs"),
        F.lit(n_children).cast("long").alias("n_children"), F.lit(leaves if n_children else 1).cast("long").alias("n_leaves"),
        F.lit(top["s"] or 0).cast("long").alias("saved_tokens"))
    rooted = lists.where("depth = 0").select(F.lit(0).cast("long").alias("_d"), "ends_sha256")
    root = root.join(rooted, F.col("depth") == F.col("_d"), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    out = root.select(*COLUMNS)
    for x in (nodes, heads, rest):
        out = out.unionByName(x.select(*COLUMNS))
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: crc32 of a short string: a list fold, bytes as they are and -1 for one shift; 3988292384 is the polynomial 0xEDB88320.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
  lambda ch: list_concat([ascii(ch)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT)"""

OP13_SQL = f"""
WITH turns AS MATERIALIZED (
  SELECT c, t, x, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, left(r, {TIE}), left(t, {TIE}), x) AS k
  FROM (SELECT *, sha256(length(r)::VARCHAR || ':' || r || t) AS x FROM (
    SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL))),
convs AS MATERIALIZED (SELECT c, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM turns)),
joined AS (
  SELECT v.c, t.k AS k, 0 AS own, t.x, t.t FROM convs v JOIN turns t ON t.c = v.c - v.c % {GROUP} AND t.k <= v.h
  UNION ALL
  SELECT v.c, t.k, 1, t.x, t.t FROM convs v JOIN turns t ON t.c = v.c AND t.k > v.h),
built AS MATERIALIZED (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, k) AS d, x, len(regexp_extract_all(t, '[^ \\t-\\r]+')) AS w FROM joined),
paths AS MATERIALIZED (
  SELECT c, d, w, count(*) OVER (PARTITION BY c) = d AS last,
         sha256(string_agg(x, '') OVER (PARTITION BY c ORDER BY d)) AS node FROM built
  UNION ALL SELECT c, 0, 0, NOT EXISTS (SELECT 1 FROM built b WHERE b.c = v.c), 'root' FROM convs v),
nodes AS MATERIALIZED (
  SELECT node, min(c) AS conv_id, d AS depth, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256 FROM paths GROUP BY node, d),
parents AS MATERIALIZED (SELECT DISTINCT a.node, b.node AS parent FROM paths a JOIN paths b ON a.c = b.c AND b.d = a.d - 1),
children AS MATERIALIZED (SELECT parent AS node, count(*) AS n FROM parents GROUP BY parent),
below AS MATERIALIZED (SELECT DISTINCT a.node, b.node AS under FROM paths a JOIN paths b ON a.c = b.c AND b.d >= a.d),
sums AS (
  SELECT b.node, sum((n.n_convs - 1) * n.w) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM below b JOIN nodes n ON n.node = b.under LEFT JOIN children k ON k.node = b.under GROUP BY b.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN children k ON k.node = n.node
LEFT JOIN parents e ON e.node = n.node LEFT JOIN nodes p ON p.node = e.parent
"""
