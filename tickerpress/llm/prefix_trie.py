"""The prefix trie of conversations, by van Emde Boas recursion.

A sequence of turns is cut at half its depth limit.  The cut prefix gets a name (a hash of
its anchor and its turns); the upper part stays below the old anchor, the lower part goes
below the new name.  Equal upper parts collapse into one row with their weight.  Each round
cuts all parts, upper and lower ones together, until every part is one turn long: one row
per trie node.  Totals then travel upward: the total of a lower forest is grafted on the
cut node above it, level by level.

Sequences longer than ``SEGMENT`` turns are first treated as sequences of segments, by the
same recursion, so no row holds more than one segment or one name per segment.

Names are 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerpress.llm.ordering import in_order, with_run
from tickerpress.session import write_through

#: Turns in a segment, a power of two.
SEGMENT = 1024
#: Name of the root and anchor of all first turns.
ROOT = "root"
#: Characters of a role and a text that order turns of the same number, before their hash does.
TIE = 64


def rebuilt_turns(conversations: DataFrame, shared: int = 100, heads: int = 6) -> DataFrame:
    """Conversations whose first turns are those of a neighbour: conv_id, depth (from 1), turn_name, n_chars.

    Conversation c takes the first h = crc32(c) % ``heads`` turns of conversation c - c % ``shared``
    (fewer if that has fewer), then its own turns after its first h.  A conversation that ends up
    without turns is one row of null depth.

    Turns are ordered by number, null first; turns of the same number by the beginnings of role
    and text, then by their hash; repeated rows stay repeated.  Null role and text are empty.
    Rows without conv_id belong to no conversation.  Other columns are not read.  Texts are read
    once and only their names are shuffled, so their length does not matter.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(role, 1, TIE).alias("role_head"),
        F.substring(text, 1, TIE).alias("text_head"),
        _short(F.concat(F.length(role), F.lit(":"), role, text)).alias("turn_name"), F.length(text).alias("n_chars"))
    # Equal turns are one row with a count, so a group of them is never one task's.
    order = ["conv_id", "turn", "role_head", "text_head", "turn_name"]
    counted = turns.groupBy(*order, "n_chars").agg(F.count(F.lit(1)).alias("n"))
    placed = with_run(in_order(counted, order, order, "trie"), "conv_id", "n", "upto")
    own = write_through(placed.select(
        "conv_id", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("place"),
        "turn_name", "n_chars"), "trie-turns")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    every = own.groupBy("conv_id").agg(F.max("place").alias("n_own")).withColumns({
        "lender": F.col("conv_id") - F.col("conv_id") % shared, "head": head})
    lent = own.where((F.col("conv_id") % shared == 0) & (F.col("place") < heads)).select(
        F.col("conv_id").alias("lender"), F.col("place").alias("depth"), "turn_name", "n_chars")
    n_lent = lent.groupBy("lender").agg(F.max("depth").alias("n_lent"))
    every = write_through(every.join(n_lent, "lender", "left").withColumn(
        "taken", F.least("head", F.coalesce("n_lent", F.lit(0)))), "trie-conversations")
    borrowed = every.where("taken > 0").join(lent, "lender").where("depth <= taken").select(
        "conv_id", "depth", "turn_name", "n_chars")
    kept = own.join(every.select("conv_id", "head", "taken"), "conv_id").where("place > head").select(
        "conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "turn_name", "n_chars")
    bare = every.where("taken = 0 and n_own <= head").select(
        "conv_id", F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("turn_name"),
        F.lit(None).cast("int").alias("n_chars"))
    return write_through(borrowed.unionByName(kept).unionByName(bare), "trie-rebuilt")


def build_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, depth, turn_name, n_chars).

    Returns name, parent, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over the node's subtree: members beyond the first times code points of
    the last text) and whole (the name under which ``members`` lists the conversations that end there,
    null if none).  Equal conversations are one sequence with a weight.  A table without conversations has no
    node, not even a root.  ``turns`` is read several times, so it should be a written table.
    """
    sequence_of = write_through(members(turns), "trie-members")
    segments, sequences = _segments(turns, sequence_of)
    upper = _name_prefixes(sequences, "top")
    lower = _name_prefixes(_open_segments(upper.nodes, segments), "low")
    nodes = write_through(_nodes(lower.nodes, sequence_of), "trie-nodes")
    totals = _graft(nodes, lower.cuts + upper.cuts)
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(totals, "name", "left").join(above, "parent", "left").select(
        "name", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.coalesce("leaves_below", F.lit(0)) + F.col("leaf")).alias("n_leaves"),
        (F.coalesce("saved_below", F.lit(0)) + F.col("saved")).alias("saved_tokens"), "whole")


def ends_digest(memberships: DataFrame) -> DataFrame:
    """SHA-256 of the ids of each whole sequence, ascending, joined by commas: whole, ends_sha256.

    The digest runs over one string, so the ids of one sequence pass through one task, in order
    and one batch at a time; nothing of them is held.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            wholes, hashes = [], []
            for whole, conv in zip(batch.column("whole").to_pylist(), batch.column("conv_id").to_pylist()):
                if whole == name:
                    state.update(b",%d" % conv)
                    continue
                if name is not None:
                    wholes.append(name)
                    hashes.append(state.hexdigest())
                name, state = whole, hashlib.sha256(b"%d" % conv)
            if wholes:
                yield pa.RecordBatch.from_arrays([pa.array(wholes), pa.array(hashes)], ["whole", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], ["whole", "ends_sha256"])

    return memberships.select("whole", "conv_id").repartition("whole").sortWithinPartitions("whole", "conv_id").mapInArrow(
        digest, "whole string, ends_sha256 string")


def _short(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def _name(anchor: Column | str, parts: Column | str) -> Column:
    """Of a prefix: its anchor and the turns after it.  Turn names hold no space."""
    return _short(F.concat_ws(" ", anchor, parts))


def _segment_rows(rows: DataFrame) -> DataFrame:
    turn = F.struct("depth", F.concat_ws(":", "turn_name", "n_chars").alias("turn"))
    return rows.where("depth is not null").groupBy("conv_id", F.floor((F.col("depth") - 1) / SEGMENT).alias("segment")).agg(
        F.transform(F.sort_array(F.collect_list(turn)), lambda x: x["turn"]).alias("turns"))


def members(rows: DataFrame) -> DataFrame:
    """conv_id, whole, names: a conversation's segment names and the name of them all."""
    named = _segment_rows(rows).select("conv_id", F.struct("segment", _name(F.lit("segment"), F.col("turns")).alias("name")).alias("s"))
    lists = named.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["name"]).alias("names"))
    bare = rows.where("depth is null").select("conv_id", F.array().cast("array<string>").alias("names"))
    return lists.unionByName(bare).select("conv_id", _name(F.lit("whole"), F.col("names")).alias("whole"), "names")


def _segments(rows: DataFrame, sequence_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct segments with their turns, and distinct whole sequences of segment names."""
    segments = _segment_rows(rows).select(_name(F.lit("segment"), F.col("turns")).alias("part"), "turns").groupBy("part").agg(
        F.first("turns").alias("turns"))
    sequences = sequence_of.where(F.size("names") > 0).groupBy("whole").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("names").alias("parts"))
    return segments, sequences.select(
        F.lit(ROOT).alias("anchor"), "parts", F.lit(None).cast("string").alias("end"), F.lit(0).cast("long").alias("depth"),
        "n_convs", "conv_id", "whole")


class _Named:
    """Nodes of a recursion (sequences of one part) and per level, small blocks first, the cuts:
    ``cut`` (node at half a block), ``anchor`` (of the block), ``end`` (of the block, null if it ends before)."""

    def __init__(self, nodes: DataFrame, cuts: list[DataFrame]):
        self.nodes, self.cuts = nodes, cuts


def _name_prefixes(sequences: DataFrame, label: str) -> _Named:
    """Cut sequences (anchor, parts, end, depth, n_convs, conv_id, whole) down to single parts."""
    parts = write_through(sequences, f"trie-{label}")
    longest = parts.agg(F.max(F.size("parts"))).first()[0] or 1
    levels, cuts = max(0, (longest - 1).bit_length()), []
    # A sequence that fills the outermost block ends in a node named after all of it.
    parts = parts.withColumn("end", F.when(F.size("parts") == 1 << levels, F.coalesce("end", _name("anchor", "parts"))).otherwise(F.col("end")))
    for level in reversed(range(levels)):
        half = 1 << level
        size, first = F.size("parts"), F.slice("parts", 1, half)
        halved = parts.withColumn("cut", F.when(size >= half, _name("anchor", first)))
        cuts.append(write_through(halved.where(F.col("cut").isNotNull()).select(
            "anchor", "cut", F.when(size == 2 * half, F.col("end")).alias("end")).distinct(), f"trie-{label}-cut{level}"))
        same = ["n_convs", "conv_id"]
        above = F.struct("anchor", first.alias("parts"), F.col("cut").alias("end"), "depth", *same,
                         F.when(size == half, F.col("whole")).alias("whole"))
        below = F.struct(F.col("cut").alias("anchor"), F.slice("parts", half + 1, half).alias("parts"), "end",
                         (F.col("depth") + half).alias("depth"), *same, "whole")
        asis = F.struct("anchor", "parts", "end", "depth", *same, "whole")
        pieces = F.when(size > half, F.array(above, below)).when(size == half, F.array(above)).otherwise(F.array(asis))
        # Equal upper parts collapse; equal short ones join them.
        parts = write_through(halved.select(F.explode(pieces).alias("x")).select("x.*").groupBy(
            "anchor", _name("anchor", "parts").alias("_name")).agg(
            F.first("parts").alias("parts"), F.max("end").alias("end"), F.first("depth").alias("depth"),
            F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("whole").alias("whole")).drop("_name"),
            f"trie-{label}-{level}")
    return _Named(parts, cuts[::-1])


def _open_segments(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """Segment nodes as sequences of turns; only a full segment ends in a node that others hang on."""
    opened = nodes.withColumn("part", F.element_at("parts", 1)).drop("parts").join(segments, "part")
    return opened.select("anchor", F.col("turns").alias("parts"), F.when(F.size("turns") == SEGMENT, F.col("end")).alias("end"),
                         (F.col("depth") * SEGMENT).alias("depth"), "n_convs", "conv_id", "whole")


def _nodes(parts: DataFrame, sequence_of: DataFrame) -> DataFrame:
    """The root and all nodes, with their own share of the totals."""
    turn = F.element_at("parts", 1)
    below = parts.select(F.col("end").alias("name"), F.col("anchor").alias("parent"), "conv_id", (F.col("depth") + 1).alias("depth"),
                         "n_convs", ((F.col("n_convs") - 1) * F.split_part(turn, F.lit(":"), F.lit(2)).cast("long")).alias("saved"),
                         "whole")
    bare = F.max(F.when(F.size("names") == 0, F.col("whole")))
    root = sequence_of.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), bare.alias("whole")).where(
        "n_convs > 0").select(F.lit(ROOT).alias("name"), F.lit(None).cast("string").alias("parent"), "conv_id",
                              F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("saved"), "whole")
    nodes = root.unionByName(below)
    children = below.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).withColumn(
        "leaf", (F.col("n_children") == 0).cast("long"))


def _graft(nodes: DataFrame, cuts: list[DataFrame]) -> DataFrame:
    """What lies strictly below each node: name, saved_below, leaves_below.

    Upward, from small blocks to large: the total of the forest below an anchor takes up the
    totals of the forests below the cut nodes of its block.  Then, from large blocks to small,
    a cut node adds what lies below the ends of its block.
    """
    sums = [F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")]
    forest = write_through(nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(*sums), "trie-graft")
    settled = []
    for level, cut in enumerate(cuts):
        to = cut.select(F.col("cut").alias("name"), "anchor").distinct()
        tied = forest.join(to, "name", "left")
        settled.append(forest.join(to, "name", "left_semi"))
        forest = write_through(tied.groupBy(F.coalesce("anchor", "name").alias("name")).agg(*sums), f"trie-graft{level}")
    below = forest  # the root, and nodes at the end of the largest block: nothing is below them
    for level in reversed(range(len(cuts))):
        ends = cuts[level].where("end is not null").select("cut", F.col("end").alias("name"))
        carried = below.join(ends, "name").select(F.col("cut").alias("name"), "saved", "leaf")
        here = settled[level].unionByName(carried).groupBy("name").agg(*sums)
        below = write_through(below.unionByName(here), f"trie-below{level}")
    return below.select("name", F.col("saved").alias("saved_below"), F.col("leaf").alias("leaves_below"))
