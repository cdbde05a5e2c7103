"""Conversations as a prefix tree of formatted turns: shared turns are emitted once, in depth-first order."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_types, map_arrow, scratch
from .tokens import byte_level

LOSS_ROLE = "assistant"
# Rows of a conversation that share a window.
CHUNK = 65_536
# Depths that one row is spread to at once.
SPREAD = 4_096

# --- the template ----------------------------------------------------------------------------------------------------

# A turn is "<turn role>\n" text "\n</turn>\n". In texts a backslash stands before each backslash and each "<" that would begin
# a mark, in roles also before ">", so no text can end a turn or begin one.
TEXT_MARK, ROLE_MARK = re.compile(r"\\|<(?=/?turn)"), re.compile(r"[\\>]|<(?=/?turn)")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n(.*)\n</turn>\n", re.DOTALL)


def format_turn(role: str | None, text: str | None) -> tuple[str, str, str]:
    """Head, body and tail of a turn; a null role or text is empty."""
    return f"<turn {ROLE_MARK.sub(_backslash, role or '')}>\n", TEXT_MARK.sub(_backslash, text or ""), "\n</turn>\n"


def _backslash(match: re.Match) -> str:
    return "\\" + match[0]


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    found = TURN.fullmatch(formatted)
    if found is None:
        raise ValueError("not one formatted turn")
    return unescape(found[1]), unescape(found[2])


# --- the tree --------------------------------------------------------------------------------------------------------


@dataclass
class ChatTree:
    """The written tree.

    ``nodes``: block, depth, role, ids, loss_from, loss_to, n_tokens, ends; one row per distinct prefix, that is per turn after the
    turns before it. A block is a run of nodes below one another. ``layout``: block, first_depth, start, position, n_tokens, chain,
    intervals; the tokens of a block are at ``start`` and after it in depth-first order, have positions from ``position`` on, and
    see the tokens before them in the block and those of ``intervals`` (from, to), which hold all their ancestors. ``leaves``: conv,
    conv_id, block, depth; where each conversation ends.
    """

    nodes: DataFrame
    layout: DataFrame
    leaves: DataFrame


def _ranked(conversations: DataFrame) -> DataFrame:
    """conv, turn, c1, c2, depth, repeated: turns numbered from 1 in their conversation, without their texts."""
    chunk = F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / F.lit(CHUNK)).alias("_chunk")
    rows = conversations.select("conv", "turn", "c1", "c2", chunk)
    counts = rows.groupBy("conv", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("conv").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv", "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("conv", "_chunk").orderBy("turn", "c1", "c2")
    this = F.struct("turn", "c1")
    repeated = F.coalesce(F.lag(this).over(inside) == this, F.lit(False)) | F.coalesce(F.lead(this).over(inside) == this, F.lit(False))
    # structs with nulls inside are compared null-safely
    return rows.join(offsets, ["conv", "_chunk"]).select(
        "conv", "turn", "c1", "c2", (F.row_number().over(inside) + F.col("_before")).alias("depth"), repeated.alias("repeated")
    )


def _halves(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]


def _prefixes(ranked: DataFrame) -> DataFrame:
    """Add n1, n2: 128 bits that name the prefix of a conversation up to each turn.

    They are sums of hashes of (depth, content) modulo 2^32, so they add up over parts of a conversation and need no long chain.
    """
    limbs = [half for seed in (1, 2) for half in _halves(F.xxhash64(F.lit(seed), "depth", "c1", "c2"))]
    names = [f"_s{i}" for i in range(4)]
    rows = ranked.select(
        "conv", "turn", "c1", "depth", "repeated", F.floor(F.col("depth") / F.lit(CHUNK)).alias("_chunk"),
        *[h.alias(n) for h, n in zip(limbs, names)],
    )
    sums = rows.groupBy("conv", "_chunk").agg(*[F.sum(n).alias(n) for n in names])
    earlier = Window.partitionBy("conv").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv", "_chunk", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}b") for n in names])
    inside = Window.partitionBy("conv", "_chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(carried, ["conv", "_chunk"])
    total = [F.pmod(F.sum(n).over(inside) + F.col(f"{n}b"), F.lit(1 << 32)) for n in names]
    pair = lambda high, low: F.shiftleft(high, 32).bitwiseOR(low)
    return joined.select("conv", "turn", "c1", "depth", "repeated", pair(total[0], total[1]).alias("n1"), pair(total[2], total[3]).alias("n2"))


def _owned(prefixes: DataFrame) -> DataFrame:
    """conv, turn, c1, depth, repeated, owner: the conversation of smallest hash through each prefix owns it.

    So a conversation owns the end of its path, or nothing. Through a random conversation the owner changes about as often as a
    minimum does, log n times, whatever the shape of the tree.
    """
    owners = prefixes.groupBy("n1", "n2").agg(F.min(F.struct(F.xxhash64("conv").alias("h"), "conv")).alias("_o"))
    owners = owners.select("n1", "n2", F.col("_o.conv").alias("owner"))
    return prefixes.join(owners, ["n1", "n2"]).select("conv", "turn", "c1", "depth", "repeated", "owner")


def _emitted(texts: DataFrame, owned: DataFrame, ends: DataFrame, path: str) -> DataFrame:
    """The nodes with their tokens, written where their text is read if the table of owned turns can be sent there."""
    own = owned.filter("owner = conv").join(
        ends.select(F.col("block").alias("conv"), "depth", F.lit(True).alias("ends")), ["conv", "depth"], "left"
    ).select("conv", "turn", "c1", "depth", "repeated", F.coalesce("ends", F.lit(False)).alias("ends"))
    own = cut_lineage(own)
    spread = lambda left, right: left.join(
        right.withColumnsRenamed({c: f"_{c}" for c in ("conv", "turn", "c1")}),
        (F.col("conv") == F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("c1") == F.col("_c1")),
    ).select("conv", "depth", "ends", "role", "text")
    rows = spread(texts, own.filter("not repeated"))
    if own.filter("repeated").limit(1).count():  # equal rows of a turn: one text for as many nodes
        rows = rows.unionByName(spread(texts.dropDuplicates(["conv", "turn", "c1"]), own.filter("repeated")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_level(path)
        for batch in batches:
            ids, starts, loss = [], [0], ([], [])
            for role, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                head, body, tail = (coder.encode(part) for part in format_turn(role, text))
                ids += head + body + tail
                starts.append(len(ids))
                loss[0].append(len(head))
                loss[1].append(len(head) + (len(body) if role == LOSS_ROLE else 0))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            sizes = pa.array([b - a for a, b in zip(starts, starts[1:])], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], lists, *[pa.array(x, pa.int32()) for x in loss], sizes],
                ["block", "depth", "ends", "role", "ids", "loss_from", "loss_to", "n_tokens"],
            )

    schema = "block string, depth long, ends boolean, role string, ids array<int>, loss_from int, loss_to int, n_tokens int"
    written = scratch(own.sparkSession, "chat-nodes")
    nodes = map_arrow(rows, encode, schema).sortWithinPartitions("block", "depth")
    nodes.write.option("compression", "zstd").parquet(written)
    return own.sparkSession.read.schema(nodes.schema).parquet(written)


def _laid_out(nodes: DataFrame, branches: DataFrame) -> DataFrame:
    """Places of the blocks in depth-first order: below a node its own block goes on first, then the blocks that branch off."""
    rows = nodes.select("block", "depth", "n_tokens", F.floor(F.col("depth") / F.lit(CHUNK)).alias("_chunk"))
    parts = rows.groupBy("block", "_chunk").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.partitionBy("block").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("block", "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("block", "_chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    through = cut_lineage(rows.join(parts, ["block", "_chunk"]).select(
        "block", "depth", (F.sum("n_tokens").over(inside) + F.col("_before")).alias("through")
    ))
    blocks = through.groupBy("block").agg(F.min("depth").alias("first_depth"), F.max("through").alias("n_tokens"))
    above = through.select(F.col("block").alias("parent"), F.col("depth").alias("branch"), F.col("through").alias("seen"))
    blocks = cut_lineage(blocks.join(branches, "block", "left").join(above, ["parent", "branch"], "left"))

    step = F.struct((-F.coalesce("branch", F.lit(0))).alias("up"), F.xxhash64("block").alias("h"), F.col("block").alias("b"))
    link = F.struct("parent", "_first", F.col("branch").alias("last"), F.col("seen").alias("tokens"))
    keep = ["block", "first_depth", "n_tokens", "position", "key", "chain"]
    level = cut_lineage(blocks.filter("parent is null").select(
        "block", "first_depth", "n_tokens", F.lit(0).cast("long").alias("position"), F.array(step).alias("key"),
        F.array().cast("array<struct<block:string,first:bigint,last:bigint,tokens:bigint>>").alias("chain"),
    ))
    below, levels = blocks.filter("parent is not null"), [level]
    while True:
        upper = level.select(
            F.col("block").alias("parent"), F.col("first_depth").alias("_first"), F.col("position").alias("_position"),
            F.col("key").alias("_key"), F.col("chain").alias("_chain"),
        )
        level = cut_lineage(below.join(upper, "parent").select(
            "block", "first_depth", "n_tokens", (F.col("_position") + F.col("seen")).alias("position"),
            F.concat("_key", F.array(step)).alias("key"),
            F.concat("_chain", F.array(link).cast("array<struct<block:string,first:bigint,last:bigint,tokens:bigint>>")).alias("chain"),
        ))
        if level.limit(1).count() == 0:
            break
        levels.append(level)
    placed = levels[0]
    for level in levels[1:]:
        placed = placed.unionByName(level)
    ordered = placed.select(*keep).orderBy("key").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered.drop("key"))
    sizes = ordered.groupBy("_part").agg(F.sum("n_tokens").alias("_n"))
    carried = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    before = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(ordered.join(carried, "_part").select(
        "block", "first_depth", (F.coalesce(F.sum("n_tokens").over(before), F.lit(0)) + F.col("_before")).alias("start"), "position",
        "n_tokens", "chain",
    ))
    seen = starts.select("block", F.posexplode("chain").alias("_at", "_l")).select("block", "_at", F.col("_l.block").alias("_of"), "_l.tokens")
    seen = seen.join(starts.select(F.col("block").alias("_of"), "start"), "_of")
    interval = F.struct(F.col("start").alias("from"), (F.col("start") + F.col("tokens")).alias("to"))
    seen = seen.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("_at", interval.alias("i")))).alias("_all"))
    seen = seen.select("block", F.transform("_all", lambda x: x["i"]).alias("intervals"))
    none = F.array().cast(seen.schema["intervals"].dataType)
    return cut_lineage(starts.join(seen, "block", "left").withColumn("intervals", F.coalesce("intervals", none)))


def build_tree(conversations: DataFrame, path: str) -> ChatTree:
    """Format all conversations (conv_id, turn, role, text), merge those that share initial turns, and write the tree.

    Rows of a conversation are ordered by turn (nulls first), rows of one turn by a hash of role and text; repeated rows are
    turns of their own, which equal each other. All rows of a null conv_id are one conversation. A null role or text is empty and
    equals an empty one. Tokens are those of the byte-level vocabulary ``path``, head, text and tail of a turn apart from each other;
    the loss lies on the texts of the role "assistant". Extra columns are left out, and an empty table gives an empty tree.

    Texts are read twice and move only if the table of owned turns is too large to be sent to them; all else handles turns
    without texts. A long conversation is numbered and summed in chunks. Blocks are placed level by level, of which there are
    about log n.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    content = lambda seed: F.xxhash64(F.lit(seed), F.length(role), role, text)
    texts = conversations.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv"), "conv_id",
        F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), content(3).alias("c1"), content(4).alias("c2"),
    )
    owned = cut_lineage(_owned(cut_lineage(_prefixes(_ranked(texts)))))
    other = F.when(F.col("owner") != F.col("conv"), F.col("depth"))
    convs = cut_lineage(owned.groupBy("conv").agg(
        F.max_by("owner", "depth").alias("block"), F.max("depth").alias("depth"),
        F.max_by("owner", other).alias("parent"), F.max(other).alias("branch"), F.count_if(F.col("owner") == F.col("conv")).alias("n_own"),
    ))
    kind = conversations.schema["conv_id"].dataType
    named = F.when(F.col("conv") != "n", F.substring("conv", 2, 1 << 30)).cast(kind)
    leaves = convs.select("conv", named.alias("conv_id"), "block", "depth")
    nodes = _emitted(texts.drop("conv_id"), owned, leaves.select("block", "depth").distinct(), path)
    branches = convs.filter("n_own > 0 and parent is not null").select(F.col("conv").alias("block"), "parent", "branch")
    return ChatTree(nodes, _laid_out(nodes, branches), leaves)


# --- reading back ----------------------------------------------------------------------------------------------------

DIGEST = "block string, depth long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Reader:
    """State of one path of nodes, read from the root on."""

    def __init__(self) -> None:
        self.depth, self.loss_chars, self.chars = 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: str) -> None:
        role, text = parse_turn(formatted)
        self.turns.update(f"{role}\n{text}\n".encode())
        self.loss.update(loss.encode())
        self.depth, self.chars, self.loss_chars = self.depth + 1, self.chars + len(formatted), self.loss_chars + len(loss)

    def row(self) -> tuple:
        return self.depth, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(rows: DataFrame, path: str) -> DataFrame:
    """Digests of the paths in ``rows`` (key, depth, emit, ids, loss_from, loss_to) that come in order and whole.

    A path is a run of rows of one key with depths 1, 2, ...; only its hash states are held, however long it is. Rows marked
    ``emit`` give a digest of the path up to them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, key, reader = byte_level(path), None, None
        for batch in batches:
            out: list[tuple] = []
            keys, depths, emits, starts, stops = (batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5))
            for i, (k, depth, emit) in enumerate(zip(keys, depths, emits)):
                if depth == 1:
                    key, reader = k, _Reader()
                elif reader is None or k != key or depth != reader.depth + 1:
                    reader = None  # a part of the path is elsewhere
                    continue
                ids = batch.column(3)[i].as_py()
                reader.add(coder.decode(ids).decode(), unescape(coder.decode(ids[starts[i] : stops[i]]).decode()))
                if emit:
                    out.append((k, depth, *reader.row()))
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    schema = arrow_types(DIGEST)
    return map_arrow(rows, run, DIGEST)


def read_back(tree: ChatTree, path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, from the written tree.

    Paths that lie whole in one part of the node table, as they were written, are read there; only the others, which pass
    through shared turns or lie in several parts, bring their nodes together.
    """
    nodes = tree.nodes
    here = cut_lineage(_digests(nodes.select(F.col("block").alias("key"), "depth", F.col("ends").alias("emit"), "ids", "loss_from", "loss_to"), path))
    ends = tree.leaves.select("block", "depth").distinct()
    rest = ends.join(here.select("block", "depth"), ["block", "depth"], "left_anti").withColumnRenamed("depth", "leaf")
    rest = rest.join(tree.layout.select("block", "first_depth", "chain"), "block")
    own = F.array(F.struct("block", F.col("first_depth").alias("first"), F.col("leaf").alias("last")))
    shared = F.transform("chain", lambda x: F.struct(x["block"].alias("block"), x["first"].alias("first"), x["last"].alias("last")))
    parts = rest.select(F.concat_ws("/", "block", "leaf").alias("key"), "leaf", F.explode(F.concat(shared, own)).alias("p"))
    parts = parts.select("key", "leaf", "p.*").withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - F.col("first")) / SPREAD))))
    low = F.col("first") + F.col("_run") * SPREAD
    steps = parts.select("key", "leaf", "block", F.explode(F.sequence(low, F.least(F.col("last"), low + (SPREAD - 1)))).alias("depth"))
    far = steps.join(nodes.select("block", "depth", "ids", "loss_from", "loss_to"), ["block", "depth"]).select(
        "key", "depth", (F.col("depth") == F.col("leaf")).alias("emit"), "ids", "loss_from", "loss_to"
    )
    far = _digests(far.repartition("key").sortWithinPartitions("key", "depth"), path)
    found = here.unionByName(far.withColumn("block", F.expr("substring(block, 1, length(block) - length(concat('/', depth)))")))
    columns = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return tree.leaves.join(found, ["block", "depth"]).select("conv_id", *columns)
