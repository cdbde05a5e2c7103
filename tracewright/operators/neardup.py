"""Near duplicates by shared line sequences, and by the similarity of their runs of lines or words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, send_package
from .components import connected_components
from .scale import compute_once

# Bands and rows of a signature: a pair of similarity 0.8 shares no band once in 4,600 times, one of 0.4 shares one in three.
BANDS, ROWS = 16, 4
# Hashes of a set that are mixed at once.
RUNS_AT_ONCE = 512
# Contents and runs of a chunk; a content of more runs is a chunk of its own.
CHUNK_CONTENTS, CHUNK_RUNS = 512, 1 << 18
# A run in more than this share of the contents, and in this many at least, is boilerplate.
BOILERPLATE_SHARE, BOILERPLATE_LEAST = 0.05, 10
# Buckets in which runs are counted, per byte of a mean content: with words of five letters each holds a hundredth of the contents.
BUCKETS_A_BYTE, LEAST_BUCKETS, MOST_BUCKETS = 16, 1 << 12, 1 << 20
# Bytes that part words, and bytes of texts that are coded at once.
BLANK, BYTES_AT_ONCE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]), 1 << 18


def line_shingles(files: DataFrame, k: int = 3) -> DataFrame:
    """Distinct runs of ``k`` lines of each distinct content: (sha256, shingle).

    ``files``: sha256, text. A content of fewer lines is one run of all of them. Runs are cut and hashed inside the row, so
    texts are never exchanged; copies share their rows and are combined before the exchange.
    """
    cut = compute_once(files.select("sha256", "text"), "_lines", F.split("text", "\n"))
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_lines") - (k - 1), F.lit(1))),
        lambda i: F.unhex(F.md5(F.array_join(F.slice("_lines", i, k), "\n"))),
    )
    return cut.select("sha256", F.explode(F.array_distinct(runs)).alias("shingle")).distinct()


def near_duplicate_links(files: DataFrame, k: int = 3, boilerplate: DataFrame | None = None) -> DataFrame:
    """(a, b, n_shared): contents linked to the smallest content they share a run with, and by how many runs.

    The holders of a run form a star around the smallest of them, so links are as many as runs, however many contents hold
    one, and join the same contents as all pairs would. ``boilerplate`` (shingle) lists runs that link nothing.
    """
    shingles = line_shingles(files, k)
    if boilerplate is not None:
        shingles = shingles.join(boilerplate.select("shingle").distinct(), "shingle", "left_anti")
    first = shingles.groupBy("shingle").agg(F.min("sha256").alias("a"))
    star = shingles.join(first, "shingle").filter("a <> sha256")
    return star.groupBy("a", F.col("sha256").alias("b")).agg(F.count(F.lit(1)).alias("n_shared"))


def families(files: DataFrame, k: int = 3, boilerplate: DataFrame | None = None) -> DataFrame:
    """Family of each file: exact and near duplicates, transitively. ``files``: rel_path, sha256, text."""
    nodes = files.select(F.col("sha256").alias("node")).distinct()
    found = connected_components(nodes, near_duplicate_links(files, k, boilerplate))
    return files.select("rel_path", "sha256").join(found.withColumnRenamed("node", "sha256"), "sha256").select(
        "rel_path", "sha256", F.col("component").alias("family")
    )


def family_representatives(families_of_files: DataFrame) -> DataFrame:
    """The first file of each family and the family size."""
    return families_of_files.groupBy("family").agg(
        F.min("rel_path").alias("rel_path"), F.count(F.lit(1)).alias("n_files")
    )


def _pieces(text: Column, unit: str) -> Column:
    """Lines or words of a text; none of a text without a word."""
    pieces = F.split(text, "\n") if unit == "line" else F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    return F.when(F.regexp_like(text, F.lit(r"[^ \t\n\x0B\f\r]")), pieces).otherwise(F.array().cast("array<string>"))


def _run_at(i: Column, k: int) -> Column:
    """Hash of the run that begins with piece ``i``. It is that of a slice, which is not copied; what lies beyond the end adds nothing."""
    return F.xxhash64(*[F.get("_pieces", i + j) for j in range(k)])


def with_runs(files: DataFrame, k: int, unit: str) -> DataFrame:
    """Add ``runs``: distinct hashes of the runs of ``k`` lines or words of ``text``; one run of all, if it has fewer."""
    cut = compute_once(files, "_pieces", _pieces(F.col("text"), unit))  # a lambda would cut the text again for each run
    last = F.greatest(F.size("_pieces") - k, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: _run_at(i, k))
    return cut.withColumn("runs", F.when(F.size("_pieces") > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))).drop("_pieces")


def _mixed(runs: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of each run (splitmix64 from ``salt`` on), to be added up over a set."""
    z = runs + np.uint64(salt)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _spans(text: np.ndarray, at: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each piece, in order, as ``_pieces`` cuts them. ``text``: bytes of UTF-8; a row ends where the next begins, ``at``."""
    solid = ~BLANK[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(solid & (edge[:-1] | np.concatenate(([True], ~solid[:-1]))))
    rows = np.searchsorted(at, starts, "right") - 1
    if unit == "word":
        return rows, starts, np.flatnonzero(solid & (edge[1:] | np.concatenate((~solid[1:], [True])))) + 1
    rows, breaks = np.unique(rows), np.flatnonzero(text == ord("\n"))
    of = np.searchsorted(at, breaks, "right") - 1
    held = np.isin(of, rows)
    breaks, of = breaks[held], of[held]
    return np.sort(np.concatenate((rows, of))), np.sort(np.concatenate((at[rows], breaks + 1))), np.sort(np.concatenate((breaks, at[rows + 1])))


def _coded(texts: pa.Array, k: int, unit: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first piece, code) of the runs of texts. Equal runs have equal codes; others may, so a code only tells what may be equal.

    Works on bytes: a piece is the difference of two sums of bytes times powers of a number, brought to the same power.
    """
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    powers = back = np.ones(1, np.uint64)
    odd, i = 0x9E3779B97F4A7C15, 0
    while i < len(texts):
        end = max(i + 1, int(np.searchsorted(at, at[i] + BYTES_AT_ONCE, "right")) - 1)
        here, text = at[i : end + 1] - at[i], data[at[i] : at[end]]
        rows, starts, ends = _spans(text, here, unit)
        if len(powers) <= len(text):
            n = max(len(text), BYTES_AT_ONCE)
            one, both = np.ones(1, np.uint64), (odd, pow(odd, -1, 1 << 64))
            powers, back = (np.cumprod(np.concatenate((one, np.full(n, x, np.uint64))), dtype=np.uint64) for x in both)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((text + np.uint64(1)) * powers[: len(text)], dtype=np.uint64)))
        pieces = _mixed((sums[ends] - sums[starts]) * back[starts], odd)
        size = np.bincount(rows, minlength=end - i)
        index = np.arange(len(rows)) - (np.cumsum(size) - size)[rows]
        size = size[rows]
        codes = np.zeros(len(rows), np.uint64)
        for j in range(min(k, len(rows))):
            n = len(rows) - j
            codes[:n] += np.where(index[:n] + j < size[:n], pieces[j:] * np.uint64(pow(odd, 2 * j + 1, 1 << 64)), np.uint64(0))
        first = index <= np.maximum(size - k, 0)
        yield rows[first] + i, index[first], _mixed(codes[first], odd)
        i = end


def _bucket_counts(texts: DataFrame, k: int, unit: str, buckets: int) -> DataFrame:
    """(bucket, n): runs of each part of ``texts`` (text) by the bucket of their code."""
    send_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, codes in _coded(batch.column(0), k, unit):
                np.add.at(n, codes & np.uint64(buckets - 1), 1)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], ["bucket", "n"])

    return texts.mapInArrow(run, "bucket bigint, n bigint")


def _marked(texts: DataFrame, k: int, unit: str, buckets: int, full: list[int]) -> DataFrame:
    """(content, text, at): the texts that have runs in the buckets ``full``, and the first pieces of those runs."""
    send_package(texts.sparkSession)
    wanted = np.zeros(buckets, bool)
    wanted[full] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(rows[hit], first[hit]) for rows, first, codes in _coded(batch.column(1), k, unit) for hit in [wanted[codes & np.uint64(buckets - 1)]]]
            if not found:
                continue
            rows, first = (np.concatenate(x) for x in zip(*found, strict=True))
            rows, n = np.unique(rows, return_counts=True)
            at = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(first, pa.int32()))
            held = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([held.column(0), held.column(1), at], ["content", "text", "at"])

    return texts.select("content", "text").mapInArrow(run, "content bigint, text string, at array<int>")


def common_runs(
    files: DataFrame, k: int = 5, unit: str = "word", share: float = BOILERPLATE_SHARE, least: int = BOILERPLATE_LEAST
) -> DataFrame:
    """(run): boilerplate, the runs that more than ``share`` of the contents hold, and at least ``least``. ``files``: sha256, text.

    Runs are counted by bucket first, copies as often as they come, so a bucket counts no less than any of its runs; only runs of
    a bucket that reaches the bounds are cut and exchanged. Buckets follow the length of a content, not the number of contents.
    """
    sizes = files.groupBy("sha256").agg(F.max(F.octet_length("text")).alias("bytes"))
    total, mean = sizes.agg(F.count(F.lit(1)), F.coalesce(F.avg("bytes"), F.lit(0.0))).first()
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << int(BUCKETS_A_BYTE * mean).bit_length()))
    many = (F.col("n") >= least) & (F.col("n") > total * share)
    counts = _bucket_counts(files.select("text"), k, unit, buckets).groupBy("bucket").agg(F.sum("n").alias("n"))
    full = counts.filter(many).agg(F.collect_list("bucket")).first()[0]  # MOST_BUCKETS numbers at most
    cut = compute_once(_marked(files.select(F.xxhash64("sha256").alias("content"), "text"), k, unit, buckets, full), "_pieces", _pieces(F.col("text"), unit))
    held = cut.select("content", F.explode(F.transform("at", lambda i: _run_at(i, k))).alias("run")).distinct()
    return cut_lineage(held.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter(many).select("run"))


def run_sets(
    files: DataFrame, k: int = 5, unit: str = "word", share: float = BOILERPLATE_SHARE, least: int = BOILERPLATE_LEAST,
    common: DataFrame | None = None, only: DataFrame | None = None, copies: bool = False,
) -> DataFrame:
    """(sha256, runs): the runs of every distinct content, without boilerplate. ``files``: sha256, text.

    ``common`` (run) is that of ``common_runs``, if it is known; ``only`` (sha256, each once) names the contents that are asked for.
    Texts are exchanged to bring copies together, and cut after it, since their runs take twice the room; with ``copies`` nothing
    is exchanged and a content comes as often as its files do. The rows are dealt by sha256 but for ``copies``.
    """
    common = common_runs(files, k, unit, share, least) if common is None else common
    texts = files.select("sha256", "text") if copies else files.groupBy("sha256").agg(F.min("text").alias("text"))
    texts = texts if only is None else texts.join(only, "sha256")
    # one row; a run of it is in a twentieth of the contents, so it is as long as twenty contents at most
    lost = common.agg(F.collect_list("run").alias("_lost"))
    sets = with_runs(texts, k, unit).join(F.broadcast(lost), F.lit(True))
    return sets.select("sha256", F.array_except("runs", "_lost").alias("runs"))


def _signed(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """(sha256, n, key, check, bands) of every set: its size, two sums of hashes that equal sets share, and, by band, the least of
    its hashes under each of bands x rows multiplicative hash functions.

    Evaluated on Arrow batches: the same in a JVM lambda takes about a hundred times as long.
    """
    send_package(sets.sparkSession)
    rng = np.random.default_rng(5)
    factor, shift = (rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    weights = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty((batch.num_rows, bands), np.uint64)
            at = batch.column(1).offsets.to_numpy()
            every = batch.column(1).values.to_numpy().view(np.uint64)
            for i in range(batch.num_rows):
                runs = every[at[i] : at[i + 1]]
                least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for k in range(0, len(runs), RUNS_AT_ONCE):
                    mixed = runs[k : k + RUNS_AT_ONCE, None] * factor + shift
                    mixed ^= mixed >> np.uint64(32)
                    mixed *= factor
                    least = np.minimum(least, mixed.min(axis=0))
                out[i] = (least.reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64)
            sums = []
            for salt in (0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A):
                up_to = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(every, salt), dtype=np.uint64)])
                sums.append(pa.array((up_to[at[1:]] - up_to[at[:-1]]).view(np.int64)))
            offsets = pa.array(np.arange(0, out.size + 1, bands, dtype=np.int32))
            signed = pa.ListArray.from_arrays(offsets, pa.array(out.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), *sums, signed], ["sha256", "n", "key", "check", "bands"])

    runs = F.coalesce("runs", F.array().cast("array<bigint>")).alias("runs")
    return sets.select("sha256", runs).mapInArrow(run, "sha256 string, n int, key bigint, check bigint, bands array<bigint>")


def _chunked(contents: DataFrame) -> DataFrame:
    """(v, sha256, chunk) of (v, sha256, n): rows that follow each other share a chunk, up to a number of runs and of contents."""
    send_package(contents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, contents, runs = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            out = []
            for n in batch.column(2).to_pylist():
                if contents and (contents == CHUNK_CONTENTS or runs + n > CHUNK_RUNS):
                    chunk, contents, runs = chunk + 1, 0, 0
                contents, runs = contents + 1, runs + n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["v", "sha256", "chunk"])

    return contents.select("v", "sha256", "n").mapInArrow(run, "v bigint, sha256 string, chunk bigint")


def _counted(met: DataFrame, contents: DataFrame, again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(x, y, n_shared, n_all) of the pairs ``met`` (x, y) of ``contents`` (id, sha256, n); ``again`` gives the sets.

    A set is not sent to each of its pairs, of which a large group of similar contents has as many as contents: contents are put in
    chunks, beside those that share their smallest partner, and a set is sent once to every pair of chunks that it has a pair in. A
    task holds the sets of two chunks at once.
    """
    ends = F.array(F.struct(F.col("x").alias("v"), F.col("y").alias("o")), F.struct(F.col("y").alias("v"), F.col("x").alias("o")))
    near = met.select(F.explode(ends).alias("e")).groupBy("e.v").agg(F.min("e.o").alias("o"))
    near = near.withColumn("label", F.least("v", "o")).join(contents.withColumnRenamed("id", "v"), "v")
    chunks = cut_lineage(_chunked(near.orderBy("label", "v")))
    place = lambda i, c: chunks.select(F.col("v").alias(i), F.col("chunk").alias(c))
    placed = met.join(place("x", "_cx"), "x").join(place("y", "_cy"), "y")
    placed = cut_lineage(placed.select(F.least("_cx", "_cy").alias("low"), F.greatest("_cx", "_cy").alias("high"), "x", "y"))
    sent = placed.select("low", "high", F.explode(F.array("x", "y")).alias("v")).distinct().join(chunks.select("v", "sha256"), "v")
    held = again(chunks.select("sha256")).join(sent, "sha256")
    held = held.select("low", "high", F.col("v").alias("x"), F.lit(None).cast("bigint").alias("y"), "runs")
    rows = held.unionByName(placed.withColumn("runs", F.lit(None).cast("array<bigint>")))
    rows = rows.repartition("low", "high").sortWithinPartitions("low", "high", F.col("y").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets = None, {}
        for batch in batches:
            low, high, xs, ys = (batch.column(i).to_pylist() for i in range(4))
            at, every = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            out = []
            for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
                if block != (low[i], high[i]):
                    block, sets = (low[i], high[i]), {}
                if y is None:
                    sets[x] = np.sort(every[at[i] : at[i + 1]])
                    continue
                both = np.concatenate((sets[x], sets[y]))
                both.sort(kind="stable")  # merges two sorted parts
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                out.append((x, y, shared, len(both) - shared))
            columns = zip(*out, strict=True) if out else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["x", "y", "n_shared", "n_all"])

    return rows.mapInArrow(run, "x bigint, y bigint, n_shared int, n_all int")


def similar_contents(
    sets: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, again: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of contents whose run sets have a Jaccard similarity of ``threshold`` or more.

    ``members``: sha256, content; contents of equal run sets are one, named by the smallest; a content without runs is its own and
    similar to none. ``pairs``: a, b (a < b, such names), n_shared, n_all, similarity. ``sets``: sha256, runs; a content may come
    more than once. ``again`` gives the sets of some contents (sha256, each once) anew, each once, for those that work them out with
    less room than the sets take; without it the sets are written. Candidates share a band of their min-wise hashes, and their
    sizes allow the similarity, which is then worked out exactly. Steps up to there move a few numbers per content.
    Pairs of one band are an equi-join, which is as large as the similar pairs of different sets are many.
    """
    if again is None:
        sets = cut_lineage(sets)
        again = lambda wanted, written=sets: written.dropDuplicates(["sha256"]).join(wanted, "sha256")
    signed = cut_lineage(_signed(sets, bands, rows))  # read three times
    equal = ["n", "key", "check", "_own"]
    keyed = signed.select("sha256", "n", "key", "check", F.when(F.col("n") > 0, "").otherwise(F.col("sha256")).alias("_own")).distinct()
    members = keyed.join(keyed.groupBy(*equal).agg(F.min("sha256").alias("content")), equal)
    members = cut_lineage(members.select("sha256", "content"))
    named = signed.filter("n > 0").dropDuplicates(["sha256"]).join(members.filter("sha256 = content").select("sha256"), "sha256")
    # numbers stand for names, which are longer than all else in a row
    named = cut_lineage(named.select(F.monotonically_increasing_id().alias("id"), F.col("sha256").alias("content"), "n", "bands"))
    banded = named.select("id", "n", F.explode("bands").alias("_hash"))
    side = lambda i, n: banded.select("_hash", F.col("id").alias(i), F.col("n").alias(n))
    met = side("x", "_nx").join(side("y", "_ny"), "_hash").filter("x < y")
    met = met.filter(F.least("_nx", "_ny") / F.greatest("_nx", "_ny") >= threshold).select("x", "y").distinct()
    met = cut_lineage(met)
    called = lambda i, name: named.select(F.col("id").alias(i), F.col("content").alias(name))
    counted = _counted(met, named.select("id", F.col("content").alias("sha256"), "n"), again)
    pairs = counted.withColumn("similarity", F.col("n_shared") / F.col("n_all")).filter(F.col("similarity") >= threshold)
    pairs = pairs.join(called("x", "_x"), "x").join(called("y", "_y"), "y")
    pairs = pairs.withColumn("a", F.least("_x", "_y")).withColumn("b", F.greatest("_x", "_y"))
    return members, pairs.select("a", "b", "n_shared", "n_all", "similarity")


def similar_families(files: DataFrame, threshold: float = 0.8, texts: DataFrame | None = None, **runs) -> DataFrame:
    """Family of each file by similarity, transitively: (rel_path, sha256, family). ``files``: rel_path, sha256, text.

    ``texts`` (sha256, text) has the texts of the files, if they can be read without what else ``files`` is made of.
    """
    texts = files if texts is None else texts
    sets = partial(run_sets, texts, common=common_runs(texts, **runs), **runs)
    members, pairs = similar_contents(sets(copies=True), threshold, again=lambda wanted: sets(only=wanted))
    nodes = members.select(F.col("content").alias("node")).distinct()
    found = connected_components(nodes, pairs).withColumnsRenamed({"node": "content", "component": "family"})
    return files.select("rel_path", "sha256").join(members, "sha256").join(found, "content").select("rel_path", "sha256", "family")
