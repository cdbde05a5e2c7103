"""Benchmark decontamination by templates: numbers, names and units become typed slots before windows are matched."""

from __future__ import annotations

import re
import string
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import Remembered, arrow_types, map_arrow, mix, word_list

WINDOW = 8  # template tokens of a window
MIN_LITERALS = 4  # words among them that are no slot; with fewer, a window is of values, so that only the same ones match
MIN_RUN = 13  # template tokens in a row that make a leak, or the whole item if it is shorter
FILTER_BITS = 26  # the windows of the benchmark, as a table of bits of fixed size
LITERAL, NUMBER, MEASURE, NAME = range(4)
NUMBER_WORDS = set("zero two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
UNITS = set(
    "mm cm m km in ft yd mi g kg mg t lb lbs oz l ml s sec min h hr hrs ms hz khz mhz ghz w kw v a j k c f usd eur gbp cents dollars euros"
    " pounds percent meters metres kilometers kilometres centimeters miles inches feet yards grams kilograms liters litres seconds minutes"
    " hours days weeks months years degrees".split()
)
GLUED = re.compile(r"([$€£]?[+-]?\d[\d.,:/]*)([a-z%°]*)")
MARKS = string.punctuation.replace("$", "").replace("%", "").replace("+", "").replace("-", "") + "«»“”„’‘¿¡…–—"
VALUES = np.uint64(0xA0761D6478BD642F)  # tells windows of values from those of templates
ROWS = "doc_key long, doc_id long, start int, length int, at int, hash long, slots array<string>"


def _word(raw: bytes) -> bytes:
    """kind, whether a unit, whether capitalised, whether it ends a sentence, and the hash of its template token."""
    text = raw.decode()
    core = text.strip(MARKS)
    low = core.lower()
    glued = GLUED.fullmatch(low)
    if glued:
        kind = MEASURE if glued[2] in UNITS or glued[2] in ("%", "°") or glued[1][0] in "$€£" else LITERAL if glued[2] else NUMBER
    else:
        kind = NUMBER if low in NUMBER_WORDS else LITERAL
    capital = core[:1].isupper() and kind == LITERAL
    # the last field is zero for a word of marks only, which is no token
    return struct.pack("<QQ", (kind | (low in UNITS) << 2 | capital << 3 | (text[-1] in ".!?:") << 4), xxhash.xxh64_intdigest(low) | 1 if core else 0)


SLOT_HASH = np.array([0, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03], np.uint64)


FACTOR = np.uint64(0x9E3779B97F4A7C15)
NO_TOKEN = struct.pack("<Q", 0)


class Tokens(NamedTuple):
    """Words of a text, and for each template token its hash, kind, first word and the word after its last; hashes of the
    words that count and where each token begins among them; for each word that would be a literal if the text began with it,
    but is none here, its token, place and hash, and whether its token has more words."""

    words: list[bytes]
    hashes: np.ndarray
    kind: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    each: np.ndarray
    begin: np.ndarray
    fresh_token: np.ndarray
    fresh_word: np.ndarray
    fresh_hash: np.ndarray
    fresh_more: np.ndarray


class Templates:
    """Template tokens and windows of texts; words are looked at once per worker."""

    def __init__(self) -> None:
        self.words = Remembered(_word)

    def tokens(self, text: str | None) -> Tokens:
        words = word_list(text)
        if not words:
            none = np.empty(0, np.int64)
            return Tokens(words, none.astype(np.uint64), none, none, none, none.astype(np.uint64), none, none, none, none.astype(np.uint64), none)
        raw = np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u8").reshape(-1, 2)
        flags, hashes = raw[:, 0].astype(np.int64), raw[:, 1]
        real = np.flatnonzero(hashes)
        ends = np.concatenate([[True], ((flags >> 4) & 1)[:-1].astype(bool)])[real]
        flags, hashes = flags[real], hashes[real]
        alone = flags & 3
        kind = np.where(((flags >> 3) & 1).astype(bool) & ~ends & (alone == LITERAL), NAME, alone)
        before = np.concatenate([[-1], kind[:-1]])
        unit = ((flags >> 2) & 1).astype(bool) & (before == NUMBER)
        first = ~unit & ~((kind == NAME) & (before == NAME))
        fresh = np.flatnonzero((kind != alone) | (unit & (alone == LITERAL)))  # literals, were they the first word of a text
        kind[np.flatnonzero(unit) - 1] = MEASURE
        at = np.flatnonzero(first)
        stop = np.concatenate([real[at[1:]], [len(words)]]) if len(at) else at
        kind = kind[at]
        token, more = np.searchsorted(at, fresh, "right") - 1, ~np.append(first, True)[fresh + 1]
        return Tokens(
            words, np.where(kind == LITERAL, hashes[at], SLOT_HASH[kind]), kind, real[at], stop, hashes, at, token, real[fresh], hashes[fresh], more
        )

    @staticmethod
    def fresh_heads(t: Tokens, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fresh words and the hashes of the windows that begin at them; the hash of a window of values is not made, but told."""
        which, hashes, poor = [], [], []
        for more in (False, True):
            k, used = np.flatnonzero(t.fresh_more == more), 1 + more
            k = k[t.fresh_token[k] + length - used < len(t.hashes)] if length >= used else k[:0]
            total, literals = np.uint64(length) * FACTOR + t.fresh_hash[k], np.ones(len(k), np.int64)
            if more:
                total = total * FACTOR + SLOT_HASH[NAME]
            for j in range(1, length - used + 1):
                total = total * FACTOR + t.hashes[t.fresh_token[k] + j]
                literals += t.kind[t.fresh_token[k] + j] == LITERAL
            which.append(k)
            hashes.append(mix(total))
            poor.append(literals < MIN_LITERALS)
        return np.concatenate(which), np.concatenate(hashes), np.concatenate(poor) & (length >= MIN_LITERALS)

    def fresh(self, t: Tokens, k: int, limit: int) -> Tokens:
        """The first ``limit`` tokens of the text that begins at the k-th fresh word, read as if nothing came before it."""
        token, word, end = int(t.fresh_token[k]), int(t.fresh_word[k]), int(t.stop[t.fresh_token[k]])
        hashes, kinds, firsts, stops = [t.fresh_hash[k]], [LITERAL], [word], [word + 1]
        each, begin = [self.words[t.words[word]][8:]], [0]
        rest = [w for w in range(word + 1, end) if self.words[t.words[w]][8:] != NO_TOKEN]
        if rest:  # the other words of a name it began or was in
            hashes, kinds, firsts, stops = [*hashes, SLOT_HASH[NAME]], [LITERAL, NAME], [word, rest[0]], [rest[0], end]
            each, begin = each + [self.words[t.words[w]][8:] for w in rest], [0, 1]
        more = slice(token + 1, token + 1 + limit)
        join = lambda head, tail: np.concatenate([np.array(head, tail.dtype), tail[more]])[:limit]
        at = t.begin[token + 1] if token + 1 < len(t.begin) else len(t.each)
        to = t.begin[token + 1 + limit] if token + 1 + limit < len(t.begin) else len(t.each)
        none = t.fresh_token[:0]
        return Tokens(
            t.words, join(hashes, t.hashes), join(kinds, t.kind), join(firsts, t.first), join(stops, t.stop),
            np.concatenate([np.frombuffer(b"".join(each), "<u8"), t.each[at:to]]), np.concatenate([begin, t.begin[more] - at + len(each)]),
            none, none, t.fresh_hash[:0], none,
        )

    def windows(self, t: Tokens, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, hashes, and whether of values, of the windows of ``length`` tokens.

        A window with fewer than MIN_LITERALS literal words is one of values, and has as many tokens at least.
        """
        n = len(t.hashes) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
        total, literals = np.full(n, length, np.uint64), np.zeros(n, np.int64)
        for j in range(length):
            total = total * FACTOR + t.hashes[j : j + n]
            literals += t.kind[j : j + n] == LITERAL
        poor = literals < MIN_LITERALS
        found = mix(total)
        if length < MIN_LITERALS:
            at = np.flatnonzero(~poor)
        else:
            at, few = np.arange(n), np.flatnonzero(poor)
            if len(few):
                values, valued = np.add.reduceat(mix(t.each), t.begin), np.full(len(few), np.uint64(length) ^ VALUES)
                for j in range(length):
                    valued = valued * FACTOR + values[few + j]
                found[few] = mix(valued)
        return at, found[at], poor[at]

    @staticmethod
    def slots(t: Tokens, at: int, length: int) -> list[str]:
        """Type and value of each slot of a window."""
        return [
            f"{'.#%@'[t.kind[i]]}{b' '.join(t.words[t.first[i] : t.stop[i]]).decode().strip(MARKS).lower()}"
            for i in range(at, at + length)
            if t.kind[i] != LITERAL
        ]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, length, at, hash, slots, valued, n_windows, n_all, n_tokens): all windows of each item, one of its whole length if it is short.

    ``n_windows`` counts those that are not of values, ``n_all`` both. An item of fewer than MIN_LITERALS tokens has one row
    without a hash: it can't be told from chance and matches nothing.
    """
    schema = "item_id long, length int, at int, hash long, slots array<string>, valued boolean, n_windows int, n_all int, n_tokens int"
    arrow = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            out = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = templates.tokens(text)
                length = min(WINDOW, len(t.hashes))
                at, found, valued = templates.windows(t, length) if length else ([], np.empty(0, np.uint64), np.empty(0, bool))
                out += [
                    (item_id, length, int(a), int(h), templates.slots(t, int(a), length), bool(v), int((~valued).sum()), len(at), len(t.hashes))
                    for a, h, v in zip(at, found.view(np.int64), valued, strict=True)
                ] or [(item_id, length, None, None, [], None, 0, 0, len(t.hashes))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return map_arrow(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")), run, schema)


def items_left_out(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_tokens): the items that get no window, so that no document can be found to hold them."""
    return item_windows(benchmark).filter("hash is null").select("item_id", "n_tokens")


def _filter_bits(items: DataFrame) -> np.ndarray:
    """Bits set for the hashes of the benchmark; 2 ** FILTER_BITS of them whatever its size."""
    slot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    words = items.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(hash, %d) & 63 as int))" % (64 - FILTER_BITS))).alias("bits")
    )
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for row in words.toLocalIterator():
        bits[row["word"]] = np.int64(row["bits"]).view(np.uint64)
    return bits


def document_windows(docs: DataFrame, bits: np.ndarray, lengths: list[int], longest: int) -> DataFrame:
    """Windows of every whole text that may be in the benchmark: the table of bits lets no true one go.

    ``start`` is zero. An item may begin at a word that its place in the text makes a name or a unit; windows of the text
    from there on, as the item reads it, have the word's place as their ``start`` and count from it, over ``longest`` tokens.
    """
    arrow = arrow_types(ROWS)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, bits = Templates(), shared.value

        def set_in(found: np.ndarray) -> np.ndarray:
            slot = found >> np.uint64(64 - FILTER_BITS)
            return ((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)

        def known(t: Tokens, length: int) -> tuple[np.ndarray, np.ndarray]:
            at, found, _ = templates.windows(t, length)
            may = np.flatnonzero(set_in(found))
            return at[may], found[may].view(np.int64)

        for batch in batches:
            out = []
            for doc_id, text, key in zip(*batch.columns, strict=True):
                doc_id, text, key = doc_id.as_py(), text.as_py(), key.as_py()
                t = templates.tokens(text)
                streams, begun = [(0, t)], set()
                for length in lengths if len(t.fresh_token) else []:
                    k, found, poor = templates.fresh_heads(t, length)
                    begun.update(k[poor | set_in(found)].tolist())
                for k in begun:
                    head = templates.fresh(t, k, max(lengths))
                    if any(len(x := known(head, n)[0]) and x[0] == 0 for n in lengths):  # an item may begin here
                        streams.append((int(t.fresh_word[k]), templates.fresh(t, k, longest)))
                for start, s in streams:
                    for length in lengths:
                        for a, h in zip(*known(s, length), strict=True):
                            out.append((key, doc_id, start, length, int(a), int(h), templates.slots(s, int(a), length)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key()), run, ROWS)


def text_key() -> Column:
    """Tells rows of one doc_id, or of none, apart."""
    return F.xxhash64(F.col("text").cast("string"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_item_windows, n_slots): the documents that hold an item or a long run of it.

    A leak is a run on one alignment of document and item, of MIN_RUN template tokens or the whole item, in which every
    value of an item's slot stands for one value throughout (and, for names, no two for the same). Null and empty texts
    leak nothing. Rows that repeat a doc_id are looked at each and give one row per item. A null doc_id is reported as null.
    """
    return sound_runs(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.max("found").alias("n_windows"), F.max("n_item_windows").alias("n_item_windows"), F.max(F.coalesce("n_slots", F.lit(0))).alias("n_slots")
    )


def sound_runs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_key, doc_id, item_id, start, shift, found, n_item_windows, n_slots): the runs that make leaks."""
    items = cut_lineage(item_windows(benchmark).filter("hash is not null"))
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # WINDOW of them at most
    longest = items.agg(F.max("n_tokens")).first()[0] or 0
    found = document_windows(docs, _filter_bits(items), lengths, longest)
    wanted = items.select(
        "item_id", "n_windows", "n_all", "valued", F.col("length").alias("_length"), F.col("at").alias("_at"), F.col("hash").alias("_hash"), F.col("slots").alias("_slots")
    )
    hits = found.join(wanted, (F.col("hash") == F.col("_hash")) & (F.col("length") == F.col("_length"))).select(
        "doc_key", "doc_id", "start", "item_id", "n_windows", "n_all", "valued", (F.col("at") - F.col("_at")).alias("shift"), "_at", "slots", "_slots"
    )
    alike = F.when(F.col("valued"), F.col("slots") == F.col("_slots")).otherwise(F.size("slots") == F.size("_slots"))
    hits = cut_lineage(hits.filter(alike & ((F.col("start") == 0) | (F.col("shift") == 0))))
    run = ["doc_key", "doc_id", "item_id", "start", "shift"]
    # the number of slots of a run is bounded by the item's length
    slots = hits.select(*run, F.explode(F.arrays_zip(F.col("_slots").alias("theirs"), F.col("slots").alias("ours"))).alias("s")).select(
        *run, "s.theirs", "s.ours"
    ).distinct()
    forward = slots.groupBy(*run, "theirs").agg(F.count(F.lit(1)).alias("n")).groupBy(*run).agg(F.max("n").alias("_many"), F.count(F.lit(1)).alias("n_slots"))
    names = slots.filter(F.col("ours").startswith("@")).groupBy(*run, "ours").agg(F.count(F.lit(1)).alias("n")).groupBy(*run).agg(F.max("n").alias("_merged"))
    places = hits.groupBy(*run, "_at").agg(F.min(F.col("valued").cast("int")).alias("valued"), F.max("n_windows").alias("n"), F.max("n_all").alias("n_all"))
    runs = places.groupBy(*run).agg(
        F.sum(1 - F.col("valued")).alias("plain"), F.count(F.lit(1)).alias("all"), F.max("n").alias("n"), F.max("n_all").alias("n_all")
    )
    least = lambda n: F.least(F.lit(MIN_RUN - WINDOW + 1), F.col(n))
    enough = ((F.col("n") > 0) & (F.col("plain") >= least("n"))) | (F.col("all") >= least("n_all"))
    # an item that has windows of values alone is counted by them
    runs = runs.filter(enough).select(
        *run, F.when(F.col("n") > 0, F.col("plain")).otherwise(F.col("all")).alias("found"), F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("n_all")).alias("n_item_windows")
    )
    same = lambda other: [runs[c].eqNullSafe(other[c]) for c in run]
    checked = runs.join(forward, same(forward), "left").select(*[runs[c] for c in run], "found", "n_item_windows", "_many", "n_slots")
    checked = checked.join(names, [checked[c].eqNullSafe(names[c]) for c in run], "left").select(*[checked[c] for c in checked.columns], "_merged")
    return checked.filter((F.coalesce("_many", F.lit(1)) == 1) & (F.coalesce("_merged", F.lit(1)) == 1))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, each row by its own text, whether it has a doc_id or shares one."""
    bad = sound_runs(docs, benchmark).select(F.col("doc_id").alias("_leaky"), F.col("doc_key").alias("_key")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_leaky")) & (text_key() == F.col("_key")), "left_anti")
