"""Operators against brute force on a small table with nulls, empty and long texts, ties and repeated rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm.common import smallest_reachable
from tracewright.llm import decontaminate, line_dedup, packing, quality_rules, rans_store, sharding, simhash, tokens, url_lists

WORDS = [f"w{c}{d}ord".replace("w", "Mi" if c in "aeiou" else "to") for c in "abcdefghijkl" for d in "mnopqrstuv"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, shard string, length string, _n string"


def text_of(rng, n, per_line=9):
    words = [rng.choice(WORDS) + rng.choice(["", "", ",", ".", "!"]) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + per_line]) for i in range(0, n, per_line))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [None, "", "   ", "a", "two words", "three small words", "Four plain small words", " lead", "trail ", "a  b\n\n c\td", "é ñ ß. 12 %%"]
    texts += [text_of(rng, rng.randint(1, 150)) for _ in range(50)]
    base = text_of(rng, 300).split(" ")
    for k in range(30):  # near copies, some equal
        copy = list(base)
        if k % 3:
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    texts += [text_of(rng, 40_000), "same same " * 30, texts[20], texts[20]]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None]), len(t or ""), "x", "y", "z", "n") for i, t in enumerate(texts)]
    return [*out, out[25], (None, texts[30], "en", "s1", 3, "x", "y", "z", "n")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer(name):
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.encode_special_tokens = True
    return found


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- fingerprints ----------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    label = {n: n for n in nodes}

    def top(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in linked:
        a, b = top(a), top(b)
        label[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_near_duplicates(docs, rows):
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    fps = [(r[0], plain_fingerprint(r[1])) for r in rows]
    distinct = sorted({f for _, f in fps})
    linked = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4]
    assert linked
    classes = plain_components(distinct, linked)
    smallest = {c: min(i for i, f in fps if i is not None and classes[f] == c) for c in set(classes.values())}
    assert got == Counter((i, f, smallest[classes[f]]) for i, f in fps)


def test_links_find_every_pair(spark):
    rng = random.Random(3)
    fps = {0, 2**64 - 1}
    for _ in range(60):
        f = rng.getrandbits(64)
        fps |= {f} | {f ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 4, 4, 4, 4, 5, 6)}
    signed = {f - 2**64 if f >= 2**63 else f for f in fps}
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).distinct().collect()
    assert {(r["a"], r["b"]) for r in found} == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 4}


def test_anchors_stay_within_radius_and_threshold():
    fps = np.array([random.Random(1).getrandbits(64) for _ in range(50)], np.uint64)
    row, key, home = simhash.anchors(fps)
    assert Counter(row[home].tolist()) == {i: 3 for i in range(50)}
    assert len(set(zip(row.tolist(), key.tolist()))) == len(row)
    for r, k, h in zip(row.tolist(), key.tolist(), home.tolist()):
        i, j = [(0, 1), (0, 2), (1, 2)][k >> 48]
        block = lambda n: (int(fps[r]) >> simhash.BLOCKS[n][0]) & ((1 << (simhash.BLOCKS[n][1] - simhash.BLOCKS[n][0])) - 1)  # noqa: B023, E731
        d1, d2 = (block(i) ^ ((k >> 24) & 0xFFFFFF)).bit_count(), (block(j) ^ (k & 0xFFFFFF)).bit_count()
        assert max(0, d1 - 3) + max(0, d2 - 3) <= (0 if h else 2)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(90 - i, 89 - i) for i in range(30)] + [(200, 100), (100, 150), (7, 7)]])
def test_contraction(spark, edges):
    got = {r["node"]: r["root"] for r in smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain_components({n for a, b in edges if a != b for n in (a, b)}, [e for e in edges if e[0] != e[1]])


def test_one_of_each_group_stays(docs, rows):
    kept = [r["doc_id"] for r in simhash.representatives(docs).collect()]
    components = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(i for i in kept if i is not None) == sorted({c for i, c in components.items() if i is not None})
    assert kept.count(None) == 1 and simhash.representatives(docs).columns == docs.columns


# --- tokens ----------------------------------------------------------------------------------------------------------

ODD = [
    "", " ", "a", " a", "a ", "a  b", "a\n\nb", "\n", "a \nb", "a\n b c", "don't we'll  do", "x-y_z (q) [r] 3.5% 12", "é ́a", "Σας ΟΔΟΣ", "<|endoftext|> b",
    "\tq w\r\ne", "a\x1cb \x1c c", "日本 語 　 x", "A" * 300 + " B", "Ab.\nCd, Ex!!\nNo", "ÀÉ ñ! ªº µ ÿ ß. ÄÖ", "x\xad\xe9", "it's. a\n\n b", "İstanbul ǅ", "n.\n", "\nn",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_one_call(rows, name):
    ids, plain = tokens.TextIds(public_tokenizers.path(name), 4), tokenizer(name)
    for text in [*ODD, *[r[1] or "" for r in rows]]:
        assert np.frombuffer(ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text[:50])


@pytest.mark.parametrize("n", [1, 2, 511, 512, 513, 65_535, 65_536, 65_537, 150_001])
def test_coder_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 49_999).astype(np.int64)
    known, counts = np.unique(ids, return_counts=True)
    shares = rans_store.quantise(known, counts)
    assert shares.sum() == 1 << rans_store.SCALE_BITS and shares.min() >= 1
    table = rans_store.Table(known, shares)
    words, states, places = rans_store.encode(ids, table)
    assert (rans_store.decode(n, words, states, places, table) == ids).all()


def test_checksums_join():
    for a, b in [(b"", b""), (b"x", b""), (b"", b"y"), (b"hello", b"world" * 1000)]:
        assert rans_store.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_store(spark, docs, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(rans_store, "BLOCK_TOKENS", 1 << 14)  # the long text spans blocks
    path, plain = public_tokenizers.path("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.json")
    rans_store.write_store(docs, f"{tmp_path}/s", path)
    got = sorted(map(tuple, rans_store.read_documents(spark, f"{tmp_path}/s").collect()), key=lambda r: r[1])
    ids = [(r[0], plain.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows]
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((i, len(x), crc(x)) for i, x in ids)
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    block = spark.read.parquet(f"{tmp_path}/s/blocks").filter("n_tokens > 1000").first().asDict()
    block["words"] = bytes([block["words"][0] ^ 1]) + bytes(block["words"][1:])
    with pytest.raises(ValueError, match="damaged"):
        rans_store.block_ids(block, None)


def test_packing(docs, rows):
    plain = tokenizer("word_bpe_49k.json")
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    want = Counter()
    for r in rows:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.update((r[0], a, len(ids[a : a + 2048]), crc(ids[a : a + 2048]), len(ids)) for a in range(0, len(ids), 2048))
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048
    assert sorted(sequences) == list(range(len(sequences)))


def test_pack_lengths_uses_the_histogram():
    rng = random.Random(2)
    histogram = {n: rng.randint(1, 400) for n in rng.sample(range(1, 2049), 300)}
    patterns = packing.pack_lengths(histogram, 2048)
    used = Counter()
    for copies, lengths in patterns:
        assert sum(lengths) <= 2048 and list(lengths) == sorted(lengths, reverse=True)
        used.update({n: 0 for n in lengths})
        for n in lengths:
            used[n] += copies
    assert used == histogram and packing.pack_lengths({}, 2048) == []


# --- rules -----------------------------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\v\f\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_measures(docs, rows):
    extra = ["a b c d e a b c d e f", "x\nx\n x\n\n\n\t\n\x1c\n\x1c", "# * é|ñ <b> &amp;", "z " * 40, "\x85a b"]
    for text in [*extra, *[r[1] for r in rows]]:
        assert quality_rules.measure(text)[:5] == plain_measures(text), repr(text)[:60]
    labels = docs.sparkSession.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        n, _, _, _, repeated = plain_measures(next(x[1] for x in rows if x[0] == r["doc_id"]))
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n) and (not r["base_failed"] or not r["kept"])


def test_cutoffs_are_certified():
    assert abs(quality_rules.tail(10, 3, 0.5) - 176 / 1024) < 1e-12
    none = [0] * len(quality_rules.CUTOFFS)
    assert quality_rules.strictest_cutoff(50, none, 0.005, 0.01) is None  # too few labels to say so
    assert quality_rules.strictest_cutoff(5000, none, 0.005, 0.01) == quality_rules.CUTOFFS[-1]
    some = [0, 0, 1, 2, 900] + [0] * (len(none) - 5)  # a later pass does not mend an earlier failure
    assert quality_rules.strictest_cutoff(5000, some, 0.005, 0.01) == quality_rules.CUTOFFS[3]
    rng, wrong = np.random.default_rng(1), 0
    for _ in range(400):  # a true rate above the risk is let through no more often than allowed
        wrong += quality_rules.strictest_cutoff(2000, [int(rng.binomial(2000, 0.0051))] * 20, 0.005, 0.05) is not None
    assert wrong <= 40


def test_junk_is_rejected_where_labels_suffice(spark):
    rng = random.Random(4)
    good = [(i, text_of(rng, 60).replace("!", ""), "en") for i in range(3000)]
    bad = [(5000 + i, " ".join(w + "%%%" for w in text_of(rng, 60).split()), "en") for i in range(50)]
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string"), labels).collect()}
    assert not any(got[i] for i, _, _ in bad) and sum(got[i] for i, _, _ in good) >= 0.97 * len(good)


# --- leaks -----------------------------------------------------------------------------------------------------------


def test_leaks(spark, docs):
    item = "A farmer named Anna Lind has 12 apples and walks 5 km to the old market. There Anna Lind sells 7 apples for the price of a loaf"
    moved = item.replace("Anna Lind", "Bo").replace("12", "140").replace("5 km", "9km").replace("7", "31")
    mixed = moved.replace("There Bo", "There Eva")  # one name of the item stands for two
    merged = "In the town Kim met Ola and Kim saw how Ola took the red boat over the lake to the far side of the wood"
    cases = [
        (1, f"Some words before this. {item} and more after it"), (2, f"Other text here. {moved} until the end"), (3, f"Other text here. {mixed} until the end"),
        (4, " ".join(item.split()[:9])), (5, text_of(random.Random(1), 500)), (6, None), (7, ""), (8, f"Well. {merged}"), (9, f"Well. {merged.replace('Ola', 'Kim')}"),
        (1, f"Some words before this. {item} and more after it"), (10, "the short item of six words stands here"), (None, item),
    ]
    benchmark = spark.createDataFrame([(70, item), (71, merged), (72, "Short item of six words stands"), (73, None), (74, ""), (75, "two words")], "item_id long, text string")
    frame = spark.createDataFrame(cases, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, benchmark).collect()}
    assert got == {(1, 70), (2, 70), (8, 71), (10, 72), (None, 70)}
    assert decontaminate.leaks(frame, benchmark.limit(0)).count() == 0 and decontaminate.leaks(frame.limit(0), benchmark).count() == 0
    kept = [r["doc_id"] for r in decontaminate.without_leaks(frame, benchmark).collect()]
    assert sorted(i for i in kept if i is not None) == [3, 4, 5, 6, 7, 9]
    assert decontaminate.leaks(docs, benchmark).count() == 0


# --- shards, lines, lists --------------------------------------------------------------------------------------------


def test_sharding(docs, rows, spark):
    got = sharding.shard_documents(docs, [1.0] * 8, [1.0] * 9).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    for shard in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    many = spark.range(80_000).withColumn("a", sharding.rendezvous("id", [1.0, 2.0, 0.0, 5.0]))
    shares = {r["a"]: r["count"] / 10_000 for r in many.groupBy("a").count().collect()}
    assert set(shares) == {0, 1, 3} and all(abs(shares[s] - w) < 0.2 for s, w in ((0, 1), (1, 2), (3, 5)))
    with pytest.raises(ValueError):
        sharding.rendezvous("id", [0.0])


def test_line_dedup(spark, docs, rows):
    pages = [(f"p{i}", "a.org", f"Head\nunique line {i}\n\n{'Foot' if i % 8 == 0 else 'x' + str(i)}\nHead") for i in range(40)]
    pages += [("copy", "a.org", "only copies\nhold this")] * 60 + [("q", None, "Head"), ("r", "a.org", None), ("s", "b.org", "Head\nHead"), ("t", "a.org", "")]
    frame = spark.createDataFrame(pages, "id string, site string, text string").withColumn("_lines", F.lit(1)).withColumn("n_lines", F.lit("x"))
    got = line_dedup.drop_boilerplate(frame.drop("_lines"), "site").collect()
    assert len(got) == len(pages)
    texts = {r["id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got}
    assert texts["p1"] == ("unique line 1\n\nx1", 5, 2)
    assert texts["p8"] == ("unique line 8\n\nFoot", 5, 2)  # on a tenth of the distinct pages, but on fewer than ten of them
    assert texts["copy"] == ("only copies\nhold this", 2, 0) and texts["q"] == ("Head", 1, 0) and texts["r"] == (None, 0, 0)
    assert texts["s"] == ("Head\nHead", 2, 0) and texts["t"] == ("", 1, 0)
    assert line_dedup.drop_boilerplate(docs, "source").count() == len(rows)


def test_url_lists(spark):
    day = lambda n: f"2024-{1 + n // 28:02d}-{1 + n % 28:02d}"
    rng = random.Random(9)
    keys = ["a.org", "x.a.org", "b.org", "b.org/news", "c.net"]
    entries = [(rng.choice("LM"), rng.choice(["block", "allow"]), rng.choice(keys), rng.choice(["add", "remove"]), day(rng.randrange(300))) for _ in range(120)]
    entries += [entries[0], ("L", "block", None, "add", day(1)), ("L", "other", "a.org", "add", day(1)), ("L", "block", "a.org", "add", None)]
    urls = ["http://x.a.org/", "https://b.org/news/1?q", "https://B.org:8080/old", "http://c.net", "no url", None, "http://deep.x.a.org/b"]
    captures = [(i, urls[i % len(urls)], day(rng.randrange(300)) if i % 50 else None) for i in range(300)] + [(0, urls[0], None)]
    frame = spark.createDataFrame(entries, "list string, kind string, key string, action string, day string").withColumn("day", F.col("day").cast("date"))
    asked = spark.createDataFrame(captures, "id long, url string, fetched_on string").withColumn("fetched_on", F.col("fetched_on").cast("date"))
    got = Counter((r["id"], r["verdict"], r["matched_key"], r["matched_list"], r["n_entries"]) for r in url_lists.evaluate(asked, frame).collect())
    state = defaultdict(dict)
    for name, kind, key, action, at in entries:
        if key and at and kind in ("block", "allow"):
            state[name, kind, key][at] = state[name, kind, key].get(at, False) or action == "add"
    names = {"http://x.a.org/": ["x.a.org", "a.org"], "https://b.org/news/1?q": ["b.org", "b.org/news"], "https://B.org:8080/old": ["b.org", "b.org/old"], "http://c.net": ["c.net"], "http://deep.x.a.org/b": ["deep.x.a.org", "x.a.org", "a.org", "deep.x.a.org/b"]}
    want = Counter()
    for i, url, at in captures:
        active = []
        for (name, kind, key), changes in state.items():
            past = [d for d in changes if at and d <= at]
            if key in names.get(url, []) and past and changes[max(past)]:
                active.append((-len(key), kind, key, name))
        best = min(active, default=(0, "none", None, None))
        want[i, best[1], best[2], best[3], len(active)] += 1
    assert got == want
    assert url_lists.evaluate(asked, frame.limit(0)).filter("verdict <> 'none'").count() == 0 and url_lists.evaluate(asked.limit(0), frame).count() == 0


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    frames = [
        simhash.near_duplicates(empty), simhash.representatives(empty), quality_rules.judge(empty, labels), packing.pack(empty, path),
        rans_store.store_and_read(empty, path), sharding.shard_documents(empty, [1.0], [1.0, 1.0]), line_dedup.drop_boilerplate(empty, "source"),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
