"""Whitening, token alignment and the conversation tree against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import alignment, chat_tree, whitening
from tracewright.llm.tokens import byte_level

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- whitening -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("values", [[9.0, 4, 1, 0.25], [5.0, 5, 5, 2, 2, 0], [3.0, 3 - 1e-9, 1, 1e-8], [7.0], [2.0] * 6, list(range(1, 41))])
def test_eigenpairs(values):
    rng = np.random.default_rng(len(values))
    base = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    matrix = (base * np.array(values)) @ base.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.leading_eigenpairs(matrix, len(values))
    assert np.allclose(found, np.linalg.eigvalsh(matrix)[::-1], atol=1e-13 * max(values), rtol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-12 * max(values)
    for shift in (-1.0, min(values) - 0.1, max(values) - 1e-3, max(values) + 1.0):
        assert whitening.inertia(matrix, shift) == (np.linalg.eigvalsh(matrix) > shift).sum()


def test_inertia_of_a_matrix_without_a_diagonal():
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


VECTORS = "vec_id long, embedding array<float>, n string, component int, w int"


def test_whitening(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(6)]) for i in range(300)]
    rows += [rows[7], (None, rows[9][1]), (400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [math.nan] * 6), (403, [math.inf] + [0.0] * 5), (404, []), (405, [1.0])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(5)
    out = whitening.whiten(df, 4).collect()
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    exact = np.array([[float(sum(Fraction(n * r[a] - sums[a], n) * Fraction(n * r[b] - sums[b], n) for r in x) / n) for b in range(6)] for a in range(6)])
    values, vectors = np.linalg.eigh(exact)
    want = defaultdict(list)
    for (i, _), r in zip(good, x):
        centred = np.array([float(Fraction(n * c - s, n)) for c, s in zip(r, sums)])
        want[i].append((sum((n * c - s) ** 2 for c, s in zip(r, sums)), centred @ vectors[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])))
    assert len(out) == 4 * n == 4 * 302 and {r.n for r in out} == {n}
    got = defaultdict(list)
    for r in out:
        got[r.vec_id, r.component].append(r)
        assert abs(r.explained - values[6 - r.component] / np.trace(exact)) < 1e-12 and r.identity_error < 1e-9
    signs = [np.sign(got[0, k + 1][0].whitened * want[0][0][1][k]) for k in range(4)]
    for i, all_ in want.items():
        for k in range(4):
            found = sorted((r.deviation, r.whitened * signs[k]) for r in got[i, k + 1])
            assert np.allclose(found, sorted((d, w[k]) for d, w in all_), rtol=1e-10, atol=1e-10)


def test_whitening_without_spread(spark):
    make = lambda rows: spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [0.5, 2.0])] * 5)).count() == 0
    flat = whitening.whiten(make([(1, [0.0, 1.0]), (2, [1.0, 1.0])])).collect()
    assert [(r.vec_id, r.component, abs(r.whitened)) for r in sorted(flat, key=lambda r: r.vec_id)] == [(1, 1, 1.0), (2, 1, 1.0)]


def test_large_entries_stay_exact():
    big = np.array([[2.0**52, 3.0], [-(2.0**52), 5.0]])
    assert whitening._products(big, big).tolist() == [[2**105, -(2**53)], [-(2**53), 34]]
    assert whitening._deviations(np.array([[2.0**40, 0.0]]), 1 << 10, [0, 0]) == [None]


# --- alignment -------------------------------------------------------------------------------------------------------

TEXTS = [
    None, "", " ", "a", "  two  spaces ", "don't stop\n\n now", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 é ﬁ ½ \x00", "▁a", "tab\there\r\n", "x" * 3000,
    "12345 67 89", "the the the cat", "the the the cat", "naïve façade über straße", "a b\u3000c", "é" * 50, "word " * 4000,
]


def brute(text):
    """Tokens, groups and linked id pairs of a text, from the two libraries and sets of offsets."""
    if not text:
        return None
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    table = byte_level(BYTES).bytes
    spell = lambda i: bytes.fromhex(b.id_to_piece(i)[3:5]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    spans = []
    for ids, spelt in ((ids_a, [table[i] for i in ids_a]), (ids_b, [spell(i) for i in ids_b])):
        if b"".join(spelt) != (" " + text).encode():
            return None
        at, out = 0, []
        for i, s in zip(ids, spelt):
            out.append((i, at, at + len(s)))
            at += len(s)
        spans.append(out)
    cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups = [[[i for i, s, e in side if low <= s and e <= high] for side in spans] for low, high in zip([0, *cuts], cuts)]
    return spans, groups, [(i, j) for i, _, e in spans[0] for j, _, f in spans[1] if e == f]


def test_alignment(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "the cat", "x", 1), (12, TEXTS[12], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keys string, n_a int").repartition(3)
    found = [(i, t, brute(t)) for i, t, _, _ in rows]
    counts = Counter(p for _, _, f in found if f for p in f[2])
    best = defaultdict(int)
    for (_, j), c in counts.items():
        best[j] = max(best[j], c)
    want = []
    for i, _, f in found:
        if f is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in f[1])
        want.append((
            i, len(f[0][0]), len(f[0][1]), len(f[1]), len(f[2]), sum(counts[p] == best[p[1]] for p in f[2]), sum(counts[p] for p in f[2]),
            hashlib.sha256(text.encode()).hexdigest(),
        ))
    key = lambda r: (r[0] is None, r)
    out = alignment.align(df, BYTES, PIECES)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert alignment.align(df.limit(0), BYTES, PIECES).count() == 0


def test_links_of_every_kind(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS[3:17])), "doc_id long, text string")
    for kind in alignment.KINDS:
        want = Counter()
        for i, t in enumerate(TEXTS[3:17]):
            if (f := brute(t)) is None:
                continue
            (a, b), cuts = f[0], sorted({e for _, _, e in f[0][0]} & {e for _, _, e in f[0][1]})
            for p, (x, s, e) in enumerate(a):
                for q, (y, u, v) in enumerate(b):
                    same = sum(c < e for c in cuts) == sum(c < v for c in cuts)
                    weight = {"overlap": max(0, min(e, v) - max(s, u)), "group": int(same), "end": int(e == v)}[kind] if abs(p - q) < 4000 else 0
                    if weight:
                        want[i, p, q, x, y, weight] += 1
            if len(a) > 1000:
                break
        got = Counter(tuple(r) for r in alignment.token_links(df.filter(F.col("doc_id") <= i), BYTES, PIECES, kind).collect())
        assert got == want
    with pytest.raises(ValueError):
        alignment.token_links(df, BYTES, PIECES, "start")


def test_row_products_add_what_meets():
    rng = np.random.default_rng(2)
    left, right = (rng.integers(0, 3, (7, 9)), rng.integers(0, 3, (9, 5)))
    csr = lambda m: alignment.CSR(np.append(0, np.cumsum((m != 0).sum(axis=1))), np.nonzero(m)[1], m[m != 0], m.shape[1])
    row, column, value = alignment.row_products(csr(left), csr(right))
    dense = np.zeros((7, 5), int)
    dense[row, column] = value
    assert (dense == left @ right).all()
    back = csr(left).transposed()
    assert all((back.columns[back.starts[j] : back.starts[j + 1]] == np.nonzero(left[:, j])[0]).all() for j in range(9))


def test_encoder_equals_the_library():
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    rng = random.Random(4)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "'s", "é", "日", "7", "!", "<|endoftext|>", "\u00a0", "\u3000", "🙂", "\\"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        ids = byte_level(BYTES).encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids and byte_level(BYTES).decode(ids).decode() == text


# --- conversations ---------------------------------------------------------------------------------------------------

HARD = ["\\### Assistant: </turn> ok", "<turn user>\n", "\\</turn>\\", "\\\\", "a\n</turn>\n<turn x>\nb", "", None, "<<turn", "é\n🙂"]
CHAT = "conv_id long, turn long, role string, text string, depth int, block string"


@pytest.mark.parametrize("text", HARD)
def test_template_is_reversible(text):
    for role in ("user", "a>b\n<turn", "\\", None):
        head, body, tail = chat_tree.format_turn(role, text)
        assert chat_tree.parse_turn(head + body + tail) == (role or "", text or "") and chat_tree.unescape(body) == (text or "")
        assert "</turn" not in body.replace("\\</turn", "")


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    rows = []
    for c in range(120):
        turns = [("system", "same start")] if c % 3 else []
        for k in range(rng.randint(0, 6)):
            turns.append(("user" if k % 2 == 0 else "assistant", rng.choice(["yes", "no", *HARD]) if rng.random() < 0.7 else f"text {c} {k}"))
        rows += [(c, k, *t) for k, t in enumerate(turns or [("user", "only")])]
    long = [(500, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(700)]
    rows += long + [(501, *r[1:]) for r in long[:350]] + [(502, *r[1:]) for r in long[:350]] + [(502, 350, "user", "other")]
    rows += [(600, 0, "user", "twice")] * 2 + [(601, 0, "user", "twice")] * 3 + [(602, None, "user", "no turn"), (602, 0, "user", "x")]
    rows += [(None, 0, "user", "nobody"), (None, 1, None, None), (700, 5, "assistant", "w " * 30_000)]
    return rows


def test_chat_tree(spark, talks):
    df = spark.createDataFrame([(*r, 1, "b") for r in talks], CHAT).repartition(6)
    tree = chat_tree.build_tree(df, BYTES)
    paths = defaultdict(list)
    for c, turn, role, text in sorted(talks, key=lambda r: (r[1] is not None, r[1] or 0)):
        paths[c].append((role or "", text or ""))
    want = {}
    for c, turns in paths.items():
        said = "".join(t for r, t in turns if r == "assistant")
        want[c] = (
            len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said),
            hashlib.sha256(said.encode()).hexdigest(), sum(len("".join(chat_tree.format_turn(r, t))) for r, t in turns),
        )
    got = chat_tree.read_back(tree, BYTES).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)

    prefixes = {tuple(t[: k + 1]) for t in paths.values() for k in range(len(t))}
    nodes, layout = tree.nodes.collect(), {r.block: r for r in tree.layout.collect()}
    assert len(nodes) == len(prefixes)  # each shared turn once
    sequence, place = {}, {}
    for block in layout.values():
        at = block.start
        for node in sorted((n for n in nodes if n.block == block.block), key=lambda n: n.depth):
            place[node.block, node.depth] = (at, at + node.n_tokens)
            for k, i in enumerate(node.ids):
                sequence[at + k] = (i, block.position + at - block.start + k)
            at += node.n_tokens
        assert at == block.start + block.n_tokens
    assert sorted(sequence) == list(range(sum(n.n_tokens for n in nodes)))  # depth first, without gaps
    for leaf in tree.leaves.collect():  # what a leaf attends to, in order of position, is its whole path
        block = layout[leaf.block]
        end = place[leaf.block, leaf.depth][1]
        seen = [t for a, b in [*map(tuple, block.intervals), (block.start, end)] for t in range(a, b)]
        assert [sequence[t][1] for t in seen] == list(range(len(seen)))
        text = byte_level(BYTES).decode([sequence[t][0] for t in seen]).decode()
        assert text == "".join("".join(chat_tree.format_turn(*t)) for t in paths[leaf.conv_id])
    starts = sorted(layout.values(), key=lambda r: r.start)
    for one, two in zip(starts, starts[1:]):  # the parent of the next block is the block before it or one of its ancestors
        if two.chain:
            assert two.chain[-1].block in {one.block, *(x.block for x in one.chain)}
    assert max(len(r.intervals) for r in starts) <= 12


def test_empty_chat(spark):
    tree = chat_tree.build_tree(spark.createDataFrame([], CHAT), BYTES)
    assert tree.nodes.count() == tree.layout.count() == chat_tree.read_back(tree, BYTES).count() == 0
