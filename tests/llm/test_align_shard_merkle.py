"""Alignment, sharding and the Merkle manifest against plain versions, with nulls, repeats, clashing columns and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tickloom.llm import alignment, merkle, queries, shards

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CLASH = "row long, pairs string, key string, place long, rank int, slot int, leaf string, n_a int, arc int, number int, size int, block int, way string, at int"


def frame(spark, rows, schema="doc_id long, text string"):
    width = len(CLASH.split(","))
    return spark.createDataFrame([(*r, *[None] * width) for r in rows], f"{schema}, {CLASH}")


# -- op11 -------------------------------------------------------------------------------------


def plain_alignment(texts):
    """Whole texts by both libraries; links from the owner of every byte."""
    a_lib, b_lib = Tokenizer.from_file(queries.BYTE_PAIRS[0]), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a_lib.encode_special_tokens = True
    alphabet = alignment.byte_level()
    rows, held = [], Counter()
    for text in texts:
        row = ([], [], [], [])
        if text:
            want = (" " + text).encode()
            a = a_lib.encode(" " + text, add_special_tokens=False).ids
            b = b_lib.encode(text)
            ab = [bytes(alphabet[c] for c in a_lib.id_to_token(i)) for i in a]
            bb = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(ab) == want == b"".join(bb):
                owner_a = [k for k, p in enumerate(ab) for _ in p]
                owner_b = [k for k, p in enumerate(bb) for _ in p]
                links = sorted(set(zip(owner_a, owner_b, strict=True)))
                groups, x, y = [], [], []
                for at in range(len(want)):
                    x += [owner_a[at]] if owner_a[at] not in x[-1:] else []
                    y += [owner_b[at]] if owner_b[at] not in y[-1:] else []
                    last = at + 1 == len(want)
                    if last or owner_a[at + 1] != owner_a[at] and owner_b[at + 1] != owner_b[at]:
                        groups.append(",".join(str(a[k]) for k in x) + "|" + ",".join(str(b[k]) for k in y))
                        x, y = [], []
                row = (a, b, groups, [(a[i], b[j]) for i, j in links])
                held.update(set(row[3]))
        rows.append(row)
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [
        (len(a), len(b), len(g), len(k), sum(held[p] == most[p[0]] for p in k), sum(held[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for a, b, g, k in rows
    ]


TEXTS = [
    None, "", " ", "  ", "a", " a", "foo  bar\n baz \t\tx  ", "\nfoo", "ﬁ ½ Ａ é é", "<|endoftext|> </s> <s> <unk>", "a▁b", "x　 y", "tokenisation untokenizable internationalisation", "日本語のテキスト 🙂🙂", "\r\nline\r\n",
    "def f(x):\r\n    return {x};\r\n", "naïve café — “quoted”", "1234567 89,000.50", "a\x00b", "word " * 3000, "z" * 5000, "same text here", "same text here", "zero​width\x85next em",
]


@pytest.mark.parametrize("common", [200_000, 3, 0])
def test_alignment_matches_plain(spark, sf, common):
    own = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()] if common == 3 else []
    texts = TEXTS + own
    want = plain_alignment(texts)
    got = alignment.align(frame(spark, list(enumerate(texts))), queries.BYTE_PAIRS, MODEL, common=common).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], texts[r.doc_id]


def test_alignment_repeats_and_empty(spark):
    got = alignment.align(frame(spark, [(1, "same here"), (1, "same here"), (None, "same here")]), queries.BYTE_PAIRS, MODEL).collect()
    assert len(got) == 3 and {r.count_sum for r in got} == {3 * got[0].n_links} and {r.n_best for r in got} == {got[0].n_links}
    assert alignment.align(frame(spark, []), queries.BYTE_PAIRS, MODEL).count() == 0


def test_galloping_is_intersection():
    rng = random.Random(5)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(200), rng.randrange(0, 120))) for _ in range(2))
        assert [a[i] for i, _ in alignment.common_ranks(a, b)] == sorted(set(a) & set(b)) == [b[j] for _, j in alignment.common_ranks(a, b)]


# -- op12 -------------------------------------------------------------------------------------


def place(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def plain_shards(rows, count, virtual, slack=0.0):
    """Each row by itself, clockwise: own rows first, then the surplus from the head of its line."""
    nodes = sorted((place(f"shard#{s}#{c}"), s) for s in range(count) for c in range(virtual))
    nodes.append((1 << 60, nodes[0][1]))
    total, order = len(rows), sorted(rows, key=lambda r: (place(r[1] or ""), r[0] is not None, r[0] or 0))
    room = {s: max(total // count + (s < total % count), -(-int(round(total * (1 + slack) * 1e6)) // (count * 10**6)) if slack else 0) for s in range(count)}
    slots, put, line = Counter(), [], []
    arcs = defaultdict(list)
    for r in order:
        arcs[next(k for k, (p, _) in enumerate(nodes) if p >= place(r[1] or ""))].append(r)
    for k, (_, s) in enumerate(nodes):
        for r in arcs[k]:
            if room[s]:
                put.append((r[0], s, slots[s]))
                room[s] -= 1
                slots[s] += 1
            else:
                line.append((k, r))
    waiting = []
    for lap in range(2):
        for k, (_, s) in enumerate(nodes):
            waiting += [r for at, r in line if at == k and lap == 0]
            while waiting and room[s]:
                put.append((waiting.pop(0)[0], s, slots[s]))
                room[s] -= 1
                slots[s] += 1
    assert not waiting
    return sorted(put, key=repr)


def shard_rows(n=700):
    rng = random.Random(3)
    return [(i, None if i % 50 == 0 else "hot" if i % 3 == 0 else f"text é {rng.randrange(400)}") for i in range(n)]


@pytest.mark.parametrize("count, virtual, slack", [(24, 32, 0.0), (5, 4, 0.0), (7, 8, 0.25), (1, 3, 0.0)])
def test_shards_match_plain(spark, count, virtual, slack):
    rows = shard_rows()
    got = shards.sharded(frame(spark, rows), shards=count, virtual=virtual, slack=slack).collect()
    assert sorted(((r.doc_id, r.shard, r.slot) for r in got), key=repr) == plain_shards(rows, count, virtual, slack)
    texts = dict(rows)
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    loads = Counter(r.shard for r in got)
    if not slack:
        assert {r.law for r in got} == {"rows"} and len(loads) == count and max(loads.values()) - min(loads.values()) <= 1
    for s in loads:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(loads[s]))


def test_growing_moves_few_rows(spark):
    rows = [(i, f"text {i}") for i in range(4000)]
    before = {r.doc_id: r.shard for r in shards.sharded(frame(spark, rows), shards=24).collect()}
    after = {r.doc_id: r.shard for r in shards.sharded(frame(spark, rows), shards=25).collect()}
    assert sum(before[i] != after[i] for i in before) < 0.4 * len(rows)  # dealing by number modulo the count moves 96 %


def test_shards_repeats_and_empty(spark):
    got = shards.sharded(frame(spark, [(1, "a")] * 30 + [(None, None)] * 20)).collect()
    assert Counter(r.shard for r in got) == {s: 3 if s < 2 else 2 for s in range(24)}
    assert shards.sharded(frame(spark, [])).count() == 0


def test_shards_run_in_the_jvm(spark):
    plan = shards.sharded(frame(spark, shard_rows(50)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan


# -- op13 -------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    """Levels of a tree, the leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def beside(levels, at):
    for level in levels[:-1]:
        low = at - at % 3
        yield level[low:at], level[at + 1 : low + 3]
        at //= 3


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r, leaf_of(r)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = plain_tree([leaf for _, leaf in by[s]])
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for number, s in enumerate(names):
        for at, (r, leaf) in enumerate(by[s]):
            way = [*beside(trees[s], at), *beside(top, number)]
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            got = leaf_of((*r[:4], r[4].replace("\n", ""))) if bad else leaf
            for left, right in way:
                got = h(*left, got, *right)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], h(*(x for left, right in way for x in (*left, *right))), got, got == top[-1][0]))
    return sorted(out, key=repr)


def merkle_rows(n=400):
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot", "hot", "src1", "é", None, "", "single" if i == 7 else "Z"]), rng.choice(["en", None]), rng.choice([None, 5, -3]), rng.choice([None, "", "a\nb", "x", "é\n\n"])) for i in range(n)]
    rows.append((1 << 40, "long", "en", 1, "line\n" * 50_000))
    return rng.sample(rows, len(rows))


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("height", [1, 2, 3, 7])
def test_manifest_matches_plain(spark, height):
    rows = merkle_rows()
    got = merkle.merkle_manifest(frame(spark, rows, SCHEMA), height=height).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows)
    assert {r.verified for r in got} == {True, False}


def test_manifest_repeats_nulls_and_empty(spark):
    rows = [(None, None, None, None, None)] * 5 + [(1, "s", "en", 3, "a\nb")] * 4 + [(None, "s", "en", 1, "q\n")]
    got = merkle.merkle_manifest(frame(spark, rows, SCHEMA), height=1).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows)
    one = merkle.merkle_manifest(frame(spark, rows[-1:], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h("") and one.verified
    assert merkle.merkle_manifest(frame(spark, [], SCHEMA)).count() == 0


def test_addresses_fill_the_block_and_keep_subtrees_together():
    for levels in range(1, 8):
        found = np.concatenate([merkle.addresses(levels, d, np.arange(3**d)) for d in range(levels)])
        assert sorted(found.tolist()) == list(range(merkle.size_of(levels)))
    upper = 6 // 2
    first = [merkle.addresses(6, d, np.arange(3 ** (d - upper))) for d in range(upper, 6)]  # the first lower subtree
    lowest = min(int(v.min()) for v in first)
    assert sorted(np.concatenate(first).tolist()) == list(range(lowest, lowest + merkle.size_of(6 - upper)))
