"""Packing, tokens, chat templates and toxicity against plain versions and held-out labels."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tickloom.llm import chat, packing, queries, toxicity
from tickloom.llm.tokens import BytePairs

ODD = ["", " ", "a", "  a\n\n b ", "don't  stop\t", "x" * 5000, "日本語 テキスト", "a\xa0 b", "   c", "🙂🙂 é", "tab\x0b\x0cx", "end ", "\r\n\r\n", "<|endoftext|> a", "\x1c x", "a\x85b"]


def test_ids_equal_the_library():
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab \n\t'é1.,日 　") for _ in range(rng.randrange(60))) for _ in range(400)]
    whole, fast = Tokenizer.from_file(queries.BYTE_PAIRS[0]), BytePairs(*queries.BYTE_PAIRS)
    for t in texts * 2:
        assert np.frombuffer(fast.encode(t), dtype="<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def check_packing(rows, docs):
    """Every document whole and in order, sequences gapless and within bounds; returns the number of sequences."""
    whole = Tokenizer.from_file(queries.BYTE_PAIRS[0])
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(by_doc[i]) == 1 or len(ids) > 2048)
        assert all(r.length == 2048 for r in by_doc[i] if r.piece > 0)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(by_sequence)


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(3)
    docs = {i: " ".join(f"word{rng.randrange(900)}" for _ in range(rng.choice([1, 30, 300, 900, 3000]))) for i in range(300)}
    docs |= {1000: None, 1001: "", 1002: "y " * 2046, 1003: "y " * 2047}
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in docs.items()], "doc_id long, text string, piece int, bin int").select("doc_id", "text")
    cut = packing.pieces(df, "text", queries.BYTE_PAIRS, 2048)
    one = packing.pack(cut, 2048).collect()
    tree = packing.pack(cut, 2048, group_pieces=20, fan_in=3).collect()
    least = -(-sum(r.length for r in one) // 2048)
    assert check_packing(one, docs) <= 1.02 * least
    assert check_packing(tree, docs) <= 1.04 * least
    assert packing.pack(cut.limit(0), 2048).count() == 0
    assert packing.pack(cut.union(cut), 2048).count() == 2 * cut.count()


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, source string, formatted string")


def test_chat_round_trip(spark):
    bits = ["<|end|>", "<|text|>", "<|turn|>", "<|turn:e|>", "<", "|", "\\", "<\\|", "<\\\\|end|>", "a", "\n", "end|>", "", "<|", "é"]
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "<|text|>", "", "sys<"]), "".join(rng.choice(bits) for _ in range(rng.randrange(7)))) for c in range(150) for t in range(rng.randrange(1, 5))]
    rows += [(None, 1, "user", "x"), (None, None, None, None), (500, 2, "assistant", "b"), (500, 2, "assistant", "a"), (500, 2, "assistant", "a"), (501, 1, "user", "z" * 200_000)]
    got = {r.conv_id: r for r in chat.format_chats(chats(spark, rows)).collect()}
    key = lambda v: (v is not None, v)
    for conv in {r[0] for r in rows}:
        want = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda v: (key(v[0]), v[1:]))
        assert [(t.role, t.text) for t in got[conv].turns] == [v[1:] for v in want]
    assert chat.format_chats(chats(spark, [])).count() == 0
    assert len({r.formatted for r in got.values()}) == len({tuple((t.role, t.text) for t in r.turns) for r in got.values()})


def test_chat_query(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = {r.conv_id: r for r in queries.op9_chat_format(spark, sf).collect()}
    for conv in {r.conv_id for r in rows}:
        turns = sorted((r.turn, r.role, r.text or "") for r in rows if r.conv_id == conv)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-7].n_turns == 2 and got[-7].loss_chars == 21


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.op8_toxicity(spark, folder).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    hits, wrong, toxic = sum(p and y for p, y in held), sum(p and not y for p, y in held), sum(y for _, y in held)
    assert hits >= 0.75 * toxic and wrong <= 0.03 * len(held)


def test_toxicity_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "x " * 300_000, None), (None, "bad bad", 1), (4, "good", 0)] * 3
    df = spark.createDataFrame([(*r, 1.0, "w") for r in rows], "doc_id long, text string, label int, f double, w string")
    p = toxicity.Ftrl(bits=12)
    out = toxicity.score(df, toxicity.fit(df, p=p), p=p).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out) and out[0].w == "w"
    empty = toxicity.fit(df.limit(0), p=p)
    assert {r.score for r in toxicity.score(df, empty, p=p).collect()} == {0.5}


@pytest.mark.parametrize("seed", [0, 1])
def test_best_fit_matches_plain(seed):
    sizes = np.random.default_rng(seed).integers(1, 2048, 400)
    place, offset, fills = packing.best_fit(sizes, 2048)
    bins = []
    for s in sorted(sizes, reverse=True):
        fitting = [i for i, b in enumerate(bins) if b + s <= 2048]
        if fitting:
            bins[max(fitting, key=lambda i: bins[i])] += s
        else:
            bins.append(s)
    assert sorted(fills) == sorted(bins)
    assert len(place) == len(set(zip(place, offset, strict=True)))
