"""The stages of the corpus pipeline, and the whole run, against plain versions on planted documents."""

import itertools
import random
from collections import Counter

import corpus_pipeline
from tokenizers import Tokenizer

from tests.llm.test_exact_near import lower
from tests.llm.test_pack_chat_tox import check_packing
from tickloom.llm import near, queries


def planted():
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = [(i, text(60)) for i in range(200)]
    rows += [(1000 + i, f"{text(20)} venom slur hate {text(20)}") for i in range(150)]
    rows += [(2000 + i, rows[i][1].upper()) for i in range(30)]  # copies but for case
    rows += [(3000 + i, f"{rows[100 + i][1]} tail{i}") for i in range(30)]  # near copies
    rows += [(4000, None), (4001, ""), (4002, "  "), (None, text(40)), (None, text(40)), (None, rows[199][1])]
    rows += [(5000, text(50)), (5000, text(50)), (5001, rows[198][1]), (5001, rows[198][1]), (5002, text(2500))]
    return rows, [(i, 1, int(1000 <= i < 2000)) for i, _ in rows if i is not None and i < 2000]


def plain_clean(rows):
    return [(i, t) for i, t in rows if "venom" not in (t or "")]


def plain_winners(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    return [(max((i for i in ids if i is not None), default=None), t) for t, ids in groups.items()]


def plain_apart(rows):
    sets, parent = [near.shingle_set(t or "", 5) for _, t in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and None not in (rows[a][0], rows[b][0]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent = [parent[a] if p == parent[b] else p for p in parent]
    least = {}
    for (i, _), p in zip(rows, parent, strict=True):
        least[p] = i if p not in least else min(i, least[p])
    return [(i, t) for (i, t), p in zip(rows, parent, strict=True) if i == least[p]]


def seen(df):
    return Counter((r.doc_id, lower(r.text)) for r in df.collect())


def told(rows):
    return Counter((i, lower(t)) for i, t in rows)


def test_stages_match_plain(spark, tmp_path):
    rows, labels = planted()
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, stages = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus_pipeline.STAGES)
    plain = rows
    for name, version in (("toxicity", plain_clean), ("exact dedup", plain_winners), ("near dedup", plain_apart)):
        kept = stages[name](spark, docs, folder)
        assert kept.columns == docs.columns
        before, plain = len(plain), version(plain)
        assert seen(kept) == told(plain) and len(plain) < before, name
        kept.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    ids = Counter(i for i, _ in plain)
    single = docs.filter(docs.doc_id.isNotNull() & (docs.doc_id != 5000))
    check_packing(stages["packing"](spark, single, folder).collect(), {r.doc_id: r.text for r in single.collect()})
    whole, wanted, got = Tokenizer.from_file(queries.BYTE_PAIRS[0]), Counter(), Counter()
    for r in docs.collect():
        wanted[r.doc_id] += len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r.doc_id] += r.length
    assert got == wanted and set(got) == set(ids)
    empty = docs.limit(0)
    assert all(stages[name](spark, empty, folder).count() == 0 for name in stages)
