"""The registered queries ``opN_<name>``: each applies one corpus operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import alignment, chat, exact, licenses, merkle, near, neighbours, packing, shards, toxicity, urls, viterbi, warc
from tickloom.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

BYTE_PAIRS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
SEQUENCE = 2048


def packed_documents(docs: DataFrame) -> DataFrame:
    cut = packing.pieces(docs.select("text", "doc_id"), "text", BYTE_PAIRS, SEQUENCE)
    return packing.pack(cut, SEQUENCE).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op1_packing")
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(table(spark, folder, "documents"))


@query("op6_near_duplicates")
def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "documents"))


@query(
    "op7_exact_duplicates",
    """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as plain from documents),
g as (select plain, max(doc_id) as keep_id, count(*) as group_size from t group by plain)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(plain) as text_sha256 from t join g using (plain)
""",
)
def op7_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"))


def held_out(id):
    return F.crc32(id.cast("string").cast("binary")) % 5 == 0


def toxicity_model(docs: DataFrame, labels: DataFrame):
    """Learned from labelled documents outside the held-out fold; rows are taken in an order set by a hash of the id."""
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("__label__"))
    learned = docs.join(known, "doc_id").filter(~held_out(F.col("doc_id")))
    return toxicity.fit(learned, label="__label__", order=F.xxhash64("doc_id"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs.select("text", "doc_id"), toxicity_model(docs, table(spark, folder, "labels")))
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(
    "op9_chat_format",
    r"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
f as (
    select *, regexp_matches(role || text, '<\|') or regexp_matches('x' || role || '<|text|>' || text || '<|end|>', 'x.*<\\*\|(text|end|turn).*<\|text\|>.*<\|text\|>') as esc from c
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(length('<|turn|>' || role || '<|text|>' || text || '<|end|>')) as bigint) as formatted_chars
from f group by conv_id
""",
)
def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    chats = chat.format_chats(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    turns, loss = chat.turns_text(F.col("turns")), chat.loss_text(F.col("turns"))
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The domain rules as (action, host, path).
DOMAIN_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op2_url_filters")
def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of documents are labels of the pages that show them: a page's URL holds the document's number. A page is
    bad when its document is toxic or of low quality."""
    pages, labels = table(spark, folder, "pages").select("page_id", "url"), table(spark, folder, "labels")
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    numbered = pages.withColumn("doc_id", F.regexp_extract(urls.path_of(F.col("url")), r"/(\d{1,18})(?:\D|$)", 1).try_cast("long"))
    rules = urls.mine(numbered.join(bad, "doc_id"))
    told = urls.judge(pages, rules, DOMAIN_RULES)
    return told.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"), F.col("__why").alias("mined_tokens"))


_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((('0x' || substr(d, {1 + 5 * i}, 5))::bigint >> {15 - 5 * j}) & 31 as int) + 1, 1)" for i in range(8) for j in range(4)
)


@query(
    "op3_warc",
    f"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as d from pages),
m as (select d, max(page_id) as head from p group by d)
select page_id, cast(strlen(h) as bigint) as payload_bytes, {_B32} as payload_digest,
    case when page_id = head then 'response' else 'revisit' end as record_type, case when page_id <> head then head end as refers_to
from p join m using (d)
""",
)
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: License notices and texts to look for; what tells a notice from its like is in braces.
LICENSES = {
    "Apache-2.0 notice": "Licensed under the {Apache} License, {Version 2}.0.",
    "MIT notice": "Released under the {MIT License}.",
    "BSD notice": "Released under the {BSD License}.",
    "GPL notice": "This work is licensed under the {GNU General} Public License.",
    "GPL-2.0 notice": "This work is licensed under the {GNU General} Public License, {version 2}.",
    "GPL-3.0 notice": "This work is licensed under the {GNU General} Public License, {version 3}.",
    "GPL-2.0 notice, v2": "This work is licensed under the {GNU General} Public License {v2}.",
    "GPL-3.0 notice, v3": "This work is licensed under the {GNU General} Public License {v3}.",
    "LGPL-2.1 notice": "This work is licensed under the {GNU Lesser} General Public License, {version 2.1}.",
    "LGPL-3.0 notice": "This work is licensed under the {GNU Lesser} General Public License, {version 3}.",
    "AGPL-3.0 notice": "This work is licensed under the {GNU Affero} General Public License, {version 3}.",
    "CC-BY-4.0 notice": "Licensed under {CC BY 4.0}.",
    "CC-BY-SA-4.0 notice": "Licensed under {CC BY-SA 4.0}.",
    "CC-BY-NC-4.0 notice": "Licensed under {CC BY-NC 4.0}.",
    "All rights reserved": "{All rights reserved}.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."
    ),
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."
    ),
}


@query("op4_licenses")
def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_spans(table(spark, folder, "documents").select("doc_id", "text"), LICENSES)


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    shown = F.replace(F.coalesce("text", F.lit("")), F.lit(viterbi.BLANK), F.lit(" "))
    docs = table(spark, folder, "documents").select("doc_id", "text", F.sha2(shown, 256).alias("source_sha256"))
    back = viterbi.decoded(viterbi.encoded(docs, model), model).withColumn("text_sha256", F.sha2("text", 256))
    return back.select("doc_id", "n_ids", "ids_crc32", "text_sha256", (F.col("text_sha256") == F.col("source_sha256")).alias("round_trip"))


@query("op10_neighbours")
def op10_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), "id % 20 = 0")


@query("op11_alignment")
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), BYTE_PAIRS, public_tokenizers.path("piece_bpe_32k.model"))


#: CRC-32 in SQL: the table of its 256 steps from the polynomial, and the fold of a list of bytes.
_CRC_TABLE = "(select list(v order by n) from (select n, list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(n)))"


def _crc_sql(text: str) -> str:
    digits = f"hex(encode({text}))"
    bytes_of = f"list_transform(range(strlen({text})), lambda i: cast('0x' || substr({digits}, cast(2 * i + 1 as int), 2) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_of}), lambda c, b: xor(steps[cast(xor(c, b) & 255 as int) + 1], c >> 8)), 4294967295)"


_ARCS = 24 * shards.VIRTUAL + 1


@query(
    "op12_shards",
    f"""
with recursive tab as (select {_CRC_TABLE} as steps),
t as (select doc_id, coalesce(text, '') as x from documents),
e as (select doc_id, cast(strlen(x) + 8 as bigint) as size, cast({_crc_sql('x')} as bigint) as crc, cast('0x' || substr(md5(x), 1, 15) as bigint) as place from t, tab),
placed as (select i % 24 as shard, cast('0x' || substr(md5('shard#' || (i % 24) || '#' || (i // 24)), 1, 15) as bigint) as place from range({_ARCS - 1}) r(i)),
ring as (select row_number() over (order by place, shard) - 1 as arc, shard, place from (select * from placed union all select arg_min(shard, place), 1::bigint << 60 from placed)),
line as (select *, row_number() over (order by place, doc_id nulls first) - 1 as rank from e),
ranked as (select line.doc_id, size, crc, rank, ring.arc from line asof join ring on line.place <= ring.place),
held as (select arc, count(*) as own, min(rank) as first from ranked group by arc),
a1 as (select arc, shard, first, coalesce(own, 0) as own from ring left join held using (arc)),
a2 as (select *, coalesce(sum(own) over (partition by shard order by arc rows between unbounded preceding and 1 preceding), 0) as prior, sum(own) over (partition by shard) as load, sum(own) over () as total from a1),
a3 as (select *, total // 24 + (shard < total % 24)::int as capacity from a2),
a4 as (select *, greatest(least(own, capacity - prior), 0) as stay, least(load, capacity) as kept from a3),
arcs as (select *, own - stay as surplus, capacity - kept as spare, coalesce(sum(own - stay) over (order by arc rows between unbounded preceding and 1 preceding), 0) as before from a4),
walk as (
    select 0 as step, 0::bigint as waiting, 0::bigint as taken, (select list(spare::bigint order by shard) from (select distinct shard, spare from arcs)) as room, 0::bigint as f, 0::bigint as t, 0::bigint as shard, 0::bigint as rest
    union all
    select step + 1, arr - g, taken + g, list_transform(room, lambda r, k: case when k = s + 1 then r - g else r end), taken, taken + g, s, room[s + 1]
    from (select w.step, w.taken, w.room, a.shard as s, (w.waiting + case when w.step < {_ARCS} then a.surplus else 0 end)::bigint as arr, least(arr, w.room[a.shard + 1])::bigint as g from walk w join arcs a on a.arc = w.step % {_ARCS} where w.step < {2 * _ARCS})
),
runs as (select f, t, shard, kept + spare - rest as slot from walk join (select distinct shard, kept, spare from arcs) using (shard) where step > 0 and t > f),
put as (select ranked.*, shard as owner, prior, stay, rank - first as r, case when rank - first >= stay then before + rank - first - stay end as ordinal from ranked join arcs using (arc))
select doc_id, size, crc as text_crc32, 'rows' as law, cast(coalesce(runs.shard, owner) as int) as shard,
    cast(case when ordinal is null then prior + r else runs.slot + ordinal - f end as bigint) as slot, null::int as grown_shard
from put left join runs on ordinal >= f and ordinal < t
""",
)
def op12_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.sharded(table(spark, folder, "documents"))


def _field(x: str) -> str:
    return f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"


_UP = "list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], '')))"
_BESIDE = """array_to_string(nodes[low + 1 : spot], '') as l, array_to_string(nodes[spot + 2 : low + 3], '') as r"""


@query(
    "op13_merkle",
    f"""
with recursive tab as (select {_CRC_TABLE} as steps),
d as (
    select doc_id, coalesce('s' || source, '') as k, sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} || {_field('text')}) as leaf,
        case when {_crc_sql('doc_id::varchar')} % 2 = 0 and contains(text, chr(10))
            then sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} || {_field("replace(text, chr(10), '')")}) end as changed
    from documents, tab
),
p as (select *, row_number() over () as rid, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as place from d),
lv as (select k, 0 as level, list(leaf order by place) as nodes from p group by k union all select k, level + 1, {_UP} from lv where len(nodes) > 1),
sub as (select k, nodes[1] as subroot, row_number() over (order by k) - 1 as number from lv where len(nodes) = 1),
tv as (select 0 as level, list(subroot order by k) as nodes from sub union all select level + 1, {_UP} from tv where len(nodes) > 1),
whole as (select nodes[1] as root from tv where len(nodes) = 1),
ways as (
    select rid, 0 as part, level, {_BESIDE} from (select rid, level, nodes, place // (3 ** level)::bigint as spot, spot - spot % 3 as low from p join lv using (k) where len(nodes) > 1)
    union all select rid, 1, level, {_BESIDE} from (select rid, level, nodes, number // (3 ** level)::bigint as spot, spot - spot % 3 as low from p join sub using (k), tv where len(nodes) > 1)
),
st as (select *, row_number() over (partition by rid order by part, level) as step from ways),
f as (select rid, 0 as step, coalesce(changed, leaf) as h from p union all select f.rid, f.step + 1, sha256(l || h || r) from f join st on st.rid = f.rid and st.step = f.step + 1),
top as (select rid, arg_max(h, step) as folded_root from f group by rid),
proof as (select rid, string_agg(l || r, '' order by step) as way from st group by rid)
select doc_id, leaf, subroot, root, sha256(coalesce(way, '')) as proof_sha256, folded_root, folded_root = root as verified
from p join sub using (k) join top using (rid) left join proof using (rid), whole
""",
)
def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, folder, "documents"))
