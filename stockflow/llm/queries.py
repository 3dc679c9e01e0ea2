"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import os
import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm import (
    bpe, decontaminate, exact_dedup, line_dedup, merkle, minhash, prefix_trie, rules, secret_scan, sharding, suffix_dedup, toxicity,
    warc,
)
from stockflow.llm.common import table, whole_text
from stockflow.session import shared_folder

#: folder of the public tokenizer files
TOKENIZERS = os.environ.get("TOKENIZERS") or os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def sha256(text) -> F.Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those deleted (0-based, comma-joined), and the digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn("n_lines", F.size(F.split(whole_text("text"), "\n")).cast("long"))
    done = line_dedup.deduplicate(counted, words=line_dedup.PASSAGE_WORDS)
    return done.select(
        "doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"),
        F.concat_ws(",", F.col("removed_lines").cast("array<string>")).alias("removed"), sha256(whole_text("text")).alias("kept_sha256"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind in secret_scan.KINDS], sha256(listed("base")).alias("base_sha256"), listed("spans").alias("spans"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade's verdicts; counts that it had no need of are made afterwards, so each is made once."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = rules.cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), report=counts)
    failed = rules.base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return judged.select("doc_id", *counts, failed.alias("base_failed"), "kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), digest=True)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        sha256(F.concat_ws(",", "items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: class_id, the smallest doc_id of its class of near copies, and whether it stands for the class."""
    found = minhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", digests=True)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a new folder beside the checkpoints and read back; refers_to is the response's page_id."""
    folder = shared_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"), columns=["doc_id"])


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document, by the CRC of its id, is checked as if the capitals A-Z of its text had been changed."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [F.translate(c, string.ascii_uppercase, string.ascii_lowercase) if c == "text" else F.col(c) for c in fields]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    seen = F.when(tampered, merkle.leaf(*changed)).otherwise(merkle.leaf(*map(F.col, fields)))
    proved = merkle.prove(docs, fields, seen)
    return proved.select(
        F.col("_row.id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


OP1_SQL = r"""
with lines as (
  select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as i
  from documents
), kept as (
  select doc_id, i, x, row_number() over w as r, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n,
         sum(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) over w as upto
  from (select doc_id, i, trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) as x from lines)
  where x <> '' window w as (partition by doc_id order by i)
), d as (select doc_id, list(x order by i) as xs, list(i order by i) as ps from kept group by doc_id
), spans as (
  select doc_id, r as a, r + 2 as b from kept
  union select doc_id, r, r from kept where length(x) >= 300
  union select s.doc_id, s.r, s.r + 1 from kept s join kept t on t.doc_id = s.doc_id and t.r = s.r + 1 where s.n > 50 or t.n > 50
  union select s.doc_id, s.r, min(t.r) from kept s join kept t
    on t.doc_id = s.doc_id and t.r between s.r and s.r + 50 and t.upto - s.upto + s.n > 50 group by s.doc_id, s.r
  union select t.doc_id, max(s.r), t.r from kept s join kept t
    on t.doc_id = s.doc_id and t.r between s.r and s.r + 50 and t.upto - s.upto + s.n > 50 group by t.doc_id, t.r
), runs as (
  select doc_id, ps[a] as a, ps[b] as b, md5(array_to_string(xs[a:b], chr(10))) as content from spans join d using (doc_id) where b <= len(xs)
), places as (
  select *, row_number() over (partition by content order by doc_id, a) as n from runs
), gone as (
  select distinct doc_id, unnest(generate_series(a, b)) as i from places where n > 1
), lists as (
  select l.doc_id, count(*) as n_lines, count(g.i) as n_removed,
         coalesce(string_agg(l.i::varchar, ',' order by l.i) filter (g.i is not null), '') as removed,
         coalesce(string_agg(l.line, chr(10) order by l.i) filter (g.i is null), '') as left_text
  from lines l left join gone g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id
)
select doc_id, n_lines, n_removed, removed, sha256(left_text) as kept_sha256 from lists
"""

OP5_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), win as (
  select doc_id, i, array_to_string(w[i:i + 7], ' ') as content
  from (select doc_id, w, unnest(generate_series(1, len(w) - 7)) as i from d)
), again as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, content) as n from win) where n > 1
), repeated as (
  select doc_id, count(distinct i + k) as n from again, (select unnest(generate_series(0, 7)) as k) group by doc_id
), dup as (
  select doc_id, count(*) - count(distinct line) as n
  from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), c as (
  select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines,
         coalesce(repeated.n, 0) as n_repeat_words, len(string_split(t, chr(10))) as n_lines,
         length(t) - length(replace(t, '!', '')) as n_exclaimed
  from d left join dup using (doc_id) left join repeated using (doc_id)
), f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not 5 * n_symbols > n_words and not 2 * n_exclaimed > n_words
       and not (n_lines >= 6 and 10 * n_dup_lines > 6 * n_lines)
       and not (word_chars < 2 * n_words or word_chars > 25 * n_words) as kept
from f
"""

OP7_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as passage
  from (select item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as i from b where len(w) > 0)
), sizes as (select distinct n from bw
), dw as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as passage
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, sizes)
), hits as (select doc_id, item_id, dw.n, i from dw join bw on dw.n = bw.n and dw.passage = bw.passage
), covered as (
  select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(generate_series(i, i + n - 1)) as p from hits) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id
)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join named using (doc_id)
"""

OP10_SQL = r"""
with p as (
  select page_id, encode(coalesce(html, '')) as raw from pages
), h as (
  select page_id, octet_length(raw) as payload_bytes, sha1(raw) as x from p
), n as (
  select *, list_transform(generate_series(0, 7), lambda g: ('0x' || substr(x, 1 + 5 * g::int, 5))::int) as v,
         min(page_id) over (partition by x) as first from h
)
select page_id, payload_bytes,
       array_to_string(list_transform(v, lambda a: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((a >> s) & 31) + 1, 1)), '')), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from n
"""

OP11_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as x from documents)
select doc_id, min(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size,
       row_number() over (partition by x order by doc_id nulls last) = 1 as kept, sha256(x) as text_sha256
from n
"""


OP12_SQL = r"""
with ids as (select distinct conv_id, conv_id - conv_id % 100 as base, conv_id::varchar as s from conversations where conv_id is not null
), n as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) - 1 as i,
         md5(coalesce(role, '')) || md5(coalesce(text, '')) as t, length(coalesce(text, '')) as chars
  from conversations where conv_id is not null
), h as (
  select conv_id, base, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i:i])::bigint)),
    lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)),
    4294967295) % 6 as h from ids
), r as (
  select h.conv_id, 0 as own, n.i, n.t, n.chars from h join n on n.conv_id = h.base and n.i < h.h
  union all select h.conv_id, 1, n.i, n.t, n.chars from h join n on n.conv_id = h.conv_id and n.i >= h.h
), p as (
  select conv_id, list(t order by own, i) as ts, list(chars order by own, i) as cs from r group by conv_id
), c as (
  select h.conv_id, coalesce(ts, []) as ts, coalesce(cs, []) as cs from h left join p using (conv_id)
), m as (
  select conv_id, d, ts[1:d] as path, case when d = 0 then 0 else cs[d] end as chars, d = len(ts) as is_end
  from (select conv_id, ts, cs, unnest(range(0, len(ts) + 1)) as d from c)
), nodes as (
  select path, d as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (is_end), '')) as ends_sha256
  from m group by path, d
), k as (
  select n.*, (select count(*) from nodes y where y.depth = n.depth + 1 and y.path[1:n.depth] = n.path) as n_children from nodes n
), sub as (
  select x.path, sum((y.n_convs - 1) * y.chars) as saved_tokens, count(*) filter (y.n_children = 0) as n_leaves
  from k x join k y on y.depth >= x.depth and y.path[1:x.depth] = x.path group by x.path
)
select k.conv_id, k.depth, u.conv_id as parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens::bigint as saved_tokens, k.ends_sha256
from k join sub using (path) left join k u on k.depth > 0 and u.path = k.path[1:k.depth - 1]
"""


def merkle_sql(levels: int = 5, upper: int = 3) -> str:
    """The manifest for sources of at most 16 ** levels rows, and 16 ** upper sources."""
    field = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """
  list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i:i])::bigint)), lambda r, b:
    list_reduce(list_prepend(xor(r, b), range(8)), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end))"""
    steps = [f"""
d as (select *, doc_id::varchar as s from documents),
f as (select *, coalesce(xor({crc}, 4294967295) % 5 = 0, false) as tampered from d),
leaves as (
  select doc_id, source, {leaf("text")} as leaf, case when tampered then {leaf(low)} else {leaf("text")} end as seen from f
),
a0 as (
  select row_number() over () as id, source as tree, leaf as x, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as p
  from leaves
)"""]

    def grow(a: str, count: int) -> None:
        """Nodes of each level with what is left and right of them in their run."""
        for k in range(count):
            steps.append(f"""
{a}{k}s as (
  select *, p // 16 as up, count(*) over (partition by tree) as n,
         coalesce(string_agg(x, '') over (partition by tree, p // 16 order by p rows between unbounded preceding and 1 preceding), '') as l,
         coalesce(string_agg(x, '') over (partition by tree, p // 16 order by p rows between 1 following and unbounded following), '') as r
  from {a}{k}
),
{a}{k + 1} as (select tree, up as p, case when any_value(n) = 1 then any_value(x) else sha256(string_agg(x, '' order by p)) end as x from {a}{k}s group by tree, up)""")

    grow("a", levels)
    steps.append(f"""
b0 as (select 0 as tree, tree as source, x, row_number() over (order by tree nulls first) - 1 as p from a{levels})""")
    grow("b", upper)
    steps.append(f"""
w0 as (
  select y.*, z.x as subroot, (select x from b{upper}) as root, z.p as place, y.seen as folded, '' as proof, a.p as spot
  from (select row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as p0, * from leaves) y
  join a0 a on a.tree is not distinct from y.source and a.p = y.p0 join b0 z on z.source is not distinct from y.source
)""")
    for k in range(levels + upper):
        a, at, same = (f"a{k}s", "spot", "is not distinct from w.source") if k < levels else (f"b{k - levels}s", "place", "= 0")
        rest = f"w.{at} // 16"
        steps.append(f"""
w{k + 1} as (
  select w.doc_id, w.source, w.leaf, w.subroot, w.root, {f"w.place, {rest} as spot" if k < levels else f"{rest} as place, w.spot"},
         case when n = 1 then folded else sha256(l || folded || r) end as folded, proof || l || r as proof
  from w{k} w join {a} v on v.tree {same} and v.p = w.{at}
)""")
    return "with " + ",".join(steps) + f"""
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified from w{levels + upper}
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_dedup, op2_secret_scan, op3_toxicity, op4_sharding, op5_quality_rules, op6_suffix_dedup, op7_decontamination,
    op8_minhash_dedup, op9_bpe, op10_warc, op11_exact_dedup, op12_prefix_trie, op13_merkle_manifest,
)}
ORACLES = {"op1_line_dedup": OP1_SQL, "op5_quality_rules": OP5_SQL, "op7_decontamination": OP7_SQL, "op10_warc": OP10_SQL, "op11_exact_dedup": OP11_SQL, "op12_prefix_trie": OP12_SQL,
           "op13_merkle_manifest": merkle_sql()}
